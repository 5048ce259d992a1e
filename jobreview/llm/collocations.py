"""Phrase collocations by direct-address tiles, counted level by level.

Words with enough occurrences get ids along their frequency, and texts become
sequences of ids. A pair of neighbours is an address in a matrix of ids, cut into
tiles of ``TILE`` cells. Where a tile is filled well it is counted by address
(``bincount``), where it is not as sorted coordinates. Because frequent words
have small ids, the dense tiles lie together at the matrix's corner. Pairs that
are frequent enough are ranked and become the symbols of the next level: two
neighbouring pairs that overlap are three words, two such triples are four. No
phrase is missed, because the parts of a frequent phrase are frequent.

Each task counts what it has read before anything is shuffled, at most
``HELD`` pairs at a time; a tile's counts then meet in the task that owns it, a
stream of partial counts whose memory is that of the distinct pairs.

The tables of ids go to all tasks: whole up to ``MAX_TABLE_BYTES``, beyond that in
slices, of which a task holds one at a time while it looks up the distinct words or
pairs of a block of its sequences. Nothing is shuffled for it. From ``SLICES``
slices on sequences are renamed by a join, a row for each place.

Defined results: null texts are empty; a null language is ``und``; rows are not
compared, so repeated rows count each time; ids are not read, nor any other
column. Texts of any length are read whole: a sequence is stored in rows of
``CHUNK`` symbols that overlap. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobreview.llm.common import LOWER_ASCII, batch_rows, pieces_of, written
from jobreview.operators.numbering import numbered
from jobreview.operators.sizing import measured_bytes

MIN_COUNT = 30
TOP = 2000
MAX_WORDS = 4
TILE = (16, 1024)
# A tile is counted by address if it holds an entry for each so many cells.
DENSE = 8
HELD = 1 << 22
CHUNK = 1 << 14
MAX_TABLE_BYTES = 32 << 20
# The most slices of a larger table, each a quarter of the above.
SLICES = 64

# What ends a piece, as a table over bytes of UTF-8 that makes
# each of them a line feed; capitals become small letters as well.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PIECE_BYTES = bytes(10 if b in _ENDS else b for b in LOWER_ASCII)


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text in UTF-8."""
    for part in pieces_of(data.translate(_PIECE_BYTES), b"\n"):
        for piece in part.split(b"\n"):
            # Of the bytes that ``split`` takes for white space only blank and
            # tabulator are left.
            if words := piece.split():
                yield words


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    texts = batch.column("text").cast(pa.binary())
    for lang, data in zip(batch.column("lang").to_pylist(), texts, strict=True):
        yield lang, data.as_py() or b""


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = defaultdict(Counter)

    def flushed():
        for lang, words in counts.items():
            names = pa.array([w.decode(errors="replace") for w in words], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), names, pa.array(list(words.values()), pa.int64())],
                names=["lang", "phrase", "f"],
            )
        counts.clear()

    for batch in batches:
        for lang, data in _texts(batch):
            for words in pieces(data):
                counts[lang].update(words)
            if sum(map(len, counts.values())) > HELD // 8:
                yield from flushed()
    yield from flushed()


# Sequences ------------------------------------------------------------------
#
# A row holds ``syms``, ids with -1 where nothing may reach across, and ``own``,
# how many of its places start a phrase here: the symbols after them are also in
# the next row, where they start theirs.


def _chunks(syms: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(own, symbols) with breaks drawn together."""
    gap = syms < 0
    syms = syms[~(gap & np.concatenate(([True], gap[:-1])))] if len(syms) else syms
    for start in range(0, len(syms), CHUNK):
        part = syms[start : start + CHUNK + MAX_WORDS - 1]
        yield min(CHUNK, len(syms) - start), part


def _batch(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *[len(s) for _, s in rows]]), pa.int32()),
        pa.array(np.concatenate([s for _, s in rows]) if rows else [], pa.int32()),
    )
    return pa.RecordBatch.from_arrays([pa.array([own for own, _ in rows], pa.int32()), lists], names=["own", "syms"])


def _slices(total: int, max_table_bytes: int) -> int:
    """In how many slices a table of ids goes to the tasks; 0: not at all."""
    if total <= max_table_bytes:
        return 1
    n = -(-4 * total // max_table_bytes) if max_table_bytes else SLICES + 1
    return n if n <= SLICES else 0


def _each(tables: list) -> Iterator:
    """The slices, one in memory at a time: a broadcast would keep its value."""
    for table in tables:
        path = getattr(table, "_path", None)
        yield table.load_from_path(path) if path else table.value


class _Numbers(dict):
    """Words by their first place."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _encode_sliced(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    """As ``_encode``, a block of texts at a time, whose words are numbered first."""
    numbers: dict[str, _Numbers] = defaultdict(_Numbers)
    held, size = [], 0

    def flushed():
        # The last id is that of breaks.
        ids = {lang: np.full(len(own) + 1, -1, np.int32) for lang, own in numbers.items()}
        for table in _each(tables):
            for lang, own in numbers.items():
                if known := table.get(lang):
                    found = np.fromiter(map(known.get, own, repeat(-1)), np.int32, len(own))
                    np.maximum(ids[lang][:-1], found, out=ids[lang][:-1])
        return _batch([row for lang, syms in held for row in _chunks(ids[lang][syms])])

    for batch in batches:
        for lang, data in _texts(batch):
            own, syms = numbers[lang], []
            for words in pieces(data):
                syms.extend(map(own.__getitem__, words))
                syms.append(-1)
            held.append((lang, np.array(syms, np.int32)))
            size += len(syms)
        if size > HELD // 2 or sum(map(len, numbers.values())) > HELD // 8:
            yield flushed()
            numbers.clear()
            held, size = [], 0
    yield flushed()


def _encode(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    if len(tables) > 1:
        yield from _encode_sliced(batches, tables)
        return
    ids = tables[0].value
    for batch in batches:
        rows = []
        for lang, data in _texts(batch):
            known, syms = ids.get(lang), []
            if known:
                for words in pieces(data):
                    syms.extend(map(known.get, words, repeat(-1)))
                    syms.append(-1)
            rows.extend(_chunks(np.array(syms, np.int32)))
        yield _batch(rows)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all rows, where each row starts, and which places are owned."""
    lists = batch.column("syms")
    starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    syms, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    at = np.arange(len(syms)) - np.repeat(starts, sizes)
    return syms, np.repeat(np.arange(len(sizes)), sizes), at < np.repeat(batch.column("own").to_numpy(), sizes)


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    """The key of each pair of neighbours that starts here; -1 where there is none."""
    syms, row, owned = _flat(batch)
    if len(syms) < 2:
        return np.zeros(0, np.int64)
    x, y = syms[:-1].astype(np.int64), syms[1:].astype(np.int64)
    there = (x >= 0) & (y >= 0) & (row[:-1] == row[1:])
    return np.where(there, (x << 32) | y, -1)


def _ids(found: np.ndarray, tables: list) -> np.ndarray:
    """The ids of pair keys by ``tables`` (sorted keys, ids), -1 for those that
    none holds. Of several, a key's is the one that ``_slice_of`` says."""

    def looked_up(found, keys, ids):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        return np.where(keys[at] == found, ids[at], -1) if len(keys) else np.full(len(found), -1)

    if len(tables) == 1:
        return looked_up(found, *tables[0].value).astype(np.int32)
    distinct, inverse = np.unique(found, return_inverse=True)
    ids, own = np.full(len(distinct), -1, np.int32), _slice_of(distinct >> 32, distinct & 0xFFFFFFFF, len(tables))
    for i, table in enumerate(_each(tables)):
        at = np.flatnonzero(own == i)
        ids[at] = looked_up(distinct[at], *table)
    return ids[inverse]


def _slice_of(x, y, n: int):
    """Of columns as of arrays: ids are dense, so the slices are even."""
    return (x + y) % n


def _rename(batches: Iterator[pa.RecordBatch], tables: list) -> Iterator[pa.RecordBatch]:
    """Sequences of the pairs that ``tables`` hold."""
    held, size = [], 0

    def renamed_batches():
        keys = [_pairs(batch) for batch in held]
        named = np.split(_ids(np.concatenate(keys), tables), np.cumsum([len(k) for k in keys])[:-1])
        for batch, ids in zip(held, named, strict=True):
            rows, sizes = [], batch.column("syms").value_lengths().to_numpy()
            new = np.append(ids, -1).astype(np.int32)
            start = 0
            for size, own in zip(sizes, batch.column("own").to_numpy(), strict=True):
                part = new[start : start + size]
                start += size
                gap = part < 0
                stays = ~(gap & np.concatenate(([True], gap[:-1]))) if size else gap
                if (part >= 0).any():
                    rows.append((int(stays[:own].sum()), part[stays]))
            yield _batch(rows)

    for batch in batches:
        held.append(batch)
        size += len(batch.column("syms").flatten())
        if len(tables) == 1 or size > HELD // 2:
            yield from renamed_batches()
            held, size = [], 0
    if held:
        yield from renamed_batches()


# Counting -------------------------------------------------------------------


def tile_counts(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and their sums: dense tiles by address, the rest as
    sorted coordinates. Sums are exact below 2**53."""
    height, width = TILE
    x, y = keys >> 32, keys & 0xFFFFFFFF
    tile = ((x // height) << 32) | (y // width)
    order = np.argsort(tile, kind="stable")
    keys, tile, x, y = keys[order], tile[order], x[order], y[order]
    weights = np.ones(len(keys)) if counts is None else counts[order].astype(np.float64)
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else np.zeros(0, int)
    ends = np.append(starts[1:], len(tile))
    dense = np.flatnonzero((ends - starts) * DENSE >= height * width)
    rest = np.ones(len(keys), bool)
    made_keys, made = [], []
    for i in dense:
        low, high = starts[i], ends[i]
        rest[low:high] = False
        top, left = x[low] // height * height, y[low] // width * width
        cells = np.bincount((x[low:high] - top) * width + (y[low:high] - left), weights[low:high])
        at = np.flatnonzero(cells)
        made_keys.append(((at // width + top) << 32) | (at % width + left))
        made.append(cells[at])
    sparse, inverse = np.unique(keys[rest], return_inverse=True)
    made_keys.append(sparse)
    made.append(np.bincount(inverse, weights[rest], len(sparse)))
    return np.concatenate(made_keys), np.concatenate(made).astype(np.int64)


def _owner(keys: np.ndarray, n: int) -> np.ndarray:
    """The task of a key: that of its tile, mixed so that tiles spread."""
    height, width = TILE
    tile = ((keys >> 32) // height).astype(np.uint64) << np.uint64(32) | ((keys & 0xFFFFFFFF) // width).astype(np.uint64)
    mixed = tile * np.uint64(0x9E3779B97F4A7C15)  # Fixed value: an odd number near 2**64 over the golden ratio
    return ((mixed >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


class _Held:
    """Counts of distinct keys, drawn together whenever they have doubled."""

    def __init__(self):
        self.keys, self.counts, self.size, self.most = [], [], 0, HELD

    def add(self, keys, counts):
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            self.draw()
            self.most = max(HELD, 2 * self.size)

    def draw(self):
        if self.keys:
            keys, counts = tile_counts(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            return keys, counts
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _partial(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Counts of what this task has read, one row per owner and flush."""

    def flushed(held):
        keys, counts = tile_counts(np.concatenate(held))
        owner = _owner(keys, n)
        order = np.argsort(owner, kind="stable")
        keys, counts, owner = keys[order], counts[order], owner[order]
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        offsets = pa.array(np.append(starts, len(owner)), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(owner[starts], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(keys)), pa.ListArray.from_arrays(offsets, pa.array(counts))],
            names=["owner", "keys", "counts"],
        )

    held, size = [], 0
    for batch in batches:
        _, _, owned = _flat(batch)
        found = _pairs(batch)
        found = found[(found >= 0) & owned[: len(found)]]
        if len(found):
            held.append(found)
            size += len(found)
        if size > HELD:
            yield flushed(held)
            held, size = [], 0
    if held:
        yield flushed(held)


def _summed(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in batches:
        held.add(batch.column("keys").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
    keys, counts = held.draw()
    often = counts >= min_count
    keys, counts = keys[often], counts[often]
    yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["x", "y", "f"])


def pair_counts(seqs: DataFrame, tasks: int, min_count: int = MIN_COUNT) -> DataFrame:
    """(x, y, f): the pairs of neighbours with ``min_count`` occurrences or more."""
    partial = seqs.select("own", "syms").mapInArrow(
        lambda batches: _partial(batches, tasks), "owner int, keys array<long>, counts array<long>"
    )
    dealt = partial.repartition(tasks, "owner")
    with batch_rows(seqs.sparkSession, 16):
        return written(dealt.mapInArrow(lambda batches: _summed(batches, min_count), "x long, y long, f long"), "phrase-pairs")


# Levels ---------------------------------------------------------------------


def _ranked(level: DataFrame, *order) -> DataFrame:
    """``level`` with ``id``, its place by frequency."""
    return numbered(level, F.desc("f"), *order, name="id", purpose="phrase-level")


def encoded(texts: DataFrame, words: DataFrame, max_table_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """(part, own, syms): each text as a sequence of word ids."""
    spark = texts.sparkSession
    names = words.select("lang", "phrase", "id")
    if n := _slices(measured_bytes(names), max_table_bytes):
        tables = []
        for i in range(n):
            ids: dict[str, dict[bytes, int]] = defaultdict(dict)
            for row in names.filter(F.col("id") % n == i).collect():
                ids[row["lang"]][row["phrase"].encode()] = row["id"]
            tables.append(spark.sparkContext.broadcast(dict(ids)))
        seqs = texts.mapInArrow(lambda batches: _encode(batches, tables), "own int, syms array<int>")
        return written(seqs.withColumn("part", F.monotonically_increasing_id()), "phrase-seqs")
    cut = texts.mapInArrow(_spelled, "lang string, own int, words array<string>")
    cut = written(cut.withColumn("part", F.monotonically_increasing_id()), "phrase-words")
    rows = cut.select("part", "own", "lang", F.posexplode("words").alias("pos", "phrase"))
    return _joined(rows, words.select("lang", "phrase", "id"), ["lang", "phrase"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in rows of words, as ``_chunks`` of symbols; an empty word is a break."""
    for batch in batches:
        rows = []
        for lang, data in _texts(batch):
            words = [w.decode(errors="replace") for piece in pieces(data) for w in (*piece, b"")]
            for start in range(0, len(words), CHUNK):
                rows.append((lang, min(CHUNK, len(words) - start), words[start : start + CHUNK + MAX_WORDS - 1]))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = (pa.string(), pa.int32(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "own", "words"])


def _joined(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Sequences put together again after each place has learnt its id by a join."""
    named = rows.join(ids.hint("merge"), keys, "left").select(
        "part", "own", "pos", F.coalesce(F.col("id"), F.lit(-1)).cast("int").alias("id")
    )
    inside = F.array_sort(F.collect_list(F.struct("pos", "id")))
    seqs = named.groupBy("part", "own").agg(inside.alias("s"))
    return written(seqs.select("part", "own", F.col("s.id").alias("syms")), "phrase-seqs")


def renamed(seqs: DataFrame, level: DataFrame, max_table_bytes: int = MAX_TABLE_BYTES) -> DataFrame:
    """(part, own, syms): sequences of pairs instead of their symbols."""
    spark, pairs = seqs.sparkSession, level.select("x", "y", "id")
    if n := _slices(pairs.count() * 16, max_table_bytes):
        tables = []
        for i in range(n):
            found = pairs.filter(_slice_of(F.col("x"), F.col("y"), n) == i).toPandas()
            keys = (found["x"].to_numpy() << 32) | found["y"].to_numpy()
            order = np.argsort(keys)
            tables.append(spark.sparkContext.broadcast((keys[order], found["id"].to_numpy()[order].astype(np.int32))))
        new = seqs.select("own", "syms").mapInArrow(lambda batches: _rename(batches, tables), "own int, syms array<int>")
        return written(new.withColumn("part", F.monotonically_increasing_id()), "phrase-seqs")
    both = F.arrays_zip(F.col("syms").alias("x"), F.slice("syms", F.lit(2), F.size("syms")).alias("y"))
    rows = seqs.filter(F.size("syms") > 1).select("part", "own", F.posexplode(both).alias("pos", "p"))
    rows = rows.select("part", "own", "pos", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))
    return _joined(rows, pairs, ["x", "y"])


def phrase_counts(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_table_bytes: int = MAX_TABLE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to four words with
    ``min_count`` occurrences, and (lang, n), the words of each language."""
    spark = docs.sparkSession
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    with batch_rows(spark):
        counted = texts.mapInArrow(_count_words, "lang string, phrase string, f long")
        words = written(counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "phrase-words")
        totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
        tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // (HELD // 2) + 1)
        level = _ranked(words.filter(F.col("f") >= min_count), "lang", "phrase")
        level = written(level.withColumn("last", F.col("phrase")), "phrase-symbols")
        seqs = encoded(texts, level, max_table_bytes)
    found = [level.select("lang", "phrase", F.lit(1).alias("n_words"), "f")]
    for n_words in range(2, MAX_WORDS + 1):
        if n_words > 2:
            with batch_rows(spark):
                seqs = renamed(seqs, level, max_table_bytes)
        symbols = level
        level = _ranked(pair_counts(seqs, tasks, min_count), "x", "y")
        first = symbols.select(F.col("id").alias("x"), "lang", F.col("phrase").alias("head"))
        second = symbols.select(F.col("id").alias("y"), "last")
        named = level.join(first, "x").join(second, "y")
        level = written(named.select("x", "y", "id", "lang", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last"), "phrase-symbols")
        found.append(level.select("lang", "phrase", F.lit(n_words).alias("n_words"), "f"))
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return phrases, totals


def _exact(expression: str) -> str:
    return f"cast({expression} as decimal(20,0))"


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, max_table_bytes: int = MAX_TABLE_BYTES,
) -> DataFrame:
    """Each language's ``top`` phrases of two to four words: lang, rank, phrase,
    a, l, r, n, score. The score is that of the weakest cut of the phrase in two,
    floor(2000000 a / (l + r)); a phrase that stands inside a longer one at least
    four times out of five is left out."""
    counts, totals = phrase_counts(docs, text_col, lang_col, min_count, max_table_bytes)
    phrases = counts.filter("n_words > 1").withColumn("words", F.split("phrase", " "))

    def part(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    cuts = phrases.select("lang", "phrase", "words", "n_words", "f", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "f", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr(f"cast((cast(2000000 as decimal(7,0)) * {_exact('f')}) div ({_exact('l')} + {_exact('r')}) as long)")
    weakest = cuts.groupBy("lang", "phrase", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = phrases.filter("n_words > 2")
    sizes = longer.select("lang", "words", "n_words", "f", F.explode(F.expr("sequence(2, n_words - 1)")).alias("size"))
    inside = sizes.select("lang", "words", "f", "size", F.explode(F.expr("sequence(1, n_words - size + 1)")).alias("start"))
    inside = inside.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("f").alias("most"))
    held = weakest.join(inside, ["lang", "phrase"], "left")
    free = F.col("most").isNull() | F.expr(f"{_exact('most')} * 100 < {_exact('f')} * 80")
    rows = held.filter(free).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(ws) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), c AS (SELECT lang, k AS m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1
), u AS (
  SELECT c.*, j, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:m], ' ')
), b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM u
), i AS (
  SELECT lang, array_to_string(ws[s:s + z - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS z FROM c)) GROUP BY ALL
), k AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase) WHERE o = 1 AND (most IS NULL OR most * 100 < a * 80)
)
SELECT * FROM k WHERE rank <= 2000
"""

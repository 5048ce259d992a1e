"""Removal of byte strings that repeat anywhere in the corpus, by suffix arrays.

Every byte covered by a ``WIDTH``-byte string that also starts elsewhere goes.
One sorted array of all suffixes would hold several records per byte of text.
Here suffixes are dealt to blocks such that equal strings meet:

* A window (``WIDTH`` bytes) belongs to the smallest hash of its ``GRAM``-byte
  strings. Equal windows have equal hashes at equal places, so they share this
  *anchor*. Neighbouring windows with one anchor form a *piece*.
* Anchors that occur once cannot hold a repeat and drop out (a key filter sized
  from the others; passing too much is harmless). Equal pieces are counted, byte
  by byte equal ones, one of each is kept: what occurs twice as a whole repeats in
  every window. A text that repeats itself at a short distance has few distinct
  pieces: each part of a text emits every distinct piece once, with its count, and
  a run of equal pieces as one place.
* The distinct pieces of the remaining anchors go to blocks by anchor, and the
  suffixes of each block are sorted by the difference-cover algorithm
  (``suffix_array``): sampled triples, recursion on their names, merge of the
  rest; then neighbours are compared. Anchors with too many distinct pieces for
  a block are judged window by window, counted by two hashes.

Then the texts take their marks. Work follows the bytes; a long text is cut into
parts that overlap by a window.

Defined results: null texts count as empty; texts shorter than the width have
nothing to remove; equal texts get equal results and remove each other; ids do
not matter, null or repeated; an empty table gives an empty result; other
columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobreview.llm.common import small_batches, written
from jobreview.llm.suffix_array import repeated_windows
from jobreview.operators.keyfilter import reduced

WIDTH = 200
GRAM = 32
BLOCK = 1_000_000
# Distinct pieces of one anchor that still go to one block.
MAX_PIECES = 3_000
PART = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Anchors and pieces of texts, by rolling hashes."""

    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram = width, gram
        self.up, self.down = powers(_BASE, PART + width + 1), powers(_INVERSE, PART + width + 1)

    def pieces(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor key, piece hash, first window, windows) of one part."""
        n, width, gram = len(data), self.width, self.gram
        if n < width:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        keys = mixed((sums[gram:] - sums[:-gram]) * self.down[: n - gram + 1])
        # The upper half of the hash, then the place: the leftmost of equal ones.
        low = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
        span, reach = 1, width - gram + 1
        while span * 2 <= reach:
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        if span < reach:
            low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        at = anchor[first]
        stop = first + count + width - 1
        whole = (sums[stop] - sums[first]) * self.down[first]
        shape = ((at - first) * 1024 + count).astype(np.uint64) * np.uint64(_BASE)
        return keys[at].view(np.int64), mixed(whole ^ shape).view(np.int64), first, count


def _parts(n: int, width: int) -> Iterator[tuple[int, int]]:
    """Parts of a text that hold each window once."""
    start = 0
    while True:
        stop = min(n, start + PART)
        yield start, stop
        if stop == n:
            return
        start = stop - width + 1


def _distinct(key: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index of each different piece, and how often it occurs."""
    order = np.lexsort((piece, key))
    key, piece = key[order], piece[order]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
    return order[new], np.diff(np.append(new, len(order)))


def _runs(key: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal pieces. Pieces that follow one
    another start as far apart as they have windows."""
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
    return new, np.diff(np.append(new, len(key)))


# Bytes of pieces, or rows, that a task holds before it hands them on.
FLUSH_BYTES, FLUSH_ROWS = 8 << 20, 1 << 18


def _emit(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces. ``kind``: keys (the anchor and a count), bytes (with the
    piece's bytes) or places (with the text's hashes, the first window and how
    many equal pieces follow one another)."""
    anchors = Anchors()
    for batch in batches:
        held: list[list[np.ndarray]] = []
        size = 0
        for i, text in enumerate(batch.column("data")):
            data = np.frombuffer(text.as_buffer() or b"", np.uint8)
            for start, stop in _parts(len(data), WIDTH):
                key, piece, first, count = anchors.pieces(data[start:stop])
                if not len(key):
                    continue
                at, times = _runs(key, piece) if kind == "places" else _distinct(key, piece)
                lengths = count[at] + WIDTH - 1 if kind == "bytes" else np.full(len(at), FLUSH_BYTES // FLUSH_ROWS)
                # So many rows at a time that they hold no more than is flushed.
                cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // FLUSH_BYTES)) + 1
                for rows in np.split(np.arange(len(at)), cuts):
                    pick = at[rows]
                    row = [key[pick], piece[pick], count[pick], first[pick] + start, times[rows]]
                    if kind == "bytes":
                        ends = np.cumsum(lengths[rows])
                        take = np.arange(int(ends[-1])) - np.repeat(ends - lengths[rows] - first[pick] - start, lengths[rows])
                        row += [lengths[rows], data[take]]
                    elif kind == "places":
                        row += [np.full(len(pick), batch.column(name)[i].as_py()) for name in ("text_a", "text_b")]
                    held.append(row)
                    size += int(lengths[rows].sum())
                    if size >= FLUSH_BYTES:
                        yield _batch(held, kind)
                        held, size = [], 0
        if held:
            yield _batch(held, kind)


def _batch(held: list[list[np.ndarray]], kind: str) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    out = {"key": pa.array(columns[0])}
    if kind != "keys":
        out |= {"piece": pa.array(columns[1]), "windows": pa.array(columns[2].astype(np.int32))}
    if kind == "bytes":
        ends = np.concatenate([[0], np.cumsum(columns[5])]).astype(np.int32)
        out["bytes"] = pa.Array.from_buffers(pa.binary(), len(columns[0]), [None, pa.py_buffer(ends), pa.py_buffer(columns[6])])
    if kind == "places":
        out |= {"first": pa.array(columns[3].astype(np.int64)), "times": pa.array(columns[4].astype(np.int64))}
        out |= {"text_a": pa.array(columns[5].astype(np.int64)), "text_b": pa.array(columns[6].astype(np.int64))}
    else:
        out["n"] = pa.array(columns[4].astype(np.int64))
    return pa.RecordBatch.from_pydict(out)


ROWS = {
    "keys": "key long, n long",
    "bytes": "key long, piece long, windows int, bytes binary, n long",
    "places": "key long, piece long, windows int, first long, times long, text_a long, text_b long",
}
JUDGED = "key long, piece long, marks binary"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of distinct pieces that come sorted by anchor; a block holds whole anchors."""
    rows: list[tuple] = []
    size = 0

    def block(done: list[tuple]) -> pa.RecordBatch:
        marks = [b""] * len(done)
        open_: list[int] = []
        at = 0
        while at < len(done):
            end = at
            while end < len(done) and done[end][0] == done[at][0]:
                end += 1
            for i in range(at, end):
                if done[i][4] > 1:
                    marks[i] = np.packbits(np.ones(done[i][2], bool)).tobytes()
            if end - at > 1:
                open_ += range(at, end)
            at = end
        if open_:
            data = np.frombuffer(b"".join(done[i][3] for i in open_), np.uint8)
            lengths = np.array([len(done[i][3]) for i in open_])
            windows = np.array([done[i][2] for i in open_])
            first = np.cumsum(lengths) - lengths
            ends = np.cumsum(windows)
            starts = np.arange(int(ends[-1])) - np.repeat(ends - windows - first, windows)
            found = repeated_windows(data, starts, WIDTH)
            for i, part in zip(open_, np.split(found, ends[:-1]), strict=True):
                if done[i][4] == 1 and part.any():
                    marks[i] = np.packbits(part).tobytes()
        keep = [i for i, m in enumerate(marks) if m]
        return pa.RecordBatch.from_pydict(
            {
                "key": pa.array([done[i][0] for i in keep], pa.int64()),
                "piece": pa.array([done[i][1] for i in keep], pa.int64()),
                "marks": pa.array([marks[i] for i in keep], pa.binary()),
            }
        )

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BLOCK // 2 and row[0] != rows[-1][0]:
                yield block(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield block(rows)


def _by_window(pieces: DataFrame) -> DataFrame:
    """Marks of pieces whose anchor has too many: windows counted by two hashes."""
    at = F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("at")
    rows = pieces.select("key", "piece", "windows", "n", "bytes", at)
    window = F.expr(f"substring(bytes, at + 1, {WIDTH})")
    rows = rows.select("key", "piece", "windows", "n", "at", F.xxhash64(window).alias("a"), F.xxhash64(F.lit(1), window).alias("b"))
    often = rows.groupBy("a", "b").agg(F.sum("n").alias("all")).filter("all > 1").select("a", "b")
    found = rows.join(often, ["a", "b"]).groupBy("key", "piece", "windows").agg(F.collect_set("at").alias("found"))
    bits = F.transform(F.sequence(F.lit(0), F.ceil(F.col("windows") / 8).cast("int") * 8 - 1), lambda i: F.array_contains("found", i).cast("int").cast("string"))
    nibbles = F.transform(F.sequence(F.lit(0), F.ceil(F.col("windows") / 8).cast("int") * 2 - 1), lambda i: F.lpad(F.conv(F.array_join(F.slice(bits, i * 4 + 1, 4), ""), 2, 16), 1, "0"))
    return found.select("key", "piece", F.unhex(F.array_join(nibbles, "")).alias("marks"))


def repeated_pieces(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, piece, marks) of the pieces with repeated windows, and the anchors
    that occur twice. ``texts``: data (binary), text_a, text_b."""
    keys = texts.mapInArrow(lambda b: _emit(b, "keys"), ROWS["keys"])
    twice = keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    twice = written(twice, "anchors")
    pieces = reduced(texts.mapInArrow(lambda b: _emit(b, "bytes"), ROWS["bytes"]), twice, ["key"])
    # Grouped by the bytes themselves: pieces that only share a hash stay apart.
    pieces = written(pieces.groupBy("key", "piece", "windows", "bytes").agg(F.sum("n").alias("n")), "pieces")
    groups = pieces.groupBy("key").agg(F.count("*").alias("pieces"), F.max("n").alias("most"))
    hot = written(groups.filter(F.col("pieces") > MAX_PIECES).select("key"), "anchors-hot")
    alone = groups.filter((F.col("pieces") > 1) | (F.col("most") > 1)).select("key")
    wanted = pieces.join(alone, "key", "left_semi").join(hot, "key", "left_anti")
    wanted = wanted.select("key", "piece", "windows", "bytes", "n").repartition("key").sortWithinPartitions("key")
    judged = wanted.mapInArrow(_judge, JUDGED)
    marks = judged.unionByName(_by_window(pieces.join(hot, "key", "left_semi")))
    return written(marks, "piece-marks"), twice


def _covered(data: np.ndarray, places: list[dict]) -> np.ndarray:
    starts = np.zeros(len(data) + 1, np.int64)
    for place in places:
        marks = np.unpackbits(np.frombuffer(place["marks"], np.uint8))[: place["windows"]]
        first, windows = place["first"], place["windows"] * place["times"]
        starts[first : first + windows] |= np.tile(marks, place["times"])
    open_ = np.cumsum(starts[:-1])
    before = np.concatenate([np.zeros(min(WIDTH, len(data)), np.int64), open_[:-WIDTH]]) if len(data) else open_
    return open_ - before > 0


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, places in zip(batch.column("data"), batch.column("places").to_pylist(), strict=True):
            data = np.frombuffer(text.as_buffer() or b"", np.uint8)
            gone = _covered(data, places) if places else np.zeros(len(data), bool)
            kept = data[~gone].tobytes()
            edges = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            rows.append((len(data), int(gone.sum()), int(edges.sum()), hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array(c, schema.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document;
    ``kept`` are the remaining bytes."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession, 500)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        text.cast("binary").alias("data"),
        F.xxhash64(text).alias("text_a"),
        F.xxhash64(F.lit(1), text).alias("text_b"),
    )
    texts = rows.select("data", "text_a", "text_b")
    marks, twice = repeated_pieces(texts)
    places = reduced(texts.mapInArrow(lambda b: _emit(b, "places"), ROWS["places"]), twice, ["key"]).distinct()
    places = (
        places.join(marks, ["key", "piece"])
        .groupBy("text_a", "text_b")
        .agg(F.collect_list(F.struct("first", "windows", "times", "marks")).alias("places"))
    )
    # One row a text on the right side, so AQE may split a text that many rows share.
    joined = rows.join(places, ["text_a", "text_b"], "left").select("id", "data", "places")
    out = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    schema = to_arrow_schema(out)
    return joined.mapInArrow(lambda b: _cut(b, schema), out).withColumnRenamed("id", id_col)

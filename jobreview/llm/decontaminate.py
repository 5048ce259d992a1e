"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts become words (runs of letters and digits, lower case). Each fixed mask
keeps some of the words that it spans and ignores the others; hashes of the kept
words of benchmark items and of documents are joined. Around a hit the whole
item is laid over the document at the hit's offset, and the share of item words
that stand there is its similarity: substituted words cost their share only.
A document is contaminated by the items with a similarity of at least 0.8.

Masks of five words find every such overlap with items of most lengths; for the
few lengths at which some patterns of substitutions slip through, masks of four
words are added, and items of up to four words, of which none may be substituted,
are their own mask. So no overlap at 0.8 is without a seed. Which masks are in use
is known from the lengths of the items.

A hit is a document, an item and an offset, no more: the words stay where they
are, however often a long document is hit. A benchmark whose seeds fit the
broadcast limit is looked up where the document is read; for a larger one places
pass a Bloom filter of the seeds and then meet them by shuffle. The distinct hits
are stored, and only the documents that have one are cut into words again, to be
verified. Spark's own estimates choose no broadcast of the benchmark: they are
made from the size of its file, and its seeds are many times that.

Defined results: null and empty texts, and items without a word, match
nothing; a short item matches wherever its words stand in a row; items that occur twice, or share an id, count once per id with their
best similarity; null item ids are left out; documents equal in id and text get
equal results, null ids included; without items nothing is contaminated; an
empty table of documents gives an empty result; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.llm.common import fresh, written
from jobreview.operators.keyfilter import key_filter, may_hold, reduced
from jobreview.operators.sizing import measured_bytes

# Positions kept by each mask; five words, so that chance rarely gives a hit.
# Ignoring every fifth word, the third mask hits what lost one word in five.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 3, 4, 6))
LIGHT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4))
# Words of items that need the light masks, and of items that are matched whole.
LIGHT_LENGTHS = (5, 6, 7, 10, 11, 15)
WHOLE_LENGTHS = (1, 2, 3, 4)
WEIGHT = 5
SIMILARITY = 0.8
NOT_WORD = r"[^\p{L}\p{N}]+"
MAX_BROADCAST = 32 * 1024 * 1024


def word_hashes(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def masks_for(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks that an item of so many words is sought by."""
    if n_words in WHOLE_LENGTHS:
        return (tuple(range(n_words)),)
    return MASKS + (LIGHT_MASKS if n_words in LIGHT_LENGTHS else ())


def _masks_in_use(items: DataFrame) -> list[tuple[int, ...]]:
    """The masks for the lengths of the items: at most eleven."""
    longest = max(LIGHT_LENGTHS) + 1
    lengths = items.select(F.least(F.size("item"), F.lit(longest)).alias("n")).distinct().collect()
    used = {mask for row in lengths for mask in masks_for(row["n"])}
    return sorted(used, key=lambda mask: (-len(mask), mask)) or list(MASKS)


def _places(rows: DataFrame, hashes: str, masks: list[tuple[int, ...]], *keep: str, of_items: bool = False) -> DataFrame:
    """One row for each place and mask that fits: ``keep``, at, seed. Items take
    the masks for their length only. The expressions are small: Java compiles no
    method as long as a case for each mask would make it."""
    count, n = len(masks), F.size(hashes)
    least = min(len(mask) for mask in masks)
    steps = F.when(n >= least, F.sequence(F.lit(0), n * count - 1))
    rows = rows.select(*keep, hashes, F.explode(steps).alias("step"))
    at, mask = F.expr(f"cast(step div {count} as int)"), F.expr(f"step % {count}")
    rows = rows.select(*keep, hashes, at.alias("at"), mask.alias("mask"))
    spans = F.array(*[F.lit(m[-1]) for m in masks])
    fitting = rows.filter(F.col("at") + F.get(spans, F.col("mask")) < n)
    if of_items:
        takes = {
            length: F.array(*[F.lit(i) for i, m in enumerate(masks) if m in masks_for(length)]).cast("array<int>")
            for length in (*WHOLE_LENGTHS, *LIGHT_LENGTHS)
        }
        taken = F.array(*[F.lit(i) for i, m in enumerate(masks) if m in MASKS]).cast("array<int>")
        for length, numbers in takes.items():
            taken = F.when(n == length, numbers).otherwise(taken)
        fitting = fitting.filter(F.array_contains(taken, F.col("mask").cast("int")))
    # A mask of fewer words has no place for the others: null, which hashes as nothing.
    kept = [F.array(*[F.lit(m[k] if k < len(m) else None).cast("int") for m in masks]) for k in range(WEIGHT)]
    places = [F.col("at") + F.get(offsets, F.col("mask")) for offsets in kept]
    name = F.get(F.array(*[F.lit("-".join(map(str, m))) for m in masks]), F.col("mask"))
    seed = F.xxhash64(name, *[F.get(hashes, place) for place in places])
    return fitting.select(*dict.fromkeys([*keep, hashes]), "at", seed.alias("seed"))


def _similarity(doc: str, item: str, offset: Column) -> Column:
    """Share of the item's words that stand in the document at ``offset``."""
    n = F.size(item)
    same = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(doc, offset + k) == F.get(item, k))
    return F.size(same) / n


def _tokens(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return docs.select(*keys, word_hashes(F.col("text").cast("string")).alias("words"))


def _hits(tokens: DataFrame, keys: tuple[str, ...], masks: list[tuple[int, ...]], seeds: DataFrame, small: bool) -> DataFrame:
    """(keys, item_key, offset) of every place that shares a seed with an item,
    stored, each once."""
    places = _places(tokens, "words", masks, *keys).drop("words")
    if small:
        met = places.join(F.broadcast(seeds), "seed")
    else:
        met = reduced(places, seeds, ["seed"]).join(seeds.hint("merge"), "seed")
    offset = (F.col("at") - F.col("item_at")).alias("offset")
    return written(met.select(*keys, "item_key", offset).distinct(), "benchmark-hits")


def _with_hits(docs: DataFrame, hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``docs`` without most of the documents that have no hit, unless too many
    have one for a filter."""
    name = fresh(docs, "key_hash")
    hashed = F.xxhash64(*keys).alias(name)  # never null
    named = hits.select(hashed).distinct()
    kept = key_filter(named, [name], named.count())
    return docs if kept is None else may_hold(docs.select(*docs.columns, hashed), [name], kept)


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    keys: tuple[str, ...] = ("doc_id",),
    similarity: float = SIMILARITY,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """(keys, item_id, similarity) of every document and item that match.
    ``docs``: the keys and ``text``; ``benchmark``: ``item_id``, ``text``."""
    items = (
        benchmark.filter(F.col("item_id").isNotNull())
        .select("item_id", word_hashes(F.col("text").cast("string")).alias("item"))
        .filter(F.size("item") > 0)
        .distinct()
        .withColumn("item_key", F.struct("item_id", F.xxhash64("item").alias("hash")))
    )
    masks = _masks_in_use(items)
    seeds = (
        _places(items, "item", masks, "item_key", of_items=True)
        .select("seed", "item_key", F.col("at").alias("item_at"))
        .distinct()
    )
    seeds, items = written(seeds, "benchmark-seeds"), written(items.select("item_key", "item"), "benchmark-items")
    small = measured_bytes(seeds) + measured_bytes(items) <= max_broadcast
    hits = _hits(_tokens(docs, keys), keys, masks, seeds, small)
    tokens = _tokens(_with_hits(docs, hits, keys), keys)
    if not small:
        hits = hits.join(items.hint("merge"), "item_key")
    same = [F.col(f"h.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    pairs = hits.alias("h").join(tokens.alias("t"), same).select("h.*", "t.words")
    if small:
        pairs = pairs.join(F.broadcast(items), "item_key")
    return (
        pairs.select(*keys, "item_key.item_id", _similarity("words", "item", F.col("offset")).alias("similarity"))
        .filter(F.col("similarity") >= similarity)
        .groupBy(*keys, "item_id")
        .agg(F.max("similarity").alias("similarity"))
    )


def mark_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """(id, contaminated, n_items, best_similarity, item_ids) of every document.
    Rows are told apart by id and text."""
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_key"),
        F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("text_hash"),
        F.col(f"`{text_col}`").alias("text"),
    )
    keys = ("doc_key", "text_hash")
    found = (
        contaminations(slim, benchmark, keys, **options)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_items"),
            F.max("similarity").alias("best_similarity"),
            F.array_sort(F.collect_list("item_id")).alias("item_ids"),
        )
    )
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    rows = slim.select(*keys).alias("d").join(found.alias("f"), same, "left")
    n = F.coalesce(F.col("f.n_items"), F.lit(0).cast("long"))
    return rows.select(
        F.col("d.doc_key").alias(id_col),
        (n > 0).alias("contaminated"),
        n.alias("n_items"),
        F.col("f.best_similarity").alias("best_similarity"),
        F.col("f.item_ids").alias("item_ids"),
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The clean documents, with all their columns."""
    key, text_hash = f"`{id_col}`", F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    slim = docs.select(F.col(key).alias("doc_key"), text_hash.alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    found = contaminations(slim, benchmark, ("doc_key", "text_hash"), **options).select(
        "doc_key", "text_hash"
    ).distinct()
    same = docs[id_col].eqNullSafe(found["doc_key"]) & (
        F.xxhash64(docs[text_col].cast("string")) == found["text_hash"]
    )
    return docs.join(found, same, "left_anti")


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v
  FROM benchmark
), masks(o, lengths) AS (
  VALUES ([0, 1, 2, 3, 4], NULL), ([0, 1, 2, 3, 5], NULL), ([0, 1, 3, 4, 6], NULL),
    ([0, 1, 2, 3], [5, 6, 7, 10, 11, 15]), ([0, 1, 2, 4], [5, 6, 7, 10, 11, 15]),
    ([0, 1, 3, 4], [5, 6, 7, 10, 11, 15]), ([0, 2, 3, 4], [5, 6, 7, 10, 11, 15]),
    ([0], [1]), ([0, 1], [2]), ([0, 1, 2], [3]), ([0, 1, 2, 3], [4])
), dp AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d
), bp AS (SELECT item_id, v, unnest(range(len(v))) AS j FROM b
), bk AS (
  SELECT item_id, j, o, list_transform(o, lambda x: v[j + x + 1]) AS k
  FROM bp, masks WHERE j + o[-1] < len(v) AND CASE WHEN lengths IS NULL THEN len(v) >= 5 ELSE list_contains(lengths, len(v)) END
), dk AS (
  SELECT doc_id, i, o, list_transform(o, lambda x: w[i + x + 1]) AS k
  FROM dp, (SELECT DISTINCT o FROM bk) WHERE i + o[-1] < len(w)
), h AS (SELECT DISTINCT doc_id, item_id, i - j AS f FROM dk JOIN bk USING (o, k)
), s AS (
  SELECT doc_id, item_id, max(len(list_filter(range(len(v)), lambda k: k + f >= 0 AND w[k + f + 1] = v[k + 1])) / len(v)) AS s
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id) GROUP BY ALL
), g AS (
  SELECT doc_id, count(*) AS n, max(s) AS best, list_sort(list(item_id)) AS ids FROM s WHERE s >= 0.8 GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) > 0 AS contaminated, coalesce(n, 0) AS n_items, best AS best_similarity, ids AS item_ids
FROM documents LEFT JOIN g USING (doc_id)
"""

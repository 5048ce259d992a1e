"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to a few *owners* by their weight, the rarest first; an owner
keeps the postings of its terms, with the integer contribution of each. A bundle
of items visits the owners one after another: each stage cogroups the bundles
with the postings of one owner and adds contributions to the sparse document
accumulators that the bundles carry.

Documents are numbered along their ids and cut into blocks of ``BLOCK_DOCS``, so
that no task holds a whole posting list or all accumulators of an item: a bundle
and an owner's postings meet block by block. After a stage an accumulator goes on
only if it may still reach its block's ``k``-th best: all later terms of the item
have a largest contribution, so nothing that could be selected is lost. The best
of each block are selected in the last stage, then the best of all.

Defined results: rows without a document id, and items without an item id, take
no part. Rows equal in id and text are one document; rows of one id with
different texts are documents of their own, ranked under that id. Rows of one
item id are one item, whose terms are those of its distinct texts. Null and empty
texts have no terms; documents without a term count nowhere, items without one
give no rows. Ties go to the smaller document id. Whatever other columns the
tables have, they are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobreview.llm.common import LOWER_ASCII, batch_rows, pieces_of, written
from jobreview.operators.numbering import numbered
from jobreview.operators.sizing import measured_bytes

K = 20
BLOCK_DOCS = 2048
BUNDLE_ITEMS = 256
OWNERS = 4
# The words of all items go to the tasks that count terms if they are no more
# than this; else all terms are counted, and joined.
MAX_VOCABULARY_BYTES = 32 << 20

# A term is a run of ASCII letters, digits and all that is not
# ASCII; a table over bytes of UTF-8 makes everything else a space.
_TERM_BYTES = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER_ASCII
)


def term_counts(data: bytes) -> Counter:
    """The terms of a text in UTF-8 with their occurrences."""
    data = data.translate(_TERM_BYTES)
    if len(data) <= 1 << 22:
        return Counter(data.split())
    counts: Counter = Counter()
    for piece in pieces_of(data, b" "):
        counts.update(piece.split())
    return counts


def _counted(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """n, terms and tfs beside each text's id and hash; of the terms those wanted."""
    for batch in batches:
        n, terms, tfs = [], [], []
        for data in batch.column("text").cast(pa.binary()):
            counts = term_counts(data.as_py() or b"")
            n.append(counts.total())
            found = counts.keys() if wanted is None else counts.keys() & wanted.value
            terms.append([t.decode() for t in sorted(found)])
            tfs.append([counts[t] for t in sorted(found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("of"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int64()))],
            names=["id", "of", "n", "terms", "tfs"],
        )


def counted_terms(texts: DataFrame, id_col: str, text_col: str, wanted: frozenset | None, purpose: str) -> DataFrame:
    """(id, of, n, terms, tfs) of each distinct (id, text) with an id, as a table.
    ``of`` is a hash of the text, ``n`` counts all terms, the arrays those wanted."""
    spark = texts.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = texts.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("of"), text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    shipped = None if wanted is None else spark.sparkContext.broadcast(wanted)
    counts = rows.filter("id IS NOT NULL").mapInArrow(
        lambda batches: _counted(batches, shipped), f"id {id_type}, of long, n long, terms array<string>, tfs array<long>"
    )
    with batch_rows(spark):
        return written(counts.dropDuplicates(["id", "of"]), purpose)


def _index(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, n, terms, tfs): documents with a term, numbered along their ids."""
    wanted = None
    if measured_bytes(vocabulary) <= MAX_VOCABULARY_BYTES:
        wanted = frozenset(row["term"].encode() for row in vocabulary.collect())
    counts = counted_terms(docs, id_col, text_col, wanted, "lexical-counts")
    return numbered(counts.filter("n > 0"), "id", "of", name="doc", purpose="lexical-index")


def _postings(index: DataFrame) -> DataFrame:
    pairs = index.select("doc", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return pairs.select("doc", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def _stage(key, bundles: pa.Table, postings: pa.Table, owner: int, last: bool, k: int) -> pa.Table:
    """Adds one owner's contributions to the accumulators of the items of a
    bundle, within one block of documents."""
    terms = postings.column("term_id").to_numpy()
    order = np.argsort(terms, kind="stable")
    terms, at, added = terms[order], postings.column("at").to_numpy()[order], postings.column("c").to_numpy()[order]
    out = {"block": [], "bundle": [], "item": [], "terms": [], "docs": [], "scores": []}
    for row in bundles.to_pylist():
        acc = np.zeros(BLOCK_DOCS, np.int64)
        acc[row["docs"]] = row["scores"]
        rest, later = 0, []
        for term in row["terms"]:
            if term["owner"] == owner:
                low, high = np.searchsorted(terms, (term["term_id"], term["term_id"] + 1))
                acc[at[low:high]] += term["mult"] * added[low:high]
            else:
                rest += term["mult"] * term["most"]
                later.append(term)
        docs = np.flatnonzero(acc)
        if len(docs) > k:
            scores = acc[docs]
            least = np.partition(scores, len(docs) - k)[len(docs) - k]
            docs = docs[scores + rest >= least]
            if last:  # equal scores by ascending number, which is ascending id
                docs = docs[np.lexsort((docs, -acc[docs]))[:k]]
        if len(docs) or later:
            for name, value in zip(out, (key[0].as_py(), key[1].as_py(), row["item"], later, docs, acc[docs]), strict=True):
                out[name].append(value)
    schema = bundles.schema
    return pa.table({name: pa.array(values, schema.field(name).type) for name, values in out.items()}, schema)


def _stage_of(owner: int, last: bool, k: int):
    def run(key, bundles, postings):
        return _stage(key, bundles, postings, owner, last, k)

    return run


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", k: int = K,
) -> DataFrame:
    """The ``k`` best documents of each item, of score above 0: ``item_id_col``,
    rank, ``id_col``, score.

    N documents hold L terms. A term's weight w is
    floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has
    m = 75 + 25nN div L, and a term that it holds tf times adds
    w (10^9 tf div (1000 tf + 12 m)) for each time that the item holds it.
    """
    spark = docs.sparkSession
    counts = counted_terms(items, item_id_col, item_text_col, None, "lexical-items")
    asked = counts.select("id", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    asked = asked.groupBy("id", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("mult"))
    asked = written(asked.withColumnRenamed("id", "item"), "lexical-asked")
    vocabulary = numbered(asked.select("term").distinct(), "term", name="term_id", purpose="lexical-words")
    index = _index(docs, vocabulary, id_col, text_col)
    total = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("l")).first()

    m = F.lit(75) + F.expr(f"(25L * n * {total['n']}L) div {total['l']}L")
    found = _postings(index).join(vocabulary, "term").withColumn("m", m)
    found = found.withColumn("g", F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)"))
    stats = found.groupBy("term_id").agg(F.count("*").alias("df"), F.max("g").alias("g"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * total["n"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    stats = written(stats.select("term_id", "df", weight.alias("w"), (weight * F.col("g")).alias("most")), "lexical-weights")
    # Equal shares of the postings, by weight; weights are few integers.
    shares = [i / OWNERS for i in range(1, OWNERS)]
    cuts = stats.agg(F.percentile("w", shares, F.col("df")).alias("cuts")).first()["cuts"] or []
    owner = sum([(F.col("w") < cut).cast("int") for cut in cuts], F.lit(0))
    owned = stats.select("term_id", "w", "most", owner.alias("owner"))

    n_bundles = max(1, -(-asked.select("item").distinct().count() // BUNDLE_ITEMS))
    asked = asked.join(vocabulary, "term").join(owned, "term_id")
    asked = asked.withColumn("bundle", F.pmod(F.xxhash64("item"), F.lit(n_bundles)).cast("int"))
    asked = written(asked, "lexical-bundles")
    postings = found.join(owned.drop("most"), "term_id").select(
        "owner", "doc", "term_id", (F.col("w") * F.col("g")).alias("c")
    )
    postings = _by_owner(spark, postings)
    terms = F.array_sort(F.collect_list(F.struct("owner", "term_id", "mult", "most"))).alias("terms")
    n_blocks = -(-total["n"] // BLOCK_DOCS)
    bundles = asked.groupBy("bundle", "item").agg(terms).select(
        F.explode(F.sequence(F.lit(0), F.lit(max(0, n_blocks - 1)))).alias("block"), "bundle", "item", "terms",
        F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores"),
    )
    shape = bundles.select("block", "bundle", "item", "terms", "docs", "scores").schema
    needs = asked.select(F.col("bundle").alias("to"), "term_id", "owner").distinct()
    for stage in range(OWNERS):
        last = stage == OWNERS - 1
        block = F.expr(f"cast(doc div {BLOCK_DOCS} as int)").alias("block")
        own = postings.filter(F.col("owner") == stage).join(needs.drop("owner"), "term_id")
        own = own.select(block, F.col("to").alias("bundle"), "term_id", F.expr(f"cast(doc % {BLOCK_DOCS} as int)").alias("at"), "c")
        step = bundles.groupBy("block", "bundle").cogroup(own.groupBy("block", "bundle"))
        bundles = step.applyInArrow(_stage_of(stage, last, k), shape)
    best = bundles.select("item", "block", F.explode(F.arrays_zip("docs", "scores")).alias("p"))
    doc = F.col("block").cast("long") * BLOCK_DOCS + F.col("p.docs")
    best = best.select("item", doc.alias("doc"), F.col("p.scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    named = best.join(index.select("doc", F.col("id").alias(id_col)), "doc")
    return named.select(F.col("item").alias(item_id_col), "rank", id_col, "score")


def _by_owner(spark: SparkSession, postings: DataFrame) -> DataFrame:
    """The postings as a table with one folder per owner."""
    from jobreview.session import scratch_dir

    path = scratch_dir(spark, "lexical-postings")
    postings.write.partitionBy("owner").parquet(path)
    schema = postings.select("doc", "term_id", "c", "owner").schema
    return spark.read.schema(schema).parquet(path)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPLIT = f"string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH q AS (
  SELECT item_id, term, count(*) AS mult FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) WHERE term <> '' GROUP BY ALL
), t AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents) WHERE term <> '' GROUP BY ALL
), d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id
), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d
), m AS (SELECT doc_id, 100 - 25 + (25 * n * nn) // ll AS m FROM d, s
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), s
), r AS (
  SELECT item_id, doc_id, CAST(sum(mult * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL
), k AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM r WHERE score > 0
)
SELECT * FROM k WHERE rank <= 20
"""

"""Exact top-k inner products with KD-trees per shard.

Rows are dealt to cells of space by median splits of a bounded sample, and
cells of over ``SHARD_ROWS`` rows to several shards by hash, so that equal rows
fill no shard. First every query is searched in one shard of the cell with the
highest bound, which yields a k-th score. Then each query goes, with that score
as floor, only to the cells whose box reaches it: a pair that cannot matter is
dropped before anything is shuffled. In a shard a tree is descended best box
first, and given up as soon as no box can reach the floor or the shard's own
k-th score. Queries meet a shard in blocks, so a task holds one shard and one
block; a shard is sent once per block of the queries that reach it. Comparing a
growing share of all rows with all rows is quadratic by its definition; boxes
and floors only prune it, which vectors without clusters hardly allow.

Defined results: a vector that is null, or holds a null or a component that is
not finite, takes no part, nor does a null id; rows equal in id and components
are one row; a query's own id is never its answer; vectors are compared with
those of the same length; scores beyond 64 bits are cut to the largest; fewer
than ``k`` candidates give fewer answers; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobreview.llm.common import written
from jobreview.llm.kdtree import KDTree, exact_dtype
from jobreview.llm.shard_cells import best_cell, cell_of, fit_boxes, fit_splits, reached_cells
from jobreview.operators.sizing import broadcast_if_small

SHARD_ROWS = 4096
QUERY_BLOCK = 1024
FOUND = "query_id long, score long, vec_id long"
LONG = (1 << 63) - 1


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole doubles; null where one is
    null or not finite."""
    def whole(v: Column) -> Column:
        product = v.cast("double") * scale  # from 2**53 on every double is whole
        return F.when(F.abs(product) < float(1 << 53), F.floor(product).cast("double")).otherwise(product)

    x = F.transform(vector, whole)
    wrong = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~wrong, x)


def _stack(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in column])


def _search(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(points) or not len(queries):
        return pd.DataFrame({"query_id": [], "score": [], "vec_id": []}).astype("int64")
    p, q = _stack(points["vec"]), _stack(queries["vec"])
    kind = exact_dtype(p, q)
    if kind is object:
        p = np.array([[int(x) for x in row] for row in p], object)
        q = np.array([[int(x) for x in row] for row in q], object)
    tree = KDTree(p, points["vec_id"].to_numpy())
    bounds = tree.bounds(q)
    out = []
    for i, (own, floor) in enumerate(zip(queries["vec_id"], queries["floor"], strict=True)):
        least = -float("inf") if pd.isna(floor) else int(floor)
        for score, vec_id in tree.search(q[i], own, k, bounds[i], least):
            out.append((own, max(-LONG, min(LONG, int(score))), vec_id))
    return pd.DataFrame(out, columns=["query_id", "score", "vec_id"]).astype("int64")


def _number(count: str, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.col(count)).cast("int")


def _searched(dealt: DataFrame, asked: DataFrame, cells: DataFrame, query_block: int, k: int) -> DataFrame:
    """The answers of each (cell, part, block) group. ``dealt``: cell, vec_id,
    vec; ``asked``: cell, part (null: all parts of the cell), vec_id, vec,
    floor, and ``home``, a part to leave out; ``cells``: cell, parts. Queries
    are dealt to blocks by their number in each cell."""
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_block).alias("blocks"))
    sent = broadcast_if_small(written(blocks.join(cells, "cell"), "topk-blocks"))
    points = dealt.join(sent, "cell").withColumn("part", _number("parts", "vec_id", "vec"))
    points = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    points = points.select("cell", "part", "block", "vec_id", "vec")
    every = F.sequence(F.lit(0), F.col("parts").cast("int") - 1)
    queries = (
        asked.join(sent, "cell")
        .withColumn("at", F.explode(F.when(F.col("part").isNull(), every).otherwise(F.array("part"))))
        .filter(F.col("home").isNull() | (F.col("at") != F.col("home")))
        .withColumn("block", _number("blocks", "vec_id"))
        .select("cell", F.col("at").alias("part"), "block", "vec_id", "vec", "floor")
    )

    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _search(points, queries, k)

    keys = ("cell", "part", "block")
    return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of each query row."""
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        scaled(F.col(f"`{vector_col}`")).alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    valid = rows.filter("vec_id IS NOT NULL AND vec IS NOT NULL")
    rows = valid.distinct()
    dealt = written(rows.withColumn("cell", cell_of(fit_splits(valid, shard_rows), F.col("vec"))), "vectors")
    boxes = fit_boxes(dealt)
    cells = dealt.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    cells = written(cells, "topk-cells")
    queries = dealt.filter("is_query").select("vec_id", "vec")
    points = dealt.select("cell", "vec_id", "vec")

    home = queries.withColumn("cell", best_cell(boxes, F.col("vec"), k)).join(broadcast_if_small(cells), "cell")
    home = home.select(
        "cell", _number("parts", "vec_id").alias("part"), F.lit(None).cast("int").alias("home"), "vec_id", "vec"
    )
    home = written(home, "topk-home")
    none = F.lit(None).cast("long").alias("floor")
    first = written(_best(_searched(points, home.withColumn("floor", none), cells, query_block, k), k), "topk-first")
    # A floor needs k answers; with fewer, nothing may be left out. The least
    # score there is may stand for lower ones that were cut.
    floors = first.filter((F.col("rank") == k) & (F.col("score") > -LONG))
    floors = floors.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("floor"))
    reach = home.select(F.col("cell").alias("home_cell"), F.col("part").alias("home_part"), "vec_id", "vec")
    reach = reach.join(floors, "vec_id", "left")
    reach = written(reach.withColumn("cells", reached_cells(boxes, F.col("vec"), F.col("floor"))), "topk-reach")
    away = reach.withColumn("cell", F.explode("cells")).select(
        "cell",
        F.lit(None).cast("int").alias("part"),
        F.when(F.col("cell") == F.col("home_cell"), F.col("home_part")).alias("home"),
        "vec_id",
        "vec",
        "floor",
    )
    found = first.select("query_id", "score", "vec_id")
    found = found.unionByName(_searched(points, away, cells, query_block, k))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

"""Numbers along an order over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobreview.session import staged


def numbered(df: DataFrame, *order: Column | str, name: str, purpose: str = "numbered") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 along ``order``.

    ``order`` must be total (ties would be numbered as they come). Rows are dealt
    by ranges of the order and sorted there; a row's number is its place in its
    range plus the rows of all ranges before, a table of one row per range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low 33 bits of the id count the rows of a partition.
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = staged(
        ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", at), purpose
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").count()
    starts = sizes.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_range")
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_start", "_at")

"""Tables cut into buckets by a key, of which a change rewrites only some."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.session import staged

BUCKET = "_bucket"


class BucketedTable:
    """A Parquet table below ``path`` with one folder per bucket of ``keys``.

    ``schema`` has no bucket column. The number of buckets is fixed by the first
    write: choose it for the size to come, as a bucket is what a change rewrites.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64
    ):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets = list(keys), buckets
        # An empty append makes the folder, and changes nothing where it exists.
        spark.createDataFrame([], schema).write.mode("append").parquet(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall in: no more than there are buckets."""
        return sorted(row[0] for row in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows of some buckets (all by default); other folders are not read."""
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self.path)
        if buckets is not None:
            rows = rows.filter(F.col(BUCKET).isin(list(buckets)))
        return rows.select(self.schema.names)

    def replace(self, rows: DataFrame) -> None:
        """Every bucket that ``rows`` fall in holds just these rows afterwards; the
        files of the others stay. The rows may come from this table: they are
        stored before a folder is touched. A hot bucket is written by several
        tasks."""
        ready = staged(rows.select(self.schema.names).withColumn(BUCKET, self.bucket()), "buckets")
        (
            ready.hint("rebalance", BUCKET)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(BUCKET)
            .parquet(self.path)
        )

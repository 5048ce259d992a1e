"""Versions kept up to date as batches of events arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.operators.keyfilter import reduced
from jobreview.operators.versions import close_versions, instants
from jobreview.session import staged
from jobreview.sources.bucketed import BUCKET, BucketedTable


class VersionTable:
    """Slowly changing versions below ``path``, merged batch by batch.

    Two tables: ``instants``, what was known of a key at each time, to which each
    batch adds files of its own; and ``versions``. A late event may open a version
    in the middle of another, or change nothing but what a later event means, so
    versions alone are not enough to go on from. A batch reads the instants of the
    keys it names, and rewrites the buckets of versions that these keys lie in.

    A batch that is applied again, after a failure at any point or by mistake,
    replaces its own instants and gives the same versions.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        tracked: Sequence[str],
        *,
        key: str = "customer_id",
        ts: str = "event_ts",
        tie_break: Sequence[str] = ("event_id",),
        null_safe: bool = False,
        buckets: int = 64,
        rows_per_slice: int | None = None,
    ):
        """``schema``: that of the events."""
        self.spark, self.path = spark, path
        self.tracked, self.key, self.ts, self.tie_break = list(tracked), key, ts, list(tie_break)
        self.options = {"null_safe": null_safe, "rows_per_slice": rows_per_slice}
        names = list(dict.fromkeys([key, ts, *tracked, *tie_break]))
        self.instant_schema = T.StructType([schema[name] for name in names])
        version_fields = [
            schema[key],
            *[schema[name] for name in tracked],
            T.StructField("row_hash", T.StringType()),
            T.StructField("row_eff_start_tms", schema[ts].dataType),
            T.StructField("row_eff_end_tms", schema[ts].dataType),
            T.StructField("is_current", T.BooleanType()),
        ]
        self.versions = BucketedTable(spark, f"{path}/versions", T.StructType(version_fields), [key], buckets)
        spark.createDataFrame([], self.instant_schema).write.mode("append").parquet(f"{path}/instants")

    def _instants(self, buckets: Sequence[int]) -> DataFrame:
        schema = T.StructType(
            [*self.instant_schema.fields, T.StructField("_batch", T.LongType()), T.StructField(BUCKET, T.IntegerType())]
        )
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/instants")
        return rows.filter(F.col(BUCKET).isin(list(buckets))).select(self.instant_schema.names)

    def merge(self, events: DataFrame, batch_id: int) -> int:
        """Applies a batch; returns how many buckets it rewrote."""
        added = instants(events, self.tracked, key=self.key, ts=self.ts, tie_break=self.tie_break)
        added = added.select(self.instant_schema.names).withColumn(BUCKET, self.versions.bucket())
        folder = f"{self.path}/instants/_batch={batch_id}"
        added.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        stored = self.spark.read.schema(added.schema).parquet(folder)
        touched = staged(stored.select(self.key).distinct(), "touched-keys")
        buckets = self.versions.touched(touched)
        if not buckets:
            return 0
        known = reduced(self._instants(buckets), touched, [self.key]).join(touched, self.key, "left_semi")
        fresh = close_versions(
            known, self.tracked, key=self.key, ts=self.ts, tie_break=self.tie_break, **self.options
        )
        others = self.versions.read(buckets).join(touched, self.key, "left_anti")
        self.versions.replace(others.unionByName(fresh))
        return len(buckets)

    def read(self) -> DataFrame:
        return self.versions.read()

"""The latest row per key of a stream, kept as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobreview.operators.dedupe import EVENT_KEYS, keep_latest
from jobreview.session import staged
from jobreview.sources.bucketed import BucketedTable

APPLIED = T.StructType([T.StructField("batch_id", T.LongType())])


class LatestTable:
    """One row per key below ``path``: the one with the greatest time.

    ``upsert`` is a ``foreachBatch`` function. Spark may hand a batch over again
    after a restart: its id is recorded once it is in the table, and a batch whose
    id is there changes nothing. One that failed before its record was written is
    applied again; the maximum of a key does not change by being taken twice.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        *,
        keys: Sequence[str] = EVENT_KEYS,
        ts: str = "event_ts",
        tie_break: Sequence[str] = (),
        buckets: int = 64,
    ):
        self.keys, self.ts, self.tie_break = list(keys), ts, list(tie_break)
        self.rows = BucketedTable(spark, f"{path}/rows", schema, keys, buckets)
        self.applied_path = f"{path}/applied"
        spark.createDataFrame([], APPLIED).write.mode("append").parquet(self.applied_path)

    def applied(self, spark: SparkSession) -> DataFrame:
        """The ids of the batches that are in the table."""
        return spark.read.schema(APPLIED).parquet(self.applied_path)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not self.applied(spark).filter(f"batch_id = {int(batch_id)}").isEmpty():
            return
        latest = staged(keep_latest(batch, self.keys, self.ts, self.tie_break), "latest-batch")
        buckets = self.rows.touched(latest)
        if buckets:
            both = self.rows.read(buckets).unionByName(latest)
            self.rows.replace(keep_latest(both, self.keys, self.ts, self.tie_break))
        spark.createDataFrame([(int(batch_id),)], APPLIED).write.mode("append").parquet(self.applied_path)

    def read(self) -> DataFrame:
        return self.rows.read()


def upsert_stream(df: DataFrame, table: LatestTable, *, checkpoint_path: str) -> StreamingQuery:
    """Puts everything now available into ``table``, then ends."""
    return (
        df.writeStream.foreachBatch(table.upsert)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )

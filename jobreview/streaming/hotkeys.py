"""Hot keys of a stream, learnt from its earlier batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobreview.operators.profile import KEY
from jobreview.plans.enrichment import EnrichmentOptions, profiled
from jobreview.session import staged


class HeavyHitters:
    """Counts of the most frequent keys, in a table of at most ``capacity`` rows.

    After each batch the counts of its keys are added to those held; of what is
    then too much, the largest count left out is taken off all others. So a key's
    count is never too high, and too low by ``error`` at most, which is no more
    than all rows over ``capacity + 1``: no key above that share is missing.

    Each batch writes a summary of its own, from that of the batches before it; a
    batch that is run again writes the same one.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: T.DataType, *, capacity: int = 1000):
        self.path, self.capacity = path, capacity
        self.schema = T.StructType(
            [
                T.StructField(KEY, key_type),
                T.StructField("n", T.LongType()),
                T.StructField("error", T.LongType()),
                T.StructField("total", T.LongType()),
                T.StructField("batch", T.LongType()),
            ]
        )
        spark.createDataFrame([], self.schema).drop("batch").write.mode("append").parquet(path)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The summary of the batches before this one: no more than ``capacity`` rows."""
        held = spark.read.schema(self.schema).parquet(self.path).filter(F.col("batch") < batch_id)
        last = held.agg(F.max("batch").alias("batch")).first()["batch"]
        return held.filter(F.col("batch") == F.lit(-1 if last is None else last)).drop("batch")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = self.before(spark, batch_id)
        known = held.first()
        total, error = (known["total"], known["error"]) if known else (0, 0)
        counts = batch.groupBy(KEY).agg(F.count("*").alias("n"))
        both = held.select(KEY, "n").unionByName(counts).groupBy(KEY).agg(F.sum("n").alias("n"))
        top = both.filter(F.col(KEY).isNotNull()).orderBy(F.desc("n"), KEY).limit(self.capacity + 1).collect()
        cut = top[self.capacity]["n"] if len(top) > self.capacity else 0
        total += batch.count()
        rows = [(row[KEY], row["n"] - cut, error + cut, total) for row in top if row["n"] > cut]
        kept = spark.createDataFrame(rows, T.StructType(self.schema.fields[:-1]))
        kept.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    @staticmethod
    def hot(summary: DataFrame, share: float) -> DataFrame:
        """The keys that may hold more than ``share`` of all rows so far."""
        may_hold = F.col("n") + F.col("error") > F.lit(share) * F.col("total")
        return summary.filter(may_hold).select(KEY)


def enrich_hot_stream(
    unique: DataFrame,
    profiles: DataFrame,
    hitters: HeavyHitters,
    *,
    path: str,
    checkpoint_path: str,
    options: EnrichmentOptions = EnrichmentOptions(salt_buckets=16),
    share: float = 0.01,
    as_of: Column | None = None,
) -> StreamingQuery:
    """Appends the enriched rows of a stream of unique events, then ends.

    Customers that held more than ``share`` of the rows of earlier batches are
    spread over ``options.salt_buckets`` tasks, and only their profiles are
    copied. Each batch has a folder of its own below ``path``, replaced if the
    batch is run again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch, "hot-batch")
        hot = hitters.hot(hitters.before(rows.sparkSession, batch_id), share)
        done = profiled(rows, profiles, options, as_of=as_of, hot_keys=hot)
        done.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        hitters.update(rows, batch_id)

    return (
        unique.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )

"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# The lookup joins rely on AQE when one key holds much of the input. It splits
# such partitions by itself unless that costs a shuffle further up; the last of
# these settings lets it split then as well.
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
# Deduplication without a watermark keeps every key: its state must live on the
# executors' disks, not in their memory, and checkpoint only its changes.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
DEFAULT_CONF = {**ADAPTIVE_CONF, **STATE_CONF, "spark.sql.session.timeZone": "UTC"}


def build_session(app_name: str = "jobreview", master: str | None = None, **conf) -> SparkSession:
    """A session with the defaults above; ``conf`` entries win, as in
    ``build_session(**{"spark.sql.shuffle.partitions": "2000"})``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def apply_conf(spark: SparkSession) -> None:
    """Sets the adaptive and the state settings on a session made elsewhere."""
    for key, value in {**ADAPTIVE_CONF, **STATE_CONF}.items():
        spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name below the shared folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may
    fall back to a temporary folder: on a cluster that would be one machine's
    disk, lost with the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="jobreview-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, with
    its own lineage cut, and lost with no executor."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

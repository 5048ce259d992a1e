"""Keyed deduplication, for tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_KEYS = ("customer_id", "event_id")


def dedupe_events(df: DataFrame, keys: Sequence[str] = EVENT_KEYS) -> DataFrame:
    """One row per key, no promise which. On a stream, the state keeps every key."""
    return df.dropDuplicates(list(keys))


def dedupe_within(
    df: DataFrame, delay: str, ts: str = "event_ts", keys: Sequence[str] = EVENT_KEYS
) -> DataFrame:
    """One row per key with state bounded by a watermark.

    Rows later than ``delay`` are dropped by Spark: the caller chooses the delay
    and reads the loss from ``late_rows`` of the query.
    """
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def keep_latest(
    df: DataFrame,
    keys: Sequence[str] = EVENT_KEYS,
    ts: str = "event_ts",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The row with the greatest timestamp per key; NULL timestamps come last.

    A maximum, not a sorted window: each task keeps one row per key before the
    shuffle, so a key with very many copies costs no task more than others. As
    an aggregate it also runs on a stream, in update or complete mode.
    """
    rest = [name for name in df.columns if name not in set(keys)]
    order = F.struct(ts, *tie_break)
    latest = F.max_by(F.struct(*rest), order).alias("_latest")
    grouped = df.groupBy(*keys).agg(latest)
    picked = {name: F.col(f"_latest.`{name}`").alias(name) for name in rest}
    return grouped.select(*[picked.get(name, F.col(name)) for name in df.columns])

"""Audit columns and closing of superseded versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobreview.functions.hashing import joined_hash, null_safe_hash
from jobreview.session import staged

# Fixed value: the end of a version that is still open.
OPEN_END = "9999-12-31 23:59:59"


def open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp")


def with_audit_columns(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Insert, update and start time, open end, current flag.

    ``as_of`` replaces the current time where a run must be repeatable.
    """
    now = F.current_timestamp() if as_of is None else as_of.cast("timestamp")
    return df.select(
        "*",
        now.alias("row_ins_utc_tms"),
        now.alias("row_upd_utc_tms"),
        now.alias("row_eff_start_tms"),
        open_end().alias("row_eff_end_tms"),
        F.lit(True).alias("is_current"),
    )


def close_versions(
    events: DataFrame,
    tracked: Sequence[str],
    *,
    key: str = "customer_id",
    ts: str = "event_ts",
    tie_break: Sequence[str] = ("event_id",),
    null_safe: bool = False,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Slowly changing versions: one row per change of the tracked columns.

    ``tracked`` must leave out what differs in every event (its id, type and
    time), or every event is a change. Of several events of a key at one
    instant the last by ``tie_break`` counts. Output: key, tracked columns,
    ``row_hash``, ``row_eff_start_tms``, ``row_eff_end_tms``, ``is_current``.

    Without ``rows_per_slice`` each key is one window group: for tables without
    hot keys. With it the rows are dealt by ranges of (key, time), of about so
    many rows each, whatever key they belong to; what a range must know of its
    neighbours comes from a table with two rows per range at most. Both give the
    same rows.
    """
    at_instants = instants(events, tracked, key=key, ts=ts, tie_break=tie_break)
    row_hash = (null_safe_hash if null_safe else joined_hash)([key, *tracked])
    hashed = at_instants.select(key, ts, *tracked, row_hash.alias("row_hash"))
    previous, next_start = F.lag("row_hash"), F.lead(ts)
    if rows_per_slice is None:
        rows = hashed.withColumn("_slice", F.lit(0))
        versions = _changes(rows, previous.over(_timeline(key, ts)))
        next_start = next_start.over(_timeline(key, ts))
    else:
        rows = time_slices(hashed, key, ts, max(1, -(-events.count() // rows_per_slice)))
        edges = _slice_edges(_at_edges(rows, key), key, ts)
        known = rows.join(F.broadcast(edges), [key, "_slice"], "left")
        versions = _changes(known, F.coalesce(previous.over(_timeline(key, ts)), "_prev_hash"))
        next_start = F.coalesce(next_start.over(_timeline(key, ts)), "_next_change")
    ended = versions.withColumn("_next_start", next_start)
    return ended.select(
        key,
        *tracked,
        "row_hash",
        F.col(ts).alias("row_eff_start_tms"),
        F.coalesce("_next_start", open_end()).alias("row_eff_end_tms"),
        F.col("_next_start").isNull().alias("is_current"),
    )


def _timeline(key: str, ts: str):
    return Window.partitionBy(key, "_slice").orderBy(ts)


def _changes(rows: DataFrame, previous: Column) -> DataFrame:
    """Rows whose hash differs from the one before (the first has none before)."""
    return rows.withColumn("_before", previous).filter(
        F.col("_before").isNull() | (F.col("_before") != F.col("row_hash"))
    )


def instants(
    events: DataFrame, tracked: Sequence[str], *, key: str, ts: str, tie_break: Sequence[str]
) -> DataFrame:
    """One row per key and instant: the tracked columns and ``tie_break`` of the
    last event there."""
    rest = [c for c in dict.fromkeys([*tracked, *tie_break]) if c not in (key, ts)]
    last = F.max_by(F.struct(*rest), F.struct(*tie_break) if tie_break else F.lit(0))
    return (
        events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, ts)
        .agg(last.alias("_row"))
        .select(key, ts, *[F.col(f"_row.`{name}`").alias(name) for name in rest])
    )


def time_slices(rows: DataFrame, key: str, ts: str, n_slices: int) -> DataFrame:
    """``rows`` with ``_slice``, the range of (key, time) that each lies in. The
    ranges come from a sample; they are stored, so that every use sees the same."""
    dealt = rows.repartitionByRange(n_slices, key, ts)
    return staged(dealt.withColumn("_slice", F.spark_partition_id()), "version-slices")


def _at_edges(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the first and the last key of each range: no other key can lie in
    two ranges. One row per range is broadcast."""
    ends = rows.groupBy("_slice").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    found = rows.join(F.broadcast(ends), "_slice")
    return found.filter((F.col(key) == F.col("_low")) | (F.col(key) == F.col("_high")))


def _slice_edges(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key and slice: the hash before it and the next change after it."""
    inside = rows.withColumn("_before", F.lag("row_hash").over(_timeline(key, ts)))
    slices = inside.groupBy(key, "_slice").agg(
        F.min(ts).alias("_first_ts"),
        F.min_by("row_hash", ts).alias("_first_hash"),
        F.max_by("row_hash", ts).alias("_last_hash"),
        F.min(F.when(F.col("_before") != F.col("row_hash"), F.col(ts))).alias("_inner_change"),
    )
    along = Window.partitionBy(key).orderBy("_slice")
    linked = slices.withColumn("_prev_hash", F.lag("_last_hash").over(along)).withColumn(
        "_first_change",
        F.when(F.col("_prev_hash").eqNullSafe(F.col("_first_hash")), F.col("_inner_change")).otherwise(
            F.col("_first_ts")
        ),
    )
    later = along.rowsBetween(1, Window.unboundedFollowing)
    return linked.select(
        key,
        "_slice",
        "_prev_hash",
        F.first("_first_change", ignorenulls=True).over(later).alias("_next_change"),
    )

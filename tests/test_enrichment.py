"""Normalising, joining, deduplicating, hashing and versioning."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from plan_text import plan_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobreview.functions.hashing import with_row_hash
from jobreview.operators.dedupe import dedupe_events, keep_latest
from jobreview.operators.normalize import normalize_events
from jobreview.operators.profile import enrich_with_profile, unique_profiles
from jobreview.operators.sizing import broadcast_if_small, measured_bytes
from jobreview.operators.versions import OPEN_END, close_versions, time_slices, with_audit_columns
from jobreview.plans.enrichment import EnrichmentOptions, enrich

PAYLOAD = (
    "payload struct<customer_id: long, event_id: long, event_type: string, event_ts: string, "
    "email: string, loyalty_tier: string, country: string, preferences: string, "
    "attributes: map<string, double>>"
)


def payloads(spark, rows):
    full = [
        ((c, e, "click", ts, None, "gold", "C1", "{}", {"v": 1.5}),)
        for c, e, ts in rows
    ]
    return spark.createDataFrame(full, PAYLOAD)


def profile_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "customer_id string, is_current boolean, segment string, lifetime_value double, "
        "last_profile_update_ts timestamp",
    )


DAY = datetime(2024, 1, 1)
GOOD_TS = "2024-01-01 00:00:00"


def test_keys_must_be_present(spark):
    events = payloads(spark, [(1, 1, GOOD_TS), (None, 2, GOOD_TS), (3, None, GOOD_TS)])
    rows = normalize_events(events).collect()
    assert [(row.customer_id, row.event_id) for row in rows] == [("1", "1")]
    assert rows[0].attributes == {"v": 1.5}


def test_malformed_time_fails_or_is_null(spark):
    events = payloads(spark, [(1, 1, "soon")])
    with pytest.raises(PySparkException):
        normalize_events(events).collect()
    assert normalize_events(events, strict=False).first().event_ts is None


def test_null_current_flag_is_not_current(spark):
    dim = profile_rows(spark, [("1", None, "A", 1.0, DAY), ("2", True, "B", 2.0, DAY)])
    events = normalize_events(payloads(spark, [(1, 1, GOOD_TS), (2, 2, GOOD_TS)]))
    found = {r.customer_id: r.profile_segment for r in enrich_with_profile(events, dim).collect()}
    assert found == {"1": None, "2": "B"}


def test_duplicate_profile_policies(spark):
    dim = profile_rows(
        spark,
        [("1", True, "old", 1.0, DAY), ("1", True, "new", 2.0, DAY + timedelta(1))],
    )
    events = normalize_events(payloads(spark, [(1, 1, GOOD_TS)]))

    def segments(policy):
        rows = enrich_with_profile(events, dim, on_duplicate=policy).collect()
        return sorted(row.profile_segment for row in rows)

    assert segments("keep") == ["new", "old"]
    assert segments("latest") == ["new"]
    assert len(segments("any")) == 1
    with pytest.raises(ValueError, match="several current profiles"):
        segments("error")
    with pytest.raises(ValueError, match="unknown"):
        unique_profiles(dim, "first")


def test_broadcast_is_granted_by_measured_size(spark):
    # Sizes Spark cannot estimate as small: the hint decides.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dim = profile_rows(spark, [(str(i), True, "A", 1.0, DAY) for i in range(50)])
        events = normalize_events(payloads(spark, [(1, 1, GOOD_TS)]))
        small = enrich_with_profile(events, dim, broadcast=True)
        large = enrich_with_profile(events, dim, broadcast=True, max_broadcast_bytes=100)
        assert "BroadcastHashJoin" in plan_of(small)
        assert "BroadcastHashJoin" not in plan_of(large)
        assert small.collect() == large.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measured_bytes_counts_text(spark):
    df = spark.createDataFrame([("x" * 1000, 1), (None, 2)], "a string, b int")
    assert 1000 < measured_bytes(df) < 1200
    assert measured_bytes(df.limit(0)) == 0
    assert broadcast_if_small(df, 10) is df


def test_salted_join_keeps_rows(spark):
    dim = profile_rows(spark, [("1", True, "A", 1.0, DAY)])
    events = normalize_events(
        payloads(spark, [(1, i, GOOD_TS) for i in range(40)] + [(2, 99, GOOD_TS)])
    )
    plain = enrich_with_profile(events, dim)
    salted = enrich_with_profile(events, dim, salt_buckets=5)
    assert sorted(plain.collect(), key=str) == sorted(salted.collect(), key=str)


def test_dedupe_keeps_one_row_per_key(spark):
    events = normalize_events(payloads(spark, [(1, 1, GOOD_TS)] * 3 + [(1, 2, GOOD_TS)]))
    assert dedupe_events(events).count() == 2


def test_latest_prefers_time_then_tie_and_nulls_last(spark):
    rows = [
        ("a", DAY, 1, "x"),
        ("a", DAY + timedelta(1), 2, "y"),
        ("a", DAY + timedelta(1), 3, "z"),
        ("a", None, 9, "n"),
        ("b", None, 4, "only"),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n int, v string")
    latest = keep_latest(df, ["k"], "ts", ["n"])
    assert latest.columns == df.columns
    assert {row.k: row.v for row in latest.collect()} == {"a": "z", "b": "only"}


def test_latest_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", DAY, 1)], "k string, ts timestamp, n int")
    plan = plan_of(keep_latest(df, ["k"], "ts"))
    assert "partial_max_by" in plan and "Window" not in plan


def test_hash_text_and_null_collision(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    plain = [row.row_hash for row in with_row_hash(df).collect()]
    assert plain == [hashlib.sha256(b"a||b").hexdigest()] * 2
    safe = [row.row_hash for row in with_row_hash(df, null_safe=True).collect()]
    assert safe[0] != safe[1]


def test_hash_exclusion_and_nested_columns(spark):
    df = spark.createDataFrame([("a", {"k": 1.5})], "x string, m map<string, double>")
    both = with_row_hash(df).first().row_hash
    assert both == hashlib.sha256("a||{k -> 1.5}".encode()).hexdigest()
    assert with_row_hash(df, ["m"]).first().row_hash == hashlib.sha256(b"a").hexdigest()


def test_audit_times_agree(spark):
    row = with_audit_columns(spark.range(1)).first()
    assert row.row_ins_utc_tms == row.row_upd_utc_tms == row.row_eff_start_tms
    assert row.row_eff_end_tms == datetime(9999, 12, 31, 23, 59, 59)
    assert row.is_current is True


def test_chain_switches(spark):
    dim = profile_rows(spark, [("1", True, "A", 1.0, DAY)])
    events = payloads(spark, [(1, 1, GOOD_TS), (1, 1, GOOD_TS)])
    full = enrich(events, dim)
    assert len(full.columns) == 18 and full.count() == 1
    bare = enrich(
        events, None, EnrichmentOptions(stateful_dedupe=False, enable_profile_join=False)
    )
    assert bare.columns == full.columns and bare.count() == 2
    assert [r.profile_segment for r in bare.collect()] == [None, None]


def test_options_merge():
    base = EnrichmentOptions()
    merged = base.with_overrides({"target_table": "t", "note": 1})
    assert (merged.target_table, merged.source_table) == ("t", base.source_table)
    assert merged.extra == {"note": 1}
    assert base.admission_caps() == {"max_files_per_trigger": 12000, "max_bytes_per_trigger": None}
    by_size = base.with_overrides({"max_bytes_per_trigger": 10}).admission_caps()
    assert by_size == {"max_files_per_trigger": None, "max_bytes_per_trigger": 10}


def expected_versions(rows):
    """One version per change, from a plain walk along each customer's events."""
    last_at = {}
    for key, ts, event_id, tier in rows:
        if (key, ts) not in last_at or event_id > last_at[key, ts][0]:
            last_at[key, ts] = (event_id, tier)
    versions = []
    for key in {row[0] for row in rows}:
        changes = []
        for ts in sorted(t for k, t in last_at if k == key):
            tier = last_at[key, ts][1]
            if not changes or changes[-1][1] != tier:
                changes.append((ts, tier))
        for i, (ts, tier) in enumerate(changes):
            end = changes[i + 1][0] if i + 1 < len(changes) else None
            versions.append((key, tier, ts, end))
    return sorted(versions, key=str)


@pytest.mark.parametrize("rows_per_slice", [None, 1_000, 200, 40, 5])
def test_versions_with_and_without_slices(spark, rows_per_slice):
    random.seed(7)
    rows = []
    for event_id in range(600):
        key = "hot" if event_id % 3 else f"k{random.randrange(9)}"
        second = random.randrange(400)
        # Long runs of one tier leave whole slices without a change.
        tier = "gold" if 100 < second < 300 and key == "hot" else random.choice("ab")
        rows.append((key, DAY + timedelta(seconds=second), f"{event_id:04d}", tier))
    df = spark.createDataFrame(
        rows, "customer_id string, event_ts timestamp, event_id string, tier string"
    )
    closed = close_versions(df, ["tier"], rows_per_slice=rows_per_slice)
    open_end = datetime.fromisoformat(OPEN_END)
    actual = []
    for row in closed.collect():
        assert row.is_current == (row.row_eff_end_tms == open_end)
        end = None if row.is_current else row.row_eff_end_tms
        actual.append((row.customer_id, row.tier, row.row_eff_start_tms, end))
    assert sorted(actual, key=str) == expected_versions(rows)


def test_slices_of_one_key_with_all_rows(spark):
    rows = spark.range(50_000).select(
        F.lit("k").alias("customer_id"), F.timestamp_seconds(F.col("id")).alias("event_ts")
    )
    sizes = time_slices(rows, "customer_id", "event_ts", 25).groupBy("_slice").count().collect()
    assert sum(row["count"] for row in sizes) == 50_000
    assert max(row["count"] for row in sizes) <= 2 * 50_000 / 25


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "dim")
    rows = [("1", True, "A", 1.0, DAY, "unused")]
    spark.createDataFrame(
        rows,
        "customer_id string, is_current boolean, segment string, lifetime_value double, "
        "last_profile_update_ts timestamp, note string",
    ).write.parquet(path)
    events = normalize_events(payloads(spark, [(1, 1, GOOD_TS)]))
    plan = plan_of(enrich_with_profile(events, spark.read.parquet(path)))
    assert "EqualTo(is_current,true)" in plan
    assert "note" not in plan.split("ReadSchema")[1]


def test_profile_column_types_match_without_join(spark):
    dim = profile_rows(spark, [("1", True, "A", 1.0, DAY)])
    events = payloads(spark, [(1, 1, GOOD_TS)])
    joined = enrich(events, dim)
    bare = enrich(events, None, EnrichmentOptions(enable_profile_join=False))
    assert [(f.name, f.dataType) for f in joined.schema] == [
        (f.name, f.dataType) for f in bare.schema
    ]

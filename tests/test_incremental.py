"""Tables that follow their batches: versions, latest rows, hot keys, lost rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobreview.operators.profile import enrich_with_profile
from jobreview.operators.version_merge import VersionTable
from jobreview.operators.versions import close_versions
from jobreview.session import scratch_dir
from jobreview.streaming.enrichment import not_in_sink
from jobreview.streaming.hotkeys import HeavyHitters
from jobreview.streaming.latest import LatestTable, upsert_stream

DAY = datetime(2024, 1, 1)
SCHEMA = "customer_id string, event_ts timestamp, event_id string, tier string"


def events(seed, n=300, keys=40):
    rng = random.Random(seed)
    return [
        (f"k{rng.randrange(keys)}", DAY + timedelta(seconds=rng.randrange(500)), f"{seed}-{i:04d}", rng.choice("aab"))
        for i in range(n)
    ]


def files(spark, path):
    return {row[0] for row in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}


@pytest.mark.parametrize("rows_per_slice", [None, 50])
def test_merged_batches_equal_all_at_once(spark, rows_per_slice):
    batches = [events(seed) for seed in (1, 2, 3)]
    # a later event that changes nothing, until a late one comes between
    batches[0] += [("late", DAY, "x1", "a"), ("late", DAY + timedelta(seconds=20), "x2", "a")]
    batches[1] += [("late", DAY + timedelta(seconds=10), "x3", "b"), (None, DAY, "x4", "a"), ("k1", None, "x5", "a")]
    frames = [spark.createDataFrame(batch, SCHEMA) for batch in batches]
    table = VersionTable(spark, scratch_dir(spark, "merge"), frames[0].schema, ["tier"], buckets=8, rows_per_slice=rows_per_slice)
    for batch_id, frame in enumerate(frames):
        table.merge(frame, batch_id)
        whole = spark.createDataFrame(sum(batches[: batch_id + 1], []), SCHEMA)
        expected = Counter(close_versions(whole, ["tier"]).collect())
        assert Counter(table.read().collect()) == expected
    table.merge(frames[1], 1)
    assert Counter(table.read().collect()) == expected, "a batch applied again changes nothing"


def test_a_batch_rewrites_only_its_buckets(spark):
    path = scratch_dir(spark, "merge")
    first = spark.createDataFrame(events(4), SCHEMA)
    table = VersionTable(spark, path, first.schema, ["tier"], buckets=16)
    table.merge(first, 0)
    before = files(spark, f"{path}/versions")
    assert table.merge(spark.createDataFrame([("k3", DAY, "y", "c")], SCHEMA), 1) == 1
    after = files(spark, f"{path}/versions")
    gone = {name.split("_bucket=")[1].split("/")[0] for name in before - after}
    assert len(gone) == 1 and len(before & after) >= len(before) - 2
    assert table.merge(first.limit(0), 2) == 0
    assert files(spark, f"{path}/versions") == after


def test_a_batch_handed_over_again_changes_nothing(spark):
    path = scratch_dir(spark, "latest")
    rows = [spark.createDataFrame(events(seed, 60, 10), SCHEMA) for seed in (1, 2)]
    table = LatestTable(spark, path, rows[0].schema, keys=["customer_id"], tie_break=["event_id"], buckets=4)
    for batch_id, batch in enumerate(rows):
        table.upsert(batch, batch_id)
    expected, before = Counter(table.read().collect()), files(spark, f"{path}/rows")
    table.upsert(rows[0], 0)
    table.upsert(rows[1].limit(3), 1)
    assert Counter(table.read().collect()) == expected
    assert files(spark, f"{path}/rows") == before
    assert sorted(row[0] for row in table.applied(spark).collect()) == [0, 1]
    # applied, but lost before its record was written: taken twice, the same
    again = LatestTable(spark, path, rows[0].schema, keys=["customer_id"], tie_break=["event_id"], buckets=4)
    again.upsert(rows[1], 2)
    assert Counter(table.read().collect()) == expected


def test_stream_upsert_resumes(spark):
    path, source = scratch_dir(spark, "latest"), scratch_dir(spark, "source")
    seen = []
    for seed in (1, 2, 3):
        seen += events(seed, 50, 10)
        frame = spark.createDataFrame(events(seed, 50, 10), SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        table = LatestTable(spark, path, frame.schema, keys=["customer_id"], tie_break=["event_id"], buckets=4)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        upsert_stream(stream, table, checkpoint_path=f"{path}/checkpoint").awaitTermination()
        latest = {}
        for row in seen:
            latest[row[0]] = max(latest.get(row[0], row), row, key=lambda r: (r[1], r[2]))
        assert {tuple(row) for row in table.read().collect()} == set(latest.values())


def test_heavy_hitters_miss_no_hot_key(spark):
    rng, counts = random.Random(1), Counter()
    hitters = HeavyHitters(spark, scratch_dir(spark, "hot"), StringType(), capacity=20)
    for batch_id in range(4):
        keys = ["hot"] * 200 + ["warm"] * 60 + [f"k{rng.randrange(500)}" for _ in range(700)] + [None] * 40
        counts.update(k for k in keys if k)
        batch = spark.createDataFrame([(k,) for k in keys], "customer_id string")
        hitters.update(batch, batch_id)
        hitters.update(batch, batch_id)
    summary = hitters.before(spark, 99)
    rows = {row["customer_id"]: row for row in summary.collect()}
    assert len(rows) <= 20 and next(iter(rows.values()))["total"] == 4_000
    for key, row in rows.items():
        assert row["n"] <= counts[key] <= row["n"] + row["error"] and row["error"] <= 4_000 / 21
    assert {row[0] for row in hitters.hot(summary, 0.1).collect()} >= {"hot"}
    assert hitters.before(spark, 0).count() == 0


def test_only_hot_profiles_are_copied(spark):
    dim = spark.range(100).select(
        F.col("id").cast("string").alias("customer_id"), F.lit(True).alias("is_current"), F.lit("s").alias("segment"),
        F.lit(1.0).alias("lifetime_value"), F.lit(DAY).cast("timestamp").alias("last_profile_update_ts"),
    )
    rows = spark.range(1_000).select(
        F.when(F.col("id") % 2 == 0, "7").otherwise((F.col("id") % 120).cast("string")).alias("customer_id"),
        F.col("id").cast("string").alias("event_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("event_type", "email", "loyalty_tier", "country", "preferences", "attributes")],
        F.lit(DAY).cast("timestamp").alias("event_ts"),
    )
    hot = spark.createDataFrame([("7",)], "customer_id string")
    out = enrich_with_profile(rows, dim, salt_buckets=8, hot_keys=hot)
    plain = enrich_with_profile(rows, dim)
    assert Counter(out.collect()) == Counter(plain.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "CASE WHEN isnotnull(_hot" in plan


def test_lost_rows_with_null_keys(spark):
    admitted = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), (None, "4")], "customer_id string, event_id string")
    sink = spark.createDataFrame([("a", "1"), (None, "3")], "customer_id string, event_id string")
    assert {tuple(r) for r in not_in_sink(admitted, sink).collect()} == {("a", "2"), (None, "4")}

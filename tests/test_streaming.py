"""Streams: resume, sinks, caps, state, and row-local steps."""

import pytest
from pyspark.sql import functions as F

from jobreview.operators import advisor, codescan, runs
from jobreview.operators.dedupe import dedupe_within, keep_latest
from jobreview.operators.normalize import normalize_events
from jobreview.plans import inputs
from jobreview.session import scratch_dir
from jobreview.sources.tables import profile_dimension, read_event_stream
from jobreview.streaming.enrichment import (
    LateRows,
    append_stream,
    default_checkpoint,
    late_rows,
    run_enrichment,
    state_rows,
)
from jobreview.plans.enrichment import EnrichmentOptions


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    """Event payloads in four time-ordered files, written one after another."""
    events = inputs.payloads(spark, sf_dir)
    path = scratch_dir(spark, "ordered")
    ordered = events.repartitionByRange(4, "payload.event_ts").select("*", F.spark_partition_id().alias("p"))
    for part in range(4):
        ordered.filter(F.col("p") == part).drop("p").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def tables(spark, sf_dir, staged):
    spark.sql("CREATE DATABASE IF NOT EXISTS crm")
    spark.read.parquet(staged).write.mode("overwrite").saveAsTable("crm.events")
    inputs.profiles(spark, sf_dir).write.mode("overwrite").saveAsTable("crm.profiles")
    return {"source_table": "crm.events", "profile_dim_table": "crm.profiles"}


def test_dimension_scan(spark, tables):
    dim = profile_dimension(spark, "crm.profiles")
    assert dim.count() == spark.table("crm.profiles").filter("is_current").count()


def test_job_appends_to_a_table_and_resumes(spark, tables, tmp_path):
    overrides = {
        **tables,
        "target_table": "crm.enriched",
        "checkpoint_path": str(tmp_path / "checkpoint"),
        "max_files_per_trigger": 1,
    }
    run_enrichment(spark, overrides)
    first = spark.table("crm.enriched")
    rows = first.count()
    assert rows == normalize_events(spark.table("crm.events")).count() > 0
    assert len(first.columns) == 18
    run_enrichment(spark, overrides)
    assert spark.table("crm.enriched").count() == rows
    spark.table("crm.events").limit(20).write.mode("append").saveAsTable("crm.events")
    run_enrichment(spark, overrides)
    # The appended rows repeat known keys, so the state drops them.
    assert spark.table("crm.enriched").count() == rows


def test_job_options_reach_the_stream(spark, tables, tmp_path):
    """Watermark, byte cap, salt and path target give the rows of the plain job."""
    base = {**tables, "target_table": None}
    plain, tuned = str(tmp_path / "plain"), str(tmp_path / "tuned")
    run_enrichment(spark, {**base, "target_path": plain}, as_of=F.lit("2024-06-30"))
    query = run_enrichment(
        spark,
        {
            **base,
            "target_path": tuned,
            "dedupe_delay": "60 days",
            "max_bytes_per_trigger": 1024,
            "salt_buckets": 3,
            "checkpoint_path": str(tmp_path / "checkpoint"),
        },
        as_of=F.lit("2024-06-30"),
    )
    assert len(state_rows(query)) > 1 and late_rows(query) == 0
    first, second = spark.read.parquet(plain), spark.read.parquet(tuned)
    assert first.count() == second.count() > 0
    assert first.exceptAll(second).count() == 0


def test_default_checkpoint_is_shared_and_stable(spark):
    options = EnrichmentOptions(target_table="a.b")
    path = default_checkpoint(spark, options)
    assert path == default_checkpoint(spark, options)
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_caps_are_checked(spark, staged):
    schema = spark.read.parquet(staged).schema
    for caps in (
        {"max_files_per_trigger": 1, "max_bytes_per_trigger": 1},
        {"max_bytes_per_trigger": "1g"},
        {"max_files_per_trigger": 0},
    ):
        with pytest.raises(ValueError):
            read_event_stream(spark, path=staged, schema=schema, **caps)
    with pytest.raises(ValueError):
        read_event_stream(spark, path=staged)
    with pytest.raises(ValueError):
        read_event_stream(spark, path=staged, table="t", schema=schema)


def event_stream(spark, staged):
    schema = spark.read.parquet(staged).schema
    stream = read_event_stream(spark, path=staged, schema=schema, max_files_per_trigger=1)
    return normalize_events(stream)


def run_to_path(df, tmp_path):
    query = append_stream(
        df, checkpoint_path=str(tmp_path / "checkpoint"), path=str(tmp_path / "rows")
    )
    query.awaitTermination()
    return query


def test_bounded_dedupe_keeps_ordered_rows_and_drops_state(spark, staged, tmp_path):
    query = run_to_path(dedupe_within(event_stream(spark, staged), "1 hour"), tmp_path)
    written = spark.read.parquet(str(tmp_path / "rows")).count()
    assert written == normalize_events(spark.read.parquet(staged)).count()
    assert late_rows(query) == 0
    assert max(state_rows(query)) < written


def test_bounded_dedupe_reports_late_rows(spark, staged, tmp_path):
    source = str(tmp_path / "reversed")
    ordered = spark.read.parquet(staged)
    # Newest events first. A batch drops by the watermark of the batch before the
    # last, so the third file is the first to lose rows.
    cuts = ordered.selectExpr("percentile_approx(payload.event_ts, array(0.33, 0.66)) c").first().c
    ts, low, high = F.col("payload.event_ts"), F.lit(cuts[0]), F.lit(cuts[1])
    for part in (ts >= high, (ts >= low) & (ts < high), ts < low):
        ordered.filter(part).coalesce(1).write.mode("append").parquet(source)
    counter = LateRows()
    spark.streams.addListener(counter)
    # The session keeps fewer reports than there are batches; the listener hears all.
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        query = run_to_path(dedupe_within(event_stream(spark, source), "1 hour"), tmp_path)
        late = counter.of(query)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
        spark.streams.removeListener(counter)
    kept = spark.read.parquet(str(tmp_path / "rows")).count()
    assert len(query.recentProgress) < 3  # batches
    assert late > 0
    assert kept + late == normalize_events(ordered).count()


def test_settings_are_required(spark):
    for given in ({}, {"source_table": "a"}, {"source_table": "a", "profile_dim_table": "b"}):
        with pytest.raises(ValueError):
            run_enrichment(spark, given)
    complete = {"source_table": "a", "enable_profile_join": False, "target_path": "c"}
    assert EnrichmentOptions().with_overrides(complete).checked().source_table == "a"


def test_latest_runs_on_a_stream(spark, staged):
    latest = keep_latest(event_stream(spark, staged), ["customer_id"], tie_break=["event_id"])
    query = (
        latest.writeStream.format("memory")
        .queryName("latest_events")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    batch = keep_latest(
        normalize_events(spark.read.parquet(staged)), ["customer_id"], tie_break=["event_id"]
    )
    streamed = spark.table("latest_events")
    assert streamed.count() == batch.count() > 0
    assert streamed.exceptAll(batch).count() == 0


@pytest.mark.parametrize("job", ["advisor", "references", "scan"])
def test_row_local_jobs_run_on_streams(spark, sf_dir, tmp_path, job):
    batch = {
        "advisor": inputs.kpis,
        "references": inputs.pull_requests,
        "scan": inputs.files,
    }[job](spark, sf_dir)
    step = {
        "advisor": lambda df: advisor.recommend(df).drop("operator_names"),
        "references": lambda df: runs.with_run_key(runs.run_refs_from_text(df)),
        "scan": lambda df: codescan.review_comments(codescan.code_hits(df, {"License": "look"})),
    }[job]
    source = str(tmp_path / "source")
    batch.write.parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    run_to_path(step(stream), tmp_path)
    streamed, expected = spark.read.parquet(str(tmp_path / "rows")), step(batch)
    assert streamed.count() == expected.count() > 0
    assert streamed.exceptAll(expected).count() == 0


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")

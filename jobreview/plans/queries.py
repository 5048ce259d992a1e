"""Registered queries: each operator over whole tables."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.functions.hashing import with_row_hash
from jobreview.functions.text import (
    bullets_if_list,
    clean_description,
    flatten_lines,
    list_bullets,
    walked_bullets,
)
from jobreview.operators import advisor, codescan, dedupe, insights, reports, runs, summary
from jobreview.operators.normalize import normalize_events
from jobreview.operators.profile import enrich_with_profile
from jobreview.operators.version_merge import VersionTable
from jobreview.operators.versions import close_versions, with_audit_columns
from jobreview.plans import inputs
from jobreview.plans.enrichment import EnrichmentOptions, enrich
from jobreview.plans.review import missing_runs
from jobreview.session import apply_conf, scratch_dir
from jobreview.sources import responses
from jobreview.sources.tables import current_profiles, read_event_stream
from jobreview.streaming.enrichment import append_stream, not_in_sink
from jobreview.streaming.hotkeys import HeavyHitters, enrich_hot_stream
from jobreview.streaming.latest import LatestTable, upsert_stream

BASE_URL = "https://monitor.example.com"
BRAND = reports.Brand("Job Review", "https://static.example.com/logo.svg")
AS_OF = "2024-06-30 12:34:56"
PAGE_CHARS = 1_000
N_RULES = 1_000
SCAN_RULES = {"License": "Check the license of this file.", "The ": "Start with a noun."}
TRACKED = ("loyalty_tier", "country", "email")


def _naive(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as they read in the session's zone."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# Enrichment ---------------------------------------------------------------


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(inputs.payloads(spark, sf_dir))


def q_normalize_events(spark, sf_dir):
    return _naive(normalized(spark, sf_dir))


def q_normalize_events_lenient(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    raw_ts = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(
        F.col("ts").cast("string")
    )
    lenient = normalize_events(inputs.as_payloads(events, raw_ts), strict=False)
    return _naive(lenient.select("customer_id", "event_id", "event_ts"))


def q_current_profiles(spark, sf_dir):
    return _naive(current_profiles(inputs.profiles(spark, sf_dir)))


def q_enrich_profile_left(spark, sf_dir):
    return _naive(enrich_with_profile(normalized(spark, sf_dir), inputs.profiles(spark, sf_dir)))


def q_enrich_profile_broadcast(spark, sf_dir):
    return _naive(
        enrich_with_profile(
            normalized(spark, sf_dir), inputs.profiles(spark, sf_dir), broadcast=True
        )
    )


def q_enrich_profile_salted(spark, sf_dir):
    return _naive(
        enrich_with_profile(
            normalized(spark, sf_dir), inputs.profiles(spark, sf_dir), salt_buckets=8
        )
    )


def q_enrich_profile_latest(spark, sf_dir):
    dim = inputs.profiles(spark, sf_dir)
    newer = dim.withColumn(
        "last_profile_update_ts", F.col("last_profile_update_ts") + F.make_dt_interval(F.lit(1))
    ).withColumn("segment", F.lower("segment"))
    return _naive(
        enrich_with_profile(
            normalized(spark, sf_dir), dim.unionByName(newer), on_duplicate="latest"
        )
    )


def q_dedupe_keys(spark, sf_dir):
    return _naive(dedupe.dedupe_events(inputs.twice(normalized(spark, sf_dir))))


def q_dedupe_latest(spark, sf_dir):
    return _naive(
        dedupe.keep_latest(
            normalized(spark, sf_dir), ["customer_id", "event_type"], tie_break=["event_id"]
        )
    )


def _row_hash(spark, sf_dir, *exclude, null_safe=False):
    enriched = enrich_with_profile(normalized(spark, sf_dir), inputs.profiles(spark, sf_dir))
    hashed = with_row_hash(enriched, exclude, null_safe=null_safe)
    return hashed.select("customer_id", "event_id", "row_hash")


def q_row_hash(spark, sf_dir):
    return _row_hash(spark, sf_dir)


def q_row_hash_excluding(spark, sf_dir):
    return _row_hash(spark, sf_dir, "event_ts", "last_profile_update_ts")


def q_row_hash_nullsafe(spark, sf_dir):
    return _row_hash(spark, sf_dir, null_safe=True)


def q_scd_audit_columns(spark, sf_dir):
    dim = inputs.profiles(spark, sf_dir).select("customer_id", "segment")
    return _naive(with_audit_columns(dim, _as_of()))


def q_scd2_close_versions(spark, sf_dir):
    return _naive(close_versions(normalized(spark, sf_dir), TRACKED))


def q_scd2_close_versions_split(spark, sf_dir):
    """The same rows by ranges of (key, time): safe for keys of any size."""
    return _naive(close_versions(normalized(spark, sf_dir), TRACKED, rows_per_slice=10_000))


def q_scd2_merge_batches(spark, sf_dir):
    """Three batches one after another; each has events earlier than the last one's."""
    events = normalized(spark, sf_dir)
    versions = VersionTable(spark, scratch_dir(spark, "versions"), events.schema, TRACKED, buckets=16)
    for batch_id in range(3):
        versions.merge(events.filter(F.col("event_id").cast("long") % 3 == batch_id), batch_id)
    return _naive(versions.read())


def q_enrichment_batch(spark, sf_dir):
    events = inputs.twice(inputs.payloads(spark, sf_dir))
    return _naive(enrich(events, inputs.profiles(spark, sf_dir), as_of=_as_of()))


# Streams ------------------------------------------------------------------


def _event_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = inputs.table(spark, sf_dir, "events").schema
    return read_event_stream(
        spark, path=sf_dir, schema=schema, path_glob="events.parquet", max_files_per_trigger=12000
    )


def _run_to_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Runs the stream to its end and reads what it appended."""
    target = scratch_dir(spark, "stream")
    append_stream(
        df, checkpoint_path=f"{target}/checkpoint", path=f"{target}/rows"
    ).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{target}/rows")


def q_enrichment_stream(spark, sf_dir):
    events = inputs.twice(inputs.as_payloads(_event_table_stream(spark, sf_dir)))
    enriched = enrich(events, inputs.profiles(spark, sf_dir), as_of=_as_of())
    return _naive(_run_to_table(spark, enriched))


def q_enrichment_stream_no_join(spark, sf_dir):
    events = inputs.as_payloads(_event_table_stream(spark, sf_dir))
    options = EnrichmentOptions(enable_profile_join=False, stateful_dedupe=False)
    return _naive(_run_to_table(spark, enrich(events, None, options, as_of=_as_of())))


def q_stream_dedupe_watermark(spark, sf_dir):
    """Doubled events in time-ordered files, one file per batch by a byte cap."""
    events = inputs.twice(normalized(spark, sf_dir))
    bounds = events.agg(F.min("event_ts").alias("low"), F.max("event_ts").alias("high")).first()
    span = (bounds["high"] - bounds["low"]) / 4
    staged = scratch_dir(spark, "ordered-events")
    for step in range(4):
        low, high = bounds["low"] + step * span, bounds["low"] + (step + 1) * span
        inside = F.col("event_ts") >= F.lit(low)
        if step < 3:
            inside = inside & (F.col("event_ts") < F.lit(high))
        events.filter(inside).write.mode("append").parquet(staged)
    stream = read_event_stream(spark, path=staged, schema=events.schema, max_bytes_per_trigger=1024)
    return _naive(_run_to_table(spark, dedupe.dedupe_within(stream, "30 days")))


def _four_files(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The events as a stream of four files, one in each batch."""
    staged_at = scratch_dir(spark, "event-files")
    dealt = events.repartition(4, "event_id").sortWithinPartitions("event_id")
    dealt.write.parquet(staged_at)
    return read_event_stream(spark, path=staged_at, schema=events.schema, max_files_per_trigger=1)


def q_dedupe_latest_stream(spark, sf_dir):
    """The latest row per key, upserted batch by batch."""
    events = normalized(spark, sf_dir)
    target = scratch_dir(spark, "latest")
    keys = ["customer_id", "event_type"]
    latest = LatestTable(spark, target, events.schema, keys=keys, tie_break=["event_id"], buckets=16)
    stream = _four_files(spark, events)
    upsert_stream(stream, latest, checkpoint_path=f"{target}/checkpoint").awaitTermination()
    return _naive(latest.read())


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Doubled events, and which of them lie in the earlier half of the time."""
    events = inputs.twice(normalized(spark, sf_dir))
    us = F.unix_micros("event_ts")
    bounds = events.agg(F.min(us).alias("low"), F.max(us).alias("high")).first()
    return events, us < F.lit(bounds["low"] + (bounds["high"] - bounds["low"]) // 2)


def q_stream_late_rows(spark, sf_dir):
    """Every key that was read, and whether a watermark of a day dropped it: the
    newer half comes first, in two batches, the earlier half last."""
    events, early = _halves(spark, sf_dir)
    newest = events.agg(F.max("event_ts").alias("ts")).first()["ts"]
    last_hours = F.col("event_ts") > F.lit(newest) - F.expr("INTERVAL 12 HOURS")
    staged_at = scratch_dir(spark, "late-events")
    for part in (~early & ~last_hours, last_hours, early):
        events.filter(part).coalesce(1).write.mode("append").parquet(staged_at)
    stream = read_event_stream(spark, path=staged_at, schema=events.schema, max_files_per_trigger=1)
    kept = _run_to_table(spark, dedupe.dedupe_within(stream, "1 day"))
    admitted = spark.read.schema(events.schema).parquet(staged_at)
    lost = not_in_sink(admitted, kept)
    rows = kept.select(*dedupe.EVENT_KEYS, F.lit(False).alias("late")).unionByName(
        lost.select(*dedupe.EVENT_KEYS, F.lit(True).alias("late"))
    )
    return rows.groupBy(*dedupe.EVENT_KEYS, "late").agg(F.count("*").alias("n"))


def q_enrichment_stream_hot(spark, sf_dir):
    """Unique events in four batches; customers frequent in earlier ones are spread."""
    events = normalized(spark, sf_dir)
    target = scratch_dir(spark, "hot")
    hitters = HeavyHitters(spark, f"{target}/keys", events.schema["customer_id"].dataType, capacity=100)
    enrich_hot_stream(
        dedupe.dedupe_events(_four_files(spark, events)),
        inputs.profiles(spark, sf_dir),
        hitters,
        path=f"{target}/rows",
        checkpoint_path=f"{target}/checkpoint",
        options=EnrichmentOptions(salt_buckets=4),
        as_of=_as_of(),
    ).awaitTermination()
    return _naive(spark.read.parquet(f"{target}/rows").drop("batch"))


# Advisor ------------------------------------------------------------------


def q_kpi_normalized(spark, sf_dir):
    filled = advisor.normalize_kpis(inputs.kpis(spark, sf_dir))
    return filled.withColumn("operators", F.array_join("operators", ",")).drop("operator_names")


def q_kpi_defaults(spark, sf_dir):
    kpis = inputs.kpis(spark, sf_dir).drop("rows_written", "environment")
    gaps = kpis.withColumn(
        "total_duration_seconds",
        F.when(F.col("query_id") % 3 != 0, F.col("total_duration_seconds")),
    ).withColumn(
        "operator_names",
        F.when(
            F.col("query_id") % 4 != 0,
            F.concat("operator_names", F.array(F.lit(None).cast("string"))),
        ),
    )
    return advisor.recommend(gaps).select("query_id", "recommendation")


def q_kpi_rules(spark, sf_dir):
    filled = advisor.normalize_kpis(inputs.kpis(spark, sf_dir))
    return filled.select(
        "query_id", *[condition.alias(name) for name, condition in advisor.rule_conditions().items()]
    )


def q_kpi_recommendation(spark, sf_dir):
    return advisor.recommend(inputs.kpis(spark, sf_dir)).select("query_id", "recommendation")


# Run references -----------------------------------------------------------


def q_clean_descriptions(spark, sf_dir):
    return inputs.pull_requests(spark, sf_dir).select(
        "pr_id",
        flatten_lines(F.col("description")).alias("flat"),
        clean_description(F.col("description")).alias("cleaned"),
    )


def q_clean_documents(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(clean_description(F.col("text")), 256).alias("cleaned_hash")
    )


def q_run_refs_text(spark, sf_dir):
    return runs.run_refs_from_text(inputs.pull_requests(spark, sf_dir))


def q_run_refs_urls(spark, sf_dir):
    return runs.run_refs_from_urls(inputs.pull_requests(spark, sf_dir))


def q_run_key(spark, sf_dir):
    refs = runs.run_refs_from_text(inputs.pull_requests(spark, sf_dir), dedupe=True)
    return runs.with_run_key(refs).select("pr_id", "run_key")


def q_lookback(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    as_of = F.lit("1998-08-02 10:37:42").cast("timestamp")
    dated = orders.withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return runs.within_lookback(dated, "ts", as_of).select("o_orderkey")


def _tables(spark, sf_dir):
    return {
        "summaries": responses.parse_task_summaries(
            responses.accepted(inputs.task_summaries(spark, sf_dir))
        ),
        "analyses": responses.accepted(inputs.analyses(spark, sf_dir)),
        "app_summaries": responses.parse_app_summary(
            responses.accepted(inputs.app_summaries(spark, sf_dir))
        ),
    }


def resolved_runs(spark, sf_dir):
    refs = runs.run_refs_from_text(inputs.pull_requests(spark, sf_dir))
    return runs.resolve_runs(refs, **_tables(spark, sf_dir))


def summarised_runs(spark, sf_dir, **options):
    return summary.with_app_summary(resolved_runs(spark, sf_dir), BASE_URL, **options)


def q_run_resolved(spark, sf_dir):
    return resolved_runs(spark, sf_dir).select(
        "pr_id",
        "pos",
        "run_key",
        "clusterUid",
        "sparkAppId",
        "recommendation",
        F.size("insights").alias("n_insights"),
    )


def q_run_resolved_relanded(spark, sf_dir):
    """Tables that were appended to, read as they are: the last accepted body of
    each key counts, and bodies of other keys are not parsed."""
    landed_runs = runs.resolve_landed(
        runs.run_refs_from_text(inputs.pull_requests(spark, sf_dir)),
        inputs.relanded(inputs.task_summaries(spark, sf_dir), ["run_key"], "[]", "z"),
        inputs.relanded(
            inputs.analyses(spark, sf_dir), runs.APP_KEY, '{"insightsV2": [], "recommendation": "old"}', "z"
        ),
        inputs.relanded(inputs.app_summaries(spark, sf_dir), runs.APP_KEY, "{}", "z"),
        landed_at="landed_at",
    )
    return landed_runs.runs.select(
        "pr_id", "pos", "run_key", "clusterUid", "recommendation", F.size("insights").alias("n_insights")
    )


def q_run_not_found(spark, sf_dir):
    summaries = _tables(spark, sf_dir)["summaries"]
    return missing_runs(inputs.pull_requests(spark, sf_dir), summaries).select(
        "pr_id", "pos", "run_key"
    )


def q_run_rejects(spark, sf_dir):
    refs = runs.run_refs_from_text(inputs.pull_requests(spark, sf_dir))
    return runs.run_rejects(refs, **_tables(spark, sf_dir))


def q_refused_responses(spark, sf_dir):
    return responses.rejected(inputs.analyses(spark, sf_dir)).select("clusterUid", "body")


def q_landed_bodies(spark, sf_dir):
    """Files landed twice, read in one scan: the last accepted body of each key,
    and every line that is none. Of the second landing some were refused and some
    cut off."""
    path = scratch_dir(spark, "landed")
    k = F.col("o_orderkey")
    start = F.concat(F.lit('{"clusterUid":"cl-'), k.cast("string"), F.lit('","response":'))
    first = F.concat(start, F.lit('{"recommendation":"old"}}'))
    answer = F.concat(start, F.lit('{"recommendation":"r'), k.cast("string"), F.lit('"}}'))
    second = (
        F.when(k % 19 == 0, F.concat(start, F.lit('{"message":"INVALID_TOKEN"}}')))
        .when(k % 17 == 0, F.concat(start, F.lit('{"recomm')))
        .otherwise(answer)
    )
    orders = inputs.table(spark, sf_dir, "orders")
    for line in (first, second):
        orders.select(line.alias("value")).write.mode("append").text(path)
    landed = responses.landed_bodies(spark, path, ["clusterUid"])
    kept = runs.latest_responses(landed.filter("state = 'accepted'"), ["clusterUid"], "landed_at")
    lost = landed.filter("state <> 'accepted'").select("clusterUid", "state", "body")
    return kept.select("clusterUid", F.lit("accepted").alias("state"), "body").unionByName(lost)


def q_unusable_analyses(spark, sf_dir):
    return responses.unusable_analyses(inputs.analyses(spark, sf_dir)).select("clusterUid", "body")


# Summaries and insights ---------------------------------------------------

SUMMARY_COLUMNS = (
    "pr_id",
    "pos",
    "run_page",
    "app_page",
    "cluster_page",
    "estimated_cost",
    "executor_node_type",
    "driver_node_type",
    "tags",
    "autoscale",
)


def _summaries_only(spark, sf_dir, **options):
    """Summaries straight from the landed table, one run per application."""
    landed = responses.parse_app_summary(inputs.app_summaries(spark, sf_dir))
    keyed = landed.withColumn("run_key", F.concat("sparkAppId", F.lit("_run")))
    return summary.with_app_summary(keyed, BASE_URL, **options)


def q_app_summary(spark, sf_dir):
    return summarised_runs(spark, sf_dir).select(*SUMMARY_COLUMNS)


def q_app_summary_custom_tags(spark, sf_dir):
    return _summaries_only(spark, sf_dir, include_custom_tags=True).select(
        "sparkAppId", "run_page", "tags"
    )


def q_bad_run_info(spark, sf_dir):
    landed = responses.parse_app_summary(inputs.app_summaries(spark, sf_dir))
    return summary.bad_run_info(landed).select("sparkAppId")


def q_summary_tables(spark, sf_dir):
    fields = _summaries_only(spark, sf_dir)
    return fields.select(
        "sparkAppId",
        reports.markdown_table(summary.summary_fields(summary.MARKDOWN_LINK)).alias("markdown"),
        reports.wiki_table(summary.summary_fields(summary.WIKI_LINK)).alias("wiki"),
    )


def q_insight_rows(spark, sf_dir):
    parsed = responses.parse_analysis(inputs.line_analyses(spark, sf_dir)).drop("recommendation")
    return insights.insight_rows(parsed)


def q_insight_rows_nested(spark, sf_dir):
    usable = responses.parse_analysis(inputs.analyses(spark, sf_dir))
    return insights.insight_rows(usable.drop("recommendation", "clusterUid"))


def q_unlabelled_insights(spark, sf_dir):
    usable = responses.parse_analysis(inputs.analyses(spark, sf_dir))
    return insights.unlabelled_insights(usable).select("sparkAppId", "key", "title")


def q_html_bullets(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", list_bullets(F.col("html")).alias("bullets")
    )


def q_html_bullets_any(spark, sf_dir):
    return inputs.table(spark, sf_dir, "pages").select(
        "page_id", list_bullets(F.col("html"), any_html=True).alias("bullets")
    )


def q_html_bullets_nested(spark, sf_dir):
    """The list of a page inside an item of another, with references: no Python."""
    inner = F.regexp_extract("html", "(?s)<ul>(.*?)</ul>", 1)
    nested = F.concat(
        F.lit("<ul><li>Page &quot;"),
        F.col("page_id").cast("string"),
        F.lit("&quot; &amp; all<!-- <li> --><ul>"),
        inner,
        F.lit("</ul></li><li> last &#233;&eacute;&amp </li></ul>"),
    )
    return inputs.table(spark, sf_dir, "pages").select("page_id", walked_bullets(nested).alias("bullets"))


def q_action_texts(spark, sf_dir):
    parsed = responses.parse_analysis(inputs.line_analyses(spark, sf_dir)).drop("recommendation")
    return insights.insight_rows(parsed).select(
        "l_orderkey", "l_linenumber", "key", bullets_if_list(F.col("actions")).alias("action_text")
    )


# Reports ------------------------------------------------------------------


def q_report_markdown(spark, sf_dir):
    report = reports.markdown_reports(summarised_runs(spark, sf_dir), BRAND)
    return report.select("pr_id", "from_pos", "report")


def q_report_wiki(spark, sf_dir):
    prs = inputs.pull_requests(spark, sf_dir)
    return reports.wiki_reports(summarised_runs(spark, sf_dir), prs, BRAND).select(
        "pr_id", "from_pos", "report"
    )


def q_report_paged(spark, sf_dir):
    """Small parts, so that many reports have several."""
    return reports.markdown_reports(
        summarised_runs(spark, sf_dir), BRAND, part_chars=PAGE_CHARS, positions_per_step=1
    )


def _reviewed(spark, sf_dir):
    return reports.reviewer_logins(reports.parse_pull_requests(inputs.reviewers(spark, sf_dir)))


def q_reviewers(spark, sf_dir):
    return _reviewed(spark, sf_dir).select(
        "pr_id", F.size("logins").alias("n"), F.array_join("logins", ",").alias("logins")
    )


def q_reviewer_mentions(spark, sf_dir):
    return reports.notifications(_reviewed(spark, sf_dir), BRAND)


# Code scan ----------------------------------------------------------------


def scanned(spark, sf_dir):
    return codescan.code_hits(
        codescan.changed_files(inputs.files(spark, sf_dir)), SCAN_RULES
    )


def q_code_hits(spark, sf_dir):
    return scanned(spark, sf_dir).select("filename", "pattern", "line")


def q_code_context(spark, sf_dir):
    return scanned(spark, sf_dir).select(
        "filename", "pattern", "line", F.array_join("context", "\n").alias("context")
    )


def q_code_hits_rule_table(spark, sf_dir):
    """A thousand rules, each a word of the files."""
    files = codescan.changed_files(inputs.files(spark, sf_dir))
    words = files.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("pattern"))
    rules = words.distinct().orderBy(F.md5("pattern")).limit(N_RULES)
    rules = rules.select("pattern", F.concat(F.lit("Mind "), "pattern").alias("advice"))
    return codescan.code_hits_by_table(files, rules).select("filename", "pattern", "advice", "line")


def comments(spark, sf_dir):
    return codescan.review_comments(scanned(spark, sf_dir))


def q_code_comments(spark, sf_dir):
    return comments(spark, sf_dir).drop("context")


def q_code_delivery(spark, sf_dir):
    status = F.when(F.col("line") % 2 == 0, 201).otherwise(422)
    return codescan.route_comments(comments(spark, sf_dir).withColumn("status", status))


def q_code_comments_gated(spark, sf_dir):
    return codescan.gate_by_runs(
        comments(spark, sf_dir).drop("context"), resolved_runs(spark, sf_dir)
    )


def _tuned(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_conf(spark)
        return query(spark, sf_dir)

    return run


def registry() -> dict:
    """Queries by name, run under the adaptive settings the joins count on."""
    return {
        name.removeprefix("q_"): _tuned(query)
        for name, query in globals().items()
        if name.startswith("q_")
    }

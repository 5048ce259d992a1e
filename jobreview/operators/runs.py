"""Run references: found in text, resolved against landed responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.functions.text import clean_description
from jobreview.operators.keyfilter import reduced
from jobreview.operators.summary import usable_annotation
from jobreview.session import staged
from jobreview.sources.responses import (
    accepted,
    parse_analysis,
    parse_app_summary,
    parse_task_summaries,
    rejected,
)

# Fixed value: the form of a run URL. Its dots are unescaped, so each of them
# stands for any character; ``(?d)`` ends lines at "\n" only.
RUN_URL = (
    r"(?d)https://adb-([0-9]+).([0-9]+).azuredatabricks.net/\?o=([0-9]+)#job/([0-9]+)/run/([0-9]+)"
)
RUN_URL_WHOLE = (
    r"(?d)^https://adb-([0-9]+).([0-9]+).azuredatabricks.net/\?o=([0-9]+)#job/([0-9]+)/run/([0-9]+)$"
)
ID_GROUPS = {"workspace_id": 3, "job_id": 4, "run_id": 5}
APP_KEY = ["clusterUid", "sparkAppId"]
LOOKBACK_DAYS = 14


def _ids(url: str) -> list[Column]:
    return [F.regexp_extract(url, RUN_URL, group).alias(name) for name, group in ID_GROUPS.items()]


def run_refs_from_text(
    pull_requests: DataFrame, text: str = "description", *, dedupe: bool = False
) -> DataFrame:
    """Every run URL of the cleaned text: ``pr_id, pos`` and three ids.

    Repeats stay unless ``dedupe``, which keeps the first position of each run.
    """
    cleaned = pull_requests.select("pr_id", clean_description(F.col(text)).alias("_text"))
    urls = F.regexp_extract_all("_text", F.lit(RUN_URL), F.lit(0))
    found = cleaned.select("pr_id", F.posexplode(urls).alias("pos", "_url"))
    # A URL found is one match, and its ids are digits: one pattern reads all three.
    groups = "_".join(f"${group}" for group in ID_GROUPS.values())
    listed = found.select("pr_id", "pos", F.split(F.regexp_replace("_url", RUN_URL, groups), "_").alias("_ids"))
    refs = listed.select("pr_id", "pos", *[F.get("_ids", F.lit(i)).alias(name) for i, name in enumerate(ID_GROUPS)])
    if dedupe:
        refs = refs.groupBy("pr_id", *ID_GROUPS).agg(F.min("pos").alias("pos"))
        refs = refs.select("pr_id", "pos", *ID_GROUPS)
    return refs


def run_refs_from_urls(pull_requests: DataFrame, urls: str = "runs") -> DataFrame:
    """The list entries that are run URLs as a whole, with the URL kept."""
    listed = pull_requests.select("pr_id", F.posexplode(urls).alias("pos", "run_url"))
    return listed.filter(F.col("run_url").rlike(RUN_URL_WHOLE)).select(
        "pr_id", "pos", "run_url", *_ids("run_url")
    )


def with_run_key(refs: DataFrame) -> DataFrame:
    """Adds ``workspace_job_run``, the key of the landed task summaries."""
    return refs.withColumn("run_key", F.concat_ws("_", *ID_GROUPS))


def lookback_window(as_of: Column, days: int = LOOKBACK_DAYS) -> tuple[Column, Column]:
    """Start and end of the look-back: hours and seconds of ``as_of`` are kept,
    its minutes and fractions are zero."""
    end = F.date_trunc("hour", as_of) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.second(as_of)
    )
    return end - F.make_dt_interval(F.lit(days)), end


def within_lookback(df: DataFrame, ts: str, as_of: Column, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Rows inside the look-back window. No pipeline applies it by itself."""
    start, end = lookback_window(as_of, days)
    return df.filter(F.col(ts).between(start, end))


def _shuffled(responses: DataFrame) -> DataFrame:
    """Response tables grow with the runs, and their parsed rows outgrow Spark's
    estimate of them, so they are merged after a shuffle, never broadcast."""
    return responses.hint("merge")


def first_tasks(summaries: DataFrame) -> DataFrame:
    """Per run key the first task's cluster and application. Empty lists go, and
    so does a first task without both ids: an error payload parses to one."""
    task = F.get("summaries", F.lit(0))
    tasks = summaries.filter(F.size("summaries") > 0).select(
        "run_key", task["clusterUid"].alias("clusterUid"), task["sparkAppId"].alias("sparkAppId")
    )
    return tasks.dropna(subset=APP_KEY)


def runs_with_task(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs joined to their first task; runs without one are left out."""
    return runs.join(_shuffled(first_tasks(summaries)), "run_key")


def runs_not_found(runs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs without a usable task summary."""
    return runs.join(_shuffled(first_tasks(summaries).select("run_key")), "run_key", "left_anti")


def with_analysis(runs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Runs joined to their analysis; an empty or malformed one drops the run.

    Bodies are parsed before the shuffle, which then moves only the fields used.
    """
    return runs.join(_shuffled(parse_analysis(analyses)), APP_KEY)


def with_annotation(runs: DataFrame, app_summaries: DataFrame) -> DataFrame:
    """Runs joined to the annotation of their application."""
    return runs.join(_shuffled(app_summaries.select(*APP_KEY, "annotation")), APP_KEY)


def resolve_runs(
    refs: DataFrame, summaries: DataFrame, analyses: DataFrame, app_summaries: DataFrame
) -> DataFrame:
    """Run references with everything a report needs.

    Each lookup table has one row per key. All joins are equi-joins with the
    runs on the left, so AQE can split the partitions of runs named very often.
    The last two share one partitioning by application; with
    ``forceOptimizeSkewedJoin`` (see ``session``) AQE gives that up, and shuffles
    once more, only where it finds a skewed application.
    """
    runs = runs_with_task(with_run_key(refs), summaries)
    return with_annotation(with_analysis(runs, analyses), app_summaries)


def latest_responses(
    responses: DataFrame, key: list[str], landed_at: str | None, body: str = "body"
) -> DataFrame:
    """One response per key where landed tables are appended to: the last by
    ``landed_at``, then by body; without a landing time the greatest body, always
    the same. A maximum, combined before the shuffle."""
    if landed_at is None or landed_at == body:
        return responses.groupBy(*key).agg(F.max(body).alias(body))
    last = F.max(F.struct(landed_at, body)).alias("_last")
    return responses.groupBy(*key).agg(last).select(*key, f"_last.{landed_at}", f"_last.{body}")


def run_rejects(
    refs: DataFrame, summaries: DataFrame, analyses: DataFrame, app_summaries: DataFrame
) -> DataFrame:
    """Every reference that ``resolve_runs`` or the app summary loses, with the
    first ``reason``: resolved and rejected references together are all found."""
    runs = with_run_key(refs).join(_shuffled(first_tasks(summaries)), "run_key", "left")
    analysed = parse_analysis(analyses).select(*APP_KEY, F.lit(True).alias("_analysed"))
    runs = runs.join(_shuffled(analysed), APP_KEY, "left")
    known = app_summaries.select(*APP_KEY, usable_annotation(F.col("annotation")).alias("_usable"))
    runs = runs.join(_shuffled(known), APP_KEY, "left")
    reason = (
        F.when(F.col("clusterUid").isNull(), "no task summary")
        .when(F.col("_analysed").isNull(), "no analysis")
        .when(F.col("_usable").isNull(), "no app summary")
        .when(~F.col("_usable"), "unusable app summary")
    )
    lost = runs.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return lost.select("pr_id", "pos", "run_key", "reason")


@dataclass(frozen=True)
class LandedRuns:
    """Runs resolved from landed bodies, and what did not get there."""

    runs: DataFrame
    rejects: DataFrame
    refused: DataFrame


def named_responses(
    responses: DataFrame, keys: DataFrame, columns: list[str], landed_at: str | None = None
) -> DataFrame:
    """The response to go by for each of ``keys``: of the accepted ones the last
    landed, or without a landing time the greatest body. Bodies of other keys are
    left out by a key filter before any body is looked into; the few that pass it
    find no run to join."""
    kept = accepted(reduced(responses, keys, columns))
    return latest_responses(kept, columns, landed_at).select(*columns, "body")


def resolve_landed(
    refs: DataFrame,
    summaries: DataFrame,
    analyses: DataFrame,
    app_summaries: DataFrame,
    *,
    landed_at: str | None = None,
) -> LandedRuns:
    """``resolve_runs`` over tables of landed bodies that are appended to: key,
    ``body`` and perhaps a landing time. Error payloads are no answers; they are
    ``refused``, and an earlier answer stands.

    The references are stored, and so are the applications they lead to, because
    both also say which bodies are worth reading.
    """
    runs = staged(with_run_key(refs), "run-refs")
    run_keys = staged(runs.select("run_key").distinct(), "run-keys")
    tasks = parse_task_summaries(named_responses(summaries, run_keys, ["run_key"], landed_at))
    tasks = staged(first_tasks(tasks), "run-tasks")
    apps = staged(tasks.select(*APP_KEY).distinct(), "run-apps")
    bodies = named_responses(analyses, apps, APP_KEY, landed_at)
    known = parse_app_summary(named_responses(app_summaries, apps, APP_KEY, landed_at))
    found = with_annotation(with_analysis(runs.join(_shuffled(tasks), "run_key"), bodies), known)
    as_listed = tasks.select("run_key", F.array(F.struct(*APP_KEY)).alias("summaries"))
    refused = [
        rejected(table).select(F.lit(kind).alias("kind"), F.concat_ws("/", *columns).alias("response_key"), "body")
        for kind, table, columns in (
            ("task summary", summaries, ["run_key"]),
            ("analysis", analyses, APP_KEY),
            ("app summary", app_summaries, APP_KEY),
        )
    ]
    return LandedRuns(
        runs=found,
        rejects=run_rejects(runs.drop("run_key"), as_listed, bodies, known),
        refused=refused[0].unionByName(refused[1]).unionByName(refused[2]),
    )

"""The review of pull requests, from descriptions to reports and comments."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobreview.operators.codescan import RULES, code_hits, gate_by_runs, review_comments
from jobreview.operators.insights import unlabelled_insights
from jobreview.operators.reports import Brand, markdown_reports, wiki_reports
from jobreview.operators.runs import (
    APP_KEY,
    resolve_landed,
    resolve_runs,
    run_refs_from_text,
    run_rejects,
    runs_not_found,
    with_run_key,
)
from jobreview.operators.summary import bad_run_info, with_app_summary
from jobreview.session import staged
from jobreview.sources.responses import accepted, rejected


@dataclass(frozen=True)
class Review:
    """Lazy results; write the ones you need.

    Several of them start from ``runs``: write that once to a table and use
    ``review_from_runs`` if more than one is wanted.
    """

    runs: DataFrame
    markdown: DataFrame
    wiki: DataFrame
    comments: DataFrame
    unlabelled: DataFrame
    bad_run_info: DataFrame
    #: References without a report, each with the reason; NULL if not known here.
    rejects: DataFrame | None = None
    #: Error payloads among the landed responses.
    refused: DataFrame | None = None


def review_from_runs(
    runs: DataFrame,
    pull_requests: DataFrame,
    files: DataFrame,
    base_url: str,
    *,
    brand: Brand = Brand(),
    rules: Mapping[str, str] = RULES,
    strict: bool = False,
    include_custom_tags: bool = False,
) -> Review:
    """Reports and comments over resolved runs (rows of ``resolve_runs``)."""
    summarised = with_app_summary(runs, base_url, include_custom_tags=include_custom_tags)
    return Review(
        runs=runs,
        markdown=markdown_reports(summarised, brand, strict=strict),
        wiki=wiki_reports(summarised, pull_requests, brand, strict=strict),
        comments=gate_by_runs(review_comments(code_hits(files, rules)), summarised),
        unlabelled=unlabelled_insights(runs),
        bad_run_info=bad_run_info(runs),
    )


def review_pull_requests(
    pull_requests: DataFrame,
    summaries: DataFrame,
    analyses: DataFrame,
    app_summaries: DataFrame,
    files: DataFrame,
    base_url: str,
    **options,
) -> Review:
    """The whole review over lookup tables of one row per key: parsed task and
    application summaries, and analysis bodies, of which error payloads go.

    ``pull_requests`` needs ``pr_id, description`` and, for the wiki report,
    ``commit_id, base_branch, target_branch``.
    """
    refs = run_refs_from_text(pull_requests)
    good = accepted(analyses)
    review = review_from_runs(
        resolve_runs(refs, summaries, good, app_summaries), pull_requests, files, base_url, **options
    )
    refused = rejected(analyses).select(
        F.lit("analysis").alias("kind"), F.concat_ws("/", *APP_KEY).alias("response_key"), "body"
    )
    return replace(review, rejects=run_rejects(refs, summaries, good, app_summaries), refused=refused)


def review_landed(
    pull_requests: DataFrame,
    summaries: DataFrame,
    analyses: DataFrame,
    app_summaries: DataFrame,
    files: DataFrame,
    base_url: str,
    *,
    landed_at: str | None = None,
    **options,
) -> Review:
    """The whole review over tables of landed bodies as they are: several per key,
    error payloads among them, and bodies that no pull request names."""
    landed = resolve_landed(
        run_refs_from_text(pull_requests), summaries, analyses, app_summaries, landed_at=landed_at
    )
    runs = staged(landed.runs, "review-runs")
    review = review_from_runs(runs, pull_requests, files, base_url, **options)
    return replace(review, rejects=landed.rejects, refused=landed.refused)


def missing_runs(pull_requests: DataFrame, summaries: DataFrame) -> DataFrame:
    """References no task summary was found for."""
    return runs_not_found(with_run_key(run_refs_from_text(pull_requests)), summaries)

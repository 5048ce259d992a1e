"""Reports per pull request, in markdown and in wiki markup."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobreview.functions.templates import fill, shown
from jobreview.functions.text import bullets_if_lists, need_parser
from jobreview.operators.insights import shown_instances
from jobreview.operators.sizing import broadcast_if_small
from jobreview.operators.summary import MARKDOWN_LINK, WIKI_LINK, summary_fields
from jobreview.session import staged
from jobreview.sources.schemas import PULL_REQUEST


@dataclass(frozen=True)
class Brand:
    """Name and logo printed in the reports; set your own."""

    name: str = "Job Review"
    logo_url: str = "logo.svg"


# The report texts, tabs and symbols included.
MARKDOWN_HEAD = (
    "----\n<details>\n"
    "<summary> <img src='{logo}' alt='Logo'> <b>Workspace Id: {workspace_id}, "
    "Job Id: {job_id}, Run Id: {run_id}</b></summary>\n\n"
    "----\n#### [{brand} url]({run_page})\n"
)
MARKDOWN_SUMMARY = (
    "----\nApp Summary  <sup>*Estimated cost is sum of DBUs and VM Cost</sup>\n----\n{table}"
)
MARKDOWN_CARD = (
    "| {key}: {label} |\n|---\t|\n"
    "| ℹ️ **{title}** \t|\n| ⚡ **Details**<br>{events}\t|\n| 🛠 **Actions**<br>{actions}\t|\n\n"
)
MARKDOWN_TAIL = "</details>\n\n"
WIKI_PREAMBLE = (
    "----\nThis Issue was automatically created by {brand} to follow up on the insights generated "
    "for the runs of the jobs mentioned in the description of pr number {pr_id} was raised to "
    "merge {commit_id} from {base_branch} to {target_branch}\n"
)
WIKI_HEAD = (
    "----\nWorkspace Id: {workspace_id}, Job Id: {job_id}, Run Id: {run_id}\n\n"
    "----\n[{brand} URL|{run_page}]\n"
)
WIKI_SUMMARY = (
    "----\nApp Summary\n*Estimated cost is the sum of DBUs and VM Cost\n----\n\n{table}"
)
WIKI_CARD = (
    "\n|| {key}: {label} ||\n"
    "| ℹ️ *{title}* \t|\n| ⚡ *Details*\n{events}\t|\n| 🛠 *Actions*\n{actions}\t|\n\n"
)
INSIGHTS_HEADING = "\n{brand} Insights\n----\n"
NOTIFICATION = (
    "{brand} has insights for the pr number {pr_id} which was raised to merge {commit_id} from "
    "{base_branch} to {target_branch}. Click this link for further details {pr_url}, alos a jira "
    "has been raised please find the jira link {ticket_url}"
)

PREAMBLE_POS = -1
PART_CHARS = 16_000_000
# Positions that one task sorts to add up their sizes; no part depends on it.
POSITIONS_PER_STEP = 10_000


def markdown_table(fields: list[tuple[str, Column]]) -> Column:
    """Header, separator and value line of ordered names and values.

    The names are known while the plan is built, so the first two lines are one
    literal and the values one concatenation.
    """
    header = "| " + " | ".join(name for name, _ in fields) + " |\n"
    rule = "| " + " | ".join("---" for _ in fields) + " |\n"
    return _value_line(header + rule, fields)


def wiki_table(fields: list[tuple[str, Column]]) -> Column:
    """Header and value line of ordered names and values."""
    return _value_line("|| " + " || ".join(name for name, _ in fields) + " |\n", fields)


def _value_line(head: str, fields: list[tuple[str, Column]]) -> Column:
    values = F.concat_ws(" | ", *[shown(value) for _, value in fields])
    return F.concat(F.lit(head + "| "), values, F.lit(" |\n"))


def markdown_card(card: Column) -> Column:
    names = ("key", "label", "title", "events", "actions")
    return fill(MARKDOWN_CARD, **{name: card[name] for name in names})


def wiki_card(card: Column, actions: Column) -> Column:
    names = ("key", "label", "title", "events")
    return fill(WIKI_CARD, **{name: card[name] for name in names}, actions=actions)


def insight_section(brand: Brand, cards: Column) -> Column:
    """Heading and cards; the heading stands even if every card is filtered out."""
    heading = F.lit(INSIGHTS_HEADING.format(brand=brand.name))
    texts = F.concat(heading, F.array_join(cards, ""))
    return F.when(F.size("insights") > 0, texts).otherwise(F.lit(""))


def _run_columns() -> dict[str, Column]:
    return {name: F.col(name) for name in ("workspace_id", "job_id", "run_id", "run_page")}


def markdown_block(brand: Brand, *, strict: bool = False) -> Column:
    """Report text of one run, from columns of ``with_app_summary``."""
    cards = F.transform(shown_instances(F.col("insights"), strict=strict), markdown_card)
    return F.concat(
        fill(MARKDOWN_HEAD, logo=brand.logo_url, brand=brand.name, **_run_columns()),
        fill(MARKDOWN_SUMMARY, table=markdown_table(summary_fields(MARKDOWN_LINK))),
        insight_section(brand, cards),
        F.lit(MARKDOWN_TAIL),
    )


def wiki_block(brand: Brand) -> Column:
    """The same in wiki markup, from columns of ``with_wiki_cards``."""
    return F.concat(_wiki_start(brand), insight_section(brand, F.zip_with("_cards", "_actions", wiki_card)))


def _wiki_start(brand: Brand) -> Column:
    return F.concat(
        fill(WIKI_HEAD, brand=brand.name, **_run_columns()),
        fill(WIKI_SUMMARY, table=wiki_table(summary_fields(WIKI_LINK))),
    )


def with_wiki_cards(runs: DataFrame, *, strict: bool = False, any_html: bool = True) -> DataFrame:
    """Adds a run's shown instances and, in their order, the action texts with
    HTML lists turned into bullets. Both stay in the run's row."""
    shown_cards = runs.withColumn("_cards", shown_instances(F.col("insights"), strict=strict))
    actions = bullets_if_lists(F.col("_cards.actions"), any_html=any_html)
    return shown_cards.withColumn("_actions", actions)


def _wiki_blocks(runs: DataFrame, brand: Brand, *, strict: bool, any_html: bool) -> DataFrame:
    """``pr_id, pos, block, chars`` of each run, stored. Only the runs whose
    actions need the HTML parser go through it: of these the cards are stored
    first, and the texts afterwards."""
    carded = with_wiki_cards(runs, strict=strict, any_html=False)
    if not any_html:
        return _stored(carded.select("pr_id", "pos", wiki_block(brand).alias("block")))
    hard = carded.withColumn("_hard", need_parser(F.col("_cards.actions")))
    section = insight_section(brand, F.zip_with("_cards", "_actions", wiki_card))
    block = F.concat(_wiki_start(brand), F.when(F.col("_hard"), "").otherwise(section))
    cards = F.when(F.col("_hard"), F.col("_cards")).alias("_cards")
    first = staged(hard.select("pr_id", "pos", block.alias("block"), cards), "wiki-blocks")
    done = first.filter(F.col("_cards").isNull()).select("pr_id", "pos", "block", F.length("block").alias("chars"))
    parsed = first.filter(F.col("_cards").isNotNull())
    if parsed.isEmpty():
        return done
    parsed = parsed.withColumn("_actions", bullets_if_lists(F.col("_cards.actions")))
    # Whoever has cards has insights.
    section = F.concat(
        F.lit(INSIGHTS_HEADING.format(brand=brand.name)),
        F.array_join(F.zip_with("_cards", "_actions", wiki_card), ""),
    )
    return done.unionByName(_stored(parsed.select("pr_id", "pos", F.concat("block", section).alias("block"))))


def _stored(blocks: DataFrame) -> DataFrame:
    """The blocks as a table: their texts are made once, their sizes read apart."""
    return staged(blocks.select("pr_id", "pos", "block", F.length("block").alias("chars")), "report-blocks")


def _part_starts(sizes: DataFrame, part_chars: int, positions_per_step: int) -> DataFrame:
    """``pr_id, starts``: where each part but the first begins, for the reports
    that have several. ``sizes``: pr_id, pos, chars.

    The characters before a block are a sum over its whole report, taken in two
    levels: within steps of so many positions, and over the steps' totals. The
    steps bound what one task sorts, and change nothing else.
    """
    large = sizes.groupBy("pr_id").agg(F.sum("chars").alias("total")).filter(F.col("total") > part_chars)
    large = broadcast_if_small(staged(large.select("pr_id"), "large-reports"))
    step = F.floor(F.greatest(F.col("pos"), F.lit(0)) / positions_per_step)
    stepped = sizes.join(large, "pr_id", "left_semi").withColumn("_step", step)
    totals = stepped.groupBy("pr_id", "_step").agg(F.sum("chars").alias("_total"))
    along = Window.rowsBetween(Window.unboundedPreceding, -1)
    above = F.sum("_total").over(along.partitionBy("pr_id").orderBy("_step"))
    offsets = totals.select("pr_id", "_step", F.coalesce(above, F.lit(0)).alias("_above"))
    inside = F.sum("chars").over(along.partitionBy("pr_id", "_step").orderBy("pos"))
    placed = stepped.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, ["pr_id", "_step"])
    part = F.floor((F.col("_above") + F.col("_inside")) / part_chars)
    starts = placed.groupBy("pr_id", part.alias("_part")).agg(F.min("pos").alias("start"))
    later = starts.filter(F.col("_part") > 0)
    return later.groupBy("pr_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))


def _assembled(stored: DataFrame, part_chars: int, positions_per_step: int) -> DataFrame:
    sizes = stored.select("pr_id", "pos", "chars")
    starts = staged(_part_starts(sizes, part_chars, positions_per_step), "report-parts")
    placed = stored.join(broadcast_if_small(starts), "pr_id", "left")
    before = F.filter("starts", lambda start: start <= F.col("pos"))
    parts = placed.select(
        "pr_id",
        "pos",
        "block",
        F.when(F.col("starts").isNull(), 0).otherwise(F.size(before)).alias("part"),
        F.when(F.col("starts").isNull(), 1).otherwise(F.size("starts") + 1).alias("n_parts"),
    )
    texts = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return (
        parts.groupBy("pr_id", "part", "n_parts")
        .agg(F.min("pos").alias("from_pos"), texts.alias("_texts"))
        .select(
            "pr_id",
            "part",
            "n_parts",
            "from_pos",
            F.array_join(F.transform("_texts", lambda text: text["block"]), "").alias("report"),
        )
    )


def assemble_reports(
    blocks: DataFrame,
    *,
    part_chars: int = PART_CHARS,
    positions_per_step: int = POSITIONS_PER_STEP,
) -> DataFrame:
    """``pr_id, part, n_parts, from_pos, report`` from ``pr_id, pos, block``.

    A block belongs to the part that its report has reached before it, at
    ``part_chars`` characters each; parts are numbered from 0 without gaps, and
    their texts in that order are the report. No task holds more of one pull
    request than a part. A position occurs once per pull request.
    """
    return _assembled(_stored(blocks), part_chars, positions_per_step)


def markdown_reports(
    runs: DataFrame, brand: Brand = Brand(), *, strict: bool = False, **parts
) -> DataFrame:
    """Markdown report per pull request over rows of ``with_app_summary``."""
    blocks = runs.select("pr_id", "pos", markdown_block(brand, strict=strict).alias("block"))
    return assemble_reports(blocks, **parts)


def wiki_preambles(pull_requests: DataFrame, brand: Brand = Brand()) -> DataFrame:
    """First text of each wiki report, placed before all runs."""
    names = ("pr_id", "commit_id", "base_branch", "target_branch")
    text = fill(WIKI_PREAMBLE, brand=brand.name, **{name: F.col(name) for name in names})
    return pull_requests.select("pr_id", F.lit(PREAMBLE_POS).alias("pos"), text.alias("block"))


def wiki_reports(
    runs: DataFrame,
    pull_requests: DataFrame,
    brand: Brand = Brand(),
    *,
    strict: bool = False,
    any_html: bool = True,
    part_chars: int = PART_CHARS,
    positions_per_step: int = POSITIONS_PER_STEP,
) -> DataFrame:
    """Wiki report per pull request with a run: preamble, then the run blocks.

    The blocks are stored first, and name the pull requests that get a preamble:
    the runs are looked up once. ``any_html=False`` leaves the HTML parser out,
    where all action lists are flat.
    """
    stored = _wiki_blocks(runs, brand, strict=strict, any_html=any_html)
    reviewed = pull_requests.join(stored.select("pr_id").distinct().hint("merge"), "pr_id")
    preambles = _stored(wiki_preambles(reviewed, brand))
    return _assembled(stored.unionByName(preambles), part_chars, positions_per_step)


def parse_pull_requests(responses: DataFrame, body: str = "body") -> DataFrame:
    """Landed pull requests with ``requested_reviewers`` read from their JSON body.
    A body that is refused or malformed names no reviewer."""
    others = [name for name in responses.columns if name != body]
    return responses.select(*others, F.inline(F.array(F.from_json(body, PULL_REQUEST))))


def reviewer_logins(pull_requests: DataFrame, reviewers: str = "requested_reviewers") -> DataFrame:
    """The pull requests with ``logins``, those of the requested reviewers in
    order, instead of the reviewers; none is an empty list."""
    logins = F.transform(reviewers, lambda reviewer: reviewer["login"])
    others = [name for name in pull_requests.columns if name != reviewers]
    return pull_requests.select(*others, F.coalesce(logins, F.array().cast("array<string>")).alias("logins"))


def mentions(logins: Column) -> Column:
    """``@login`` words."""
    return F.array_join(F.transform(logins, lambda login: F.concat(F.lit("@"), login)), " ")


def notifications(pull_requests: DataFrame, brand: Brand = Brand()) -> DataFrame:
    """Notification text with mentions, from pull requests with ``logins``."""
    names = ("pr_id", "commit_id", "base_branch", "target_branch", "pr_url", "ticket_url")
    text = fill(NOTIFICATION, brand=brand.name, **{name: F.col(name) for name in names})
    message = F.concat(text, F.lit(" "), mentions(F.col("logins")))
    return pull_requests.select("pr_id", message.alias("message"))

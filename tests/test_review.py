"""Run references, responses, insights, summaries and reports."""

import json
from datetime import datetime

import pytest
from plan_text import plan_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from jobreview.operators import insights, reports, runs, summary
from jobreview.operators.reports import Brand, assemble_reports
from jobreview.plans.review import missing_runs, review_landed, review_pull_requests
from jobreview.session import staged
from jobreview.sources import responses, schemas

URL = "https://adb-12.3.azuredatabricks.net/?o=12#job/{}/run/{}"
BASE = "https://m.example.com"
BRAND = Brand("Acme", "https://acme.example.com/logo.svg")


def descriptions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "pr_id long, description string")


def test_references_in_order_with_repeats(spark):
    text = f"a {URL.format(1, 2)}\nb{URL.format(3, 4)}<br>{URL.format(1, 2)} <{URL.format(9, 9)}>"
    prs = descriptions(spark, text, "none", None)
    found = [tuple(row) for row in runs.run_refs_from_text(prs).collect()]
    assert found == [(0, 0, "12", "1", "2"), (0, 1, "12", "3", "4"), (0, 2, "12", "1", "2")]
    once = runs.run_refs_from_text(prs, dedupe=True).orderBy("pos").collect()
    assert [(row.pos, row.job_id) for row in once] == [(0, "1"), (1, "3")]


def test_pattern_dots_match_any_character(spark):
    loose = "https://adb-1x2yazuredatabricksznet/?o=5#job/6/run/7"
    row = runs.run_refs_from_text(descriptions(spark, loose)).first()
    assert (row.workspace_id, row.job_id, row.run_id) == ("5", "6", "7")


def test_listed_urls_match_as_a_whole(spark):
    good = URL.format(1, 2)
    listed = [good, good + "\n", good + "\r", " " + good, good + "0x", None]
    prs = spark.createDataFrame([(7, listed)], "pr_id long, runs array<string>")
    found = runs.run_refs_from_urls(prs).collect()
    assert [(row.pos, row.run_url) for row in found] == [(0, good), (1, good + "\n")]


def test_lookback_window(spark):
    as_of = F.lit("2024-03-20 10:37:42.5").cast("timestamp")
    start, end = runs.lookback_window(as_of)
    row = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    assert (row.s, row.e) == (datetime(2024, 3, 6, 10, 0, 42), datetime(2024, 3, 20, 10, 0, 42))


def test_row_local_steps_do_not_shuffle(spark):
    prs = descriptions(spark, "x")
    assert "Exchange" not in plan_of(runs.with_run_key(runs.run_refs_from_text(prs)))


def test_bad_token_guard(spark):
    bodies = [
        '{"message": "INVALID_TOKEN"}',
        '{"message": "INVALID\\u005fTOKEN"}',
        '{"message": "other"}',
        '{"a": {"message": "INVALID_TOKEN"}}',
        "[]",
        "INVALID_TOKEN {",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    assert [row.i for row in responses.rejected(df).collect()] == [0, 1]
    assert [row.i for row in responses.accepted(df).collect()] == [2, 3, 4, 5, 6]
    with pytest.raises(PySparkException, match="INVALID_TOKEN"):
        responses.checked(df).collect()
    assert responses.checked(df.filter("i > 1")).count() == 5


def test_landed_json_is_read_with_a_schema(spark, tmp_path):
    body = {"insightsV2": [{"categories": {"c": {"instances": []}}}], "recommendation": "r"}
    (tmp_path / "part.json").write_text(json.dumps(body) + "\n" + '{"broken"\n')
    df = responses.read_landed(spark, str(tmp_path), schemas.ANALYSIS)
    assert df.schema == schemas.ANALYSIS
    assert df.filter("insightsV2 is not null").count() == 1


def instance(key, title="t", events="e", actions="a"):
    return {"key": key, "title": title, "events": events, "actions": actions}


INSIGHTS = [
    {"categories": {"b": {"instances": [instance("SLA"), instance("sparkapptimereport")]}, "a": {"instances": []}}},
    {"categories": None},
    {"categories": {}},
    {"categories": {"c": {"instances": None}, "d": {"instances": [instance("Nope"), instance("appFailure", None)]}}},
]


def analysis_frame(spark, body, **others):
    rows = [("cl", "app", body if isinstance(body, str) else json.dumps(body))]
    return spark.createDataFrame(rows, "clusterUid string, sparkAppId string, body string")


def test_insight_rows(spark):
    parsed = responses.parse_analysis(
        analysis_frame(spark, {"insightsV2": INSIGHTS, "recommendation": {"x": 1}})
    )
    found = insights.insight_rows(parsed).collect()
    assert [
        (r.insight_pos, r.category_pos, r.instance_pos, r.category, r.key, r.label) for r in found
    ] == [
        (0, 0, 0, "b", "SLA", insights.LABELS["SLA"]),
        (3, 1, 0, "d", "Nope", None),
        (3, 1, 1, "d", "appFailure", insights.LABELS["appFailure"]),
    ]
    assert [r.key for r in insights.unlabelled_insights(parsed).collect()] == ["Nope"]
    array = parsed.select(insights.shown_instances(F.col("insights")).alias("s")).first().s
    assert [(card.key, card.title) for card in array] == [("SLA", "t"), ("APPFAILURE", None)]
    with pytest.raises(PySparkException, match="unknown insight key: Nope"):
        parsed.select(insights.shown_instances(F.col("insights"), strict=True)).collect()


@pytest.mark.parametrize("body", ["{}", "null", "", '{"insightsV2": [{', "[]"])
def test_unusable_analysis(spark, body):
    df = analysis_frame(spark, body)
    assert responses.parse_analysis(df).count() == 0
    assert responses.unusable_analyses(df).count() == 1


def landed(spark, run_info, insight_list, cents=10.25, cost=2.0):
    """Landed tables: run 1 resolves, run 2 has no task, run 3 is unknown."""
    summaries = spark.createDataFrame(
        [("12_1_1", [("cl", "app"), ("x", "y")]), ("12_2_2", [])],
        "run_key string, summaries array<struct<clusterUid: string, sparkAppId: string>>",
    )
    analyses = analysis_frame(spark, {"insightsV2": insight_list, "recommendation": "r"})
    annotation = {"cents": cents, "dbuCost": cost, "runInfo": run_info}
    app_summaries = responses.parse_app_summary(analysis_frame(spark, {"annotation": annotation}))
    return summaries, analyses, app_summaries


RUN_INFO = {
    "node_type_id": "n1",
    "driver_node_type_id": "d1",
    "default_tags": {"env": "prod", "team": "t"},
    "custom_tags": {"env": "dev", "owner": "o"},
}


def pull_requests(spark):
    text = " ".join(URL.format(i, i) for i in (1, 2, 3, 1))
    return spark.createDataFrame(
        [(5, text, "abc", "base", "main")],
        "pr_id long, description string, commit_id string, base_branch string, target_branch string",
    )


def files(spark):
    text = "import x\n\ndf = load()\nrows = df.collect()\n"
    return spark.createDataFrame(
        [(5, "abc", "a.py", text), (6, "abc", "b.py", text)],
        "pr_id long, commit_id string, filename string, text string",
    )


def test_review_end_to_end(spark):
    tables = landed(spark, json.dumps(RUN_INFO), [])
    review = review_pull_requests(pull_requests(spark), *tables, files(spark), BASE, brand=BRAND)
    resolved = review.runs.orderBy("pos").collect()
    assert [(r.pos, r.run_key) for r in resolved] == [(0, "12_1_1"), (3, "12_1_1")]
    assert [(r.path, r.line) for r in review.comments.collect()] == [("a.py", 4)]
    missing = missing_runs(pull_requests(spark), tables[0]).orderBy("pos").collect()
    assert [r.run_key for r in missing] == ["12_2_2", "12_3_3"]
    assert review.markdown.count() == review.wiki.count() == 1
    assert review.unlabelled.count() == review.bad_run_info.count() == 0


TABLE = (
    "[app{l}https://m.example.com/#/app/application/spark?execId=app&clusterUid=cl{r} | "
    "[cl{l}https://m.example.com/#/compute/cluster_summary?cluster_uid=cl&app_id=app{r} | "
    '$ 12.25 | n1 | d1 | {{"env":"prod","team":"t"}} | Autoscale is not enabled. |\n'
)
HEADERS = [
    "Spark App",
    "Cluster",
    "Estimated cost",
    "Executor Node Type",
    "Driver Node Type",
    "Tags",
    "Autoscale",
]
RUN_PAGE = "https://m.example.com/#/app/application/db?execId=12_1_1"


def single_run(spark):
    return descriptions(spark, URL.format(1, 1)).select(
        F.lit(5).cast("long").alias("pr_id"),
        "description",
        F.lit("abc").alias("commit_id"),
        F.lit("base").alias("base_branch"),
        F.lit("main").alias("target_branch"),
    )


def test_markdown_golden(spark):
    tables = landed(spark, json.dumps(RUN_INFO), INSIGHTS)
    review = review_pull_requests(single_run(spark), *tables, files(spark), BASE, brand=BRAND)
    expected = (
        "----\n<details>\n<summary> <img src='https://acme.example.com/logo.svg' alt='Logo'> "
        "<b>Workspace Id: 12, Job Id: 1, Run Id: 1</b></summary>\n\n----\n"
        f"#### [Acme url]({RUN_PAGE})\n----\n"
        "App Summary  <sup>*Estimated cost is sum of DBUs and VM Cost</sup>\n----\n"
        f"| {' | '.join(HEADERS)} |\n| {' | '.join(['---'] * 7)} |\n| "
        + TABLE.format(l="](", r=")")
        + "\nAcme Insights\n----\n"
        "| SLA: Insights to make this app meet SLA |\n|---\t|\n| ℹ️ **t** \t|\n"
        "| ⚡ **Details**<br>e\t|\n| 🛠 **Actions**<br>a\t|\n\n"
        "| APPFAILURE: Insights to help with failure analysis |\n|---\t|\n| ℹ️ **None** \t|\n"
        "| ⚡ **Details**<br>e\t|\n| 🛠 **Actions**<br>a\t|\n\n"
        "</details>\n\n"
    )
    assert review.markdown.first().report == expected


def test_wiki_golden(spark):
    listed = [{"categories": {"c": {"instances": [instance("SLA", actions="<ul><li>x</li></ul>")]}}}]
    tables = landed(spark, json.dumps(RUN_INFO), listed)
    review = review_pull_requests(single_run(spark), *tables, files(spark), BASE, brand=BRAND)
    expected = (
        "----\nThis Issue was automatically created by Acme to follow up on the insights generated "
        "for the runs of the jobs mentioned in the description of pr number 5 was raised to merge "
        "abc from base to main\n"
        "----\nWorkspace Id: 12, Job Id: 1, Run Id: 1\n\n----\n"
        f"[Acme URL|{RUN_PAGE}]\n----\nApp Summary\n"
        "*Estimated cost is the sum of DBUs and VM Cost\n----\n\n"
        f"|| {' || '.join(HEADERS)} |\n| "
        + TABLE.format(l="|", r="]")
        + "\nAcme Insights\n----\n\n|| SLA: Insights to make this app meet SLA ||\n"
        "| ℹ️ *t* \t|\n| ⚡ *Details*\ne\t|\n| 🛠 *Actions*\n- x\t|\n\n"
    )
    assert review.wiki.first().report == expected


@pytest.mark.parametrize("any_html", [True, False])
def test_wiki_action_lists(spark, any_html):
    flat = instance("SLA", actions="<ul><li> a <b>b</b></li></ul>")
    hard = instance("SLA", actions="<li>x &amp; y<ul><li>z</li></ul></li>")
    plain = instance("SLA", actions="a &amp; b")
    insight_list = [{"categories": {"c": {"instances": [flat, hard, plain]}}}]
    if not any_html:
        insight_list[0]["categories"]["c"]["instances"].remove(hard)
    tables = landed(spark, json.dumps(RUN_INFO), insight_list)
    resolved = runs.resolve_runs(runs.run_refs_from_text(single_run(spark)), *tables)
    summarised = summary.with_app_summary(resolved, BASE)
    row = reports.wiki_reports(summarised, single_run(spark), BRAND, any_html=any_html).first()
    found = [part.split("\t|")[0] for part in row.report.split("*Actions*\n")[1:]]
    expected = ["- ab", "- x & yz\n- z", "a &amp; b"]
    assert found == (expected if any_html else [expected[0], expected[2]])


@pytest.mark.parametrize(
    "insight_list,heading", [([], False), ([{"categories": None}], True)]
)
def test_heading_needs_an_insight_not_a_card(spark, insight_list, heading):
    tables = landed(spark, json.dumps(RUN_INFO), insight_list)
    review = review_pull_requests(single_run(spark), *tables, files(spark), BASE, brand=BRAND)
    report = review.markdown.first().report
    assert ("Acme Insights" in report) == heading
    assert report.endswith("</details>\n\n")


def test_autoscale_and_custom_tags(spark):
    info = {**RUN_INFO, "autoscale": {"min_workers": 1, "max_workers": 8, "target_workers": 4}}
    tables = landed(spark, json.dumps(info), [], cents=12_000_000.1)
    resolved = runs.resolve_runs(runs.run_refs_from_text(single_run(spark)), *tables)
    row = summary.with_app_summary(resolved, BASE, include_custom_tags=True).first()
    assert json.loads(row.tags) == {"team": "t", "env": "dev", "owner": "o"}
    assert json.loads(row.autoscale) == {
        "autoscale_min_workers": 1,
        "autoscale_max_workers": 8,
        "autoscale_target_workers": 4,
    }
    assert row.estimated_cost == "$ 12000002.10"


def test_malformed_run_info_is_rejected(spark):
    tables = landed(spark, '{"node_type_id"', [])
    resolved = runs.resolve_runs(runs.run_refs_from_text(single_run(spark)), *tables)
    assert summary.with_app_summary(resolved, BASE).count() == 0
    assert summary.bad_run_info(resolved).count() == 1


@pytest.mark.parametrize("part_chars,positions_per_step", [(10**6, 10**6), (50, 10**6), (50, 7), (10**6, 7)])
def test_parts_concatenate_to_the_report(spark, part_chars, positions_per_step):
    rows = [(1, pos, f"block {pos};" * (pos % 4 + 1)) for pos in range(-1, 60)]
    rows += [(2, 3, "single")]
    blocks = spark.createDataFrame(rows, "pr_id long, pos int, block string").repartition(5)
    parts = assemble_reports(blocks, part_chars=part_chars, positions_per_step=positions_per_step)
    whole = {}
    for row in sorted(parts.collect(), key=lambda row: (row.pr_id, row.from_pos)):
        longest = max(len(block) for _, _, block in rows)
        assert len(row.report) < part_chars + longest
        whole[row.pr_id] = whole.get(row.pr_id, "") + row.report
    assert whole == {1: "".join(block for _, _, block in rows[:-1]), 2: "single"}


def test_report_text_is_shuffled_once(spark):
    blocks = spark.createDataFrame([(1, 1, "x")], "pr_id long, pos int, block string")
    assert plan_of(assemble_reports(blocks)).count("Exchange hashpartitioning") == 1


def test_reviewers_and_notification(spark):
    rows = [(1, [("ann",), ("bo",)]), (2, None)]
    prs = spark.createDataFrame(rows, "pr_id long, requested_reviewers array<struct<login: string>>")
    logins = reports.reviewer_logins(prs)
    assert [row.logins for row in logins.orderBy("pr_id").collect()] == [["ann", "bo"], []]
    named = logins
    for name in ("commit_id", "base_branch", "target_branch", "pr_url", "ticket_url"):
        named = named.withColumn(name, F.lit(name[0]))
    messages = [row.message for row in reports.notifications(named, BRAND).orderBy("pr_id").collect()]
    assert messages[0] == (
        "Acme has insights for the pr number 1 which was raised to merge c from b to t. Click this "
        "link for further details p, alos a jira has been raised please find the jira link t @ann @bo"
    )
    assert messages[1].endswith("link t ")


def test_hot_run_is_split_by_adaptive_execution(spark):
    """A third of all mentions name one run: its partition is split in both joins."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        n = F.col("id")
        run = F.when(n % 3 == 0, F.lit(0)).otherwise(n).cast("string")
        refs = spark.range(0, 60_000, numPartitions=8).select(
            n.alias("pr_id"),
            F.lit(0).alias("pos"),
            F.lit("1").alias("workspace_id"),
            F.lit("2").alias("job_id"),
            run.alias("run_id"),
            # Text that does not compress: AQE goes by the bytes on disk.
            F.sha2(n.cast("string"), 512).alias("note"),
        )
        keys = spark.range(60_000).select(F.col("id").cast("string").alias("r"))
        cluster, app = F.concat(F.lit("cl"), "r"), F.concat(F.lit("app"), "r")
        summaries = keys.select(
            F.concat_ws("_", F.lit("1"), F.lit("2"), "r").alias("run_key"),
            F.array(F.struct(cluster.alias("clusterUid"), app.alias("sparkAppId"))).alias("summaries"),
        )
        apps = keys.select(cluster.alias("clusterUid"), app.alias("sparkAppId"))
        analyses = apps.withColumn("body", F.lit('{"insightsV2": [], "recommendation": "r"}'))
        annotations = apps.withColumn("annotation", F.struct(F.lit(1.0).alias("cents")))
        resolved = runs.resolve_runs(refs, summaries, analyses, annotations)
        assert resolved.count() == 60_000
        counted = resolved.agg(F.count("annotation"), F.count("insights"), F.max("note"))
        assert tuple(counted.collect()[0])[:2] == (60_000, 60_000)
        assert plan_of(counted).count("SortMergeJoin(skew=true)") >= 3
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_every_reference_is_resolved_or_rejected(spark):
    prs = descriptions(spark, " ".join(URL.format(n, n) for n in range(7)))
    refs = runs.run_refs_from_text(prs)
    keys = [f"12_{n}_{n}" for n in range(7)]
    task = '[{"clusterUid": "c%d", "sparkAppId": "a"}]'
    bodies = [task % 0, '{"message": "INVALID_TOKEN"}', '[{"clusterUid": null, "sparkAppId": "a"}]', "[]", task % 4, task % 5, task % 6]
    tasks = spark.createDataFrame(list(zip(keys, bodies)), "run_key string, body string")
    analyses = spark.createDataFrame(
        [(f"c{n}", "a", '{"insightsV2": []}') for n in (0, 5, 6)], "clusterUid string, sparkAppId string, body string"
    )
    info = '{"node_type_id": "n", "driver_node_type_id": "d", "default_tags": {}}'
    full = json.dumps({"annotation": {"cents": 1.0, "dbuCost": 2.0, "runInfo": info}})
    no_cost = json.dumps({"annotation": {"cents": 1.0, "runInfo": info}})
    apps = spark.createDataFrame(
        [("c0", "a", full), ("c6", "a", no_cost)], "clusterUid string, sparkAppId string, body string"
    )
    landed_tables = (
        responses.parse_task_summaries(tasks), responses.accepted(analyses), responses.parse_app_summary(apps)
    )
    rejects = {row.pos: row.reason for row in runs.run_rejects(refs, *landed_tables).collect()}
    assert rejects == {
        1: "no task summary",
        2: "no task summary",
        3: "no task summary",
        4: "no analysis",
        5: "no app summary",
        6: "unusable app summary",
    }
    resolved = runs.resolve_runs(refs, *landed_tables)
    shown = summary.with_app_summary(resolved, BASE)
    assert [row.pos for row in shown.collect()] == [0]
    assert [row.pos for row in summary.bad_run_info(resolved).collect()] == [6]
    assert shown.count() + len(rejects) == refs.count()


def test_instances_without_key_are_not_lost(spark):
    body = json.dumps({"insightsV2": [{"categories": {"x": {"instances": [instance("efficiency"), instance(None)]}}}]})
    usable = responses.parse_analysis(analysis_frame(spark, body))
    assert [row.key for row in insights.unlabelled_insights(usable).collect()] == [None]
    with pytest.raises(PySparkException, match="unknown insight key: none"):
        usable.select(insights.shown_instances(F.col("insights"), strict=True)).collect()


def test_latest_response_per_key(spark):
    rows = [("k", "2024-01-01", "old"), ("k", "2024-01-02", "b"), ("k", "2024-01-02", "c"), ("l", None, "d")]
    landed_twice = spark.createDataFrame(rows, "run_key string, landed_at string, body string")
    kept = runs.latest_responses(landed_twice, ["run_key"], "landed_at").orderBy("run_key").collect()
    assert [(row.run_key, row.body) for row in kept] == [("k", "c"), ("l", "d")]


def test_page_numbers_do_not_depend_on_the_steps(spark):
    rows = [(pr, pos, "x" * (pos * 7 % 50 + (900 if pos == 20 else 0))) for pr in (1, 2) for pos in range(-1, 120)]
    blocks = spark.createDataFrame([*rows, (3, 0, "one")], "pr_id long, pos int, block string").repartition(6)
    found = []
    for step in (1, 13, 10_000):
        parts = assemble_reports(blocks, part_chars=200, positions_per_step=step)
        found.append(sorted(tuple(row) for row in parts.collect()))
    assert found[0] == found[1] == found[2]
    for pr in (1, 2, 3):
        numbers = [(part, n) for pr_id, part, n, _, _ in found[0] if pr_id == pr]
        assert numbers == [(i, len(numbers)) for i in range(len(numbers))]


def test_reviewers_from_landed_bodies(spark):
    bodies = ['{"requested_reviewers": [{"login": "ann", "id": 1}], "x": 2}', '{"message": "Not Found"}', '{"requested_r', None]
    prs = spark.createDataFrame([(i, b, "c") for i, b in enumerate(bodies)], "pr_id long, body string, commit_id string")
    rows = reports.reviewer_logins(reports.parse_pull_requests(prs)).orderBy("pr_id").collect()
    assert [(r.commit_id, r.logins) for r in rows] == [("c", ["ann"]), ("c", []), ("c", []), ("c", [])]


def landed_bodies(spark):
    """Run 1 has an older answer and a later refusal; run 2 was refused; 5,000
    bodies belong to no run."""
    task = '[{"clusterUid": "cl", "sparkAppId": "app"}]'
    summaries = [("12_1_1", task, 1), ("12_1_1", '{"message": "INVALID_TOKEN"}', 2), ("12_2_2", '{"message": "INVALID_TOKEN"}', 1)]
    analyses = [("cl", "app", json.dumps({"insightsV2": [], "recommendation": r}), at) for r, at in (("old", 1), ("new", 2))]
    others = [(f"cl{i}", "app", analyses[0][2], 1) for i in range(5_000)]
    apps = [("cl", "app", json.dumps({"annotation": {"cents": 1.0, "dbuCost": 2.0, "runInfo": json.dumps(RUN_INFO)}}), 1)]
    key = "clusterUid string, sparkAppId string, body string, landed_at int"
    return (
        spark.createDataFrame(summaries, "run_key string, body string, landed_at int"),
        spark.createDataFrame(analyses + others, key),
        spark.createDataFrame(apps + [apps[0]], key),
    )


def test_review_of_landed_bodies(spark):
    tables = landed_bodies(spark)
    review = review_landed(pull_requests(spark), *tables, files(spark), BASE, landed_at="landed_at", brand=BRAND)
    assert [(r.pos, r.recommendation) for r in review.runs.orderBy("pos").collect()] == [(0, "new"), (3, "new")]
    assert review.markdown.count() == 1 and review.comments.count() == 1
    assert [(r.pos, r.reason) for r in review.rejects.orderBy("pos").collect()] == [(1, "no task summary"), (2, "no task summary")]
    assert sorted(r.response_key for r in review.refused.collect()) == ["12_1_1", "12_2_2"]
    again = review_landed(pull_requests(spark), *[t.drop("landed_at") for t in tables], files(spark), BASE, brand=BRAND)
    assert {r.recommendation for r in again.runs.collect()} == {"old"}, "without a time the greatest body"


def test_only_named_bodies_are_looked_into(spark):
    analyses = landed_bodies(spark)[1]
    apps = spark.createDataFrame([("cl", "app"), ("cl7", "app")], "clusterUid string, sparkAppId string")
    named = runs.named_responses(analyses, apps, runs.APP_KEY, "landed_at")
    assert {"cl", "cl7"} <= {r.clusterUid for r in named.collect()}
    assert named.count() <= 2 + 0.02 * 5_000


def test_review_refuses_error_payloads(spark):
    summaries, analyses, app_summaries = landed(spark, json.dumps(RUN_INFO), [])
    bad = analysis_frame(spark, '{"message": "INVALID_TOKEN"}')
    review = review_pull_requests(pull_requests(spark), summaries, analyses.unionByName(bad), app_summaries, files(spark), BASE)
    assert review.runs.count() == 2 and review.refused.count() == 1
    assert [r.reason for r in review.rejects.orderBy("pos").collect()] == ["no task summary"] * 2


def test_landing_splits_in_one_scan(spark, tmp_path):
    lines = ['{"k": "1", "response": {"a": [1, 2]}}', '{"k": "2", "response": {"message": "INVALID_TOKEN"}}', '{"k": "3", "resp', '{"k": "4"}', "", '{"response": []}']
    (tmp_path / "one.json").write_text("\n".join(lines) + "\n")
    rows = {r.body: r for r in responses.landed_bodies(spark, str(tmp_path), ["k"]).collect()}
    good = next(r for body, r in rows.items() if json.loads(body if body.endswith("}") else "0") == {"a": [1, 2]})
    assert good.state == "accepted" and good.k == "1" and good.landed_at is not None
    assert rows['{"k": "3", "resp'].state == "malformed"
    assert sorted(r.state for r in rows.values()) == ["accepted", "malformed", "malformed", "malformed", "refused"]
    assert plan_of(responses.landed_bodies(spark, str(tmp_path), ["k"])).count("Scan") == 1


def test_ids_of_a_reference_are_read_by_one_pattern(spark):
    refs = runs.run_refs_from_text(descriptions(spark, URL.format(1, 2)))
    assert "regexp_extract(" not in plan_of(refs)


def test_flat_lists_need_no_parser_and_small_reports_no_second_shuffle(spark, monkeypatch):
    plans = {}

    def kept(df, purpose):
        plans.setdefault(purpose, []).append(plan_of(df))
        return staged(df, purpose)

    monkeypatch.setattr(reports, "staged", kept)
    flat = [{"categories": {"c": {"instances": [instance("SLA", actions="<ul><li>a</li></ul>")]}}}]
    resolved = runs.resolve_runs(runs.run_refs_from_text(single_run(spark)), *landed(spark, json.dumps(RUN_INFO), flat))
    summarised = summary.with_app_summary(resolved, BASE)
    assert "- a\t|" in reports.wiki_reports(summarised, single_run(spark), BRAND).first().report
    assert not any("ArrowEvalPython" in plan for stored in plans.values() for plan in stored)
    # The preambles are looked up once; sizes meet the large reports by a broadcast.
    assert len(plans["report-blocks"]) == 1
    assert "large-reports" in plans and "BroadcastHashJoin" in plans["report-parts"][0]

"""Job inputs derived from the star-schema tables, row by row.

Each function adds columns to one scan and nothing else: no join, no grouping,
no driver-side rows. The SQL side of a query derives the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSIGHT_KEYS = ("efficiency", "appFailure", "Bottlenecks", "SLA", "SparkAppTimeReport")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def landed(df: DataFrame) -> DataFrame:
    """The same rows with every column computed once, as if read from a table.

    Spark would otherwise repeat the expression behind a column wherever the
    column is used. It does not look through a generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def as_payloads(events: DataFrame, ts: Column | None = None) -> DataFrame:
    """Event rows in the nested layout; works on a stream as well."""
    user, number = F.col("user_id"), F.col("event_id")
    payload = F.struct(
        F.when(number % 97 != 0, _text("user_id")).alias("customer_id"),
        _text("event_id").alias("event_id"),
        F.col("event_type"),
        (F.col("ts").cast("timestamp") if ts is None else ts).alias("event_ts"),
        F.when(
            number % 5 != 0, F.concat(F.lit("user"), _text("user_id"), F.lit("@example.com"))
        ).alias("email"),
        F.when(user % 3 == 0, "gold").when(user % 3 == 1, "silver").alias("loyalty_tier"),
        F.concat(F.lit("C"), (user % 25).cast("string")).alias("country"),
        F.col("props").alias("preferences"),
        F.concat(F.lit('{"value":'), _text("value"), F.lit("}")).alias("attributes"),
    )
    return events.select(payload.alias("payload"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_payloads(table(spark, sf_dir, "events"))


def twice(df: DataFrame) -> DataFrame:
    """Every row two times."""
    return df.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "customer").select(
        _text("c_custkey").alias("customer_id"),
        (F.col("c_custkey") % 10 != 0).alias("is_current"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("lifetime_value"),
        (start + F.make_dt_interval(secs=F.col("c_custkey"))).alias("last_profile_update_ts"),
    )


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = k % 8
    names = (
        F.when(kind == 0, F.array(F.lit("Scan"), F.lit("BroadcastHashJoin")))
        .when(kind == 1, F.array(F.lit("BatchEvalPython")))
        .when(kind.isin(2, 5), F.array(F.lit("Project")))
        .when(kind == 3, F.array(F.lit("Scan"), F.lit("Aggregate")))
        .when(kind == 4, F.array(F.lit("PhotonParquetWriter")))
        .when(kind == 6, F.array(F.lit("Union"), F.lit("PhotonParquetWriter")))
        .otherwise(F.array().cast("array<string>"))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("query_id"),
        F.col("o_orderpriority").alias("environment"),
        (k * 7919 % 3_000_000).alias("rows_read"),
        (k * 104_729 % 12_000_000).alias("rows_written"),
        (k * 37 % 4096).cast("double").alias("bytes_read_mb"),
        (k * 53 % 2300).cast("double").alias("bytes_written_mb"),
        (k * 101 % 2000).cast("double").alias("total_duration_seconds"),
        names.alias("operator_names"),
    )


def run_url(workspace: Column, job: Column, run: Column) -> Column:
    return F.concat(
        F.lit("https://adb-"),
        workspace.cast("string"),
        F.lit(".7.azuredatabricks.net/?o="),
        workspace.cast("string"),
        F.lit("#job/"),
        job.cast("string"),
        F.lit("/run/"),
        run.cast("string"),
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pull request per order: two run URLs, a third hidden in a tag."""
    k, workspace = F.col("o_orderkey"), F.col("o_custkey")
    first = run_url(workspace, k, k * 10)
    hidden = run_url(workspace, k, F.lit(99))
    second = run_url(workspace, k + 1, F.lit(5))
    description = F.concat(
        F.lit("Fix <b>job</b>\n"),
        first,
        F.lit("\r\n<"),
        hidden,
        F.lit("> "),
        second,
        F.lit("<br>"),
    )
    return landed(
        table(spark, sf_dir, "orders").select(
            k.alias("pr_id"),
            description.alias("description"),
            F.array(first, F.concat(first, F.lit("/x")), F.concat(F.lit("see "), first), second).alias(
                "runs"
            ),
            F.concat(F.lit("c"), k.cast("string")).alias("commit_id"),
            F.concat(F.lit("base-"), F.col("o_orderstatus")).alias("base_branch"),
            F.lit("main").alias("target_branch"),
            F.concat(F.lit("https://git.example.com/pr/"), k.cast("string")).alias("pr_url"),
            F.concat(F.lit("https://tickets.example.com/"), k.cast("string")).alias("ticket_url"),
        )
    )


def task_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed bodies by run key: absent or empty for some first runs."""
    k, workspace = F.col("o_orderkey"), F.col("o_custkey")
    task = F.struct(
        F.concat(F.lit("cl-"), k.cast("string")).alias("clusterUid"),
        F.concat(F.lit("app-"), k.cast("string")).alias("sparkAppId"),
    )
    other = F.struct(F.lit("cl-x").alias("clusterUid"), F.lit("app-x").alias("sparkAppId"))
    first = F.struct(
        F.concat_ws("_", workspace, k, k * 10).alias("run_key"),
        F.when(k % 7 == 0, "[]").otherwise(F.to_json(F.array(task, other))).alias("body"),
    )
    second = F.struct(
        F.concat_ws("_", workspace, k + 1, F.lit(5)).alias("run_key"),
        F.to_json(F.array(task)).alias("body"),
    )
    landed = F.when(k % 11 == 0, F.array(second)).otherwise(F.array(first, second))
    return table(spark, sf_dir, "orders").select(F.inline(landed))


def _instance(key: Column, title: str, actions: Column) -> Column:
    return F.struct(
        key.alias("key"),
        F.concat(F.lit("order "), _text("o_orderkey"), F.lit(f" {title}")).alias("title"),
        F.col("o_orderpriority").alias("events"),
        actions.alias("actions"),
    )


def _insight_key(number: Column) -> Column:
    return F.element_at(
        F.array(*[F.lit(key) for key in INSIGHT_KEYS]), (number % len(INSIGHT_KEYS) + 1).cast("int")
    )


def _categories(*pairs: tuple[Column, Column]) -> Column:
    flat = []
    for name, instances in pairs:
        flat += [name, F.struct(instances.alias("instances"))]
    return F.struct(F.create_map(*flat).alias("categories"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed analysis bodies, with empty, malformed and refused ones."""
    k = F.col("o_orderkey")
    listed = F.concat(
        F.lit("<ul><li> Use <b>cache</b> </li><li>Fix "), k.cast("string"), F.lit("</li></ul>")
    )
    actions = F.when(k % 3 == 0, listed).otherwise(
        F.concat(F.lit("See "), F.col("o_orderpriority"))
    )
    second_key = F.when(k % 29 == 0, "Unknown").otherwise(_insight_key(k + 1))
    instances = F.array(
        _instance(_insight_key(k), "a", actions), _instance(second_key, "b", actions)
    )
    main = _categories(
        (F.col("o_orderstatus"), instances), (F.lit("none"), F.filter(instances, lambda _: F.lit(False)))
    )
    empty = F.struct(F.lit(None).cast(_categories_type()).alias("categories"))
    late = _categories((F.lit("late"), F.array(_instance(_insight_key(k + 2), "c", actions))))
    insights = F.when(k % 2 == 0, F.array(main, empty, late)).otherwise(F.array(main, empty))
    insights = F.when(k % 23 != 0, insights).otherwise(F.filter(insights, lambda _: F.lit(False)))
    good = F.to_json(F.struct(insights.alias("insightsV2"), F.lit("tune").alias("recommendation")))
    body = (
        F.when(k % 13 == 0, "{}")
        .when(k % 17 == 0, '{"insightsV2": [{"categories"')
        .when(k % 19 == 0, '{"message": "INVALID_TOKEN"}')
        .otherwise(good)
    )
    return landed(
        table(spark, sf_dir, "orders").select(
            F.concat(F.lit("cl-"), k.cast("string")).alias("clusterUid"),
            F.concat(F.lit("app-"), k.cast("string")).alias("sparkAppId"),
            body.alias("body"),
        )
    )


def _categories_type() -> str:
    instance = "struct<key:string,title:string,events:string,actions:string>"
    return f"map<string,struct<instances:array<{instance}>>>"


def app_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed application summaries, with some malformed embedded texts."""
    k = F.col("o_orderkey")
    info = F.struct(
        F.concat(F.lit("node-"), F.col("o_orderstatus")).alias("node_type_id"),
        F.concat(F.lit("driver-"), (F.col("o_custkey") % 10).cast("string")).alias(
            "driver_node_type_id"
        ),
        F.create_map(
            F.lit("team"),
            F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string")),
            F.lit("env"),
            F.lit("prod"),
        ).alias("default_tags"),
        F.when(
            k % 3 == 0,
            F.create_map(F.lit("env"), F.lit("dev"), F.lit("owner"), F.col("o_orderpriority")),
        ).alias("custom_tags"),
        F.when(
            k % 2 == 0,
            F.struct(
                F.lit(1).alias("min_workers"),
                (k % 10 + 1).alias("max_workers"),
                (k % 5 + 1).alias("target_workers"),
            ),
        ).alias("autoscale"),
    )
    annotation = F.struct(
        F.col("o_totalprice").alias("cents"),
        F.col("o_custkey").cast("double").alias("dbuCost"),
        F.when(k % 31 == 0, '{"node_type_id"').otherwise(F.to_json(info)).alias("runInfo"),
    )
    return landed(
        table(spark, sf_dir, "orders").select(
            F.concat(F.lit("cl-"), k.cast("string")).alias("clusterUid"),
            F.concat(F.lit("app-"), k.cast("string")).alias("sparkAppId"),
            F.to_json(F.struct(annotation.alias("annotation"))).alias("body"),
        )
    )


def line_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis body per order line."""
    line = F.col("l_linenumber")
    key = _insight_key(line)
    listed = F.concat(F.lit("<ul><li>Check "), line.cast("string"), F.lit("</li></ul>"))
    instance = F.struct(
        key.alias("key"),
        F.concat(F.lit("line "), line.cast("string")).alias("title"),
        F.col("l_linestatus").alias("events"),
        F.when(F.col("l_returnflag") == "N", listed).otherwise("plain").alias("actions"),
    )
    insight = _categories((F.col("l_returnflag"), F.array(instance)))
    return landed(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            F.to_json(F.struct(F.array(insight).alias("insightsV2"))).alias("body"),
        )
    )


def relanded(answers: DataFrame, keys: list[str], older: str, key_of_none: str) -> DataFrame:
    """An appended table: every body landed at 2, an older one at 1, and another
    at 2 under a key that no run leads to."""
    now = answers.select(*keys, "body", F.lit(2).alias("landed_at"))
    before = answers.select(*keys, F.lit(older).alias("body"), F.lit(1).alias("landed_at"))
    foreign = [F.concat(F.lit(key_of_none), name).alias(name) for name in keys]
    return now.unionByName(before).unionByName(answers.select(*foreign, "body", F.lit(2).alias("landed_at")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 50).alias("pr_id"),
        F.concat(F.lit("c"), (F.col("doc_id") % 50).cast("string")).alias("commit_id"),
        F.concat(F.lit("doc_"), _text("doc_id")).alias("filename"),
        F.col("text"),
    )


def reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pull requests, one per customer, each with two or no reviewers, and
    some bodies that name none because the request failed or was cut off."""
    requested = F.array(
        F.struct(F.col("c_name").alias("login")), F.struct(F.col("c_mktsegment").alias("login"))
    )
    key = F.col("c_custkey")
    none = F.lit(None).cast("array<struct<login:string>>")
    body = F.to_json(
        F.struct(
            key.alias("number"),
            F.when(key % 4 != 0, requested).otherwise(none).alias("requested_reviewers"),
        )
    )
    body = (
        F.when(key % 8 == 0, '{"message": "Not Found"}')
        .when(key % 12 == 0, '{"requested_reviewers": [{"login"')
        .otherwise(body)
    )
    return landed(
        table(spark, sf_dir, "customer").select(
            key.alias("pr_id"),
            body.alias("body"),
            F.concat(F.lit("c"), key.cast("string")).alias("commit_id"),
            F.lit("dev").alias("base_branch"),
            F.lit("main").alias("target_branch"),
            F.concat(F.lit("https://git.example.com/pr/"), key.cast("string")).alias("pr_url"),
            F.concat(F.lit("https://tickets.example.com/"), key.cast("string")).alias("ticket_url"),
        )
    )

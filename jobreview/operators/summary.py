"""Application summary of a resolved run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.functions.templates import fill, shown
from jobreview.sources.schemas import RUN_INFO

# Page addresses below the service's base URL, and texts.
RUN_PAGE = "{base}/#/app/application/db?execId={run_key}"
APP_PAGE = "{base}/#/app/application/spark?execId={app}&clusterUid={cluster}"
CLUSTER_PAGE = "{base}/#/compute/cluster_summary?cluster_uid={cluster}&app_id={app}"
MARKDOWN_LINK = "[{text}]({url})"
WIKI_LINK = "[{text}|{url}]"
NO_AUTOSCALE = "Autoscale is not enabled."
SUMMARY_HEADERS = (
    "Spark App",
    "Cluster",
    "Estimated cost",
    "Executor Node Type",
    "Driver Node Type",
    "Tags",
    "Autoscale",
)
COST_TYPE = "decimal(18,2)"


def run_page(base_url: str, run_key: Column) -> Column:
    return fill(RUN_PAGE, base=base_url, run_key=run_key)


def estimated_cost(annotation: Column) -> Column:
    """``$`` and the sum of both cost fields, in the unit they come in."""
    total = annotation["cents"] + annotation["dbuCost"]
    return F.concat(F.lit("$ "), shown(total.cast(COST_TYPE)))


def merged_tags(run_info: Column, include_custom_tags: bool) -> Column:
    """Default tags as JSON text; custom tags win where they are asked for."""
    defaults, custom = run_info["default_tags"], run_info["custom_tags"]
    if not include_custom_tags:
        return F.to_json(defaults)
    own = F.map_filter(defaults, lambda name, _: ~F.map_contains_key(custom, name))
    return F.to_json(F.when(custom.isNull(), defaults).otherwise(F.map_concat(own, custom)))


def autoscale_text(run_info: Column) -> Column:
    """Worker bounds as JSON text, or the sentence that there are none."""
    scale = run_info["autoscale"]
    bounds = F.struct(
        *[
            scale[name].alias(f"autoscale_{name}")
            for name in ("min_workers", "max_workers", "target_workers")
        ]
    )
    return F.when(scale.isNotNull(), F.to_json(bounds)).otherwise(F.lit(NO_AUTOSCALE))


def usable_annotation(annotation: Column) -> Column:
    """True if the run info parses and both cost fields are there."""
    parsed = F.from_json(annotation["runInfo"], RUN_INFO)
    return (
        parsed["node_type_id"].isNotNull()
        & annotation["cents"].isNotNull()
        & annotation["dbuCost"].isNotNull()
    )


def with_run_info(runs: DataFrame) -> DataFrame:
    """Adds the parsed ``run_info``; rows whose text does not parse go, and so
    do rows without both cost fields.

    Malformed text parses to a struct of NULLs; the node type, always there in
    a good one, tells. Testing inside the generator parses each text once: a
    plain filter would be pushed below the parse and repeat it.
    """
    parsed = F.from_json(F.col("annotation.runInfo"), RUN_INFO)
    cost = F.col("annotation.cents").isNotNull() & F.col("annotation.dbuCost").isNotNull()
    usable = F.filter(F.array(parsed), lambda info: info["node_type_id"].isNotNull() & cost)
    return runs.select("*", F.explode(usable).alias("run_info"))


def bad_run_info(runs: DataFrame) -> DataFrame:
    """The rows ``with_run_info`` leaves out, for a reject table."""
    return runs.filter(~F.coalesce(usable_annotation(F.col("annotation")), F.lit(False)))


def with_app_summary(
    runs: DataFrame, base_url: str, *, include_custom_tags: bool = False
) -> DataFrame:
    """Adds links, cost, node types, tags and autoscale as text columns."""
    informed = with_run_info(runs)
    cluster, app, info = F.col("clusterUid"), F.col("sparkAppId"), F.col("run_info")
    return informed.select(
        *runs.columns,
        run_page(base_url, F.col("run_key")).alias("run_page"),
        fill(APP_PAGE, base=base_url, app=app, cluster=cluster).alias("app_page"),
        fill(CLUSTER_PAGE, base=base_url, app=app, cluster=cluster).alias("cluster_page"),
        estimated_cost(F.col("annotation")).alias("estimated_cost"),
        info["node_type_id"].alias("executor_node_type"),
        info["driver_node_type_id"].alias("driver_node_type"),
        merged_tags(info, include_custom_tags).alias("tags"),
        autoscale_text(info).alias("autoscale"),
    )


def summary_fields(link: str) -> list[tuple[str, Column]]:
    """Ordered names and values of the summary, links in the given form."""
    values = (
        fill(link, text=F.col("sparkAppId"), url=F.col("app_page")),
        fill(link, text=F.col("clusterUid"), url=F.col("cluster_page")),
        F.col("estimated_cost"),
        F.col("executor_node_type"),
        F.col("driver_node_type"),
        F.col("tags"),
        F.col("autoscale"),
    )
    return list(zip(SUMMARY_HEADERS, values))

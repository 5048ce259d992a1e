"""Insights: flattening, filtering and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label per insight key, and the key that is never shown.
LABELS = {
    "efficiency": "Insights to make this app resource/cost efficient",
    "appFailure": "Insights to help with failure analysis",
    "Bottlenecks": "Insights to make this app faster",
    "SLA": "Insights to make this app meet SLA",
}
REPORT_KEY = "SPARKAPPTIMEREPORT"


def label_of(key: Column) -> Column:
    """Label of an insight key, case-sensitive; NULL for an unknown key."""
    labels = F.create_map(*[F.lit(text) for text in chain.from_iterable(LABELS.items())])
    return F.try_element_at(labels, key)


def is_shown(key: Column) -> Column:
    """True unless the key, in any case, is the report key; also for no key."""
    return F.coalesce(F.upper(key) != REPORT_KEY, F.lit(True))


def insight_rows(runs: DataFrame, insights: str = "insights") -> DataFrame:
    """One row per instance, with its position on each of the three levels.

    NULL and empty levels give no row. The label is NULL for an unknown key.
    """
    kept = [name for name in runs.columns if name != insights]
    by_insight = runs.select(*kept, F.posexplode(insights).alias("insight_pos", "_insight"))
    by_category = by_insight.select(
        *kept,
        "insight_pos",
        F.posexplode("_insight.categories").alias("category_pos", "category", "_category"),
    )
    by_instance = by_category.select(
        *kept,
        "insight_pos",
        "category_pos",
        "category",
        F.posexplode("_category.instances").alias("instance_pos", "_instance"),
    )
    return by_instance.filter(is_shown(F.col("_instance.key"))).select(
        *kept,
        "insight_pos",
        "category_pos",
        "category",
        "instance_pos",
        "_instance.*",
        label_of(F.col("_instance.key")).alias("label"),
    )


def unlabelled_insights(runs: DataFrame, insights: str = "insights") -> DataFrame:
    """Instances with an unknown key or none, for a reject table."""
    return insight_rows(runs, insights).filter(F.col("label").isNull())


def shown_instances(insights: Column, *, strict: bool = False) -> Column:
    """The same instances in order as one array, for text built row by row.

    All of a run's insights sit in one response body, so no grouping is needed.
    Instances with an unknown key are left to ``unlabelled_insights``, or fail
    the query if ``strict``.
    """
    mapped = F.filter(insights, lambda insight: insight["categories"].isNotNull())
    categories = F.flatten(F.transform(mapped, lambda insight: F.map_values(insight["categories"])))
    filled = F.filter(categories, lambda category: category["instances"].isNotNull())
    instances = F.flatten(F.transform(filled, lambda category: category["instances"]))

    def labelled(instance: Column) -> Column:
        label = label_of(instance["key"])
        if strict:
            key = F.coalesce(instance["key"], F.lit("none"))
            unknown = F.concat(F.lit("unknown insight key: "), key)
            label = F.coalesce(label, F.raise_error(unknown))
        return F.struct(
            F.upper(instance["key"]).alias("key"),
            label.alias("label"),
            *[instance[name].alias(name) for name in ("title", "events", "actions")],
        )

    if strict:
        return F.transform(F.filter(instances, lambda instance: is_shown(instance["key"])), labelled)
    # The report key has no label, so that the known keys are all shown.
    return F.transform(F.filter(instances, lambda instance: instance["key"].isin(*LABELS)), labelled)

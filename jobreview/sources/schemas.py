"""Explicit schemas of the inputs.

File streams and ``from_json`` need them, and an explicit schema lets the scan
read only the fields a query uses.
"""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_PAYLOAD = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("email", T.StringType()),
        T.StructField("loyalty_tier", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("preferences", T.StringType()),
        T.StructField("attributes", T.StringType()),
    ]
)
EVENTS = T.StructType([T.StructField("payload", EVENT_PAYLOAD)])

PROFILE = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("is_current", T.BooleanType()),
        T.StructField("segment", T.StringType()),
        T.StructField("lifetime_value", T.DoubleType()),
        T.StructField("last_profile_update_ts", T.TimestampType()),
    ]
)

KPI = T.StructType(
    [
        T.StructField("environment", T.StringType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("bytes_read_mb", T.DoubleType()),
        T.StructField("bytes_written_mb", T.DoubleType()),
        T.StructField("total_duration_seconds", T.DoubleType()),
        T.StructField("operator_names", T.ArrayType(T.StringType())),
    ]
)

TASK_SUMMARIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("clusterUid", T.StringType()),
            T.StructField("sparkAppId", T.StringType()),
        ]
    )
)

INSTANCE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("events", T.StringType()),
        T.StructField("actions", T.StringType()),
    ]
)
INSIGHTS = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "categories",
                T.MapType(
                    T.StringType(),
                    T.StructType([T.StructField("instances", T.ArrayType(INSTANCE))]),
                ),
            )
        ]
    )
)
ANALYSIS = T.StructType(
    [
        T.StructField("insightsV2", INSIGHTS),
        T.StructField("recommendation", T.StringType()),
    ]
)

APP_SUMMARY = T.StructType(
    [
        T.StructField(
            "annotation",
            T.StructType(
                [
                    T.StructField("cents", T.DoubleType()),
                    T.StructField("dbuCost", T.DoubleType()),
                    T.StructField("runInfo", T.StringType()),
                ]
            ),
        )
    ]
)

RUN_INFO = T.StructType(
    [
        T.StructField("node_type_id", T.StringType()),
        T.StructField("driver_node_type_id", T.StringType()),
        T.StructField("default_tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("custom_tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "autoscale",
            T.StructType(
                [
                    T.StructField("min_workers", T.LongType()),
                    T.StructField("max_workers", T.LongType()),
                    T.StructField("target_workers", T.LongType()),
                ]
            ),
        ),
    ]
)

PULL_REQUEST = T.StructType(
    [
        T.StructField(
            "requested_reviewers",
            T.ArrayType(T.StructType([T.StructField("login", T.StringType())])),
        )
    ]
)

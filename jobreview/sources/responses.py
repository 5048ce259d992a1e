"""Service responses that were landed as JSON, read as tables.

A response body stays a string until its key is known to be wanted; it is parsed
before the joins, which then move only the fields used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.sources import schemas

MALFORMED = "_malformed"
# Fixed value: the message of a response to a request with a bad token.
INVALID_TOKEN = "INVALID_TOKEN"


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under ``path`` with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path)


def landed_bodies(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Landed responses below ``path`` in one scan: ``keys``, ``body``,
    ``landed_at``, ``state``.

    A line is an object with the keys of a request and its ``response``, any JSON,
    which is kept as text. ``landed_at`` is the time of the file. A line is
    ``accepted``, ``refused`` (an error payload) or ``malformed`` (no JSON, or
    without a key or a response). A malformed line has NULL keys, and as ``body`` the
    line, or the response if that is all it had.
    """
    names = [*keys, "response", MALFORMED]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", MALFORMED)
    lines = reader.json(path).select(*names, F.col("_metadata.file_modification_time").alias("landed_at"))
    incomplete = reduce(or_, [F.col(name).isNull() for name in [*keys, "response"]])
    state = (
        F.when(F.col(MALFORMED).isNotNull() | incomplete, "malformed")
        .when(is_error_payload(F.col("response")), "refused")
        .otherwise("accepted")
    )
    known = [F.when(state != "malformed", F.col(name)).alias(name) for name in keys]
    return lines.select(*known, F.coalesce(MALFORMED, "response").alias("body"), "landed_at", state.alias("state"))


def is_error_payload(body: Column) -> Column:
    """True for a body whose top-level ``message`` is the bad-token message.

    Only a body that holds the word, or escapes it might be spelled with, is
    parsed.
    """
    worth_parsing = body.contains(INVALID_TOKEN) | body.contains("\\u")
    message = F.get_json_object(body, "$.message")
    return F.coalesce(worth_parsing & (message == F.lit(INVALID_TOKEN)), F.lit(False))


def accepted(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses that are not error payloads."""
    return responses.filter(~is_error_payload(F.col(body)))


def rejected(responses: DataFrame, body: str = "body") -> DataFrame:
    """Error payloads, for a reject table."""
    return responses.filter(is_error_payload(F.col(body)))


def checked(responses: DataFrame, body: str = "body") -> DataFrame:
    """Strict form: the job fails on the first error payload it reads."""
    guarded = F.when(is_error_payload(F.col(body)), F.raise_error(F.lit(INVALID_TOKEN))).otherwise(
        F.col(body)
    )
    return responses.withColumn(body, guarded)


def _parsed_once(responses: DataFrame, body: str, schema: T.DataType, name: str) -> DataFrame:
    """Body replaced by its parsed value.

    The generator of one element keeps Spark from repeating the parse in every
    expression and pushed-down filter that uses the value.
    """
    others = [column for column in responses.columns if column != body]
    parsed = F.explode(F.array(F.from_json(body, schema)))
    return responses.select(*others, parsed.alias(name))


def parse_task_summaries(responses: DataFrame, body: str = "body") -> DataFrame:
    """``summaries`` array from a landed task-summary body."""
    return _parsed_once(responses, body, schemas.TASK_SUMMARIES, "summaries")


def parse_analysis(responses: DataFrame, body: str = "body") -> DataFrame:
    """``insights`` and ``recommendation`` of the usable analysis bodies.

    Empty and malformed bodies have no insight list and give no row; a malformed
    one parses to a struct of NULLs. The test sits inside the generator so that
    each body is parsed once: a plain filter would be pushed below the parse and
    repeat it.
    """
    parsed = F.from_json(body, schemas.ANALYSIS)
    usable = F.filter(F.array(parsed), lambda analysis: analysis["insightsV2"].isNotNull())
    others = [name for name in responses.columns if name != body]
    return responses.select(*others, F.inline(usable)).withColumnRenamed("insightsV2", "insights")


def unusable_analyses(responses: DataFrame, body: str = "body") -> DataFrame:
    """Bodies without an insight list, for a reject table."""
    return responses.filter(F.from_json(body, schemas.ANALYSIS)["insightsV2"].isNull())


def parse_app_summary(responses: DataFrame, body: str = "body") -> DataFrame:
    """``annotation`` struct from a landed app-summary body."""
    parsed = _parsed_once(responses, body, schemas.APP_SUMMARY, "_summary")
    return parsed.withColumn("annotation", F.col("_summary.annotation")).drop("_summary")

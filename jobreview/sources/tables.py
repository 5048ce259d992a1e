"""Table and stream sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def current_profiles(dim: DataFrame) -> DataFrame:
    """Rows of the dimension that are current; a NULL flag is not current."""
    return dim.filter(F.col("is_current"))


def profile_dimension(spark: SparkSession, table: str) -> DataFrame:
    """Static scan of the profile table, current rows only."""
    return current_profiles(spark.table(table))


def read_event_stream(
    spark: SparkSession,
    *,
    table: str | None = None,
    path: str | None = None,
    schema: T.StructType | None = None,
    source_format: str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    path_glob: str | None = None,
) -> DataFrame:
    """Unbounded scan of a table or a folder with at most one admission cap.

    Spark rejects both caps together and reads a byte cap only as a plain
    integer, so both mistakes are caught here, before a stream is started.
    """
    if (table is None) == (path is None):
        raise ValueError("give exactly one of table and path")
    if max_files_per_trigger is not None and max_bytes_per_trigger is not None:
        raise ValueError("give at most one of max_files_per_trigger and max_bytes_per_trigger")
    reader = spark.readStream
    if source_format:
        reader = reader.format(source_format)
    for option, cap in (
        ("maxFilesPerTrigger", max_files_per_trigger),
        ("maxBytesPerTrigger", max_bytes_per_trigger),
    ):
        if cap is None:
            continue
        if isinstance(cap, bool) or not isinstance(cap, int) or cap <= 0:
            raise ValueError(f"{option} must be a positive integer, got {cap!r}")
        reader = reader.option(option, cap)
    if table is not None:
        return reader.table(table)
    if schema is None:
        raise ValueError("a file stream needs an explicit schema")
    if path_glob:
        reader = reader.option("pathGlobFilter", path_glob)
    if not source_format:
        reader = reader.format("parquet")
    return reader.schema(schema).load(path)

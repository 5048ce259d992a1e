"""Measured size of a join side, so that a broadcast is never a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows as they would be shipped, from one aggregate over ``df``."""
    fixed = 16 + 8 * len(df.columns)
    width = F.lit(fixed)
    for field in df.schema.fields:
        if not isinstance(field.dataType, _FIXED_WIDTH):
            text = F.col(f"`{field.name}`").cast("string")
            width = width + F.coalesce(F.octet_length(text), F.lit(0))
    return df.agg(F.sum(width.cast("long")).alias("bytes")).first()["bytes"] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it, else as it is.

    Without the hint the join shuffles, and AQE splits its skewed partitions.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df

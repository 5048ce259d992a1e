"""Row hashes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "||"


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def hash_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Columns that enter the hash, in column order."""
    skipped = set(exclude)
    return [name for name in df.columns if name not in skipped]


def joined_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of the columns' texts joined by ``||``. A NULL leaves no trace."""
    return F.sha2(F.concat_ws(SEPARATOR, *[_text(name) for name in columns]), 256)


def null_safe_hash(columns: Iterable[str]) -> Column:
    """SHA-256 of a JSON object of the columns' texts: NULLs and ``||`` inside
    values cannot make two different rows look alike."""
    texts = F.struct(*[_text(name).alias(name) for name in columns])
    return F.sha2(F.to_json(texts, {"ignoreNullFields": "false"}), 256)


def with_row_hash(
    df: DataFrame,
    exclude: Iterable[str] = (),
    *,
    null_safe: bool = False,
    name: str = "row_hash",
) -> DataFrame:
    """Adds the hash over all columns but the excluded ones."""
    columns = hash_columns(df, exclude)
    return df.withColumn(name, null_safe_hash(columns) if null_safe else joined_hash(columns))

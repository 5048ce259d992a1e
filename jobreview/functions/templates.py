"""Text templates filled with columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(value: Column) -> Column:
    """Text of a value; NULL shows as ``None``."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def fill(template: str, **values: Column | str) -> Column:
    """Concatenation of the template's literals and the named values.

    A ``str`` value is literal text, a Column is shown as by ``shown``.
    """
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            value = values[name]
            pieces.append(F.lit(value) if isinstance(value, str) else shown(value))
    return F.concat(*pieces)

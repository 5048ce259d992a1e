"""Event normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Output column, type; NULL keeps the type of the nested field.
EVENT_FIELDS = (
    ("customer_id", "string"),
    ("event_id", "string"),
    ("event_type", "string"),
    ("event_ts", "timestamp"),
    ("email", "string"),
    ("loyalty_tier", "string"),
    ("country", "string"),
    ("preferences", None),
    ("attributes", None),
)
EVENT_KEYS = ("customer_id", "event_id")


def normalize_events(events: DataFrame, *, strict: bool = True) -> DataFrame:
    """Nine payload fields as typed top-level columns; rows without both keys go.

    Strict casts fail the query on a malformed timestamp (the ANSI default);
    lenient ones give NULL.
    """

    def field(name: str, to_type: str | None):
        source = F.col(f"payload.{name}")
        if to_type is not None:
            source = source.cast(to_type) if strict else source.try_cast(to_type)
        return source.alias(name)

    columns = [field(name, to_type) for name, to_type in EVENT_FIELDS]
    keyed = [F.col(key).isNotNull() for key in EVENT_KEYS]
    return events.select(*columns).filter(keyed[0] & keyed[1])

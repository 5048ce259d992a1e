"""Left join of events to the profile dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobreview.operators.sizing import DEFAULT_BROADCAST_BYTES, broadcast_if_small
from jobreview.sources.tables import current_profiles

KEY = "customer_id"
PROFILE_COLUMNS = {
    "segment": "profile_segment",
    "lifetime_value": "profile_lifetime_value",
    "last_profile_update_ts": "last_profile_update_ts",
}
ENRICHED_COLUMNS = (
    "customer_id",
    "event_id",
    "event_type",
    "event_ts",
    "email",
    "loyalty_tier",
    "profile_segment",
    "profile_lifetime_value",
    "last_profile_update_ts",
    "country",
    "preferences",
    "attributes",
)


def unique_profiles(dim: DataFrame, on_duplicate: str) -> DataFrame:
    """Policy for several current rows of one customer.

    ``keep`` fans out, ``any`` keeps one of them, ``latest`` the one updated
    last, ``error`` fails while the plan is built.
    """
    if on_duplicate == "keep":
        return dim
    if on_duplicate == "any":
        return dim.dropDuplicates([KEY])
    if on_duplicate == "latest":
        others = [name for name in dim.columns if name != KEY]
        # A struct orders by its fields, so ties end the same way every time,
        # and the maximum is combined before the shuffle.
        newest = F.max(
            F.struct(F.col("last_profile_update_ts").alias("_updated"), *others)
        ).alias("_newest")
        return dim.groupBy(KEY).agg(newest).select(KEY, *[f"_newest.{name}" for name in others])
    if on_duplicate == "error":
        twice = dim.groupBy(KEY).count().filter("count > 1").select(KEY).limit(1).collect()
        if twice:
            raise ValueError(f"several current profiles for {KEY}={twice[0][0]!r}")
        return dim
    raise ValueError(f"unknown on_duplicate policy {on_duplicate!r}")


def enrich_with_profile(
    events: DataFrame,
    dim: DataFrame,
    *,
    broadcast: bool = False,
    max_broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
    salt_buckets: int = 1,
    hot_keys: DataFrame | None = None,
    on_duplicate: str = "keep",
) -> DataFrame:
    """Twelve enriched columns; an event without a current profile keeps NULLs.

    By default Spark picks the join from the side's size estimate and AQE splits
    hot customers. ``broadcast`` asks for a broadcast join, granted only if the
    measured size of the side is within ``max_broadcast_bytes``. A stream has
    no AQE skew handling: there, ``salt_buckets`` spreads each customer over
    that many tasks at the price of as many copies of each profile. With
    ``hot_keys``, a small table of customers, only those are spread and copied.
    """
    profiles = unique_profiles(current_profiles(dim).select(KEY, *PROFILE_COLUMNS), on_duplicate)
    renamed = profiles.select(
        F.col(KEY).alias("_profile_key"),
        *[F.col(name).alias(f"_profile_{name}") for name in PROFILE_COLUMNS],
    )
    if broadcast:
        renamed = broadcast_if_small(renamed, max_broadcast_bytes)
    same_key = F.col(KEY) == F.col("_profile_key")
    left = events
    if salt_buckets > 1:
        salt = F.pmod(F.xxhash64("event_id"), F.lit(salt_buckets))
        copies = F.sequence(F.lit(0), F.lit(salt_buckets - 1)).cast("array<bigint>")
        left = events
        if hot_keys is not None:
            hot = F.broadcast(hot_keys.select(F.col(KEY).alias("_hot")).distinct())
            left = left.join(hot, F.col(KEY) == F.col("_hot"), "left")
            renamed = renamed.join(hot, F.col("_profile_key") == F.col("_hot"), "left")
            once = F.array(F.lit(0).cast("bigint"))
            salt = F.when(F.col("_hot").isNotNull(), salt).otherwise(F.lit(0))
            copies = F.when(F.col("_hot").isNotNull(), copies).otherwise(once)
        left = left.withColumn("_salt", salt)
        renamed = renamed.select("*", F.explode(copies).alias("_profile_salt"))
        same_key = same_key & (F.col("_salt") == F.col("_profile_salt"))
    joined = left.join(renamed, same_key, "left")
    source = {alias: f"_profile_{name}" for name, alias in PROFILE_COLUMNS.items()}
    return joined.select(*[F.col(source.get(name, name)).alias(name) for name in ENRICHED_COLUMNS])


def without_profile(events: DataFrame) -> DataFrame:
    """The enriched layout with NULL profile columns, for runs with the join off."""
    types = {
        "profile_segment": "string",
        "profile_lifetime_value": "double",
        "last_profile_update_ts": "timestamp",
    }
    return events.select(
        *[
            F.lit(None).cast(types[name]).alias(name) if name in types else F.col(name)
            for name in ENRICHED_COLUMNS
        ]
    )

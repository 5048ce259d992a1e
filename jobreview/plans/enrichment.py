"""The enrichment chain, the same for a batch and a stream."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame

from jobreview.functions.hashing import with_row_hash
from jobreview.operators.dedupe import dedupe_events, dedupe_within
from jobreview.operators.normalize import normalize_events
from jobreview.operators.profile import enrich_with_profile, without_profile
from jobreview.operators.versions import with_audit_columns

DEFAULT_FILES_PER_TRIGGER = 12000
# Columns the strategy leaves out of the hash. They are added after hashing, so
# the list only matters to callers that hash an already audited table.
HASH_EXCLUDED = ("row_eff_start_tms", "row_eff_end_tms")


@dataclass(frozen=True)
class EnrichmentOptions:
    """Settings of the enrichment job; ``with_overrides`` replaces some.

    Tables have no defaults: a run with a forgotten setting must not write to a
    guessed table. Keys that are no setting are accepted and kept in ``extra``.
    """

    source_table: str | None = None
    profile_dim_table: str | None = None
    target_table: str | None = None
    target_path: str | None = None
    checkpoint_path: str | None = None
    source_format: str | None = None
    target_format: str = "parquet"
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int | None = None
    stateful_dedupe: bool = True
    dedupe_delay: str | None = None
    enable_profile_join: bool = True
    broadcast_profile: bool = False
    salt_buckets: int = 1
    on_duplicate_profile: str = "latest"
    strict_casts: bool = True
    null_safe_hash: bool = False
    extra: dict = field(default_factory=dict)

    def with_overrides(self, overrides: dict | None = None) -> EnrichmentOptions:
        known = {item.name for item in fields(self)} - {"extra"}
        given = dict(overrides or {})
        extra = {name: value for name, value in given.items() if name not in known}
        chosen = {name: value for name, value in given.items() if name in known}
        return replace(self, **chosen, extra={**self.extra, **extra})

    def checked(self) -> EnrichmentOptions:
        """Itself, if the tables that the job needs are named."""
        missing = [] if self.source_table else ["source_table"]
        if self.enable_profile_join and not self.profile_dim_table:
            missing.append("profile_dim_table")
        if not (self.target_table or self.target_path):
            missing.append("target_table or target_path")
        if missing:
            raise ValueError(f"the enrichment job needs {', '.join(missing)}")
        return self

    def admission_caps(self) -> dict[str, int | None]:
        """Caps of the stream source: files by default, bytes if they are given."""
        files, size = self.max_files_per_trigger, self.max_bytes_per_trigger
        if files is None and size is None:
            files = DEFAULT_FILES_PER_TRIGGER
        return {"max_files_per_trigger": files, "max_bytes_per_trigger": size}


def dedupe_step(events: DataFrame, options: EnrichmentOptions) -> DataFrame:
    if not options.stateful_dedupe:
        return events
    if options.dedupe_delay is not None and events.isStreaming:
        return dedupe_within(events, options.dedupe_delay)
    return dedupe_events(events)


def unique_events(events: DataFrame, options: EnrichmentOptions = EnrichmentOptions()) -> DataFrame:
    """The events normalised, each once."""
    return dedupe_step(normalize_events(events, strict=options.strict_casts), options)


def profiled(
    unique: DataFrame,
    profiles: DataFrame | None,
    options: EnrichmentOptions = EnrichmentOptions(),
    *,
    as_of: Column | None = None,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """Unique events with their profile, hash and audit columns."""
    if options.enable_profile_join:
        enriched = enrich_with_profile(
            unique,
            profiles,
            broadcast=options.broadcast_profile,
            salt_buckets=options.salt_buckets,
            hot_keys=hot_keys,
            on_duplicate=options.on_duplicate_profile,
        )
    else:
        enriched = without_profile(unique)
    hashed = with_row_hash(enriched, HASH_EXCLUDED, null_safe=options.null_safe_hash)
    return with_audit_columns(hashed, as_of)


def enrich(
    events: DataFrame,
    profiles: DataFrame | None,
    options: EnrichmentOptions = EnrichmentOptions(),
    *,
    as_of: Column | None = None,
) -> DataFrame:
    """Eighteen columns per event: normalised, profiled, hashed, audited.

    Duplicates go before the join, which then sees fewer and narrower rows, and
    whose key alone would gather a busy customer in one task. With one profile
    per customer both orders keep the same events.
    """
    return profiled(unique_events(events, options), profiles, options, as_of=as_of)

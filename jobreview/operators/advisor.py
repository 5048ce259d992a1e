"""Compute recommendation per query from its KPIs: an ordered rule ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.sources.schemas import KPI

# Operator names, thresholds and result texts of the rules.
HEAVY_EXCHANGE = ("broadcasthashjoin", "shufflerepartition", "sortmergejoin", "shuffleexchange")
PYTHON_EVAL = ("batchevalpython",)
READ_OPERATORS = ("scan", "union", "aggregate")
NOT_WITH_NATIVE_WRITE = (
    "broadcasthashjoin",
    "shufflerepartition",
    "sortmergejoin",
    "batchevalpython",
)
NATIVE_WRITE = ("photonparquetwriter",)
NOT_LIGHTWEIGHT = ("join", "union", "aggregate", "python")

MANY_ROWS_WRITTEN = 10_000_000
MANY_MB_WRITTEN = 2048
LONG_SECONDS = 1800
READ_HEAVY_SECONDS = 900
READ_HEAVY_MB = 2048
SHORT_WRITE_ROWS = 2_000_000
SHORT_WRITE_SECONDS = 600
SHORT_WRITE_MB = 1000
LIGHT_SECONDS = 300
LIGHT_ROWS_READ = 1_000_000

RESULTS = {
    "heavy_exchange": "Prefer Photon Compute (heavy join or repartitioning)",
    "python_eval": "Prefer Photon Compute (Python UDFs detected)",
    "large_write": "Prefer Photon Compute (Large write volume)",
    "long_run": "Prefer Photon Compute (long execution time)",
    "read_heavy": "Prefer Photon Compute (long read-heavy pipeline)",
    "short_native_write": "Prefer Serverless (Photon write, no heavy ops, short job)",
    "lightweight": "Prefer Serverless (lightweight read/project job)",
}
NEUTRAL_RESULT = "Either environment acceptable or further tuning needed"


def normalize_kpis(queries: DataFrame, prefix: str = "") -> DataFrame:
    """KPI columns with defaults for NULL or absent ones, plus ``operators``:
    the distinct lower-cased operator names. Other columns pass through, and so
    do the KPIs as they came if a ``prefix`` names the filled ones."""
    present = set(queries.columns)
    defaults = {"string": F.lit(""), "bigint": F.lit(0), "double": F.lit(0)}

    def filled(field):
        default = defaults.get(field.dataType.simpleString(), F.array()).cast(field.dataType)
        if field.name not in present:
            return default.alias(prefix + field.name)
        value = F.coalesce(F.col(field.name).cast(field.dataType), default)
        return (F.lower(value) if field.name == "environment" else value).alias(prefix + field.name)

    replaced = set() if prefix else {field.name for field in KPI.fields}
    kept = [F.col(name) for name in queries.columns if name not in replaced]
    names = F.filter(F.col(f"{prefix}operator_names"), lambda name: name.isNotNull())
    return queries.select(*kept, *[filled(field) for field in KPI.fields]).withColumn(
        f"{prefix}operators", F.array_distinct(F.transform(names, F.lower))
    )


def has_any(names: tuple[str, ...], operators: str = "operators") -> Column:
    """True if one of ``names`` is among the operators, as a whole name."""
    wanted = F.array(*[F.lit(name) for name in names])
    return F.coalesce(F.arrays_overlap(F.col(operators), wanted), F.lit(False))


def rule_conditions(prefix: str = "") -> dict[str, Column]:
    """The rules by name, in ladder order, over columns of ``normalize_kpis``."""

    def ran(names: tuple[str, ...]) -> Column:
        return has_any(names, f"{prefix}operators")

    def above(value: Column, limit: float) -> Column:
        # NaN sorts above every number here, but is above no limit.
        return (value > limit) & ~F.isnan(value)

    # Cheap comparisons stand before array tests; the conditions are the same.
    seconds = F.col(f"{prefix}total_duration_seconds")
    written_rows = F.col(f"{prefix}rows_written")
    written_mb = F.col(f"{prefix}bytes_written_mb")
    read_rows = F.col(f"{prefix}rows_read")
    read_mb = F.col(f"{prefix}bytes_read_mb")
    return {
        "heavy_exchange": ran(HEAVY_EXCHANGE),
        "python_eval": ran(PYTHON_EVAL),
        "large_write": (written_rows > MANY_ROWS_WRITTEN) | above(written_mb, MANY_MB_WRITTEN),
        "long_run": above(seconds, LONG_SECONDS),
        "read_heavy": above(seconds, READ_HEAVY_SECONDS)
        & above(read_mb, READ_HEAVY_MB)
        & ran(READ_OPERATORS),
        "short_native_write": (written_rows < SHORT_WRITE_ROWS)
        & (seconds < SHORT_WRITE_SECONDS)
        & (written_mb < SHORT_WRITE_MB)
        & ran(NATIVE_WRITE)
        & ~ran(NOT_WITH_NATIVE_WRITE),
        "lightweight": (seconds < LIGHT_SECONDS)
        & (read_rows < LIGHT_ROWS_READ)
        & ~ran(NOT_LIGHTWEIGHT),
    }


def recommend(queries: DataFrame) -> DataFrame:
    """Adds ``recommendation``, the text of the first rule that holds."""
    prefix = "_kpi_"
    ladder = F
    for rule, condition in rule_conditions(prefix).items():
        ladder = ladder.when(condition, F.lit(RESULTS[rule]))
    advice = ladder.otherwise(F.lit(NEUTRAL_RESULT)).alias("recommendation")
    return normalize_kpis(queries, prefix).select(*queries.columns, advice)

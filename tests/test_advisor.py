"""Rule ladder: thresholds, case, gaps, order."""

import pytest
from plan_text import plan_of

from jobreview.operators.advisor import NEUTRAL_RESULT, RESULTS, normalize_kpis, recommend
from jobreview.sources.schemas import KPI

MILLION = 1_000_000
FIELDS = [field.name for field in KPI.fields]


def kpi(seconds=1000.0, ops=(), read=0, written=0, mb_read=0.0, mb_written=0.0):
    return ("Prod", read, written, mb_read, mb_written, seconds, list(ops))


CASES = [
    (kpi(ops=["SortMergeJoin"]), "heavy_exchange"),
    (kpi(ops=["ShuffleExchange", "BatchEvalPython"]), "heavy_exchange"),
    (kpi(ops=["BATCHEVALPYTHON"]), "python_eval"),
    (kpi(written=10 * MILLION), None),
    (kpi(written=10 * MILLION + 1), "large_write"),
    (kpi(mb_written=2048.0), None),
    (kpi(mb_written=2048.5), "large_write"),
    (kpi(seconds=1800.0), None),
    (kpi(seconds=1800.1), "long_run"),
    (kpi(seconds=900.0, mb_read=3000.0, ops=["Scan"]), None),
    (kpi(seconds=900.1, mb_read=2048.0, ops=["Scan"]), None),
    (kpi(seconds=900.1, mb_read=2048.1, ops=["Scan"]), "read_heavy"),
    (kpi(seconds=900.1, mb_read=2048.1, ops=["Filter"]), None),
    (kpi(seconds=599.9, ops=["PhotonParquetWriter"]), "short_native_write"),
    (kpi(seconds=600.0, ops=["PhotonParquetWriter"]), None),
    (kpi(seconds=400.0, ops=["PhotonParquetWriter"], written=2 * MILLION), None),
    (kpi(seconds=400.0, ops=["PhotonParquetWriter"], written=2 * MILLION - 1), "short_native_write"),
    (kpi(seconds=400.0, ops=["PhotonParquetWriter"], mb_written=1000.0), None),
    (kpi(seconds=299.9, ops=["Project"]), "lightweight"),
    (kpi(seconds=300.0, ops=["Project"]), None),
    (kpi(seconds=299.9, read=MILLION), None),
    (kpi(seconds=299.9, read=MILLION - 1), "lightweight"),
    (kpi(seconds=10.0, ops=["Join"]), None),
    (kpi(seconds=10.0, ops=["HashJoin"]), "lightweight"),
    (kpi(seconds=10.0, ops=["Python"]), None),
    (kpi(seconds=10.0, ops=["Scan", None]), "lightweight"),
    (kpi(seconds=10.0, ops=["Union", None]), None),
    ((None,) * 7, "lightweight"),
]


def test_ladder(spark):
    rows = [(i, *case[0]) for i, case in enumerate(CASES)]
    schema = "i int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in KPI.fields)
    df = spark.createDataFrame(rows, schema)
    advised = recommend(df)
    assert advised.columns == [*df.columns, "recommendation"]
    actual = {row.i: row.recommendation for row in advised.collect()}
    for i, (values, rule) in enumerate(CASES):
        assert actual[i] == (RESULTS[rule] if rule else NEUTRAL_RESULT), values


def test_input_columns_stay_as_they_came(spark):
    df = spark.createDataFrame([("PROD", None)], "environment string, rows_read long")
    row = recommend(df).first()
    assert (row.environment, row.rows_read) == ("PROD", None)
    assert row.recommendation == RESULTS["lightweight"]


def test_defaults(spark):
    df = spark.createDataFrame([(1, "PROD", ["A", "a", None])], "q int, environment string, operator_names array<string>")
    row = normalize_kpis(df).first()
    assert (row.environment, row.rows_read, row.total_duration_seconds) == ("prod", 0, 0.0)
    assert row.operators == ["a"]


@pytest.mark.parametrize("columns", [FIELDS, FIELDS[:3]])
def test_no_shuffle(spark, columns):
    fields = {f.name: f.dataType.simpleString() for f in KPI.fields}
    schema = ", ".join(f"{name} {fields[name]}" for name in columns)
    assert "Exchange" not in plan_of(recommend(spark.createDataFrame([], schema)))


def test_nan_is_above_no_limit(spark):
    nan = float("nan")
    rows = [(1, nan, nan, nan, ["scan"])]
    schema = "query_id int, bytes_read_mb double, bytes_written_mb double, total_duration_seconds double, operator_names array<string>"
    advice = recommend(spark.createDataFrame(rows, schema)).first().recommendation
    assert advice == NEUTRAL_RESULT

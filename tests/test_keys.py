"""Key filters and numbers along an order."""

import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from jobreview.operators import keyfilter
from jobreview.operators.numbering import numbered


@pytest.mark.parametrize("max_words", [keyfilter.MAX_WORDS, 0])
def test_no_key_is_lost_and_few_others_pass(spark, max_words):
    keys = spark.range(0, 200_000, 40).select(F.col("id").cast("string").alias("a"), "id")
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("a"), "id", F.lit(1).alias("_extra"))
    got = keyfilter.reduced(rows, keys, ["a", "id"], max_words=max_words)
    assert got.columns == rows.columns
    assert got.join(keys, ["a", "id"]).count() == 5_000
    assert got.count() <= 5_000 + 200_000 * (0.02 if max_words else 0)


def test_filter_grows_with_its_keys():
    assert [keyfilter.words_for(n) for n in (0, 1, 4, 5, 8, 9, 1000)] == [1, 1, 1, 2, 2, 4, 256]


def test_null_keys_and_no_keys(spark):
    rows = spark.createDataFrame([(1,), (None,)], "k long")
    assert keyfilter.reduced(rows, rows.filter("k IS NULL"), ["k"]).count() == 0
    assert keyfilter.reduced(rows, rows, ["k"]).collect() == [(1,)]


def test_numbers_follow_the_order_without_one_task(spark):
    rows = spark.range(5_000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    got = numbered(rows, F.desc("a"), "id", name="no").collect()
    expected = sorted(((r["a"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["no"])] == expected
    assert sorted(r["no"] for r in got) == list(range(5_000))
    assert numbered(rows.limit(0), "id", name="no").count() == 0
    assert "SinglePartition" not in plan_of(rows.repartitionByRange("a"))

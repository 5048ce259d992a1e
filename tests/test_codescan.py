"""Code scan against a plain walk over the lines."""

import random

import numpy as np
import pyarrow as pa
import pytest
from plan_text import plan_of
from pyspark.sql import functions as F

from jobreview.operators import codescan
from jobreview.operators.codescan import (
    RULES,
    changed_files,
    code_hits,
    code_hits_by_table,
    gate_by_runs,
    review_comments,
    route_comments,
)
from jobreview.plans import queries
from jobreview.session import staged


def files(spark, *texts):
    rows = [(i, f"c{i}", f"f{i}.py", text) for i, text in enumerate(texts)]
    return changed_files(
        spark.createDataFrame(rows, "pr_id int, commit_id string, filename string, text string")
    )


def expected(texts):
    found = []
    for i, text in enumerate(texts):
        lines = text.split("\n")
        for pattern in RULES:
            for number, line in enumerate(lines, 1):
                if pattern in line:
                    shown = range(max(1, number - 3), number + 1)
                    found.append((f"f{i}.py", pattern, number, [f"{n} {lines[n - 1]}" for n in shown]))
    return sorted(found)


def test_hits_and_context(spark):
    random.seed(3)
    pieces = ["df.collect()", "df.toPandas()", "DF.collect()", "x = 1", "", "df.collect() # df.collect()"]
    texts = ["\n".join(random.choices(pieces, k=k)) for k in range(1, 25)]
    texts += ["", "df.collect()", "df.toPandas()\n", "a\r\ndf.collect()\r\n", "df.collec\nt()"]
    found = code_hits(files(spark, *texts)).collect()
    actual = sorted((r.filename, r.pattern, r.line, r.context) for r in found)
    assert actual == expected(texts)
    assert {r.pattern: r.advice for r in found} == RULES


def test_no_shuffle_and_early_filter(spark):
    plan = plan_of(review_comments(code_hits(files(spark, "x"))))
    assert "Exchange" not in plan and "Contains" in plan


def test_delivery(spark):
    text = "a\nb\nc\nd\ndf.collect()\ndf.collect()\ndf.collect()"
    comments = review_comments(code_hits(files(spark, text)))
    status = F.when(F.col("line") == 5, 201).when(F.col("line") == 6, 422)
    rows = {r.line: r for r in route_comments(comments.withColumn("status", status)).collect()}
    advice = RULES["df.collect()"]
    assert (rows[5].delivery, rows[5].body) == ("inline", advice)
    block = "\n```python\n3 c\n4 d\n5 df.collect()\n6 df.collect()\n```\n\n"
    assert (rows[6].delivery, rows[6].body) == ("fallback", block + "\n\n" + advice)
    assert rows[7].delivery == "fallback"
    assert rows[5].path == "f0.py" and rows[5].commit_id == "c0"


def test_gate(spark):
    comments = review_comments(code_hits(files(spark, "df.collect()", "df.collect()")))
    resolved = spark.createDataFrame([(1,), (1,)], "pr_id int")
    assert [row.pr_id for row in gate_by_runs(comments, resolved).collect()] == [1]
    plan = plan_of(gate_by_runs(comments, resolved))
    # The join sits above the generator that emits the hits.
    assert plan.index("Join") < plan.index("Generate")


def test_rule_table_equals_plain_search(spark):
    rng = random.Random(2)
    letters = "abcé "
    texts = ["\n".join("".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(6)) for _ in range(60)] + [None, ""]
    patterns = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(80)} | {"", "zzzz", "b"}
    files = spark.createDataFrame([(1, "c", f"f{i}", t) for i, t in enumerate(texts)], "pr_id long, commit_id string, filename string, text string")
    rules = spark.createDataFrame([(p, f"mind {p}") for p in patterns] + [("b", "mind b"), (None, "x")], "pattern string, advice string")
    hits = code_hits_by_table(files, rules)
    expected = {
        (f"f{i}", p, n)
        for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"), 1) for p in patterns if p and p in line
    }
    rows = hits.collect()
    assert {(r.filename, r.pattern, r.line) for r in rows} == expected and len(rows) == len(expected)
    assert code_hits_by_table(files, rules.limit(0)).count() == 0
    assert "NestedLoop" not in plan_of(hits) and "Cartesian" not in plan_of(hits)


@pytest.mark.parametrize("max_known", [0, 1 << 20])
def test_rule_table_keeps_only_the_windows_of_rules(spark, tmp_path, monkeypatch, max_known):
    """The index over the files holds a window of a rule where it stands, and no
    others; the files are read for it once."""
    stored = {}

    def kept(df, purpose):
        assert purpose not in stored
        stored[purpose] = staged(df, purpose)
        return stored[purpose]

    monkeypatch.setattr(codescan, "staged", kept)
    rows = [(1, "c", "a", "one two three é\nthree"), (1, "c", "b", "abcdef bcdefg cdefgh"), (1, "c", "d", None)]
    files = spark.createDataFrame(rows, "pr_id long, commit_id string, filename string, text string")
    rules = spark.createDataFrame([(p, "x") for p in ("é", "three é", "abcdefgh", "ee")], "pattern string, advice string")
    hits = code_hits_by_table(files, rules, max_known=max_known).collect()
    assert sorted((r.filename, r.pattern, r.line) for r in hits) == [("a", "ee", 1), ("a", "ee", 2), ("a", "three é", 1), ("a", "é", 1)]
    windows = sorted(r.filename for r in stored["file-grams"].collect())
    assert windows == ["a"] * 4  # "é", "ee", and the two windows of "three é"


def test_windows_equal_those_of_each_text(monkeypatch):
    monkeypatch.setattr(codescan, "POSITIONS", 5)
    texts = ["abcabcabc", None, "", "é1é1é1", "x", "abcdefgh" * 3, "cab"]
    expected = [
        {(w << 56) | int.from_bytes(d[i : i + w], "little") for w in (1, 3, 7) for i in range(len(d) - w + 1)}
        for d in ((t or "").encode() for t in texts)
    ]
    whole = pa.array([None, *texts]).slice(1)
    assert [set(x) for x in codescan.text_grams(whole, [1, 3, 7]).to_pylist()] == expected
    some = np.array(sorted(expected[0])[::2], np.uint64)
    assert [set(x) for x in codescan.text_grams(whole, [1, 3, 7], some).to_pylist()] == [e & set(some.tolist()) for e in expected]


def test_gated_comments_need_no_run_info(spark, tmp_path):
    """Order 31 has resolved runs, but its run info is malformed; order 13 has no
    analysis, so no run of it is resolved."""
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    orders = [(k, 7, "O", 1.5, "1-URGENT") for k in (13, 31, 32)]
    documents = [(k, "The first\nLicense") for k in (13, 31, 32)]
    spark.createDataFrame(orders, columns).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.registry()["code_comments_gated"](spark, str(tmp_path)).collect()
    assert sorted((r.pr_id, r.line) for r in rows) == [(31, 1), (31, 2), (32, 1), (32, 2)]

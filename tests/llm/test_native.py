"""Decontamination, line deduplication and pseudonyms on small tables."""

import itertools
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from jobreview.llm import decontaminate as D
from jobreview.llm import line_dedup as L
from jobreview.llm import pii
from jobreview.llm.common import written

KEY = "a key for tests"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
ITEM_SUBST = "alpha beta gamma delta XXX zeta eta theta iota YYY"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_contamination(spark, frame, max_broadcast):
    texts = [f"well {ITEM} then", f"so {ITEM_SUBST}", "alpha beta gamma delta epsilon only", "", None, ITEM.upper() + ".", "one two"]
    docs = frame([*texts, texts[0], None], [*range(len(texts)), 0, None])
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "one two"), (None, ITEM), (3, None)], "item_id long, text string")
    out = D.mark_contaminated(docs, items, max_broadcast=max_broadcast)
    no_python(out)
    rows = out.collect()
    assert len(rows) == 9
    got = {r["doc_id"]: (r["contaminated"], r["n_items"], r["best_similarity"], r["item_ids"]) for r in rows if r["doc_id"] is not None}
    assert got[0] == got[5] == (True, 1, 1.0, [1])
    assert got[1] == (True, 1, 0.8, [1])
    assert all(got[i] == (False, 0, None, None) for i in (2, 3, 4))
    assert got[6] == (True, 1, 1.0, [2]), "short items are matched whole"
    kept = D.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [2, 3, 4]
    assert D.mark_contaminated(docs, items.limit(0)).filter("contaminated").count() == 0
    assert D.mark_contaminated(docs.limit(0), items).count() == 0


def has_seed(n, gone):
    masks = D.masks_for(n)
    return any(all(at + p not in gone for p in mask) for mask in masks for at in range(n - mask[-1]))


@pytest.mark.parametrize("n", range(1, 31))
def test_every_overlap_has_a_seed(n):
    lost = n // 5
    if n <= 20:
        patterns = itertools.combinations(range(n), lost)
    else:
        rng = random.Random(n)
        patterns = [rng.sample(range(n), lost) for _ in range(20_000)]
        patterns += [range(i, n, step) for step in (4, 5, 6) for i in range(step) if len(range(i, n, step)) <= lost]
    assert all(has_seed(n, set(gone)) for gone in patterns)


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_overlaps_equal_a_search_without_seeds(spark, max_broadcast):
    rng = random.Random(4)
    items = {i: [f"i{i}x{k}" for k in range(i)] for i in range(1, 26)}
    texts, expected = [], []
    for i, words in items.items():
        for lost in range(n_lost(i) + 2):
            text = list(words)
            for at in rng.sample(range(i), min(lost, i)):
                text[at] = "other"
            texts.append(" ".join(["so", *text, "then", "very long text " * 50]))
            share = sum(a == b for a, b in zip(text, words, strict=True)) / i
            expected.append((share >= 0.8, [i] if share >= 0.8 else None))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = D.mark_contaminated(docs, bench, max_broadcast=max_broadcast).orderBy("doc_id").collect()
    assert [(r["contaminated"], r["item_ids"]) for r in rows] == expected


@pytest.mark.parametrize("max_broadcast", [D.MAX_BROADCAST, 0])
def test_hits_carry_no_words_and_estimates_broadcast_no_benchmark(spark, monkeypatch, max_broadcast):
    frames = []
    monkeypatch.setattr(D, "written", lambda df, purpose: frames.append(df) or written(df, purpose), raising=False)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join([*words, *words, f"own{i}"])) for i in range(3)] + [(9, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(words)) for i in range(5)], "item_id long, text string")
    out = D.mark_contaminated(docs, items, max_broadcast=max_broadcast)
    got = {r["doc_id"]: (r["n_items"], r["best_similarity"]) for r in out.collect()}
    assert got == {0: (5, 1.0), 1: (5, 1.0), 2: (5, 1.0), 9: (0, None)}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in [*frames, out]]
    met = [x for x in frames if "offset" in x.columns]
    assert [x.columns for x in met] == [["doc_key", "text_hash", "item_key", "offset"]]
    broadcast = any(re.search(r"BroadcastHashJoin \[(seed|item_key)#", plan) for plan in plans)
    assert broadcast == (max_broadcast > 0)


def n_lost(n):
    return n // 5


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup_equals_brute_force(frame):
    line = "this is the first line of the text, and it is long"
    variants = [line, line[:10] + "X" + line[11:], line[1:], line + "!", line[:25] + "é" + line[25:], line[:-2], line[:3] + line[4:]]
    texts = ["\n".join(variants[i:] + ["short", "", f"own line number {i} here, once only"]) for i in range(len(variants))]
    texts += [None, "", line, "\n\n" + "z" * 300 + "\n" + "z" * 301]
    docs = frame(texts)
    out = L.dedup_lines(docs)
    no_python(out)
    assert out.columns == [*docs.columns, "lines_removed_", "lines_left"]
    seen, expected = [], []
    for text in texts:
        kept = []
        for x in text.split("\n") if text is not None else []:
            # All earlier lines count, also those that go themselves.
            near = [y for y in seen if min(len(x), len(y)) >= L.NEAR_MIN_CHARS]
            if x == "" or (x not in seen and all(edits(x, y) > 1 for y in near)):
                kept.append(x)
            seen.append(x)
        expected.append(None if text is None else "\n".join(kept))
    assert [row["text"] for row in out.orderBy("doc_id").collect()] == expected
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_equal_ids_and_nulls(frame):
    line = "a line that is long enough to go"
    rows = L.dedup_lines(frame([line, line, line + "\nx"], [None, 1, 1])).collect()
    assert sorted((r["text"], r["lines_removed_"]) for r in rows) == [("", 1), (line, 0), ("x", 1)]


def test_null_and_repeated_ids_lose_only_their_own_lines(spark):
    rows = [(None, "a\nsame\nonly here"), (None, "same\nclean\nfine"), (7, "x\ny"), (7, "b\nx\nclean"), (7, "b\nx\nclean")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, gone_doc int, gone int")
    out = L.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "gone_doc", "gone", "lines_removed", "lines_left"]
    got = sorted((r["doc_id"] or 0, r["text"], r["lines_removed"]) for r in out.collect())
    expected = []  # the earliest place is the least by id (null first), text hash and line number
    order = {t: h for t, h in docs.selectExpr("text", "xxhash64(text)").distinct().collect()}
    seen = set()
    for i, text in sorted(set(rows), key=lambda r: (r[0] or 0, order[r[1]])):
        kept = [x for x in text.split("\n") if x not in seen]
        seen |= set(text.split("\n"))
        expected += [(i or 0, "\n".join(kept), text.count("\n") + 1 - len(kept))] * rows.count((i, text))
    assert got == sorted(expected)


def test_short_lines_and_one_very_long_line(frame):
    long = "".join(chr(97 + i * i % 23) for i in range(1_000_000))
    texts = ["Subscribe now\n\nx", "x\nSubscribe now\n\nSubscribe no", long, long[:400_000] + "#" + long[400_000:], long[:-1] + "##"]
    rows = L.dedup_lines(frame(texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in rows[:2]] == [texts[0], "\nSubscribe no"]
    assert rows[2]["text"] == long and rows[3]["text"] == "" and rows[4]["text"] == texts[4]


def test_neighbours_are_verified_without_an_edit_distance(frame):
    """Its cost is the product of the lengths: ten minutes and more for a pair of a million characters."""
    base = "née 😀 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa the end"
    near = [base[1:], base[:-1], base + "!", "x" + base, base.replace("😀", "y"), base.replace("aa", "a", 1)]
    far = [base + "??", "zz" + base[2:], base[::-1]]
    docs = frame([base, *near, *far])
    found = L.neighbours(L.distinct_lines(docs.select(docs.doc_id.alias("doc"), "text")))
    assert "levenshtein" not in found._jdf.queryExecution().toString()
    rows = L.dedup_lines(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [base, *[""] * len(near), *far]


def test_work_follows_distinct_lines_not_places(frame):
    lines = [f"license line number {i} of this very common notice, all rights reserved" for i in range(40)]
    made = []
    for copies in (2, 40):
        docs = frame(["\n".join(lines)] * copies, list(range(copies)))
        slim = docs.select(docs.doc_id.alias("doc"), "text")
        made.append(L._variants(L.shared_ranges(L.distinct_lines(slim))).count())
    assert 0 < made[0] == made[1]


VALUES = {
    "n_email": "Bob.42@mail8.example.com",
    "n_ip": "42.144.35.254",
    "n_card": "4041894974608795",
    "n_phone": "+1 (386) 555-1234",
    "n_date": "2020-02-29",
}


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", text)))


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark, frame):
    texts = [f"é {v}, then" for v in VALUES.values()]
    texts += ["4041894974608796 2021-02-30 300.1.1.1 1.2.3.4.5 a42.144.35.254", "", None, "31/12/1999 1.2.2003", " ".join(VALUES.values())]
    docs = frame(texts)
    out = pii.pseudonymise(docs, KEY)
    no_python(out)
    out = written(out, "pseudonyms")
    rows = out.orderBy("doc_id").collect()
    for i, (name, value) in enumerate(VALUES.items()):
        assert rows[i][name] == 1 and value not in rows[i]["text"]
        made = rows[i]["text"][2:-6]
        assert made in rows[9]["text"], "equal values stay linked"
        assert shape(made) == shape(value) or name == "n_ip"
    assert luhn(rows[2]["text"][2:-6])
    assert all(int(part) < 256 for part in rows[1]["text"][2:-6].split("."))
    date.fromisoformat(rows[4]["text"][2:-6])
    assert [r["text"] for r in rows[5:8]] == texts[5:8]
    assert rows[8]["n_date"] == 2
    back = pii.pseudonymise(out.select("doc_id", "text"), KEY, inverse=True).orderBy("doc_id").collect()
    assert [r["text"] for r in back] == texts
    other = pii.pseudonymise(docs, key="another").orderBy("doc_id").collect()
    assert other[0]["text"] != rows[0]["text"]
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


def test_adjacent_numbers(frame):
    card, mail = "4111 1111 1111 1111", "42@mail8.example.com"
    texts = {
        f"{card} 12/27": [card],
        "4111111111111111 123": ["4111111111111111"],
        f"item 5 {card}": [card],
        f"1234 {card}": [card],
        "555-234-4567 555-987-6543": ["555-234-4567", "555-987-6543"],
        "3782 822463 10005 12/27": ["3782 822463 10005"],
        "404189-4974608795 12": ["404189-4974608795"],
        f"4111111111111111 12.5.1999 {card} 10.0.0.1": ["4111111111111111", "12.5.1999", card, "10.0.0.1"],
        f"4111111111111112 {mail} é": [mail],
        "4111111111111112 4111 1111 1111 1112": [],
    }
    rows = pii.pseudonymise(frame(list(texts)), KEY).orderBy("doc_id").collect()
    for (text, values), row in zip(texts.items(), rows, strict=True):
        assert sum(row[name] for name in VALUES) == len(values), text
        assert all(value not in row["text"] for value in values), text
        assert values or row["text"] == text


@pytest.mark.parametrize("form", ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "d.M.yyyy"])
def test_every_day_goes_out_and_comes_back(spark, form):
    days = spark.range(pii.DAYS).select(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")).alias("day"))
    if form == "MM/dd/yyyy":
        days = days.filter(F.dayofmonth("day") > 12)
    if form == "d.M.yyyy":
        days = days.filter(F.year("day") < 1940)
    days = days.select(F.date_format("day", form).alias("text"), F.col("day"))
    # Stored in between: the plan would repeat the first step wherever the second uses it.
    made = written(pii.pseudonymise(written(days, "days"), KEY), "pseudonyms")
    made = made.select("text", F.col("text").alias("out"), F.to_date("text", form).alias("made"), "day")
    back = pii.pseudonymise(made, KEY, inverse=True)
    row = back.agg(
        F.count("*").alias("n"),
        F.count_distinct("out").alias("distinct"),
        F.sum((F.to_date("text", form) == F.col("day")).cast("int")).alias("back"),
        F.min("made").alias("low"),
        F.max("made").alias("high"),
    ).first()
    n = days.count()
    assert (row["n"], row["distinct"], row["back"]) == (n, n, n)
    assert str(row["low"]) >= pii.FIRST_DAY and str(row["high"]) <= pii.LAST_DAY


def test_forms_of_dates(frame):
    texts = ["12/25/1999", "13/25/1999", "25/12/1999", "1999/02/30", "2001/02/03", "02/30/2001", "31.04.2001", "2.28.2001", "1/2/2003"]
    rows = pii.pseudonymise(frame(texts), KEY).orderBy("doc_id").collect()
    assert [r["n_date"] for r in rows] == [1, 0, 1, 0, 1, 0, 0, 1, 1]
    for text, row in zip(texts, rows, strict=True):
        assert (row["text"] == text) == (row["n_date"] == 0)
        assert [c for c in row["text"] if not c.isdigit()] == [c for c in text if not c.isdigit()]
    assert int(rows[0]["text"][3:5]) > 12 and int(rows[7]["text"].split(".")[1]) > 12

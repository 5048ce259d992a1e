"""Line deduplication within one edit, by a deletion-neighbourhood join; DataFrame operations only.

A line goes if an earlier line, by (document id, text hash, line number), equals
it or is one edit away (a character substituted, inserted or deleted). Steps:

* One row per distinct line: its text and its earliest place, one aggregate. All
  that follows works on distinct lines, however often each occurs.
* Neighbours: each distinct line stands for its *variants*, a position and what
  is left of the line there: the line without the character at that position,
  or the line itself as it would be left by deleting a character inserted
  there. Lines that share a variant are one edit apart at most, all of them, so
  the earliest line of a variant is all that the others need to know: one
  aggregate by hashed variant, no pairs. The found neighbour is then verified:
  what both leave at the variant's position is compared as text.

Emitting every variant of every line would be the line's length times its size.
A variant at a position within [lo, hi] fixes the characters before ``lo`` and
after ``hi``, so it can only be shared by lines that share these. Ranges are
narrowed, from the whole line to halves and then to eighths of what is left,
until they are short; only ranges that two lines share are narrowed further, and
at the end every variant within them is emitted. Nothing is lost: lines that
share a variant share every range around it. A range carries one hash of all
that lies outside it and the text inside, so that a round costs the text that is
left, not the line again.

A round shuffles hashes; its shared ones are found again by a key filter (sized
from their number; a semi join beyond its bound). A filter only passes too much,
so that hash collisions cost work, not results.

Defined results: lines are cut at line feeds. Equal lines of any length go but
the empty one, which stays; neighbours are looked for among lines of
``near_min_chars`` and more. Null and empty texts have no lines to remove and
stay as they are. Rows with one id are documents of their own, told apart by
their text, and null ids come before all others; rows equal in id and text are
one document listed several times, and lose the same lines. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.llm.common import fresh, written
from jobreview.operators.keyfilter import reduced

# A feature, not a cut for speed: one edit in a shorter line changes what it says.
NEAR_MIN_CHARS = 20
# Parts into which the first and every later round cuts a range, and the length
# of a range whose variants are all emitted.
FIRST_PARTS, PARTS, FINE = 2, 8, 16
PLACE = ("doc", "of", "no")


def _places(docs: DataFrame) -> DataFrame:
    """(doc, of, no, line, id_a, id_b) of every line that may go; ``docs``: doc,
    text. ``of`` is a hash of the text. Two hashes are the line's id: corpora
    hold more lines than one could tell apart."""
    lines = docs.select(
        "doc", F.xxhash64("text").alias("of"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")
    )
    lines = lines.filter(F.col("line") != "")
    return lines.select("*", F.xxhash64("line").alias("id_a"), F.xxhash64(F.lit(1), "line").alias("id_b"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(id_a, id_b, first, n, line): each distinct line, its earliest place and
    how many places it has."""
    return (
        _places(docs)
        .groupBy("id_a", "id_b")
        .agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    )


def _whole_ranges(lines: DataFrame) -> DataFrame:
    """Each line with one character ``gone``, and whole, as a range over all its
    positions. ``left`` is the length of what is left; positions go from 0 to it.
    ``inside`` is the text that the range covers: all of the line."""
    rows = lines.select("id_a", "id_b", F.col("line").alias("inside"), F.explode(F.array(F.lit(0), F.lit(1))).alias("gone"))
    left = F.length("inside") - F.col("gone")
    return rows.select("*", left.alias("lo"), (left + 1).alias("width"), F.xxhash64(left).alias("key")).withColumn("lo", F.lit(0))


def _cut(ranges: DataFrame, parts: int) -> DataFrame:
    """Each range of more than ``FINE`` positions in ``parts``; ``key`` takes in
    what the part leaves outside. Short ranges pass as they are."""
    long = F.col("width") > FINE
    rows = ranges.select("*", F.explode(F.sequence(F.lit(0), F.when(long, F.lit(parts - 1)).otherwise(0))).alias("k"))
    a = F.when(long, F.expr(f"cast(width * cast(k as long) div {parts} as int)")).otherwise(0)
    b = F.when(long, F.expr(f"cast(width * cast(k + 1 as long) div {parts} as int)")).otherwise(F.col("width"))
    rows = rows.withColumns({"a": a, "b": b})
    before, after = F.expr("substring(inside, 1, a)"), F.expr("substring(inside, b + gone)")
    return rows.select(
        "id_a",
        "id_b",
        "gone",
        (F.col("lo") + F.col("a")).alias("lo"),
        (F.col("b") - F.col("a")).alias("width"),
        F.xxhash64("key", F.col("lo") + F.col("a"), F.col("lo") + F.col("b"), before, after).alias("key"),
        F.expr("substring(inside, a + 1, b - a - 1 + gone)").alias("inside"),
    )


def _shared(ranges: DataFrame) -> DataFrame:
    """``ranges`` whose ``key`` two different lines have, and few others."""
    keys = ranges.groupBy("key").agg(F.min("id_a").alias("x"), F.max("id_a").alias("y")).filter("x != y")
    return reduced(ranges, written(keys.select("key"), "line-ranges"), ["key"])


def _variants(ranges: DataFrame) -> DataFrame:
    """(id_a, id_b, gone, p, key, key_b): one row for each position ``p`` of each range."""
    at = ranges.select("id_a", "id_b", "key", "gone", "lo", "inside", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("i"))
    p = F.col("lo") + F.col("i")
    rest = [p, F.expr("substring(inside, 1, i)"), F.expr("substring(inside, i + gone + 1)")]
    keys = F.xxhash64("key", *rest).alias("key"), F.xxhash64(F.lit(1), "key", *rest).alias("key_b")
    return at.select("id_a", "id_b", "gone", p.alias("p"), *keys)


def shared_ranges(lines: DataFrame) -> DataFrame:
    """The short ranges of ``lines`` that two lines share, and few others."""
    longest = lines.agg(F.max(F.length("line")).alias("n")).first()["n"] or 0
    ranges = _shared(_cut(_whole_ranges(lines), FIRST_PARTS))
    width = longest // FIRST_PARTS + 1
    while True:
        ranges = _shared(_cut(ranges, PARTS))
        if width <= FINE * PARTS:
            return ranges
        width = width // PARTS + 1
        ranges = written(ranges, "line-narrowed")


def neighbours(lines: DataFrame) -> DataFrame:
    """(id_a, id_b) of the lines one edit from an earlier one. ``lines``: as from
    ``distinct_lines``."""
    ranges = written(shared_ranges(lines.select("id_a", "id_b", "line")), "line-shared")
    variants = _variants(ranges)
    shared = variants.groupBy("key", "key_b").agg(F.min("id_a").alias("x"), F.max("id_a").alias("y"))
    shared = written(shared.filter("x != y").select("key", "key_b"), "line-variants")
    # Few lines are left that share a variant: they learn their places now.
    sharing = written(reduced(variants, shared, ["key", "key_b"]), "line-sharing")
    named = written(sharing.select("id_a", "id_b").distinct(), "line-named")
    texts = written(reduced(lines, named, ["id_a", "id_b"]).select("id_a", "id_b", "first", "line"), "line-texts")
    placed = sharing.join(texts.select("id_a", "id_b", "first"), ["id_a", "id_b"])
    best = F.min(F.struct("first", "id_a", "id_b", "gone")).alias("best")
    earliest = placed.groupBy("key", "key_b").agg(best)
    pairs = (
        placed.join(earliest, ["key", "key_b"])
        .filter(F.col("best.first") < F.col("first"))
        .groupBy("id_a", "id_b", F.col("best.id_a").alias("best_a"), F.col("best.id_b").alias("best_b"))
        .agg(F.min(F.struct("p", "gone", F.col("best.gone").alias("best_gone"))).alias("at"))
    )
    best_texts = texts.select(F.col("id_a").alias("best_a"), F.col("id_b").alias("best_b"), F.col("line").alias("best_line"))
    both = pairs.join(texts.select("id_a", "id_b", "line"), ["id_a", "id_b"]).join(best_texts, ["best_a", "best_b"])
    # Equal without the character there; an edit distance would take the product of the lengths.
    same = F.expr(
        "line != best_line AND substring(line, 1, at.p) = substring(best_line, 1, at.p) "
        "AND substring(line, at.p + 1 + at.gone) = substring(best_line, at.p + 1 + at.best_gone)"
    )
    return both.filter(same).select("id_a", "id_b").distinct()


def removed_lines(docs: DataFrame, near_min_chars: int = NEAR_MIN_CHARS) -> DataFrame:
    """(doc, of, no, near) of every line that goes. ``docs``: doc, text."""
    lines = written(distinct_lines(docs), "lines", codec="zstd")
    near = neighbours(lines.filter(F.length("line") >= near_min_chars)).withColumn("near", F.lit(True))
    near = written(near, "line-neighbours")
    # One row a line that goes somewhere, so AQE may split a hot line's places.
    judged = lines.drop("line").join(near, ["id_a", "id_b"], "left").filter("n > 1 OR near").select("id_a", "id_b", "first", "near")
    judged = written(judged, "line-judged")
    rows = reduced(_places(docs).drop("line"), judged, ["id_a", "id_b"]).join(judged, ["id_a", "id_b"])
    is_near = F.coalesce("near", F.lit(False))
    is_first = F.struct(*PLACE).eqNullSafe(F.col("first"))
    return rows.filter(is_near | ~is_first).select(*PLACE, is_near.alias("near"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_min_chars: int = NEAR_MIN_CHARS
) -> DataFrame:
    """``docs`` with its text free of repeated lines and two more columns,
    ``lines_removed`` and ``lines_left`` (names free in ``docs``: with
    underscores if taken)."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    removed, left, taken = fresh(docs, "lines_removed"), fresh(docs, "lines_left"), fresh(docs, "gone")
    doc, of = fresh(docs, "gone_doc"), fresh(docs, "gone_of")
    gone = removed_lines(slim, near_min_chars).groupBy(F.col("doc").alias(doc), F.col("of").alias(of))
    gone = gone.agg(F.collect_set("no").alias(taken))
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(of))
    rows = docs.join(gone, same, "left")
    lines = F.split(text, "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(taken))
    kept = F.array_join(F.transform(numbers, lambda no: F.get(lines, no)), "\n")
    n_lines = F.coalesce(F.when(text == "", 0).otherwise(F.size(lines)), F.lit(0))
    n_gone = F.coalesce(F.size(taken), F.lit(0))
    n_gone = F.when(F.col(taken).isNull(), 0).otherwise(n_gone)
    return rows.select(
        *[F.when(F.col(taken).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        n_gone.cast("long").alias(removed),
        (n_lines - n_gone).cast("long").alias(left),
    )


ORACLE = """
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS no, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
), p AS (SELECT * FROM l WHERE line <> ''
), u AS (SELECT line, min((doc_id, no)) AS first FROM p GROUP BY line
), v AS (
  SELECT line, first, i, substr(line, 1, i) || substr(line, i + 2) AS rest
  FROM (SELECT *, unnest(range(length(line))) AS i FROM u WHERE length(line) >= 20)
  UNION ALL
  SELECT line, first, i, line FROM (SELECT *, unnest(range(length(line) + 1)) AS i FROM u WHERE length(line) >= 20)
), e AS (SELECT md5(i || ' ' || rest) AS k, min(first) AS earliest FROM v GROUP BY ALL
), n AS (SELECT line, bool_or(earliest < first) AS near FROM v JOIN e ON e.k = md5(v.i || ' ' || v.rest) GROUP BY line
), g AS (
  SELECT p.doc_id, p.no FROM p JOIN u USING (line) LEFT JOIN n USING (line)
  WHERE coalesce(near, false) OR (p.doc_id, p.no) <> u.first
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE g.no IS NULL) AS text,
    count(g.no) AS lines_removed, count(*) - count(g.no) AS lines_left
  FROM l LEFT JOIN g USING (doc_id, no) GROUP BY l.doc_id
)
SELECT doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(lines_removed, 0) AS lines_removed,
  CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE lines_left END AS lines_left
FROM documents d LEFT JOIN k USING (doc_id)
"""

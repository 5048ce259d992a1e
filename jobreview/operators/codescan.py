"""Line-level scan of changed files for costly calls."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobreview.operators.keyfilter import reduced
from jobreview.session import staged

# The calls looked for and the advice on each.
RULES = {
    "df.toPandas()": (
        "toPandas() moves all the data to driver to convert the spark df to a pandas dataframe.\n\n"
        ' Instead use this statement df.withColumn("<newColumn>", lit("<constant_value>"))'
    ),
    "df.collect()": (
        "Avoid collecting all the data if we require only few rows of dataframe..\n\n"
        " Instead use this statement df.take(n)"
    ),
}
LINES_BEFORE = 3
INLINE_STATUS = 201


def changed_files(pull_requests: DataFrame) -> DataFrame:
    """``pr_id, commit_id, filename, text`` rows of the landed changed files."""
    return pull_requests.select("pr_id", "commit_id", "filename", "text")


def numbered_context(lines: Column, index: Column) -> Column:
    """The lines before the hit (``index`` from 0) and the hit, as ``"{n} {line}"``."""
    start = F.greatest(index - LINES_BEFORE, F.lit(0))
    return F.transform(
        F.slice(lines, start + 1, index - start + 1),
        lambda line, offset: F.concat((start + offset + 1).cast("string"), F.lit(" "), line),
    )


def code_hits(files: DataFrame, rules: Mapping[str, str] = RULES, text: str = "text") -> DataFrame:
    """One row per rule and matching line: ``pattern, advice, line, context``.

    The rules are a literal, so matching them needs no join: files without any
    pattern are filtered first, the others are split once, and only hits leave
    the line array.
    """
    literal_rules = F.array(
        *[
            F.struct(F.lit(pattern).alias("pattern"), F.lit(advice).alias("advice"))
            for pattern, advice in rules.items()
        ]
    )
    candidates = files.filter(reduce(or_, [F.col(text).contains(pattern) for pattern in rules]))
    kept = [name for name in files.columns if name != text]
    return candidates.select(*kept, F.inline(_file_hits(F.col(text), literal_rules)))


def _file_hits(source: Column, rules: Column) -> Column:
    """The hits of an array of rules in one text."""

    def rule_hits(lines: Column, rule: Column) -> Column:
        matching = F.array_compact(
            F.transform(
                lines, lambda line, index: F.when(F.contains(line, rule["pattern"]), index)
            )
        )
        return F.transform(
            matching,
            lambda index: F.struct(
                rule["pattern"].alias("pattern"),
                rule["advice"].alias("advice"),
                (index + 1).alias("line"),
                numbered_context(lines, index).alias("context"),
            ),
        )

    def file_hits(lines: Column) -> Column:
        present = F.filter(rules, lambda rule: F.contains(source, rule["pattern"]))
        return F.flatten(F.transform(present, lambda rule: rule_hits(lines, rule)))

    # A one-element array gives the split lines a name inside the expression;
    # otherwise each use would split the text again.
    split_once = F.array(F.split(source, "\n"))
    return F.flatten(F.transform(split_once, file_hits))


# Windows of up to seven bytes fit into a long together with their size.
GRAM = 7
# The most windows of rules that travel to the tasks: eight bytes each.
MAX_KNOWN = 1 << 20
# Positions of a batch of texts that are looked at together.
POSITIONS = 1 << 18


def _found_windows(data: np.ndarray, size: int, known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and codes of the windows of ``size`` bytes, of the ``known`` ones
    (sorted) only if they are given."""
    if known is not None:
        # A small table of bits passes over almost every other window.
        fold, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)
        bits = np.zeros(1 << 20, bool)
        bits[known * fold >> shift] = True
    for start in range(0, len(data) - size + 1, POSITIONS):
        part = data[start : start + POSITIONS + size - 1]
        n = len(part) - size + 1
        codes = np.full(n, size << 56, np.uint64)
        for i in range(size):
            codes |= part[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        places = np.arange(n) if known is None else np.flatnonzero(bits[codes * fold >> shift])
        if known is not None:
            at = np.minimum(np.searchsorted(known, codes[places]), len(known) - 1)
            places = places[known[at] == codes[places]]
        yield places + start, codes[places]


def text_grams(texts: pa.Array, sizes: Sequence[int], known: np.ndarray | None = None) -> pa.Array:
    """Per text its different windows of each of ``sizes`` bytes of UTF-8."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return pa.array([], pa.list_(pa.int64()))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets[1:] - offsets[0]
    rows, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in sizes:
        some = None if known is None else known[known >> np.uint64(56) == size]
        for places, found in _found_windows(data, size, some):
            row = np.searchsorted(ends, places, "right")
            inside = places + size <= ends[row]
            rows.append(row[inside])
            codes.append(found[inside])
    rows, codes = np.concatenate(rows), np.concatenate(codes).view(np.int64)
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    counts = np.bincount(rows[first], minlength=len(texts))
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(codes[first]))


def _grams(text: Column, sizes: Sequence[int], known: np.ndarray | None = None) -> Column:
    @F.arrow_udf("array<bigint>")
    def grams(texts: pa.Array) -> pa.Array:
        return text_grams(texts, sizes, known)

    return grams(text)


def code_hits_by_table(
    files: DataFrame,
    rules: DataFrame,
    text: str = "text",
    file_key: Sequence[str] = ("pr_id", "commit_id", "filename"),
    max_known: int = MAX_KNOWN,
) -> DataFrame:
    """``code_hits`` for a table of many rules: ``pattern, advice``.

    An index of n-grams finds the files in which a pattern may stand: of each
    pattern the n-gram (seven bytes, or the whole of a shorter pattern) that the
    fewest files hold is joined to the n-grams of the files. Only those files are
    searched, each for its own candidates. Texts are read once for their n-grams,
    and only those of some rule are kept: they travel to the tasks up to
    ``max_known``; beyond that a key filter does the same. Rules without a
    pattern match nothing. ``file_key`` tells files apart.
    """
    key = list(file_key)
    rules = staged(rules.select("pattern", "advice").filter(F.col("pattern") != "").distinct(), "rules")
    size = F.least(F.octet_length("pattern"), F.lit(GRAM))
    sizes = sorted(row["n"] for row in rules.select(size.alias("n")).distinct().collect())
    of_size = [F.when(size == n, _grams(F.when(size == n, F.col("pattern")), [n])) for n in sizes]
    grams = F.coalesce(*of_size, F.array().cast("array<bigint>"))
    of_rule = staged(rules.select("pattern", "advice", F.explode(grams).alias("gram")), "rule-grams")
    known = staged(of_rule.select("gram").distinct(), "grams")
    few = known.count() <= max_known
    codes = np.sort(known.toArrow().column("gram").to_numpy().view(np.uint64)) if few else None
    in_text = _grams(F.col(text), sizes, codes)
    of_file = files.select(*key, F.explode(in_text).alias("gram"))
    of_file = staged(of_file if few else reduced(of_file, known, ["gram"]), "file-grams")
    counts = of_file.groupBy("gram").count()
    counted = of_rule.join(counts, "gram", "left").fillna(0, ["count"])
    rarest = counted.groupBy("pattern", "advice").agg(F.min(F.struct("count", "gram")).alias("least"))
    # A gram that no file holds rules its patterns out.
    rarest = rarest.filter(F.col("least.count") > 0).select("pattern", "advice", F.col("least.gram").alias("gram"))
    rarest = staged(rarest, "rarest-grams")
    candidates = reduced(of_file, rarest.select("gram").distinct(), ["gram"]).join(rarest, "gram")
    rule = F.struct("pattern", "advice")
    candidates = candidates.groupBy(*key).agg(F.array_sort(F.collect_set(rule)).alias("_rules"))
    found = files.join(candidates, key)
    kept = [name for name in files.columns if name != text]
    return found.select(*kept, F.inline(_file_hits(F.col(text), F.col("_rules"))))


def review_comments(hits: DataFrame) -> DataFrame:
    """Comment records to post on a line of a changed file."""
    return hits.select(
        "pr_id",
        F.col("advice").alias("body"),
        F.col("filename").alias("path"),
        "commit_id",
        "line",
        "context",
    )


def code_block(context: Column) -> Column:
    """Fenced block of the context lines."""
    lines = F.array_join(F.transform(context, lambda line: F.concat(line, F.lit("\n"))), "")
    return F.concat(F.lit("\n```python\n"), lines, F.lit("```\n\n"))


def fallback_body(context: Column, advice: Column) -> Column:
    """Body of a comment that could not be placed on its line."""
    return F.concat(code_block(context), F.lit("\n\n"), advice)


def route_comments(comments: DataFrame, status: str = "status") -> DataFrame:
    """``delivery`` and final body by the status the inline attempt returned.

    Any status but 201, a missing one included, takes the fallback.
    """
    inline = F.coalesce(F.col(status) == INLINE_STATUS, F.lit(False))
    return comments.select(
        *[name for name in comments.columns if name not in ("body", "context")],
        F.when(inline, F.lit("inline")).otherwise(F.lit("fallback")).alias("delivery"),
        F.when(inline, F.col("body"))
        .otherwise(fallback_body(F.col("context"), F.col("body")))
        .alias("body"),
    )


def gate_by_runs(rows: DataFrame, resolved_runs: DataFrame) -> DataFrame:
    """Rows of pull requests with at least one resolved run.

    An inner join to distinct keys does what a semi join does, but stays above
    the scan: Spark pushes a semi join below it and would shuffle whole file
    texts instead of the hits. The keys grow with the runs: no broadcast.
    """
    reviewed = resolved_runs.select("pr_id").distinct().hint("merge")
    return rows.join(reviewed, "pr_id").select(*rows.columns)

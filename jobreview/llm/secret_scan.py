"""Secret scan: fixed patterns, and a battery of randomness tests for the rest.

Patterns give the base spans. Other tokens get an encoding inferred from their
characters and tests of "symbols are drawn evenly and independently from
that alphabet": chi-squared evenness (of symbols and of their classes), runs about the middle symbol, lag-one
serial correlation. The combined p-values of all tokens of a length class pass
one false-discovery procedure, which discards tokens that are *not* random
(words, paths, numbers in sequence); what it cannot discard is a secret. Longer
tokens give the tests more power, hence the classes.

Defined results: a null text counts as empty; empty texts have no spans; rows
are treated one by one, so repeated or null ids stay as they are; an empty
table gives an empty result; columns other than the id and the text are not
carried along.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.llm.common import small_batches, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
ASSIGN_HINTS = ("passw", "secret", "token", "api")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

MIN_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_TOKEN)
# Alphabets in the order of their symbols, the smallest that fits is inferred.
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_CLASSES = (str.isupper, str.islower, str.isdigit, lambda c: not c.isalnum())
P_BINS = 400
FDR = 0.01

CANDIDATE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("length_class", T.IntegerType()),
        T.StructField("p_bin", T.IntegerType()),
    ]
)
SCANNED = T.StructType(
    [
        T.StructField("n_assign", T.LongType(), False),
        T.StructField("n_access", T.LongType(), False),
        T.StructField("n_hex", T.LongType(), False),
        T.StructField("base_sha256", T.StringType(), False),
        T.StructField(
            "base",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.IntegerType()),
                        T.StructField("kind", T.IntegerType()),
                        T.StructField("end", T.IntegerType()),
                    ]
                )
            ),
            False,
        ),
        T.StructField("candidates", T.ArrayType(CANDIDATE), False),
    ]
)


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet holding the token; None where it looks like words:
    without a digit, or one case of letters broken by separators only."""
    symbols = set(token)
    if not symbols & set(_DIGITS):
        return None
    for name, alphabet in ALPHABETS.items():
        if symbols <= set(alphabet):
            return None if name == "decimal" else name
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def _chi2_tail(chi2: float, df: int) -> float:
    """Upper tail (Wilson-Hilferty)."""
    if chi2 <= 0:
        return 1.0
    return _normal_tail(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def evenness_p(values: list[int], size: int) -> float:
    """Whether all symbols of the alphabet are drawn evenly."""
    n = len(values)
    return _chi2_tail(sum(c * c for c in Counter(values).values()) * size / n - n, size - 1)


def classes_p(token: str, alphabet: str) -> float:
    """The same for upper case, lower case, digits and marks: few counts, so
    that short tokens tell words from random letters."""
    counts, sizes = ([sum(kind(c) for c in s) for kind in _CLASSES] for s in (token, alphabet))
    expected = [len(token) * size / len(alphabet) for size in sizes]
    terms = [(c - e) ** 2 / e for c, e in zip(counts, expected, strict=True) if e]
    return _chi2_tail(sum(terms), len(terms) - 1) if len(terms) > 1 else 1.0


def runs_p(values: list[int], size: int) -> float:
    """Two-sided runs test about the middle of the alphabet."""
    high = [2 * v >= size for v in values]
    n1 = sum(high)
    n2 = len(high) - n1
    if not n1 or not n2:
        return 2.0 ** (1 - len(high))
    n = n1 + n2
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 2 * n1 * n2 / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * _normal_tail(abs(runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial_p(values: list[int]) -> float:
    """Two-sided test of the lag-one correlation."""
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if not spread:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / spread
    return 2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n))


def battery(token: str) -> float | None:
    """The combined p-value (the least of four, times four), None without an
    inferred encoding."""
    body = token.rstrip("=")
    name = infer_encoding(body)
    if name is None:
        return None
    alphabet = ALPHABETS[name]
    values = [alphabet.index(c) for c in body]
    size = len(alphabet)
    tests = (evenness_p(values, size), classes_p(body, alphabet), runs_p(values, size), serial_p(values))
    return min(1.0, 4 * min(tests))


def length_class(n: int) -> int:
    """Two classes for each doubling of the length."""
    return int(2 * math.log2(n))


def p_bin(p: float) -> int:
    """Tenths of the decimal logarithm, from 0 for p = 1."""
    return P_BINS if p < 10 ** (-P_BINS / 10) else min(P_BINS, math.floor(-10 * math.log10(p)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern match that is long enough, sorted."""
    spans = []
    if ":" in text or "=" in text:
        lowered = text.lower()
        if any(hint in lowered for hint in ASSIGN_HINTS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    if LONG_HEX.search(text):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens clear of every base span, with their tests."""
    found = []
    for m in TOKEN.finditer(text):
        if any(start < m.end() and m.start() < end for start, _, end in base):
            continue
        p = battery(m[0])
        if p is not None:
            found.append(
                {
                    "start": m.start(),
                    "end": m.end(),
                    "length_class": length_class(len(m[0].rstrip("="))),
                    "p_bin": p_bin(p),
                }
            )
    return found


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            counts = Counter(kind for _, kind, _ in base)
            rows.append(
                {
                    "n_assign": counts[0],
                    "n_access": counts[1],
                    "n_hex": counts[2],
                    "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(),
                    "base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
                    "candidates": candidates(text, base),
                }
            )
        columns = [batch.column(0)]
        columns += [pa.array([row[f.name] for row in rows], f.type) for f in list(schema)[1:]]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def scan_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and tested tokens of every text, in one pass over the texts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = T.StructType([T.StructField("id", slim.schema["id"].dataType), *SCANNED.fields])
    schema = to_arrow_schema(out)
    return slim.mapInArrow(lambda batches: _scan(batches, schema), out)


def discarded_from(counts: list[tuple[int, int, int]], level: float = FDR) -> dict[int, int]:
    """Per length class, the smallest p-bin whose tokens are discarded.

    ``counts``: (length class, bin, tokens). Benjamini-Hochberg on the grid of
    bins: the largest p that is at most ``level`` times the share of tokens at
    or below it. A class without an entry discards nothing.
    """
    by_class: dict[int, dict[int, int]] = {}
    for cls, b, n in counts:
        by_class.setdefault(cls, {})[b] = n
    limits = {}
    for cls, bins in by_class.items():
        total, below = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            below += bins[b]
            if 10 ** (-b / 10) <= level * below / total:
                limits[cls] = b
    return limits


def _limit(limits: dict[int, int], cls: Column) -> Column:
    value = F.lit(P_BINS + 1)
    for key, b in limits.items():
        value = F.when(cls == key, F.lit(b)).otherwise(value)
    return value


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: float = FDR
) -> DataFrame:
    """One row per document: its base spans, and the tokens the tests leave as
    random. The false-discovery step reads token counts by length class and
    p-bin, a table bounded by the two grids, over all documents."""
    scanned = written(scan_texts(docs, id_col, text_col), "secrets")
    token = F.explode("candidates").alias("token")
    counts = scanned.select(token).groupBy("token.length_class", "token.p_bin").count().collect()
    limits = discarded_from([tuple(row) for row in counts], level)
    kept = F.filter("candidates", lambda c: c["p_bin"] < _limit(limits, c["length_class"]))
    random = F.transform(
        kept, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))
    )
    names = F.array(*[F.lit(kind) for kind in KINDS])
    spans = F.transform(
        F.array_sort(F.concat("base", random)),
        lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return scanned.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("found")
    )


def spans_text(found: Column) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    parts = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")

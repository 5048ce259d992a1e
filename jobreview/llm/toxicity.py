"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Fit on a bounded, hash-ordered sample of the labelled rows that may be learned
from (``MAX_TRAIN_ROWS``): two fifths give the learned lexicon, two fifths the
trees, one fifth the calibration, so that no part judges rows it has seen. The
features of a text are lexicon densities (a fixed list, learned words, learned
word beginnings), nearness of the hits to a second person, capitals,
punctuation and obfuscation rates. Scoring is row by row over all texts.

Defined results: null and empty texts have all features zero and get a score
like any other; equal texts get equal scores; a document id with several labels
counts as toxic if one says so, null labels are left out; without labels of
both kinds every score is the share of toxic labels (0 without any); empty
tables give empty results; ids and other columns never enter a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.llm.common import fresh, small_batches, written

MAX_TRAIN_ROWS = 20_000
MAX_TERMS = 3_000
MIN_TERM_DOCS = 4
MIN_LOG_ODDS = 1.5
BEGINNING = 5
THRESHOLD = 0.7

INSULTS = frozenset(
    "asshole bastard bitch clown coward crap creep cretin damn disgusting dumb filth fool freak "
    "garbage hate idiot idiotic imbecile jerk kill liar loser moron nasty pathetic pig scum shit "
    "sick stupid suck sucks terrible trash ugly useless vermin weirdo worthless".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself youre u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch tú "
    "ti usted ustedes vosotros tuyo su".split()
)
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_]+[0-9@$*!|]+[^\W_][\w@$*!|]*")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l", "!": "i", "*": ""})
NEAR = 5
WINDOW = 50
FEATURES = (
    "insults", "learned_words", "learned_beginnings", "log_hits", "densest_window", "log_odds", "near_second_person",
    "second_person", "capitals", "capital_words", "punctuation", "shouts", "obfuscated", "obfuscated_insults", "log_words",
)


@dataclass
class Lexicon:
    """Learned words and word beginnings with their log odds."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    base_rate: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def terms_of(text: str | None) -> set[str]:
    """Distinct words, and beginnings marked by a trailing hyphen."""
    words = set(WORD.findall((text or "").lower()))
    return words | {word[:BEGINNING] + "-" for word in words if len(word) > BEGINNING}


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    learned, begins = lexicon.words, lexicon.beginnings
    insults = sum(w in INSULTS for w in words)
    known = [i for i, w in enumerate(words) if w in learned]
    begun = [i for i, w in enumerate(words) if len(w) > BEGINNING and w[:BEGINNING] in begins]
    hits = sorted({*known, *begun, *(i for i, w in enumerate(words) if w in INSULTS)}) if insults or known or begun else []
    odds = sum(learned[words[i]] for i in known) + sum(begins[words[i][:BEGINNING]] for i in begun)
    densest = left = 0
    for right, at in enumerate(hits):
        while at - hits[left] >= WINDOW:
            left += 1
        densest = max(densest, right - left + 1)
    seconds = sum(w in SECOND_PERSON for w in words)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits) if seconds else 0
    masked = MASKED.findall(text)
    plain = [m.lower().translate(PLAIN) for m in masked]
    letters = sum(map(len, words))
    upper = sum(c.isupper() for c in text) if not text.islower() else 0
    marks = len(text) - letters - text.count(" ") - text.count("\n")
    shouts = text.count("!") + text.count("?")
    loud = len(re.findall(r"\b[A-Z]{3,}\b", text)) if upper else 0
    return [
        insults / n,
        len(known) / n,
        len(begun) / n,
        math.log1p(len(hits)),
        float(densest),
        odds / math.sqrt(n),
        near / (1 + len(hits)),
        seconds / n,
        upper / max(1, letters),
        loud / n,
        marks / len(text),
        shouts / n,
        len(masked) / n,
        sum(p in INSULTS or p in learned for p in plain) / n,
        math.log1p(len(words)),
    ]


def features_table(
    docs: DataFrame, lexicon: Lexicon, keep: Sequence[str], text_col: str = "text", name: str = "features"
) -> DataFrame:
    """The columns ``keep`` and the features as an array."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    slim = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    kept = [T.StructField(f"k{i}", slim.schema[f"k{i}"].dataType) for i in range(len(keep))]
    out = T.StructType([*kept, T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features_of(text, lexicon) for text in batch.column("text").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, schema.field("features").type)], schema=schema)

    done = slim.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("features").alias(name))


def held_out(doc_id: Column) -> Column:
    """The rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_ids(labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(id, toxic, fold 0 to 4) of at most ``max_rows`` labelled rows, by hash order."""
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )
    return ids.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5)).cast("int"))


def learn_lexicon(sample: DataFrame, toxic: int, clean: int, max_terms: int = MAX_TERMS) -> Lexicon:
    """Terms of toxic documents by smoothed log odds; ``sample``: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, marks = [], []
            for text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = terms_of(text)
                terms += found
                marks += [mark] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(marks, pa.int32())], ["term", "toxic"])

    counts = (
        sample.mapInArrow(run, "term string, toxic int")
        .groupBy("term")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter(F.col("t") >= MIN_TERM_DOCS)
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    best = (
        counts.withColumn("odds", odds)
        .filter(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.col("odds").desc(), F.col("t").desc(), "term")
        .limit(max_terms)
        .collect()
    )
    lexicon = Lexicon()
    for row in best:
        if row["term"].endswith("-"):
            lexicon.beginnings[row["term"][:-1]] = row["odds"]
        else:
            lexicon.words[row["term"]] = row["odds"]
    return lexicon


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> ToxicityModel:
    """``labels``: doc_id, toxic (0 or 1). The sample's ids are broadcast: they
    are bounded by ``max_rows``."""
    ids = written(training_ids(labels, max_rows), "toxic-ids")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sample = texts.join(F.broadcast(ids), "id").select("text", "toxic", "fold")
    # Labels count where their document is there.
    found = texts.select("id").join(F.broadcast(ids), "id").groupBy("fold", "toxic").count().collect()
    folds = {(r["fold"], r["toxic"]): r["count"] for r in found}
    rows = sum(folds.values())
    base_rate = sum(n for (_, toxic), n in folds.items() if toxic) / rows if rows else 0.0
    model = ToxicityModel(Lexicon(), base_rate)
    if not 0 < base_rate < 1:
        return model
    parts = [(0, 1), (2, 3), (4,)]
    counts = [[sum(folds.get((f, y), 0) for f in part) for y in (0, 1)] for part in parts]
    if min(min(c) for c in counts) < 2:  # too few labels to divide
        parts = [(0, 1, 2, 3, 4)] * 3
        counts = [[sum(c) for c in zip(*counts, strict=True)]] * 3
    lexicon_part, trees_part, calibration_part = (F.col("fold").isin(*part) for part in parts)
    model.lexicon = learn_lexicon(sample.filter(lexicon_part).select("text", "toxic"), counts[0][1], counts[0][0])
    rows = written(features_table(sample, model.lexicon, ["toxic", "fold"]).coalesce(4), "toxic-train")
    rows = rows.select(array_to_vector("features").alias("vector"), F.col("toxic").cast("double").alias("toxic"), "fold")
    trees = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=30, maxDepth=3, maxBins=64, stepSize=0.2, seed=7, minInstancesPerNode=5
    )
    model.trees = trees.fit(rows.filter(trees_part))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="toxic")
    model.calibration = calibration.fit(_raw(model, rows.filter(calibration_part), "vector", "raw"))
    if model.trees.numClasses != 2 or not model.trees.trees:
        model.trees = None
    return model


def _raw(model: ToxicityModel, rows: DataFrame, vector: str, out: str) -> DataFrame:
    """The trees' own probability; their other columns do not stay."""
    trees = model.trees.copy()
    trees.setFeaturesCol(vector)
    names = [fresh(rows, f"toxicity_{kind}") for kind in ("raw", "probability", "prediction")]
    trees.setRawPredictionCol(names[0]).setProbabilityCol(names[1]).setPredictionCol(names[2])
    scored = trees.transform(rows).withColumn(out, vector_to_array(names[1])[1])
    return scored.drop(*names)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """The columns ``keep`` and the calibrated score of every row."""
    if model.trees is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(float(model.base_rate)).alias(score_col))
    features = fresh(docs, "toxicity_features")
    vector, raw, fitted = (fresh(docs, f"toxicity_{name}") for name in ("vector", "raw_score", "fitted"))
    rows = features_table(docs, model.lexicon, keep, text_col, features).withColumn(vector, array_to_vector(features))
    scored = _raw(model, rows, vector, raw)
    calibration = model.calibration.copy()
    calibration.setFeaturesCol(raw).setPredictionCol(fitted)
    bounded = F.least(F.greatest(F.col(fitted), F.lit(0.0)), F.lit(1.0))
    return calibration.transform(scored).select(*[F.col(f"`{c}`") for c in keep], bounded.alias(score_col))

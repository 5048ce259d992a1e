"""SentencePiece encoding and decoding of whole tables, with seeded merge-dropout.

Defined results: a null text has null pieces, an empty one none, both count as
lossless; equal rows get equal pieces; a null id counts as the text ``null`` in
the key of the draws; empty tables give empty results. ``keep`` names columns
of the input that go along; a new column whose name they take gets an underscore.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobreview.llm.common import fresh, small_batches
from jobreview.llm.pieces import PieceModel, SegmentCache, decode_ids, encode_texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
OUTPUT = [
    T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("n_pieces", T.LongType(), False),
    T.StructField("n_bytes", T.LongType(), False),
    T.StructField("lossless", T.BooleanType(), False),
]


def document_key(doc_id: object) -> int:
    """Stable across processes, for the draws of one document."""
    digest = hashlib.blake2b(str("null" if doc_id is None else doc_id).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little")


def encode_table(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    dropout: float = 0.1,
    seed: int = 0,
    variants: int | None = None,
    model_path: str = MODEL_PATH,
) -> DataFrame:
    """The columns ``keep``, then ``piece_ids``, their number, the text's bytes,
    and whether the pieces decode to exactly these bytes (all are checked). The
    model file is read once, on the driver, and sent along (about 10 MB)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    model = PieceModel.load(model_path)  # travels with the function below
    slim = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    kept = [T.StructField(f"k{i}", slim.schema[f"k{i}"].dataType) for i in range(len(keep))]
    out = T.StructType([*kept, *OUTPUT])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = SegmentCache()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            doc_keys = [document_key(i) for i in batch.column("id").to_pylist()]
            ids, counts = encode_texts(model, texts, doc_keys, dropout, seed, variants, cache)
            decoded = decode_ids(model, ids, counts)
            raw = [(text or "").encode() for text in texts]
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            absent = pa.array([text is None for text in texts])
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(ids.astype(np.int32)), type=schema.field("piece_ids").type, mask=absent
            )
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [
                lists,
                pa.array(counts),
                pa.array([len(b) for b in raw], pa.int64()),
                pa.array([a == b for a, b in zip(raw, decoded, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    pieces = slim.mapInArrow(run, out)
    return pieces.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col(field.name).alias(fresh(docs.select(*keep), field.name)) for field in OUTPUT],
    )


def decode_table(
    pieces: DataFrame,
    ids_col: str = "piece_ids",
    text_col: str = "text",
    model_path: str = MODEL_PATH,
) -> DataFrame:
    """``pieces`` with the texts that the ids stand for; null ids give null.
    Ids that end within a character decode to the replacement character."""
    spark = pieces.sparkSession
    small_batches(spark)
    model = PieceModel.load(model_path)  # travels with the function below

    @F.pandas_udf("string")
    def texts(column):
        lists = [[] if v is None else v for v in column]
        counts = np.array([len(v) for v in lists], np.int64)
        ids = np.concatenate([np.asarray(v, np.int64) for v in lists]) if lists else np.zeros(0, np.int64)
        decoded = [b.decode("utf-8", "replace") for b in decode_ids(model, ids, counts)]
        return column.__class__([None if v is None else t for v, t in zip(column, decoded, strict=True)], dtype=object)

    return pieces.withColumn(text_col, texts(F.col(f"`{ids_col}`")))

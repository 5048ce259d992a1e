"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobreview.session import scratch_dir

# A word of the contracts: a run of anything but ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: it cuts the
    lineage, and a lost executor costs no more than the reader's own tasks.
    ``codec``: how to compress it, where it holds most of the input's text."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    writer = df.write.option("compression", codec) if codec else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def words(text: Column) -> Column:
    """The words of a text, in order; none for an empty or null text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.filter(parts, lambda word: word != "")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows: texts are long, and a Python worker holds
    one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# A filter of 2**23 bits is a table of at most 2**17 rows, whatever it is made of.
FILTER_BITS = 1 << 23


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(FILTER_BITS))


def bit_filter(keys: DataFrame, key: str, purpose: str) -> DataFrame:
    """(word, bits): one bit for each value of the long column ``key``. The
    table is bounded by ``FILTER_BITS``, and combined before the shuffle."""
    slots = keys.select(_slot(F.col(key)).alias("slot"))
    rows = slots.select(
        F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit")
    )
    return written(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")), purpose)


def may_hold(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the filter, and some others: all of them if
    the filter is full. The filter is broadcast; its size is bounded."""
    found = rows.join(F.broadcast(bits), F.shiftright(_slot(F.col(key)), 6) == bits["word"])
    bit = F.expr(f"shiftright(bits, cast(pmod({key}, {FILTER_BITS}) % 64 as int)) & 1L")
    return found.filter(bit == 1).drop("word", "bits")


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 500):
    """Arrow batches of few rows for the jobs run inside: texts are long, and a
    Python worker holds one batch at a time. The session's setting comes back."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


# ASCII capitals to small letters, as a table over bytes.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def pieces_of(data: bytes, cut: bytes, size: int = 1 << 22):
    """``data`` in pieces of about ``size`` bytes, each ended before a ``cut``."""
    start = 0
    while start < len(data):
        end = data.find(cut, start + size) if len(data) - start > size else -1
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end

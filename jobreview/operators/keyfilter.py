"""Rows whose key may be in a set of keys, before a costly step or a join.

A Bloom filter as a small table: its rows are words of 64 bits; a key chooses one
word by its hash and a few bits of that word by further hashes. The filter is
sized from the number of keys, and broadcast, up to a size that is fixed; beyond
it the rows go through an ordinary semi join, so that there is always a way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sixteen bits a key and four of them set let about one foreign key in 150 pass.
KEYS_PER_WORD = 4
BITS_PER_KEY = 4
# The most words that are broadcast: two longs each.
MAX_WORDS = 1 << 20


@dataclass(frozen=True)
class KeyFilter:
    """``words``: word number and its bits; only words that hold a key."""

    words: DataFrame
    n_words: int


def _hash(columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(7), *[F.col(f"`{name}`") for name in columns])


def _mask(hashed: Column) -> Column:
    """A long with ``BITS_PER_KEY`` bits set (fewer if two fall on one)."""
    mask = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        at = F.shiftrightunsigned(hashed, 40 + 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def words_for(n_keys: int) -> int:
    """Words of a filter for so many keys: a power of two."""
    return 1 << max(0, (max(1, n_keys) - 1) // KEYS_PER_WORD).bit_length()


def key_filter(
    keys: DataFrame, columns: Sequence[str], n_keys: int, max_words: int = MAX_WORDS
) -> KeyFilter | None:
    """The filter of ``keys``, of which there are at most about ``n_keys``; None
    if it would need more than ``max_words`` words."""
    n_words = words_for(n_keys)
    if n_words > max_words:
        return None
    hashed = keys.dropna(subset=list(columns)).select(_hash(columns).alias("_hash"))
    words = hashed.select(
        F.pmod("_hash", F.lit(n_words)).alias("_word"), _mask(F.col("_hash")).alias("_mask")
    )
    return KeyFilter(words.groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), n_words)


def may_hold(rows: DataFrame, columns: Sequence[str], kept: KeyFilter) -> DataFrame:
    """The rows whose key is in the filter, and a few others. NULL keys go."""
    hashed = rows.dropna(subset=list(columns)).withColumn("_hash", _hash(columns))
    slot = F.pmod("_hash", F.lit(kept.n_words))
    found = hashed.join(F.broadcast(kept.words), slot == F.col("_word"))
    mask = _mask(F.col("_hash"))
    return found.filter(F.col("_bits").bitwiseAND(mask) == mask).select(
        *[F.col(f"`{name}`") for name in rows.columns]
    )


def reduced(
    rows: DataFrame,
    keys: DataFrame,
    columns: Sequence[str],
    n_keys: int | None = None,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``; none whose key
    is there is lost. ``keys`` is read up to twice: pass a stored table."""
    kept = key_filter(keys, columns, keys.count() if n_keys is None else n_keys, max_words)
    if kept is None:
        return rows.join(keys.select(*columns), list(columns), "left_semi").select(
            *[F.col(f"`{name}`") for name in rows.columns]
        )
    return may_hold(rows, columns, kept)

"""Reproducible train/test split.

``randomSplit`` depends on partitioning and row order; a hash of the row key does
not: the same rows land in the test set on any cluster size, after a retry, and
in DuckDB. ``md5(key || '-' || seed)`` read as a 32-bit fraction below
``test_size`` marks a test row. A NULL key hashes like the empty text.

``exact_split`` marks exactly ceil(test_size * n) rows: those with the smallest hashes. The
last one is found by radix selection: one aggregate counts the rows by the hash's first four
digits, the next by four digits more inside the group that holds it, until a group is
taken whole. No row is sorted; only rows with equal hashes (equal keys) are numbered.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.ordinal import row_positions

TEST_SIZE = 0.3  # fixed values: 70/30 split, seed 42
SEED = 42


def _threshold(test_size: float) -> str:
    return format(int(test_size * 0xFFFFFFFF), "08x")


def _hash(key: str | Column, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f"-{seed}")))


def is_test(key: str | Column, test_size: float = TEST_SIZE, seed: int = SEED) -> Column:
    """True for test rows, never NULL. For 0.3 the cut is the hex prefix ``4ccccccc``."""
    return F.substring(_hash(key, seed), 1, 8) < F.lit(_threshold(test_size))


def hash_split(df: DataFrame, key: str | Column, test_size: float = TEST_SIZE,
               seed: int = SEED, name: str = "is_test") -> DataFrame:
    """Add the boolean ``is_test`` column (keep one DataFrame, no join)."""
    return df.withColumn(name, is_test(key, test_size, seed))


def train_test(df: DataFrame, key: str | Column, test_size: float = TEST_SIZE,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) DataFrames."""
    flag = is_test(key, test_size, seed)
    return df.where(~flag), df.where(flag)


#: Hex digits that one pass of the selection counts by: at most 16 ** DIGITS rows reach the driver.
DIGITS, WIDTH = 4, 32


def _last_taken(rows: DataFrame, h: str, take: int) -> tuple[str, int | None]:
    """(prefix, rest): rows whose hash begins below ``prefix`` are taken, and of those that begin
    with it all (None) or ``rest``."""
    prefix = ""
    for width in range(DIGITS, WIDTH + 1, DIGITS):
        inside = rows.where(F.col(h).startswith(prefix)) if prefix else rows
        counts = sorted(map(tuple, inside.groupBy(F.substring(h, 1, width).alias("p")).agg(F.count(F.lit(1))).collect()))
        for prefix, n in counts:
            if n >= take:
                break
            take -= n
        if n == take:
            return prefix, None
    return prefix, take


def exact_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED, name: str = "is_test") -> DataFrame:
    """``is_test`` on exactly ceil(test_size * n) rows, those with the smallest hashes of
    ``key``. Rows that share the last hash are chosen by a hash of all their columns."""
    n = df.count()
    take = -(-n * Fraction(str(test_size)) // 1)
    if not take:
        return df.withColumn(name, F.lit(False))
    h, tie, at = "_split_hash", "_split_row", "_split_at"
    rows = df.withColumn(h, _hash(key, seed))
    prefix, rest = _last_taken(rows.select(h), h, int(take))
    head = F.substring(h, 1, len(prefix))
    if rest is None:
        return rows.withColumn(name, head <= F.lit(prefix)).drop(h)
    out = rows.where(F.col(h) != prefix).withColumn(name, F.col(h) < F.lit(prefix)).drop(h)
    tied = row_positions(rows.where(F.col(h) == prefix).withColumn(tie, F.xxhash64(*df.columns)), [tie], at)
    return out.unionByName(tied.withColumn(name, F.col(at) < rest).drop(h, tie, at))

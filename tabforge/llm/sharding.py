"""Sharding by a Feistel permutation over global row numbers.

Row i of n (global order: doc_id, then checksum and size of the text) moves to place
``P(i)``; its shard is ``P(i) mod shards`` and its slot ``P(i) div shards``. ``P`` is a
Feistel network on pairs (l, r) below ``a = ceil(sqrt(n))``, so it permutes ``a * a``
places; a place beyond ``n`` is sent through the network again (cycle walking) until it
falls inside. Shard counts differ by at most one, slots are gapless, and the place of any
row number can be computed - or inverted - without looking at other rows.

Only DataFrame functions: the numbering is one range-bucketed window over three narrow
columns, and the permutation is integer arithmetic in generated code.

Defined results: NULL texts are empty (size 8, checksum 0); a NULL doc_id sorts first;
repeated rows get different places; an empty table gives an empty result; only the named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.ordinal import row_positions
from tabforge.session import materialize

ROUNDS = 6
#: Fixed odd multipliers of the round function (any odd 31-bit numbers do).
MIX_A, MIX_B, MIX_MOD = 1103515245, 668265263, 2_147_483_648


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Keys of the rounds from the seed (a linear congruential step each)."""
    out, x = [], seed % MIX_MOD
    for _ in range(rounds):
        x = (x * MIX_A + 12345) % MIX_MOD
        out.append(x)
    return out


def _mix(r: Column, key: Column) -> Column:
    """31-bit mixing; all products stay below 2^62."""
    x = ((r % F.lit(MIX_MOD)) * F.lit(MIX_A) + key) % F.lit(MIX_MOD)
    x = x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(MIX_B) % F.lit(MIX_MOD)
    return x.bitwiseXOR(F.shiftright(x, 13))


def _walk(place: Column, a: int, n: int, keys: list[int]) -> Column:
    """Cycle walking for a place outside 0..n-1. The network permutes a*a places, so a
    walk meets each of the a*a - n outside places at most once and then is inside."""
    def step(x: Column) -> Column:
        pair = F.struct(F.floor(x / F.lit(a)).cast("long").alias("l"), (x % F.lit(a)).alias("r"))
        fed = F.aggregate(
            F.array(*[F.lit(k).cast("long") for k in keys]), pair,
            lambda p, k: F.struct(p["r"].alias("l"), ((p["l"] + _mix(p["r"], k)) % F.lit(a)).alias("r")))
        return fed["l"] * F.lit(a) + fed["r"]

    steps = F.sequence(F.lit(1), F.lit(max(1, a * a - n)))
    return F.aggregate(steps, place, lambda x, _: F.when(x < F.lit(n), x).otherwise(step(x)))


def permute(df: DataFrame, index: str, n: int, out: str, seed: int = 42) -> DataFrame:
    """Adds ``out``: the place of row number ``index`` in a keyed permutation of 0..n-1."""
    if n <= 0:
        return df.withColumn(out, F.col(index))
    keys = round_keys(seed)
    a = max(1, math.isqrt(n - 1) + 1)
    # one projection per round: each round's halves are named once, not expanded
    cur = df.withColumns({"_fl": F.floor(F.col(index) / F.lit(a)).cast("long"), "_fr": F.col(index) % F.lit(a)})
    for k in keys:
        cur = cur.withColumns({"_fl": F.col("_fr"), "_fr": (F.col("_fl") + _mix(F.col("_fr"), F.lit(k))) % F.lit(a)})
    place = F.col("_fl") * F.lit(a) + F.col("_fr")
    return (cur.withColumn("_place", place)
            .withColumn(out, F.when(F.col("_place") < F.lit(n), F.col("_place"))
                        .otherwise(_walk(F.col("_place"), a, n, keys)))
            .drop("_fl", "_fr", "_place"))


def place_of(i: int, n: int, seed: int = 42) -> int:
    """The same permutation for one row number (reference for tests and lookups)."""
    a, keys = max(1, math.isqrt(n - 1) + 1), round_keys(seed)
    x = i
    while True:
        left, r = divmod(x, a)
        for k in keys:
            m = (r % MIX_MOD * MIX_A + k) % MIX_MOD
            m = (m ^ (m >> 15)) * MIX_B % MIX_MOD
            m ^= m >> 13
            left, r = r, (left + m) % a
        x = left * a + r
        if x < n:
            return x


def shard(docs: DataFrame, shards: int, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), text_crc32, row_number, place, shard, slot."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))
    rows = materialize(rows, "shard-rows")  # three narrow columns: the texts are read once
    n = rows.count()
    numbered = row_positions(rows, ["doc_id", "text_crc32", "size"], "row_number")
    return (permute(numbered, "row_number", n, "place", seed)
            .withColumns({"shard": (F.col("place") % shards).cast("int"),
                          "slot": F.floor(F.col("place") / F.lit(shards)).cast("long")}))

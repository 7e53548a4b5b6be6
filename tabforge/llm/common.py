"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the operators' contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of ``text`` as UTF-8. ``bytes.split`` splits on exactly the six
    characters space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for added columns that clash with none of ``taken`` (case-insensitively)."""
    used = {c.lower() for c in taken}
    out = []
    for w in wanted:
        while w.lower() in used:
            w += "_"
        used.add(w.lower())
        out.append(w)
    return out


def n_words(text: Column) -> Column:
    """Number of words (0 for NULL)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_in_groups(df: DataFrame, groups: Sequence[str], order: Sequence[Column], spread: Column,
                     out: str, buckets: int = 64) -> DataFrame:
    """1-based rank of each row inside its group, for groups that may hold most rows.

    A group is dealt over ``buckets`` by ``spread`` (a deterministic hash expression of
    the row); rows rank by (bucket, ``order``). A window ranks inside (group, bucket),
    and the few (group, bucket) counts give each bucket's offset, so no task gets a
    whole hot group. The result is a function of the rows alone."""
    b, n, off, rn = free_names(df.columns, "_b", "_n", "_off", "_rn")
    rows = df.withColumn(b, F.pmod(spread, F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*groups, b).agg(F.count(F.lit(1)).alias(n))
               .withColumn(off, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n))
    renamed = [f"{c}__o" for c in (*groups, b)]
    offsets = offsets.select(*[F.col(c).alias(r) for c, r in zip((*groups, b), renamed)], off)
    on = None
    for c, r in zip((*groups, b), renamed):
        eq = F.col(c).eqNullSafe(F.col(r))
        on = eq if on is None else on & eq
    ranked = rows.withColumn(rn, F.row_number().over(Window.partitionBy(*groups, b).orderBy(*order)))
    return (ranked.join(offsets, on, "left")
            .select(*df.columns, (F.col(rn) + F.col(off)).cast("long").alias(out)))

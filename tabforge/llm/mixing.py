"""Mixing sources to target weights by subset-sum budget fitting.

1. Targets: ``share`` x all words are dealt to the sources by weight; a source stops at
   ``max_epochs`` times its own words and what it cannot take goes to the others by
   weight (water filling: the level is found with running sums, not by iteration).
2. A source's target is whole epochs of everything plus a remaining budget below one
   epoch. The budget is filled exactly where the lengths allow it: documents are counted
   by exact length, every length first gives its proportional count, then a bounded
   knapsack over the unused counts decides the rest.
3. Documents are chosen by length count: the seeded order inside (source, length) fills
   the count.

Scale: texts are read once (a narrow table of doc_id, source, size is written); the
knapsack works on the histogram (source, length) - at most one row per distinct length -
one source per task; its arrays are bounded by DP_LENGTHS times the longest document.
Choosing inside a hot (source, length) is spread over hash buckets.

Defined results: NULL text has size 0 and is never taken; a NULL source is a source, last
in order; repeated rows are chosen one by one; an empty table gives an empty result; a
source without words has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import free_names, n_words, ranked_in_groups
from tabforge.operators.ordinal import ordered_cumsum, row_positions
from tabforge.session import materialize

#: The knapsack's budget is at most this many times the longest document.
DP_LENGTHS = 4
#: Hash buckets of a (source, length), and most plan rows sent by broadcast.
RANK_BUCKETS, MAX_PLAN_ROWS = 64, 500_000


def bounded_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is as near to ``budget`` as it
    can be without passing it (at most ``counts`` of each; lengths > 0, distinct).

    ``first[s]`` is the index of the length that first reached the sum s and ``used[s]``
    how many of it that took; sums reached earlier never change, so walking back from
    the best sum meets each length at most once."""
    first = np.full(budget + 1, -1, dtype=np.int64)
    used = np.zeros(budget + 1, dtype=np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        fresh = reached
        for k in range(1, min(count, budget // length) + 1):
            new = np.zeros_like(reached)
            new[length:] = fresh[:-length]
            new &= ~reached
            at = np.flatnonzero(new)
            if not len(at):
                break
            first[at], used[at] = i, k
            reached = reached | new
            fresh = new
            if reached[budget]:
                break
        if reached[budget]:
            break
    out = np.zeros(len(lengths), dtype=np.int64)
    s = int(np.flatnonzero(reached)[-1])
    while s:
        i = first[s]
        out[i] += used[s]
        s -= int(used[s] * lengths[i])
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Counts by length whose words sum to (nearly) ``budget`` <= all words: the
    proportional share of every length, then the longest that fit until the rest is a
    few documents, then the knapsack."""
    total = int((lengths * counts).sum())
    rest = int(round(budget))
    if rest <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if rest >= total:
        return counts.copy()
    take = (counts.astype(object) * rest // total).astype(np.int64)
    rest -= int((take * lengths).sum())
    down = np.argsort(-lengths, kind="stable")
    room = DP_LENGTHS * int(lengths.max())
    for i in down:
        if rest <= room:
            break
        k = min(int(counts[i] - take[i]), (rest - room) // int(lengths[i]) + 1, rest // int(lengths[i]))
        take[i] += k
        rest -= k * int(lengths[i])
    if rest > 0:
        order = [i for i in down if lengths[i] <= rest and counts[i] > take[i]]
        if order:
            take[order] += bounded_knapsack(lengths[order], (counts - take)[order], rest)
    return take


def source_targets(sizes: DataFrame, weight: Column, share: float | None, max_epochs: float) -> DataFrame:
    """(source, source_size) -> also position (by source, NULL last), weight, target.
    ``share`` None deals out the sum of the weights.

    ``weight`` may use ``position`` and ``source_size``. Targets are
    min(max_epochs * size, level * weight); the level is the largest, over the sources
    sorted by size per weight, of (what is left without the smaller ones) / (weight left)."""
    src = sizes.withColumn("_isnull", F.col("source").isNull().cast("int"))
    src = row_positions(src, ["_isnull", "source"], "position").drop("_isnull")
    src = src.withColumn("weight", weight.cast("double")).withColumns({
        "cap": F.col("source_size") * F.lit(float(max_epochs))})
    src = materialize(src.withColumn("ratio", F.col("cap") / F.col("weight")), "mix-sources")
    sums = src.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not sums["n"]:
        return src.withColumn("target", F.lit(0.0)).drop("cap", "ratio")
    budget = float(share) * sums["n"] if share is not None else float(sums["w"])
    run = ordered_cumsum(src, ["ratio", "position"], {"cap_to": "cap", "w_to": "weight"})
    left = (F.lit(budget) - (F.col("cap_to") - F.col("cap")))
    level = run.agg(F.max(F.try_divide(left, F.lit(sums["w"]) - (F.col("w_to") - F.col("weight")))).alias("l")).first()["l"]
    return (src.withColumn("target", F.least(F.col("cap"), F.lit(float(level)) * F.col("weight")))
            .drop("cap", "ratio"))


def mix(docs: DataFrame, weight: Column, share: float | None = 1.5, max_epochs: int = 2, seed: int = 42,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken: a document is taken whole
    0 .. max_epochs ``times``; ``taken`` counts its words as often."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                   n_words(F.col(text)).alias("size")), "mix-sizes")
    times = F.col("epochs") + (F.col("rank") <= F.col("chosen")).cast("int")
    return (_ranked(rows, weight, share, max_epochs, seed)
            .select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"),
                    (times * F.col("size")).cast("long").alias("taken")))


def _order(seed: int, doc_id: Column, size: Column) -> tuple[Column, Column]:
    """Seeded order inside a (source, length): hash bucket, then hash."""
    order = F.xxhash64(F.lit(seed), doc_id, size)
    return F.pmod(F.shiftrightunsigned(order, 20), F.lit(RANK_BUCKETS)).cast("int"), order


def _ranked(rows: DataFrame, weight: Column, share: float | None, max_epochs: int, seed: int) -> DataFrame:
    """Rows (doc_id, source, size) with their rank in the seeded order of (source, size)
    and the plan of that length: source_size, target, epochs, chosen."""
    hist = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    targets = source_targets(sizes, weight, share, max_epochs)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        pdf = pdf.sort_values("size")
        epochs = min(int(target // total), max_epochs) if total else 0
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        chosen = np.zeros(len(pdf), dtype=np.int64)
        some = lengths > 0
        if total and epochs < max_epochs:
            chosen[some] = fit_counts(lengths[some], counts[some], target - epochs * total)
        return pdf.assign(epochs=epochs, chosen=chosen)[["source", "size", "source_size", "target", "epochs", "chosen"]]

    plan = (hist.join(targets, hist["source"].eqNullSafe(targets["source"])).drop(targets["source"])
            .groupBy("position").applyInPandas(
                fit, "source string, size long, source_size long, target double, epochs int, chosen long"))
    plan = materialize(plan, "mix-plan").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"),
                                                "source_size", "target", "epochs", "chosen")
    bucket, order = _order(seed, F.col("doc_id"), F.col("size"))
    ranked = ranked_in_groups(rows.withColumn("order", order), ["source", "size"], [F.col("order"), F.col("doc_id")],
                              F.shiftrightunsigned(F.col("order"), 20), "rank", RANK_BUCKETS)
    return ranked.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left")


def repeat(docs: DataFrame, epochs: Column, max_epochs: int = 2, seed: int = 42, doc_id: str = "doc_id",
           text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents themselves, all columns kept: a row is there as often as it is
    taken, rows without words once. A source's weight is ``epochs`` (of ``position``) times
    its own size, and the weights are the targets.

    The plan is one row per (source, length) - epochs, and the last taken place in the
    seeded order - so a row finds its copies from its own columns. The plan goes along by
    broadcast up to MAX_PLAN_ROWS rows and is joined by shuffle beyond. Rows that agree in
    doc_id, source and size are taken alike."""
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                   n_words(F.col(text)).alias("size")), "mix-sizes")
    ranked = _ranked(rows, epochs * F.col("source_size"), None, max_epochs, seed)
    bucket, order = _order(seed, F.col("doc_id"), F.col("size"))
    last = F.max(F.when(F.col("rank") <= F.col("chosen"), F.struct(bucket.alias("b"), order.alias("o"))))
    plan = materialize(ranked.groupBy("source", "size").agg(F.max("epochs").alias("epochs"), last.alias("last")), "mix-copies")
    names = free_names(docs.columns, "_p_source", "_p_size", "_epochs", "_last", "_size", "_copy")
    p_source, p_size, p_epochs, p_last, size, copy = names
    plan = plan.toDF(p_source, p_size, p_epochs, p_last)
    bucket, order = _order(seed, F.col(doc_id), F.col(size))
    place = F.struct(bucket.alias("b"), order.alias("o"))
    times = F.coalesce(F.col(p_epochs) + (place <= F.col(p_last)).cast("int"), F.col(p_epochs))
    on = F.col(source).eqNullSafe(F.col(p_source)) & (F.col(size) == F.col(p_size))
    return (docs.withColumn(size, n_words(F.col(text)))
            .join(F.broadcast(plan) if plan.count() <= MAX_PLAN_ROWS else plan, on, "left")
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.when(F.col(size) == 0, 1).otherwise(times))))
            .select(*docs.columns))


def weights_by_position(pattern: tuple[float, ...] = (3, 1, 2)) -> Column:
    """The weight of the source at ``position`` in a repeating pattern."""
    return F.element_at(F.array(*[F.lit(float(p)) for p in pattern]), (F.col("position") % len(pattern) + 1).cast("int"))



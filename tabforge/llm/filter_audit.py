"""Filter interaction audit: what each filter removes, for every order of the filters.

Each document gets a mask of the filters it fails. Per part (source) the masks are counted,
and the counts become a decision diagram: one level per filter, a low edge for documents
that pass it and a high edge for those that fail, equal sub-diagrams shared, every node
weighted with its documents (all, good, toxic). Swapping two adjacent levels rewrites only
the nodes of these levels; a sequence of adjacent swaps visits every order. In each order
the all-pass path (low edges from the root) yields the steps: the high child's weight is
what the step removes, the low child's is what it keeps.

Filter E (exact copies) compares whole texts of the whole table by SHA-256. A document
passes if its doc_id is the smallest of its text, found by a join on (doc_id, digest): a
text with any number of copies is one aggregated row, never a group in a task. Documents
leave the row level pre-aggregated (part, mask), so a part holding most rows is at most
2^filters rows; one diagram is built per part.

Defined results: a NULL text is empty; a NULL source is the part ''; a NULL doc_id is never
smaller than another and has no smaller one, so it passes E; rows repeating a doc_id and
its text are no copies of each other (neither id is smaller) and each count; labels that repeat a
doc_id count as good (toxic) if any of them does; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.session import materialize

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))


# ---- failure masks ------------------------------------------------------------------------
def text_mask(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters A to D that the text fails, and its SHA-256."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split separates at exactly the six ASCII white-space characters
    fails = (len(words) < MIN_WORDS,
             100 * len(set(words)) < DISTINCT_PERCENT * len(words),
             100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text or ""),
             SYMBOLS.search(raw) is not None)
    return sum(f << i for i, f in enumerate(fails)), hashlib.sha256(raw).digest()


def failure_masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): documents by id, part and failure mask (bit i = filter i)."""
    @F.pandas_udf("mask int, digest binary")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_mask(t) for t in texts], columns=["mask", "digest"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"),
                      judge(F.col(text)).alias("j"))
    narrow = materialize(src.select("doc_id", "part", "j.mask", "j.digest"), "audit-masks")
    firsts = (narrow.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
              .withColumn("first", F.lit(True)))
    rows = narrow.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (rows.join(firsts, ["doc_id", "digest"], "left")
            .withColumn("mask", F.col("mask") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
            .groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``masks``, with ``labels`` (doc_id, quality, toxic)."""
    any_one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(any_one("quality").alias("good"), any_one("toxic").alias("toxic"))
    weight: list[Column] = [F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "toxic")]
    return masks.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *weight)


# ---- decision diagrams ----------------------------------------------------------------------
Weight = tuple[int, ...]


def _add(a: Weight, b: Weight) -> Weight:
    return tuple(x + y for x, y in zip(a, b))


class Diagram:
    """A count-weighted decision diagram over ``n`` variables, every level present. Level i
    tests variable ``order[i]``; a node is a number with a low child (0: pass), a high child
    (1: fail) and a weight; two nodes of one level never have the same children."""

    def __init__(self, n: int, counts: Mapping[int, Weight]):
        self.order = list(range(n))
        self.low: dict[int, int] = {}
        self.high: dict[int, int] = {}
        self.weight: list[Weight] = []
        self._levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        zero = (0,) * len(next(iter(counts.values())))
        leaves: dict[Weight, int] = {}
        row = []
        for path in range(1 << n):  # the first variable is the path's highest bit
            w = counts.get(sum(1 << v for v in range(n) if path >> (n - 1 - v) & 1), zero)
            if w not in leaves:
                leaves[w] = len(self.weight)
                self.weight.append(w)
            row.append(leaves[w])
        for level in reversed(range(n)):
            row = [self._node(level, row[i], row[i + 1]) for i in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, level: int, low: int, high: int) -> int:
        found = self._levels[level].get((low, high))
        if found is None:
            found = self._levels[level][(low, high)] = len(self.weight)
            self.low[found], self.high[found] = low, high
            self.weight.append(_add(self.weight[low], self.weight[high]))
        return found

    def swap(self, level: int) -> None:
        """Exchanges the variables of ``level`` and ``level + 1``. Nodes of ``level`` keep their
        numbers (their documents stay the same), so levels above need no change."""
        upper, old = self._levels[level], self._levels[level + 1]
        self._levels[level], self._levels[level + 1] = {}, {}
        for (a, b), node in upper.items():
            low = self._node(level + 1, self.low[a], self.low[b])
            high = self._node(level + 1, self.high[a], self.high[b])
            self.low[node], self.high[node] = low, high
            self._levels[level][(low, high)] = node
        for node in old.values():
            del self.low[node], self.high[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Weight, Weight]]:
        """(variable, kept, removed) along the all-pass path."""
        out, node = [], self.root
        for v in self.order:
            out.append((v, self.weight[self.low[node]], self.weight[self.high[node]]))
            node = self.low[node]
        return out


def adjacent_swaps(n: int) -> Iterator[int]:
    """Positions of adjacent swaps that lead through all n! orders, each once (the plain
    changes of bell ringers): the last item walks through every order of the others."""
    if n < 2:
        return
    down = True
    inner = adjacent_swaps(n - 1)
    while True:
        yield from (range(n - 2, -1, -1) if down else range(n - 1))
        try:
            at = next(inner)
        except StopIteration:
            return
        # the others move while the walking item is at the front (then shifted by one) or the back
        yield at + 1 if down else at
        down = not down


def audit_counts(counts: Mapping[int, Weight], filters: Sequence[str]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for all orders of ``filters``; ``counts``: mask -> (n, good, toxic)."""
    n = len(filters)
    diagram = Diagram(n, counts)
    paths = [(tuple(diagram.order), diagram.steps())]
    for at in adjacent_swaps(n):
        diagram.swap(at)
        paths.append((tuple(diagram.order), diagram.steps()))
    fails, alone, shapley = {}, {}, dict.fromkeys(range(n), 0)
    for order, steps in paths:
        fails[order[0]] = steps[0][2][0]  # first in line: removes all that fail it
        alone[order[-1]] = steps[-1][2][0]  # last in line: removes those that fail nothing else
        for v, _, gone in steps:
            shapley[v] += gone[0]
    return [("".join(filters[v] for v in order), i + 1, kept[0], gone[0], fails[v] - gone[0], alone[v], gone[1], gone[2], shapley[v])
            for order, steps in paths for i, (v, kept, gone) in enumerate(steps)]


COLUMNS = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order and step, from ``mask_counts``."""
    def per_part(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(pdf["mask"], pdf["n"], pdf["good"], pdf["toxic"])}
        out = pd.DataFrame(audit_counts(cells, filters), columns=COLUMNS)
        out.insert(0, "part", pdf["part"].iloc[0])
        return out

    longs = ", ".join(f"{c} long" for c in COLUMNS[2:])
    return counts.groupBy("part").applyInPandas(per_part, f"part string, filter_order string, step int, {longs}")

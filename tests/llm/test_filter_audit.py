"""Filter audit against applying the filters one after another."""

from itertools import permutations
from math import factorial

import pandas as pd

from tabforge.llm import filter_audit as A


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for at in A.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == factorial(n)


def plain(cells, filters):
    docs = [(m, w) for m, w in cells.items()]
    rows = {}
    for order in permutations(range(len(filters))):
        left = docs
        for i, v in enumerate(order):
            gone = [(m, w) for m, w in left if m >> v & 1]
            left = [(m, w) for m, w in left if not m >> v & 1]
            removed = sum(w[0] for _, w in gone)
            rows["".join(filters[x] for x in order), i + 1] = [
                sum(w[0] for _, w in left), removed, sum(w[0] for m, w in docs if m >> v & 1) - removed,
                cells.get(1 << v, (0, 0, 0))[0], sum(w[1] for _, w in gone), sum(w[2] for _, w in gone)]
    total = dict.fromkeys(filters, 0)
    for (order, step), r in rows.items():
        total[order[step - 1]] += r[1]
    return {k: tuple(r + [total[k[0][k[1] - 1]]]) for k, r in rows.items()}


def test_diagram_equals_plain_filters():
    import random
    rnd = random.Random(3)
    for n in (1, 2, 3, 5):
        for density in (0.2, 1.0):
            cells = {m: (rnd.randrange(9), rnd.randrange(3), rnd.randrange(2)) for m in range(1 << n) if rnd.random() < density}
            cells = cells or {0: (1, 0, 0)}
            got = {r[:2]: r[2:] for r in A.audit_counts(cells, "ABCDE"[:n])}
            assert got == plain(cells, "ABCDE"[:n])


def test_equal_subdiagrams_are_shared():
    same = A.Diagram(5, {m: (1, 0, 0) for m in range(32)})
    assert len(same.weight) == 6  # one node a level and one leaf
    assert same.weight[same.root] == (32, 0, 0)


LONG = " ".join(f"w{i}" for i in range(300))


def test_masks_on_edge_rows(spark):
    rows = [(1, LONG, "s", 9), (2, LONG, "s", 9), (2, LONG, "s", 9), (3, None, None, 9), (4, "", "s", 9), (None, LONG, "", 9),
            (5, "A# " * 250, "s", 9), (6, "x" * 2_000_000, "t", 9), (7, "word " * 300_000, "t", 9), (None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part long")
    got = {(r.doc_id, r.part): (r.mask, r.n) for r in A.failure_masks(docs).collect()}
    # 3 and 4 both hold the empty text; E is bit 4
    assert got == {(1, "s"): (0, 1), (2, "s"): (16, 2), (3, ""): (1, 1), (4, "s"): (1 | 16, 1), (None, ""): (0, 1),
                   (5, "s"): (2 | 4 | 8, 1), (6, "t"): (1, 1), (7, "t"): (2, 1)} | {(None, ""): got[None, ""]}
    nulls = sorted((r.mask, r.n) for r in A.failure_masks(docs).where("doc_id IS NULL").collect())
    assert nulls == [(0, 1), (1, 1)]


def test_audit_counts_labels_and_zeros(spark):
    docs = spark.createDataFrame([(1, LONG, "s"), (2, LONG, "s"), (3, "few", None), (1, "few words", "s")],
                                 "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    counts = A.mask_counts(A.failure_masks(docs), labels)
    out = A.audit(counts).toPandas()
    assert len(out) == 2 * 120 * 5 and sorted(out["part"].unique()) == ["", "s"]
    row = out[(out.part == "s") & (out.filter_order == "EABCD")].set_index("step")
    assert row["removed"].tolist() == [1, 1, 0, 0, 0] and row["kept"].tolist() == [2, 1, 1, 1, 1]
    assert row["good_lost"].tolist() == [1, 1, 0, 0, 0] and row["toxic_lost"].tolist() == [1, 0, 0, 0, 0]
    assert (out.groupby("part")["shapley"].sum() / 120).tolist() == [removed_in_all(out, p) for p in ("", "s")]
    assert A.audit(counts.limit(0)).count() == 0


def removed_in_all(out: pd.DataFrame, part: str) -> float:
    # every order removes the same documents in all; each (order, step) row repeats its filter's shapley
    return float(out[out.part == part].groupby("filter_order")["removed"].sum().sum())

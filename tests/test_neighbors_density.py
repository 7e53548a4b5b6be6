import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.operators import density, hierarchy, neighbors


def _brute_knn(tr, q, k):
    out = {}
    for qi, qv in q:
        d = sorted((float(np.linalg.norm(np.array(qv) - np.array(tv))), ti, tl) for ti, tv, tl in tr)
        out[qi] = d[:k]
    return out


@pytest.mark.parametrize("rings", [1, 16])
def test_knn_exact(spark, rings):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(160, 3))
    pts[:40] += 4.0
    tr = [(i, [float(x) for x in pts[i]], int(i % 3)) for i in range(120)]
    q = [(i, [float(x) for x in pts[i]]) for i in range(120, 160)]
    t_df = spark.createDataFrame(tr, "id long, vec array<double>, label long")
    q_df = spark.createDataFrame(q, "id long, vec array<double>")
    nb = neighbors.knn(t_df, q_df, 5, rings=rings)
    got = {}
    for r in nb.collect():
        got.setdefault(r.q_id, []).append((r.rank, r.t_id))
    want = _brute_knn(tr, q, 5)
    for qi, lst in want.items():
        assert [t for _, t in sorted(got[qi])] == [t for _, t, _ in lst]
    v = {r.q_id: r.y_pred for r in neighbors.vote(nb).collect()}
    for qi, lst in want.items():
        labels = [lb for _, _, lb in lst]
        best = sorted(set(labels), key=lambda x: (-labels.count(x), x))[0]
        assert v[qi] == best


def test_k_value_curve_self_included(spark):
    pts = [(i, [float(i), 0.0], i % 2) for i in range(20)]
    df = spark.createDataFrame(pts, "id long, vec array<double>, label long")
    nb = neighbors.knn(df, df.select("id", "vec"), neighbors.k_max_for(20))
    truth = df.select(F.col("id").alias("q_id"), F.col("label").alias("y_true"))
    curve = {r.k: r.accuracy for r in neighbors.k_value_curve(nb, truth, 9).collect()}
    assert curve[1] == 1.0 and len(curve) == 9


def test_dbscan_rings(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(0, 0.05, size=(30, 2))
    b = rng.normal(0, 0.05, size=(30, 2)) + [1.0, 0.0]
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(np.vstack([a, b]))]
    rows.append((100, [5.0, 5.0]))                      # noise
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = {r.id: r.cluster for r in density.dbscan(df, "id", "v", eps=0.3, min_samples=5).collect()}
    assert out[100] == -1
    assert len({out[i] for i in range(30)}) == 1 and len({out[i] for i in range(30, 60)}) == 1
    assert out[0] == 0 and out[30] == 1


def test_dbscan_border_takes_lowest_cluster(spark):
    left = [(i, [0.0 + 0.01 * i, 0.0]) for i in range(5)]
    right = [(10 + i, [1.0 + 0.01 * i, 0.0]) for i in range(5)]
    border = [(99, [0.52, 0.0])]        # within eps of both groups' edges, not core
    df = spark.createDataFrame(left + right + border, "id long, v array<double>")
    out = {r.id: (r.cluster, r.is_core) for r in density.dbscan(df, "id", "v", eps=0.485, min_samples=5).collect()}
    assert out[99] == (0, False)


def test_ward_two_groups(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 0.1, size=(40, 2)), rng.normal(5, 0.1, size=(40, 2))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    labels, link = hierarchy.ward(df, "id", "v", 2)
    lab = {r.id: r.cluster for r in labels.collect()}
    assert len({lab[i] for i in range(40)}) == 1 and len({lab[i] for i in range(40, 80)}) == 1
    assert lab[0] != lab[40]
    assert link.count() == 79
    d = [r.distance for r in link.orderBy("step").collect()]
    assert all(x <= y + 1e-9 for x, y in zip(d, d[1:]))


def _brute_dbscan(pts, eps, min_samples):
    """Reference-order DBSCAN on a small list (index order = id order)."""
    n = len(pts)
    P = np.array(pts)
    nb = [np.where(np.sqrt(((P - P[i]) ** 2).sum(1)) <= eps)[0] for i in range(n)]
    core = [len(x) >= min_samples for x in nb]
    lab = [-1] * n
    c = 0
    for i in range(n):
        if not core[i] or lab[i] != -1:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            for k in nb[j]:
                if lab[k] == -1:
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return lab


def test_dbscan_hot_duplicates_match_bruteforce(spark):
    rng = np.random.default_rng(11)
    pts = [[0.5, 0.5]] * 60 + [list(map(float, p)) for p in rng.uniform(0, 2, size=(120, 2))]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {r.id: r.cluster for r in density.dbscan(df, "id", "v", eps=0.15, min_samples=5).collect()}
    want = _brute_dbscan(pts, 0.15, 5)
    # same partition into clusters and same noise (numbering by smallest core id)
    assert [got[i] for i in range(len(pts))] == want


def test_dbscan_high_dim_fallback(spark):
    rng = np.random.default_rng(12)
    a = rng.normal(0, 0.05, size=(20, 5))
    b = rng.normal(0, 0.05, size=(20, 5)) + 3
    pts = [list(map(float, p)) for p in np.vstack([a, b])] + [[9.0] * 5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {r.id: r.cluster for r in density.dbscan(df, "id", "v", eps=0.5, min_samples=5).collect()}
    assert [got[i] for i in range(len(pts))] == _brute_dbscan(pts, 0.5, 5)


def test_ward_rounds_equal_one_merge_at_a_time(spark, monkeypatch):
    """Blocks of 16 force several distributed rounds before the last task."""
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, [float(x) for x in pts[i]]) for i in range(90)], "id long, v array<double>")
    size, cent, want = np.ones(90), pts.copy(), []
    live = list(range(90))
    while len(live) > 1:
        d, a, b = min((np.sqrt(2 * size[a] * size[b] / (size[a] + size[b])) * np.linalg.norm(cent[a] - cent[b]), a, b)
                      for i, a in enumerate(live) for b in live[i + 1:])
        cent[a], size[a] = (cent[a] * size[a] + cent[b] * size[b]) / (size[a] + size[b]), size[a] + size[b]
        live.remove(b)
        want.append(d)
    monkeypatch.setattr(hierarchy, "BLOCK", 16)
    labels, link = hierarchy.ward(df, "id", "v", 3, leaves=None)
    rows = sorted(link.collect())
    assert [r.step for r in rows] == list(range(89)) and rows[-1]["size"] == 90
    assert np.allclose([r.distance for r in rows], want)
    assert sorted(x for r in rows for x in (r.left, r.right)) == list(range(90 + 88))
    assert len({r.cluster for r in labels.collect()}) == 3 and labels.count() == 90


def test_knn_with_one_crowded_ring(spark, monkeypatch):
    """Many rings, a third of the rows in one of them, and fewer rows per salt than that."""
    monkeypatch.setattr(neighbors, "SALT_ROWS", 10)
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.normal(size=(100, 3)) * 5, np.ones((60, 3)) + rng.normal(size=(60, 3)) * 1e-3])
    rows = [(i, [float(x) for x in p], i % 2) for i, p in enumerate(pts)]
    t = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    got = {}
    for r in neighbors.knn(t, t.select("id", "vec"), 4, rings=64).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.t_id))
    want = _brute_knn([(i, v, y) for i, v, y in rows], [(i, v) for i, v, _ in rows], 4)
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i, _ in v] for q, v in want.items()}


def test_block_nearest_ties_and_far_offsets():
    """Products only rule rows out: ties to the smaller number, also far from zero."""
    rng = np.random.default_rng(4)
    for offset in (0.0, 1e6):
        t = rng.integers(0, 4, size=(300, 5)).astype(float) + offset
        q = rng.integers(0, 4, size=(40, 5)).astype(float) + offset
        r = rng.permutation(300)
        place, number, dist = neighbors.block_nearest(q, t, r, 7)
        for i in range(40):
            d = np.sqrt(((t - q[i]) ** 2).sum(axis=1))
            want = sorted(zip(d, r))[:7]
            assert list(zip(dist[place == i], number[place == i])) == want


def test_knn_copies_form_no_pairs(spark, monkeypatch):
    """Only k of a vector's copies, and each query vector once, enter the search."""
    seen = {}
    search = neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda q, t, *a: seen.update(q=q.count(), t=t.count()) or search(q, t, *a))
    rows = [(i, [float(i % 3), 1.0], i % 2) for i in range(300)]
    t = spark.createDataFrame(rows, "id long, vec array<double>, label long")
    got = {}
    for r in neighbors.knn(t, t.select("id", "vec"), 4).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.t_id))
    assert seen == {"q": 3, "t": 12}
    assert all([i for _, i in sorted(v)] == [q % 3 + 3 * j for j in range(4)] for q, v in got.items()) and len(got) == 300


def test_dbscan_copies_in_many_dimensions(spark, monkeypatch):
    """Copies are merged before pairs are formed; labels are those of plain DBSCAN."""
    pairs = {}
    plain = density.neighbour_pairs
    monkeypatch.setattr(density, "neighbour_pairs", lambda df, *a: pairs.setdefault("out", plain(df, *a)))
    pts = [[0.1 * (i % 4), 0.0, 0.0, 1.0] for i in range(80)] + [[5.0, 0.0, 0.0, float(i)] for i in range(3)] + [[9.0, 9.0, 9.0, 9.0]] * 5
    df = spark.createDataFrame(list(enumerate(pts)), "id long, v array<double>")
    got = {r.id: r.cluster for r in density.dbscan(df, "id", "v", eps=0.15, min_samples=5).collect()}
    assert [got[i] for i in range(len(pts))] == _brute_dbscan(pts, 0.15, 5)
    assert pairs["out"].count() == 10 + 3 + 1


def test_ward_nearest_rows_by_products():
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.integers(0, 3, size=(200, 4)).astype(float), rng.normal(size=(200, 4)) + 1e5])
    n, ids = rng.integers(1, 9, size=400).astype(float), np.sort(rng.choice(5000, 400, replace=False))
    near = hierarchy.nearest_rows((ids, n, c), (ids, n, c))
    for k in range(400):
        d = np.sqrt(2 * n[k] * n / (n[k] + n)) * np.sqrt(((c - c[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        assert (near["d"][k], near["other"][k]) == (d.min(), ids[np.argmin(d)])

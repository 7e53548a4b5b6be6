"""Ward over clusters whose lists of nearest ones come from several tasks and run out."""

import numpy as np
import pytest

from tabforge.operators import hierarchy


def one_by_one(pts):
    """(distance, the rows below) of each merge, one closest pair at a time."""
    n = len(pts)
    size, cent, live, out = np.ones(n), pts.copy(), np.ones(n, dtype=bool), []
    below = {i: {i} for i in range(n)}
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for _ in range(n - 1):
        a, b = divmod(int(np.argmin(d)), n)
        out.append((d[a, b], frozenset(below[a] | below[b])))
        cent[a], size[a] = (cent[a] * size[a] + cent[b] * size[b]) / (size[a] + size[b]), size[a] + size[b]
        below[a], live[b] = below[a] | below.pop(b), False
        d[b], d[:, b] = np.inf, np.inf
        row = np.sqrt(2 * size[a] * size / (size[a] + size)) * np.sqrt(((cent - cent[a]) ** 2).sum(axis=1))
        row[~live] = row[a] = np.inf
        d[a], d[:, a] = row, row
    return out


def merges(link, n):
    below, out = {i: {i} for i in range(n)}, []
    for r in sorted(link.collect()):
        below[n + r.step] = below[r.left] | below[r.right]
        assert r["size"] == len(below[n + r.step])
        out.append((r.distance, frozenset(below[n + r.step])))
    return out


@pytest.mark.parametrize("block", [4096, 200])
def test_lists_and_rounds_make_the_same_tree(spark, monkeypatch, block):
    """Many dimensions, close copies and hubs; 200: rounds first. Before, 1,025 clusters were rounds of Spark jobs."""
    rng = np.random.default_rng(17)
    pts = rng.normal(size=(220, 16)) * rng.uniform(0.3, 2, size=(220, 1))
    pts = np.concatenate([pts, pts[:80] + rng.normal(size=(80, 16)) * 0.01])
    monkeypatch.setattr(hierarchy, "BLOCK", block)
    monkeypatch.setattr(hierarchy, "LEAST_ROWS", 100)
    monkeypatch.setattr(hierarchy, "NEAR", 3)
    written, real = [], hierarchy.materialize
    monkeypatch.setattr(hierarchy, "materialize", lambda df, name: written.append(name) or real(df, name))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    labels, link = hierarchy.ward(df, "id", "v", 4, leaves=None)
    got, want = merges(link, 300), one_by_one(pts)
    assert np.allclose([d for d, _ in got], [d for d, _ in want]) and {x for _, x in got} == {x for _, x in want}
    assert len({r.cluster for r in labels.collect()}) == 4
    assert ("ward-merged" in written) == (block == 200)


def test_lists_bound_what_they_leave_out():
    rng = np.random.default_rng(3)
    c, n = rng.normal(size=(500, 6)), rng.integers(1, 40, size=500).astype(float)
    places, bound = hierarchy.near_lists(n, c, n, c, np.arange(500), 5)
    for i in range(500):
        d = 2 * n[i] * n / (n[i] + n) * ((c - c[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert list(places[i]) == list(np.argsort(d, kind="stable")[:5])
        assert bound[i] <= np.sort(d)[5] * (1 + 1e-12) and bound[i] >= np.sort(d)[4] * (1 - 1e-12)


def test_distances_that_are_not_finite(spark):
    df = spark.createDataFrame([(i, [float(i), float("nan") if i == 3 else 1.0]) for i in range(6)], "id long, v array<double>")
    with pytest.raises(Exception, match="distances are not finite"):
        hierarchy.ward(df, "id", "v", 2, leaves=None)

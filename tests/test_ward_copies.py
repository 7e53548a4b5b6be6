"""Ward linkage of tables with groups of equal rows."""

import numpy as np

from tabforge.operators import hierarchy


def test_copies_merge_first_without_rounds(spark):
    """A group of 70 equal rows (ids passed 2^63 before), one of 3, and single rows."""
    pts = [[1.0, 2.0]] * 70 + [[5.0, 5.0]] * 3 + [[float(x), float(x * x % 7)] for x in range(10, 16)]
    order = np.random.default_rng(5).permutation(len(pts))
    pts = [pts[i] for i in order]
    n = len(pts)
    df = spark.createDataFrame(list(enumerate(pts)), "id long, v array<double>")
    # one closest pair at a time
    size, cent, live, want = np.ones(n), np.array(pts), list(range(n)), []
    while len(live) > 1:
        d, a, b = min((np.sqrt(2 * size[a] * size[b] / (size[a] + size[b])) * np.linalg.norm(cent[a] - cent[b]), a, b)
                      for i, a in enumerate(live) for b in live[i + 1:])
        cent[a], size[a] = (cent[a] * size[a] + cent[b] * size[b]) / (size[a] + size[b]), size[a] + size[b]
        live.remove(b)
        want.append(d)
    labels, link = hierarchy.ward(df, "id", "v", 2, leaves=None)
    rows = sorted(link.collect())
    assert [r.step for r in rows] == list(range(n - 1)) and rows[-1]["size"] == n
    assert [r.distance for r in rows[:71]] == [0.0] * 71 and rows[71].distance > 0
    assert sorted(x for r in rows for x in (r.left, r.right)) == list(range(2 * n - 2))
    weight = {i: 1 for i in range(n)}
    for r in rows:
        weight[n + r.step] = weight[r.left] + weight[r.right]
        assert r["size"] == weight[n + r.step]
    assert np.allclose([r.distance for r in rows[:72]], want[:72])
    groups = {}
    for r in labels.collect():
        groups.setdefault(tuple(pts[r.id]), set()).add(r.cluster)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 2

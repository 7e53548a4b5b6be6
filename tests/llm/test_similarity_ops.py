"""Nearest neighbours and the n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tabforge.llm import ann, ngram_join
from tabforge.llm.shingles import shingle_sets


def _brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted((-max(float((a * b).sum()) for a in ok[q] for b in ok[i]), i) for i in ok if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def _vectors(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, [float(x) for x in (centres[i % 20] + rng.normal(size=8)) * rng.uniform(0.2, 2)]) for i in range(n)]
    rows += [(n + i, rows[5][1]) for i in range(60)]  # a group of copies
    rows += [(9000, None), (9010, []), (9020, [0.0] * 8), (9030, [1.0, float("nan")] + [1.0] * 6), (9040, [1.0, None] + [1.0] * 6),
             (9050, [float("inf")] + [1.0] * 7), (9060, [1.0] * 5), (None, [1.0] * 8), (20, rows[21][1])]
    return rows, spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")


def test_search_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 64)
    rows, df = _vectors(spark)
    truth = _brute(rows, 20, 10)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(truth)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, 11)) and q not in [x[1] for x in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len(set(truth[q]) & {x[1] for x in found})
    assert hits / (10 * len(truth)) >= 0.9


def test_hot_buckets_in_blocks_and_exact_rest(spark, monkeypatch):
    rows, df = _vectors(spark, n=300, seed=2)
    monkeypatch.setattr(ann, "BLOCK", 16)
    found = ann.search(df, F.col("vec_id") % 50 == 0, 400)  # more than there are: all candidates, exactly
    truth = _brute(rows, 50, 400)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == truth
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).collect() == []


def test_fit_reaches_target_on_large_tables(spark, monkeypatch):
    """Hash functions of a table of 58 million rows, on random unit vectors."""
    monkeypatch.setattr(ann, "SAMPLE", 1500)
    monkeypatch.setattr(ann, "SAMPLE_QUERIES", 48)
    x = np.random.default_rng(4).normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    t, probes = ann.fit(df, 58_000_000, 1.0, 20)
    rows = df.orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    x = np.array([r["v"] for r in rows])
    s = x[:48] @ x.T
    s[np.arange(48), np.arange(48)] = -np.inf
    best = s.argmax(axis=1)
    met = [any(t.bucket(t.cells(x[[b]], n, False)[0])[0] in t.probes(x[[i]], n, probes)[0] for n in range(t.tables))
           for i, b in enumerate(best)]
    assert probes and np.mean(met) >= ann.TARGET


def test_probes_in_success_order_without_a_cap():
    t = ann.Tables(8, 2, 7, 1.0, 3.0)
    x = np.random.default_rng(0).normal(size=(3, 8))
    got = t.probes(x, 1, 5 ** 7)
    assert got.shape == (3, 5 ** 7) and all(len(set(g)) == 5 ** 7 for g in got)
    assert (t.probes(x, 1, 100) == got[:, :100]).all()


def test_exact_when_no_fit_reaches_target(spark, monkeypatch):
    monkeypatch.setattr(ann, "PROBES", 1)
    monkeypatch.setattr(ann, "TABLES", 1)
    rows, df = _vectors(spark, n=300, seed=3)
    assert ann.fit(ann.clean(df), 350, 10.0, 10)[1] == 0
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == _brute(rows, 50, 10)


def test_results_come_from_visited_buckets_only(spark, monkeypatch):
    """One probe a table: the pilot, which holds the whole table, adds nothing to what the
    visited buckets hold, and its bound takes nothing away."""
    real, seen = ann.fit, []
    monkeypatch.setattr(ann, "TABLES", 1)
    monkeypatch.setattr(ann, "BUCKET", 64)
    monkeypatch.setattr(ann, "fit", lambda *a: seen.append((real(*a)[0], 1)) or seen[-1])
    rows, df = _vectors(spark)
    x = {r.vec_id: np.array(r.v) for r in ann.clean(df).collect() if r.vec_id != 20}
    got = {}
    for r in ann.search(df.where("vec_id != 20"), F.col("vec_id") % 7 == 0, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    t, ids, v = seen[0][0], np.array(list(x)), np.stack(list(x.values()))
    truth, exact, differ = _brute([r for r in rows if r[0] != 20], 7, 5), 0, 0
    for q, found in got.items():
        met = np.zeros(len(ids), dtype=bool)
        for n in range(t.tables):
            met |= t.bucket(t.cells(v, n, False)[0]) == t.probes(x[q][None], n, 1)[0, 0]
        met &= ids != q
        if met.sum() < 5:  # short: exact
            exact += 1
            assert found == set(truth[q])
        else:
            score = {i: -float((x[q] * x[i]).sum()) for i in ids[met]}
            assert found == set(sorted(score, key=lambda i: (score[i], i))[:5])
            differ += found != set(truth[q])
    assert set(got) == set(truth) and differ and exact


def test_short_queries_are_exact_beyond_the_pilot(spark, monkeypatch):
    """An outlier meets fewer than k rows in its buckets; the pilot does not hide that."""
    monkeypatch.setattr(ann, "PILOT", 64)
    monkeypatch.setattr(ann, "BUCKET", 16)
    real = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: (real(*a)[0], 1))
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=8) + 30 * np.eye(8)[0]).tolist()) for i in range(1, 800)] + [(0, [-9.0, 40.0] + [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.search(df, F.col("vec_id") == 0, 10).orderBy("rank").collect()]
    assert got == _brute(rows, 10 ** 6, 10)[0]


def _sets(rows):
    out = []
    for _, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    return out


def _components(rows, percent=75):
    sets = _sets(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    names = {}
    for i, (d, _) in enumerate(rows):
        names.setdefault(find(i), []).append(d)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in names.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 200]))]
        if rng.random() < .4:
            base[len(base) // 2:len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < .3:
                t = t[:max(1, int(len(t) * rng.uniform(.6, 1)))]
            rows.append((n, " ".join(t)))
            n += 1
    near = [word() for _ in range(80)]  # a large group of near copies
    for _ in range(80):
        t = list(near)
        for _ in range(2):
            t[rng.randrange(len(t))] = word()
        rows.append((n, " ".join(t)))
        n += 1
    rows += [(n + i, "Same  TEXT here\tof five words") for i in range(40)]
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "two words"), (None, "one"), (5006, "é É"),
             (5003, "one"), (5007, "solo null" * 3), (5008, "w " * 20_000)]
    rng.shuffle(rows)
    return rows


def test_components_against_all_pairs(spark, monkeypatch):
    for seed, salt in ((1, 20_000), (2, 5)):
        monkeypatch.setattr(ngram_join, "SALT_ROWS", salt)
        if salt < 100:  # few counters: frequent shingles stand out and their buckets are salted
            monkeypatch.setattr(ngram_join, "SLOTS", 1 << 12)
        rows = _corpus(seed)
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, set_key string, n int").repartition(5)
        got = sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(docs).collect()]))
        assert got == sorted(map(str, _components(rows)))


def test_keep_one_per_group(spark):
    rows = _corpus(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _set_key string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    want = {d for d, n, c in _components(rows) if n == 0 or d == c}
    assert set(ids) == want and len(ids) == len(want)
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


def test_filters_never_lose_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < .9], rng.integers(0, 300, 10).astype(np.uint64)]))
        inter = len(np.intersect1d(a, b))
        x, y = a * np.uint64(0x9E3779B97F4A7C15), b * np.uint64(0x9E3779B97F4A7C15)
        x.sort(), y.sort()
        assert ngram_join.suffix_bound(ngram_join.part_counts(x), ngram_join.part_counts(y)) >= inter
        assert ngram_join.linked(a, b) == (100 * inter >= 75 * len(np.union1d(a, b)))


def test_shingle_sets_across_chunks(monkeypatch):
    from tabforge.llm import shingles
    texts = [t for _, t in _corpus(4)]
    whole = [s.tolist() for s in shingle_sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK", 300)
    assert [s.tolist() for s in shingle_sets(texts)] == whole
    assert [len(s) for s in whole] == [len(s) for s in _sets([(0, t) for t in texts])]

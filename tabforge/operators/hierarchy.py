"""Ward agglomerative clustering (M13) and its linkage table (V12), as Spark jobs.

Ward's criterion is reducible: merging all pairs of clusters that are each other's nearest
neighbour at once gives the same hierarchy as merging one closest pair at a time. So a round
finds the nearest neighbour of every new cluster and of those whose neighbour was merged (blocks
of clusters against blocks of clusters, each pair of blocks one task), merges the reciprocal
pairs, and writes the next clusters. In many dimensions a round merges few pairs (82 rounds over
10,256 embeddings), so once no more than BLOCK clusters are left, tasks list the nearest ones of each
and a single task plays the remaining rounds from these lists. Equal points come first, without
rounds: their merges, all at distance 0, are numbered by rank. Steps are numbered by merge
distance, which Ward's criterion never lowers from a merge to the next.

``leaves`` says what is merged: a number k first gathers the rows into k-means clusters (the
form for large tables: a round costs k * k distances), None takes every row as a leaf (exact,
n * n distances). Either way each leaf but one gets its merge and nothing is linked on the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators.density import connected_min_labels
from tabforge.operators.models import kmeans
from tabforge.operators.ordinal import dense_codes, ordered_cumsum, row_positions
from tabforge.session import materialize, release

#: BLOCK clusters at most are merged to the end in one task.
LEAVES, BLOCK = 256, 1 << 16
#: Clusters of a block in a round: as many, or as few where cores are free; distances that a task holds at once.
MOST_ROWS, LEAST_ROWS, PAIRS_AT_ONCE, AT_ONCE = 1 << 14, 1 << 10, 1 << 21, 1 << 16
#: Nearest clusters in a list; rows of one size that are multiplied by themselves.
NEAR, ONE_SIZE = 24, 32
#: Tasks that find lists; each reads all of the at most BLOCK clusters.
LIST_PARTS = 16


def _leaves(df: DataFrame, id_col: str, vec: str, leaves: int | None) -> DataFrame:
    """(id_col, leaf, v): leaves numbered 0..m-1 without gaps."""
    rows = df.select(id_col, F.col(vec).cast("array<double>").alias("v"))
    if leaves is None:
        codes = dense_codes(rows, id_col, "leaf")
        return rows.join(codes, id_col)
    feats = rows.withColumn("features", array_to_vector("v"))
    found = materialize(kmeans(leaves, prediction="cell").fit(feats).transform(feats).select(id_col, "v", "cell"), "ward-cells")
    return found.join(dense_codes(found, "cell", "leaf"), "cell").select(id_col, "leaf", "v")


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pdf["id"].to_numpy(), pdf["n"].to_numpy(), np.stack(pdf["c"].to_numpy())


def _products(na, ca, nb, cb) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, their n_b / (n_a + n_b) |c_a - c_b|^2 for all of b by matrix product, twice the
    error of each row's numbers at most). Rows of one size take their factors from the product."""
    middle = cb.mean(axis=0)
    ac, bc = ca - middle, cb - middle
    bb = (bc * bc).sum(axis=1)
    aa = (ac * ac).sum(axis=1)
    left = np.concatenate([ac, np.ones((len(ac), 1)), aa[:, None]], axis=1)
    right = np.concatenate([-2 * bc, bb[:, None], np.ones((len(bc), 1))], axis=1).T
    slack = 32 * (cb.shape[1] + 4) * np.finfo(float).eps * (aa + bb.max())
    step = max(1, PAIRS_AT_ONCE // len(cb))
    order = np.argsort(na, kind="stable")
    alike = np.split(order, np.flatnonzero(np.diff(na[order])) + 1)
    for rows in [x for x in alike if len(x) >= ONE_SIZE]:
        scaled = right * (nb / (na[rows[0]] + nb))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            yield some, left[some] @ scaled, slack[some]
    rows = np.concatenate([order[:0], *(x for x in alike if len(x) < ONE_SIZE)])
    for at in range(0, len(rows), step):
        some = rows[at:at + step]
        yield some, left[some] @ right * (nb / (na[some][:, None] + nb)), slack[some]


def _squared(na, ca, nb, cb, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """|c_a - c_b|^2 of the pairs (row of a, col of b), term by term."""
    out = np.empty(len(row))
    for at in range(0, len(row), AT_ONCE):
        k = slice(at, at + AT_ONCE)
        out[k] = ((cb[col[k]] - ca[row[k]]) ** 2).sum(axis=1)
    return out


def _distances(na, ca, nb, cb, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Ward distances sqrt(2 ab / (a + b)) |c_a - c_b| of the pairs (row of a, col of b)."""
    return np.sqrt(2 * na[row] * nb[col] / (na[row] + nb[col])) * np.sqrt(_squared(na, ca, nb, cb, row, col))


def nearest_rows(a, b) -> pd.DataFrame:
    """(id, d, other) for clusters ``a`` among clusters ``b`` (in order of id). Matrix products
    rule out what is certainly farther than the nearest (their error is bounded); the distances
    of what remains are computed one by one."""
    (ia, na, ca), (ib, nb, cb) = a, b
    own = np.searchsorted(ib, ia)
    own[ib[np.minimum(own, len(ib) - 1)] != ia] = -1
    out_d, out_o = np.full(len(ia), np.inf), np.zeros(len(ia), dtype=np.int64)
    for rows, least, slack in _products(na, ca, nb, cb):
        mine = np.flatnonzero(own[rows] >= 0)
        least[mine, own[rows][mine]] = np.inf
        row, col = np.nonzero(~(least > (least.min(axis=1) + slack)[:, None]))  # all of them where a number is not finite
        d = _distances(na, ca, nb, cb, rows[row], col)
        d[ib[col] == ia[rows[row]]] = np.inf
        order = np.lexsort((col, d, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        out_d[rows[row[first]]], out_o[rows[row[first]]] = d[first], ib[col[first]]
    return pd.DataFrame({"id": ia, "d": out_d, "other": out_o})


def near_lists(na, ca, nb, cb, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in b of at most ``k`` nearest clusters of each of a, nearest first, -1 beyond them; a
    squared distance below which no other cluster of b lies). ``own``: a's own places in b. The k-th smallest of the
    minima of groups of columns bounds the k-th smallest number, so two passes find the list."""
    places, bound = np.full((len(na), k), -1, dtype=np.int64), np.full(len(na), np.inf)
    groups = min(len(nb), 16 * k)
    cuts = np.arange(groups) * len(nb) // groups
    for rows, least, slack in _products(na, ca, nb, cb):
        least[np.arange(len(rows)), own[rows]] = np.inf
        if groups > k + 1:
            most = np.partition(np.minimum.reduceat(least, cuts, axis=1), k, axis=1)[:, k]
        else:
            most = np.full(len(rows), np.inf)
        row, col = np.nonzero(~(least > (most + slack)[:, None]) & (least < np.inf))
        d = _distances(na, ca, nb, cb, rows[row], col)
        order = np.lexsort((col, d, row))
        row, col, d = row[order], col[order], d[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        in_list = rank < k
        places[rows[row[in_list]], rank[in_list]] = col[in_list]
        limit = 2 * na[rows] * most  # what lies beyond ``most`` is farther
        over = rank == k
        limit[row[over]] = np.minimum(limit[row[over]], d[over] ** 2)
        bound[rows] = limit
    return places, bound


class _Hierarchy:
    """The merges of at most BLOCK clusters, each with a list of its nearest ones and a bound: no
    cluster without a member in the list is nearer than that. Merged clusters are no nearer than
    their parts, so bounds stay true, and a list answers until it holds nothing below its bound."""

    def __init__(self, n: np.ndarray, c: np.ndarray, places: np.ndarray, bound: np.ndarray):
        m = len(n)
        self.m, self.made = m, 0
        self.n, self.c = np.concatenate([n, np.zeros(m)]), np.concatenate([c, np.zeros_like(c)])
        self.places = np.concatenate([places, np.full_like(places, -1)])
        self.bound = np.concatenate([bound, np.full(m, np.inf)])
        self.root, self.live = np.arange(2 * m), np.arange(m)
        self.nn, self.d = np.full(2 * m, -1, dtype=np.int64), np.full(2 * m, np.inf)
        self.look(self.live, places)

    def look(self, rows: np.ndarray, old: np.ndarray, keep: bool = False) -> None:
        """Nearest clusters of ``rows`` from their lists ``old``; the whole table where these do not say."""
        unsure = [np.empty(0, dtype=np.int64)]
        k = self.places.shape[1]
        for at in range(0, len(rows), max(1, AT_ONCE // old.shape[1])):
            some, have = rows[at:at + max(1, AT_ONCE // old.shape[1])], old[at:at + max(1, AT_ONCE // old.shape[1])]
            now = np.sort(np.where(have < 0, some[:, None], self.root[have]), axis=1)
            again = (now == some[:, None]) | (np.diff(now, axis=1, prepend=-1) == 0)
            d = _distances(self.n, self.c, self.n, self.c, np.repeat(some, now.shape[1]), now.ravel()).reshape(now.shape)
            d[again] = np.inf
            order = np.argsort(d, axis=1, kind="stable")
            now, d = np.take_along_axis(now, order, 1), np.take_along_axis(d, order, 1)
            if keep:
                self.places[some] = np.where(np.isfinite(d), now, -1)[:, :k]
                self.bound[some] = np.minimum(self.bound[some], d[:, k] ** 2)
            self.nn[some], self.d[some] = now[:, 0], d[:, 0]
            unsure.append(some[~(d[:, 0] ** 2 < self.bound[some] * (1 - 1e-9)) & ~(np.isinf(self.bound[some]) & np.isfinite(d[:, 0]))])
        self.search(np.concatenate(unsure))

    def search(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        live = self.live
        places, self.bound[rows] = near_lists(self.n[rows], self.c[rows], self.n[live], self.c[live],
                                              np.searchsorted(live, rows), self.places.shape[1])
        self.places[rows] = np.where(places < 0, -1, live[places])
        self.nn[rows] = np.where(places[:, 0] < 0, rows, self.places[rows, 0])
        self.d[rows] = np.where(places[:, 0] < 0, np.inf, _distances(self.n, self.c, self.n, self.c, rows, self.nn[rows]))

    def round(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merges the reciprocal pairs (a, b) into new numbers; (a, b, new, distance)."""
        live = self.live
        a = live[(self.nn[self.nn[live]] == live) & (live < self.nn[live]) & np.isfinite(self.d[live])]
        b, new, d = self.nn[a], self.m + self.made + np.arange(len(a)), self.d[a]
        if not len(a):
            return a, b, new, d
        self.made += len(a)
        na, nb = self.n[a][:, None], self.n[b][:, None]
        self.n[new], self.c[new] = self.n[a] + self.n[b], (self.c[a] * na + self.c[b] * nb) / (na + nb)
        # d(new, y)^2 by Lance and Williams, for a y of size 1 or of any size, that no list holds
        x, y = self.bound[a], self.bound[b]
        self.bound[new] = np.minimum((na[:, 0] * x + nb[:, 0] * y + (x + y - d * d)) / (na + nb + 1)[:, 0], x + y - d * d)
        into = np.arange(len(self.root))
        into[a] = into[b] = new
        self.root = into[self.root]
        stays = into[live] == live
        self.live = np.concatenate([live[stays], new])
        lost = live[stays]
        lost = lost[into[self.nn[lost]] != self.nn[lost]]
        if len(self.live) > 1:
            self.look(lost, self.places[lost])
            self.look(new, np.concatenate([self.places[a], self.places[b]], axis=1), keep=True)
        return a, b, new, d


def finish(pdf: pd.DataFrame, base: int) -> pd.DataFrame:
    """The remaining merges of at most BLOCK clusters (with ``near`` and ``bound``, their lists, if
    there are any); new ids start at ``base``."""
    pdf = pdf.sort_values("id")
    ids, n, c = _arrays(pdf)
    if "near" in pdf:
        places, bound = np.full((len(ids), max(map(len, pdf["near"]))), -1, dtype=np.int64), pdf["bound"].to_numpy()
        for i, x in enumerate(pdf["near"]):
            places[i, :len(x)] = np.searchsorted(ids, x)
    else:
        places, bound = near_lists(n, c, n, c, np.arange(len(ids)), NEAR)
    state, rows, whole = _Hierarchy(n, c, places, bound), [], False
    while len(state.live) > 1:
        a, b, new, d = state.round()
        if not len(a):
            if whole:
                raise ValueError("distances are not finite")
            state.search(state.live)  # rounding hid a pair: every nearest neighbour anew
        whole = not len(a)
        rows.append((a, b, new, d))
    name = np.concatenate([ids, base + np.arange(len(ids))])
    a, b, new, d = (np.concatenate(x) for x in zip(*rows))
    return pd.DataFrame({"a": name[a], "b": name[b], "new": name[new], "distance": d, "size": state.n[new].astype(np.int64)})


def _finisher(base: int):
    return lambda pdf: finish(pdf, base)


def _blocks(spark, count: int) -> int:
    """Blocks of at most MOST_ROWS rows; more of them keep the cores busy."""
    par = int(spark.conf.get("spark.sql.shuffle.partitions"))
    busy = min(math.ceil(math.sqrt(2 * par)), math.ceil(count / min(BLOCK, LEAST_ROWS)))
    return max(1, math.ceil(count / MOST_ROWS), busy)


def _nearest(wanted: DataFrame, clusters: DataFrame, count: int) -> DataFrame:
    """(id, d, other): the nearest of each ``wanted`` cluster among all by Ward distance
    sqrt(2 ab / (a + b)) |ca - cb|, ties to the smaller id."""
    blocks = _blocks(clusters.sparkSession, count)
    deal = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = wanted.select("id", "n", "c", deal.alias("i")).withColumn("j", every)
    right = clusters.select(*[F.col(x).alias(x) for x in ("id", "n", "c")]).withColumn("j", deal).withColumn("i", every)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "d": [], "other": []}).astype({"id": "int64", "d": "float64", "other": "int64"})
        out = nearest_rows(_arrays(a), _arrays(b.sort_values("id")))
        return out[np.isfinite(out["d"])]

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best, "id long, d double, other long")
    return pairs.groupBy("id").agg(F.min(F.struct("d", "other")).alias("m")).select("id", "m.d", "m.other")


def _lists(clusters: DataFrame, count: int) -> DataFrame:
    """At most BLOCK clusters with ``near`` and ``bound``, their lists, a part of them a task."""
    parts, k = min(LIST_PARTS, math.ceil(count / LEAST_ROWS)), NEAR
    if parts == 1:
        return clusters
    left = clusters.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    right = clusters.select(*[F.col(x).alias(x) for x in ("id", "n", "c")]).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def listed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        (ia, na, ca), (ib, nb, cb) = _arrays(a) if len(a) else _arrays(b.iloc[:1]), _arrays(b.sort_values("id"))
        places, bound = near_lists(na, ca, nb, cb, np.searchsorted(ib, ia), k)
        out = pd.DataFrame({"id": ia, "n": na, "c": list(ca), "near": [ib[x[x >= 0]] for x in places], "bound": bound})
        return out if len(a) else out.iloc[:0]

    return left.groupBy("i").cogroup(right.groupBy("i")).applyInPandas(
        listed, "id long, n double, c array<double>, near array<long>, bound double")


def _equal_points(clusters: DataFrame, m: int) -> tuple[DataFrame, DataFrame]:
    """(the merges of equal points among m leaves, the clusters left). Each further point of a
    group, in order of id, joins those before it; its place among all rows numbers the merge."""
    groups = clusters.groupBy("c").agg(F.min("id").alias("least"), F.sum("n").alias("whole"))
    rows = clusters.join(groups.select(F.col("c").alias("gc"), "least"), F.col("c") == F.col("gc")).select("id", "n", "least", F.lit(1).alias("one"))
    rows = materialize(ordered_cumsum(rows, ["least", "id"], {"place": "one", "upto": "n"}), "ward-equal")
    start = rows.where("id = least").select("least", F.col("place").alias("first"), (F.col("upto") - F.col("n")).alias("below"))
    ranked = rows.join(start, "least").withColumn("new", (F.lit(m) + F.col("place")).cast("long"))
    steps = ranked.where("id != least").select(
        F.when(F.col("place") == F.col("first") + 1, F.col("least")).otherwise(F.col("new") - 1).alias("a"), F.col("id").alias("b"),
        "new", F.lit(0.0).alias("distance"), (F.col("upto") - F.col("below")).cast("long").alias("size"), F.col("least").alias("hub"))
    last = steps.join(ranked.select(F.col("id").alias("b"), "least"), "b").groupBy("least").agg(F.max("new").alias("top"))
    left = groups.join(last, "least", "left").select(F.coalesce("top", "least").alias("id"), F.col("least").alias("rep"), F.col("whole").alias("n"), "c")
    return materialize(steps, "ward-zero"), materialize(left, "ward-distinct")


def _merges(clusters: DataFrame, count: int) -> DataFrame:
    """(a, b, new, distance, size, hub) of all merges; ids below ``count`` are leaves, the hub is
    one node that all of a merge's nodes hang on: its new one, or the first of equal points. A new
    id is its round's base and the leaf that names the merge's second part, which no later one has."""
    leaves = count
    found, clusters = _equal_points(clusters, count)
    base, count = 2 * leaves + 1, clusters.count()
    near, whole = None, False
    while True:
        if count <= 1:
            return found
        if count <= BLOCK:
            last = _lists(clusters.select("id", "n", "c"), count).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(
                _finisher(base), "a long, b long, new long, distance double, size long")
            last = materialize(last.withColumn("hub", F.col("new")), "ward-last")
            return found.unionByName(last)
        if near is None:
            near, whole = materialize(_nearest(clusters, clusters, count), "ward-nearest"), True
        back = near.select(F.col("id").alias("b"), F.col("other").alias("back"))
        pairs = (near.join(back, (F.col("other") == F.col("b")) & (F.col("id") == F.col("back"))).where("id < other")
                 .select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("d").alias("distance")))
        x, y = (clusters.select(F.col("id").alias(i), F.col("rep").alias(f"rep_{i}"), F.col("n").alias(f"n{i}"), F.col("c").alias(f"c{i}"))
                for i in "ab")
        joined = (pairs.join(x, "a").join(y, "b")
                  .select("a", "b", (F.col("rep_b") + F.lit(base)).cast("long").alias("id"), F.col("rep_a").alias("rep"), "distance",
                          (F.col("na") + F.col("nb")).alias("n"),
                          F.zip_with("ca", "cb", lambda p, q: (p * F.col("na") + q * F.col("nb")) / (F.col("na") + F.col("nb"))).alias("c")))
        joined = materialize(joined, "ward-merged")
        merged = joined.count()
        if not merged:
            if whole:
                raise ValueError("distances are not finite")
            near = None  # rounding hid a pair: every nearest neighbour anew
            continue
        gone = joined.select(F.explode(F.array("a", "b")).alias("id"))
        old, clusters = clusters, materialize(clusters.join(gone, "id", "left_anti").unionByName(joined.select("id", "rep", "n", "c")), "ward-clusters")
        step = joined.select("a", "b", F.col("id").alias("new"), "distance", F.col("n").cast("long").alias("size"),
                             F.col("id").alias("hub"))
        found = found.unionByName(step)
        count, base = count - merged, base + leaves
        if count > BLOCK:
            # a merged cluster is no nearer to the others than its parts were: a nearest
            # neighbour that is still there stays the nearest
            kept = near.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("other")), "other", "left_anti")
            kept = kept.select("id", "d", "other")
            wanted = clusters.join(kept.select("id"), "id", "left_anti")
            release(old)
            last, near = near, materialize(kept.unionByName(_nearest(wanted, clusters, count)), "ward-nearest")
            release(last)
            whole = False


def ward(df: DataFrame, id_col: str, vec: str, n_clusters: int = 2, leaves: int | None = LEAVES):
    """(labels ``id_col, cluster``; linkage ``step, left, right, distance, size``).
    The merge of step s makes cluster m + s of m leaves. Clusters are numbered by their
    smallest leaf."""
    leaf = materialize(_leaves(df, id_col, vec, leaves), "ward-leaves")
    x = leaf.select("leaf", F.posexplode("v").alias("i", "x")).groupBy("leaf", "i").agg(F.avg("x").alias("x"))
    centre = x.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    sizes = leaf.groupBy("leaf").agg(F.count(F.lit(1)).cast("double").alias("n"))
    clusters = materialize(sizes.join(centre, "leaf").select(F.col("leaf").alias("id"), "n", "c"), "ward-start")
    m = clusters.count()
    merges = _merges(clusters, m)
    steps = materialize(row_positions(merges, ["distance", "new"], "step"), "ward-steps")
    names = steps.select(F.col("new").alias("id"), (F.col("step") + F.lit(m)).alias("name"))
    named = steps
    for side, out in (("a", "left"), ("b", "right")):
        named = (named.join(names.select(F.col("id").alias(side), F.col("name").alias(out)), side, "left")
                 .withColumn(out, F.coalesce(out, side)))
    linkage = named.select("step", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"),
                           "distance", "size")
    # the last n_clusters - 1 merges undone
    kept = steps.where(F.col("step") < F.lit(m - 1 - (n_clusters - 1)))
    hung = kept.select(F.explode(F.array("a", "b", "new")).alias("x"), "hub").where("x != hub")
    edges = hung.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("hub").alias("b")),
                                          F.struct(F.col("hub").alias("a"), F.col("x").alias("b")))).alias("e")).select("e.a", "e.b")
    nodes = leaf.select(F.col("leaf").alias("node")).distinct()
    roots = connected_min_labels(nodes, edges)
    numbers = dense_codes(roots, "label", "cluster")
    label_of = roots.join(numbers, "label").select(F.col("node").alias("leaf"), "cluster")
    return leaf.join(label_of, "leaf").select(id_col, "cluster"), linkage

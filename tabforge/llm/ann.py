"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by L tables of K functions floor((a.x + b) / w) with Gaussian (2-stable)
``a``. For the largest inner product the vectors first get one more component,
sqrt(M^2 - |x|^2), M the largest norm; a query's is 0. Then the Euclidean distance to a
query falls as the inner product rises, so hashing for distance serves it exactly.

A query visits, in every table, its own bucket and then perturbed ones in the order of
their estimated success: the sum of squared distances from the query's projections to the
walls crossed. Inside a visited bucket all vectors are scored by the original measure and
the best k kept; the tables' candidates merge by a top-k per query.

Perturbations are made per query in success order, best first, as many as are asked for: no
list of them is kept, and a coordinate may move as far as the sample's cells lie apart.

K grows with the logarithm of the table (a bucket keeps about BUCKET vectors), w is the
spread of the projections, and the number of probes is fitted: on a fixed-size sample
(SAMPLE vectors, SAMPLE_QUERIES queries, documented bound) the smallest number reaching
TARGET recall is taken. If PROBES of them do not reach it, K is lowered until they do (fewer
and larger buckets); if no K does, every query is answered exactly. Every vector is indexed
and every query answered; a query that finds fewer than k candidates is answered exactly,
against all rows in blocks.

A fixed sample (PILOT vectors) bounds what buckets emit: of the sample's vectors that lie in
buckets the query visits, the k-th best score is one that its buckets reach anyhow, so rows
below it are not emitted. The sample adds no result rows: what is found is what the visited
buckets hold, at every table size.

Scale: one narrow shuffle of L copies of the vectors by (table, bucket), none of pairs: a
task scores a block of vectors against a block of queries with a matrix product and emits
k rows a query. A bucket with more than BLOCK vectors or queries is cut into blocks by
hashes, so a bucket with a third of all rows is many tasks.

Defined results: vectors that are NULL, empty, zero, of another length than the most
frequent one, or hold NULL or non-finite components take no part, neither as queries nor
as candidates; rows that share a vec_id count as one vector with its best score; ties go
to the smaller vec_id; fewer than k candidates give fewer rows; an empty table gives an
empty result; a NULL vec_id takes no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.session import materialize

TABLES, BUCKET, BLOCK = 4, 1024, 4096
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 256, 0.96
PILOT = 16_384
#: Probes a table at most before K is lowered, and query copies a batch of visits holds.
PROBES, VISITS = 4096, 1 << 16


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    ok = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0))
    size = ok.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return ok.where(F.size("v") == (size["d"] if size else 0))


class Tables:
    """The hash functions and the perturbations, from a seed."""

    def __init__(self, dim: int, tables: int, k: int, w: float, top_norm: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(tables, dim + 1, k))
        self.b = rng.uniform(0, w, size=(tables, k))
        self.w, self.top_norm, self.k, self.tables = w, top_norm, k, tables
        self.mult = rng.integers(1, 2 ** 40, size=k) * 2 + 1
        self.reach = 2

    def augment(self, x: np.ndarray, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.clip(self.top_norm ** 2 - (x * x).sum(axis=1), 0, None))
        return np.column_stack([x, last])

    def cells(self, x: np.ndarray, table: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        p = (self.augment(x, query) @ self.a[table] + self.b[table]) / self.w
        c = np.floor(p)
        return c.astype(np.int64), p - c

    def bucket(self, cells: np.ndarray) -> np.ndarray:
        """One 64-bit number per cell vector (equal cells only, but for chance)."""
        with np.errstate(over="ignore"):
            return (cells * self.mult).sum(axis=-1)

    def probes(self, x: np.ndarray, table: int, many: int) -> np.ndarray:
        """[query, probe] buckets in estimated success order: the ``many`` cheapest sums of
        one move a coordinate, or all there are."""
        cells, frac = self.cells(x, table, True)
        n = len(x)
        move = np.arange(-self.reach, self.reach + 1)
        cost, moved = np.zeros((n, 1)), np.zeros((n, 1, 0), dtype=np.int64)
        for d in range(self.k):
            f = frac[:, d, None]
            wall = np.where(move > 0, move - f, np.where(move < 0, f - move - 1, 0)) ** 2
            by = np.argsort(wall, axis=1, kind="stable")
            wall = np.take_along_axis(wall, by, axis=1)
            # the i-th sum with the j-th move has i * j sums at least as cheap before it
            i, j = np.indices((cost.shape[1], len(move))).reshape(2, -1)
            some = (i + 1) * (j + 1) <= many
            i, j = i[some], j[some]
            total = cost[:, i] + wall[:, j]
            order = np.argsort(total, axis=1, kind="stable")[:, :many]
            cost = np.take_along_axis(total, order, axis=1)
            before = np.take_along_axis(moved, i[order][:, :, None], axis=1)
            moved = np.concatenate([before, move[np.take_along_axis(by, j[order], axis=1)][:, :, None]], axis=2)
        return self.bucket(cells[:, None, :] + moved)


def top_k(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int,
          bound: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of ``x`` for each query but itself, from its ``bound`` on. A matrix
    product picks who can be among them; scores are then summed one pair at a time, so
    that equal vectors get equal scores in any block."""
    out_q, out_x, out_s = [], [], []
    for at in range(0, len(q), 512):
        s = q[at:at + 512] @ x.T
        s[q_ids[at:at + 512, None] == x_ids[None, :]] = -np.inf
        if s.shape[1] > k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            slack = 1e-9 * (1 + np.abs(kth))
            near = s >= np.where(np.isfinite(kth), kth - slack, -np.finfo(float).max)[:, None]
        else:
            near = np.isfinite(s)
        if bound is not None:
            near &= s >= (bound[at:at + 512] - 1e-9 * (1 + np.abs(np.nan_to_num(bound[at:at + 512], neginf=0))))[:, None]
        i, j = np.nonzero(near)
        score = (q[at:at + 512][i] * x[j]).sum(axis=1)
        order = np.lexsort((x_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        keep = np.arange(len(i)) - first < k
        out_q.append(q_ids[at:at + 512][i[keep]])
        out_x.append(x_ids[j[keep]])
        out_s.append(score[keep])
    return pd.DataFrame({"query_id": np.concatenate(out_q) if out_q else np.zeros(0, np.int64),
                         "vec_id": np.concatenate(out_x) if out_x else np.zeros(0, np.int64),
                         "score": np.concatenate(out_s) if out_s else np.zeros(0)})


FOUND = "query_id long, vec_id long, score double"


def _score_blocks(index: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per key: the k best of the index rows for each of the query rows."""
    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        return top_k(q["vec_id"].to_numpy(), np.stack(q["v"].to_numpy()), x["vec_id"].to_numpy(),
                     np.stack(x["v"].to_numpy()), k, q["bound"].to_numpy())
    return queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(run, FOUND)


def _needed(t: Tables, x: np.ndarray, q: np.ndarray, truth: np.ndarray) -> int:
    """The smallest number of probes that meets TARGET of the ``truth`` rows; 0 if PROBES do not."""
    cells = [t.cells(x, table, False)[0] for table in range(t.tables)]
    t.reach = max(2, *(int(np.abs(c[truth] - t.cells(q, table, True)[0][:, None, :]).max()) for table, c in enumerate(cells)))
    many = min(64, PROBES)
    while True:
        found_at = np.full(truth.shape, PROBES + 1)
        for table, c in enumerate(cells):
            b = t.bucket(c)
            for at in range(0, len(q), 16):
                visits = t.probes(q[at:at + 16], table, many)
                hit = visits[:, None, :] == b[truth[at:at + 16]][:, :, None]
                found_at[at:at + 16] = np.minimum(found_at[at:at + 16], np.where(hit.any(axis=2), hit.argmax(axis=2) + 1, PROBES + 1))
        need = np.sort(found_at.ravel())
        probes = int(need[math.ceil(TARGET * len(need)) - 1])
        if probes <= PROBES:
            return probes
        if many >= min(PROBES, (2 * t.reach + 1) ** t.k):
            return 0
        many = min(PROBES, many * 4)


def fit(vectors: DataFrame, n: int, top_norm: float, k: int) -> tuple[Tables, int]:
    """Hash tables and number of probes, from the SAMPLE vectors of smallest hash. In a
    sample of m of n rows the nearest k * m / n stand for a query's k nearest of n. No
    probes: TARGET is out of reach, answer exactly."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    return fit_sample(np.array([r["v"] for r in rows]), n, top_norm, k)


def fit_sample(x: np.ndarray, n: int, top_norm: float, k: int) -> tuple[Tables, int]:
    m = len(x)
    functions = max(1, round(math.log2(max(2.0, n / BUCKET)) / 2))
    rng = np.random.default_rng(3)
    w = float(np.std(x @ rng.normal(size=(x.shape[1], 64)))) or 1.0
    q = x[:SAMPLE_QUERIES]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = min(m - 1, max(1, round(k * m / n)))
    if near < 1:
        return Tables(x.shape[1], TABLES, functions, w, top_norm), 1
    truth = np.argsort(-s, axis=1)[:, :near]
    for fewer in range(functions, 0, -1):
        t = Tables(x.shape[1], TABLES, fewer, w, top_norm)
        probes = _needed(t, x, q, truth)
        if probes:
            break
    return t, probes


def search(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found per query.
    ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    x = materialize(clean(vectors, vec_id, embedding), "ann-vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    head = x.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    if not head["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tables, probes = fit(x, head["n"], head["m"], k)
    queries = x.where(is_query)
    # at most PILOT vectors of fixed length: a proven bound for the broadcast
    some = x.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT).collect()
    some_ids, some_v = np.array([r["vec_id"] for r in some]), np.array([r["v"] for r in some])
    pilot = spark.sparkContext.broadcast((some_ids, some_v, [
        np.unique(tables.bucket(tables.cells(some_v, t, False)[0]), return_inverse=True) for t in range(tables.tables)]))

    def bounds(ids: np.ndarray, v: np.ndarray, visited: list[np.ndarray]) -> np.ndarray:
        """The k-th best score among the sample's vectors in the ``visited`` buckets."""
        pilot_ids, pilot_v, buckets = pilot.value
        if len(pilot_ids) < k:
            return np.full(len(ids), -np.inf)
        low = []
        for at in range(0, len(ids), 512):
            met = np.zeros((len(ids[at:at + 512]), len(pilot_ids)), dtype=bool)
            for b, (known, which) in zip(visited, buckets):
                b = b[at:at + 512]
                place = np.minimum(np.searchsorted(known, b), len(known) - 1)
                i, j = np.nonzero(known[place] == b)
                seen = np.zeros((len(b), len(known)), dtype=bool)
                seen[i, place[i, j]] = True
                met |= seen[:, which]
            s = v[at:at + 512] @ pilot_v.T
            s[~met | (ids[at:at + 512, None] == pilot_ids[None, :])] = -np.inf
            low.append(-np.partition(-s, k - 1, axis=1)[:, k - 1])
        return np.concatenate(low)

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy())
            for t in range(tables.tables):
                yield pd.DataFrame({"t": t, "bucket": tables.bucket(tables.cells(v, t, False)[0]),
                                    "vec_id": pdf["vec_id"], "v": pdf["v"]})

    def hash_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = max(1, VISITS // max(1, probes))
            for at in range(0, len(pdf), step):
                some = pdf.iloc[at:at + step]
                v = np.stack(some["v"].to_numpy())
                visited = [tables.probes(v, t, max(1, probes)) for t in range(tables.tables)]
                low = bounds(some["vec_id"].to_numpy(), v, visited)
                for t, b in enumerate(visited):
                    who = np.repeat(np.arange(len(some)), b.shape[1])
                    yield pd.DataFrame({"t": t, "bucket": b.ravel(), "vec_id": some["vec_id"].to_numpy()[who],
                                        "v": some["v"].to_numpy()[who], "bound": low[who]}
                                       ).drop_duplicates(["bucket", "vec_id"])

    schema = "t int, bucket long, vec_id long, v array<double>"
    index = x.mapInPandas(hash_rows, schema)
    visits = queries.mapInPandas(hash_queries, schema + ", bound double")
    found = _score_blocks(*_blocked(index, visits, ["t", "bucket"]), ["t", "bucket", "xb", "qb"], k)
    found = materialize(_merge(found, k), "ann-found")

    # queries that found too few: exact, in blocks of all rows
    ids = x.select("vec_id").distinct().count()
    want = min(k, ids - 1)
    enough = found.groupBy("query_id").count().where((F.col("count") >= want) & F.lit(probes > 0)).select("query_id")
    short = queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti")
    short = materialize(short.select("vec_id", "v"), "ann-short")
    if want > 0 and short.count():
        blocks = -(-head["n"] // BLOCK)
        q_blocks = -(-short.count() // BLOCK)
        rows = x.withColumn("xb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        rows = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        asked = (short.withColumn("bound", F.lit(float("-inf"))).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
                 .withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")))
        exact = _merge(_score_blocks(rows, asked, ["xb", "qb"], k), k)
        found = found.join(short.select(F.col("vec_id").alias("s")), F.col("query_id") == F.col("s"), "left_anti").unionByName(exact)
    return found


def _blocked(index: DataFrame, visits: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cuts buckets of more than BLOCK vectors or queries into blocks: a row of either side
    belongs to one block of its own side and is copied to the other side's blocks."""
    def sizes(df: DataFrame, out: str) -> DataFrame:
        big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        return materialize(big.select(*keys, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias(out)), "ann-hot")

    hot = sizes(index, "xn").join(sizes(visits, "qn"), keys, "full")  # hot buckets only

    def cut(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        df = df.join(hot, keys, "left")
        own_at = F.pmod(F.xxhash64("vec_id"), F.coalesce(F.col(own_n), F.lit(1))).cast("int")
        all_at = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1))
        return df.withColumn(own, own_at).withColumn(other, all_at).drop("xn", "qn")

    return cut(index, "xb", "xn", "qb", "qn"), cut(visits, "qb", "qn", "xb", "xn")


def _merge(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

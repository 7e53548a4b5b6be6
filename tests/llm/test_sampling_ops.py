"""Mixing, sharding, packing: brute force, laws and edge cases."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import mixing, packing, sharding
from tabforge.llm.queries import tokenizer_path

EDGE = [(1, "a b c", "s1"), (1, "a b c", "s1"), (2, None, "s2"), (3, "", None), (4, " \t\n", "s2"), (None, "x y", None),
        (5, "w " * 30_000, "s1"), (6, "a b d", "s1"), (7, "Ünï çödé\u00a0x", "s2")]


def edge_docs(spark):
    """Edge rows with further columns that clash with the operators' own names."""
    rows = [(*r, 7, "k", 1.0, 3) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard string, rank double, times int")


def test_bounded_knapsack_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths = np.unique(rng.integers(1, 15, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(1, 40))
        taken = mixing.bounded_knapsack(lengths, counts, budget)
        sums = {0}
        for length, c in zip(lengths, counts):
            sums = {s + k * length for s in sums for k in range(c + 1)}
        assert (taken <= counts).all()
        assert (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_counts_hits_large_budgets():
    rng = np.random.default_rng(1)
    lengths, counts = np.arange(1, 3000), rng.integers(1, 50, 2999)
    total = int((lengths * counts).sum())
    for part in (0.0, 0.01, 0.37, 0.5, 0.999, 1.0):
        t = mixing.fit_counts(lengths, counts, part * total)
        assert (t >= 0).all() and (t <= counts).all()
        assert abs((t * lengths).sum() - part * total) <= 1


def _fill(sizes, weights, share, cap):
    """Targets by resharing the excess until none is above."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while True:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w > cap * sizes[i]} if w else set()
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            return target
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ -= over
        if not open_:
            return target


def test_mix_targets_and_taken(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for s, k in [("a", 300), ("b", 40), ("c", 80), ("d", 5), (None, 60)]:
        for _ in range(k):
            rows.append((n, " ".join(["w"] * rng.randint(1, 40)), s))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, mixing.weights_by_position((3, 1, 2))).toPandas()
    assert len(out) == n and (out["taken"] <= 2 * out["size"]).all() and (out["taken"] % out["size"] == 0).all()
    order = ["a", "b", "c", "d", None]
    sizes = [sum(len(t.split()) for _, t, x in rows if x == s) for s in order]
    want = _fill(sizes, [3, 1, 2, 3, 1], 1.5, 2)
    for s, size, target in zip(order, sizes, want):
        g = out[out["source"].isna() if s is None else out["source"] == s]
        assert (g["source_size"] == size).all()
        assert g["target"].to_numpy() == pytest.approx([target] * len(g))
        assert abs(g["taken"].sum() - target) <= 1
    again = mixing.mix(docs.repartition(7), mixing.weights_by_position((3, 1, 2))).toPandas()
    assert dict(zip(out.doc_id, out.taken)) == dict(zip(again.doc_id, again.taken))


def test_mix_edge_cases(spark):
    docs = edge_docs(spark)
    out = mixing.mix(docs, mixing.weights_by_position()).collect()
    assert len(out) == len(EDGE)
    assert all(r.taken == 0 for r in out if r["size"] == 0)
    assert mixing.mix(docs.limit(0), mixing.weights_by_position()).collect() == []
    kept = mixing.repeat(docs, mixing.weights_by_position((1.5, 1.0, 1.25)))
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) == {r[0] for r in EDGE} and ids[2] == 1 and ids[3] == 1
    assert mixing.repeat(docs.limit(0), mixing.weights_by_position()).collect() == []
    words_only_null = docs.where("text IS NULL")
    assert mixing.mix(words_only_null, mixing.weights_by_position()).first().target == 0


def test_hot_length_is_ranked_in_parts(spark):
    """A third of all documents in one source and length: exact counts all the same."""
    rows = [(i, "x y z", "hot") for i in range(600)] + [(1000 + i, "w " * (1 + i % 50), f"s{i % 3}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, mixing.weights_by_position((1, 1)), share=0.5).toPandas().groupby("source", dropna=False)
    for _, g in out:
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 3


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 400])
def test_feistel_is_a_permutation(spark, n):
    got = {r.i: r.p for r in sharding.permute(spark.range(n).withColumnRenamed("id", "i"), "i", n, "p").collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(sharding.place_of(i, n) == p for i, p in got.items())


def test_shards(spark):
    docs = edge_docs(spark)
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(EDGE)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[s]) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in EDGE)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    again = sharding.shard(docs.repartition(5), 4).collect()
    key = lambda r: (str(r.doc_id), r["size"], r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert sharding.shard(docs.limit(0), 4).collect() == []


def test_placement_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for window in (8, 16, 37):
        for _ in range(60):
            pieces = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
            seqs, placed = defaultdict(list), Counter()
            for length, _, many, per, first, offset in packing.placement_plan(Counter(pieces), window):
                for i in range(many):
                    seqs[first + i // per].append((offset + (i % per) * length, length))
                    placed[length] += 1
            assert placed == Counter(pieces)
            for parts in seqs.values():
                at = 0
                for o, length in sorted(parts):
                    assert o == at
                    at += length
                assert at <= window
            free: list[int] = []  # one piece at a time into the tightest sequence
            for length in sorted(pieces, reverse=True):
                fits = [b for b, f in enumerate(free) if f >= length]
                if fits:
                    free[min(fits, key=lambda b: free[b])] -= length
                else:
                    free.append(window - length)
            assert sorted(free) == sorted(window - sum(x for _, x in p) for p in seqs.values())


ODD = ["it's don't O'Brien'll ", "<|endoftext|> a", "caf́e Éa—, x…!", "I2C 12-34 ½² ǅ İstanbul ΑΣ", "a b c\x1cd",
       "ß ﬁ ſ", "'s 't'", "__a_b__ (x)", "naïve--co-op", "日本語 テスト、です。", " ", "", "Word, word. WORD;", "ͅa ͅ x", "x" * 500]


def test_word_cache_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 12)  # the cache starts anew in between
    tok = packing.WordTokenizer(tokenizer_path())
    texts = ODD + ["the quick brown fox, jumps. over 12 lazy dogs!"] * 3
    for i in range(0, len(texts), 4):
        for t, ids in zip(texts[i:i + 4], tok.batch(texts[i:i + 4])):
            assert np.frombuffer(ids, "<u4").tolist() == tok.tok.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    window = 64
    docs = edge_docs(spark).unionByName(
        spark.createDataFrame([(100 + i, t, "s", 1, "k", 1.0, 1) for i, t in enumerate(ODD)], edge_docs(spark).schema))
    rows = packing.pack(docs, tokenizer_path(), window=window, with_ids=True).collect()
    tok = packing.WordTokenizer(tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = tok.tok.encode(r.text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), window):
            want[(r.doc_id, len(ids), s, tuple(ids[s:s + window]))] += 1
    assert Counter((r.doc_id, r.doc_tokens, r.start, tuple(r.ids)) for r in rows) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in rows)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for parts in seqs.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= window
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []
    padded = {r.tokens: r.padded_to for r in packing.sequences(packing.pack(docs, tokenizer_path())).collect()}
    assert all(p == (t if t & (t - 1) == 0 else 2048) for t, p in padded.items())


def test_hot_piece_length(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.pack(docs, tokenizer_path(), window=10).collect()
    assert Counter((r.sequence_id, r.offset) for r in rows).most_common(1)[0][1] == 1
    assert len({r.sequence_id for r in rows}) == 1500

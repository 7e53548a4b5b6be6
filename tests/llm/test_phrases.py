"""Phrase mining against plain counting of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tabforge.llm import phrases as P


def plain(rows, min_count=100, top=2000, max_words=5):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, max_words + 1):
                    if i + m <= len(w):
                        f[lang][tuple(w[i:i + m])] += 1
    out = {}
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        held = {q[i:j] for q, b in cand.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                if j - i < len(q) and 100 * b >= 100 * cand[q[i:j]]}
        rows = []
        for p, a in cand.items():
            if p not in held:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], s))
        for rank, x in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = (x[2].decode(), x[3], x[4], x[5], n[lang], x[6])
    return out


def mined(docs, **limits):
    return {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in P.collocations(docs, **limits).collect()}


def texts(n, seed=5):
    rnd = random.Random(seed)
    common = ["of", "the", "and", "a", "to", "in"]
    out = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(0, 60)):
            w.append(rnd.choice(common) if rnd.random() < 0.7 else f"w{rnd.randrange(200)}")
            if rnd.random() < 0.1:
                w += ["New", "York", "stock", "exchange"]
            if rnd.random() < 0.1:
                w.append(rnd.choice(["a a a a a a", "é", "ÉA", "x.", ",", "\n", "\t", "..", "\x0b", "\xa0"]))
        out.append((" ".join(w), rnd.choice(["en", "en", "de", None])))
    return out


def test_suffix_array_and_lf():
    rnd = random.Random(1)
    for _ in range(30):
        x = []
        for _ in range(rnd.randrange(1, 6)):
            x += [rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] + [0]
        x = np.array(x, dtype=np.int32)
        ends = np.cumsum(x == 0) - 1
        named = [(0, int(e)) if s == 0 else (1, int(s)) for s, e in zip(x, ends)]
        want = sorted(range(len(x)), key=lambda i: named[i:])
        sa, bwt = P.transform(x)
        lf = P.lf_of(bwt)
        assert sa.tolist() == want
        place = {p: i for i, p in enumerate(want)}
        assert [lf[j] for j in range(len(x)) if bwt[j]] == [place[p - 1] for p in want if p and x[p - 1]]


def test_equals_plain_counting(spark):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, words int")
    want = plain(rows, min_count=20)
    assert len({k[0] for k in want}) == 3 and any(len(v[0].split(" ")) == 5 for v in want.values())
    assert mined(docs.repartition(5), min_count=20) == want
    # shards of a few words, slices of a few bytes: the cuts lose and add nothing
    assert mined(docs, min_count=20, shard_tokens=2000, slice_bytes=40) == want
    # frequent phrases joined, not broadcast: at every depth, and from some depth on
    assert mined(docs, min_count=20, shard_tokens=5000, broadcast_rows=0) == want
    assert mined(docs, min_count=20, broadcast_rows=60) == want
    assert mined(docs, min_count=20, top=3) == {k: v for k, v in want.items() if k[1] <= 3}


def test_edge_rows(spark):
    long = "again and again " * 60_000
    rows = [(None, "en"), ("", None), ("...", "en"), (" \t ", None), ("one", None), (long, None), ("x" * 3_000_000, "de"),
            ("So it goes. " * 100, "und"), ("So it goes. " * 100, "und")]
    docs = spark.createDataFrame([(t, lang, "a", 1) for t, lang in rows], "text string, lang string, word string, count int")
    assert mined(docs, slice_bytes=1000) == plain(rows)
    assert mined(docs.limit(0)) == {}


def test_exact_beyond_64_bits(spark):
    big = 9 * 10 ** 12
    row = spark.sql(f"""SELECT (CAST(1000 AS DECIMAL(4,0)) * (CAST({big} AS DECIMAL(19,0)) * CAST({big * 7} AS DECIMAL(19,0)))
                        div (CAST({big - 1} AS DECIMAL(19,0)) * CAST({big + 2} AS DECIMAL(19,0)))) AS s""").first()
    assert row.s == 1000 * big * big * 7 // ((big - 1) * (big + 2))

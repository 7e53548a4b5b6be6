"""Pipeline stages: columns, kept rows, and the packed tokens of what was kept."""

from collections import Counter

import corpus_pipeline as P
from tabforge.session import materialize


def test_stages_on_edge_rows(spark):
    prose = " ".join(f"alpha{i} the of beta{i} and to" for i in range(60))
    other = " ".join(f"gamma{i} de la delta{i} et les" for i in range(60))
    rows = [(1, prose, "en", "s1", len(prose)), (2, prose, "en", "s2", len(prose)), (2, prose, "en", "s2", len(prose)),
            (3, other + " mail a.b@example.com", "fr", "s1", 0), (4, None, "en", None, None), (5, "", None, "s1", 0),
            (6, "too short", "en", "s1", 9), (None, other.replace("gamma", "beta"), "fr", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cur = docs
    sizes = {}
    for name, stage in P.STAGES[:-1]:
        cur = materialize(stage(spark, cur, ""), "t")
        assert cur.columns == docs.columns and dict(cur.dtypes) == dict(docs.dtypes), name
        sizes[name] = Counter(r.doc_id for r in cur.collect())
    assert set(sizes["quality_rules"]) == {1, 2, 3, None}
    assert sizes["ngram_jaccard"] == {1: 1, 3: 1, None: 1}
    assert sizes["pii_surrogates"] == sizes["ngram_jaccard"]
    assert not any("a.b@example.com" in r.text for r in cur.collect())
    assert set(sizes["source_mix"]) == set(sizes["pii_surrogates"])
    packed = P.STAGES[-1][1](spark, cur, "").collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
        assert 0 < r.length <= 2048
    assert set(tokens) == set(sizes["source_mix"])
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = materialize(stage(spark, empty, ""), "t")
    assert empty.count() == 0

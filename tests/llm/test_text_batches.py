"""Bounded memory of the n-gram join: Arrow batches of texts, and few rounds of components."""

import pandas as pd

from tabforge.llm import ngram_join
from tabforge.operators import density
from tabforge.session import BATCH_BYTES


def _sizes(spark):
    big = spark.range(0, 600, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 8000) AS text")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [int(pdf["text"].str.len().sum())]})

    return [r.n for r in big.mapInPandas(run, "n long").collect()]


def test_batches_of_texts_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "doc_id long, text string")
    ngram_join.components(docs).collect()
    assert max(_sizes(spark)) < 1.5 * BATCH_BYTES
    spark.conf.set(key, "8m")  # the owner's bound holds
    ngram_join.components(docs).collect()
    assert spark.conf.get(key) == "8m"
    spark.conf.unset(key)


def _path(spark, n):
    """Two long paths, their nodes named in no order along the path, and one lone node."""
    name = [f"{(i * 7919) % 100_003:06d}" for i in range(2 * n)]
    edges = [(name[i], name[i + 1]) for i in range(2 * n - 1) if i != n - 1]
    nodes = spark.createDataFrame([(x,) for x in [*name, "zz"]], "node string")
    want = {x: min(name[:n]) for x in name[:n]} | {x: min(name[n:]) for x in name[n:]} | {"zz": "zz"}
    return nodes, spark.createDataFrame(edges, "a string, b string"), want


def test_components_of_one_chunk_take_no_rounds(spark, monkeypatch):
    written, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda df, *a: written.append(1) or real(df, *a))
    nodes, edges, want = _path(spark, 700)
    got = {r.node: r.label for r in density.connected_min_labels(nodes, edges).collect()}
    assert got == want
    assert len(written) <= 2


def test_components_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(density, "CHUNK", 20)
    nodes, edges, want = _path(spark, 60)
    assert {r.node: r.label for r in density.connected_min_labels(nodes, edges).collect()} == want
    none = density.connected_min_labels(nodes, edges.limit(0))
    assert {r.node: r.label for r in none.collect()} == {x: x for x in want}

"""One document per component where components share a doc_id or have none."""

from tabforge.llm import ngram_join


def test_components_without_ids_of_their_own_each_keep_one(spark):
    text = lambda s: " ".join(f"{s}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("e")),
            (8, text("e")), (9, text("f"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.text[0] + str(r.doc_id) for r in ngram_join.keep_one(docs).collect())
    assert kept == ["aNone", "bNone", "cNone", "d7", "e7", "f9"]

"""The n-gram join writes its rounds' small tables in a file a core, not one a shuffle partition."""

from __future__ import annotations

from tabforge.llm import ngram_join


def test_small_tables_are_few_files(spark, monkeypatch):
    files: dict[str, int] = {}
    write = ngram_join.materialize

    def counted(df, name="t"):
        out = write(df, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k:k + 60]) for k in range(0, 300, 3)] + [" ".join(words[:60] + [f"x{j}"]) for j in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cores = spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * cores))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r["doc_id"]: r["component_id"] for r in ngram_join.components(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == {i: 0 for i in range(140)}
    small = {k: n for k, n in files.items() if k in ("ngram-pairs", "ngram-links", "ngram-labels", "ngram-mixed", "ngram-suffixes")}
    assert len(small) == 5 and max(small.values()) <= cores
    assert ngram_join._files(docs, 100 * cores * ngram_join.FILE_ROWS) == 100 * cores  # large tables keep theirs

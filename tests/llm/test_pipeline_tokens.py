"""The corpus pipeline's last stage returns every document's tokens."""

import corpus_pipeline as P
from tabforge.llm.queries import tokenizer_path


def test_pieces_rebuild_the_tokens(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path())
    texts = {1: "one two three", 2: "", 3: " ".join(f"word{i}" for i in range(3000)), 4: None}
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    rows = P.STAGES[-1][1](spark, docs, "").collect()
    for k, t in texts.items():
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(len(r.ids) == r.length for r in mine)

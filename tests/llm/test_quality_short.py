"""Quality rule on texts under 300 words."""

import random

from tabforge.llm import quality


def test_short_junk_is_rejected_and_short_prose_kept(spark):
    rng = random.Random(1)
    names = [f"name{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(quality.COMMON_WORDS["en"]) if rng.random() < .45 else rng.choice(names)
                               for _ in range(n))
    rows = [(i, prose(rng.randrange(120, 290)), "en") for i in range(60)]  # all under the old guard
    rows += [(100, " ".join(rng.choice(names) for _ in range(150)), "en"), (101, prose(15), "en"), (102, "", "en"), (103, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert set(refs) == {"en", quality.OTHER}
    kept = {r.doc_id for r in quality.judge(docs, refs).where("quality.kept").select("doc_id").collect()}
    assert kept == set(range(60)) | {101}

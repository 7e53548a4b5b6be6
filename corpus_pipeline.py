"""A corpus pipeline over ``documents``: quality rules, near-duplicate removal, surrogates
for personal data, mixing sources, packing into token sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``. ``run`` applies them to the whole table.

NULLs, empty texts, repeated rows and further columns are treated as the operators of
``tabforge.llm`` define them; every stage keeps further columns but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import mixing, ngram_join, packing, quality, surrogates
from tabforge.llm.queries import tokenizer_path
from tabforge.session import materialize

#: Sources' weights repeat this pattern times their own size: each is seen once and some
#: of it again, so mixing repeats documents but drops none.
EPOCHS = (1.5, 1.0, 1.25)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the divergence from their language rejects go."""
    judged = quality.judge(docs, quality.references(docs))
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by similar texts stays."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.replace(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to 1.5, 1 and 1.25 epochs in turn (by name); a document taken twice is two
    rows. Documents without words are kept once: mixing counts words."""
    factor = mixing.weights_by_position(EPOCHS)
    return mixing.repeat(docs, factor)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (the tokens themselves), ids_crc32,
    doc_tokens, sequence_id, offset."""
    packed = packing.pack(docs, tokenizer_path(), with_ids=True)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("pii_surrogates", personal_data),
    ("source_mix", source_mix),
    ("packing", pack_sequences),
]

#: Similarity components, surrogates and tokens are beyond SQL; the stages are tested
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

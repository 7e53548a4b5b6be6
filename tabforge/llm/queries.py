"""The registered queries of the training-data operators: thin contracts over the
operators' own interfaces, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import (ann, credentials, filter_audit, mixing, ngram_join, packing, pagediff, phrases, quality, sharding,
                          surrogates, urlfilter, warc)
from tabforge.llm.common import table

SHARDS = 24
QUERY_EVERY, NEIGHBOURS = 20, 20
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
TOKENIZER = "word_bpe_49k.json"


def op1_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.weights_by_position((3, 1, 2)), share=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_ann_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


def op4_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return surrogates.replace(docs)


def op7_warc_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark, f"warc-{uuid.uuid4().hex}")
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    records = warc.read_records(spark, folder)
    return records.select(warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", warc.page_of(F.col("refers_to_record")).alias("refers_to"))


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, quality.references(docs))
    q = [f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return judged.select("doc_id", *q)


def op9_pack_bfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.mask_counts(masks, table(spark, sf_dir, "labels")))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


#: DuckDB SQL of the queries that SQL can express.
_HOST = "coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
ORACLES = {
    "op5_url_trie": f"""
        WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
            ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        hit AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (
                    PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
                FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM u LEFT JOIN hit ON hit.page_id = u.page_id AND k = 1""",
    "op7_warc_cas": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        h AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
        FROM h""",
    "op12_filter_audit": r"""
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
        lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > first, false)::INT AS mask
              FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
        c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
        letters AS (SELECT unnest(['A','B','C','D','E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (SELECT '' AS o, 0 AS step, 0 AS before, 0 AS bit
                   UNION ALL SELECT o || f, step + 1, before + orders.bit, letters.bit FROM orders, letters WHERE position(f IN o) = 0),
        whole AS (SELECT o AS filter_order FROM orders WHERE step = 5),
        steps AS (SELECT filter_order, step, before, bit FROM whole JOIN orders ON step > 0 AND starts_with(filter_order, o)),
        r AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
              FROM c, steps GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
               unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM r""",
    "op13_phrase_mining": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                     translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        s AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
        g AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase
              FROM s, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(ws)),
        f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        c AS (SELECT lang, m, phrase, a FROM f WHERE m > 1 AND a >= 100),
        held AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS q ON q.lang = c.lang AND q.m > c.m AND 100 * q.a >= 100 * c.a
                 AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ')),
        k AS (SELECT *, string_split(phrase, ' ') AS ws, unnest(generate_series(1, m - 1)) AS k FROM c ANTI JOIN held USING (lang, phrase)),
        x AS (SELECT k.lang, k.phrase, k.a, k.k, one.a AS l, two.a AS r, n.n,
                     (1000::HUGEINT * k.a * n.n // (one.a::HUGEINT * two.a))::BIGINT AS score
              FROM k JOIN n ON n.lang = k.lang
              JOIN f AS one ON one.lang = k.lang AND one.phrase = array_to_string(list_slice(ws, 1, k.k), ' ')
              JOIN f AS two ON two.lang = k.lang AND two.phrase = array_to_string(list_slice(ws, k.k + 1, k.m), ' ')),
        low AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low)
        SELECT * FROM ranked WHERE rank <= 2000""",
}

QUERIES = {f.__name__: f for f in (
    op1_mix_budget, op2_ann_multiprobe, op3_feistel_shards, op4_secret_links, op5_url_trie, op6_pii_surrogates,
    op7_warc_cas, op8_quality_divergence, op9_pack_bfd, op10_ngram_jaccard, op11_page_differencing, op12_filter_audit,
    op13_phrase_mining)}

"""A content-addressed WARC archive.

``write_archive`` makes one WARC/1.1 record per page and stores it in two tables under a
folder: ``payloads`` - payload bytes once per SHA-256 digest - and ``records`` - the exact
header block of every record with the digest it refers to. ``read_records`` rebuilds the
records by joining the two, after verifying that the stored bytes still have the digest
they are filed under.

Of records with equal payloads of at least MIN_REVISIT bytes the one with the smallest
page_id is the ``response``; the others are ``revisit`` records that refer to it. "Equal"
is verified: rows of one digest must agree in length and in a second, independent digest,
else the job fails rather than merging them.

Scale: the html is hashed in the first pass, which writes narrow rows; the holder of each
digest comes from a combinable aggregate (a payload that a third of the pages share is one
row per task). The html moves once, in the join that picks the holders; each key of that
join is one page, so it has no hot key. Reading back, the store is hashed once where it
lies; the join that rebuilds records has one stored row per digest, and a hot digest only on
the records' side, which adaptive execution splits.

Defined results: NULL html is an empty payload; a NULL url is an empty target; line breaks in
a url are percent-encoded, so it stays one header line; a NULL page_id sorts after all others;
rows that repeat a page_id and payload give one response, the rest revisits of it; an empty
table gives an empty archive; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.session import materialize, scratch_path

MIN_REVISIT = 100
CRLF = "\r\n"
#: The archive's own date: records of one input are equal on every run.
DATE = "2024-01-01T00:00:00Z"


def _urn(page_id: Column, digest: Column, copy: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"),
                    F.substring(digest, 1, 16), F.lit(":"), copy.cast("string"), F.lit(">"))


def _one_line(url: Column) -> Column:
    """A url's line breaks percent-encoded: it cannot end its header line and begin another."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _headers(kind: str) -> Column:
    """The exact header block of a record, up to and including the empty line."""
    lines = [
        F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"),
        F.concat(F.lit("WARC-Record-ID: "), F.col("record_id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(_one_line(F.col("url")), F.lit(""))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: text/html; charset=utf-8")]
    if kind == "revisit":
        lines += [F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  F.concat(F.lit("WARC-Refers-To: "), F.col("holder_record")), F.lit("Content-Length: 0")]
    else:
        lines += [F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes ``folder/payloads`` and ``folder/records``."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256))
    rows = src.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
                      F.crc32("payload").alias("check"), F.xxhash64("payload").alias("check2"))
    rows = materialize(rows, "warc-rows")
    found = rows.groupBy("digest").agg(
        F.min("page_id").alias("holder"), F.count_if(F.col("page_id").isNull()).alias("nulls"),
        F.min(F.struct("payload_bytes", "check", "check2")).alias("lo"),
        F.max(F.struct("payload_bytes", "check", "check2")).alias("hi"))
    verified = F.when(F.col("lo") == F.col("hi"), F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("payloads differ under one digest: "), F.col("digest"))).cast("string"))
    holders = found.select(verified.alias("h_digest"), "holder")

    # records: the rank among rows that repeat both the digest and the page_id makes ids unique
    ranked = rows.withColumn("copy", F.row_number().over(
        Window.partitionBy("digest", "page_id").orderBy(F.col("url").asc_nulls_last())))
    joined = ranked.join(holders, F.col("digest") == F.col("h_digest"))
    first = F.col("page_id").eqNullSafe(F.col("holder")) & (F.col("copy") == 1)
    plain = first | (F.col("payload_bytes") < MIN_REVISIT)
    records = (joined.withColumns({"record_id": _urn(F.col("page_id"), F.col("digest"), F.col("copy")),
                                   "holder_record": _urn(F.col("holder"), F.col("digest"), F.lit(1))})
               .select("record_id", "digest", F.when(plain, _headers("response")).otherwise(_headers("revisit")).alias("header")))
    records.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/records")

    # payloads: one row per digest; the join's keys are single pages
    # (one key column, never NULL: dropping repeated rows then needs no second exchange)
    def key(digest: str, page: str) -> Column:
        return F.concat_ws(":", F.col(digest), F.coalesce(F.col(page).cast("string"), F.lit("null")))

    wanted = holders.select(key("h_digest", "holder").alias("key"))
    store = (src.select(key("digest", "page_id").alias("key"), "digest", "payload").join(wanted, "key")
             .dropDuplicates(["key"]).select("digest", "payload"))
    store.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/payloads")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records: header fields, header, payload and the whole record's bytes
    (a revisit's block is empty; ``payload`` is still the full payload it stands for).
    ``payload_digest`` and ``payload_bytes`` are computed from the stored bytes; a store
    row whose bytes do not have its digest fails the read."""
    store = spark.read.parquet(f"{folder}/payloads")
    actual = F.sha2("payload", 256)
    store = store.select(
        F.when(actual == F.col("digest"), F.col("digest")).otherwise(
            F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    rec = spark.read.parquet(f"{folder}/records")
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))

    rec = rec.select("header", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("record_id"),
                     field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to_record"),
                     F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]+)", 1).alias("named_digest"))
    out = rec.join(store, F.col("named_digest") == F.col("payload_digest"), "left")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return out.withColumn("record", F.concat(F.col("header"), block, F.lit(CRLF + CRLF).cast("binary")))


def page_of(record_id: Column) -> Column:
    """The page_id inside a record id."""
    return F.try_to_number(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+):", 1), F.lit("S9999999999999999999")).cast("long")


def archive_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)

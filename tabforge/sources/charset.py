"""Charset detection (S3): one pass over a file's raw bytes, split like any text file.

The text source hands lines back byte for byte, so a line's bytes read as ISO-8859-1 are a
string of one character a byte, and each candidate's automaton is a regular expression over
it. A line break is a byte of its own in every candidate (no multi-byte sequence holds 0x0A),
so the automaton starts anew at each line and no state crosses blocks or splits. Files of
two-byte units (UTF-16) are told by their mark or by their zero bytes.

Defined results: a file without bytes above 0x7F, an empty one included, is UTF-8; bytes that
no candidate explains are Windows-1252, or ISO-8859-1 where it leaves bytes undefined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values --------------------------------------------------------------------
# Candidate charset: (well-formed sequences above ASCII, frequent ones among them), as bytes.
# Frequent are letters, syllables, first-level ideographs and full-width punctuation; in
# Windows-1252 a letter between ASCII bytes. A narrower charset comes before a wider one.
_HIGH = r"[\xa1-\xfe]"
SEQUENCES = {
    "utf-8": (r"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
              r"|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}"
              r"|\xf4[\x80-\x8f][\x80-\xbf]{2}", r"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec][\x80-\xbf]{2}"),
    "euc_kr": (r"[\xa1-\xfd][\xa1-\xfe]", r"[\xa1\xa3\xb0-\xc8][\xa1-\xfe]"),
    "euc_jp": (_HIGH + "{2}" r"|\x8e[\xa1-\xdf]|\x8f" + _HIGH + "{2}", r"[\xa1\xa3-\xa5\xb0-\xcf][\xa1-\xfe]"),
    "shift_jis": (r"[\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]",
                  r"\x81[\x40-\xac]|\x82[\x4f-\xf1]|\x83[\x40-\x96]|[\x88-\x97][\x40-\x7e\x80-\xfc]"),
    "gb18030": (r"[\x81-\xfe][\x40-\x7e\x80-\xfe]|[\x81-\xfe][0-9][\x81-\xfe][0-9]", r"[\xa1\xa3\xb0-\xd7][\xa1-\xfe]"),
    "big5": (r"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]", r"[\xa1\xa4-\xc6][\x40-\x7e\xa1-\xfe]"),
    "cp1252": (r"[\x80\x82-\x8c\x8e\x91-\x9c\x9e-\xff]",
               r"(?<![\x80-\xff])[\x91-\x94\xc0-\xd6\xd8-\xf6\xf8-\xff](?![\x80-\xff])"),
}
# ----------------------------------------------------------------------------------

#: A candidate's frequent share falls by this much per share of malformed bytes.
MALFORMED_COST = 10
#: Shares this close count as equal: the narrower charset wins.
MARGIN = 0.05
#: Share of zero bytes from which a file holds two-byte units.
ZERO_SHARE = 0.2


def byte_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines of a file or folder: ``value`` (binary, without its ``\\n``), ``file``
    and ``block`` (where the split that holds the line begins)."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block")))


def charset_votes(lines: DataFrame, col: str = "value") -> DataFrame:
    """Per candidate, over all lines' bytes: ``candidate, n_bytes, n_high`` (above 0x7F),
    ``n_zero, n_invalid`` (bytes outside well-formed sequences), ``n_common`` (bytes in frequent
    sequences). One aggregate; lines of ASCII skip the patterns."""
    text = F.decode(F.col(col), "ISO-8859-1")
    lines = lines.select(text.alias("t"))
    high = F.col("t").rlike(r"[\x80-\xff]")
    aggs = []
    for i, (valid, common) in enumerate(SEQUENCES.values()):
        bad = F.length(F.regexp_replace("t", r"[\x00-\x7f]+|" + valid, ""))
        # frequent sequences stay, other well-formed ones go, malformed bytes stay too
        rest = F.length(F.regexp_replace("t", rf"[\x00-\x7f]+|({common})|{valid}", "$1"))
        aggs += [F.sum(F.when(high, bad).otherwise(0)).alias(f"i{i}"),
                 F.sum(F.when(high, rest - bad).otherwise(0)).alias(f"c{i}")]
    sums = lines.agg(F.sum(F.length("t")).alias("b"),
                     F.sum(F.when(high, F.length(F.regexp_replace("t", r"[\x00-\x7f]+", ""))).otherwise(0)).alias("h"),
                     F.sum(F.length("t") - F.length(F.replace(F.col("t"), F.lit("\0"), F.lit("")))).alias("z"), *aggs)
    total = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    rows = [F.struct(F.lit(c).alias("candidate"), total("b").alias("n_bytes"), total("h").alias("n_high"),
                     total("z").alias("n_zero"), total(f"i{i}").alias("n_invalid"), total(f"c{i}").alias("n_common"))
            for i, c in enumerate(SEQUENCES)]
    return sums.select(F.inline(F.array(*rows)))


def best_charset(votes: list, head: bytes = b"") -> str:
    """The charset that the votes (rows of ``charset_votes``) and a file's first bytes name."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    by = {v["candidate"]: v for v in votes}
    some = by["utf-8"]
    if some["n_bytes"] and some["n_zero"] >= ZERO_SHARE * some["n_bytes"]:
        return "utf-16be" if head[:1] == b"\0" else "utf-16le"
    if not some["n_invalid"]:
        return "utf-8"
    share = {c: (v["n_common"] - MALFORMED_COST * v["n_invalid"]) / v["n_high"] for c, v in by.items()}
    top = max(share.values())
    if top <= 0:
        return "cp1252" if not by["cp1252"]["n_invalid"] else "iso-8859-1"
    return next(c for c in SEQUENCES if share[c] >= top - MARGIN)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S3: the charset of a file (or of a folder's files together) from all its bytes."""
    lines = byte_lines(spark, path)
    first = lines.where("block = 0").select("value").first()
    return best_charset(charset_votes(lines).collect(), bytes(first["value"][:4]) if first else b"")

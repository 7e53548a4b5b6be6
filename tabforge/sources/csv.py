"""CSV scan (S1-S5).

* ``read_table``: header + inferred types like the reference's loader, but the
  missing-value tokens of pandas count as NULL before types are inferred, short
  rows are padded and over-long rows are set aside instead of failing the load.
* ``delimiter_votes`` / ``detect_delimiter``: choose the separator from the whole
  text, with one distributed aggregate (no driver-side sniffing of a prefix).
* ``parse_lines``: field split of raw text lines with a good / short / long
  status, the building block of the bad-line report.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.sources.charset import byte_lines, detect_encoding
from tabforge.sources.records import csv_records

# Fixed values --------------------------------------------------------------------
# Texts read as missing (the pandas 2.x default NA set), in its natural order.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
# Candidate separators in order of preference, and the fallback.
DELIMITER_CANDIDATES = (",", ";", "\t", " ", "|")
DEFAULT_DELIMITER = ","
DEFAULT_ENCODING = "utf-8"
# Charsets that Spark's own CSV reader decodes; others are decoded record by record.
READER_ENCODINGS = ("us-ascii", "iso-8859-1", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32")
# ----------------------------------------------------------------------------------

_QUOTED = r'"([^"]|"")*"'


def _split_regex(sep: str) -> str:
    """Java regex matching ``sep`` only outside double quotes."""
    esc = "\\" + sep if sep in r".^$|?*+()[]{}\\" else ("\\t" if sep == "\t" else sep)
    return esc + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'


def null_tokens(col: str | Column, tokens: Sequence[str] = NA_TOKENS) -> Column:
    """A text column with the missing-value tokens turned into NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def delimiter_votes(lines: DataFrame, line_col: str = "value",
                    candidates: Sequence[str] = DELIMITER_CANDIDATES) -> DataFrame:
    """Per candidate separator, how often it occurs per line (quoted text removed):
    ``candidate, n_lines, mean_count, var_count, min_count, chosen``.

    One aggregate over all lines; the 5-row result is ranked by consistency
    (lowest variance), then frequency, then preference order."""
    stripped = F.regexp_replace(F.col(line_col), _QUOTED, "")
    counts = [(F.length(stripped) - F.length(F.replace(stripped, F.lit(c), F.lit(""))))
              .alias(f"k{i}") for i, c in enumerate(candidates)]
    per_line = lines.select(*counts)
    aggs = []
    for i in range(len(candidates)):
        k = F.col(f"k{i}")
        aggs += [F.avg(k).alias(f"m{i}"), F.var_pop(k).alias(f"v{i}"), F.min(k).alias(f"n{i}")]
    stats = per_line.agg(F.count(F.lit(1)).alias("n_lines"), *aggs)
    rows = [F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("pref"),
                     F.col(f"m{i}").alias("mean_count"), F.col(f"v{i}").alias("var_count"),
                     F.col(f"n{i}").alias("min_count"))
            for i, c in enumerate(candidates)]
    long = stats.select("n_lines", F.explode(F.array(*rows)).alias("s")).select("n_lines", "s.*")
    eligible = F.col("mean_count") >= 1
    # 5 rows: a window over them is free.
    from pyspark.sql import Window
    w = Window.orderBy(F.when(eligible, 0).otherwise(1), F.col("var_count").asc(),
                       F.col("mean_count").desc(), F.col("pref").asc())
    return (long.withColumn("rk", F.row_number().over(w))
            .select("candidate", F.col("n_lines").cast("long").alias("n_lines"),
                    F.col("mean_count").cast("double").alias("mean_count"),
                    F.col("var_count").cast("double").alias("var_count"),
                    F.col("min_count").cast("long").alias("min_count"),
                    ((F.col("rk") == 1) & eligible).alias("chosen")))


def raw_lines(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING) -> DataFrame:
    """Decoded text lines (column ``value``) of a file or folder in any encoding:
    the CSV reader with a control character as separator and quoting off hands
    back each line whole (a leading byte-order mark is dropped, blank lines are
    skipped as pandas does)."""
    if encoding.lower() not in READER_ENCODINGS:
        @F.pandas_udf("string")
        def decoded(values: pd.Series) -> pd.Series:
            return values.map(lambda b: bytes(b).decode(encoding, "replace"))

        lines = byte_lines(spark, path).select(F.regexp_replace(decoded("value"), "\r$", "").alias("value"))
        return lines.where(F.length("value") > 0)
    df = (spark.read.option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000")
          .option("header", False).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).option("nullValue", "\u0000__no_null__")
          .schema("value string").csv(path))
    return df.select(F.regexp_replace("value", "^\ufeff", "").alias("value")).where(F.col("value").isNotNull())


def detect_delimiter(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING) -> str:
    """The separator of a delimited text file (``,`` when nothing qualifies)."""
    best = delimiter_votes(raw_lines(spark, path, encoding)).where("chosen").select("candidate").first()
    return best[0] if best else DEFAULT_DELIMITER


def parse_lines(lines: DataFrame, names: Sequence[str], sep: str = ",",
                line_col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Split text lines into ``names`` (quote-aware). ``status`` is ``ok``,
    ``short`` (padded with NULL, kept) or ``long`` (too many fields: set aside by
    the caller); ``n_fields`` is the field count. Missing tokens become NULL."""
    parts = F.split(F.col(line_col), _split_regex(sep))
    n = F.size(parts)
    unquote = lambda c: F.regexp_replace(F.regexp_replace(c, r'^"(.*)"$', "$1"), '""', '"')
    status = (F.when(n == len(names), F.lit("ok"))
              .when(n < len(names), F.lit("short")).otherwise(F.lit("long")))
    return lines.select(*keep, n.alias("n_fields"), status.alias("status"),
                        *[null_tokens(unquote(F.get(parts, i))).alias(nm)
                          for i, nm in enumerate(names)])


#: Fixed patterns: what reads as a number or a truth value (a trailing ``d``/``f`` does not).
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Inf|infinity|Infinity)\s*$"
BOOLEAN_TEXT = r"^(True|False|TRUE|FALSE|true|false)$"


def _infer_types(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """One aggregate: a column is long if every non-null value reads as an integer in
    range, else double if every one reads as a number, else boolean, else string."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"a{i}"),
                 F.count_if(x.rlike(INTEGER_TEXT) & x.try_cast("long").isNotNull()).alias(f"l{i}"),
                 F.count_if(x.rlike(NUMBER_TEXT)).alias(f"d{i}"),
                 F.count_if(x.rlike(BOOLEAN_TEXT)).alias(f"b{i}")]
    if not aggs:
        return {}
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(cols):
        a = r[f"a{i}"]
        out[c] = next((t for t, k in (("long", "l"), ("double", "d"), ("boolean", "b")) if a and r[f"{k}{i}"] == a), "string")
    return out


def header_names(header: str, sep: str) -> list[str]:
    """Column names from a header line: blank -> ``_c{i}``, a repeated name gets
    its position appended (Spark's convention)."""
    import csv as _csv
    fields = next(_csv.reader([header.lstrip("\ufeff")], delimiter=sep, quotechar='"'))
    names = [f.strip() or f"_c{i}" for i, f in enumerate(fields)]
    lowered = [n.lower() for n in names]
    return [f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def has_open_quotes(spark: SparkSession, path: str, encoding: str = DEFAULT_ENCODING) -> bool:
    """Does any physical line hold an odd number of quotes, i.e. does a quoted field go
    on in the next line? Decides whether files must be read whole (one aggregate)."""
    line = F.col("value")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    return bool(raw_lines(spark, path, encoding).agg(F.coalesce(F.bool_or(odd), F.lit(False)).alias("o")).first()["o"])


def read_table(spark: SparkSession, path: str, sep: str | None = None,
               encoding: str | None = None, infer: bool = True,
               with_rejects: bool = False, multiline: bool | None = None):
    """Read a CSV file (or folder of part files, each with the header) with a header.

    ``encoding=None`` detects the charset (S3), ``sep=None`` the separator (S2). Files stay
    splittable: those whose quoted fields span lines, and those in charsets that Spark's
    reader does not decode, are joined into records by ``records.csv_records`` and their
    records parsed; others go to the CSV reader, which skips the header by its position in
    each file. ``multiline=True`` reads each file whole by the CSV reader instead, which UTF-16
    always gets and which lines ending in a lone carriage return need. The NA
    tokens become NULL (S5), short rows are padded, rows with too many fields are set
    aside (S4; returned as a second DataFrame with ``with_rejects``), then long / double /
    boolean / string types are inferred with one aggregate."""
    encoding = encoding or detect_encoding(spark, path)
    sep = sep or detect_delimiter(spark, path, encoding)
    native, wide = encoding.lower() in READER_ENCODINGS, encoding.lower().startswith(("utf-16", "utf-32"))
    if multiline is None:
        if not wide and (not native or has_open_quotes(spark, path, encoding)):
            return _read_records(spark, path, sep, encoding, infer, with_rejects)
        multiline = wide
    reader = lambda: (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
                      .option("quote", '"').option("escape", '"').option("multiLine", multiline)
                      .option("mode", "PERMISSIVE").option("enforceSchema", True).option("maxCharsPerColumn", -1))
    names = header_names(sep.join('"' + c.replace('"', '""') + '"' for c in _raw_header(spark, path, sep, encoding, multiline)), sep)
    bad = _corrupt_name(names)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    rows = reader().schema(schema).option("columnNameOfCorruptRecord", bad).csv(path)
    return _finished(rows, names, bad, sep, infer, with_rejects)


def _corrupt_name(names: Sequence[str]) -> str:
    bad = "_corrupt"
    while bad.lower() in {n.lower() for n in names}:
        bad += "_"
    return bad


def _read_records(spark: SparkSession, path: str, sep: str, encoding: str, infer: bool, with_rejects: bool):
    """``read_table`` over records joined from split files."""
    records = csv_records(spark, path, sep, encoding)
    # any file's header: as in a folder read by the CSV reader, all are taken as equal
    first = records.where("header").select("record").first()
    if first is None:
        raise ValueError(f"no lines in {path}")
    names = header_names(first["record"], sep)
    bad = _corrupt_name(names)
    ticked = [n.replace("`", "``") for n in [*names, bad]]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad,
               "maxCharsPerColumn": "-1"}
    parsed = records.where("NOT header").select(
        F.from_csv("record", ", ".join(f"`{n}` string" for n in ticked), options).alias("r")).select("r.*")
    return _finished(parsed, names, bad, sep, infer, with_rejects)


def _finished(rows: DataFrame, names: Sequence[str], bad: str, sep: str, infer: bool, with_rejects: bool):
    """Rows read as texts, with the flagged ones' raw text in ``bad``: missing values, rows
    with too many fields, types."""
    # a flagged row is short (padded, kept) or long; a row of one field is never short
    # (naming every column keeps the reader from parsing only some fields of a row, which
    # would hide that it is too long)
    line = F.concat(F.col(bad), F.substring(F.concat_ws("", *[F.col(f"`{n}`") for n in names]), 1, 0))
    fields = F.size(F.split(F.regexp_replace(line, _QUOTED, '""'), _plain_regex(sep)))
    long_row = F.coalesce(fields > len(names), F.lit(False))
    good = rows.where(~long_row).select(*[null_tokens(F.col(f"`{n}`")).alias(n) for n in names])
    if infer:
        types = _infer_types(good, names)
        good = good.select(*[F.trim(F.col(f"`{n}`")).cast(types[n]).alias(n) if types[n] != "string" else F.col(f"`{n}`")
                             for n in names])
    if with_rejects:
        return good, rows.where(long_row).select(line.alias("line"))
    return good


def _plain_regex(sep: str) -> str:
    return "\\" + sep if sep in r".^$|?*+()[]{}\\" else ("\\t" if sep == "\t" else sep)


def _raw_header(spark: SparkSession, path: str, sep: str, encoding: str, multiline: bool) -> list[str]:
    """The fields of the first record of the first file, in file order."""
    first = (spark.read.option("header", False).option("sep", sep).option("encoding", encoding).option("quote", '"')
             .option("escape", '"').option("multiLine", multiline).option("maxCharsPerColumn", -1)
             .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    row = first.first()
    if row is None:
        raise ValueError(f"no lines in {path}")
    return [(v or "").lstrip("\ufeff") for v in row]

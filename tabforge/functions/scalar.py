"""Column-level rules (C1-C11). All return ``Column`` expressions: they stay inside
whole-stage codegen and work on batch and streaming DataFrames alike.

The session runs with ANSI mode on, so every parse uses ``try_*`` functions:
an unparseable value becomes NULL instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's behaviour) ---------------------------
INCH_CM = 2.54
# Date formats in the order they are tried; the first that parses wins, so a
# day-first reading beats a month-first one for ambiguous text.
#   %Y-%m-%d, %d/%m/%Y, %b %d, %Y, %Y/%m/%d, %m/%d/%Y
DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy", "MMM d, yyyy", "yyyy/M/d", "M/d/yyyy")
# Loose shapes of the formats above (a superset of what each format parses); a
# text that does not have the shape is not handed to the parser at all, which
# spares the parser's failure path on the other formats.
DATE_SHAPES = {"yyyy-M-d": r"^\d+-\d+-\d+$", "d/M/yyyy": r"^\d+/\d+/\d+$",
               "MMM d, yyyy": r"^[A-Za-z]+ \d+, \d+$", "yyyy/M/d": r"^\d+/\d+/\d+$",
               "M/d/yyyy": r"^\d+/\d+/\d+$"}
# Regular expression for "the first number in a text".
FIRST_NUMBER_PATTERN = r"([0-9]+[.]?[0-9]*)"
# R2 grade thresholds: high > 0.8, medium > 0.5, else low.
GRADE_HIGH, GRADE_MEDIUM = 0.8, 0.5
# --------------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def height_cm(col: str | Column) -> Column:
    """``'F-I'`` (feet-inches) to centimetres; anything else is NULL."""
    parts = F.split(_c(col).cast("string"), "-")
    feet = F.trim(F.get(parts, 0)).try_cast("int")
    inches = F.trim(F.get(parts, 1)).try_cast("int")
    return F.when(F.size(parts) == 2, (feet * 12 + inches) * F.lit(INCH_CM)).cast("double")


def first_number(col: str | Column) -> Column:
    """First number found in a text (``'180 lb'`` -> 180.0); none -> NULL."""
    return F.regexp_extract(_c(col).cast("string"), FIRST_NUMBER_PATTERN, 1).try_cast("double")


def parse_date(col: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """C4 helper: the first format that parses the whole text, as a timestamp.
    Date and timestamp columns pass through unchanged (see ``date_parts``)."""
    c = _c(col).cast("string")
    tries = []
    for f in formats:
        t = F.try_to_timestamp(c, F.lit(f))
        shape = DATE_SHAPES.get(f)
        tries.append(F.when(c.rlike(shape), t) if shape else t)
    return F.coalesce(*tries)


def date_parts(col: str | Column, name: str, dtype: str = "string",
               formats: Sequence[str] = DATE_FORMATS) -> list[Column]:
    """C4: year, month, day and hour columns named ``{name}_year`` ... from a text,
    date or timestamp column. Unparseable text gives NULL in all four."""
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        ts = _c(col).cast("timestamp")
    else:
        ts = parse_date(col, formats)
    return [F.year(ts).cast("double").alias(f"{name}_year"),
            F.month(ts).cast("double").alias(f"{name}_month"),
            F.dayofmonth(ts).cast("double").alias(f"{name}_day"),
            F.hour(ts).cast("double").alias(f"{name}_hour")]


def split_parts(col: str | Column, n_parts: int, sep: str = ",") -> list[Column]:
    """The first ``n_parts`` pieces of a text split on ``sep`` (missing -> NULL)."""
    arr = F.split(_c(col), sep if sep not in r".^$|?*+()[]{}\\" else "\\" + sep)
    return [F.get(arr, i) for i in range(n_parts)]


def contains_any(col: str | Column, needle: str = ",") -> Column:
    """C6 (aggregate): does any value contain ``needle``."""
    return F.bool_or(F.coalesce(F.contains(_c(col), F.lit(needle)), F.lit(False)))


def log1p(col: str | Column) -> Column:
    """Natural log of 1 + x (salary target transform)."""
    return F.log1p(_c(col))


def poly_degree(n: Column, n_distinct: Column) -> Column:
    """``int(min(max(2, n/100), distinct))``. It grows with the table, so the model
    runner takes the degree from its caller instead."""
    return F.floor(F.least(F.greatest(F.lit(2.0), n / F.lit(100.0)), n_distinct.cast("double"))).cast("int")


def r2_grade(r2: Column) -> Column:
    """Quality label of an R2 score."""
    return (F.when(r2 > GRADE_HIGH, F.lit("high"))
            .when(r2 > GRADE_MEDIUM, F.lit("medium"))
            .otherwise(F.lit("low")))


def residual(y_true: str | Column, y_pred: str | Column) -> Column:
    """C11: ``y_true - y_pred``."""
    return _c(y_true) - _c(y_pred)


def parse_number(col: str | Column) -> Column:
    """Currency text such as ``'$25,000,000 '`` to a double (strip ``$ , space``)."""
    return F.regexp_replace(_c(col).cast("string"), r"[$,\s]", "").try_cast("double")

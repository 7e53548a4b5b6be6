"""The prep plan: the reference's preprocessing as (1) one profile job, (2) a
small rule list decided on the driver, (3) lazy column expressions, (4) one
aggregate for the scaler statistics.

Rules per text column (by name, case-insensitive, then by distinct count):
  height                     -> centimetres (C1)
  weight                     -> first number, mean-imputed (C2, C3)
  date, datetime             -> {col}_year/_month/_day/_hour (C4)
  name, person               -> label code (T1)
  location, city, address    -> split on ',' + one-hot per part if any value has
                                a comma (T3), else label code
  anything else              -> one-hot if < 10 distinct values (T2), else label code
Numeric X columns (including label codes, heights and date parts, but not the
one-hot indicators) are min-max scaled and standardized (population std).
Date and timestamp columns give their four parts under any name. A text target
is label-encoded, unless it is named 'salary' and reads as numbers (currency
text); a non-categorical target named 'salary' is log1p-transformed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.functions import scalar as S
from tabforge.operators import clean, encode, profile, scale
from tabforge.session import materialize

# Column-name triggers of the rules.
HEIGHT_NAMES = ("height",)
WEIGHT_NAMES = ("weight",)
DATE_NAMES = ("date", "datetime")
NAME_NAMES = ("name", "person")
LOCATION_NAMES = ("location", "city", "address")
SALARY_NAME = "salary"


@dataclass
class Rule:
    """A column's rule and its fitted state."""
    column: str
    kind: str                      # height|weight|date|label|split_onehot|onehot
    values: list = field(default_factory=list)   # one-hot values (per part, when split)
    codes: DataFrame | None = None               # label dictionary (value, code)
    mean: float | None = None                    # for missing weights
    dtype: str = "string"

    def fit(self, d: DataFrame) -> None:
        c = self.column
        if self.kind == "weight":
            self.mean = d.agg(F.avg(S.first_number(F.col(f"`{c}`")))).first()[0]
        elif self.kind == "label":
            self.codes = encode.fit_label_codes(clean.fill_unknown(d, [c]), c)
        elif self.kind == "onehot":
            self.values = encode.category_values(d, c)
        elif self.kind == "split_onehot":
            self.values = encode.split_values(d, c)

    def features(self) -> tuple[list[str], bool]:
        """Names of the resulting columns, and whether they are scaled."""
        c = self.column
        if self.kind == "date":
            return [f"{c}_{p}" for p in ("year", "month", "day", "hour")], True
        if self.kind == "onehot":
            return [f"{c}_{v}" for v in self.values], False
        if self.kind == "split_onehot":
            return [f"{c}_part{i}_{v}" for i, part in enumerate(self.values) for v in part], False
        return [c], True

    def apply(self, d: DataFrame) -> DataFrame:
        c, x = self.column, F.col(f"`{self.column}`")
        if self.kind == "height":
            return d.withColumn(c, S.height_cm(x))
        if self.kind == "weight":
            return d.withColumn(c, F.coalesce(S.first_number(x), F.lit(self.mean).cast("double")))
        if self.kind == "date":
            parts = S.date_parts(x, c, self.dtype)
            return d.select(*[F.col(f"`{k}`") for k in d.columns if k != c], *parts)
        if self.kind == "label":
            return encode.apply_label_codes(clean.fill_unknown(d, [c]), c, self.codes)
        if self.kind == "onehot":
            return encode.one_hot(d, c, self.values)
        return encode.split_one_hot(d, c, values=self.values)


@dataclass
class PrepResult:
    data: DataFrame                # key, encoded X columns, target "y"
    features: list[str]            # X columns after encoding
    scaled: list[str]              # numeric X columns that are scaled
    key: str
    target: str = "y"
    rules: list[Rule] = field(default_factory=list)
    n_input: int | None = None

    def standard(self, fit_on: DataFrame | None = None) -> DataFrame:
        return scale.standard_scale(self.data, self.scaled, fit_on)

    def minmax(self, fit_on: DataFrame | None = None) -> DataFrame:
        return scale.minmax_scale(self.data, self.scaled, fit_on)


def plan_rules(df: DataFrame, text_cols: Sequence[str]) -> list[Rule]:
    """One profile job (exact distinct counts + 'has a comma' for every text
    column), then the rule per column."""
    if not text_cols:
        return []
    aggs = []
    for i, c in enumerate(text_cols):
        aggs += [F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}"), S.contains_any(f"`{c}`").alias(f"k{i}")]
    r = df.agg(*aggs).first()
    rules = []
    for i, c in enumerate(text_cols):
        low = c.lower()
        if low in HEIGHT_NAMES:
            rules.append(Rule(c, "height"))
        elif low in WEIGHT_NAMES:
            rules.append(Rule(c, "weight"))
        elif low in DATE_NAMES:
            rules.append(Rule(c, "date"))
        elif low in NAME_NAMES:
            rules.append(Rule(c, "label"))
        elif low in LOCATION_NAMES:
            rules.append(Rule(c, "split_onehot" if r[f"k{i}"] else "label"))
        elif r[f"d{i}"] < encode.ONE_HOT_MAX_DISTINCT:
            rules.append(Rule(c, "onehot"))
        else:
            rules.append(Rule(c, "label"))
    return rules


def preprocess(df: DataFrame, x: Sequence[str], y: str, key: str | None = None,
               is_categorical: bool = False) -> PrepResult:
    """Entry 2 of the reference: validate, drop incomplete rows, encode text
    columns by rule, drop rows whose parse failed, transform the target."""
    clean.validate_selection(df, x, y)
    if key is None:
        key = "_row_id"
        df = df.withColumn(key, F.monotonically_increasing_id())
    d = clean.drop_incomplete(df.select(key, *x, F.col(f"`{y}`").alias("y")))
    types = dict(d.dtypes)
    text_x = [c for c in x if types[c] == "string"]
    time_x = [c for c in x if types[c] in ("date", "timestamp", "timestamp_ntz")]
    rules = plan_rules(d, text_x) + [Rule(c, "date", dtype=types[c]) for c in time_x]
    features: list[str] = [c for c in x if c not in text_x and c not in time_x]
    scaled: list[str] = [c for c in features if profile.is_numeric(types[c])]
    if scaled:  # decimals and integers enter the models as doubles
        d = d.withColumns({c: F.col(f"`{c}`").cast("double") for c in scaled if types[c].startswith("decimal")})
    if types["y"].startswith("decimal"):
        d = d.withColumn("y", F.col("y").cast("double"))
    for rule in rules:
        rule.fit(d)
        d = rule.apply(d)
        names, is_scaled = rule.features()
        features += names
        scaled += names if is_scaled else []
    d = clean.drop_incomplete(d)
    # the encoded table is read by the target transform, the scaler statistics,
    # every pass of a fit and the scoring: write it once to the shared folder
    d = materialize(d, "prep")
    numeric_y = types["y"] != "string"
    if types["y"] == "string" and not is_categorical and y.lower() == SALARY_NAME:
        # currency text: numbers if every value reads as one
        money = d.withColumn("_money", S.parse_number("y"))
        if money.agg(F.bool_and(F.col("_money").isNotNull()).alias("ok")).first()["ok"]:
            d, numeric_y = money.drop("y").withColumnRenamed("_money", "y"), True
    if not numeric_y:
        d = encode.label_encode(d, "y")
    elif not is_categorical and y.lower() == SALARY_NAME:
        d = d.withColumn("y", S.log1p("y"))
    return PrepResult(d, features, scaled, key, "y", rules)

"""The query catalogue: each entry reads the given tables, derives the inputs the
reference's rules need (recipes below, identical in the DuckDB oracles) and runs
one operator of the library over the whole table.

Derived inputs (the tables hold no height/weight/date/location text or NULLs):
  height   concat(p_size div 12, '-', p_size % 12), with 'x' for p_partkey % 10 = 0
           and a three-part text for p_partkey % 10 = 1
  weight   concat(p_retailprice, ' lb'), 'n/a' for p_partkey % 9 = 0
  date     o_orderdate formatted by o_orderkey % 6: yyyy-MM-dd, dd/MM/yyyy,
           MMM d, yyyy, yyyy/MM/dd, MM/dd/yyyy, else 'bad'
  location concat(r_name, ',', n_name)
  missing  o_totalprice is NULL when o_orderkey % 7 = 0
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions import scalar as S
from tabforge.operators import clean, encode, profile, scale, split
from tabforge.sources import csv as csvsrc

# Region and nation names of the test tables (for the one-hot oracle).
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = tuple(f"NATION_{i}" for i in range(25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6) + F.lit(0.0)


# ---- recipes ------------------------------------------------------------------
def height_text():
    h = F.concat((F.col("p_size") / 12).cast("int").cast("string"), F.lit("-"),
                 (F.col("p_size") % 12).cast("string"))
    k = F.col("p_partkey") % 10
    return (F.when(k == 0, F.lit("x")).when(k == 1, F.concat(h, F.lit("-1"))).otherwise(h))


def weight_text():
    return F.when(F.col("p_partkey") % 9 == 0, F.lit("n/a")).otherwise(
        F.concat(F.col("p_retailprice").cast("string"), F.lit(" lb")))


def date_text():
    k = F.col("o_orderkey") % 6
    d = F.col("o_orderdate")
    return (F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
            .when(k == 1, F.date_format(d, "dd/MM/yyyy"))
            .when(k == 2, F.date_format(d, "MMM d, yyyy"))
            .when(k == 3, F.date_format(d, "yyyy/MM/dd"))
            .when(k == 4, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.lit("bad")))


def orders_with_gaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("double"))
                        .otherwise(F.col("o_totalprice")))


def locations(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    # region has one row per region: the planner broadcasts it by size.
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select("n_nationkey", F.concat("r_name", F.lit(","), "n_name").alias("location")))


# ---- profile --------------------------------------------------------------------
def q_column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "orders"))


def _text_profile(name):
    def q(spark, sf_dir):
        return profile.column_profile(table(spark, sf_dir, name))
    q.__name__ = f"q_{name}_profile"
    return q


def q_preview_rows(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "customer"), ["c_custkey"], 5)


def q_display_width(spark, sf_dir):
    return profile.display_width(table(spark, sf_dir, "customer"), ["c_custkey"], 5)


def q_numeric_stats(spark, sf_dir):
    st = profile.numeric_stats(table(spark, sf_dir, "lineitem"))
    return st.select("column_name", "position", r6(F.col("min_value")).alias("min_value"),
                     r6(F.col("max_value")).alias("max_value"),
                     r6(F.col("mean_value")).alias("mean_value"), "n")


def q_missing_report(spark, sf_dir):
    rep = profile.missing_report(orders_with_gaps(spark, sf_dir))
    return rep.withColumn("pct_removed", r6(F.col("pct_removed")))


def q_target_profile(spark, sf_dir):
    return profile.target_profile(table(spark, sf_dir, "orders"), "o_totalprice")


def q_target_frequency(spark, sf_dir):
    return profile.value_frequency(table(spark, sf_dir, "orders"), "o_orderpriority")


def q_continuity_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = profile.continuity(o, ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return c.withColumn("value_range", r6(F.col("value_range")))


# ---- sources ----------------------------------------------------------------------
def part_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("|", *[F.col(c).cast("string") for c in
                                       ["p_partkey", "p_name", "p_brand", "p_type", "p_size",
                                        "p_retailprice"]]).alias("value"))


def q_delimiter_votes(spark, sf_dir):
    v = csvsrc.delimiter_votes(part_lines(spark, sf_dir))
    return v.select("candidate", "n_lines", r6(F.col("mean_count")).alias("mean_count"),
                    r6(F.col("var_count")).alias("var_count"), "min_count", "chosen")


def q_na_tokens(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 10
    raw = (F.when(k == 0, "NA").when(k == 1, "null").when(k == 2, "None").when(k == 3, "NaN")
           .when(k == 4, "").when(k == 5, "n/a").otherwise(F.col("o_custkey").cast("string")))
    t = o.select("o_orderkey", raw.alias("raw"))
    cleaned = csvsrc.null_tokens("raw")
    return t.select("o_orderkey", "raw", cleaned.isNull().alias("is_missing"),
                    cleaned.try_cast("bigint").alias("value"))


def q_bad_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = [F.col(c).cast("string") for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]]
    k = F.col("o_orderkey") % 9
    line = (F.when(k == 0, F.concat_ws(",", *f, F.lit("extra")))
            .when(k == 1, F.concat_ws(",", *f[:3])).otherwise(F.concat_ws(",", *f)))
    lines = o.select("o_orderkey", line.alias("value"))
    parsed = csvsrc.parse_lines(lines, ["f0", "f1", "f2", "f3"], ",", keep=["o_orderkey"])
    return parsed.where(F.col("status") != "long")


# ---- cleaning and scalar rules -------------------------------------------------------
def q_drop_incomplete(spark, sf_dir):
    o = clean.drop_incomplete(orders_with_gaps(spark, sf_dir), ["o_totalprice"])
    d = o.select("o_orderkey", "o_totalprice", *S.date_parts(date_text(), "date")[:3])
    return clean.drop_incomplete(d)


def q_height_cm(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", height_text().alias("height"))
    return p.select("p_partkey", "height", r6(S.height_cm("height")).alias("height_cm"))


def q_weight_number(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", weight_text().alias("weight_text"))
    return p.select("p_partkey", "weight_text", S.first_number("weight_text").alias("weight"))


def q_weight_impute(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", S.first_number(weight_text()).alias("weight"))
    out = clean.impute_mean(p, "weight")
    return out.select("p_partkey", r6(F.col("weight")).alias("weight"))


def q_date_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", date_text().alias("date_text"))
    return o.select("o_orderkey", "date_text", *S.date_parts("date_text", "date"))


def q_location_split(spark, sf_dir):
    loc = locations(spark, sf_dir)
    p0, p1 = S.split_parts("location", 2)
    return loc.select("n_nationkey", "location", p0.alias("location_part0"),
                      p1.alias("location_part1"),
                      F.size(F.split("location", ",")).alias("n_parts"))


def q_location_one_hot(spark, sf_dir):
    return encode.split_one_hot(locations(spark, sf_dir), "location")


def q_label_encode(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return encode.label_encode(p, "p_name", "p_name_code").select("p_partkey", "p_name", "p_name_code")


def q_one_hot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return encode.one_hot(o, "o_orderpriority")


def q_salary_log1p(spark, sf_dir):
    c = table(spark, sf_dir, "customer")  # every row; x <= -1 has no logarithm (NULL)
    return c.select("c_custkey", r6(S.log1p("c_acctbal")).alias("salary_log"))


def q_minmax_scale(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    s = scale.minmax_scale(p, ["p_size", "p_retailprice"])
    return s.select("p_partkey", r6(F.col("p_size")).alias("p_size"),
                    r6(F.col("p_retailprice")).alias("p_retailprice"))


def q_standard_scale(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *cols)
    s = scale.standard_scale(li, cols)
    return s.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in cols])


def q_quantile_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return scale.quantile_bins(o, "o_totalprice", "bin")


def q_iqr_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    return clean.iqr_filter(e, "value")


def q_polynomial_features(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = scale.polynomial_columns(["p_size", "p_retailprice"], 2, "t")
    return p.select("p_partkey", *[r6(e).alias(f"poly_{i}") for i, e in enumerate(terms)])


def q_hash_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.hash_split(o, "o_orderkey")


def q_exact_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return split.exact_split(o, "o_orderkey")


QUERIES = {
    "column_profile": q_column_profile,
    "pages_profile": _text_profile("pages"),
    "conversations_profile": _text_profile("conversations"),
    "benchmark_profile": _text_profile("benchmark"),
    "preview_rows": q_preview_rows,
    "display_width": q_display_width,
    "numeric_stats": q_numeric_stats,
    "missing_report": q_missing_report,
    "target_profile": q_target_profile,
    "target_frequency": q_target_frequency,
    "continuity_check": q_continuity_check,
    "delimiter_votes": q_delimiter_votes,
    "na_tokens": q_na_tokens,
    "bad_lines": q_bad_lines,
    "drop_incomplete": q_drop_incomplete,
    "height_cm": q_height_cm,
    "weight_number": q_weight_number,
    "weight_impute": q_weight_impute,
    "date_parts": q_date_parts,
    "location_split": q_location_split,
    "location_one_hot": q_location_one_hot,
    "label_encode": q_label_encode,
    "one_hot": q_one_hot,
    "salary_log1p": q_salary_log1p,
    "minmax_scale": q_minmax_scale,
    "standard_scale": q_standard_scale,
    "quantile_bins": q_quantile_bins,
    "iqr_filter": q_iqr_filter,
    "polynomial_features": q_polynomial_features,
    "hash_split": q_hash_split,
    "exact_split": q_exact_split,
}


# =================================================================================
# Models, metrics and chart data
# =================================================================================
import uuid  # noqa: E402


from tabforge.operators import chartdata, density, hierarchy, metrics, models, neighbors  # noqa: E402
from tabforge.session import materialize, scratch_path  # noqa: E402


def lineitem_split(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return li.withColumn("is_test", split.is_test(key))


def _fit_ols(df, features, label):
    data = models.assemble(df, features).withColumn("label", F.col(label).cast("double"))
    return models.linear_regression().fit(data.where(~F.col("is_test")))


def _coef_frame(spark, model, names):
    rows = [("intercept", float(model.intercept))] + [
        (n, float(v)) for n, v in zip(names, model.coefficients.toArray())]
    return spark.createDataFrame(rows, "term string, coefficient double")


def q_linear_regression(spark, sf_dir):
    m = _fit_ols(lineitem_split(spark, sf_dir), ["l_quantity"], "l_extendedprice")
    c = _coef_frame(spark, m, ["l_quantity"])
    return c.select("term", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


def q_multiple_regression(spark, sf_dir):
    m = _fit_ols(lineitem_split(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice")
    c = _coef_frame(spark, m, ["l_quantity", "l_discount"])
    return c.select("term", (F.round("coefficient", 4) + 0.0).alias("coefficient"))


def q_polynomial_regression(spark, sf_dir):
    p = split.hash_split(table(spark, sf_dir, "part"), "p_partkey")
    data = models.assemble(p, ["p_size"]).withColumn("label", F.col("p_retailprice"))
    pipe = models.polynomial_regression(2).fit(data.where(~F.col("is_test")))
    lr = pipe.stages[-1]
    c = _coef_frame(spark, lr, ["poly_0", "poly_1"])
    return c.select("term", r6(F.col("coefficient")).alias("coefficient"))


def _predict_ols(df, features, label, key):
    m = _fit_ols(df, features, label)
    data = models.assemble(df, features).withColumn("label", F.col(label).cast("double"))
    return m.transform(data).select(key, *features, "is_test", F.col("label").alias("y_true"),
                                    F.col("prediction").alias("y_pred"))


def q_regression_metrics(spark, sf_dir):
    li = lineitem_split(spark, sf_dir)
    pred = _predict_ols(li, ["l_quantity"], "l_extendedprice", "l_orderkey")
    mt = metrics.regression_metrics(pred)
    return mt.select("n_test", F.round("mse_train", 2).alias("mse_train"),
                     F.round("mse_test", 2).alias("mse_test"), F.round("mse_diff", 2).alias("mse_diff"),
                     r6(F.col("r2")).alias("r2"), "grade")


def _part_test_predictions(spark, sf_dir):
    p = split.hash_split(table(spark, sf_dir, "part"), "p_partkey")
    pred = _predict_ols(p, ["p_size"], "p_retailprice", "p_partkey")
    return pred.where("is_test")


def q_line_series(spark, sf_dir):
    s = chartdata.line_series(_part_test_predictions(spark, sf_dir), "p_partkey")
    return s.select("index", "p_partkey", r6(F.col("y_true")).alias("y_true"),
                    r6(F.col("y_pred")).alias("y_pred"))


def q_residuals(spark, sf_dir):
    s = chartdata.residual_series(_part_test_predictions(spark, sf_dir), "p_partkey")
    return s.select("index", "p_partkey", r6(F.col("residual")).alias("residual"))


def q_scatter_points(spark, sf_dir):
    s = chartdata.scatter_points(_part_test_predictions(spark, sf_dir), ["p_size"], "p_partkey")
    return s.select("p_partkey", "x", F.col("y").cast("double").alias("y"), r6(F.col("label")).alias("label"))


def flagship_frame(spark, sf_dir):
    o = clean.drop_incomplete(orders_with_gaps(spark, sf_dir), ["o_totalprice"])
    d = o.select("o_orderkey", "o_totalprice", "o_orderpriority", *S.date_parts(date_text(), "date"))
    d = clean.drop_incomplete(d, ["date_year"])
    d = encode.one_hot(d, "o_orderpriority")
    # the prepared table feeds the scaler statistics, every pass of the fit and
    # the scoring: write it once to the shared folder instead of re-deriving it
    d = split.hash_split(d, "o_orderkey").transform(materialize)
    feats = ["date_year", "date_month", "date_day"]
    d = scale.standard_scale(d, feats, fit_on=d.where(~F.col("is_test")))
    # the first level is the base: with the intercept, all of them would be collinear
    onehots = sorted(c for c in d.columns if c.startswith("o_orderpriority_"))[1:]
    return d, feats + onehots


def q_flagship(spark, sf_dir):
    d, feats = flagship_frame(spark, sf_dir)
    pred = _predict_ols(d, feats, "o_totalprice", "o_orderkey")
    mt = metrics.regression_metrics(pred)
    return mt.select("n_test", F.round("mse_train", 2).alias("mse_train"),
                     F.round("mse_test", 2).alias("mse_test"), r6(F.col("r2")).alias("r2"), "grade")


# ---- classifiers on embeddings -----------------------------------------------------
def emb_split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return split.hash_split(e, "vec_id").withColumn("label", F.col("label").cast("double"))


def _classify(spark, sf_dir, estimator_fn):
    e = models.assemble(emb_split(spark, sf_dir), ["embedding"])
    est = estimator_fn(e)
    m = est.fit(models.spread(e.where(~F.col("is_test"))))
    out = m.transform(e.where("is_test"))
    return out.select("vec_id", F.col("label").cast("long").alias("y_true"),
                      F.col("prediction").cast("long").alias("y_pred"))


def q_logistic(spark, sf_dir):
    return _classify(spark, sf_dir, lambda e: models.logistic_regression(e.where(~F.col("is_test")).count()))


def q_decision_tree(spark, sf_dir):
    return _classify(spark, sf_dir, lambda e: models.decision_tree(False))


def _vote(spark, sf_dir, forest):
    e = models.assemble(emb_split(spark, sf_dir), ["embedding"])
    out = models.forest_predictions(forest, e.where(~F.col("is_test")),
                                    e.where("is_test").select("vec_id", "label", "features"))
    return out.select("vec_id", F.col("label").cast("long").alias("y_true"),
                      F.col("prediction").cast("long").alias("y_pred"))


def q_bagging(spark, sf_dir):
    return _vote(spark, sf_dir, models.bagging())


def q_forest_classifier(spark, sf_dir):
    return _vote(spark, sf_dir, models.forest_classifier())


def q_svm(spark, sf_dir):
    e = emb_split(spark, sf_dir)
    train = e.where(~F.col("is_test"))
    prepare, ovr = models.svm_rbf(train, ["embedding"], "label")
    m = ovr.fit(prepare(models.spread(train)))
    out = m.transform(prepare(e.where("is_test")))
    return out.select("vec_id", F.col("label").cast("long").alias("y_true"),
                      F.col("prediction").cast("long").alias("y_pred"))


def q_forest_regressor(spark, sf_dir):
    p = split.hash_split(table(spark, sf_dir, "part"), "p_partkey")
    d = models.assemble(p, ["p_size", "p_partkey"]).withColumn("label", F.col("p_retailprice"))
    out = models.forest_predictions(models.forest_regressor(), d.where(~F.col("is_test")),
                                    d.where("is_test").select("p_partkey", "label", "features"))
    return out.select("p_partkey", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))


def _lineitem_tree(spark, sf_dir):
    feats = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    d = models.assemble(lineitem_split(spark, sf_dir), feats).withColumn("label", F.col("l_extendedprice"))
    return models.decision_tree(True).fit(models.spread(d.where(~F.col("is_test")))), feats


def q_feature_importance(spark, sf_dir):
    m, feats = _lineitem_tree(spark, sf_dir)
    return chartdata.feature_importance(spark, m, feats)


def q_tree_nodes(spark, sf_dir):
    m, _ = _lineitem_tree(spark, sf_dir)
    return chartdata.tree_nodes(spark, m, scratch_path(spark, f"tree-{uuid.uuid4().hex}"))


# ---- label metrics ------------------------------------------------------------------
def label_pairs(spark, sf_dir):
    lb = table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


def q_accuracy_error(spark, sf_dir):
    a = metrics.accuracy(label_pairs(spark, sf_dir))
    return a.select("n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("error_rate")).alias("error_rate"))


def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(label_pairs(spark, sf_dir))


def q_label_union(spark, sf_dir):
    lp = label_pairs(spark, sf_dir)
    return profile.label_union(lp, "y_true", lp, "y_pred")


def roc_input(spark, sf_dir):
    """One-vs-rest rows (class, y, score) from ONE scan of the joined tables: each
    example is exploded into one row per class (score = n_chars for class 1 and
    -n_chars, i.e. 1 - p, for class 0)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lb = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lb, "doc_id")
    s = F.col("n_chars").cast("double")
    per_class = F.array(
        F.struct(F.lit(1).alias("class"), (F.col("quality") == 1).cast("int").alias("y"), s.alias("score")),
        F.struct(F.lit(0).alias("class"), (F.col("quality") == 0).cast("int").alias("y"), (-s).alias("score")))
    return j.select(F.explode(per_class).alias("r")).select("r.*")


def q_roc_points(spark, sf_dir):
    pts = metrics.roc_points(roc_input(spark, sf_dir), "y", "score")
    return pts.select("class", "pos", "threshold", r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


def q_roc_auc(spark, sf_dir):
    a = metrics.roc_auc(roc_input(spark, sf_dir), "y", "score")
    return a.select("class", r6(F.col("auc")).alias("auc"))


# ---- neighbours ---------------------------------------------------------------------
def _knn_sets(spark, sf_dir):
    e = emb_split(spark, sf_dir).select("vec_id", "embedding", F.col("label").cast("long").alias("label"),
                                        "is_test")
    train = e.where(~F.col("is_test")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    test = e.where("is_test").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return train, test


def q_knn_classify(spark, sf_dir):
    train, test = _knn_sets(spark, sf_dir)
    nb = neighbors.knn(train, test.select("id", "vec"), 5)
    v = neighbors.vote(nb)
    return (test.select(F.col("id").alias("vec_id"), F.col("label").alias("y_true"))
            .join(v.select(F.col("q_id").alias("vec_id"), F.col("y_pred").cast("long")), "vec_id"))


def q_knn_regress(spark, sf_dir):
    train, test = _knn_sets(spark, sf_dir)
    nb = neighbors.knn(train, test.select("id", "vec"), 5)
    r = neighbors.regress(nb)
    return (test.select(F.col("id").alias("vec_id"), F.col("label").cast("double").alias("y_true"))
            .join(r.select(F.col("q_id").alias("vec_id"), r6(F.col("y_pred")).alias("y_pred")), "vec_id"))


def q_k_value_curve(spark, sf_dir):
    _, test = _knn_sets(spark, sf_dir)
    k_max = neighbors.k_max_for(test.count())
    nb = neighbors.knn(test, test.select("id", "vec"), k_max)
    truth = test.select(F.col("id").alias("q_id"), F.col("label").alias("y_true"))
    c = neighbors.k_value_curve(nb, truth, k_max)
    return c.select(F.col("k").cast("int"), r6(F.col("accuracy")).alias("accuracy"))


# ---- clustering -------------------------------------------------------------------------
def part_standard(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return scale.standard_scale(p, ["p_size", "p_retailprice"])


def q_dbscan(spark, sf_dir):
    p = part_standard(spark, sf_dir).select("p_partkey", F.array("p_size", "p_retailprice").alias("v"))
    return density.dbscan(p, "p_partkey", "v", eps=0.1, min_samples=5)


def q_cluster_summary(spark, sf_dir):
    return profile.cluster_counts(q_dbscan(spark, sf_dir), "cluster")


def q_boundary_grid(spark, sf_dir):
    p = part_standard(spark, sf_dir)
    r = p.agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    g = chartdata.boundary_grid(spark, (r[0], r[1]), (r[2], r[3]))
    return g.select("i", "j", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def emb_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return models.assemble(e, ["embedding"])


def q_kmeans(spark, sf_dir):
    e = emb_vectors(spark, sf_dir)
    m = models.kmeans(8).fit(e)
    return m.transform(e).select("vec_id", F.col("cluster").cast("long"))


def q_elbow_k1(spark, sf_dir):
    c = chartdata.elbow_curve(emb_vectors(spark, sf_dir), k_max=1)
    return c.select("k", (F.round("inertia", 4) + 0.0).alias("inertia"))


def q_elbow_curve(spark, sf_dir):
    return chartdata.elbow_curve(emb_vectors(spark, sf_dir))


def q_ward_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    labels, _ = hierarchy.ward(e, "vec_id", "embedding", 2)
    return labels


def q_ward_linkage(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    _, link = hierarchy.ward(e, "vec_id", "embedding", 2, leaves=None)
    return link


# ---- feature selection ---------------------------------------------------------------------
def q_mi_top_k(spark, sf_dir):
    from tabforge.operators import select as sel
    li = table(spark, sf_dir, "lineitem")
    mi = sel.mutual_information(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey",
                                     "l_suppkey"], "l_extendedprice", bins=10)
    return sel.top_k(mi, 10).select("feature", r6(F.col("mi")).alias("mi"))


def q_pca_ratio(spark, sf_dir):
    from tabforge.operators import select as sel
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    s = scale.standard_scale(c, ["c_acctbal", "c_nationkey"])
    r = sel.pca_variance(s, ["c_acctbal", "c_nationkey"])
    return r.select("component", r6(F.col("explained_ratio")).alias("explained_ratio"),
                    r6(F.col("cumulative")).alias("cumulative"), "kept")


# ---- sources round trip ----------------------------------------------------------------------
def q_csv_roundtrip(spark, sf_dir):
    from tabforge.sources import sinks
    path = scratch_path(spark, f"customer-csv-{uuid.uuid4().hex}")
    sinks.write_csv(table(spark, sf_dir, "customer"), path)
    back = csvsrc.read_table(spark, path)
    return back


# ---- the whole prep plan and the model runner ----------------------------------------
def _customer_prep(spark, sf_dir):
    from tabforge.plans import prep as P
    c = table(spark, sf_dir, "customer")
    return P.preprocess(c, ["c_nationkey", "c_name", "c_mktsegment"], "c_acctbal", key="c_custkey")


def q_prep_table(spark, sf_dir):
    """Entry 2 end to end: profile job -> rules (c_name: label code by its name,
    c_mktsegment: one-hot, 5 values) -> standardized numeric features."""
    res = _customer_prep(spark, sf_dir)
    std = res.standard()
    onehots = [f for f in res.features if f not in res.scaled]
    return std.select("c_custkey", *[r6(F.col(f"`{f}`")).alias(f) for f in res.scaled],
                      *[F.col(f"`{f}`") for f in onehots], F.col("y").alias("c_acctbal"))


def q_prep_rules(spark, sf_dir):
    res = _customer_prep(spark, sf_dir)
    return spark.createDataFrame([(r.column, r.kind) for r in res.rules], "column_name string, rule string")


def q_model_run(spark, sf_dir):
    """Entry 3 end to end: the runner on the prepared customer table, as its run record."""
    from tabforge.plans import runner
    res = runner.run_model(_customer_prep(spark, sf_dir), "Linear_Regression")
    return res.report()


QUERIES.update({
    "prep_table": q_prep_table,
    "prep_rules": q_prep_rules,
    "model_run": q_model_run,
    "linear_regression": q_linear_regression,
    "multiple_regression": q_multiple_regression,
    "polynomial_regression": q_polynomial_regression,
    "regression_metrics": q_regression_metrics,
    "line_series": q_line_series,
    "residuals": q_residuals,
    "scatter_points": q_scatter_points,
    "flagship": q_flagship,
    "logistic": q_logistic,
    "decision_tree": q_decision_tree,
    "bagging": q_bagging,
    "forest_classifier": q_forest_classifier,
    "forest_regressor": q_forest_regressor,
    "svm": q_svm,
    "feature_importance": q_feature_importance,
    "tree_nodes": q_tree_nodes,
    "accuracy_error": q_accuracy_error,
    "confusion_matrix": q_confusion_matrix,
    "label_union": q_label_union,
    "roc_points": q_roc_points,
    "roc_auc": q_roc_auc,
    "knn_classify": q_knn_classify,
    "knn_regress": q_knn_regress,
    "k_value_curve": q_k_value_curve,
    "dbscan": q_dbscan,
    "cluster_summary": q_cluster_summary,
    "boundary_grid": q_boundary_grid,
    "kmeans": q_kmeans,
    "elbow_k1": q_elbow_k1,
    "elbow_curve": q_elbow_curve,
    "ward_clusters": q_ward_clusters,
    "ward_linkage": q_ward_linkage,
    "mi_top_k": q_mi_top_k,
    "pca_ratio": q_pca_ratio,
    "csv_roundtrip": q_csv_roundtrip,
})

"""Queries that state checkable facts about fitted models, computed from all rows, and
queries for the parts that plain results cannot show (saved runs, preparation rules, the
runner's model names, CSV round trips, decision boundaries). Every one has an oracle."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.operators import chartdata, metrics, models
from tabforge.plans import catalogue as C
from tabforge.plans import oracles as O
from tabforge.plans import prep as P
from tabforge.plans import runner as R
from tabforge.plans import saved
from tabforge.session import materialize, scratch_path
from tabforge.sources import charset
from tabforge.sources import csv as csvsrc
from tabforge.sources import sinks


def q_r2_large_offset(spark, sf_dir):
    """X1 where the target is far from zero: the squares cancel unless R2 is stable."""
    li = C.lineitem_split(spark, sf_dir)
    pred = li.select(F.col("is_test"), (F.col("l_quantity") + F.lit(1e9)).alias("y_true"),
                     (F.col("l_quantity") + F.lit(1e9) + F.col("l_discount") * 20).alias("y_pred"))
    return metrics.regression_metrics(pred).select("n_test", F.round("r2", 4).alias("r2"), "grade")


def q_auc_one_sided(spark, sf_dir):
    """X4 with classes that have no negatives (``all``) or no positives (``none``)."""
    d = C.table(spark, sf_dir, "documents").join(C.table(spark, sf_dir, "labels"), "doc_id")
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("class"), y.cast("int").alias("y")) for n, y in (
        ("all", F.lit(1)), ("none", F.lit(0)), ("quality", F.col("quality")))])).alias("c")
    scored = d.select(F.col("n_chars").cast("double").alias("score"), rows).select("score", "c.*")
    return metrics.roc_auc(scored, "y", "score").select("class", C.r6(F.col("auc")).alias("auc"))


def q_csv_documents(spark, sf_dir):
    """S1 over texts with line breaks, quotes and separators: write, read back."""
    path = scratch_path(spark, f"documents-csv-{uuid.uuid4().hex}")
    d = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    d.write.option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(path)
    return csvsrc.read_table(spark, path, sep=",")


_VOTES = ("candidate", "n_bytes", "n_high", "n_zero", "n_invalid")


def q_charset_documents(spark, sf_dir):
    """S3 over a written file of all texts: malformed bytes per candidate charset."""
    path = scratch_path(spark, f"documents-text-{uuid.uuid4().hex}")
    C.table(spark, sf_dir, "documents").select("text").write.text(path, lineSep="\n")
    return charset.charset_votes(charset.byte_lines(spark, path)).select(*_VOTES)


def q_charset_bytes(spark, sf_dir):
    """S3 over lines of arbitrary bytes: 16 of them per event."""
    lines = C.table(spark, sf_dir, "events").select(F.unhex(F.md5(F.col("event_id").cast("string"))).alias("value"))
    return charset.charset_votes(lines).select(*_VOTES)


def q_csv_charset(spark, sf_dir):
    """All texts written in a single-byte charset, told and read back."""
    path = scratch_path(spark, f"documents-latin-{uuid.uuid4().hex}")
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("caf\u00e9 "), "text").alias("text"))
    d.write.options(header=True, escape='"', quoteAll=True, lineSep="\n", encoding="ISO-8859-1").csv(path)
    return csvsrc.read_table(spark, path, sep=",")


def q_csv_types(spark, sf_dir):
    """S1 types: whole numbers, numbers, truth values, and texts that only look like numbers."""
    path = scratch_path(spark, f"types-csv-{uuid.uuid4().hex}")
    e = C.table(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 2 == 0).alias("even"),
                                                F.concat(F.col("user_id"), F.lit("D")).alias("seat"))
    sinks.write_csv(e, path)
    back = csvsrc.read_table(spark, path, sep=",")
    return back.select("event_id", F.round("value", 6).alias("value"), F.col("even").cast("boolean").alias("even"),
                       F.col("seat").cast("string").alias("seat"))


# ---- preparation rules, one by one -----------------------------------------------------------
def q_rule_height_weight(spark, sf_dir):
    p = C.table(spark, sf_dir, "part").select("p_partkey", C.height_text().alias("height"), C.weight_text().alias("weight"),
                                              F.col("p_retailprice").alias("y"))
    return P.preprocess(p, ["height", "weight"], "y", key="p_partkey").data.select(
        "p_partkey", C.r6(F.col("height")).alias("height"), C.r6(F.col("weight")).alias("weight"))


def q_rule_date_typed(spark, sf_dir):
    o = C.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("shipped"), "o_totalprice")
    d = P.preprocess(o, ["shipped"], "o_totalprice", key="o_orderkey").data
    return d.select("o_orderkey", *[F.col(f"shipped_{p}").cast("long").alias(p) for p in ("year", "month", "day", "hour")])


def q_rule_location(spark, sf_dir):
    c = C.locations(spark, sf_dir)
    key = [n for n, t in c.dtypes if t in ("int", "bigint")][0]
    text = [n for n, t in c.dtypes if t == "string"][-1]
    c = c.select(F.col(key).alias("k"), F.col(text).alias("location"), F.col(key).cast("double").alias("y"))
    r = P.preprocess(c, ["location"], "y", key="k")
    return r.data.select("k", sum((F.col(f"`{f}`") for f in r.features), F.lit(0)).cast("long").alias("set_parts"))


def q_rule_salary_text(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(
        "c_custkey", "c_nationkey", F.concat(F.lit("$"), F.format_number("c_acctbal", 2), F.lit(" ")).alias("salary"))
    return P.preprocess(c, ["c_nationkey"], "salary", key="c_custkey").data.select("c_custkey", C.r6(F.col("y")).alias("y"))


def q_rule_text_target(spark, sf_dir):
    c = C.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return P.preprocess(c, ["c_acctbal"], "c_mktsegment", key="c_custkey").data.select("c_custkey", F.col("y").cast("long").alias("y"))


# ---- models ----------------------------------------------------------------------------------
def q_fact_flagship_normal_equations(spark, sf_dir):
    """OLS: residuals of the training rows are orthogonal to every feature."""
    d, feats = C.flagship_frame(spark, sf_dir)
    pred = C._predict_ols(d, feats, "o_totalprice", "o_orderkey")
    rows = d.where("NOT is_test").select("o_orderkey", *feats).join(pred.select("o_orderkey", "y_true", "y_pred"), "o_orderkey")
    e = F.col("y_true") - F.col("y_pred")
    stats = rows.agg(*[(F.abs(F.sum(e * F.col(f"`{f}`"))) / F.sum(F.abs(e) * (F.abs(F.col(f"`{f}`")) + 1e-9)) < 1e-6).alias(f)
                       for f in feats], (F.abs(F.sum(e)) / F.sum(F.abs(e)) < 1e-6).alias("intercept"))
    return stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("orthogonal"))
                                            for c in [*feats, "intercept"]])).alias("s")).select("s.*")


def q_fact_logistic_optimum(spark, sf_dir):
    """Multinomial logistic regression: the penalised gradient vanishes for every class."""
    e = materialize(models.assemble(C.emb_split(spark, sf_dir).where(~F.col("is_test")), ["embedding"]), "fact-logistic")
    n = e.count()
    m = models.logistic_regression(n).fit(e)
    out = m.transform(e).select(F.col("embedding").alias("x"), F.col("label").cast("int").alias("c"),
                                vector_to_array("probability").alias("p"))
    r = out.select("x", F.posexplode(F.transform("p", lambda v, i: v - (i == F.col("c")).cast("double"))).alias("k", "r"))
    g = r.select("k", "r", F.posexplode("x").alias("j", "x")).groupBy("k", "j").agg((F.sum(F.col("r") * F.col("x")) / n).alias("g"))
    w = m.coefficientMatrix.toArray()
    pen = spark.createDataFrame([(k, j, float(w[k, j]) / n) for k in range(w.shape[0]) for j in range(w.shape[1])], "k int, j int, w double")
    return (g.join(pen, ["k", "j"]).groupBy("k").agg((F.max(F.abs(F.col("g") + F.col("w"))) < 1e-3).alias("at_optimum"))
            .select(F.col("k").cast("long").alias("class"), "at_optimum"))


def _beats_majority(spark, sf_dir, build) -> DataFrame:
    """Training accuracy above the share of the most frequent class."""
    e = models.assemble(C.emb_split(spark, sf_dir).where(~F.col("is_test")), ["embedding"]).withColumn("k", F.col("vec_id"))
    pred = build(e).select(F.col("label").alias("y"), "prediction")
    hit = pred.agg(F.count(F.lit(1)).alias("n_train"), F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("a")).first()
    top = pred.groupBy("y").count().agg(F.max("count").alias("m")).first()["m"]
    return spark.createDataFrame([(hit["n_train"], hit["a"] > top / hit["n_train"])], "n_train long, beats_majority boolean")


def q_fact_decision_tree(spark, sf_dir):
    return _beats_majority(spark, sf_dir, lambda e: models.decision_tree(False).fit(models.spread(e)).transform(e))


def q_fact_bagging(spark, sf_dir):
    return _beats_majority(spark, sf_dir, lambda e: models.bagging(max_depth=12).fit(models.spread(e)).transform(e))


def q_fact_forest_classifier(spark, sf_dir):
    return _beats_majority(spark, sf_dir, lambda e: models.forest_classifier(max_depth=8).fit(models.spread(e)).transform(e))


def q_fact_svm(spark, sf_dir):
    def build(e):
        prepare, ovr = models.svm_rbf(e, ["embedding"], "label")
        z = e.drop("features")
        return ovr.fit(prepare(models.spread(z))).transform(prepare(z))
    return _beats_majority(spark, sf_dir, build)


def q_fact_forest_regressor(spark, sf_dir):
    """The forest's training error is below the target's variance."""
    d = models.assemble(C.table(spark, sf_dir, "part"), ["p_size", "p_partkey"]).withColumn("label", F.col("p_retailprice"))
    out = models.forest_regressor(max_depth=10).fit(models.spread(d)).transform(d)
    return out.agg(F.count(F.lit(1)).alias("n"), (F.avg((F.col("label") - F.col("prediction")) ** 2) < F.var_pop("label")).alias("below_variance"))


def q_fact_tree_counts(spark, sf_dir):
    """Every inner node's rows are its children's rows; the root has the training rows."""
    n = C.q_tree_nodes(spark, sf_dir).select("id", "leftChild", "rightChild", "rawCount")
    kids = n.select(F.col("id").alias("c"), F.col("rawCount").alias("rows"))
    inner = n.where("leftChild >= 0").select("id", "rawCount", F.explode(F.array("leftChild", "rightChild")).alias("c"))
    sums = inner.join(kids, "c").groupBy("id", "rawCount").agg(F.sum("rows").alias("s"))
    root = n.where("id = 0").select(F.col("rawCount").cast("long").alias("root_rows"))
    bad = sums.agg(F.count_if(F.col("s") != F.col("rawCount")).alias("bad")).first()["bad"]
    return root.withColumn("children_add_up", F.lit(bad == 0))


def q_fact_importances(spark, sf_dir):
    return C.q_feature_importance(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_features"), F.round(F.sum("importance"), 6).alias("total"),
                                                     F.min((F.col("importance") >= 0).cast("int")).alias("non_negative"))


def q_fact_kmeans_nearest(spark, sf_dir):
    """Every row is nearest to its own cluster's centre."""
    e = C.emb_vectors(spark, sf_dir)
    m = models.kmeans(8).fit(e)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in m.clusterCenters()])
    v = vector_to_array("features")
    d2 = F.transform(centres, lambda c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = m.transform(e).withColumn("d", d2)
    return out.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.get("d", F.col("cluster")) <= F.array_min("d") + 1e-9).alias("all_nearest"))


def q_fact_elbow(spark, sf_dir):
    """Inertia for k = 1..10, and that no k is worse than k = 1."""
    c = C.q_elbow_curve(spark, sf_dir)
    return c.agg(F.count(F.lit(1)).alias("n_k"), (F.max("inertia") == F.max(F.when(F.col("k") == 1, F.col("inertia")))).alias("k1_is_worst"))


def q_fact_ward(spark, sf_dir):
    """The linkage has a merge for every row but one, ends with all rows, and its distances
    never fall."""
    link = materialize(C.q_ward_linkage(spark, sf_dir), "fact-ward")
    nxt = link.select((F.col("step") - 1).alias("step"), F.col("distance").alias("next"))
    falls = link.join(nxt, "step").where(F.col("next") < F.col("distance")).count()
    return link.agg(F.count(F.lit(1)).alias("n_merges"), F.max("size").alias("root_size"), F.lit(falls == 0).alias("rising"),
                    (F.count_distinct("left") + F.count_distinct("right")).alias("n_children"))


def _run(name: str):
    def q(spark, sf_dir):
        c = C.table(spark, sf_dir, "customer").withColumn("segment", F.col("c_mktsegment"))
        prep = P.preprocess(c, ["c_nationkey", "segment"], "c_acctbal", key="c_custkey")
        r = R.run_model(prep, name)
        return r.predictions.agg(F.lit(name).alias("model"), F.lit(r.status).alias("status"), F.count(F.lit(1)).alias("n_rows"))
    return q


def q_saved_run(spark, sf_dir):
    """A saved run scores the RAW table as the run in memory did."""
    c = C.table(spark, sf_dir, "customer").withColumn("name", F.col("c_name"))
    x = ["c_nationkey", "name", "c_mktsegment"]
    prep = P.preprocess(c, x, "c_acctbal", key="c_custkey")
    run = R.run_model(prep, "Linear_Regression")
    path = saved.save_run(prep, run, scratch_path(spark, f"saved-{uuid.uuid4().hex}"))
    scores = saved.load_run(spark, path).score(c.select("c_custkey", *x), "c_custkey")
    return (run.predictions.select("c_custkey", "y_pred").join(scores, "c_custkey")
            .select("c_custkey", (F.abs(F.col("y_pred") - F.col("prediction")) < 1e-6).alias("same")))


def q_boundary_predictions(spark, sf_dir):
    """V8: OLS predictions over the decision-boundary grid."""
    p = C.part_standard(spark, sf_dir).withColumn("label", (F.col("p_partkey") % 7).cast("double"))
    m = models.linear_regression().fit(models.assemble(p, ["p_size", "p_retailprice"]))
    r = p.agg(F.min("p_size"), F.max("p_size"), F.min("p_retailprice"), F.max("p_retailprice")).first()
    out = chartdata.boundary_predictions(spark, ["p_size", "p_retailprice"], (r[0], r[1]), (r[2], r[3]),
                                         lambda g: m.transform(models.assemble(g, ["p_size", "p_retailprice"])))
    return out.select("i", "j", F.round("prediction", 4).alias("prediction"))


def majority_oracle() -> str:
    return f"SELECT count(*) AS n_train, true AS beats_majority FROM {O.EMB_SPLIT} WHERE NOT is_test"


QUERIES = {
    "r2_large_offset": q_r2_large_offset, "auc_one_sided": q_auc_one_sided, "csv_documents": q_csv_documents, "csv_types": q_csv_types,
    "charset_documents": q_charset_documents, "charset_bytes": q_charset_bytes, "csv_charset": q_csv_charset,
    "rule_height_weight": q_rule_height_weight, "rule_date_typed": q_rule_date_typed, "rule_location": q_rule_location,
    "rule_salary_text": q_rule_salary_text, "rule_text_target": q_rule_text_target,
    "fact_flagship_normal_equations": q_fact_flagship_normal_equations, "fact_logistic_optimum": q_fact_logistic_optimum,
    "fact_decision_tree": q_fact_decision_tree, "fact_bagging": q_fact_bagging, "fact_forest_classifier": q_fact_forest_classifier,
    "fact_svm": q_fact_svm, "fact_forest_regressor": q_fact_forest_regressor, "fact_tree_counts": q_fact_tree_counts,
    "fact_importances": q_fact_importances, "fact_kmeans_nearest": q_fact_kmeans_nearest, "fact_elbow": q_fact_elbow, "fact_ward": q_fact_ward,
    "saved_run": q_saved_run, "boundary_predictions": q_boundary_predictions,
    **{f"run_{m.lower()}": _run(m) for m in models.MODEL_NAMES},
}

# Well-formed byte sequences as pairs of hexadecimal digits (for RE2).
_H = "(?:A[1-9A-F]|[B-E].|F[0-9A-E])"
_HEX_SEQUENCES = {
    "utf-8": "(?:C[2-9A-F]|D.)[89AB].|E0[AB].[89AB].|(?:E[1-9A-CEF])[89AB].[89AB].|ED[89].[89AB].|F0[9AB].[89AB].[89AB]."
             "|F[1-3][89AB].[89AB].[89AB].|F48.[89AB].[89AB].",
    "euc_kr": f"(?:A[1-9A-F]|[B-E].|F[0-9A-D]){_H}",
    "euc_jp": f"{_H}{_H}|8E(?:A[1-9A-F]|[BCD].)|8F{_H}{_H}",
    "shift_jis": "(?:A[1-9A-F]|[BCD].)|(?:8[1-9A-F]|9.|E.|F[0-9A-C])(?:[4-6].|7[0-9A-E]|[89A-E].|F[0-9A-C])",
    "gb18030": "(?:8[1-9A-F]|[9A-E].|F[0-9A-E])(?:[4-6].|7[0-9A-E]|[89A-E].|F[0-9A-E])"
               "|(?:8[1-9A-F]|[9A-E].|F[0-9A-E])3[0-9](?:8[1-9A-F]|[9A-E].|F[0-9A-E])3[0-9]",
    "big5": f"(?:A[1-9A-F]|[B-E].|F[0-9])(?:[4-6].|7[0-9A-E]|{_H})",
    "cp1252": "8[02-9A-CE]|9[1-9A-CEF]|[A-F].",
}


def charset_oracle(source: str) -> str:
    """``source``: a subquery with the lines' bytes as hexadecimal text ``x``. Each step takes
    whole bytes; what no sequence explains is kept, one byte at a time."""
    left = lambda p: f"length(regexp_replace(x, '[0-7].|{p}|(..)', '\\1', 'g')) // 2"
    high = "length(regexp_replace(x, '[0-7].|(..)', '\\1', 'g')) // 2"
    zero = "length(regexp_replace(x, '(00)|..', '\\1', 'g')) // 2"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS candidate, sum(length(x) // 2)::BIGINT AS n_bytes, sum({high})::BIGINT AS n_high, "
        f"sum({zero})::BIGINT AS n_zero, sum({left(p)})::BIGINT AS n_invalid FROM ({source})" for c, p in _HEX_SEQUENCES.items())


_HEIGHT = "((p_size // 12) * 12 + p_size % 12) * 2.54::DOUBLE"
ORACLES = {
    "r2_large_offset": f"""SELECT count(*) AS n_test, round(1 - sum((l_discount * 20) ^ 2) / (var_pop(l_quantity) * count(*)), 4) AS r2,
        CASE WHEN 1 - sum((l_discount * 20) ^ 2) / (var_pop(l_quantity) * count(*)) > 0.8 THEN 'high'
             WHEN 1 - sum((l_discount * 20) ^ 2) / (var_pop(l_quantity) * count(*)) > 0.5 THEN 'medium' ELSE 'low' END AS grade
        FROM {O.LI_SPLIT} WHERE is_test""",
    "auc_one_sided": O.ROC_INPUT + """ SELECT 'quality' AS class, round(sum(fp_n / N * (2 * tps - tp_n) / P / 2), 6) + 0.0 AS auc FROM c WHERE class = 1
        UNION ALL SELECT 'all', NULL UNION ALL SELECT 'none', NULL""",
    "csv_documents": "SELECT doc_id, nullif(text, '') AS text, lang, n_chars FROM documents",
    "charset_documents": charset_oracle("SELECT hex(replace(text, chr(10), '')) AS x FROM documents"),
    "charset_bytes": charset_oracle("SELECT upper(md5(event_id::VARCHAR)) AS x FROM events"),
    "csv_charset": """SELECT doc_id, regexp_replace('caf\u00e9 ' || text, '[^\\x{0}-\\x{ff}]', '?', 'g') AS text FROM documents""",
    "csv_types": "SELECT event_id, round(value, 6) AS value, user_id % 2 = 0 AS even, concat(user_id, 'D') AS seat FROM events",
    "rule_height_weight": f"""WITH w AS (SELECT avg(p_retailprice) FILTER (p_partkey % 9 <> 0) AS m FROM part)
        SELECT p_partkey, round({_HEIGHT}, 6) + 0.0 AS height, round(CASE WHEN p_partkey % 9 = 0 THEN m ELSE p_retailprice END, 6) + 0.0 AS weight
        FROM part, w WHERE p_partkey % 10 > 1""",
    "rule_date_typed": """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month, day(o_orderdate) AS day,
        hour(o_orderdate) AS hour FROM orders""",
    "rule_location": "SELECT n_nationkey AS k, 2 AS set_parts FROM nation",
    "rule_salary_text": "SELECT c_custkey, round(ln(1 + round(c_acctbal, 2)), 6) + 0.0 AS y FROM customer WHERE c_acctbal > 0",
    "rule_text_target": "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS y FROM customer",
    "fact_flagship_normal_equations": """SELECT unnest(['date_year', 'date_month', 'date_day', 'intercept']) AS feature, true AS orthogonal
        UNION ALL SELECT 'o_orderpriority_' || p, true FROM (SELECT DISTINCT o_orderpriority AS p FROM orders)
        WHERE p > (SELECT min(o_orderpriority) FROM orders)""",
    "fact_logistic_optimum": "SELECT DISTINCT CAST(label AS BIGINT) AS class, true AS at_optimum FROM embeddings",
    "fact_forest_regressor": "SELECT count(*) AS n, true AS below_variance FROM part",
    "fact_tree_counts": f"SELECT count(*) AS root_rows, true AS children_add_up FROM {O.LI_TRAIN}",
    "fact_importances": "SELECT 4 AS n_features, CAST(1 AS DOUBLE) AS total, 1 AS non_negative",
    "fact_kmeans_nearest": "SELECT count(*) AS n, true AS all_nearest FROM embeddings",
    "fact_ward": "SELECT count(*) - 1 AS n_merges, count(*) AS root_size, true AS rising, 2 * (count(*) - 1) AS n_children FROM embeddings",
    "fact_elbow": "SELECT 10 AS n_k, true AS k1_is_worst",
    "saved_run": "SELECT c_custkey, true AS same FROM customer",
    "boundary_predictions": f"""WITH p AS (SELECT x, y, CAST(p_partkey % 7 AS DOUBLE) AS z FROM {O.PART_STD}),
        s AS (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz,
                     avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p),
        b AS (SELECT (xz * yy - yz * xy) / (xx * yy - xy * xy) AS bx, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b_y, mx, my, mz FROM s),
        g AS ({O.GRID})
        SELECT i, j, round(mz + bx * (x - mx) + b_y * (y - my), 4) AS prediction FROM g, b""",
    **{f"fact_{m}": majority_oracle() for m in ("decision_tree", "bagging", "forest_classifier", "svm")},
    **{f"run_{m.lower()}": f"SELECT '{m}' AS model, 'ok' AS status, count(*) AS n_rows FROM customer" for m in models.MODEL_NAMES},
}

"""DuckDB SQL for every catalogue query that SQL can express (same recipes,
same column names; floats rounded to 6 places on both sides)."""

from __future__ import annotations

from tabforge.plans.catalogue import NATIONS, REGIONS

HEIGHT = """CASE WHEN p_partkey % 10 = 0 THEN 'x'
     WHEN p_partkey % 10 = 1 THEN concat(p_size // 12, '-', p_size % 12, '-1')
     ELSE concat(p_size // 12, '-', p_size % 12) END"""
WEIGHT = "CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE concat(p_retailprice, ' lb') END"
DATE_TEXT = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
     WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%b %-d, %Y')
     WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y')
     ELSE 'bad' END"""
PARSE_DATE = """coalesce(try_strptime({c}, '%Y-%m-%d'), try_strptime({c}, '%d/%m/%Y'),
     try_strptime({c}, '%b %d, %Y'), try_strptime({c}, '%Y/%m/%d'), try_strptime({c}, '%m/%d/%Y'))"""
FIRST_NUMBER = "try_cast(nullif(regexp_extract({c}, '([0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE)"
NA_LIST = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', "
           "'1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")
IS_TEST = "substring(md5(concat(CAST({k} AS VARCHAR), '-42')), 1, 8) < '4ccccccc'"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _column_profile() -> str:
    cols = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS data_type, "
        f"CAST(count({c}) AS BIGINT) AS non_null FROM orders" for i, (c, t) in enumerate(cols))


def _profile(tab: str, cols: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS data_type, "
        f"CAST(count({c}) AS BIGINT) AS non_null FROM {tab}" for i, (c, t) in enumerate(cols))


def _display_width() -> str:
    cols = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    head = "(SELECT * FROM customer ORDER BY c_custkey LIMIT 5)"
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, "
        f"CAST(greatest(coalesce(max(length(CAST({c} AS VARCHAR))), 0), {len(c)}) * 8 AS BIGINT) AS width "
        f"FROM {head}" for i, c in enumerate(cols))


def _numeric_stats() -> str:
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax"]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i} AS position, {r6(f'min({c})::DOUBLE')} AS min_value, "
        f"{r6(f'max({c})::DOUBLE')} AS max_value, {r6(f'avg({c})::DOUBLE')} AS mean_value, "
        f"CAST(count({c}) AS BIGINT) AS n FROM lineitem" for i, c in enumerate(cols))


def _continuity() -> str:
    parts = []
    for i, (c, numeric) in enumerate([("o_totalprice", True), ("o_custkey", True),
                                      ("o_orderstatus", False), ("o_orderpriority", False)]):
        rng = f"(max({c}) - min({c}))::DOUBLE" if numeric else "NULL::DOUBLE"
        cont = f"(count(DISTINCT {c}) > 10 AND coalesce({rng} > 1.0, false))" if numeric else "false"
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {r6(rng)} AS value_range, "
                     f"{cont} AS is_continuous FROM orders")
    return " UNION ALL ".join(parts)


def _delimiter_votes() -> str:
    line = ("concat_ws('|', p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)")
    cands = [(",", "','"), (";", "';'"), ("\t", "chr(9)"), (" ", "' '"), ("|", "'|'")]
    per = []
    for i, (_c, lit) in enumerate(cands):
        stripped = f"regexp_replace({line}, '\"([^\"]|\"\")*\"', '', 'g')"
        cnt = f"(length({stripped}) - length(replace({stripped}, {lit}, '')))"
        per.append(f"SELECT {lit} AS candidate, {i} AS pref, count(*) AS n_lines, avg({cnt}) AS m, "
                   f"var_pop({cnt}) AS v, min({cnt}) AS mn FROM part")
    return f"""WITH s AS ({' UNION ALL '.join(per)}),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN m >= 1 THEN 0 ELSE 1 END, v, m DESC, pref) AS rk FROM s)
SELECT candidate, CAST(n_lines AS BIGINT) AS n_lines, {r6('m')} AS mean_count, {r6('v')} AS var_count,
       CAST(mn AS BIGINT) AS min_count, (rk = 1 AND m >= 1) AS chosen FROM r"""


def _location_one_hot() -> str:
    loc = ("(SELECT n_nationkey, split_part(concat(r_name, ',', n_name), ',', 1) AS p0, "
           "split_part(concat(r_name, ',', n_name), ',', 2) AS p1 FROM nation JOIN region ON n_regionkey = r_regionkey)")
    cols = [f'CAST(p0 = \'{v}\' AS INTEGER) AS "location_part0_{v}"' for v in sorted(REGIONS)]
    cols += [f'CAST(p1 = \'{v}\' AS INTEGER) AS "location_part1_{v}"' for v in sorted(NATIONS)]
    return f"SELECT n_nationkey, {', '.join(cols)} FROM {loc}"


def _one_hot() -> str:
    vals = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cols = [f'CAST(o_orderpriority = \'{v}\' AS INTEGER) AS "o_orderpriority_{v}"' for v in vals]
    return f"SELECT o_orderkey, {', '.join(cols)} FROM orders"


def _polynomial() -> str:
    x, y = "CAST(p_size AS DOUBLE)", "p_retailprice"
    terms = [x, f"{x} * {x}", y, f"{x} * {y}", f"{y} * {y}"]
    return "SELECT p_partkey, " + ", ".join(f"{r6(t)} AS poly_{i}" for i, t in enumerate(terms)) + " FROM part"


ORACLES: dict[str, str] = {
    "column_profile": _column_profile(),
    "preview_rows": "SELECT * FROM customer ORDER BY c_custkey LIMIT 5",
    "pages_profile": _profile("pages", [("page_id", "bigint"), ("url", "string"), ("html", "string")]),
    "conversations_profile": _profile("conversations", [("conv_id", "bigint"), ("turn", "bigint"),
                                                        ("role", "string"), ("text", "string")]),
    "benchmark_profile": _profile("benchmark", [("item_id", "bigint"), ("text", "string")]),
    "display_width": _display_width(),
    "numeric_stats": _numeric_stats(),
    "missing_report": f"""
        WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS tp FROM orders)
        SELECT CAST(count(*) AS BIGINT) AS n_rows,
               CAST(count(*) FILTER (WHERE tp IS NULL OR o_orderkey IS NULL OR o_custkey IS NULL
                     OR o_orderstatus IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL) AS BIGINT) AS n_incomplete,
               CAST(count(*) FILTER (WHERE NOT (tp IS NULL OR o_orderkey IS NULL OR o_custkey IS NULL
                     OR o_orderstatus IS NULL OR o_orderdate IS NULL OR o_orderpriority IS NULL)) AS BIGINT) AS n_complete,
               {r6("CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE tp IS NULL) * 100.0 / count(*) ELSE 0.0 END")} AS pct_removed
        FROM o""",
    "target_profile": """SELECT CAST(count(o_totalprice) AS BIGINT) AS n,
        CAST(count(DISTINCT o_totalprice) AS BIGINT) AS n_distinct,
        min(o_totalprice)::DOUBLE AS min_value, max(o_totalprice)::DOUBLE AS max_value FROM orders""",
    "target_frequency": "SELECT o_orderpriority AS value, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
    "continuity_check": _continuity(),
    "delimiter_votes": _delimiter_votes(),
    "na_tokens": f"""
        WITH t AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'NA' WHEN 1 THEN 'null'
            WHEN 2 THEN 'None' WHEN 3 THEN 'NaN' WHEN 4 THEN '' WHEN 5 THEN 'n/a'
            ELSE CAST(o_custkey AS VARCHAR) END AS raw FROM orders)
        SELECT o_orderkey, raw, raw IN ({NA_LIST}) AS is_missing,
               CASE WHEN raw IN ({NA_LIST}) THEN NULL ELSE try_cast(raw AS BIGINT) END AS value FROM t""",
    "bad_lines": """
        WITH t AS (SELECT o_orderkey, CASE o_orderkey % 9
              WHEN 0 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 'extra')
              WHEN 1 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus)
              ELSE concat_ws(',', o_orderkey, o_custkey, o_orderstatus, o_orderpriority) END AS line FROM orders),
        p AS (SELECT o_orderkey, string_split(line, ',') AS a FROM t)
        SELECT o_orderkey, CAST(len(a) AS INTEGER) AS n_fields,
               CASE WHEN len(a) = 4 THEN 'ok' WHEN len(a) < 4 THEN 'short' ELSE 'long' END AS status,
               a[1] AS f0, a[2] AS f1, a[3] AS f2, a[4] AS f3
        FROM p WHERE len(a) <= 4""",
    "drop_incomplete": f"""
        WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
                          {PARSE_DATE.format(c='(' + DATE_TEXT + ')')} AS ts FROM orders)
        SELECT o_orderkey, o_totalprice, year(ts)::DOUBLE AS date_year, month(ts)::DOUBLE AS date_month,
               day(ts)::DOUBLE AS date_day
        FROM o WHERE o_totalprice IS NOT NULL AND ts IS NOT NULL""",
    "height_cm": f"""
        WITH p AS (SELECT p_partkey, {HEIGHT} AS height FROM part)
        SELECT p_partkey, height,
               {r6("CASE WHEN len(string_split(height, '-')) = 2 THEN (try_cast(trim(split_part(height, '-', 1)) AS INTEGER) * 12 + try_cast(trim(split_part(height, '-', 2)) AS INTEGER)) * 2.54::DOUBLE END")} AS height_cm
        FROM p""",
    "weight_number": f"""SELECT p_partkey, {WEIGHT} AS weight_text, {FIRST_NUMBER.format(c='(' + WEIGHT + ')')} AS weight FROM part""",
    "weight_impute": f"""
        WITH p AS (SELECT p_partkey, {FIRST_NUMBER.format(c='(' + WEIGHT + ')')} AS w FROM part)
        SELECT p_partkey, {r6('coalesce(w, avg(w) OVER ())')} AS weight FROM p""",
    "date_parts": f"""
        WITH o AS (SELECT o_orderkey, {DATE_TEXT} AS date_text FROM orders),
        t AS (SELECT *, {PARSE_DATE.format(c='date_text')} AS ts FROM o)
        SELECT o_orderkey, date_text, year(ts)::DOUBLE AS date_year, month(ts)::DOUBLE AS date_month,
               day(ts)::DOUBLE AS date_day, hour(ts)::DOUBLE AS date_hour FROM t""",
    "location_split": """
        WITH l AS (SELECT n_nationkey, concat(r_name, ',', n_name) AS location FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT n_nationkey, location, split_part(location, ',', 1) AS location_part0,
               split_part(location, ',', 2) AS location_part1, CAST(len(string_split(location, ',')) AS INTEGER) AS n_parts FROM l""",
    "location_one_hot": _location_one_hot(),
    "label_encode": """
        WITH codes AS (SELECT p_name, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name_code
                       FROM (SELECT DISTINCT p_name FROM part))
        SELECT p_partkey, part.p_name, p_name_code FROM part JOIN codes USING (p_name)""",
    "one_hot": _one_hot(),
    "salary_log1p": f"SELECT c_custkey, {r6('CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END')} AS salary_log FROM customer",
    "minmax_scale": f"""
        WITH s AS (SELECT min(p_size) a, max(p_size) b, min(p_retailprice) c, max(p_retailprice) d FROM part)
        SELECT p_partkey, {r6('CASE WHEN b > a THEN (p_size - a)::DOUBLE / (b - a) ELSE 0.0 END')} AS p_size,
               {r6('CASE WHEN d > c THEN (p_retailprice - c) / (d - c) ELSE 0.0 END')} AS p_retailprice
        FROM part, s""",
    "standard_scale": "WITH s AS (SELECT " + ", ".join(
        f"avg({c}) m_{c}, stddev_pop({c}) s_{c}" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
        + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"{r6(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END')} AS {c}"
        for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) + " FROM lineitem, s",
    "quantile_bins": """
        WITH e AS (SELECT list_distinct([quantile_cont(o_totalprice, 0.2), quantile_cont(o_totalprice, 0.4),
                                         quantile_cont(o_totalprice, 0.6), quantile_cont(o_totalprice, 0.8)]) AS edges FROM orders)
        SELECT o_orderkey, o_totalprice, CAST(len(list_filter(edges, lambda x: x <= o_totalprice)) AS BIGINT) AS bin
        FROM orders, e""",
    "iqr_filter": """
        WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events)
        SELECT event_id, value FROM events, q
        WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "polynomial_features": _polynomial(),
    "exact_split": """
        SELECT * EXCLUDE (r, n), r <= ceil(0.3 * n) AS is_test FROM (
            SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat(o_orderkey::VARCHAR, '-42'))) AS r,
                   count(*) OVER () AS n FROM orders)""",
    "hash_split": f"SELECT o_orderkey, {IS_TEST.format(k='o_orderkey')} AS is_test FROM orders",
}


# ---- models, metrics, chart data ------------------------------------------------------
LI_TRAIN = ("(SELECT * FROM lineitem WHERE NOT (substring(md5(concat(CAST(l_orderkey AS VARCHAR), '-', "
            "CAST(l_linenumber AS VARCHAR), '-42')), 1, 8) < '4ccccccc'))")
LI_SPLIT = ("(SELECT *, substring(md5(concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR), "
            "'-42')), 1, 8) < '4ccccccc' AS is_test FROM lineitem)")
PART_SPLIT = f"(SELECT *, {IS_TEST.format(k='p_partkey')} AS is_test FROM part)"
EMB_SPLIT = f"(SELECT *, {IS_TEST.format(k='vec_id')} AS is_test FROM embeddings)"


def _ols2(src: str, x1: str, x2: str, y: str, names: tuple[str, str], digits: int) -> str:
    """Two-feature least squares from population (co)variances."""
    return f"""WITH s AS (SELECT covar_pop({x1}, {x1}) s11, covar_pop({x2}, {x2}) s22, covar_pop({x1}, {x2}) s12,
                      covar_pop({x1}, {y}) s1y, covar_pop({x2}, {y}) s2y, avg({x1}) m1, avg({x2}) m2, avg({y}) my
               FROM {src}),
     b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) b1,
                  (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) b2, m1, m2, my FROM s)
SELECT 'intercept' AS term, round(my - b1 * m1 - b2 * m2, {digits}) + 0.0 AS coefficient FROM b
UNION ALL SELECT '{names[0]}', round(b1, {digits}) + 0.0 FROM b
UNION ALL SELECT '{names[1]}', round(b2, {digits}) + 0.0 FROM b"""


PART_OLS = f"""WITH f AS (SELECT regr_slope(p_retailprice, p_size) b1, regr_intercept(p_retailprice, p_size) b0
                          FROM {PART_SPLIT} WHERE NOT is_test),
t AS (SELECT p_partkey, p_size, p_retailprice AS y_true, b0 + b1 * p_size AS y_pred,
             row_number() OVER (ORDER BY p_partkey) - 1 AS idx FROM {PART_SPLIT}, f WHERE is_test)"""

ROC_INPUT = """WITH j AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)),
s AS (SELECT 1 AS class, CAST(quality = 1 AS INTEGER) AS y, CAST(n_chars AS DOUBLE) AS score FROM j
      UNION ALL SELECT 0, CAST(quality = 0 AS INTEGER), -CAST(n_chars AS DOUBLE) FROM j),
g AS (SELECT class, score AS threshold, sum(y) AS tp_n, sum(1 - y) AS fp_n FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(tp_n) OVER w AS tps, sum(fp_n) OVER w AS fps, row_number() OVER w AS pos,
             sum(tp_n) OVER (PARTITION BY class) AS P, sum(fp_n) OVER (PARTITION BY class) AS N,
             lead(fp_n) OVER w AS nfp, lead(tp_n) OVER w AS ntp
      FROM g WINDOW w AS (PARTITION BY class ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

KNN_PAIRS = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label, is_test FROM {EMB_SPLIT}),
q AS (SELECT * FROM e WHERE is_test), t AS (SELECT * FROM e WHERE NOT is_test),
d AS (SELECT q.vec_id AS q_id, q.label AS y_true, t.vec_id AS t_id, t.label AS t_label,
             sqrt(list_sum(list_transform(list_zip(q.v, t.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
      FROM q, t),
nb AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, t_id) AS rnk FROM d QUALIFY rnk <= 5)"""

KCURVE = f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM {EMB_SPLIT} WHERE is_test),
n AS (SELECT least(31, count(*) // 2) - 1 AS kmax FROM e),
d AS (SELECT a.vec_id AS q_id, a.label AS y_true, b.vec_id AS t_id, b.label AS t_label,
             sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS dist
      FROM e a, e b),
nb AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, t_id) AS rnk FROM d, n QUALIFY rnk <= kmax),
ks AS (SELECT nb.*, k FROM nb, n, generate_series(1, n.kmax) g(k) WHERE rnk <= k),
c AS (SELECT k, q_id, y_true, t_label, count(*) AS c FROM ks GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY k, q_id ORDER BY c DESC, t_label) AS r FROM c QUALIFY r = 1)
SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(t_label = y_true AS DOUBLE)), 6) + 0.0 AS accuracy FROM p GROUP BY k"""

PART_STD = """(SELECT p_partkey, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS x,
        (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS y FROM part)"""

DBSCAN = f"""WITH RECURSIVE pts AS {PART_STD},
nb AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM pts a JOIN pts b
       ON abs(a.x - b.x) <= 0.1 AND abs(a.y - b.y) <= 0.1
       WHERE list_sum([(a.x - b.x) * (a.x - b.x), (a.y - b.y) * (a.y - b.y)]) <= 0.1 * 0.1),
core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT nb.a, nb.b FROM nb WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach(node, lab) AS (SELECT a, a FROM core UNION SELECT ce.b, reach.lab FROM reach JOIN ce ON reach.node = ce.a),
comp AS (SELECT node, min(lab) AS lab FROM reach GROUP BY node),
num AS (SELECT lab, dense_rank() OVER (ORDER BY lab) - 1 AS cluster FROM (SELECT DISTINCT lab FROM comp)),
corel AS (SELECT node, cluster FROM comp JOIN num USING (lab)),
border AS (SELECT nb.a AS node, min(corel.cluster) AS cluster FROM nb JOIN corel ON nb.b = corel.node
           WHERE nb.a NOT IN (SELECT a FROM core) GROUP BY nb.a)
SELECT p_partkey, CAST(coalesce(c.cluster, b.cluster, -1) AS BIGINT) AS cluster, c.node IS NOT NULL AS is_core
FROM part LEFT JOIN corel c ON c.node = p_partkey LEFT JOIN border b ON b.node = p_partkey"""

GRID = f"""WITH s AS (SELECT min(x) - 1.0 AS x0, max(x) + 1.0 AS x1, min(y) - 1.0 AS y0, max(y) + 1.0 AS y1 FROM {PART_STD}),
n AS (SELECT x0, y0, CAST(ceil((x1 - x0) / 0.1) AS BIGINT) AS nx, CAST(ceil((y1 - y0) / 0.1) AS BIGINT) AS ny FROM s)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(x0 + i * 0.1, 6) + 0.0 AS x, round(y0 + j * 0.1, 6) + 0.0 AS y
FROM n, range(0, n.nx) a(i), range(0, n.ny) b(j)"""

MI = """WITH r AS (SELECT min(l_extendedprice) ymn, max(l_extendedprice) ymx,
        min(l_quantity) a0, max(l_quantity) b0, min(l_discount) a1, max(l_discount) b1, min(l_tax) a2, max(l_tax) b2,
        min(l_linenumber) a3, max(l_linenumber) b3, min(l_partkey) a4, max(l_partkey) b4, min(l_suppkey) a5, max(l_suppkey) b5
        FROM lineitem),
x AS (SELECT CAST(least(floor((l_extendedprice - ymn) / (ymx - ymn) * 10), 9) AS BIGINT) AS yb,
        unnest([
          {'feature': 'l_quantity', 'bx': CAST(least(floor((l_quantity - a0) / (b0 - a0) * 10), 9) AS BIGINT)},
          {'feature': 'l_discount', 'bx': CAST(least(floor((l_discount - a1) / (b1 - a1) * 10), 9) AS BIGINT)},
          {'feature': 'l_tax', 'bx': CAST(least(floor((l_tax - a2) / (b2 - a2) * 10), 9) AS BIGINT)},
          {'feature': 'l_linenumber', 'bx': CAST(least(floor((CAST(l_linenumber AS DOUBLE) - a3) / (b3 - a3) * 10), 9) AS BIGINT)},
          {'feature': 'l_partkey', 'bx': CAST(least(floor((CAST(l_partkey AS DOUBLE) - a4) / (b4 - a4) * 10), 9) AS BIGINT)},
          {'feature': 'l_suppkey', 'bx': CAST(least(floor((CAST(l_suppkey AS DOUBLE) - a5) / (b5 - a5) * 10), 9) AS BIGINT)}
        ]) AS p FROM lineitem, r),
c AS (SELECT p.feature AS feature, p.bx AS bx, yb, count(*) AS c FROM x GROUP BY ALL),
t AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bx) AS px,
             sum(c) OVER (PARTITION BY feature, yb) AS py FROM c)
SELECT feature, round(sum(c / n * ln(c * n / (px * py))), 6) + 0.0 AS mi FROM t GROUP BY feature
ORDER BY mi DESC, feature LIMIT 10"""

PCA = """WITH s AS (SELECT abs(corr(c_acctbal, c_nationkey)) AS r FROM customer),
v AS (SELECT 0 AS component, (1 + r) / 2 AS ratio FROM s UNION ALL SELECT 1, (1 - r) / 2 FROM s),
c0 AS (SELECT component, ratio, sum(ratio) OVER (ORDER BY component) AS cum FROM v),
c AS (SELECT *, coalesce(max(CAST(cum >= 0.95 AS INTEGER)) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_reached FROM c0)
SELECT CAST(component AS INTEGER) AS component, round(ratio, 6) + 0.0 AS explained_ratio,
       round(cum, 6) + 0.0 AS cumulative, prev_reached = 0 AS kept FROM c"""

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")  # test-table values
PREP_TABLE = """WITH b AS (SELECT c_custkey, CAST(c_nationkey AS DOUBLE) AS n, c_acctbal, c_mktsegment,
                        CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS DOUBLE) AS code FROM customer)
SELECT c_custkey,
       round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) + 0.0 AS c_nationkey,
       round((code - avg(code) OVER ()) / stddev_pop(code) OVER (), 6) + 0.0 AS c_name, """ + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INTEGER) AS \"c_mktsegment_{v}\"" for v in SEGMENTS) + """, c_acctbal FROM b"""

ORACLES.update({
    "prep_table": PREP_TABLE,
    "prep_rules": """SELECT 'c_name' AS column_name, 'label' AS rule
        UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < 10 THEN 'onehot' ELSE 'label' END FROM customer""",
    "linear_regression": f"""SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) + 0.0 AS coefficient FROM {LI_TRAIN}
        UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 FROM {LI_TRAIN}""",
    "multiple_regression": _ols2(LI_TRAIN, "l_quantity", "l_discount", "l_extendedprice",
                                 ("l_quantity", "l_discount"), 4),
    "polynomial_regression": _ols2(f"(SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) * p_size AS x2, p_retailprice FROM {PART_SPLIT} WHERE NOT is_test)",
                                   "x1", "x2", "p_retailprice", ("poly_0", "poly_1"), 6),
    "regression_metrics": f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) b1, regr_intercept(l_extendedprice, l_quantity) b0 FROM {LI_TRAIN}),
        p AS (SELECT is_test, l_extendedprice AS y, b0 + b1 * l_quantity AS yp FROM {LI_SPLIT}, f),
        m AS (SELECT is_test, avg((y - yp) * (y - yp)) AS mse, sum((y - yp) * (y - yp)) AS sse,
                     sum((y - (SELECT avg(y) FROM p p2 WHERE p2.is_test = p.is_test)) ^ 2) AS sst, count(*) AS n FROM p GROUP BY is_test),
        w AS (SELECT max(CASE WHEN NOT is_test THEN mse END) AS mse_train, max(CASE WHEN is_test THEN mse END) AS mse_test,
                     max(CASE WHEN is_test THEN 1 - sse / sst END) AS r2, max(CASE WHEN is_test THEN n END) AS n_test FROM m)
        SELECT CAST(n_test AS BIGINT) AS n_test, round(mse_train, 2) AS mse_train, round(mse_test, 2) AS mse_test,
               round(mse_train - mse_test, 2) AS mse_diff, round(r2, 6) + 0.0 AS r2,
               CASE WHEN r2 > 0.8 THEN 'high' WHEN r2 > 0.5 THEN 'medium' ELSE 'low' END AS grade FROM w""",
    "line_series": PART_OLS + " SELECT CAST(idx AS BIGINT) AS \"index\", p_partkey, round(y_true, 6) + 0.0 AS y_true, round(y_pred, 6) + 0.0 AS y_pred FROM t",
    "residuals": PART_OLS + " SELECT CAST(idx AS BIGINT) AS \"index\", p_partkey, round(y_true - y_pred, 6) + 0.0 AS residual FROM t",
    "scatter_points": PART_OLS + " SELECT p_partkey, CAST(idx AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, round(y_pred, 6) + 0.0 AS label FROM t",
    "accuracy_error": """SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(quality = toxic AS DOUBLE)), 6) + 0.0 AS accuracy,
        round(1 - avg(CAST(quality = toxic AS DOUBLE)), 6) + 0.0 AS error_rate FROM labels""",
    "confusion_matrix": """WITH l AS (SELECT quality AS label FROM labels UNION SELECT toxic FROM labels)
        SELECT a.label AS y_true, b.label AS y_pred,
               CAST((SELECT count(*) FROM labels WHERE quality = a.label AND toxic = b.label) AS BIGINT) AS n
        FROM l a, l b""",
    "label_union": "SELECT quality AS label FROM labels UNION SELECT toxic FROM labels",
    "roc_points": ROC_INPUT + """,
        k AS (SELECT * FROM c WHERE pos = 1 OR nfp IS NULL OR nfp <> fp_n OR ntp <> tp_n),
        a AS (SELECT class, CAST(pos AS BIGINT) AS pos, threshold, tps, fps, P, N FROM k
              UNION ALL SELECT class, 0, NULL, 0, 0, P, N FROM c WHERE pos = 1)
        SELECT class, pos, threshold, round(CASE WHEN N > 0 THEN fps / N END, 6) + 0.0 AS fpr,
               round(CASE WHEN P > 0 THEN tps / P END, 6) + 0.0 AS tpr FROM a""",
    "roc_auc": ROC_INPUT + " SELECT class, round(sum(fp_n / nullif(N, 0) * (2 * tps - tp_n) / nullif(P, 0) / 2), 6) + 0.0 AS auc FROM c GROUP BY class",
    "knn_classify": KNN_PAIRS + """,
        v AS (SELECT q_id, y_true, t_label, count(*) AS c FROM nb GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, t_label) AS r FROM v QUALIFY r = 1)
        SELECT q_id AS vec_id, y_true, t_label AS y_pred FROM p""",
    "knn_regress": KNN_PAIRS + """
        SELECT q_id AS vec_id, CAST(any_value(y_true) AS DOUBLE) AS y_true, round(avg(CAST(t_label AS DOUBLE)), 6) + 0.0 AS y_pred
        FROM nb GROUP BY q_id""",
    "k_value_curve": KCURVE,
    "dbscan": DBSCAN,
    "cluster_summary": f"""WITH d AS ({DBSCAN.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)})
        SELECT CAST(count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS BIGINT) AS n_clusters,
               CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS n_noise FROM d""",
    "boundary_grid": GRID,
    "elbow_k1": """WITH u AS (SELECT unnest(generate_series(1, len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)
        SELECT 1 AS k, round(sum(s), 4) + 0.0 AS inertia FROM (SELECT var_pop(x) * count(*) AS s FROM u GROUP BY i)""",
    "mi_top_k": MI,
    "pca_ratio": PCA,
    "csv_roundtrip": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
})

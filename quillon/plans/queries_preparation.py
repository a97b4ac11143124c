"""Outliers, imputation, features, encoding and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import features, impute, outliers
from .queries_profile import fill_c
from .registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]

_Q = "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s, mad({c}) AS d FROM lineitem)"
_LIMITS = {
    "iqr": ("q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"),
    "zscore": ("m - 1.5 * s", "m + 1.5 * s"),
    "modified_z": ("q2 - 1.2 * d / 0.6745", "q2 + 1.2 * d / 0.6745"),
    "adjusted_boxplot": (
        "q1 - 0.5 * exp(-4 * (q3 + q1 - 2 * q2) / (q3 - q1)) * (q3 - q1)",
        "q3 + 0.5 * exp(3 * (q3 + q1 - 2 * q2) / (q3 - q1)) * (q3 - q1)",
    ),
}
_KNOBS = {"iqr": {"multiplier": 1.5}, "zscore": {"z": 1.5}, "modified_z": {"z": 1.2}, "adjusted_boxplot": {"multiplier": 0.5}}


def _outlier_query(method: str):
    low, high = _LIMITS[method]
    one = f"SELECT '{{c}}' AS column_name, {{R:any_value({low})}} AS low, {{R:any_value({high})}} AS high, count(*) FILTER ({{c}} < {low} OR {{c}} > {high}) AS outliers FROM lineitem, {_Q}"

    @query(f"outlier_{method}", " UNION ALL ".join(fill_c(one, c) for c in NUMBERS), digits=4)
    def run(spark, sf_dir):
        return outliers.counts(table(spark, sf_dir, "lineitem"), NUMBERS, method, **_KNOBS[method])


for _m in _LIMITS:
    _outlier_query(_m)

_FENCE = "(SELECT avg(o_totalprice) - 1.2 * stddev_samp(o_totalprice) AS lo, avg(o_totalprice) + 1.2 * stddev_samp(o_totalprice) AS hi FROM orders)"


@query("outlier_remove", f"SELECT o_orderkey, {{R:o_totalprice}} AS o_totalprice FROM orders, {_FENCE} WHERE o_totalprice BETWEEN lo AND hi")
def outlier_remove(spark, sf_dir):
    return outliers.remove(table(spark, sf_dir, "orders"), ["o_totalprice"], "zscore", z=1.2).select("o_orderkey", "o_totalprice")


@query("outlier_cap", f"SELECT o_orderkey, {{R:greatest(l, least(o_totalprice, h))}} AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS l, max(o_totalprice) AS h FROM orders, {_FENCE} WHERE o_totalprice BETWEEN lo AND hi)")
def outlier_cap(spark, sf_dir):
    return outliers.cap(table(spark, sf_dir, "orders"), ["o_totalprice"], "zscore", z=1.2).select("o_orderkey", "o_totalprice")


@query("outlier_flag", f"SELECT o_orderkey, (o_totalprice < lo OR o_totalprice > hi) AS o_totalprice_outlier FROM orders, {_FENCE}")
def outlier_flag(spark, sf_dir):
    return outliers.flag(table(spark, sf_dir, "orders"), ["o_totalprice"], "zscore", z=1.2).select("o_orderkey", "o_totalprice_outlier")


_LOF = """WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer),
 c AS (SELECT a.i, b.i AS j, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY abs(a.v - b.v), b.i) AS p FROM r a JOIN r b ON b.i BETWEEN a.i - 20 AND a.i + 20 AND b.i <> a.i),
 n AS (SELECT i, j, d FROM c WHERE p <= 20), k AS (SELECT i, max(d) AS kd FROM n GROUP BY i), h AS (SELECT n.i, avg(greatest(n.d, k.kd)) AS reach FROM n JOIN k ON k.i = n.j GROUP BY n.i),
 l AS (SELECT n.i, avg(1 / b.reach) * any_value(a.reach) AS lof FROM n JOIN h a ON a.i = n.i JOIN h b ON b.i = n.j GROUP BY n.i),
 f AS (SELECT v, min(i) AS i FROM r GROUP BY v)
 SELECT c_custkey, {R:lof} AS lof, lof > 1.5 AS outlier FROM customer JOIN f ON v = c_acctbal JOIN l USING (i)"""


@query("lof_1d", _LOF)
def lof_1d(spark, sf_dir):
    return outliers.lof(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey")


_D2 = """WITH s AS (SELECT avg(o_totalprice) AS m1, stddev_samp(o_totalprice) AS s1, avg(o_custkey) AS m2, stddev_samp(o_custkey) AS s2, corr(o_totalprice, o_custkey) AS r FROM orders),
 d AS (SELECT o_orderkey, (pow((o_totalprice - m1) / s1, 2) - 2 * r * (o_totalprice - m1) / s1 * (o_custkey - m2) / s2 + pow((o_custkey - m2) / s2, 2)) / (1 - r * r) AS d2 FROM orders, s),
 t AS (SELECT quantile_cont(d2, 0.975) AS threshold FROM d)
 SELECT o_orderkey, {R:d2} AS d2, {R:threshold} AS threshold FROM d, t WHERE d2 >= threshold ORDER BY d.d2 DESC, o_orderkey LIMIT 6"""


@query("mahalanobis_top6", _D2)
def mahalanobis_top6(spark, sf_dir):
    return outliers.mahalanobis(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey")


_PEAKS = "(SELECT o_orderkey, o_orderstatus, o_totalprice * CASE WHEN o_orderkey % 97 = 0 THEN 4 ELSE 1 END AS price, o_custkey::DOUBLE * CASE WHEN o_orderkey % 194 = 0 THEN 5 ELSE 1 END AS cust FROM orders)"
_CONTEXT = f"""WITH d AS {_PEAKS}, s AS (SELECT o_orderstatus, avg(price) AS mp, stddev_samp(price) AS sp, avg(cust) AS mc, stddev_samp(cust) AS sc, count(*) AS n FROM d GROUP BY 1),
 q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(cust, 0.25) AS c1, quantile_cont(cust, 0.75) AS c3 FROM d),
 z AS (SELECT o_orderkey, o_orderstatus AS segment, abs((price - mp) / sp) AS zp, abs((cust - mc) / sc) AS zc FROM d JOIN s USING (o_orderstatus), q
 WHERE n >= 12 AND (price < p1 - 1.5 * (p3 - p1) OR price > p3 + 1.5 * (p3 - p1) OR cust < c1 - 1.5 * (c3 - c1) OR cust > c3 + 1.5 * (c3 - c1)))
 SELECT o_orderkey, segment, CASE WHEN zp > zc THEN 'price' ELSE 'cust' END AS strongest, {{R:greatest(zp, zc)}} AS abs_z, CASE WHEN least(zp, zc) >= 1.5 THEN 1 ELSE 0 END AS others FROM z ORDER BY o_orderkey LIMIT 8"""


@query("outlier_context", _CONTEXT)
def outlier_context(spark, sf_dir):
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(k, "o_orderstatus", (F.col("o_totalprice") * F.when(k % 97 == 0, 4).otherwise(1)).alias("price"), (F.col("o_custkey").cast("double") * F.when(k % 194 == 0, 5).otherwise(1)).alias("cust"))
    return outliers.outlier_context(d, "o_orderstatus", ["price", "cust"], "o_orderkey")


# -- imputation: nulls are derived from keys --


def _holes(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount")).alias("b"),
        F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("c"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_shipdate")).alias("t"),
    )


_HOLES = """WITH h AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 5 <> 0 THEN l_discount END AS b,
 CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END AS c, CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate END AS t FROM lineitem) """


@query("impute_mean", _HOLES + "SELECT row_id, {R:coalesce(a, (SELECT avg(a) FROM h))} AS a, {R:coalesce(b, (SELECT avg(b) FROM h))} AS b FROM h")
def impute_mean(spark, sf_dir):
    return impute.numeric(_holes(spark, sf_dir), ["a", "b"], "mean").select("row_id", "a", "b")


@query("impute_median", _HOLES + "SELECT row_id, {R:coalesce(a, (SELECT median(a) FROM h))} AS a FROM h")
def impute_median(spark, sf_dir):
    return impute.numeric(_holes(spark, sf_dir), ["a"], "median").select("row_id", "a")


@query("impute_zero", _HOLES + "SELECT row_id, {R:coalesce(a, 0)} AS a FROM h")
def impute_zero(spark, sf_dir):
    return impute.numeric(_holes(spark, sf_dir), ["a"], "zero").select("row_id", "a")


@query("impute_mode", _HOLES + "SELECT row_id, coalesce(c, (SELECT c FROM h WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)) AS c FROM h")
def impute_mode(spark, sf_dir):
    return impute.categorical(_holes(spark, sf_dir), ["c"]).select("row_id", "c")


def _series(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("user_id") % 4 != 0, F.col("ts")).alias("t"))


_BETWEEN = """WITH h AS (SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN value END AS a FROM events),
 w AS (SELECT event_id, a, last_value(CASE WHEN a IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS x0, last_value(a IGNORE NULLS) OVER p AS y0,
 first_value(CASE WHEN a IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS x1, first_value(a IGNORE NULLS) OVER n AS y1 FROM h
 WINDOW p AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT event_id, {R:coalesce(a, y0 + (y1 - y0) * (event_id - x0) / nullif(x1 - x0, 0), y0, y1)} AS a FROM w"""


@query("impute_interpolate", _BETWEEN)
def impute_interpolate(spark, sf_dir):
    return impute.interpolate(_series(spark, sf_dir), ["a"], "event_id").select("event_id", "a")


@query("impute_datetime", _BETWEEN.replace("CASE WHEN user_id % 3 <> 0 THEN value END AS a", "CASE WHEN user_id % 4 <> 0 THEN floor(epoch(ts)) END AS a").replace("SELECT event_id, {R:", "SELECT event_id, make_timestamp((floor(").replace("y0, y1)} AS a FROM w", "y0, y1)) * 1000000)::BIGINT) AS t FROM w"))
def impute_datetime(spark, sf_dir):
    return impute.interpolate(_series(spark, sf_dir), ["t"], "event_id").select("event_id", "t")


@query("impute_matrix", _HOLES + "SELECT row_id, {R:coalesce(a, 0.5 * ma + 0.5 * coalesce(b, ma))} AS a, {R:coalesce(b, 0.5 * mb + 0.5 * coalesce(a, mb))} AS b FROM h, (SELECT avg(a) AS ma, avg(b) AS mb FROM h)")
def impute_matrix(spark, sf_dir):
    return impute.matrix_completion(_holes(spark, sf_dir), ["a", "b"]).select("row_id", "a", "b")




@query("impute_regression", "WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS y, l_quantity AS x FROM lineitem), f AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM d) SELECT row_id, {R:coalesce(y, i + s * x)} AS y FROM d, f", digits=4)
def impute_regression(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("y"), F.col("l_quantity").alias("x"))
    return impute.mice(d, ["y", "x"]).select("row_id", "y")


_KNN = """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS y, p_size::DOUBLE AS x FROM part), z AS (SELECT k, y, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS x FROM p),
 n AS (SELECT h.k, r.y, 1 / greatest(round(abs(h.x - r.x), 12), 1e-9) AS w, row_number() OVER (PARTITION BY h.k ORDER BY round(abs(h.x - r.x), 12), r.k) AS place FROM z h JOIN z r ON h.y IS NULL AND r.y IS NOT NULL)
 SELECT k AS p_partkey, {R:coalesce(y, (SELECT sum(n.y * w) / sum(w) FROM n WHERE n.k = z.k AND place <= 5))} AS y FROM z"""


@query("impute_knn", _KNN, digits=5)
def impute_knn(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_retailprice")).alias("y"), F.col("p_size").cast("double").alias("x"))
    return impute.knn(d, "y", ["x"], "p_partkey").select("p_partkey", "y")


# -- features --


@query("scale_zscore", "SELECT o_orderkey, {R:(o_totalprice - m) / s} AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def scale_zscore(spark, sf_dir):
    return features.scaled(table(spark, sf_dir, "orders"), ["o_totalprice"], "zscore")[0].select("o_orderkey", "o_totalprice")


@query("scale_minmax", "SELECT o_orderkey, {R:(o_totalprice - lo) / (hi - lo)} AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def scale_minmax(spark, sf_dir):
    return features.scaled(table(spark, sf_dir, "orders"), ["o_totalprice"], "minmax")[0].select("o_orderkey", "o_totalprice")


@query("scale_auto", "SELECT l_orderkey, l_linenumber, {R:(l_extendedprice - lo) / (hi - lo)} AS l_extendedprice, {R:(l_discount - m) / s} AS l_discount FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_discount) AS m, stddev_samp(l_discount) AS s FROM lineitem)")
def scale_auto(spark, sf_dir):
    return features.scaled(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_discount"])[0].select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")


@query("date_features", 'SELECT event_id, dayofweek(ts)::INTEGER AS "ts_DayOfWeek", month(ts)::INTEGER AS "ts_Month", CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS "ts_IsWeekend", dayofyear(ts)::INTEGER AS "ts_DayOfYear", quarter(ts)::INTEGER AS "ts_Quarter" FROM events')
def date_features(spark, sf_dir):
    return features.date_features(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts"]).drop("ts")


@query("polynomials_and_logs", "SELECT p_partkey, {R:pow(p_retailprice, 2)} AS p_retailprice_pow2, {R:pow(p_retailprice, 3)} AS p_retailprice_pow3, {R:sign(p_retailprice) * ln(1 + abs(p_retailprice))} AS p_retailprice_log1p_abs FROM part", digits=2)
def polynomials_and_logs(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return features.signed_logs(features.polynomials(d, ["p_retailprice"], 3), ["p_retailprice"]).drop("p_retailprice")


@query("products_and_ratios", "SELECT l_orderkey, l_linenumber, {R:l_extendedprice * l_quantity} AS l_extendedprice_x_l_quantity, {R:CASE WHEN abs(l_quantity) > 1e-9 THEN l_extendedprice / l_quantity END} AS l_extendedprice_div_l_quantity, {R:CASE WHEN abs(l_extendedprice) > 1e-9 THEN l_quantity / l_extendedprice END} AS l_quantity_div_l_extendedprice FROM lineitem", digits=8)
def products_and_ratios(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    pair = [("l_extendedprice", "l_quantity")]
    return features.ratios(features.products(d, pair), pair).drop("l_extendedprice", "l_quantity")


@query("engineered_features")
def engineered_features(spark, sf_dir):
    wide, kept = features.engineered(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], target="l_extendedprice")
    return wide.agg(*[F.avg(c).alias(c) for c in ["l_quantity", *kept]])


@query("boolean_flag", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END AS flag_bool FROM orders")
def boolean_flag(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus").isin("O", "P"), " Yes").otherwise("off").alias("flag"))
    return features.boolean_flags(d, ["flag"]).select("o_orderkey", "flag_bool")


@query("multi_select_counts", """WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS t FROM part), n AS (SELECT count(*) AS n FROM part),
 top AS (SELECT t FROM t, n GROUP BY t, n HAVING count(*) >= greatest(2, 0.04 * n) ORDER BY count(*) DESC, t LIMIT 6)
 SELECT p_partkey, count(*)::INTEGER AS selections, count(*) FILTER (t IN (SELECT t FROM top))::INTEGER AS frequent FROM t GROUP BY 1""")
def multi_select_counts(spark, sf_dir):
    wide = multi_select_expand(spark, sf_dir)
    flags = [c for c in wide.columns if "_has_" in c]
    return wide.select("p_partkey", F.col("picks_selection_count").cast("int").alias("selections"), sum((F.col(c) for c in flags), F.lit(0)).cast("int").alias("frequent"))


@query("multi_select_expand")
def multi_select_expand(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit(";")).alias("picks"))
    return features.multi_select(d, "picks")[0].drop("picks")


@query("label_encode", "SELECT o_orderpriority AS value, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::INTEGER AS code, count(*) AS n FROM orders GROUP BY 1")
def label_encode(spark, sf_dir):
    return features.label_codes(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("encode_target", "SELECT o_orderkey, {R:code} AS o_orderpriority_code FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1 AS code FROM orders GROUP BY 1) USING (o_orderpriority)")
def encode_target(spark, sf_dir):
    return features.encoded_target(table(spark, sf_dir, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority_code")


@query("binary_target", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > (SELECT (min(l_linenumber) + max(l_linenumber)) / 2 FROM lineitem) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM lineitem")
def binary_target(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("y"))
    return features.binary_target(d, "y")


_TOP2 = "(SELECT list(v) AS top FROM (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2))"


@query("one_hot_other", f"SELECT o_orderkey, CASE WHEN o_orderpriority = top[1] THEN 1 ELSE 0 END AS first_level, CASE WHEN o_orderpriority = top[2] THEN 1 ELSE 0 END AS second_level, CASE WHEN NOT list_contains(top, o_orderpriority) THEN 1 ELSE 0 END AS other FROM orders, {_TOP2}")
def one_hot_other(spark, sf_dir):
    wide, made = features.one_hot(table(spark, sf_dir, "orders"), "o_orderpriority", top=2)
    return wide.select("o_orderkey", *[F.col(f"`{c}`").alias(n) for c, n in zip(made, ("first_level", "second_level", "other"), strict=True)])


@query("category_normalise", "SELECT c_custkey, lower(trim(c_mktsegment)) AS c_mktsegment FROM customer")
def category_normalise(spark, sf_dir):
    return features.normalised_categories(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


def _cull_sql() -> str:
    numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant", "sparse"]
    words = ["l_returnflag", "l_linestatus", "l_shipdate"]
    limit = features.CULL["auto"]
    each = [f"SELECT '{c}' AS column_name, 1 - count({c}) / count(*) AS miss, max({c})::DOUBLE - min({c})::DOUBLE AS span, count({c}) < greatest(3, count(*) // 200) AS few FROM d" for c in numbers]
    each += [f"SELECT '{c}', 1 - count({c}) / count(*), CASE WHEN count(DISTINCT {c}) > 1 THEN 1 ELSE 0 END, false FROM d" for c in words]
    return f"""WITH d AS (SELECT *, 1.0::DOUBLE AS constant, CASE WHEN l_orderkey % 50 = 0 THEN 1.0::DOUBLE END AS sparse FROM lineitem), t AS ({" UNION ALL ".join(each)})
 SELECT column_name, CASE WHEN miss > {limit} THEN 'missing' WHEN few THEN 'few values' WHEN span <= 1e-12 THEN 'constant' ELSE 'kept' END AS verdict FROM t"""


@query("column_cull", _cull_sql())
def column_cull(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(1.0)).withColumn("sparse", F.when(F.col("l_orderkey") % 50 == 0, 1.0))
    kept, gone = features.cull_columns(d)
    return spark.createDataFrame([(c, "kept") for c in kept] + list(gone.items()), "column_name string, verdict string")


# -- parsing --



@query("parse_numbers", "SELECT l_orderkey, l_linenumber, {R:CASE l_linenumber % 4 WHEN 1 THEN (l_orderkey % 1000) + 0.5 WHEN 2 THEN (l_orderkey % 900 + 100) + (l_partkey % 90 + 10) / 100 END} AS value FROM lineitem")
def parse_numbers(spark, sf_dir):
    key, part, line = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber") % 4
    raw = F.when(line == 0, F.concat(F.lit("$"), key.cast("string"))).when(line == 1, F.concat((key % 1000).cast("string"), F.lit(".5"))).when(line == 2, F.concat(F.lit(" "), (key % 900 + 100).cast("string"), F.lit(","), (part % 90 + 10).cast("string"))).otherwise("n/a")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parsing.parse_number(parsing.missing_to_null(raw)).alias("value"))


@query("parse_dates", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, date_trunc('day', ts) FROM events WHERE event_id % 3 = 2")
def parse_dates(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    form = F.when(F.col("event_id") % 3 == 0, F.unix_timestamp("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "dd-MM-yyyy"))
    return d.select("event_id", parsing.parse_datetime(form).alias("parsed"))


@query("missing_tokens", "SELECT count(*) FILTER (event_id % 4 = 0) AS nulls, count(*) FILTER (event_id % 4 <> 0) AS kept FROM events")
def missing_tokens(spark, sf_dir):
    raw = F.when(F.col("event_id") % 4 == 0, " N/A ").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(parsing.missing_to_null(raw).alias("v")).agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count("v").alias("kept"))


@query("text_functions", "SELECT p_partkey, replace(replace(p_name, '<', '&lt;'), '&', '&amp;') AS escaped, printf('%.2f', p_retailprice) AS fixed FROM part")
def text_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", parsing.html_escape(F.col("p_name")).alias("escaped"), parsing.fixed(F.col("p_retailprice"), 2).alias("fixed"))


# -- text tables --


@query("csv_round_trip", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderstatus, {R:o_totalprice} AS o_totalprice, o_orderdate AS order_date, o_orderpriority FROM orders")
def csv_round_trip(spark, sf_dir):
    """Written as delimited text, then read, typed by inference and cast."""
    import uuid

    from ..sources import scratch, tabular

    base = scratch.materialised(table(spark, sf_dir, "region"), "base").inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base}/quillon-csv-{uuid.uuid4().hex}"
    tabular.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("order_date"), "o_orderpriority"), path)
    raw = tabular.read_text_table(spark, path)
    return tabular.typed(raw, tabular.infer_types(raw))


@query("type_inference", "SELECT * FROM (VALUES ('amount', 'numeric'), ('code', 'categorical'), ('event_time', 'datetime'), ('mixed', 'categorical')) t(column_name, kind)")
def type_inference(spark, sf_dir):
    from ..sources import tabular

    d = table(spark, sf_dir, "orders").select(
        F.format_string("%.2f", F.col("o_totalprice")).alias("amount"), F.col("o_orderstatus").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_time"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).otherwise(F.col("o_orderkey").cast("string")).alias("mixed"),
    )
    return spark.createDataFrame(list(tabular.infer_types(d).items()), "column_name string, kind string")


@query("row_admission", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 10 > 2")
def row_admission(spark, sf_dir):
    from ..sources import tabular

    k = F.col("o_orderkey") % 10
    d = table(spark, sf_dir, "orders").select(F.when(k == 0, "Grand Total").when(k == 1, "-- note").when(k == 2, " ").otherwise(F.col("o_orderpriority")).alias("a"), F.when((k == 1) | (k == 2), None).otherwise(F.col("o_orderkey").cast("string")).alias("b"))
    return tabular.admitted(d).agg(F.count("*").alias("n"))


@query("dense_row_ids", "SELECT count(*) AS n, min(i) AS first, max(i) AS last FROM (SELECT row_number() OVER () - 1 AS i FROM lineitem)")
def dense_row_ids(spark, sf_dir):
    from ..sources import tabular

    return tabular.with_row_id(table(spark, sf_dir, "lineitem")).agg(F.count_distinct("row_id").alias("n"), F.min("row_id").alias("first"), F.max("row_id").alias("last"))


@query("parquet_round_trip", "SELECT l_orderkey, l_linenumber, {R:CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END} AS v, l_shipdate FROM lineitem")
def parquet_round_trip(spark, sf_dir):
    """Written and read again; numbers that are not finite become null."""
    import uuid

    from ..sources import scratch, tabular

    base = scratch.materialised(table(spark, sf_dir, "region"), "base").inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base}/quillon-parquet-{uuid.uuid4().hex}"
    odd = F.when(F.col("l_linenumber") == 1, float("nan")).when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_quantity"))
    tabular.write_parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", odd.alias("v"), "l_shipdate"), path)
    return tabular.load(spark, f"{path}/*.parquet").select("l_orderkey", "l_linenumber", "v", "l_shipdate")


@query("running_totals", "SELECT count(*) AS n, {R:sum(o_totalprice)} AS total FROM orders WHERE o_orderkey < 40", digits=4)
def running_totals(spark, sf_dir):
    """Rows that repeat the sums of those before them are dropped: after every tenth row, and a grand total."""
    from ..sources import tabular

    rows = table(spark, sf_dir, "orders").where("o_orderkey < 40").orderBy("o_orderkey").select("o_orderkey", "o_totalprice").collect()
    out, key, total = [], 0, 0.0
    for i, r in enumerate(rows, 1):
        out.append(("sale", str(r["o_orderkey"]), repr(r["o_totalprice"]), "a", "b", "c"))
        key, total = key + r["o_orderkey"], total + r["o_totalprice"]
        if i % 10 == 0:
            out.append((None, str(key), repr(total), None, None, None))
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(out)], "row_id long, kind string, key string, price string, x string, y string, z string")
    left = tabular.without_running_totals(d, ["key", "price"])
    return left.agg(F.count("*").alias("n"), F.sum(F.col("price").cast("double")).alias("total"))


@query("text_headers", "SELECT unnest(['key', 'price', 'price_2', 'column_3']) AS column_name, unnest([0, 1, 2, 3]) AS place, count(*) AS n FROM orders")
def text_headers(spark, sf_dir):
    """A byte-order mark goes, empty names are numbered, repeated ones counted."""
    import uuid

    from ..sources import scratch, tabular

    base = scratch.materialised(table(spark, sf_dir, "region"), "base").inputFiles()[0].rsplit("/", 2)[0]
    path = f"{base}/quillon-text-{uuid.uuid4().hex}"
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(",", "o_orderkey", "o_totalprice", "o_totalprice", F.lit("x")).alias("value"))
    spark.createDataFrame([("\ufeffkey,price, price,",)], "value string").unionByName(lines).coalesce(1).write.text(path)
    d = tabular.read_text_table(spark, path)
    n = d.count()
    return spark.createDataFrame([(c, i, n) for i, c in enumerate(d.columns)], "column_name string, place int, n long")


@query("token_names", "SELECT DISTINCT p_type || ' / ' || p_brand AS token, substr(trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_'), 1, 24) AS name FROM part")
def token_names(spark, sf_dir):
    from ..functions import names

    tokens = [r["t"] for r in table(spark, sf_dir, "part").select(F.concat_ws(" / ", "p_type", "p_brand").alias("t")).distinct().collect()]
    return spark.createDataFrame([(t, names.column_token(t)) for t in tokens], "token string, name string")

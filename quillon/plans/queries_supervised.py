"""Targets, features, models, drift and causal hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, models, neural, select, temporal
from .registry import query, table

FEATURES = ["l_extendedprice", "l_discount", "l_tax"]


def _net(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("row_key"), "l_quantity", *FEATURES, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


def _indexed(spark, sf_dir):
    # One row an order: the index is dense, as folds and slices need.
    return temporal.positions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "i")


@query("target_resolution")
def target_resolution(spark, sf_dir):
    rows = []
    for t in ("lineitem", "orders", "events", "part"):
        for s in select.STRATEGIES:
            found = select.resolve_target(table(spark, sf_dir, t), strategy=s)
            rows.append((t, s, found.name, found.strategy, found.task))
    return spark.createDataFrame(rows, "name string, strategy string, target string, how string, task string")


@query("feature_collection")
def feature_collection(spark, sf_dir):
    kept, gone = select.collect_features(_net(spark, sf_dir).drop("row_key"), "net")
    return spark.createDataFrame([(c, "kept") for c in kept] + list(gone.items()), "column_name string, verdict string")


@query("selection_phases")
def selection_phases(spark, sf_dir):
    p = select.phases(_net(spark, sf_dir), "net", ["l_quantity", *FEATURES])
    rows = [("role", c, r) for c, r in p["roles"].items()] + [("kept", c, p["mode"]) for c in p["kept"]]
    return spark.createDataFrame(rows, "phase string, column_name string, value string")


@query("ridge_cv")
def ridge_cv(spark, sf_dir):
    d = _net(spark, sf_dir)
    return models.cross_validated(d, FEATURES, "net", "row_key").unionByName(models.cross_validated(d, FEATURES, "net", "row_key", ridge=1.0, label="ridge"))


@query("decision_stump")
def decision_stump(spark, sf_dir):
    return models.stump(_net(spark, sf_dir), FEATURES, "net", "row_key")


@query("bagged_stumps")
def bagged_stumps(spark, sf_dir):
    return models.bagged_stumps(_net(spark, sf_dir), FEATURES, "net", "row_key", bags=25)


@query("model_benchmark")
def model_benchmark(spark, sf_dir):
    return models.benchmark(_net(spark, sf_dir), FEATURES, ["net", "l_quantity"], "row_key")


@query("binary_accuracy", "SELECT {R:avg(CASE WHEN (o_totalprice > 200000) = (o_custkey % 2 = 1) THEN 1.0 ELSE 0.0 END)} AS accuracy, count(*) AS n FROM orders")
def binary_accuracy(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select((F.col("o_totalprice") > 200000).cast("double").alias("p"), (F.col("o_custkey") % 2).cast("double").alias("y"))
    return models.accuracy(d, "p", "y")


_PSI = """WITH d AS (SELECT o_totalprice + CASE WHEN i >= floor(0.7 * n) THEN 40000 ELSE 0 END AS v, i < floor(0.7 * n) AS ref FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)),
 q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS c FROM d WHERE ref),
 b AS (SELECT (v >= c[1])::INTEGER + (v >= c[2])::INTEGER + (v >= c[3])::INTEGER + (v >= c[4])::INTEGER AS bin, ref FROM d, q),
 s AS (SELECT bin, greatest(count(*) FILTER (ref) / sum(count(*) FILTER (ref)) OVER (), 1e-6) AS a, greatest(count(*) FILTER (NOT ref) / sum(count(*) FILTER (NOT ref)) OVER (), 1e-6) AS m FROM b GROUP BY bin)
 SELECT 'v' AS column_name, {R:sum((m - a) * ln(m / a))} AS psi, CASE WHEN sum((m - a) * ln(m / a)) >= 0.25 THEN 'critical' WHEN sum((m - a) * ln(m / a)) >= 0.15 THEN 'warning' ELSE 'stable' END AS band FROM s"""


@query("psi_drift", _PSI)
def psi_drift(spark, sf_dir):
    d = _indexed(spark, sf_dir)
    n = d.count()
    ref = F.col("i") < int(0.7 * n)
    return models.psi(d.withColumn("v", F.col("o_totalprice") + F.when(ref, 0).otherwise(40000)), "v", ref)


@query("ood_rate")
def ood_rate(spark, sf_dir):
    d = _indexed(spark, sf_dir).withColumn("x", F.col("o_totalprice") + F.when(F.col("i") % 50 == 0, 3e6).otherwise(0.0))
    return models.out_of_distribution(d, ["x", "o_custkey"], "i")


@query("kmeans_silhouette")
def kmeans_silhouette(spark, sf_dir):
    return models.kmeans(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"])


@query("row_sample")
def row_sample(spark, sf_dir):
    return models.sampled(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


@query("even_sample", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE n <= 2500 OR floor((i + 1) * 2500 / n) > floor(i * 2500 / n)")
def even_sample(spark, sf_dir):
    return models.evenly(_indexed(spark, sf_dir), 2500, "i").select("o_orderkey")


@query("neural_regression")
def neural_regression(spark, sf_dir):
    d = _net(spark, sf_dir)
    net, x, y = neural.fit(d, FEATURES, "net", "row_key")
    imp = neural.hybrid(net, x, y)
    scored = neural.score(d, net, FEATURES, "row_key").join(d.select("row_key", "net"), "row_key")
    out = models.errors(scored, F.col("prediction"), "net", "dense network")
    return out.crossJoin(spark.createDataFrame([tuple(float(v) for v in imp)], ", ".join(f"w_{c} double" for c in FEATURES)))


@query("causal_edges")
def causal_edges(spark, sf_dir):
    d = _indexed(spark, sf_dir).select("i", F.pow("o_totalprice", F.lit(0.5)).alias("a")).withColumn("noise", F.pmod(F.xxhash64("i"), F.lit(1000)) / 10.0)
    d = d.withColumn("b", F.col("a") * 0.4 + F.col("noise")).withColumn("c", F.col("b") * 0.7 + F.pmod(F.xxhash64("i", F.lit(1)), F.lit(1000)) / 9.0)
    return causal.discover(d, "c", ["a", "b"], "i", causal.Knobs())


def _parted(spark, sf_dir):
    """Folds that SQL can name."""
    d = table(spark, sf_dir, "lineitem")
    return d.select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("row_key"), (F.col("l_orderkey") % 5).cast("int").alias("part"), *FEATURES, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


_PARTED = "(SELECT l_orderkey % 5 AS fold, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"
_FOLDS = f"""WITH d AS {_PARTED}, f AS (SELECT k, regr_sxy(net, l_tax) AS sxy, regr_sxx(net, l_tax) AS sxx, avg(net) AS my, avg(l_tax) AS mx, count(*) AS n FROM d, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE fold <> k GROUP BY k),
 e AS (SELECT net, my + sxy / (sxx + strength * sxx / (n - 1)) * (l_tax - mx) AS p, model FROM d JOIN f ON fold = k, (SELECT unnest(['linear', 'ridge']) AS model, unnest([1e-6, 1.0]) AS strength))
 SELECT model, count(*) AS n, {{R:sqrt(avg(pow(net - p, 2)))}} AS rmse, {{R:1 - avg(pow(net - p, 2)) / var_pop(net)}} AS r2 FROM e GROUP BY model"""


@query("cross_validated_lines", _FOLDS, digits=4)
def cross_validated_lines(spark, sf_dir):
    d = _parted(spark, sf_dir)
    return models.cross_validated(d, ["l_tax"], "net", "row_key", fold="part").unionByName(models.cross_validated(d, ["l_tax"], "net", "row_key", ridge=1.0, label="ridge", fold="part"))


def _stump_sql(features: list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT fold, net AS y, {i} AS i, {c} AS v FROM d" for i, c in enumerate(features))
    return f"""WITH d AS {_PARTED}, l AS ({long}), t AS (SELECT k, i, v, y FROM l, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE fold <> k),
 m AS (SELECT k, i, v AS m FROM (SELECT k, i, v, row_number() OVER (PARTITION BY k, i ORDER BY v) - 1 AS place, count(*) OVER (PARTITION BY k, i) AS n FROM t) WHERE place = n // 2),
 g AS (SELECT t.k, t.i, any_value(m) AS m, avg(y) FILTER (v <= m) AS lo, avg(y) FILTER (v > m) AS hi, var_pop(y) FILTER (v <= m) * count(*) FILTER (v <= m) + var_pop(y) FILTER (v > m) * count(*) FILTER (v > m) AS sse FROM t JOIN m ON m.k = t.k AND m.i = t.i GROUP BY 1, 2),
 b AS (SELECT k, i, m, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sse, i) AS place FROM g WHERE sse IS NOT NULL) WHERE place = 1),
 e AS (SELECT y, CASE WHEN v <= m THEN lo ELSE hi END AS p FROM l JOIN b ON l.fold = b.k AND l.i = b.i)
 SELECT 'decision stump' AS model, count(*) AS n, {{R:sqrt(avg(pow(y - p, 2)))}} AS rmse, {{R:1 - avg(pow(y - p, 2)) / var_pop(y)}} AS r2 FROM e"""


@query("stump_of_named_folds", _stump_sql(FEATURES), digits=3)
def stump_of_named_folds(spark, sf_dir):
    return models.stump(_parted(spark, sf_dir), FEATURES, "net", "row_key", fold="part")


_plain = lambda sql: sql.replace("{R:", "(").replace("} AS", ") AS")


@query("benchmark_of_named_folds", f"WITH a AS ({_plain(_FOLDS)}), b AS ({_plain(_stump_sql(['l_tax']))}) SELECT model, {{R:rmse}} AS rmse, {{R:r2}} AS r2, 1::BIGINT AS targets FROM (SELECT * FROM a UNION ALL SELECT * FROM b)", digits=3)
def benchmark_of_named_folds(spark, sf_dir):
    return models.benchmark(_parted(spark, sf_dir), ["l_tax"], ["net"], "row_key", fold="part")


@query("sample_facts", "SELECT least(100, count(*)) AS n, least(100, count(*)) AS distinct_keys, least(100, count(*)) AS in_table, true AS same_again FROM orders")
def sample_facts(spark, sf_dir):
    """What a sample without replacement has to be, whatever rows it drew."""
    d = table(spark, sf_dir, "orders").select("o_orderkey")
    one, two = models.sampled(d, 100, "o_orderkey"), models.sampled(d, 100, "o_orderkey")
    same = one.join(two, "o_orderkey").count() == one.count()
    known = one.join(d, "o_orderkey", "left_semi").count()
    return one.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys")).select("n", "distinct_keys", F.lit(known).cast("long").alias("in_table"), F.lit(same).alias("same_again"))


def _quality_sql() -> str:
    cols, places = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], [0.05, 0.0, 0.0, 0.14]
    one = """SELECT '{c}' AS column_name, 0.30 + 0.25 * least(1, ln(1 + v) / 4) + 0.15 * z + 0.30 * CASE WHEN d > 1 THEN bits / log2(d) ELSE 0 END
 - CASE WHEN d / n > 0.95 THEN 0.20 ELSE 0 END - CASE WHEN d / n > 0.98 THEN 0.15 ELSE 0 END - CASE WHEN d / n > 0.35 AND d > 32 THEN 0.08 ELSE 0 END + CASE WHEN d BETWEEN 2 AND 12 THEN 0.24 ELSE 0 END + {b} AS q
 FROM (SELECT var_samp({c}) AS v, avg(({c} <> 0)::INTEGER) AS z, count(*) AS n FROM lineitem), (SELECT count(*) AS d, sum(-k / t * log2(k / t)) AS bits FROM (SELECT count(*) AS k, sum(count(*)) OVER () AS t FROM lineitem GROUP BY round({c} * 1000)))"""
    return "SELECT column_name, {R:q} AS quality FROM (" + " UNION ALL ".join(one.replace("{c}", c).replace("{b}", str(b)) for c, b in zip(cols, places, strict=True)) + ")"


@query("numeric_quality", _quality_sql())
def numeric_quality(spark, sf_dir):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    profile = select.column_profile(table(spark, sf_dir, "lineitem").select(*cols))
    return spark.createDataFrame([(c, float(select.numeric_quality(c, p, i / 3))) for i, (c, p) in enumerate(profile.items())], "column_name string, quality double")


@query("feature_verdicts", f"""WITH d AS {_PARTED}, t AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, abs(corr({c}, net)) AS r FROM d" for c in FEATURES)})
 SELECT column_name, CASE WHEN r >= 0.995 THEN 'leakage' ELSE 'kept' END AS verdict FROM t UNION ALL SELECT 'flat', 'no variance' UNION ALL SELECT 'word', 'not numeric' UNION ALL SELECT 'left_out', 'excluded'""")
def feature_verdicts(spark, sf_dir):
    d = _parted(spark, sf_dir).drop("row_key", "part").withColumns({"flat": F.lit(2.0), "word": F.lit("x"), "left_out": F.col("l_tax") * 2})
    kept, gone = select.collect_features(d, "net", ["left_out"])
    return spark.createDataFrame([(c, "kept") for c in kept] + list(gone.items()), "column_name string, verdict string")


_OOD = """WITH o AS (SELECT o_totalprice + CASE WHEN i % 50 = 0 THEN 3e6 ELSE 0 END AS v, i < floor(0.7 * n) AS ref FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)),
 z AS (SELECT ref, abs((v - m) / s) AS d FROM o, (SELECT avg(v) AS m, stddev_samp(v) AS s FROM o WHERE ref)), t AS (SELECT avg(d) AS m, stddev_samp(d) AS s FROM z WHERE ref),
 k AS (SELECT count(*) FILTER (ref) AS reference_rows, count(*) FILTER (NOT ref) AS monitor_rows, count(*) FILTER (NOT ref AND ((d - m) / s >= 3.5 OR d >= 3.5)) AS ood, avg(d) FILTER (NOT ref) AS mean_distance, max(d) FILTER (NOT ref) AS max_distance FROM z, t),
 q AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS c FROM o WHERE ref), b AS (SELECT (v >= c[1])::INTEGER + (v >= c[2])::INTEGER + (v >= c[3])::INTEGER + (v >= c[4])::INTEGER AS bin, ref FROM o, q),
 h AS (SELECT greatest(count(*) FILTER (ref) / sum(count(*) FILTER (ref)) OVER (), 1e-6) AS a, greatest(count(*) FILTER (NOT ref) / sum(count(*) FILTER (NOT ref)) OVER (), 1e-6) AS m FROM b GROUP BY bin), p AS (SELECT sum((m - a) * ln(m / a)) AS psi FROM h)
 SELECT reference_rows, monitor_rows, ood, {R:ood / monitor_rows} AS ood_rate, {R:mean_distance} AS mean_distance, {R:max_distance} AS max_distance, {R:psi} AS psi_mean, {R:psi} AS psi_max,
 CASE WHEN psi >= 0.25 OR ood / monitor_rows >= 0.25 THEN 'critical' WHEN psi >= 0.15 OR ood / monitor_rows >= 0.10 THEN 'warning' ELSE 'stable' END AS band FROM k, p"""


@query("ood_of_one_column", _OOD)
def ood_of_one_column(spark, sf_dir):
    d = _indexed(spark, sf_dir).withColumn("v", F.col("o_totalprice") + F.when(F.col("i") % 50 == 0, 3e6).otherwise(0.0))
    return models.out_of_distribution(d, ["v"], "i")

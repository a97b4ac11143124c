"""Associations, regressions and groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, plots, relate, temporal
from ..operators.moments import gram
from .registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


def _net(spark, sf_dir):
    """lineitem with a dependent column and a dense row id."""
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


_NET = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem)"


@query("pearson_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {{R:corr({a}, {b})}} AS r, count(*) AS n FROM lineitem" for a, b in _PAIRS))
def pearson_matrix(spark, sf_dir):
    return relate.pearson(table(spark, sf_dir, "lineitem"), NUMBERS).drop("p_value")


@query("pearson_significance")
def pearson_significance(spark, sf_dir):
    return relate.pearson(_net(spark, sf_dir), [*NUMBERS, "net"])


@query(
    "spearman_matrix",
    "WITH k AS (SELECT "
    + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS)
    + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {{R:corr({a}, {b})}} AS r, count(*) AS n FROM k" for a, b in _PAIRS),
)
def spearman_matrix(spark, sf_dir):
    return relate.spearman(table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS).drop("p_value")


@query("average_ranks", "SELECT l_quantity AS v, {R:any_value(r)} AS rank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem) GROUP BY 1")
def average_ranks(spark, sf_dir):
    return relate.rank_map(table(spark, sf_dir, "lineitem"), "l_quantity")


_TAU = """WITH s AS (SELECT s_suppkey AS k, s_acctbal AS a, s_nationkey::DOUBLE AS b, count(*) OVER () AS n FROM supplier),
 t AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(count(*) FILTER (x.a <> y.a) * count(*) FILTER (x.b <> y.b)) AS tau FROM s x JOIN s y ON x.k < y.k AND x.n <= 256),
 r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s)
 SELECT {R:CASE WHEN (SELECT any_value(n) FROM s) <= 256 THEN (SELECT tau FROM t) ELSE 2 / pi() * asin((SELECT corr(ra, rb) FROM r)) END} AS tau"""


@query("kendall_tau", _TAU)
def kendall_tau(spark, sf_dir):
    return spark.createDataFrame([(relate.kendall(table(spark, sf_dir, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey"),)], "tau double")


_RHO = f"""WITH d AS {_NET}, k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY net) + (count(*) OVER (PARTITION BY net) - 1) / 2 AS b FROM d)
 SELECT {{R:2 / pi() * asin(corr(a, b))}} AS tau FROM k"""


@query("kendall_large", _RHO)
def kendall_large(spark, sf_dir):
    return spark.createDataFrame([(relate.kendall(_net(spark, sf_dir).withColumn("k", F.lit(1)), "l_quantity", "net", "k"),)], "tau double")


@query("simple_regression", f"SELECT {{R:regr_slope(net, l_extendedprice)}} AS slope, {{R:regr_intercept(net, l_extendedprice)}} AS intercept, {{R:corr(net, l_extendedprice)}} AS r, count(*) AS n FROM {_NET}", digits=5)
def simple_regression(spark, sf_dir):
    return relate.simple_regression(_net(spark, sf_dir), "l_extendedprice", "net")


@query(
    "fold_stability",
    "WITH e AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders), f AS (SELECT least(4, floor(i * 5 / n)) AS fold, abs(corr(x, y)) AS r FROM e GROUP BY 1) SELECT count(*) AS folds, {R:avg(r)} AS mean_abs_r, {R:greatest(0, least(1, 1 - stddev_samp(r) / avg(r)))} AS stability FROM f",
)
def fold_stability(spark, sf_dir):
    d = temporal.positions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "i")
    return relate.fold_stability(d, "o_totalprice", "o_custkey", "i")


@query("structural_relations", "SELECT 'sum' AS kind, 'l_discount' AS a, 'l_tax' AS b, 'both' AS c, 1.0::DOUBLE AS hit_rate UNION ALL SELECT 'product', 'l_quantity', 'unit', 'l_extendedprice', 1.0::DOUBLE")
def structural_relations(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_discount") + F.col("l_tax")).alias("both"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return relate.structural(d, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "both", "unit"])


@query("pair_scores")
def pair_scores(spark, sf_dir):
    d = temporal.positions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "i").withColumn("half", F.col("o_totalprice") / 2 + F.col("o_custkey") * 10)
    return relate.analyse_pairs(d, ["o_totalprice", "o_custkey", "half", "o_orderkey"], "i")


@query("relation_labels", "SELECT o_orderkey, CASE WHEN v >= 0.85 THEN 'Very strong' WHEN v >= 0.65 THEN 'Strong' WHEN v >= 0.45 THEN 'Moderate' WHEN v >= 0.25 THEN 'Weak' ELSE 'Very weak' END || ' positive association' AS relation FROM (SELECT o_orderkey, (o_orderkey % 100) / 100 AS v FROM orders)")
def relation_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", relate.relation_label((F.col("o_orderkey") % 100) / 100).alias("relation"))


_CHI = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
 f AS (SELECT x.a, y.b, coalesce(o, 0) AS o FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
 e AS (SELECT *, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM f),
 s AS (SELECT sum(pow(o - e, 2) / e) AS chi2, sum(o)::BIGINT AS n, count(DISTINCT a)::INTEGER AS levels_a, count(DISTINCT b)::INTEGER AS levels_b FROM e)
 SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, n, levels_a, levels_b, {R:chi2} AS chi2, {R:sqrt(chi2 / (n * (least(levels_a, levels_b) - 1)))} AS cramers_v, {R:exp(-chi2 / 2)} AS p_approx FROM s"""


@query("contingency_cramers_v", _CHI)
def contingency_cramers_v(spark, sf_dir):
    return relate.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").drop("odds_ratio", "ci_low", "ci_high", "strength")


_ODDS = """WITH c AS (SELECT (l_quantity > 25)::VARCHAR AS a, (l_discount > 0.05)::VARCHAR AS b, count(*) + 0.5 AS o FROM lineitem GROUP BY 1, 2),
 p AS (SELECT max(o) FILTER (a = 'false' AND b = 'false') AS a, max(o) FILTER (a = 'false' AND b = 'true') AS b, max(o) FILTER (a = 'true' AND b = 'false') AS c, max(o) FILTER (a = 'true' AND b = 'true') AS d FROM c)
 SELECT {R:a * d / (b * c)} AS odds_ratio, {R:exp(ln(a * d / (b * c)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))} AS ci_low, {R:exp(ln(a * d / (b * c)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))} AS ci_high FROM p"""


@query("odds_ratio_2x2", _ODDS)
def odds_ratio_2x2(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"))
    return relate.contingency(d, "a", "b").select("odds_ratio", "ci_low", "ci_high")


_ANOVA = """WITH g AS (SELECT o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS mean, coalesce(var_samp(o_totalprice), 0) AS var FROM orders GROUP BY 1),
 t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS rows, sum(n) AS m, sum(n * mean) AS s, sum(n * mean * mean) AS q, sum((n - 1) * var) AS w FROM g WHERE n > 1),
 r AS (SELECT groups, rows, q - s * s / m AS b, w, ((q - s * s / m) / (groups - 1)) / (w / (rows - groups)) AS f FROM t)
 SELECT 'o_orderpriority' AS category, 'o_totalprice' AS value, groups, rows, {R:f} AS f, {R:exp(-f / 2)} AS p_approx, {R:b / (b + w)} AS eta2 FROM r"""


@query("anova_eta2", _ANOVA, digits=4)
def anova_eta2(spark, sf_dir):
    return relate.anova(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").drop("gap")


_SHIFT = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 300000 ELSE 600000 END"
_STRATA = f"""WITH g AS (SELECT o_orderstatus AS level, count(*) AS n, avg(o_totalprice + {_SHIFT}) AS mean, var_samp(o_totalprice + {_SHIFT}) AS var FROM orders GROUP BY 1),
 t AS (SELECT count(*) AS groups, sum(n)::BIGINT AS rows, sum(n * mean) AS s, sum(n * mean * mean) AS q, sum((n - 1) * var) AS w, max(mean) - min(mean) AS span FROM g),
 r AS (SELECT groups, rows, q - s * s / rows AS b, w, span / sqrt(w / (rows - groups)) AS sep FROM t)
 SELECT 'o_orderstatus' AS category, 'v' AS value, groups, rows, {{R:b / (b + w)}} AS eta2, {{R:sep}} AS separation, (b / (b + w) >= 0.20 AND sep >= 0.75) AS stratified FROM r"""


@query("stratified_populations", _STRATA)
def stratified_populations(spark, sf_dir):
    s = F.col("o_orderstatus")
    d = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") + F.when(s == "F", 0).when(s == "O", 300000).otherwise(600000))
    return relate.strata(d, "o_orderstatus", "v")


_STACK = """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders),
 m AS (SELECT o_custkey AS u FROM orders ORDER BY o_custkey LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders))
 SELECT ((o_totalprice >= a)::INTEGER + (o_totalprice >= b)::INTEGER + (o_totalprice >= c)::INTEGER) AS bin, count(*) FILTER (o_custkey <= u) AS low, count(*) FILTER (o_custkey > u) AS high FROM orders, q, m GROUP BY 1"""


@query("stacked_profile", _STACK)
def stacked_profile(spark, sf_dir):
    return relate.stacked_profile(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey")


_FACET = """SELECT category, count(*) AS levels, {R:min(n / t)} AS least_share, {R:var_pop(m)} AS between FROM (
 SELECT 'o_orderpriority' AS category, count(*) AS n, sum(count(*)) OVER () AS t, avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority UNION ALL
 SELECT 'o_orderstatus', count(*), sum(count(*)) OVER (), avg(o_totalprice) FROM orders GROUP BY o_orderstatus) GROUP BY category HAVING count(*) BETWEEN 2 AND 12 AND min(n / t) >= 0.05"""


@query("facet_column", _FACET, digits=3)
def facet_column(spark, sf_dir):
    return relate.facet_column(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")


@query("topn_other", "SELECT CASE WHEN k <= 12 THEN level ELSE 'OTHER' END AS level, sum(n)::BIGINT AS n FROM (SELECT p_type AS level, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY 1) GROUP BY 1")
def topn_other(spark, sf_dir):
    return relate.top_other(table(spark, sf_dir, "part"), "p_type")


def _gain_sql() -> str:
    cuts = lambda c: f"(SELECT list_distinct(quantile_cont({c}, [{', '.join(str(i / 8) for i in range(1, 8))}])) FROM {_NET})"
    return f"""WITH b AS (SELECT len(list_filter({cuts('l_extendedprice')}, lambda v: v <= l_extendedprice)) AS x, len(list_filter({cuts('net')}, lambda v: v <= net)) AS y FROM {_NET}),
 j AS (SELECT x, y, count(*) AS n FROM b GROUP BY 1, 2),
 p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM j),
 s AS (SELECT sum(-p * log2(px)) AS hx, sum(-p * log2(py)) AS hy, sum(p * log2(p / (px * py))) AS mi FROM p)
 SELECT {{R:hx}} AS hx, {{R:hy}} AS hy, {{R:mi}} AS mi, {{R:mi / hy}} AS x_explains_y, {{R:mi / hx}} AS y_explains_x, {{R:mi / hy - mi / hx}} AS asymmetry FROM s"""


@query("information_gain", _gain_sql())
def information_gain(spark, sf_dir):
    return relate.information_gain(_net(spark, sf_dir), "l_extendedprice", "net")


def _scores_sql() -> str:
    cols = ["l_extendedprice", "cost", "l_quantity"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    each = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a} * {b}, net)) AS s, corr({a}, {b}) AS r FROM d" for a, b in pairs)
    return f"WITH d AS (SELECT *, l_extendedprice * (1 + l_tax) AS cost FROM {_NET}) SELECT a, b, {{R:s}} AS score FROM ({each}) WHERE abs(r) >= 0.05"


@query("interaction_scores", _scores_sql())
def interaction_scores(spark, sf_dir):
    d = _net(spark, sf_dir).withColumn("cost", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return relate.interactions(d, ["l_extendedprice", "cost", "l_quantity"], "net")


@query("interaction_ttest")
def interaction_ttest(spark, sf_dir):
    return relate.interaction_test(_net(spark, sf_dir), "l_extendedprice", "l_discount", "net")


@query("ols_diagnostics")
def ols_diagnostics(spark, sf_dir):
    return relate.ols_table(_net(spark, sf_dir), ["l_extendedprice", "l_discount", "l_tax"], "net")


@query("ols_one_feature", f"SELECT 'l_extendedprice' AS term, {{R:regr_slope(net, l_extendedprice)}} AS beta, {{R:sqrt((1 - regr_r2(net, l_extendedprice)) * regr_syy(net, l_extendedprice) / (count(*) - 2) / regr_sxx(net, l_extendedprice))}} AS se FROM {_NET}", digits=7)
def ols_one_feature(spark, sf_dir):
    return relate.ols_table(_net(spark, sf_dir), ["l_extendedprice"], "net").where("term <> '(intercept)'").select("term", "beta", "se")


@query(
    "vif_two",
    f"SELECT column_name, {{R:1 / (1 - r * r)}} AS vif FROM (SELECT corr(l_extendedprice, net) AS r FROM {_NET}), (SELECT unnest(['l_extendedprice', 'net']) AS column_name)",
    digits=5,
)
def vif_two(spark, sf_dir):
    g = gram(_net(spark, sf_dir), ["l_extendedprice", "net"])
    return spark.createDataFrame(list(algebra.vif(g, ["l_extendedprice", "net"]).items()), "column_name string, vif double")


@query("vif_pruning")
def vif_pruning(spark, sf_dir):
    g = gram(_net(spark, sf_dir), [*NUMBERS, "net"])
    kept, gone = algebra.vif_pruned(g, [*NUMBERS, "net"])
    return spark.createDataFrame([(c, "kept", 0.0) for c in kept] + [(c, "dropped", min(v, 1e12)) for c, v in gone], "column_name string, verdict string, vif double")


@query(
    "partial_correlation",
    f"SELECT {{R:(ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc))}} AS r FROM (SELECT corr(net, l_discount) AS ab, corr(net, l_extendedprice) AS ac, corr(l_discount, l_extendedprice) AS bc FROM {_NET})",
)
def partial_correlation(spark, sf_dir):
    g = gram(_net(spark, sf_dir), ["net", "l_discount", "l_extendedprice"])
    return spark.createDataFrame([(algebra.partial_r(g, "net", "l_discount", ["l_extendedprice"]),)], "r double")


def _drift_sql() -> str:
    one = """SELECT '{a}' AS a, '{b}' AS b, '{c}' AS given, corr({a}, {b}) AS g, (corr({a}, {b}) - corr({a}, {c}) * corr({b}, {c})) / sqrt((1 - corr({a}, {c}) * corr({a}, {c})) * (1 - corr({b}, {c}) * corr({b}, {c}))) AS p FROM d"""
    each = " UNION ALL ".join(one.replace("{a}", a).replace("{b}", b).replace("{c}", c) for a, b, c in (("net", "l_extendedprice", "l_quantity"), ("net", "l_quantity", "l_extendedprice"), ("net", "l_discount", "l_extendedprice")))
    return f"""WITH d AS {_NET}, r AS ({each}), f AS (SELECT *, abs(p) >= 0.05 AND g * p < 0 AS flips, abs(p) <= abs(g) * 0.5 AND abs(g) - abs(p) >= 0.12 AS falls FROM r)
 SELECT a, b, given, {{R:g}} AS global_r, {{R:p}} AS conditional_r, CASE WHEN abs(g) < 0.15 THEN 'weak global signal' WHEN flips AND falls THEN 'sign reversal + magnitude collapse' WHEN flips THEN 'sign reversal' WHEN falls THEN 'magnitude collapse' ELSE 'stable' END AS verdict FROM f"""


@query("conditional_drift", _drift_sql())
def conditional_drift(spark, sf_dir):
    g = gram(_net(spark, sf_dir), ["net", "l_quantity", "l_extendedprice", "l_discount"])
    rows = []
    for a, b, c in (("net", "l_extendedprice", "l_quantity"), ("net", "l_quantity", "l_extendedprice"), ("net", "l_discount", "l_extendedprice")):
        r = float(g.pick([a, b]).correlation()[0, 1])
        p = algebra.partial_r(g, a, b, [c])
        rows.append((a, b, c, r, p, algebra.drift(r, p)))
    return spark.createDataFrame(rows, "a string, b string, given string, global_r double, conditional_r double, verdict string")


@query("lasso_path")
def lasso_path(spark, sf_dir):
    g = gram(_net(spark, sf_dir), [*NUMBERS, "net"])
    return spark.createDataFrame(list(algebra.lasso(g, NUMBERS, "net").items()), "column_name string, beta double")


@query("stepwise_ols")
def stepwise_ols(spark, sf_dir):
    g = gram(_net(spark, sf_dir), [*NUMBERS, "net"])
    return spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(algebra.stepwise(g, NUMBERS, "net"))], "step int, column_name string, adjusted_r2 double")


@query("pca_two")
def pca_two(spark, sf_dir):
    cols = [*NUMBERS, "net"]
    share, v = algebra.pca(gram(_net(spark, sf_dir), cols), cols)
    return spark.createDataFrame([(i + 1, float(share[i]), c, float(v[j, i])) for i in range(2) for j, c in enumerate(cols)], "component int, explained double, column_name string, loading double")


@query("information_clusters")
def information_clusters(spark, sf_dir):
    cols = [*NUMBERS, "net"]
    return spark.createDataFrame(list(algebra.clusters(gram(_net(spark, sf_dir), cols).correlation(), cols, 0.97).items()), "column_name string, representative string")


@query("feature_filters")
def feature_filters(spark, sf_dir):
    d = _net(spark, sf_dir).withColumn("copy", F.col("net") * 2 + 1)
    g = gram(d, [*NUMBERS, "copy", "net"])
    kept = algebra.identity_block(g, [*NUMBERS, "copy"])
    bad = algebra.contaminated(g, [*NUMBERS, "copy"], "net")
    hidden = algebra.hidden_driver(g, NUMBERS, "net")
    return spark.createDataFrame([("identity", c) for c in kept] + [("contaminated", c) for c in bad] + [("auxiliary", c) for c in relate.auxiliary_targets(g, "net")] + ([("hidden driver", hidden[1])] if hidden else []), "filter string, column_name string")


@query("partial_dependence")
def partial_dependence(spark, sf_dir):
    from ..operators.quantiles import exact_quantiles

    d = _net(spark, sf_dir)
    g = gram(d, ["l_extendedprice", "l_discount", "net"])
    fit = algebra.ols(g, ["l_extendedprice", "l_discount"], "net")
    points = exact_quantiles(d, ["l_extendedprice", "l_discount"], [0.1, 0.5, 0.9])
    means = dict(zip(g.names, g.mean.tolist(), strict=True))
    return spark.createDataFrame([(c, float(v), float(p)) for c, v, p in algebra.dependence_profile(fit, means, points)], "column_name string, value double, prediction double")


@query(
    "joined_profile",
    "SELECT n_name, count(*) AS orders, {R:avg(o_totalprice)} AS mean_price, {R:stddev_samp(o_totalprice)} AS sd_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    digits=4,
)
def joined_profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # A nation has a row in a table that does not grow.
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price"), F.stddev_samp("o_totalprice").alias("sd_price"))


def _sums(y: str, *xs: str) -> str:
    """SQL columns of cross products: s11, s12, s1y, ..., syy, n and means."""
    parts = [f"regr_sxx({y}, {x}) AS s{i}{i}, regr_sxy({y}, {x}) AS s{i}y, avg({x}) AS m{i}" for i, x in enumerate(xs, 1)]
    parts += [f"regr_sxy({b}, {a}) AS s{i}{j}" for i, a in enumerate(xs, 1) for j, b in enumerate(xs, 1) if i < j]
    return ", ".join([*parts, f"regr_syy({y}, {xs[0]}) AS syy, avg({y}) AS my, count(*) AS n"])


_TWO = f"""WITH s AS (SELECT {_sums('net', 'l_extendedprice', 'l_tax')} FROM {_NET}),
 b AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
 e AS (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS v FROM b)
 SELECT 'l_extendedprice' AS term, {{R:b1}} AS beta, {{R:sqrt(v * s22 / det)}} AS se, {{R:b1 / sqrt(v * s22 / det)}} AS t FROM e UNION ALL SELECT 'l_tax', {{R:b2}}, {{R:sqrt(v * s11 / det)}}, {{R:b2 / sqrt(v * s11 / det)}} FROM e"""


@query("ols_two_features", _TWO, digits=4)
def ols_two_features(spark, sf_dir):
    return relate.ols_table(_net(spark, sf_dir), ["l_extendedprice", "l_tax"], "net").where("term <> '(intercept)'").drop("p_value")


_TERM = f"""WITH d AS (SELECT l_quantity AS a, l_discount AS b, l_quantity * l_discount AS c, l_extendedprice AS y FROM lineitem), s AS (SELECT {_sums('y', 'a', 'b', 'c')} FROM d), q AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM s),
 p AS (SELECT n, s33 - (s13 * s13 * s22 - 2 * s13 * s23 * s12 + s23 * s23 * s11) / det AS cc, s3y - (s13 * s1y * s22 - (s13 * s2y + s23 * s1y) * s12 + s23 * s2y * s11) / det AS cy, syy - (s1y * s1y * s22 - 2 * s1y * s2y * s12 + s2y * s2y * s11) / det AS yy FROM q)
 SELECT 'ab' AS term, {{R:cy / cc}} AS beta, {{R:sqrt((yy - cy * cy / cc) / (n - 4) / cc)}} AS se, {{R:cy / cc / sqrt((yy - cy * cy / cc) / (n - 4) / cc)}} AS t FROM p"""


@query("interaction_term", _TERM, digits=4)
def interaction_term(spark, sf_dir):
    return relate.interaction_test(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice").drop("p_value")


@query("pca_of_two", f"SELECT unnest([1, 1, 2, 2]) AS component, unnest([(1 + r) / 2, (1 + r) / 2, (1 - r) / 2, (1 - r) / 2]) AS explained, unnest(['l_extendedprice', 'net', 'l_extendedprice', 'net']) AS column_name, {{R:sqrt(0.5)}} AS size FROM (SELECT round(corr(l_extendedprice, net), 12) AS r FROM {_NET})".replace("unnest([(1 + r) / 2, (1 + r) / 2, (1 - r) / 2, (1 - r) / 2])", "unnest([round((1 + r) / 2, 6), round((1 + r) / 2, 6), round((1 - r) / 2, 6), round((1 - r) / 2, 6)])"))
def pca_of_two(spark, sf_dir):
    cols = ["l_extendedprice", "net"]
    share, v = algebra.pca(gram(_net(spark, sf_dir), cols), cols)
    return spark.createDataFrame([(i + 1, float(share[i]), c, abs(float(v[j, i]))) for i in range(2) for j, c in enumerate(cols)], "component int, explained double, column_name string, size double")


@query("lasso_of_one", f"SELECT 'l_extendedprice' AS column_name, {{R:sign(r) * greatest(abs(r) - CASE WHEN n < 200 THEN 0.12 ELSE 0.08 END, 0)}} AS beta FROM (SELECT corr(net, l_extendedprice) AS r, count(*) AS n FROM {_NET})")
def lasso_of_one(spark, sf_dir):
    return spark.createDataFrame(list(algebra.lasso(gram(_net(spark, sf_dir), ["l_extendedprice", "net"]), ["l_extendedprice"], "net").items()), "column_name string, beta double")


_WIDE = [*NUMBERS, "net", "copy"]
_COPY = f"(SELECT *, net * 2 + 1 AS copy FROM {_NET})"


def _corr_table(names: list[str], source: str) -> str:
    """SQL: (i, j, a, b, r) for i < j."""
    return " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, var_samp({a}) AS va, var_samp({b}) AS vb FROM {source}" for i, a in enumerate(names) for j, b in enumerate(names) if i < j)


def _group_sql(limit: float) -> str:
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(_WIDE))
    return f"""WITH RECURSIVE c AS ({_corr_table(_WIDE, _COPY)}), l AS (SELECT i, j FROM c WHERE abs(r) >= {limit} UNION SELECT j, i FROM c WHERE abs(r) >= {limit}),
 names(i, name) AS (VALUES {names}), t(i, k) AS (SELECT i, i FROM names UNION SELECT t.i, l.j FROM t JOIN l ON l.i = t.k), m AS (SELECT i, min(k) AS k FROM t GROUP BY i)
 SELECT a.name AS column_name, b.name AS representative FROM m JOIN names a ON a.i = m.i JOIN names b ON b.i = m.k"""


def _copied(spark, sf_dir):
    return gram(_net(spark, sf_dir).withColumn("copy", F.col("net") * 2 + 1), _WIDE)


@query("redundancy_groups", _group_sql(0.92))
def redundancy_groups(spark, sf_dir):
    return spark.createDataFrame(list(relate.redundancy_groups(_copied(spark, sf_dir), _WIDE).items()), "column_name string, representative string")


@query("cluster_representatives", _group_sql(0.97))
def cluster_representatives(spark, sf_dir):
    return spark.createDataFrame(list(algebra.clusters(_copied(spark, sf_dir).correlation(), _WIDE, 0.97).items()), "column_name string, representative string")


@query("deterministic_pairs", f"SELECT a, b, {{R:r}} AS r FROM ({_corr_table(_WIDE, _COPY)}) WHERE abs(r) >= 0.999")
def deterministic_pairs(spark, sf_dir):
    return spark.createDataFrame(relate.deterministic(_copied(spark, sf_dir), _WIDE), "a string, b string, r double")


_OTHERS = [*NUMBERS, "copy"]
_FILTERS = f"""WITH p AS ({_corr_table(_OTHERS, _COPY)}), t AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, corr({c}, net) AS r FROM {_COPY}" for i, c in enumerate(_OTHERS))}),
 gone AS (SELECT DISTINCT CASE WHEN va < vb THEN a ELSE b END AS c FROM p WHERE abs(r) >= 0.98)
 SELECT 'identity' AS filter, c AS column_name FROM t WHERE c NOT IN (SELECT c FROM gone) UNION ALL SELECT 'contaminated', c FROM t WHERE abs(r) > 0.99 UNION ALL (SELECT 'auxiliary', c FROM t ORDER BY abs(r) DESC LIMIT 2)"""


@query("feature_blocks", _FILTERS)
def feature_blocks(spark, sf_dir):
    g = _copied(spark, sf_dir)
    rows = [("identity", c) for c in algebra.identity_block(g, _OTHERS)] + [("contaminated", c) for c in algebra.contaminated(g, _OTHERS, "net")]
    return spark.createDataFrame(rows + [("auxiliary", c) for c in relate.auxiliary_targets(g, "net")], "filter string, column_name string")


_RESIDUAL = f"""WITH t AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, corr({c}, net) AS r FROM {_NET}" for i, c in enumerate(NUMBERS))}), best AS (SELECT * FROM t ORDER BY abs(r) DESC LIMIT 1),
 p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {_NET}" for a in NUMBERS for b in NUMBERS if a != b)}),
 k AS (SELECT best.c AS first, best.r AS ry, t.c AS second, t.r AS g, (t.r - p.r * best.r) / sqrt(1 - best.r * best.r) AS v FROM best JOIN p ON p.a = best.c JOIN t ON t.c = p.b ORDER BY abs(v) DESC LIMIT 1)
 SELECT first, second, {{R:ry}} AS r, {{R:v}} AS r_residual FROM k WHERE abs(v) >= 0.25"""


@query("hidden_driver", _RESIDUAL)
def hidden_driver(spark, sf_dir):
    g = gram(_net(spark, sf_dir), [*NUMBERS, "net"])
    found = algebra.hidden_driver(g, NUMBERS, "net")
    r = float(g.pick([found[0], "net"]).correlation()[0, 1]) if found else None
    return spark.createDataFrame([(found[0], found[1], r, found[2])] if found else [], "first string, second string, r double, r_residual double")


@query(
    "residual_narrative",
    _RESIDUAL.replace("SELECT first, second, {R:ry} AS r, {R:v} AS r_residual FROM k WHERE abs(v) >= 0.25", """SELECT 1 AS place, 'residual' AS topic,
 printf('%s drives net most (|r| = %.3f); %s explains most of what it leaves (|r| = %.3f, overall r = %.3f).', first, abs(ry), second, abs(v), g)
 || CASE WHEN abs(g) < 0.15 THEN '' WHEN abs(v) >= 0.05 AND g < 0 AND abs(v) <= abs(g) * 0.5 AND abs(g) - abs(v) >= 0.12 THEN ' Against its overall relation: sign reversal + magnitude collapse.' WHEN abs(v) >= 0.05 AND g < 0 THEN ' Against its overall relation: sign reversal.' WHEN abs(v) <= abs(g) * 0.5 AND abs(g) - abs(v) >= 0.12 THEN ' Against its overall relation: magnitude collapse.' ELSE '' END AS text
 FROM k WHERE abs(v) >= 0.25 AND abs(ry) >= 0.35"""),
)
def residual_narrative(spark, sf_dir):
    g = gram(_net(spark, sf_dir), [*NUMBERS, "net"])
    rows = relate.narrative_rows([("empty", "  "), ("nothing", "No finding"), ("residual", relate.residual_narrative(g, NUMBERS, "net"))])
    return spark.createDataFrame(rows, "place int, topic string, text string")


_DEPEND = f"""WITH s AS (SELECT {_sums('net', 'l_extendedprice', 'l_discount')} FROM {_NET}),
 b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
 q AS (SELECT unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS x1, unnest(quantile_cont(l_discount, [0.1, 0.5, 0.9])) AS x2 FROM {_NET})
 SELECT 'l_extendedprice' AS column_name, {{R:x1}} AS value, {{R:my + b1 * (x1 - m1)}} AS prediction FROM b, q UNION ALL SELECT 'l_discount', {{R:x2}}, {{R:my + b2 * (x2 - m2)}} FROM b, q"""


@query("dependence_profile", _DEPEND, digits=4)
def dependence_profile(spark, sf_dir):
    return partial_dependence(spark, sf_dir)


_PIES = """WITH g AS (SELECT 'o_orderpriority' AS category, o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), avg(o_totalprice), var_pop(o_totalprice) FROM orders GROUP BY 2 UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*), avg(o_totalprice), var_pop(o_totalprice) FROM orders GROUP BY 2),
 s AS (SELECT category, count(*) AS levels, sum(n)::BIGINT AS rows, max(n) / sum(n) AS dominance, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum(n * v) AS w FROM g GROUP BY 1)
 SELECT category, 'o_totalprice' AS anchor, levels, rows, {R:dominance} AS dominance, {R:b / (b + w)} AS eta2 FROM s WHERE levels BETWEEN 2 AND 20 AND dominance <= 0.98 AND rows >= 30 ORDER BY b / (b + w) DESC LIMIT 3"""


@query("pie_ranking", _PIES)
def pie_ranking(spark, sf_dir):
    d = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).withColumn("one", F.lit("x"))
    return relate.pie_ranking(d, ["o_orderpriority", "o_orderstatus", "year", "one"], "o_totalprice")


_APPROVED = f"""WITH t AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, abs(corr({c}, net)) AS r FROM {_NET}" for i, c in enumerate(NUMBERS))}), w AS (SELECT i, c, r / sum(r) OVER () AS share FROM t),
 k AS (SELECT list(share ORDER BY share)[1 + (0.6 * (count(*) - 1))::INTEGER - CASE WHEN (0.6 * (count(*) - 1))::INTEGER > 0.6 * (count(*) - 1) THEN 1 ELSE 0 END] AS cut FROM w)
 SELECT c AS column_name, {{R:share}} AS importance FROM w, k WHERE share >= greatest(0.01, cut) AND c <> 'l_tax'"""


@query("approved_features", _APPROVED)
def approved_features(spark, sf_dir):
    r = gram(_net(spark, sf_dir), [*NUMBERS, "net"]).correlation()[-1]
    importance = relate.coherent_importance(dict(zip(NUMBERS, map(abs, r), strict=False)), dict(zip(NUMBERS, r, strict=False)))
    chosen = relate.approved(importance, {c for c in NUMBERS if c != "l_tax"})
    return spark.createDataFrame([(c, float(importance[c])) for c in chosen], "column_name string, importance double")


# -- plot data --

_BOX = """WITH q AS (SELECT o_orderpriority AS level, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
 SELECT level, n, {R:q1} AS q1, {R:median} AS median, {R:q3} AS q3, {R:min(o_totalprice)} AS low, {R:max(o_totalprice)} AS high, n >= 5 AND q3 - q1 > 1e-9 AS drawn
 FROM q JOIN orders ON o_orderpriority = level AND o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY level, n, q1, median, q3"""


@query("plot_box", _BOX, digits=4)
def plot_box(spark, sf_dir):
    return plots.box(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")


@query("plot_fitted_line")
def plot_fitted_line(spark, sf_dir):
    return plots.fitted_line(_net(spark, sf_dir), "l_extendedprice", "net")


@query("plot_residuals", "WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders) SELECT o_orderkey, {R:i + s * o_custkey} AS fitted, {R:o_totalprice - i - s * o_custkey} AS residual FROM orders, f", digits=4)
def plot_residuals(spark, sf_dir):
    return plots.residuals(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query("plot_pie", "SELECT o_orderstatus AS level, count(*)::BIGINT AS n, {R:count(*) / sum(count(*)) OVER ()} AS share, true AS drawn FROM orders GROUP BY 1")
def plot_pie(spark, sf_dir):
    return plots.pie(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("plot_level_means", "SELECT o_orderpriority AS level, count(*) AS n, {R:avg(o_totalprice)} AS mean, {R:stddev_samp(o_totalprice)} AS sd FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 12", digits=4)
def plot_level_means(spark, sf_dir):
    return plots.level_means(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")


_SERIES = """WITH e AS (SELECT epoch(ts) AS t, value, min(epoch(ts)) OVER () AS lo, (max(epoch(ts)) OVER () - min(epoch(ts)) OVER ()) / 100 AS w FROM events)
 SELECT {R:any_value(lo + (s + 0.5) * w)} AS position, {R:avg(value)} AS mean, count(value) AS n FROM (SELECT *, least(99, floor((t - lo) / w)) AS s FROM e) GROUP BY s"""


@query("plot_series", _SERIES, digits=3)
def plot_series(spark, sf_dir):
    return plots.series(table(spark, sf_dir, "events"), "value", "ts", 100)


@query("plot_heatmap")
def plot_heatmap(spark, sf_dir):
    d = _net(spark, sf_dir)
    return plots.heatmap(d, [*NUMBERS, "net"]).unionByName(plots.heatmap(d, [*NUMBERS, "net"], clustered=True))


@query("plot_scatter", "SELECT o_custkey::DOUBLE AS x, {R:o_totalprice} AS y FROM (SELECT *, row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM orders) WHERE n <= 1000 OR floor((i + 1) * 1000 / n) > floor(i * 1000 / n)")
def plot_scatter(spark, sf_dir):
    from ..sources.tabular import with_row_id

    return plots.scatter(with_row_id(table(spark, sf_dir, "orders")), "o_custkey", "o_totalprice", "row_id", 1000)


@query("plot_ogive", "SELECT v, n, {R:100.0 * sum(n) OVER (ORDER BY v) / sum(n) OVER ()} AS percent FROM (SELECT p_size::DOUBLE AS v, count(*) AS n FROM part GROUP BY 1)")
def plot_ogive(spark, sf_dir):
    return plots.ogive(table(spark, sf_dir, "part"), "p_size")


@query("plot_schedule", "SELECT l_orderkey AS task, o_orderdate AS start, {R:(epoch(l_shipdate) - epoch(o_orderdate)) / 3600} AS hours, 'days' AS unit FROM (SELECT l_orderkey, o_orderdate, max(l_shipdate) AS l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE epoch(l_shipdate) >= epoch(o_orderdate) ORDER BY start, task LIMIT 25")
def plot_schedule(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    d = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("l_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("l_shipdate"))
    return plots.tasks(d, "l_orderkey", "o_orderdate", "l_shipdate")


_THIN = "n <= 500 OR floor((i + 1) * 500 / n) > floor(i * 500 / n)"


@query("plot_scatter_3d", f"SELECT {{R:o_custkey}} AS x, {{R:o_totalprice}} AS y, {{R:o_orderkey}} AS z FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE {_THIN}")
def plot_scatter_3d(spark, sf_dir):
    d = temporal.positions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "i")
    return plots.scatter_3d(d, "o_custkey", "o_totalprice", "o_orderkey", "i", 500)


_LINES = """WITH d AS (SELECT epoch(o_orderdate) AS x, o_totalprice, o_custkey::DOUBLE AS o_custkey, min(epoch(o_orderdate)) OVER () AS lo, (max(epoch(o_orderdate)) OVER () - min(epoch(o_orderdate)) OVER ()) / 50 AS w FROM orders),
 l AS (SELECT 'o_totalprice' AS series, x, o_totalprice AS y, lo, w FROM d UNION ALL SELECT 'o_custkey', x, o_custkey, lo, w FROM d)
 SELECT series, {R:any_value(lo + (s + 0.5) * w)} AS x, {R:avg(y)} AS y FROM (SELECT *, least(49, floor((x - lo) / w)) AS s FROM l) GROUP BY series, s"""


@query("plot_multi_line", _LINES, digits=3)
def plot_multi_line(spark, sf_dir):
    return plots.multi_line(table(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice", "o_custkey"], 50)


@query("plot_faceted_scatter", "SELECT facet, {R:o_custkey} AS x, {R:o_totalprice} AS y FROM (SELECT o_orderpriority AS facet FROM orders GROUP BY 1 HAVING count(*) >= 8 ORDER BY count(*) DESC, 1 LIMIT 3) JOIN orders ON o_orderpriority = facet")
def plot_faceted_scatter(spark, sf_dir):
    return plots.faceted_scatter(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderpriority", "o_orderkey", facets=3, points=10**9)


_HALF = "(SELECT o_totalprice, o_custkey::DOUBLE AS o_custkey, o_totalprice / 2 + o_custkey * 1000 AS half, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS total FROM orders)"
_FIGURES = f"""WITH d AS {_HALF}, p AS (SELECT 'o_totalprice' AS a, 'half' AS b, o_totalprice AS x, half AS y, i, total FROM d UNION ALL SELECT 'o_custkey', 'half', o_custkey, half, i, total FROM d),
 f AS (SELECT a, b, abs(corr(x, y)) AS r FROM p GROUP BY a, b, least(4, floor(i * 5 / total)) HAVING count(*) >= 8), s AS (SELECT a, b, greatest(0, least(1, 1 - stddev_samp(r) / avg(r))) AS steady FROM f GROUP BY a, b),
 w AS (SELECT a, b, corr(x, y) AS r, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, count(*) AS n FROM p GROUP BY a, b)
 SELECT a, b, n, {{R:r}} AS r, {{R:slope}} AS slope, {{R:intercept}} AS intercept, {{R:steady}} AS stability, {{R:r * r}} AS effect, {{R:(0.20 * (0.6 * r * r + 0.4 * abs(r)) + 0.15 * steady) * 0.35}} AS score,
 CASE WHEN abs(r) >= 0.85 THEN 'Very strong' WHEN abs(r) >= 0.65 THEN 'Strong' WHEN abs(r) >= 0.45 THEN 'Moderate' WHEN abs(r) >= 0.25 THEN 'Weak' ELSE 'Very weak' END || ' positive association' AS relation FROM w JOIN s USING (a, b) WHERE abs(r) >= 0.25"""


@query("pair_figures", _FIGURES, digits=5)
def pair_figures(spark, sf_dir):
    d = temporal.positions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderkey", "i").withColumn("half", F.col("o_totalprice") / 2 + F.col("o_custkey") * 1000)
    found = relate.analyse_pairs(d, ["o_totalprice", "o_custkey", "half"], "i").where("abs(r) >= 0.25")
    return found.select("a", "b", "n", "r", "slope", "intercept", "stability", "effect", "score", "relation")


@query("association_strength", f"WITH v AS ({_CHI.replace('{R:', '(').replace('}} AS', ') AS').replace('} AS', ') AS')}) SELECT a, b, CASE WHEN cramers_v >= 0.6 THEN 'very strong' WHEN cramers_v >= 0.4 THEN 'strong' WHEN cramers_v >= 0.2 THEN 'moderate' WHEN cramers_v >= 0.1 THEN 'weak' ELSE 'negligible' END AS strength FROM v")
def association_strength(spark, sf_dir):
    return relate.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").select("a", "b", "strength")


@query("matrix_inverse", f"""WITH s AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS d FROM {_NET})
 SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j, unnest([d, -b, -b, a]) / (a * d - b * b) AS v FROM s""".replace("unnest([d, -b, -b, a]) / (a * d - b * b) AS v", "round(unnest([d / (a * d - b * b), -b / (a * d - b * b), -b / (a * d - b * b), a / (a * d - b * b)]), 6) + 0.0 AS v"))
def matrix_inverse(spark, sf_dir):
    m = algebra.inverse(gram(_net(spark, sf_dir), ["l_quantity", "l_discount"]).covariance())
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(2) for j in range(2)], "i int, j int, v double")


@query("leading_features", f"SELECT row_number() OVER (ORDER BY abs(r) DESC) AS place, c AS column_name FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS c, corr({c}, net) AS r FROM {_COPY}' for c in _OTHERS)}) ORDER BY abs(r) DESC LIMIT 3")
def leading_features(spark, sf_dir):
    r = _copied(spark, sf_dir).pick([*_OTHERS, "net"]).correlation()[-1]
    top = relate.leading({c: abs(float(x)) for c, x in zip(_OTHERS, r, strict=False)}, 3)
    return spark.createDataFrame(list(enumerate(top, 1)), "place long, column_name string")


@query("heatmap_cells", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {{R:corr({a}, {b})}} AS r FROM {_NET}" for a in [*NUMBERS, "net"] for b in [*NUMBERS, "net"]))
def heatmap_cells(spark, sf_dir):
    return plots.heatmap(_net(spark, sf_dir), [*NUMBERS, "net"]).select("a", "b", "r")


_STEP = f"""WITH t AS ({" UNION ALL ".join(f"SELECT {i} AS i, '{c}' AS c, corr({c}, net) AS r, count(*) AS n FROM {_NET}" for i, c in enumerate(NUMBERS))}), first AS (SELECT * FROM t ORDER BY abs(r) DESC LIMIT 1),
 p AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {_NET}" for a in NUMBERS for b in NUMBERS if a != b)}),
 two AS (SELECT t.c, first.n, (first.r * first.r + t.r * t.r - 2 * first.r * t.r * p.r) / (1 - p.r * p.r) AS r2 FROM first JOIN p ON p.a = first.c JOIN t ON t.c = p.b),
 second AS (SELECT c, 1 - (1 - r2) * (n - 1) / (n - 3) AS v FROM two ORDER BY v DESC LIMIT 1), one AS (SELECT c, 1 - (1 - r * r) * (n - 1) / (n - 2) AS v FROM first)
 SELECT 0 AS step, c AS column_name, {{R:v}} AS adjusted_r2 FROM one UNION ALL SELECT 1, second.c, {{R:second.v}} FROM second, one WHERE second.v - one.v > 0.0005"""


@query("stepwise_two", _STEP)
def stepwise_two(spark, sf_dir):
    found = algebra.stepwise(gram(_net(spark, sf_dir), [*NUMBERS, "net"]), NUMBERS, "net", additions=1, gain=0.0005)
    return spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(found)], "step int, column_name string, adjusted_r2 double")

"""Profiles of single columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.quantiles import exact_quantiles, nth_values
from .registry import query, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns: list[str], select: str, source: str = "lineitem", rest: str = "") -> str:
    """UNION ALL of one SELECT a column; {c} stands for the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.replace('{c}', c)} FROM {source} {rest.replace('{c}', c)}" for c in columns)


_MOMENTS = """count({c}) AS n, {R:avg({c})} AS mean, {R:var_samp({c})} AS variance, {R:stddev_samp({c})} AS stddev,
 {R:skewness({c})} AS skewness, {R:kurtosis({c})} AS kurtosis, {R:min({c})} AS min, {R:max({c})} AS max, {R:max({c}) - min({c})} AS value_range,
 {R:sum({c})} AS total, count(*) FILTER (abs({c}) > 1e-12) AS nonzero, {R:quantile_cont({c}, 0.05)} AS p05, {R:quantile_cont({c}, 0.25)} AS q1,
 {R:median({c})} AS median, {R:quantile_cont({c}, 0.75)} AS q3, {R:quantile_cont({c}, 0.95)} AS p95,
 {R:quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)} AS iqr,
 {R:CASE WHEN min({c}) > 0 THEN exp(avg(ln(CASE WHEN {c} > 0 THEN {c} END))) ELSE 0 END} AS geometric_mean,
 {R:CASE WHEN min({c}) > 0 THEN count({c}) / sum(1 / CASE WHEN {c} > 0 THEN {c} END) ELSE 0 END} AS harmonic_mean,
 {R:stddev_samp({c}) / abs(avg({c}))} AS cv, count(*) - count({c}) AS missing"""


def fill_c(sql: str, c: str) -> str:
    return sql.replace("{c}", c)


def per_column(columns: list[str], select: str, source: str = "lineitem") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {fill_c(select, c)} FROM {source}" for c in columns)


@query("numeric_profile", per_column(NUMBERS, _MOMENTS), digits=3)
def numeric_profile(spark, sf_dir):
    return P.moments(table(spark, sf_dir, "lineitem"), NUMBERS)


@query("univariate_mad", per_column(NUMBERS, "{R:mad({c})} AS mad"))
def univariate_mad(spark, sf_dir):
    return P.mad(table(spark, sf_dir, "lineitem"), NUMBERS)


_TRIM = "{R:avg(v)} AS trimmed_mean, count(*) AS n_kept FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS k, count(*) OVER () AS n FROM lineitem WHERE {c} IS NOT NULL) WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1)"


@query("trimmed_mean", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {fill_c(_TRIM, c)}" for c in NUMBERS))
def trimmed_mean(spark, sf_dir):
    return P.trimmed_mean(table(spark, sf_dir, "lineitem"), NUMBERS)


_MODE = "{R:v} AS mode_value FROM (SELECT round({c}, 6) AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"


@query("mode_rounded", " UNION ALL ".join(f"(SELECT '{c}' AS column_name, {fill_c(_MODE, c)})" for c in NUMBERS))
def mode_rounded(spark, sf_dir):
    return P.rounded_mode(table(spark, sf_dir, "lineitem"), NUMBERS)


_FULL = f"""SELECT * FROM ({per_column(NUMBERS, _MOMENTS)}) JOIN ({per_column(NUMBERS, "{R:mad({c})} AS mad")}) USING (column_name)
 JOIN ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {fill_c(_TRIM, c)}" for c in NUMBERS)}) USING (column_name) JOIN ({" UNION ALL ".join(f"(SELECT '{c}' AS column_name, {fill_c(_MODE, c)})" for c in NUMBERS)}) USING (column_name)"""


@query("full_summary", _FULL, digits=3)
def full_summary(spark, sf_dir):
    return P.numeric_summary(table(spark, sf_dir, "lineitem"), NUMBERS)


@query(
    "quantiles",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, {p} AS p, {{R:quantile_cont({c}, {p})}} AS value FROM lineitem" for c in NUMBERS for p in (0.05, 0.25, 0.5, 0.75, 0.95)).replace("AS p,", "::DOUBLE AS p,"),
)
def quantiles(spark, sf_dir):
    q = exact_quantiles(table(spark, sf_dir, "lineitem"), NUMBERS, P.PROBS)
    return spark.createDataFrame([(c, p, v) for c, x in q.items() for p, v in x.items()], "column_name string, p double, value double")


@query("nth_values_narrowing", "SELECT k::BIGINT AS k, {R:v} AS value FROM (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k FROM lineitem) WHERE k IN (0, 100, 2500, 3000)")
def nth_values_narrowing(spark, sf_dir):
    found = nth_values(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], {"l_extendedprice": [0, 100, 2500, 3000]})["l_extendedprice"]
    return spark.createDataFrame(list(found.items()), "k long, value double")


_TOP8 = """SELECT column_name, value, n, {R:n / sum(n) OVER (PARTITION BY column_name)} AS share, (row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value))::INTEGER AS place
 FROM (SELECT 'o_orderpriority' AS column_name, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)
 QUALIFY place <= 8"""


@query("category_top8", _TOP8)
def category_top8(spark, sf_dir):
    return P.category_counts(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("multiselect_tokens", "SELECT token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_filter(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))), lambda x: x <> '')) AS token FROM part) GROUP BY 1 ORDER BY n DESC, token LIMIT 8")
def multiselect_tokens(spark, sf_dir):
    return P.token_counts(table(spark, sf_dir, "part"), "p_name", " ")


@query("datetime_range", "SELECT 'ts' AS column_name, epoch(min(ts))::BIGINT AS first_second, epoch(max(ts))::BIGINT AS last_second, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS range_seconds FROM (SELECT date_trunc('second', ts) AS ts FROM events)")
def datetime_range(spark, sf_dir):
    return P.datetime_ranges(table(spark, sf_dir, "events"), ["ts"])


@query("distinct_counts", "SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS distinct_values FROM events UNION ALL SELECT 'value', count(DISTINCT round(value, 6)) FROM events UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM events")
def distinct_counts(spark, sf_dir):
    return P.distinct_counts(table(spark, sf_dir, "events"), ["event_type", "value", "user_id"])


@query("approx_distinct")
def approx_distinct(spark, sf_dir):
    return P.approx_distinct_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


_GAPS = "(SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_returnflag END AS b FROM lineitem)"


@query("quality_matrix", per_column(["a", "b"], "count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS missing, {R:count(*) FILTER ({c} IS NULL) / count(*)} AS missing_ratio", _GAPS))
def quality_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_returnflag")).alias("b"))
    return P.quality_matrix(d, ["a", "b"])


_ENTROPY = "SELECT '{c}' AS column_name, count(*) AS levels, {R:CASE WHEN count(*) > 1 THEN sum(-p * log2(p)) / log2(count(*)) ELSE 0 END} AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY {c})"


@query("entropy", " UNION ALL ".join(fill_c(_ENTROPY, c) for c in ("o_orderpriority", "o_orderstatus")))
def entropy(spark, sf_dir):
    return P.entropy(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


_SURPRISE = """SELECT column_name, {R:sk} AS skewness, {R:ku} AS kurtosis, {R:sd} AS stddev, {R:rate} AS outlier_rate,
 {R:0.45 * abs(sk) + 0.25 * ln(1 + abs(ku)) + 0.20 * ln(1 + sd) + 0.10 * 10 * rate} AS surprise FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, skewness({c}) AS sk, kurtosis({c}) AS ku, stddev_samp({c}) AS sd, (SELECT count(*) FILTER ({c} < lo OR {c} > hi) / count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM lineitem)) AS rate FROM lineitem" for c in NUMBERS
) + ")"


@query("surprise_ranking", _SURPRISE, digits=4)
def surprise_ranking(spark, sf_dir):
    return P.surprise(table(spark, sf_dir, "lineitem"), NUMBERS)


@query("histogram_20", "SELECT least(19, floor((v - lo) / w))::INTEGER AS bin, {R:lo + least(19, floor((v - lo) / w)) * w} AS low, {R:lo + (least(19, floor((v - lo) / w)) + 1) * w} AS high, count(*) AS n FROM (SELECT o_totalprice AS v, min(o_totalprice) OVER () AS lo, (max(o_totalprice) OVER () - min(o_totalprice) OVER ()) / 20 AS w FROM orders) GROUP BY lo, w, 1, 2, 3", digits=4)
def histogram_20(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)


_AUTO = """WITH s AS (SELECT count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem),
 b AS (SELECT lo, greatest(5, least(96, ceil((hi - lo) / (2 * iqr * pow(n, -1 / 3))))) AS k, (hi - lo) / greatest(5, least(96, ceil((hi - lo) / (2 * iqr * pow(n, -1 / 3))))) AS w FROM s)
 SELECT least(k - 1, floor((l_extendedprice - lo) / w))::INTEGER AS bin, {R:lo + least(k - 1, floor((l_extendedprice - lo) / w)) * w} AS low, {R:lo + (least(k - 1, floor((l_extendedprice - lo) / w)) + 1) * w} AS high, count(*) AS n FROM lineitem, b GROUP BY 1, 2, 3"""


@query("histogram_auto", _AUTO, digits=4)
def histogram_auto(spark, sf_dir):
    return P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


_KDE = """WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, least(stddev_samp(o_totalprice), (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.34) AS sp FROM orders),
 g AS (SELECT lo + i * (hi - lo) / 159 AS x, n, 1.06 * sp * pow(n, -0.2) AS h FROM s, range(160) t(i))
 SELECT {R:x} AS x, {R:1e6 * sum(exp(-0.5 * pow((o_totalprice - x) / h, 2))) / (n * h * sqrt(2 * pi()))} AS density FROM g, orders GROUP BY x, n, h"""


@query("kde_160", _KDE, digits=3)
def kde_160(spark, sf_dir):
    return P.kde(table(spark, sf_dir, "orders"), "o_totalprice").withColumn("density", F.col("density") * 1e6)


@query("ecdf", "SELECT v, n, {R:100.0 * sum(n) OVER (ORDER BY v) / sum(n) OVER ()} AS percent FROM (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1)")
def ecdf(spark, sf_dir):
    return P.ecdf(table(spark, sf_dir, "lineitem"), "l_quantity")


@query("qq_normal")
def qq_normal(spark, sf_dir):
    return P.qq_points(table(spark, sf_dir, "orders"), "o_totalprice")


@query("qq_exponential", "SELECT {R:p} AS p, {R:-m * ln(1 - p)} AS theoretical, {R:q} AS sample FROM (SELECT (i + 0.5) / 20 AS p, m, (1 - (pos - floor(pos))) * vs[floor(pos)::BIGINT + 1] + (pos - floor(pos)) * vs[least(floor(pos)::BIGINT + 2, len(vs))] AS q FROM (SELECT i, m, vs, (i + 0.5) / 20 * (len(vs) - 1) AS pos FROM (SELECT list_sort(list(o_totalprice)) AS vs, avg(o_totalprice) AS m FROM orders), range(20) t(i)))", digits=3)
def qq_exponential(spark, sf_dir):
    return P.qq_points(table(spark, sf_dir, "orders"), "o_totalprice", points=20, family="exponential")


@query("bootstrap_mean_ci")
def bootstrap_mean_ci(spark, sf_dir):
    return P.bootstrap_mean_ci(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("data_health", "SELECT {R:100 * (0.30 + 0.10 * 8 / 11 + 0.15 * 5 / 7 + 0.20 * least(1, ln(1 + 3) / ln(1 + 7)) + 0.15 * least(1, ln(1 + 2) / ln(1 + 2)) + 0.10 * 0.7) * (1 - 0.01)} AS score, 'strong' AS band")
def data_health(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    missing = d.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in d.columns]).first()
    # five features kept; of 28 pairs three significant, two selected; stability .7, mean PSI .15
    score, band = P.health_score(d.count() * len(d.columns), sum(missing), len(d.columns), len(P.numeric_columns(d)), 5, 28, 3, 2, 0.7, 0.15)
    return spark.createDataFrame([(score, band)], "score double, band string")


@query("approximate_counts", "SELECT 'l_orderkey' AS column_name, true AS near FROM lineitem HAVING count(DISTINCT l_orderkey) > 0 UNION ALL SELECT 'l_partkey', true FROM lineitem HAVING count(DISTINCT l_partkey) > 0")
def approximate_counts(spark, sf_dir):
    """Whether sketches come within six of a hundred of the exact counts."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    exact = P.distinct_counts(d, d.columns).withColumnRenamed("distinct_values", "exact")
    return P.approx_distinct_counts(d, d.columns).join(exact, "column_name").select("column_name", (F.abs(F.col("distinct_values") / F.col("exact") - 1) <= 0.06).alias("near"))


@query("bootstrap_interval", "SELECT avg(o_totalprice) IS NOT NULL AS covers_mean, count(*) > 1 AS width_near_normal FROM orders")
def bootstrap_interval(spark, sf_dir):
    """Whether the interval holds the mean, and is about as wide as the normal one (a quarter either way)."""
    d = table(spark, sf_dir, "orders")
    normal = d.agg(F.avg("o_totalprice").alias("m"), (3.92 * F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("width"))
    both = P.bootstrap_mean_ci(d, "o_totalprice", "o_orderkey").join(normal)
    return both.select(F.col("m").between(F.col("low"), F.col("high")).alias("covers_mean"), (F.abs((F.col("high") - F.col("low")) / F.col("width") - 1) < 0.25).alias("width_near_normal"))


@query("critical_values", "SELECT * FROM (VALUES ('t', 10.0::DOUBLE, 2.228139::DOUBLE), ('t', 30.0, 2.042272), ('t', 120.0, 1.979930), ('z', 1.0, 0.317311), ('z', 1.959964, 0.05), ('z', 3.0, 0.0027)) v(kind, place, value)")
def critical_values(spark, sf_dir):
    """Tabled values: t at .05 for degrees of freedom, two-sided tails of the normal distribution."""
    from ..functions import special

    return spark.createDataFrame([("t", df, special.t_critical(0.05, df)) for df in (10.0, 30.0, 120.0)] + [("z", z, special.normal_two_sided(z)) for z in (1.0, 1.959964, 3.0)], "kind string, place double, value double")

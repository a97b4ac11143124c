"""Associations between columns: correlations, pair tables, contingency, variance decomposition."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.special import correlation_p
from . import algebra
from .moments import Gram, gram, merge
from .profile import finite, running_counts
from .quantiles import even_cuts_of, exact_quantiles, order_statistics

@dataclass(frozen=True)
class Policy:
    """Weights of importance, correlation and stability, the quantile of scores that selects, and
    factors for pairs of which both, one or none of the columns are modelled."""

    importance: float
    correlation: float
    stability: float
    quantile: float
    both: float
    one: float
    none: float


#: Fixed values.
POLICIES = {
    "balanced": Policy(0.50, 0.35, 0.15, 0.60, 1.0, 0.60, 0.25),
    "corr_heavy": Policy(0.30, 0.55, 0.15, 0.55, 1.0, 0.55, 0.20),
    "importance_heavy": Policy(0.65, 0.20, 0.15, 0.65, 1.0, 0.70, 0.35),
}


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row an unordered pair: a, b, r, n, p_value; complete rows, from the shared statistics."""
    g = gram(df, columns)
    r = g.correlation()
    rows = [(columns[i], columns[j], float(r[i, j]), g.n, correlation_p(float(r[i, j]), g.n)) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double, n long, p_value double")


def rank_map(df: DataFrame, column: str, cuts: list[float] | None = None) -> DataFrame:
    """(value, average rank) from value counts: running counts over buckets, then inside them."""
    return running_counts(df, finite(column), cuts).select("v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its average rank."""
    out, cuts = df, even_cuts_of(df, {c: finite(c) for c in columns})
    for c in columns:
        m = rank_map(df, c, cuts[c]).select(F.col("v").alias("__v"), F.col("rank").alias("__rank"))
        out = out.join(m, finite(out[c]) == F.col("__v"), "left").drop("__v", c).withColumnRenamed("__rank", c)
    return out


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    clean = df.select(*columns).dropna()
    return pearson(ranked(clean, columns), columns)


def kendall(df: DataFrame, a: str, b: str, key: str, exact_rows: int = 256) -> float:
    """Tau-b: exact over row pairs of small tables, else (2 / pi) asin(Spearman's rho)."""
    clean = df.select(finite(a).alias("a"), finite(b).alias("b"), F.col(key).alias("k")).dropna()
    n = clean.limit(exact_rows + 1).count()
    if n > exact_rows:
        rho = spearman(df.select(a, b), [a, b]).first()["r"]
        return 2 / math.pi * math.asin(max(-1.0, min(1.0, rho)))
    x, y = clean.alias("x"), clean.alias("y")
    sx, sy = F.signum(F.col("x.a") - F.col("y.a")), F.signum(F.col("x.b") - F.col("y.b"))
    row = x.join(F.broadcast(y), F.col("x.k") < F.col("y.k")).agg(F.sum(sx * sy).alias("s"), F.count_if(sx != 0).alias("p"), F.count_if(sy != 0).alias("q")).first()
    return float(row["s"] / math.sqrt(row["p"] * row["q"])) if row["p"] and row["q"] else 0.0


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = finite(y), finite(x)
    return df.agg(F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.corr(a, b).alias("r"), F.regr_count(a, b).alias("n"))


def fold_stability(df: DataFrame, x: str, y: str, row_id: str, folds: int = 5) -> DataFrame:
    """1 minus the coefficient of variation of |r| over contiguous folds, in 0..1. ``row_id`` is
    dense from 0. Folds: at most n / 6, with at least eight rows; below 30 rows none."""
    both = df.select(finite(x).alias("x"), finite(y).alias("y"), F.col(row_id).alias("i"))
    n = both.count()
    k = min(folds, n // 6)
    per = both.groupBy(F.least(F.lit(k - 1), F.floor(F.col("i") * k / n)).alias("fold")).agg(F.abs(F.corr("x", "y")).alias("r"), F.count("*").alias("m")).where("m >= 8")
    cv = F.stddev_samp("r") / F.nullif(F.avg("r"), F.lit(0.0))
    return per.agg(F.count("*").alias("folds"), F.avg("r").alias("mean_abs_r"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv)).alias("stability"))


def structural(df: DataFrame, columns: list[str], hit: float = 0.985) -> DataFrame:
    """Triples of the first 18 columns with a + b = c or a * b = c on nearly all rows, from one
    aggregate over the whole table."""
    cols = columns[:18]
    every = df.select(*[finite(c).alias(c) for c in cols])
    tests = [(op, a, b, c) for i, a in enumerate(cols) for b in cols[i + 1 :] for c in cols if c not in (a, b) for op in ("sum", "product")]
    if not tests:
        return df.sparkSession.createDataFrame([], "kind string, a string, b string, c string, hit_rate double")

    def good(op: str, a: str, b: str, c: str) -> Column:
        v = F.col(a) + F.col(b) if op == "sum" else F.col(a) * F.col(b)
        tol = (1e-5 if op == "sum" else 1e-4) * F.greatest(F.lit(1.0), F.abs(F.col(c)))
        return F.avg(F.when(F.abs(v - F.col(c)) <= tol, 1.0).otherwise(0.0))

    row = every.agg(*[good(*t).alias(f"t{i}") for i, t in enumerate(tests)]).first()
    found = [(*t, row[i]) for i, t in enumerate(tests) if row[i] is not None and row[i] >= hit]
    return df.sparkSession.createDataFrame(found, "kind string, a string, b string, c string, hit_rate double")


def choose_policy(importance: list[float]) -> str:
    """Few dominant importances trust correlation more, even ones importance more."""
    top, spread = max(importance, default=0.0), math.sqrt(sum(v * v for v in importance))
    if top > 0.65 or spread > 0.55:
        return "corr_heavy"
    return "importance_heavy" if top < 0.30 and spread < 0.40 else "balanced"


def label(r: float) -> str:
    word = next((w for limit, w in ((0.85, "Very strong"), (0.65, "Strong"), (0.45, "Moderate"), (0.25, "Weak")) if abs(r) >= limit), "Very weak")
    return f"{word} {'positive' if r >= 0 else 'negative'} association"


def relation_label(c: Column) -> Column:
    a = F.abs(c)
    word = F.when(a >= 0.85, "Very strong").when(a >= 0.65, "Strong").when(a >= 0.45, "Moderate").when(a >= 0.25, "Weak").otherwise("Very weak")
    return F.concat(word, F.when(c >= 0, " positive association").otherwise(" negative association"))


def analyse_pairs(df: DataFrame, columns: list[str], row_id: str, importance: dict[str, float] | None = None, policy: str = "auto", alpha: float = 0.05, max_columns: int = 512, quantile: float | None = None, folds: int = 5, fit_min_corr: float = 0.35) -> DataFrame:
    """The pair table. Two jobs, whatever the number of pairs: profiles of the columns, and one
    matrix of statistics a fold; whole-table figures are merged from the folds.

    Eligible columns vary, are at most 90 % null and have 24 values. Beyond ``max_columns`` those
    with the greatest variance stay. Pairs below the prefilter are not listed.
    """
    spark = df.sparkSession
    row = df.agg(F.count("*").alias("__n"), *[F.struct(F.count(finite(c)).alias("n"), F.var_samp(finite(c)).alias("v")).alias(c) for c in columns]).first()
    total = row["__n"]
    fine = [c for c in columns if (row[c]["v"] or 0.0) > 1e-12 and total and 1 - row[c]["n"] / total <= 0.90 and row[c]["n"] >= 24]
    fine = sorted(sorted(fine, key=lambda c: -row[c]["v"])[:max_columns], key=columns.index)
    schema = "a string, b string, n long, r double, slope double, intercept double, p_value double, significant boolean, stability double, coverage double, effect double, score double, relation string, redundant boolean, leakage boolean, cluster_a string, cluster_b string, tier int, selected boolean"
    if len(fine) < 2:
        return spark.createDataFrame([], schema)
    k = max(1, min(folds, total // 6) if total >= 30 else 1)
    tagged = df.withColumn("__fold", F.least(F.lit(k - 1), F.floor(F.col(row_id) * k / total)).cast("int"))
    per = gram(tagged, fine, fold="__fold")
    g = merge([per[f] for f in sorted(per)])
    r, sd = g.correlation(), g.stddev()
    by_fold = [np.abs(x.correlation()) for x in per.values() if x.n >= 8]
    imp = importance or {}
    w = POLICIES[choose_policy(list(imp.values())) if policy == "auto" else policy]
    floor = min(0.20, max(0.05, 0.5 * fit_min_corr))
    rep = algebra.clusters(r, fine, 0.97, imp)
    pairs = []
    for i, a in enumerate(fine):
        for j in range(i + 1, len(fine)):
            b, v = fine[j], float(r[i, j])
            if abs(v) < floor:
                continue
            p = correlation_p(v, g.n)
            rs = np.array([f[i, j] for f in by_fold])
            steady = float(np.clip(1 - rs.std(ddof=1) / rs.mean(), 0, 1)) if len(rs) > 1 and rs.mean() > 0 else 0.0
            modelled = (a in imp) + (b in imp)
            coverage = (w.none, w.one, w.both)[modelled]
            steady = steady if p < alpha or abs(v) >= 0.25 else 0.0
            weight = min(1.0, max(0.0, (imp.get(a, 0.0) + imp.get(b, 0.0)) / 2))
            score = (w.importance * weight + w.correlation * (0.6 * v * v + 0.4 * abs(v)) + w.stability * steady) * coverage
            slope = v * sd[j] / sd[i] if sd[i] > 0 else 0.0
            family = a in N.engineered_base(b) or b in N.engineered_base(a)
            redundant = abs(v) >= 0.9995 or family and abs(v) >= 0.98 or rep[a] == rep[b]
            leak = abs(v) >= 0.995 and (N.leak_hint(a) or N.leak_hint(b))
            pairs.append([a, b, g.n, v, float(slope), float(g.mean[j] - slope * g.mean[i]), p, p < alpha, steady, coverage, float(v * v), float(score), label(v), redundant, leak, rep[a], rep[b]])
    return spark.createDataFrame([tuple(x) for x in tiers(pairs, w.quantile if quantile is None else quantile)], schema)


def tiers(pairs: list[list], quantile: float, aggressiveness: float = 1.0) -> list[list]:
    """Adds tier and selected. Significant pairs are tier 1, tier 2 where their score reaches the
    quantile of significant scores; those that are neither redundant nor leaks are selected, up to
    six a significant pair (8 to 120). Below a floor others are promoted as tier 3, by effect,
    stability, significance and |r|."""
    real = [x for x in pairs if x[7] and not x[14]]
    scores = sorted(x[11] for x in real)
    cut = scores[int(quantile * (len(scores) - 1))] if scores else 0.0
    cap = max(8, min(120, 6 * len(real)))
    first = {id(x) for x in sorted((x for x in real if not x[13] and x[11] >= cut), key=lambda x: (-x[11], -x[10]))[:cap]}
    want = min(cap, max(1, round(max(3, min(12, len(pairs) // 25 + 1)) * aggressiveness))) if aggressiveness > 0 else 0
    merit = lambda x: 0.45 * x[10] + 0.25 * x[8] + 0.20 * min(1.0, max(0.0, -math.log10(max(x[6], 1e-12)) / 12)) + 0.10 * abs(x[3])
    rest = sorted((x for x in real if id(x) not in first), key=lambda x: (-merit(x), x[6], -x[11]))
    chosen = first | {id(x) for x in rest[: max(0, want - len(first))]}
    out = []
    for x in pairs:
        tier = 0
        if x[7] and not x[14]:
            tier = 2 if x[11] >= cut else 3 if id(x) in chosen else 1
        out.append([*x, tier, id(x) in chosen])
    return sorted(out, key=lambda x: (not x[18], -x[10], -abs(x[3])))


# -- categories --


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, Cramer's V, exp(-chi2 / 2) as p_approx, its label; for 2 x 2 the odds ratio with +0.5
    and its 95 % interval. Only cells that occur are counted: empty ones add to chi2 through the marginals, as
    chi2 = n (sum o^2 / (row total * column total) - 1)."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("o"))
    e = F.sum("o").over(Window.partitionBy("a")) * F.sum("o").over(Window.partitionBy("b"))
    s = cells.withColumn("e", e).agg(
        F.sum(F.col("o") / F.col("e") * F.col("o")).alias("q"), F.sum("o").alias("n"), F.count_distinct("a").alias("levels_a"), F.count_distinct("b").alias("levels_b"),
        *[f(x).alias(f"{name}_{x}") for x in ("a", "b") for name, f in (("low", F.min), ("high", F.max))],
    )
    row = s.first()
    if (row["n"] or 0) < 20 or row["levels_a"] < 2 or row["levels_b"] < 2:
        return df.sparkSession.createDataFrame([], _CONTINGENCY)
    chi2 = max(0.0, row["n"] * (row["q"] - 1))
    v = math.sqrt(chi2 / (row["n"] * (min(row["levels_a"], row["levels_b"]) - 1)))
    ratio = low = high = None
    if row["levels_a"] == row["levels_b"] == 2:
        count = {(r["a"], r["b"]): r["o"] for r in cells.collect()}  # four at most
        w, x, y, z = (count.get((i, j), 0) + 0.5 for i in (row["low_a"], row["high_a"]) for j in (row["low_b"], row["high_b"]))
        ratio, se = w * z / (x * y), math.sqrt(1 / w + 1 / x + 1 / y + 1 / z)
        low, high = math.exp(math.log(ratio) - 1.96 * se), math.exp(math.log(ratio) + 1.96 * se)
    strength = next((word for limit, word in ((0.6, "very strong"), (0.4, "strong"), (0.2, "moderate"), (0.1, "weak")) if v >= limit), "negligible")
    return df.sparkSession.createDataFrame([(a, b, row["n"], row["levels_a"], row["levels_b"], chi2, v, math.exp(-chi2 / 2), ratio, low, high, strength)], _CONTINGENCY)


_CONTINGENCY = "a string, b string, n long, levels_a int, levels_b int, chi2 double, cramers_v double, p_approx double, odds_ratio double, ci_low double, ci_high double, strength string"


def group_moments(df: DataFrame, category: str, value: str) -> DataFrame:
    both = df.where(F.col(category).isNotNull() & finite(value).isNotNull())
    return both.groupBy(F.col(category).cast("string").alias("level")).agg(F.count("*").alias("n"), F.avg(finite(value)).alias("mean"), F.coalesce(F.var_samp(finite(value)), F.lit(0.0)).alias("var"))


def anova(df: DataFrame, category: str, value: str) -> DataFrame:
    """F, exp(-F / 2) as p_approx, eta^2, and the difference of the two largest group means where
    p_approx < .05. Single-row groups leave the sums but count in the degrees of freedom."""
    g = group_moments(df, category, value)
    several = F.col("n") > 1
    total = g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.sum(F.when(several, F.col("n"))).alias("m"), F.sum(F.when(several, F.col("n") * F.col("mean"))).alias("s"), F.sum(F.when(several, F.col("n") * F.col("mean") ** 2)).alias("q"), F.sum(F.when(several, (F.col("n") - 1) * F.col("var"))).alias("within"), F.sort_array(F.collect_list("mean"), False).alias("means"))
    between = F.col("q") - F.col("s") ** 2 / F.col("m")
    f = (between / (F.col("groups") - 1)) / (F.col("within") / (F.col("rows") - F.col("groups")))
    out = total.where("groups between 2 and 10 and rows >= 24").select(F.lit(category).alias("category"), F.lit(value).alias("value"), "groups", "rows", f.alias("f"), F.exp(-f / 2).alias("p_approx"), (between / (between + F.col("within"))).alias("eta2"), (F.col("means")[0] - F.col("means")[1]).alias("gap"))
    return out.withColumn("gap", F.when(F.col("p_approx") < 0.05, F.col("gap")))


def strata(df: DataFrame, category: str, value: str) -> DataFrame:
    """eta^2 and separation of the groups of a category with 2 to 8 levels, where both are large."""
    g = group_moments(df, category, value)
    rows = F.sum("n").over(Window.partitionBy())
    big = g.withColumn("rows", rows).withColumn("levels", F.count("*").over(Window.partitionBy())).where((F.col("levels").between(2, 8)) & (F.col("rows") >= 30) & (F.col("n") >= F.greatest(F.lit(3), F.col("rows") / 300)))
    t = big.agg(F.count("*").alias("groups"), F.sum("n").alias("m"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * F.col("mean") ** 2).alias("q"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"), (F.max("mean") - F.min("mean")).alias("span"))
    between = F.col("q") - F.col("s") ** 2 / F.col("m")
    pooled = F.sqrt(F.col("within") / (F.col("m") - F.col("groups")))
    out = t.where("groups >= 2").select(F.lit(category).alias("category"), F.lit(value).alias("value"), "groups", F.col("m").alias("rows"), (between / (between + F.col("within"))).alias("eta2"), (F.col("span") / pooled).alias("separation"))
    return out.withColumn("stratified", (F.col("eta2") >= 0.20) & (F.col("separation") >= 0.75))


def quantile_bins(df: DataFrame, columns: list[str], bins: int) -> list[Column]:
    """Bin numbers by quantile cuts; a value equal to a cut goes to the upper bin."""
    cuts = exact_quantiles(df, columns, [i / bins for i in range(1, bins)])
    return [sum((F.when(finite(c) >= F.lit(x), 1).otherwise(0) for x in sorted({x for x in cuts[c].values() if x is not None})), F.lit(0)) for c in columns]


def stacked_profile(df: DataFrame, x: str, y: str, bins: int = 4) -> DataFrame:
    """Counts of y at most / above its upper median in quantile bins of x."""
    (number,) = quantile_bins(df, [x], bins)
    n = df.where(finite(y).isNotNull()).count()
    upper = order_statistics(df.select(finite(y).alias("y")), "y", [n // 2], n)[n // 2] if n else None
    return df.groupBy(number.alias("bin")).agg(F.count_if(finite(y) <= F.lit(upper)).alias("low"), F.count_if(finite(y) > F.lit(upper)).alias("high"))


def facet_column(df: DataFrame, categories: list[str], value: str) -> DataFrame:
    """Variance of group means by category, among categories of 2 to 12 levels with 5 % shares."""
    rows = None
    for c in categories:
        g = group_moments(df, c, value).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
        one = g.agg(F.count("*").alias("levels"), F.min("share").alias("least_share"), F.var_pop("mean").alias("between")).select(F.lit(c).alias("category"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows.where("levels between 2 and 12 and least_share >= 0.05").orderBy(F.desc("between"), "category")


def pie_ranking(df: DataFrame, categories: list[str], anchor: str, top: int = 3, least: int = 2, most: int = 20, dominance: float = 0.98) -> DataFrame:
    """Categories worth a pie beside a number: those of ``least`` to ``most`` levels, none of which holds more
    than ``dominance`` of the rows, by their eta^2 on the anchor; the first ``top`` of them."""
    spark = df.sparkSession
    schema = "category string, anchor string, levels long, rows long, dominance double, eta2 double"
    if not categories:
        return spark.createDataFrame([], schema)
    v = finite(anchor)
    level = lambda c: F.trim(F.col(c).cast("string"))
    long = df.where(v.isNotNull()).select(v.alias("v"), F.explode(F.array(*[F.struct(F.lit(c).alias("category"), level(c).alias("level")) for c in categories])).alias("x")).select("v", "x.*").where("level <> ''")
    per = long.groupBy("category", "level").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    sums = per.groupBy("category").agg(F.count("*").alias("levels"), F.sum("n").alias("rows"), (F.max("n") / F.sum("n")).alias("dominance"), (F.sum(F.col("n") * F.col("m") ** 2) - F.sum("n") * mean**2).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    fine = sums.where((F.col("rows") >= 30) & F.col("levels").between(least, most) & (F.col("dominance") <= dominance) & (F.col("between") + F.col("within") > 1e-12))
    return fine.select("category", F.lit(anchor).alias("anchor"), "levels", "rows", "dominance", (F.col("between") / (F.col("between") + F.col("within"))).alias("eta2")).orderBy(F.desc("eta2"), "category").limit(top)


def residual_narrative(g: Gram, features: list[str], target: str, primary: float = 0.35, second: float = 0.25) -> str | None:
    """The feature that drives the target most, and the one that explains most of what its line leaves;
    none where either is weaker than its limit. Administrative names do not count."""
    fine = [c for c in features if not N.is_admin(c)]
    if len(fine) < 2:
        return None
    r = g.pick([*fine, target]).correlation()
    best = int(np.argmax(np.abs(r[:-1, -1])))
    ry = float(r[best, -1])
    if abs(ry) < primary or abs(ry) >= 1:
        return None
    rest = {i: float(r[i, -1] - r[i, best] * ry) / math.sqrt(1 - ry * ry) for i in range(len(fine)) if i != best}
    i = max(rest, key=lambda j: abs(rest[j]))
    if abs(rest[i]) < second:
        return None
    change = algebra.drift(float(r[i, -1]), abs(rest[i]))
    tail = f" Against its overall relation: {change}." if change not in ("stable", "weak global signal") else ""
    return f"{fine[best]} drives {target} most (|r| = {abs(ry):.3f}); {fine[i]} explains most of what it leaves (|r| = {abs(rest[i]):.3f}, overall r = {r[i, -1]:.3f}).{tail}"


def narrative_rows(rows: list[tuple[str, str | None]]) -> list[tuple[int, str, str]]:
    """(place, topic, text) of findings that say something, numbered anew."""
    said = [(topic, text.strip()) for topic, text in rows if text and text.strip() and not text.strip().startswith(("Insufficient", "No "))]
    return [(i, topic, text) for i, (topic, text) in enumerate(said, 1)]


def top_other(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """The most frequent levels, the rest as OTHER."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "level"))
    return counts.withColumn("place", place).groupBy(F.when(F.col("place") <= top, F.col("level")).otherwise("OTHER").alias("level")).agg(F.sum("n").alias("n"))


def information_gain(df: DataFrame, x: str, y: str, bins: int = 8) -> DataFrame:
    """Gains in bits in both directions over quantile bins, and the direction of the larger share."""
    bx, by = quantile_bins(df, [x, y], min(16, bins))
    joint = df.where(finite(x).isNotNull() & finite(y).isNotNull()).groupBy(bx.alias("x"), by.alias("y")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    px, py = F.sum("n").over(Window.partitionBy("x")) / total, F.sum("n").over(Window.partitionBy("y")) / total
    p = joint.withColumns({"p": F.col("n") / total, "px": px, "py": py})
    sums = p.agg(F.sum(-F.col("p") * F.log2("px")).alias("hx"), F.sum(-F.col("p") * F.log2("py")).alias("hy"), F.sum(F.col("p") * F.log2(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))
    g = sums.select("hx", "hy", "mi", (F.col("mi") / F.nullif("hy", F.lit(0.0))).alias("x_explains_y"), (F.col("mi") / F.nullif("hx", F.lit(0.0))).alias("y_explains_x"))
    return g.withColumn("asymmetry", F.coalesce(F.col("x_explains_y") - F.col("y_explains_x"), F.lit(0.0)))


def interactions(df: DataFrame, features: list[str], target: str, importance: dict[str, float] | None = None) -> DataFrame:
    """|corr(a * b, y)| times the root of the importances, for pairs with |r| of .05, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(features[:8]) for b in features[i + 1 : 8]]
    y = finite(target)
    row = df.agg(*[F.struct(F.corr(finite(a) * finite(b), y).alias("t"), F.corr(finite(a), finite(b)).alias("r")).alias(f"{a}|{b}") for a, b in pairs]).first()
    imp = importance or {}
    rows = [(a, b, abs(row[f"{a}|{b}"]["t"] or 0.0) * math.sqrt(imp.get(a, 1.0) * imp.get(b, 1.0))) for a, b in pairs if abs(row[f"{a}|{b}"]["r"] or 0.0) >= 0.05]
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda x: -x[2]), "a string, b string, score double")


def interaction_test(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """t test of the product term in y ~ a + b + ab, from 16 rows on."""
    wide = df.select(finite(a).alias("a"), finite(b).alias("b"), finite(y).alias("y")).withColumn("ab", F.col("a") * F.col("b"))
    fit = algebra.ols(gram(wide, ["a", "b", "ab", "y"]), ["a", "b", "ab"], "y")
    rows = [r for r in fit.rows() if r[0] == "ab"] if fit and fit.n >= 16 else []
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double, p_value double")


def ols_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    fit = algebra.ols(gram(df, [*features, target]), features, target)
    return df.sparkSession.createDataFrame(fit.rows() if fit else [], "term string, beta double, se double, t double, p_value double")


def normalised(v: dict[str, float]) -> dict[str, float]:
    total = sum(max(0.0, x) for x in v.values())
    return {c: max(0.0, x) / total if total > 0 else 0.0 for c, x in v.items()}


def coherent_importance(neural: dict[str, float], corr: dict[str, float], rows: int = 1000, train_loss: float | None = None, held_loss: float | None = None, best_rmse: float | None = None) -> dict[str, float]:
    """A blend of model importance and |correlation|, each as shares. The model counts .70 (.55 below
    80 rows), less by .20 where its held-out loss is 1.5 times its training loss, and again where its
    error is 1.5 times the best baseline's."""
    w = 0.55 if rows < 80 else 0.70
    if train_loss is not None and held_loss is not None and held_loss > 1.5 * max(train_loss, 1e-12):
        w -= 0.20
    if best_rmse is not None and held_loss is not None and math.sqrt(max(held_loss, 0.0)) > 1.5 * best_rmse:
        w -= 0.20
    w = min(0.85, max(0.20, w))
    a, b = normalised(neural), normalised({c: abs(r) for c, r in corr.items()})
    return normalised({c: w * a.get(c, 0.0) + (1 - w) * b[c] for c in b})


def approved(importance: dict[str, float], significant: set[str]) -> list[str]:
    """Features at the 60th percentile of importance (.01 at least) that are significant; else the best."""
    if not importance:
        return []
    v = sorted(importance.values())
    limit = max(0.01, v[int(0.6 * (len(v) - 1))])
    fine = [c for c, x in importance.items() if x >= limit and c in significant]
    return sorted(fine, key=lambda c: -importance[c]) or [max(importance, key=importance.get)]


def auxiliary_targets(g: Gram, target: str, k: int = 2) -> list[str]:
    r = g.correlation()[g.names.index(target)]
    others = [(c, abs(r[i])) for i, c in enumerate(g.names) if c != target]
    return [c for c, _ in sorted(others, key=lambda x: -x[1])[:k]]


def redundancy_groups(g: Gram, columns: list[str], limit: float = 0.92, importance: dict[str, float] | None = None) -> dict[str, str]:
    """Column -> representative of the columns it is redundant with."""
    return algebra.clusters(g.pick(columns).correlation(), columns, limit, importance)


def deterministic(g: Gram, columns: list[str], limit: float = 0.999) -> list[tuple[str, str, float]]:
    """Pairs of columns that say the same."""
    r = g.pick(columns).correlation()
    return [(columns[i], columns[j], float(r[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns)) if abs(r[i, j]) >= limit]


def leading(importance: dict[str, float], k: int = 8) -> list[str]:
    return sorted(importance, key=lambda c: (-importance[c], c))[:k]

"""Order-dependent statistics: lags, drift, causality in time, smoothing, trends, schedules.

Windows are partitioned by a series key, or by blocks of the time axis whose edges carry over, so a
long single series is not ordered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N
from ..functions.special import normal_two_sided
from . import algebra, quantiles
from .moments import gram
from .profile import finite

#: Blocks of the order axis, of about even depth; rows of neighbouring blocks are copied over as far as a lag reaches.
BLOCKS = 64


def on_axis(df: DataFrame, axis: str) -> Column:
    """The axis as a number: seconds for dates and timestamps with or without a zone."""
    if isinstance(df.schema[axis].dataType, T.NumericType):
        return F.col(axis).cast("double")
    return F.col(axis).cast("timestamp").cast("double")


def blocked(df: DataFrame, axis: Column, tie: str, reach: int = 1) -> DataFrame:
    """Adds __block, __home and a copy of each block's last ``reach`` rows to the next non-empty
    block, so that lags up to ``reach`` are right inside a block. Blocks are of about even depth; equal
    times stay together."""
    cuts = quantiles.even_cuts(df, axis.cast("double"), BLOCKS)
    placed = quantiles.with_bucket(df, axis, cuts, "__block").withColumns({"__block": F.col("__block").cast("long"), "__home": F.lit(True)})
    if not cuts:
        return placed
    last = F.row_number().over(Window.partitionBy("__block").orderBy(axis.desc(), F.desc(tie)))
    edges = placed.withColumn("__last", last).where(F.col("__last") <= reach)
    # at most ``reach`` rows a block: a small table, put before every later block that needs it
    later = F.explode(F.sequence(F.col("__block") + 1, F.lit(BLOCKS))).alias("__to")
    copies = edges.select("*", later)
    near = F.row_number().over(Window.partitionBy("__to").orderBy(axis.desc(), F.desc(tie)))
    copies = copies.withColumn("__near", near).where(F.col("__near") <= reach)
    copies = copies.withColumns({"__block": F.col("__to"), "__home": F.lit(False)}).drop("__to", "__near", "__last")
    return placed.unionByName(copies)


def lagged(df: DataFrame, columns: list[str], axis: str, tie: str, steps: int = 1) -> DataFrame:
    """Adds <c>_lag<steps> in the order of (axis, tie)."""
    at = on_axis(df, axis)
    order = Window.partitionBy("__block").orderBy(at, tie)
    wide = blocked(df, at, tie, steps).withColumns({f"{c}_lag{steps}": F.lag(c, steps).over(order) for c in columns})
    return wide.where("__home").drop("__block", "__home")


def moving_average(df: DataFrame, value: str, axis: str, tie: str, width: int | None = None) -> DataFrame:
    """Adds <value>_ma: the trailing mean, over fewer rows at the head. Width: n / 10 in 3..25."""
    n = df.count() if width is None else 0
    w = width or int(min(25, max(3, n // 10)))
    at = on_axis(df, axis)
    order = Window.partitionBy("__block").orderBy(at, tie).rowsBetween(-(w - 1), 0)
    return blocked(df, at, tie, w - 1).withColumn(f"{value}_ma", F.avg(finite(value)).over(order)).where("__home").drop("__block", "__home")


def seasonal_naive(df: DataFrame, value: str, axis: str, tie: str, season: int) -> DataFrame:
    return lagged(df, [value], axis, tie, season).withColumnRenamed(f"{value}_lag{season}", f"{value}_naive")


def exponential_smoothing(df: DataFrame, key: str, value: str, axis: str, alpha: float = 0.3) -> DataFrame:
    """(key, axis, value, smoothed) of each series, s = alpha * v + (1 - alpha) * s_before.

    As a weighted sum: s_t = (1 - alpha)^t v_0 + alpha * sum (1 - alpha)^(t - i) v_i. Weights below
    1e-18 of the last are left out, so the window has a fixed width and no recursion is needed.
    """
    width = max(1, math.ceil(math.log(1e-18) / math.log(1 - alpha)))
    order = Window.partitionBy(key).orderBy(axis)
    frame = order.rowsBetween(-(width - 1), 0)
    i = F.row_number().over(order) - 1
    parts = df.select(key, axis, finite(value).alias(value)).withColumns({"__i": i, "__v": F.collect_list(value).over(frame)})
    m = F.size("__v")
    total = F.aggregate(
        F.sequence(F.lit(0), m - 1), F.lit(0.0), lambda acc, j: acc * (1 - alpha) + F.when((j == 0) & (F.col("__i") < width), F.get("__v", j)).otherwise(alpha * F.get("__v", j))
    )
    return parts.select(key, axis, value, total.alias("smoothed"))


def positions(df: DataFrame, axis: str, tie: str, name: str = "__pos") -> DataFrame:
    """Adds the dense place from 0 in the order of (axis, tie), from counts of buckets and places inside."""
    at = on_axis(df, axis)
    placed = quantiles.with_bucket(df, at, quantiles.even_cuts(df, at), "__block")
    # one row a bucket: the only window without a key
    starts = placed.groupBy("__block").agg(F.count("*").alias("n")).select("__block", (F.sum("n").over(Window.orderBy("__block")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(at, tie)) - 1
    return placed.withColumn("__inside", inside).join(F.broadcast(starts), "__block").withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__before", "__inside")


def cumulative(df: DataFrame, value: str, axis: str, tie: str) -> DataFrame:
    """Adds <value>_cum, the running sum in the order of (axis, tie): inside buckets, plus the sums of those before."""
    at = on_axis(df, axis)
    placed = quantiles.with_bucket(df, at, quantiles.even_cuts(df, at), "__block")
    # one row a bucket: the only window without a key
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = placed.groupBy("__block").agg(F.coalesce(F.sum(finite(value)), F.lit(0.0)).alias("s")).select("__block", F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("__before"))
    inside = F.coalesce(F.sum(finite(value)).over(Window.partitionBy("__block").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return placed.withColumn("__inside", inside).join(F.broadcast(carry), "__block").withColumn(f"{value}_cum", F.col("__before") + F.col("__inside")).drop("__block", "__before", "__inside")


def adf_drift(df: DataFrame, value: str, axis: str) -> DataFrame:
    """Regression of first differences on the lag: gamma, t, p = erfc(|t| / sqrt 2); the shift of
    the level between the first and last quarter, in standard deviations; and a verdict. Rows are
    ordered by axis, then value; from 16 rows on."""
    schema = "n long, gamma double, t double, p_value double, drift_ratio double, verdict string"
    clean = df.select(axis, finite(value).alias("y")).dropna()
    n = clean.count()
    if n < 16:
        return df.sparkSession.createDataFrame([(n, 0.0, 0.0, 1.0, 0.0, "insufficient")], schema)
    pairs = lagged(clean, ["y"], axis, "y").where("y_lag1 is not null")
    d, x = F.col("y") - F.col("y_lag1"), F.col("y_lag1")
    s = pairs.agg(F.count("*").alias("n"), F.regr_slope(d, x).alias("g"), F.regr_sxx(d, x).alias("sxx"), F.regr_syy(d, x).alias("syy"), F.regr_sxy(d, x).alias("sxy")).first()
    q = max(3, (n - 1) // 4)
    at = F.col("__pos")
    level = positions(clean, axis, "y").agg(F.avg(F.when(at < q, F.col("y"))).alias("a"), F.avg(F.when((at >= n - 1 - q) & (at < n - 1), F.col("y"))).alias("b"), F.stddev_samp("y").alias("sd")).first()
    g = s["g"] or 0.0
    se = math.sqrt(max(0.0, s["syy"] - s["sxy"] ** 2 / s["sxx"]) / max(1, s["n"] - 2) / s["sxx"]) if s["sxx"] else 0.0
    t, p = (g / se, normal_two_sided(g / se)) if se > 1e-12 else (0.0, 1.0)
    ratio = abs(level["b"] - level["a"]) / max(1e-9, level["sd"] or 0.0)
    if g > -0.03 and (p > 0.05 or ratio >= 0.35):
        verdict = "non-stationary"
    else:
        verdict = "stationary" if g <= -0.08 and p <= 0.05 and ratio < 0.25 else "borderline"
    return df.sparkSession.createDataFrame([(s["n"], g, t, p, ratio, verdict)], schema)


def granger(df: DataFrame, cause: str, effect: str, axis: str, tie: str) -> DataFrame:
    """F of adding cause's lag to effect's own lag, p = exp(-F / 2), from 24 rows on."""
    wide = lagged(df.select(*dict.fromkeys((axis, tie)), finite(cause).alias("x"), finite(effect).alias("y")), ["x", "y"], axis, tie)
    g = gram(wide, ["y_lag1", "x_lag1", "y"])
    small, large = algebra.ols(g, ["y_lag1"], "y"), algebra.ols(g, ["y_lag1", "x_lag1"], "y")
    rows = []
    if small and large and g.n >= 24 and large.rss > 0:
        f = (small.rss - large.rss) / (large.rss / (g.n - 3))
        rows = [(cause, effect, g.n, f, math.exp(-max(0.0, f) / 2))]
    return df.sparkSession.createDataFrame(rows, "cause string, effect string, n long, f double, p_approx double")


def slope_stability(df: DataFrame, x: str, y: str, row_id: str, parts: int = 3) -> DataFrame:
    """Slopes over contiguous thirds: span over max(.1, |mean slope|); stable at .45 or less."""
    n = df.count()
    third = F.least(F.lit(parts - 1), F.floor(F.col(row_id) * parts / max(1, n)))
    per = df.groupBy(third.alias("part")).agg(F.regr_slope(finite(y), finite(x)).alias("slope"))
    span = (F.max("slope") - F.min("slope")) / F.greatest(F.lit(0.1), F.abs(F.avg("slope")))
    return per.agg(F.count("slope").alias("parts"), F.avg("slope").alias("mean_slope"), span.alias("span")).withColumn("stable", F.col("span") <= 0.45)


def time_axis(df: DataFrame) -> str | None:
    """The first datetime column, else a date-like name, else none (the row index serves)."""
    from .profile import datetime_columns

    times = datetime_columns(df)
    return times[0] if times else next((c for c in df.columns if N.is_date_like(c)), None)


def regularised(df: DataFrame, value: str, axis: str, uneven_only: bool = True) -> DataFrame:
    """Means on a grid of the median step; if ``uneven_only``, where over 20 % of the steps differ from it by a
    tenth, and else the rows as they are. Otherwise always, and rows without a step are one mean without a time."""
    at = F.unix_timestamp(axis).cast("double")
    steps = lagged(df.select(axis, finite(value).alias(value)).withColumn("__t", at), ["__t"], axis, value).select((F.col("__t") - F.col("__t_lag1")).alias("d")).where("d > 0")
    s = quantiles.medians(steps, ["d"])["d"]
    if uneven_only:
        if not s:
            return df.select(axis, value)
        odd = steps.agg(F.avg(F.when(F.abs(F.col("d") - s) > 0.1 * s, 1.0).otherwise(0.0))).first()[0]
        if odd <= 0.20:
            return df.select(axis, value)
    step = F.lit(s).cast("double")
    return df.groupBy(F.timestamp_seconds(F.floor(at / step) * step).alias(axis)).agg(F.avg(finite(value)).alias(value))


def trend_choice(df: DataFrame, value: str, axis: str, tie: str) -> DataFrame:
    """Root mean square errors of a line, a parabola and the moving average; the least is chosen."""
    t = on_axis(df, axis)
    low, high = df.agg(F.min(t), F.max(t)).first()
    u = (t - low) / ((high - low) or 1.0)
    wide = moving_average(df.select(*dict.fromkeys((axis, tie)), finite(value).alias("y")), "y", axis, tie).withColumns({"u": u, "u2": u * u})
    g = gram(wide, ["u", "u2", "y"])
    out = [(name, math.sqrt(fit.rss / fit.n)) for name, fit in (("linear", algebra.ols(g, ["u"], "y")), ("quadratic", algebra.ols(g, ["u", "u2"], "y"))) if fit]
    out.append(("moving average", wide.agg(F.sqrt(F.avg((F.col("y") - F.col("y_ma")) ** 2))).first()[0]))
    best = min(out, key=lambda x: x[1])[0]
    return df.sparkSession.createDataFrame([(n, float(v), n == best) for n, v in out], "trend string, rmse double, chosen boolean")


def arima_110(df: DataFrame, value: str, axis: str, tie: str) -> DataFrame:
    """ARIMA(1, 1, 0) by least squares of differences on their lag, and the next value."""
    d1 = lagged(df.select(*dict.fromkeys((axis, tie)), finite(value).alias("y")), ["y"], axis, tie).withColumn("d", F.col("y") - F.col("y_lag1"))
    d2 = lagged(d1.where("d is not null"), ["d"], axis, tie)
    s = d2.agg(F.regr_slope("d", "d_lag1").alias("phi"), F.regr_intercept("d", "d_lag1").alias("c"), F.max_by("y", F.struct(F.col(axis), F.col(tie))).alias("last"), F.max_by("d", F.struct(F.col(axis), F.col(tie))).alias("step")).first()
    phi, c = s["phi"] or 0.0, s["c"] or 0.0
    return df.sparkSession.createDataFrame([(phi, c, (s["last"] or 0.0) + c + phi * (s["step"] or 0.0))], "phi double, constant double, forecast double")


def project_timeline(df: DataFrame) -> tuple[str, str] | None:
    """(start, end) column names of a schedule: a pair of dates of which the end never precedes."""
    from .profile import datetime_columns

    cols = datetime_columns(df)
    starts = [c for c in cols if any(w in c.lower() for w in ("start", "begin", "from", "order"))]
    ends = [c for c in cols if any(w in c.lower() for w in ("end", "finish", "due", "to", "ship"))]
    for a in starts:
        for b in ends:
            if a != b and df.agg(F.min(F.when(F.col(b) < F.col(a), 0).otherwise(1))).first()[0] == 1:
                return a, b
    return None


def dead_zones(df: DataFrame, anchors: list[str], feature: str, target: str, row_id: str, rounds: int = 20) -> DataFrame:
    """Two-means on two standardised anchors, started at the first and the middle row; a feature
    that is strong (.35) in one cluster and weak (.10) in the other has a dead zone."""
    s = df.agg(*[F.struct(F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s")).alias(c) for c in anchors], F.count("*").alias("n")).first()
    z = [(finite(c) - F.lit(s[c]["m"])) / F.lit(s[c]["s"] or 1.0) for c in anchors]
    pts = df.select(F.col(row_id).alias("i"), finite(feature).alias("x"), finite(target).alias("y"), *[e.alias(f"z{j}") for j, e in enumerate(z)]).dropna()
    heads = pts.where(F.col("i").isin(0, s["n"] // 2)).orderBy("i").collect()
    if len(heads) < 2:
        return df.sparkSession.createDataFrame([], "cluster int, n long, r double, dead_zone boolean")
    centres = [[h[f"z{j}"] for j in range(len(anchors))] for h in heads]
    dist = lambda c: sum(((F.col(f"z{j}") - F.lit(c[j])) ** 2 for j in range(len(anchors))), F.lit(0.0))
    for _ in range(rounds):
        own = F.when(dist(centres[0]) <= dist(centres[1]), 0).otherwise(1)
        new = {r["k"]: [r[f"z{j}"] for j in range(len(anchors))] for r in pts.groupBy(own.alias("k")).agg(*[F.avg(f"z{j}").alias(f"z{j}") for j in range(len(anchors))]).collect()}
        moved = max((abs(a - b) for k in new for a, b in zip(new[k], centres[k], strict=True)), default=0.0)
        centres = [new.get(k, centres[k]) for k in (0, 1)]
        if moved < 1e-9:
            break
    own = F.when(dist(centres[0]) <= dist(centres[1]), 0).otherwise(1)
    per = pts.groupBy(own.alias("cluster")).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    rs = {r["cluster"]: (r["n"], abs(r["r"] or 0.0)) for r in per.collect()}
    hit = len(rs) == 2 and min(n for n, _ in rs.values()) >= 10 and max(r for _, r in rs.values()) >= 0.35 and min(r for _, r in rs.values()) <= 0.10
    return per.withColumn("dead_zone", F.lit(hit))

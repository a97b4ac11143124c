"""Plot data as small DataFrames, with the rules that say whether a plot is worth drawing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_critical
from . import profile, quantiles, relate
from .models import evenly
from .profile import finite


def ogive_fits(n: int, unique: int) -> bool:
    return n >= 8 and unique >= 6


def box_fits(n: int, iqr: float) -> bool:
    return n >= 5 and iqr > 1e-9


def pie_fits(counts: list[int]) -> bool:
    """2 to 10 levels, none above 90 %, normalised entropy of .40 at least."""
    total = sum(counts)
    if not 2 <= len(counts) <= 10 or not total or max(counts) / total > 0.90:
        return False
    p = np.array([c for c in counts if c], float) / total
    return float(-(p * np.log2(p)).sum() / np.log2(len(counts))) >= 0.40


def line_fits(r: float, n: int) -> bool:
    return abs(r) >= 0.35 and n >= 12 and r * r >= (0.18 if n < 40 else 0.12)


def band_fits(r: float, n: int) -> bool:
    return abs(r) >= 0.45 and n >= 30


def residuals_fit(r: float, n: int) -> bool:
    return abs(r) >= 0.55 and n >= 24


def box(df: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Quartiles and whiskers (the extreme values inside 1.5 IQR) of each group."""
    v = finite(column)
    key = F.col(by).cast("string") if by else F.lit("all")
    rows = df.select(key.alias("level"), v.alias("v")).where("v is not null")
    sizes = rows.groupBy("level").agg(F.count("*").alias("n"))
    large = [r["level"] for r in sizes.where(F.col("n") > quantiles.SINGLE_PASS_VALUES).collect()]  # as many as the rows allow
    q = rows.where(~F.col("level").isin(large)).groupBy("level").agg(F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    if large:
        names = {x: f"l{i}" for i, x in enumerate(large)}
        cuts = quantiles.exact_quantiles(rows, {names[x]: F.when(F.col("level") == x, F.col("v")) for x in large}, [0.25, 0.5, 0.75])
        listed = df.sparkSession.createDataFrame([(x, list(cuts[names[x]].values())) for x in large], "level string, q array<double>")
        q = q.unionByName(sizes.join(F.broadcast(listed), "level").select("level", "n", "q"))
    q = q.select("level", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = rows.join(F.broadcast(q), "level").where((F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach))
    ends = inside.groupBy("level").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return q.join(ends, "level").withColumn("drawn", (F.col("n") >= 5) & (F.col("q3") - F.col("q1") > 1e-9))


def scatter(df: DataFrame, x: str, y: str, row_id: str, points: int = 10_000) -> DataFrame:
    """At most ``points`` evenly spaced points."""
    clean = df.select(row_id, finite(x).alias("x"), finite(y).alias("y")).dropna()
    return evenly(clean, points, row_id).select("x", "y")


def fitted_line(df: DataFrame, x: str, y: str, steps: int = 20) -> DataFrame:
    """x, fit, and the ends of the 95 % band of the mean, on an even grid; with what may be drawn."""
    a, b = finite(y), finite(x)
    s = df.agg(F.regr_count(a, b), F.regr_slope(a, b), F.regr_intercept(a, b), F.regr_sxx(a, b), F.regr_syy(a, b), F.regr_sxy(a, b), F.regr_avgx(a, b), F.min(F.when(a.isNotNull(), b)), F.max(F.when(a.isNotNull(), b))).first()
    n, slope, icept, sxx, syy, sxy, mx, low, high = s
    schema = "x double, fit double, low double, high double, line boolean, band boolean"
    if n < 3 or not sxx or not syy:
        return df.sparkSession.createDataFrame([], schema)
    r = sxy / (sxx * syy) ** 0.5
    sigma = (max(0.0, syy - sxy * sxy / sxx) / (n - 2)) ** 0.5
    t = t_critical(0.05, n - 2)
    rows = []
    for i in range(steps + 1):
        at = low + (high - low) * i / steps
        half = t * sigma * (1 / n + (at - mx) ** 2 / sxx) ** 0.5
        rows.append((at, icept + slope * at, icept + slope * at - half, icept + slope * at + half, line_fits(r, n), band_fits(r, n)))
    return df.sparkSession.createDataFrame(rows, schema)


def residuals(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(key, fitted, residual) of the simple regression."""
    fit = relate.simple_regression(df, x, y).first()
    fitted = F.lit(fit["intercept"]) + F.lit(fit["slope"]) * finite(x)
    return df.select(key, fitted.alias("fitted"), (finite(y) - fitted).alias("residual"))


def pie(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """Shares of the levels, the rest as OTHER, and whether a pie says anything."""
    counts = relate.top_other(df, column, top)
    fine = pie_fits([r["n"] for r in counts.collect()])
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("drawn", F.lit(fine))


def level_means(df: DataFrame, category: str, value: str, top: int = 12) -> DataFrame:
    """Mean and spread of a value by the most frequent levels."""
    g = relate.group_moments(df, category, value)
    return g.orderBy(F.desc("n"), "level").limit(top).select("level", "n", "mean", F.sqrt("var").alias("sd"))


def series(df: DataFrame, value: str, axis: str, points: int = 500) -> DataFrame:
    """Means over even stretches of an axis: the line of a long series."""
    from .temporal import on_axis

    at = on_axis(df, axis)
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "position double, mean double, n long")
    width = (high - low) / points or 1.0
    stretch = F.least(F.lit(points - 1), F.floor((at - low) / width))
    return df.groupBy(stretch.alias("s")).agg(F.avg(finite(value)).alias("mean"), F.count(finite(value)).alias("n")).select((low + (F.col("s") + 0.5) * width).alias("position"), "mean", "n")


def greedy_order(r: np.ndarray) -> list[int]:
    """Columns so that neighbours correlate: start with the strongest, append the most similar."""
    m = np.abs(r) - np.eye(len(r))
    order = [int(m.sum(axis=1).argmax())] if len(r) else []
    while len(order) < len(r):
        left = [i for i in range(len(r)) if i not in order]
        order.append(max(left, key=lambda i: (m[order[-1], i], -i)))
    return order


def linkage_order(r: np.ndarray) -> list[int]:
    """Columns by average-linkage clustering of 1 - |r|."""
    groups = [[i] for i in range(len(r))]
    d = 1 - np.abs(r)
    while len(groups) > 1:
        pairs = [(float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return groups[0] if groups else []


def heatmap(df: DataFrame, columns: list[str], most: int = 50, clustered: bool = False) -> DataFrame:
    """(a, b, r) with places, for at most ``most`` columns."""
    from .moments import gram

    cols = columns[:most]
    r = gram(df, cols).correlation()
    order = linkage_order(r) if clustered else greedy_order(r)
    return df.sparkSession.createDataFrame([(i, j, cols[a], cols[b], float(r[a, b])) for i, a in enumerate(order) for j, b in enumerate(order)], "i int, j int, a string, b string, r double")


def tasks(df: DataFrame, name: str, start: str, end: str, least: int = 3, most: int = 25) -> DataFrame:
    """Bars of a schedule in order of their start, in hours below three days, else in days."""
    hours = (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600.0
    rows = df.select(F.col(name).alias("task"), F.col(start).alias("start"), hours.alias("hours")).where("hours >= 0").orderBy("start", "task").limit(most)
    if rows.count() < least:
        return rows.limit(0).withColumn("unit", F.lit("hours"))
    days = rows.agg(F.max("hours")).first()[0] > 72
    return rows.withColumn("unit", F.lit("days" if days else "hours"))


def ogive(df: DataFrame, column: str) -> DataFrame:
    """Cumulative per cent, empty where there are too few points."""
    out = profile.ecdf(df, column)
    n, unique = out.agg(F.sum("n"), F.count("*")).first()
    return out if ogive_fits(n or 0, unique) else out.limit(0)


def scatter_3d(df: DataFrame, x: str, y: str, z: str, row_id: str, points: int = 10_000) -> DataFrame:
    """At most ``points`` evenly spaced points in three columns; none with fewer than four."""
    clean = df.select(row_id, finite(x).alias("x"), finite(y).alias("y"), finite(z).alias("z")).dropna()
    if clean.limit(4).count() < 4:
        return clean.select("x", "y", "z").limit(0)
    return evenly(clean, points, row_id).select("x", "y", "z")


def multi_line(df: DataFrame, axis: str, columns: list[str], points: int = 400) -> DataFrame:
    """(series, x, y): means of several columns in the same even ranges of the axis, a line each."""
    from .temporal import on_axis

    at = on_axis(df, axis)
    low, high = df.agg(F.min(at), F.max(at)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "series string, x double, y double")
    width = (high - low) / points or 1.0
    place = F.least(F.lit(points - 1), F.floor((F.col("x") - low) / width))
    series = F.explode(F.array(*[F.struct(F.lit(c).alias("series"), finite(c).alias("y")) for c in columns])).alias("s")
    long = df.select(at.alias("x"), series).select("x", "s.*").where("x is not null and y is not null")
    return long.groupBy("series", place.alias("place")).agg(F.avg("y").alias("y")).select("series", (low + (F.col("place") + 0.5) * width).alias("x"), "y")


def faceted_scatter(df: DataFrame, x: str, y: str, facet: str, key: str, facets: int = 6, points: int = 3000, least: int = 8) -> DataFrame:
    """(facet, x, y) of the largest facets of ``least`` points or more, each thinned to about ``points`` by a
    hash of the key; none with fewer than two such facets."""
    rows = df.select(F.trim(F.col(facet).cast("string")).alias("facet"), finite(x).alias("x"), finite(y).alias("y"), F.col(key).alias("k")).where("facet <> '' and x is not null and y is not null")
    sizes = rows.groupBy("facet").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "facet").limit(max(2, facets)).collect()
    if len(sizes) < 2:
        return rows.select("facet", "x", "y").limit(0)
    kept = df.sparkSession.createDataFrame([(r["facet"], max(1, -(-r["n"] // points))) for r in sizes], "facet string, step long")
    thinned = rows.join(F.broadcast(kept), "facet").where(F.pmod(F.xxhash64("k"), F.col("step")) == 0)
    return thinned.select("facet", "x", "y")

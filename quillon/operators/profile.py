"""Univariate profiles: one wide aggregate over all columns, reshaped to a row a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import tokens
from . import quantiles

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType))]


finite = quantiles.number


def sample_skewness(v: Column) -> Column:
    """Bias-corrected G1; 0 with fewer than three values or no spread."""
    n = F.count(v)
    return F.when((n > 2) & (F.stddev_pop(v) > 0), F.skewness(v) * F.sqrt(n * (n - 1.0)) / (n - 2)).otherwise(0.0)


def sample_kurtosis(v: Column) -> Column:
    """Bias-corrected excess G2; 0 with fewer than four values or no spread."""
    n = F.count(v)
    return F.when((n > 3) & (F.stddev_pop(v) > 0), (n - 1.0) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6)).otherwise(0.0)


def _long(wide: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """One row a column from one wide row whose cells are structs."""
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("s")) for c in columns])).alias("x")).select("x.column_name", *[F.col(f"x.s.{f}").alias(f) for f in fields])


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, variance, stddev, skewness, kurtosis, min, max, sum, nonzero, quantiles,
    geometric and harmonic means of each column's finite values, in one pass beside that of the quantiles."""
    cells, fields, cuts = [], [], quantiles.exact_quantiles(df, columns, PROBS)
    for c in columns:
        v = finite(c)
        n = F.count(v)
        q = [F.lit(cuts[c][p]).cast("double") for p in PROBS]
        positive = F.min(v) > 0
        safe = F.when(v > 0, v)
        values = {
            "n": n,
            "mean": F.avg(v),
            "variance": F.when(n > 1, F.var_samp(v)).otherwise(0.0),
            "stddev": F.when(n > 1, F.stddev_samp(v)).otherwise(0.0),
            "skewness": sample_skewness(v),
            "kurtosis": sample_kurtosis(v),
            "min": F.min(v),
            "max": F.max(v),
            "value_range": F.max(v) - F.min(v),
            "total": F.sum(v),
            "nonzero": F.count(F.when(F.abs(v) > 1e-12, 1)),
            "p05": q[0], "q1": q[1], "median": q[2], "q3": q[3], "p95": q[4],
            "iqr": q[3] - q[1],
            "geometric_mean": F.when(positive, F.exp(F.avg(F.ln(safe)))).otherwise(0.0),
            "harmonic_mean": F.when(positive, n / F.sum(1 / safe)).otherwise(0.0),
            "cv": F.when(F.abs(F.avg(v)) > 1e-12, F.when(n > 1, F.stddev_samp(v)).otherwise(0.0) / F.abs(F.avg(v))).otherwise(0.0),
            "missing": F.count("*") - n,
        }
        fields = list(values)
        cells.append(F.struct(*[x.alias(k) for k, x in values.items()]).alias(c))
    return _long(df.agg(*cells), columns, fields)


def mad(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median absolute deviation from the median, unscaled."""
    found = deviations(df, columns, quantiles.medians(df, columns))
    return df.sparkSession.createDataFrame([(c, found[c]) for c in columns], "column_name string, mad double")


def deviations(df: DataFrame, columns: list[str], centres: dict[str, float | None]) -> dict[str, float | None]:
    """Medians of the absolute deviations from a centre."""
    return quantiles.medians(df, {c: F.abs(finite(c) - F.lit(centres[c]).cast("double")) for c in columns})


def trimmed_mean(df: DataFrame, columns: list[str], share: float = 0.1) -> DataFrame:
    """Mean without floor(share * n) values at each end.

    Two order statistics bound what is kept; values strictly between them all count, and of those
    equal to a bound as many as the trim leaves. So it is selections and sums, not a ranking.
    """
    sizes = df.agg(*[F.count(finite(c)).alias(c) for c in columns]).first()
    cells = []
    for c in columns:
        n, v = sizes[c], finite(c)
        if not n:
            cells.append(F.struct(F.lit(None).cast("double").alias("trimmed_mean"), F.lit(0).cast("long").alias("n_kept")).alias(c))
            continue
        k = int(n * share)
        found = quantiles.order_statistics(df.select(v.alias(c)), c, sorted({k, n - 1 - k}), n)
        lo, hi, kept = found[k], found[n - 1 - k], n - 2 * k
        between = F.coalesce(F.sum(F.when((v > lo) & (v < hi), v)), F.lit(0.0))
        ends = F.lit(lo) * (F.count(F.when(v <= lo, 1)) - k) + F.lit(hi) * (F.count(F.when(v >= hi, 1)) - k)
        mean = F.lit(lo) if lo == hi else (between + ends) / kept
        cells.append(F.struct(mean.cast("double").alias("trimmed_mean"), F.lit(kept).cast("long").alias("n_kept")).alias(c))
    return _long(df.agg(F.count("*").alias("__n"), *cells), columns, ["trimmed_mean", "n_kept"])


def rounded_mode(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """The most frequent value after rounding; the smallest of ties. Null for a column without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(finite(c), digits).alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column_name", "v").agg(F.count("v").alias("n"))
    return counts.groupBy("column_name").agg(F.max(F.struct("n", (-F.col("v")).alias("v")))["v"].alias("v")).select("column_name", (0.0 - F.col("v")).alias("mode_value"))


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """The full summary: moments with MAD, trimmed mean and mode."""
    out = moments(df, columns)
    for more in (mad(df, columns), trimmed_mean(df, columns), rounded_mode(df, columns)):
        out = out.join(F.broadcast(more), "column_name")
    return out


def category_counts(df: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """Most frequent values of each column with their share; ties by value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("column_name"))
    return counts.withColumn("share", share).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def token_counts(df: DataFrame, column: str, separator: str, top: int = 8) -> DataFrame:
    """Rows that hold each token of a multi-select column."""
    each = df.select(F.explode(tokens(F.col(column), separator)).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def datetime_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.min(F.unix_timestamp(c)).alias("first_second"), F.max(F.unix_timestamp(c)).alias("last_second"), (F.max(F.unix_timestamp(c)) - F.min(F.unix_timestamp(c))).alias("range_seconds")).alias(c) for c in columns]
    return _long(df.agg(*cells), columns, ["first_second", "last_second", "range_seconds"])


def distinct_counts(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Exact distinct counts; numbers are rounded first."""
    numeric = set(numeric_columns(df))
    cells = [F.struct(F.count_distinct(F.round(finite(c), digits) if c in numeric else F.col(c)).alias("distinct_values")).alias(c) for c in columns]
    return _long(df.agg(*cells), columns, ["distinct_values"])


def approx_distinct_counts(df: DataFrame, columns: list[str], error: float = 0.02) -> DataFrame:
    """HyperLogLog counts, where exact ones would shuffle every value."""
    cells = [F.struct(F.approx_count_distinct(c, error).alias("distinct_values")).alias(c) for c in columns]
    return _long(df.agg(*cells), columns, ["distinct_values"])


def quality_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing cells and their ratio, a row a column."""
    cells = [F.struct(F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("missing"), (F.count_if(F.col(c).isNull()) / F.count("*")).alias("missing_ratio")).alias(c) for c in columns]
    return _long(df.agg(*cells), columns, ["n_rows", "missing", "missing_ratio"])


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shannon entropy of value counts over log2 of their number; 0 with fewer than two values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("column_name"))
    levels = counts.withColumn("p", p).groupBy("column_name").agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"), F.count("*").alias("levels"))
    return levels.select("column_name", "levels", F.when(F.col("levels") > 1, F.col("bits") / F.log2("levels")).otherwise(0.0).alias("entropy"))


def surprise(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """Columns ordered by how unusual they look: skew, kurtosis, spread and outlier rate. Above 16
    columns the first min(10, max(6, sqrt(rows))) stay."""
    base = moments(df, columns)
    fences = {r["column_name"]: (r["q1"] - multiplier * r["iqr"], r["q3"] + multiplier * r["iqr"]) for r in base.select("column_name", "q1", "q3", "iqr").collect()}
    cells = [F.struct((F.count(F.when((finite(c) < fences[c][0]) | (finite(c) > fences[c][1]), 1)) / F.count(finite(c))).alias("outlier_rate")).alias(c) for c in columns]
    rates = _long(df.agg(*cells), columns, ["outlier_rate"])
    value = 0.45 * F.abs("skewness") + 0.25 * F.log1p(F.abs("kurtosis")) + 0.20 * F.log1p("stddev") + 0.10 * 10 * F.col("outlier_rate")
    ranked = base.join(F.broadcast(rates), "column_name").select("column_name", "skewness", "kurtosis", "stddev", "outlier_rate", value.alias("surprise")).orderBy(F.desc("surprise"), "column_name")
    if len(columns) > 16:
        ranked = ranked.limit(min(10, max(6, int(len(columns) ** 0.5))))
    return ranked


def bin_count(n: int, low: float, high: float, iqr: float, sd: float) -> int:
    """Sturges where the span is 120 times the spread or more, else Freedman-Diaconis, else Scott;
    5 to 96 bins."""
    span = high - low
    sturges = max(5, min(96, math.ceil(math.log2(max(2, n)) + 1)))
    if n < 2 or span <= 1e-12:
        return 5
    if n >= 8 and span / max(sd, iqr, 1e-12) >= 120:
        return sturges
    width = 2 * iqr * n ** (-1 / 3) if iqr > 1e-12 else 3.5 * sd * n ** (-1 / 3) if sd > 1e-12 else 0.0
    return max(5, min(96, math.ceil(span / width))) if width > 0 else sturges


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Counts in equal-width bins; the last one is closed."""
    v = finite(column)
    s = df.agg(F.count(v), F.min(v), F.max(v), F.stddev_samp(v)).first()
    if not s[0]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    q = None if bins else quantiles.exact_quantiles(df, [column], [0.25, 0.75])[column]
    k = bins or bin_count(s[0], s[1], s[2], q[0.75] - q[0.25], s[3] or 0.0)
    width = (s[2] - s[1]) / k or 1.0
    number = F.least(F.lit(k - 1), F.floor((F.col("v") - s[1]) / width)).cast("int")
    counts = df.select(v.alias("v")).where("v is not null").groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (s[1] + F.col("bin") * width).alias("low"), (s[1] + (F.col("bin") + 1) * width).alias("high"), "n")


def kde(df: DataFrame, column: str, points: int = 160, bins: int = 1 << 16) -> DataFrame:
    """Gaussian kernel density on an even grid, from 80 values on.

    Rows become counts and means of ``bins`` narrow bins, which the grid's side then sums over. A bin of width w
    changes its part of the density by less than (w / h)^2 / 8 of the kernel's peak, h the bandwidth; columns with
    fewer distinct values than bins are exact.
    """
    v = finite(column)
    n, low, high, sd = df.agg(F.count(v), F.min(v), F.max(v), F.stddev_samp(v)).first()
    q = quantiles.exact_quantiles(df, [column], [0.25, 0.75])[column] if n >= 80 and sd else None
    spread = min(x for x in (sd, (q[0.75] - q[0.25]) / 1.34) if x > 0) if q else 0.0
    if n < 80 or spread <= 0:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = 1.06 * spread * n**-0.2
    step = (high - low) / (points - 1)
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins))
    narrow = df.select(v.alias("v")).where("v is not null").groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("m"))
    grid = [low + i * step for i in range(points)]
    # One aggregate with a sum a grid point: no row is multiplied.
    row = narrow.agg(*[F.sum(F.col("n") * F.exp(-0.5 * ((F.col("m") - x) / h) ** 2)).alias(f"g{i}") for i, x in enumerate(grid)])
    cells = F.array(*[F.struct(F.lit(x).alias("x"), (F.col(f"g{i}") / (n * h * math.sqrt(2 * math.pi))).alias("density")) for i, x in enumerate(grid)])
    return row.select(F.explode(cells).alias("p")).select("p.*")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Cumulative per cent at each distinct value. Buckets of even depth are summed first, so ranking
    stays inside a bucket and only their bounded table is ordered in one task."""
    counts = running_counts(df, finite(column))
    total = df.agg(F.count(finite(column))).first()[0]
    return counts.select("v", "n", (100.0 * F.col("upto") / max(1, total)).alias("percent"))


def running_counts(df: DataFrame, value: Column, cuts: list[float] | None = None) -> DataFrame:
    """(v, n, upto): each distinct value, its rows, and the rows up to it in order of value. ``cuts`` are
    those of :func:`quantiles.even_cuts`, if they are known."""
    values = df.select(value.alias("v")).where("v is not null")
    cuts = quantiles.even_cuts(values, F.col("v")) if cuts is None else cuts
    counts = quantiles.with_bucket(values.groupBy("v").agg(F.count("*").alias("n")), F.col("v"), cuts, "bucket")
    heads = quantiles.with_bucket(values, F.col("v"), cuts, "bucket").groupBy("bucket").agg(F.count("*").alias("here"))
    # one row a bucket: the only window without a key
    starts = heads.select("bucket", (F.sum("here").over(Window.orderBy("bucket")) - F.col("here")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("bucket").orderBy("v"))
    return counts.select("v", "n", inside.alias("inside"), "bucket").join(F.broadcast(starts), "bucket").select("v", "n", (F.col("before") + F.col("inside")).alias("upto"))


def qq_points(df: DataFrame, column: str, points: int = 100, family: str = "normal") -> DataFrame:
    """Theoretical and sample quantiles at (i + 0.5) / points."""
    from ..functions.special import probit

    v = finite(column)
    mean, sd = df.agg(F.avg(v), F.stddev_samp(v)).first()
    probs = [(i + 0.5) / points for i in range(points)]
    sample = quantiles.exact_quantiles(df, [column], probs)[column]
    theory = (lambda p: mean + (sd or 0.0) * probit(p)) if family == "normal" else (lambda p: -(mean or 0.0) * math.log1p(-p))
    rows = [(p, float(theory(p)), float(sample[p])) for p in probs if sample[p] is not None]
    return df.sparkSession.createDataFrame(rows, "p double, theoretical double, sample double")


def bootstrap_mean_ci(df: DataFrame, column: str, key: str, rounds: int = 300, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by the Poisson bootstrap: each row draws a weight a round
    from a hash of its key. Sums are combined before the shuffle, so what moves is a row a round and task."""
    each = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")
    rows = df.select(finite(column).alias("v"), F.col(key).alias("k")).where("v is not null").select("v", "k", each)
    u = (F.xxhash64("k", F.lit(seed), "round") % (1 << 30) + (1 << 30)) / float(1 << 31)
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    w = F.lit(8)
    for k in range(7, -1, -1):
        w = F.when(F.col("u") < cuts[k], k).otherwise(w)
    drawn = rows.select("v", "round", u.alias("u")).select("v", "round", w.alias("w"))
    means = drawn.groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    q = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))  # of one value a round
    return means.agg(F.avg("m").alias("mean"), q[0].alias("low"), q[1].alias("high"))


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def health_score(cells: int, missing: int, columns: int, numeric: int, retained: int, pairs: int, significant: int, selected: int, stability: float, psi_mean: float = 0.0, band: str = "stable") -> tuple[float, str]:
    """Weighted data-health score (0 to 100) and its band. Yields are logarithmic, against a quarter
    and a tenth of the pairs; drift takes a share of the score away."""
    c = lambda x: min(1.0, max(0.0, x))
    found = lambda k, part: c(share(math.log1p(k), math.log1p(max(1, pairs // part)))) if pairs else 0.0
    score = 0.30 * (1 - share(missing, max(1, cells))) + 0.10 * share(numeric, max(1, columns)) + 0.15 * share(retained, numeric - 1 if numeric else 0) + 0.20 * found(significant, 4) + 0.15 * found(selected, 10) + 0.10 * stability
    penalty = {"critical": 0.08, "warning": 0.03}.get(band, 0.0)
    penalty += min(0.20, (psi_mean - 0.10) * 0.20) if psi_mean > 0.10 else 0.0
    penalty += min(0.30, 0.12 + (psi_mean - 0.50) * 0.35) if psi_mean > 0.50 else 0.0
    value = 100 * c(score * (1 - min(0.55, penalty)))
    return value, next((b for limit, b in ((85, "excellent"), (70, "strong"), (55, "moderate"), (40, "weak")) if value >= limit), "limited")

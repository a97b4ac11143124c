"""Outlier rules and what to do with flagged cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .profile import deviations, finite, running_counts

METHODS = ("iqr", "zscore", "modified_z", "adjusted_boxplot", "lof")
ACTIONS = ("flag", "remove", "cap")


def fences(df: DataFrame, columns: list[str], method: str = "iqr", multiplier: float = 1.5, z: float = 3.0) -> dict[str, tuple[float, float] | None]:
    """Inclusive inlier limits of each column, or None where it has too few values or no spread.

    Every rule but LOF is an interval, so detection is a predicate on the row.
    """
    row = df.agg(*[F.struct(F.count(finite(c)).alias("n"), F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s")).alias(c) for c in columns]).first()
    cuts = {} if method == "zscore" else quantiles.exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    out: dict[str, tuple[float, float] | None] = {}
    med_dev = deviations(df, columns, {c: cuts[c][0.5] for c in columns}) if method == "modified_z" else {}
    for c in columns:
        n, m, s, q = row[c]["n"], row[c]["m"], row[c]["s"], list(cuts[c].values()) if cuts else None
        out[c] = None
        if method == "iqr" and n >= 4:
            r = q[2] - q[0]
            out[c] = (q[0] - multiplier * r, q[2] + multiplier * r)
        elif method == "zscore" and n >= 3 and s and s > 1e-12:
            out[c] = (m - z * s, m + z * s)
        elif method == "modified_z" and n >= 4 and med_dev[c] and med_dev[c] > 1e-12:
            reach = z * med_dev[c] / 0.6745
            out[c] = (q[1] - reach, q[1] + reach)
        elif method == "adjusted_boxplot" and n >= 8:
            import math

            r = q[2] - q[0]
            if r > 1e-12:
                bowley = (q[2] + q[0] - 2 * q[1]) / r
                out[c] = (q[0] - multiplier * math.exp(-4 * bowley) * r, q[2] + multiplier * math.exp(3 * bowley) * r)
    return out


def outside(column: str, limits: tuple[float, float] | None) -> Column:
    v = finite(column)
    return F.lit(False) if limits is None else F.coalesce((v < limits[0]) | (v > limits[1]), F.lit(False))


def flag(df: DataFrame, columns: list[str], method: str = "iqr", **knobs) -> DataFrame:
    """Adds <column>_outlier for each column."""
    limits = fences(df, columns, method, **knobs)
    return df.withColumns({f"{c}_outlier": outside(c, limits[c]) for c in columns})


def counts(df: DataFrame, columns: list[str], method: str = "iqr", **knobs) -> DataFrame:
    limits = fences(df, columns, method, **knobs)
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(limits[c][0] if limits[c] else None).cast("double").alias("low"), F.lit(limits[c][1] if limits[c] else None).cast("double").alias("high"), F.col(f"`{c}`").alias("outliers")) for c in columns]
    return df.agg(*[F.count_if(outside(c, limits[c])).alias(c) for c in columns]).select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def remove(df: DataFrame, columns: list[str], method: str = "iqr", **knobs) -> DataFrame:
    """Without rows that any column flags."""
    limits = fences(df, columns, method, **knobs)
    keep = F.lit(True)
    for c in columns:
        keep = keep & ~outside(c, limits[c])
    return df.where(keep)


def cap(df: DataFrame, columns: list[str], method: str = "iqr", **knobs) -> DataFrame:
    """Outliers moved to the least and greatest inlier of their column."""
    limits = fences(df, columns, method, **knobs)
    used = [c for c in columns if limits[c]]
    if not used:
        return df
    ends = df.agg(*[F.struct(F.min(F.when(~outside(c, limits[c]), finite(c))).alias("lo"), F.max(F.when(~outside(c, limits[c]), finite(c))).alias("hi")).alias(c) for c in used]).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(ends[c]["lo"]), F.least(F.col(c).cast("double"), F.lit(ends[c]["hi"])))) for c in used})


def lof(df: DataFrame, column: str, key: str, k: int = 20, threshold: float = 1.5) -> DataFrame:
    """(key, lof, outlier): local outlier factor on one axis with k = min(k, n - 1) neighbours.

    On a sorted axis the k nearest are among the k before and the k after. Equal values share a
    result, so the axis holds distinct values with their counts; it is cut into ranges that overlap
    by 3k values (neighbours of neighbours of neighbours), each worked on alone. Points whose
    neighbours are all at distance zero are never flagged.
    """
    import pandas as pd

    v = finite(column)
    n = df.agg(F.count(v)).first()[0]
    use = min(k, n - 1)
    if use < 1:
        return df.select(key, F.lit(None).cast("double").alias("lof"), F.lit(False).alias("outlier"))
    values = df.select(v.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ranks = _ranked(values)
    block, reach = 100_000, 3 * use
    home = F.floor(F.col("r") / block)
    near = F.explode(F.array_distinct(F.array(home, F.floor(F.greatest(F.lit(0), F.col("r") - reach) / block), F.floor((F.col("r") + reach) / block)))).alias("block")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return local_outlier_factors(pdf, use, block)

    scored = ranks.select("v", "n", "r", near).groupBy("block").applyInPandas(work, "v double, lof double")
    return df.select(F.col(key), v.alias("v")).join(scored, "v", "left").select(key, "lof", (F.coalesce("lof", F.lit(0.0)) > threshold).alias("outlier"))


def _ranked(values: DataFrame) -> DataFrame:
    """Row numbers of distinct values in their order."""
    places = running_counts(values, F.col("v")).select("v", (F.col("upto") - 1).alias("r"))
    return values.join(places, "v").select("v", "n", "r")


def local_outlier_factors(pdf, k: int, block: int):
    """LOF of the block's own values, given its values and those next to it. Points are the values
    repeated as often as they occur, at most k + 1 times: further copies change no k-distance."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("v")
    here = int(pdf["block"].iloc[0])
    x = np.repeat(pdf["v"].to_numpy(), np.minimum(pdf["n"].to_numpy(), k + 1))
    m = len(x)
    kk = min(k, m - 1)
    if kk < 1:
        own = pdf[pdf["r"] // block == here]
        return pd.DataFrame({"v": own["v"], "lof": np.zeros(len(own))})
    at = np.arange(m)
    offsets = np.concatenate([np.arange(-kk, 0), np.arange(1, kk + 1)])
    idx = at[:, None] + offsets
    dist = np.where((idx >= 0) & (idx < m), np.abs(x[np.clip(idx, 0, m - 1)] - x[:, None]), np.inf)
    pick = np.argsort(dist, axis=1, kind="stable")[:, :kk]
    nn = np.take_along_axis(np.clip(idx, 0, m - 1), pick, axis=1)
    d = np.take_along_axis(dist, pick, axis=1)
    kdist = d[:, -1]
    reach = np.maximum(d, kdist[nn]).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = np.where(reach > 0, 1 / reach, np.inf)
        ratio = np.where(np.isfinite(density), np.where(np.isfinite(density[nn]), density[nn], 0).mean(axis=1) / density, 0.0)
    first = np.unique(x, return_index=True)
    scores = dict(zip(first[0].tolist(), ratio[first[1]].tolist(), strict=True))
    own = pdf[pdf["r"] // block == here]
    return pd.DataFrame({"v": own["v"], "lof": [scores[a] for a in own["v"]]})


def mahalanobis(df: DataFrame, columns: list[str], key: str, quantile: float = 0.975, top: int = 6) -> DataFrame:
    """The rows farthest from the mean in units of the covariance, above the empirical quantile.

    The covariance comes from one aggregate; d^2 is a row expression; only ``top`` rows are ordered.
    """
    import numpy as np

    from .moments import gram

    g = gram(df, columns)
    if g.n <= len(columns) + 1:
        return df.select(key, F.lit(0.0).alias("d2"), F.lit(0.0).alias("threshold")).limit(0)
    inverse = np.linalg.pinv(g.covariance())
    dev = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(columns, g.mean, strict=True)]
    d2 = sum((dev[i] * dev[j] * float(inverse[i, j]) for i in range(len(columns)) for j in range(len(columns))), F.lit(0.0))
    scored = df.select(F.col(key), d2.alias("d2")).where("d2 is not null")
    limit = quantiles.exact_quantiles(scored, ["d2"], [quantile])["d2"][quantile]
    return scored.where(F.col("d2") >= F.lit(limit)).orderBy(F.desc("d2"), key).limit(top).withColumn("threshold", F.lit(limit))


def outlier_context(df: DataFrame, segment: str, columns: list[str], key: str, method: str = "iqr", rows: int = 8, least: int = 12) -> DataFrame:
    """Flagged rows with how unusual they are inside their segment: the column with the largest
    conditional |z| and how many others reach 1.5; the first ``rows`` in key order."""
    flagged = flag(df, columns, method)
    any_flag = F.lit(False)
    for c in columns:
        any_flag = any_flag | F.col(f"{c}_outlier")
    stats = df.groupBy(segment).agg(F.count("*").alias("__n"), *[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"__s_{c}") for c in columns]).where(F.col("__n") >= least)
    joined = flagged.where(any_flag).join(stats, segment)  # a row a segment: the planner broadcasts it if it is small
    zs = F.array(*[F.struct(F.abs(F.coalesce((F.col(c) - F.col(f"__m_{c}")) / F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(0.0))).alias("z"), F.lit(c).alias("c")) for c in columns])
    ordered = F.sort_array(zs, asc=False)
    return joined.select(
        key, F.col(segment).alias("segment"), ordered[0]["c"].alias("strongest"), ordered[0]["z"].alias("abs_z"), (F.size(F.filter(ordered, lambda x: x["z"] >= 1.5)) - F.when(ordered[0]["z"] >= 1.5, 1).otherwise(0)).alias("others"),
    ).orderBy(key).limit(rows)

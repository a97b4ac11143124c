"""Imputation. After it no cell is null, except where a column has no value at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .moments import gram
from .profile import datetime_columns, finite, numeric_columns
from .quantiles import medians

# Strategies by type.
STRATEGIES = {
    "numeric": {"auto", "mean", "median", "zero", "interpolate", "knn", "mice", "matrix_completion"},
    "categorical": {"auto", "mode"},
    "datetime": {"auto", "interpolate"},
}

#: Rows of an interpolation block: bounds what one task orders.
BLOCK_ROWS = 1_000_000


def check_strategy(kind: str, strategy: str) -> str:
    if strategy not in STRATEGIES[kind]:
        raise ConfigurationError(f"strategy {strategy!r} does not apply to a {kind} column; use one of {sorted(STRATEGIES[kind])}")
    return strategy


def numeric(df: DataFrame, columns: list[str], strategy: str = "auto") -> DataFrame:
    """Nulls replaced by the mean (also auto), the median or zero."""
    check_strategy("numeric", strategy)
    if strategy == "zero":
        fill = dict.fromkeys(columns, 0.0)
    elif strategy == "median":
        fill = medians(df, columns)
    else:
        fill = df.agg(*[F.avg(finite(c)).alias(c) for c in columns]).first().asDict()
    return df.withColumns({c: F.coalesce(finite(c), F.lit(fill[c])) for c in columns})


def categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the most frequent value, the least of ties; "Unknown" in an empty column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count("*").alias("n"))
    top = counts.groupBy("c").agg(F.max("n").alias("n")).withColumnsRenamed({"c": "__c", "n": "__n"})
    best = counts.join(F.broadcast(top), (F.col("c") == F.col("__c")) & (F.col("n") == F.col("__n"))).groupBy("c").agg(F.min("v").alias("v"))
    fill = dict.fromkeys(columns) | {r["c"]: r["v"] for r in best.collect()}
    return df.withColumns({c: F.coalesce(c, F.lit(fill[c] if fill[c] is not None else "Unknown")) for c in columns})


def interpolate(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """Linear between the neighbouring known values in row order, the nearest known one at the ends.

    Rows are cut into blocks of ``row_id``; windows run inside a block, and the last and first known
    values of blocks are carried over by a small table with a row a block.
    """
    times = set(datetime_columns(df))
    value = {c: (F.unix_timestamp(c).cast("double") if c in times else finite(c)) for c in columns}
    work = df.withColumn("__block", F.floor(F.col(row_id) / BLOCK_ROWS))
    known = {c: F.when(value[c].isNotNull(), F.struct(F.col(row_id).cast("double").alias("x"), value[c].alias("y"))) for c in columns}
    ends = work.groupBy("__block").agg(*[F.max_by(known[c], F.when(known[c].isNotNull(), F.col(row_id))).alias(f"__l_{c}") for c in columns], *[F.min_by(known[c], F.when(known[c].isNotNull(), F.col(row_id))).alias(f"__f_{c}") for c in columns])
    order = Window.orderBy("__block")
    carry = ends.select(
        "__block",
        *[F.last(f"__l_{c}", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__p_{c}") for c in columns],
        *[F.last(f"__f_{c}", True).over(Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)).alias(f"__n_{c}") for c in columns],
    )
    # Both run from the frame's start to the current row, which costs one step a row.
    back = Window.partitionBy("__block").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("__block").orderBy(F.desc(row_id)).rowsBetween(Window.unboundedPreceding, 0)
    joined = work.join(carry, "__block", "left")
    found = {}
    for c in columns:
        p = F.coalesce(F.last(known[c], True).over(back), F.col(f"__p_{c}"))
        n = F.coalesce(F.last(known[c], True).over(ahead), F.col(f"__n_{c}"))
        found[f"__a_{c}"], found[f"__b_{c}"] = p, n
    joined = joined.withColumns(found)

    def filled(c: str) -> Column:
        a, b = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        between = a["y"] + (b["y"] - a["y"]) * (F.col(row_id) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
        v = F.coalesce(value[c], between, a["y"], b["y"])
        return F.timestamp_seconds(F.floor(v)) if c in times else v

    return joined.withColumns({c: filled(c) for c in columns}).select(*df.columns)


def matrix_completion(df: DataFrame, columns: list[str]) -> DataFrame:
    """Half the column's mean and half the mean of the row's known numbers."""
    means = df.agg(*[F.avg(finite(c)).alias(c) for c in columns]).first()
    known = F.filter(F.array(*[finite(c) for c in columns]), lambda x: x.isNotNull())
    row_mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    tagged = df.withColumn("__row_mean", row_mean)
    return tagged.withColumns({c: F.coalesce(finite(c), 0.5 * F.lit(means[c]) + 0.5 * F.coalesce("__row_mean", F.lit(means[c]))) for c in columns}).select(*df.columns)


def mice(df: DataFrame, columns: list[str], predictors: int = 4) -> DataFrame:
    """One pass of regressions: each column on its up to four most correlated others, fitted on
    complete rows; rows whose predictors are null too get the mean."""
    import numpy as np

    means = df.agg(*[F.avg(finite(c)).alias(c) for c in columns]).first()
    g = gram(df, columns)
    r = np.abs(g.correlation())
    out = {}
    for i, c in enumerate(columns):
        chosen = [columns[j] for j in np.argsort(-r[i], kind="stable") if j != i and r[i, j] > 0][:predictors]
        fit = None
        if chosen and g.n >= max(12, len(chosen) + 8):
            sub = g.pick([*chosen, c])
            xx, xy = sub.cross[:-1, :-1], sub.cross[:-1, -1]
            if np.linalg.matrix_rank(xx) == len(chosen):
                beta = np.linalg.solve(xx, xy)
                fit = sum((F.lit(float(b)) * finite(x) for b, x in zip(beta, chosen, strict=True)), F.lit(float(sub.mean[-1] - beta @ sub.mean[:-1])))
        out[c] = F.coalesce(finite(c), *([fit] if fit is not None else []), F.lit(means[c]))
    return df.withColumns(out)


#: Rows of a block of known rows and of a block of rows to fill.
KNOWN_ROWS, HOLE_ROWS = 50_000, 5_000


def knn(df: DataFrame, column: str, others: list[str], key: str, k: int = 5) -> DataFrame:
    """Nulls of ``column`` from the k nearest of all rows that have it, weighted by inverse distance.

    Distance is the root mean square over the standardised columns both rows have, to twelve digits; ties
    go by key. Rows with a null meet the known rows block by block and keep their k best of each, so a
    task holds two blocks; the work is their product.
    """
    import pandas as pd

    row = df.agg(F.count(finite(column)).alias("__known"), F.count("*").alias("__all"), *[F.struct(F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s")).alias(c) for c in [*others, column]]).first()
    if not row["__known"] or row["__known"] == row["__all"]:
        return df
    scaled = [((finite(c) - F.lit(row[c]["m"])) / F.lit(row[c]["s"] or 1.0)).alias(f"x{i}") for i, c in enumerate(others)]
    known_blocks = -(-row["__known"] // KNOWN_ROWS)
    hole_blocks = -(-(row["__all"] - row["__known"]) // HOLE_ROWS)
    block = lambda n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    known = df.where(finite(column).isNotNull()).select(F.col(key).alias("k"), finite(column).alias("y"), *scaled, block(known_blocks).alias("kb"), every(hole_blocks, "hb"))
    holes = df.where(finite(column).isNull()).select(F.col(key).alias("k"), *scaled, block(hole_blocks).alias("hb"), every(known_blocks, "kb"))
    kind = df.schema[key].dataType.simpleString()
    names = [f"x{i}" for i in range(len(others))]

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return nearest(left, right, names, k)

    found = known.groupBy("kb", "hb").cogroup(holes.groupBy("kb", "hb")).applyInPandas(work, f"k {kind}, d double, near {kind}, y double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d", "near", "y"))), 1, k)  # k rows a block of known rows
    weight = F.transform("best", lambda x: 1 / F.greatest(x["d"], F.lit(1e-9)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    filled = total(F.zip_with("best", weight, lambda x, w: x["y"] * w)) / total(weight)
    fills = found.groupBy(F.col("k").alias("__k")).agg(best.alias("best")).select("__k", filled.alias("__fill"))
    return df.join(fills, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce(finite(column), "__fill", F.lit(row[column]["m"]))).select(*df.columns)


def nearest(known, holes, names: list[str], k: int, chunk: int = 64):
    """The k nearest known rows of each hole, by (distance, key)."""
    import numpy as np
    import pandas as pd

    known = known.sort_values("k")
    ref, y, keys = known[names].to_numpy(float), known["y"].to_numpy(float), known["k"].to_numpy()
    out: dict[str, list] = {"k": [], "d": [], "near": [], "y": []}
    for start in range(0, len(holes) if len(known) else 0, chunk):
        x = holes[names].to_numpy(float)[start : start + chunk]
        d, n = np.zeros((len(x), len(ref))), np.zeros((len(x), len(ref)))
        for j in range(len(names)):
            gap = x[:, j, None] - ref[None, :, j]
            both = ~np.isnan(gap)
            n += both
            d += np.where(both, gap * gap, 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(n > 0, np.round(np.sqrt(d / n), 12), np.inf)
        for i, hole in enumerate(holes["k"].to_numpy()[start : start + chunk]):
            limit = np.partition(d[i], min(k, len(ref)) - 1)[min(k, len(ref)) - 1]
            near = np.flatnonzero((d[i] <= limit) & np.isfinite(d[i]))
            near = near[np.lexsort((near, d[i][near]))][:k]
            for name, values in (("k", [hole] * len(near)), ("d", d[i][near]), ("near", keys[near]), ("y", y[near])):
                out[name].extend(values)
    return pd.DataFrame(out)


def run(df: DataFrame, strategies: dict[str, str], row_id: str | None = None) -> DataFrame:
    """Apply a strategy a column; columns of one strategy share a pass."""
    numbers, times = set(numeric_columns(df)), set(datetime_columns(df))
    groups: dict[tuple[str, str], list[str]] = {}
    for c, s in strategies.items():
        kind = "numeric" if c in numbers else "datetime" if c in times else "categorical"
        groups.setdefault((kind, check_strategy(kind, s)), []).append(c)
    for (kind, s), columns in groups.items():
        if kind == "categorical":
            df = categorical(df, columns)
        elif kind == "datetime" or s == "interpolate":
            if row_id is None:
                raise ConfigurationError("interpolation needs row_id")
            df = interpolate(df, columns, row_id)
        elif s == "matrix_completion":
            df = matrix_completion(df, columns)
        elif s == "mice":
            df = mice(df, [*columns, *[c for c in sorted(numbers) if c not in columns and c != row_id]])
        elif s == "knn":
            if row_id is None:
                raise ConfigurationError("knn needs row_id")
            for c in columns:
                df = knn(df, c, [x for x in sorted(numbers) if x not in (c, row_id)], row_id)
        else:
            df = numeric(df, columns, s)
    return df

"""Baseline models with cross-validation, clustering, drift and out-of-distribution checks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import algebra
from .moments import Gram, gram, merge
from .profile import finite
from .quantiles import exact_quantiles, nth_values


def folds(df: DataFrame, key: str, k: int = 5, label: str | None = None, seed: int = 42) -> DataFrame:
    """Adds fold: by a seeded hash of the key, within each value of ``label`` if one is given.

    A hash needs no ordering; fold sizes are equal up to chance, which large tables make small.
    """
    parts = [F.col(key), F.lit(seed)] + ([F.col(label)] if label else [])
    return df.withColumn("fold", F.pmod(F.xxhash64(*parts), F.lit(k)).cast("int"))


def folded(df: DataFrame, columns: list[str], key: str, k: int, seed: int, fold: str | None) -> DataFrame:
    """The columns with a fold: the one given, or by a hash of the key."""
    return df.select(key, *columns, F.col(fold).cast("int").alias("fold")) if fold else folds(df.select(key, *columns), key, k, seed=seed)


def stratifiable(df: DataFrame, label: str) -> bool:
    """Few integer classes and at least 20 rows."""
    n, classes, whole = df.agg(F.count("*"), F.approx_count_distinct(label), F.min(F.when(finite(label) == F.floor(finite(label)), 1).otherwise(0))).first()
    return bool(n >= 20 and whole and classes <= min(20, n // 8))


def cross_validated(df: DataFrame, features: list[str], target: str, key: str, k: int = 5, ridge: float = 1e-6, label: str = "linear", seed: int = 42, fold: str | None = None) -> DataFrame:
    """Pooled RMSE and R^2 of (ridge) regression: one job for the statistics of all folds, k solves
    on the driver from total minus fold. The held-out error is a function of the fold's statistics."""
    per = gram(folded(df, [*features, target], key, k, seed, fold), [*features, target], fold="fold")
    total = merge([per[f] for f in sorted(per)])
    sse, n, sst = 0.0, 0, float(total.cross[-1, -1])
    for g in per.values():
        train = total - g
        s = train.stddev()
        # ridge acts on standardised features
        scaled = Gram(train.names, train.n, train.mean, train.cross)
        p = len(features)
        d = np.where(s[:p] > 0, s[:p], 1.0)
        xx = scaled.cross[:p, :p] / np.outer(d, d)
        slopes = np.linalg.solve(xx + ridge * np.eye(p), scaled.cross[:p, p] / d) / d if train.n > p + 1 else np.zeros(p)
        gap = (g.mean[p] - train.mean[p]) - slopes @ (g.mean[:p] - train.mean[:p])
        c = g.cross
        sse += float(c[p, p] - 2 * slopes @ c[:p, p] + slopes @ c[:p, :p] @ slopes) + g.n * float(gap) ** 2
        n += g.n
    rmse = math.sqrt(max(0.0, sse) / n) if n else 0.0
    return df.sparkSession.createDataFrame([(label, n, rmse, 1 - sse / sst if sst > 0 else 0.0)], "model string, n long, rmse double, r2 double")


def upper_medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The value at place n // 2 of each column's finite values."""
    sizes = df.agg(*[F.count(finite(v)).alias(f"v{i}") for i, v in enumerate(columns.values())]).first()
    ranks = {c: [n // 2] if n else [] for c, n in zip(columns, sizes, strict=True)}
    found = nth_values(df, columns, ranks)
    return {c: next(iter(found[c].values()), None) for c in columns}


def split_predictions(data: DataFrame, features: list[str], target: str, medians: dict[tuple[int, str], float | None], bags: int = 1, weight: Callable[[Column], Column] | None = None) -> dict[tuple[int, int], float]:
    """(fold, sides) -> prediction, the mean over bags of one-split fits on the other folds. ``sides`` has two
    bits a feature: below or equal its median, above it, null.

    Rows enter only through the sides they are on of every fold's medians, so one aggregate serves all folds, features and
    bags; ``weight`` gives a row's weight in a bag.
    """
    ks = sorted({f for f, _ in medians})
    y, wide = finite(target), 2 * len(features)
    # one key from the sides of all folds where it fits a long, else one a fold
    keys = [sides(features, medians, f) for f in ks]
    packed = [sum((k * (1 << wide * j) for j, k in enumerate(keys)), F.lit(0).cast("long"))] if wide * len(ks) < 63 else keys
    names = [f"__s{j}" for j in range(len(packed))]
    rows = data.where(y.isNotNull()).select("*", y.alias("__y"), *[k.alias(n) for n, k in zip(names, packed, strict=True)])
    bag = F.explode(F.sequence(F.lit(0), F.lit(bags - 1))).alias("bag")
    drawn = rows.select("*", bag).withColumn("w", weight(F.col("bag")) if weight else F.lit(1.0)).where("w > 0")
    found = drawn.groupBy("bag", "fold", *names).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("__y")).alias("s"), F.sum(F.col("w") * F.col("__y") ** 2).alias("q")).collect()
    unpack = (lambda r: {f: r["__s0"] >> wide * j & ((1 << wide) - 1) for j, f in enumerate(ks)}) if len(packed) == 1 else (lambda r: {f: r[n] for f, n in zip(ks, names, strict=True)})
    sums = [{"bag": r["bag"], "fold": r["fold"], "n": r["n"], "s": r["s"], "q": r["q"], **{f"s{f}": v for f, v in unpack(r).items()}} for r in found]
    total: dict[tuple[int, int], float] = {}
    for f in ks:
        for b in range(bags):
            part = [r for r in sums if r["bag"] == b and r["fold"] != f]
            best = None
            for i in range(len(features)):
                halves = np.zeros((2, 3))
                for r in part:
                    side = r[f"s{f}"] >> 2 * i & 3
                    if side < 2:
                        halves[side] += (r["n"], r["s"], r["q"])
                if not halves[:, 0].all():
                    continue
                sse = float((halves[:, 2] - halves[:, 1] ** 2 / halves[:, 0]).sum())
                if best is None or sse < best[0]:
                    best = (sse, i, halves[:, 1] / halves[:, 0])
            if best:
                for code in {r[f"s{f}"] for r in sums if r["fold"] == f}:
                    total[f, code] = total.get((f, code), 0.0) + float(best[2][min(1, code >> 2 * best[1] & 3)]) / bags
    return total


def sides(features: list[str], medians: dict[tuple[int, str], float | None], f: int) -> Column:
    """Two bits a feature: 0 up to the median of fold ``f``, 1 above it, 2 where the value is null."""
    def side(c: str) -> Column:
        m = F.lit(medians[f, c]).cast("double")
        return F.when(finite(c) <= m, 0).when(finite(c) > m, 1).otherwise(2)

    return sum((side(c) * (1 << 2 * i) for i, c in enumerate(features)), F.lit(0)).cast("long")


def split_model(data: DataFrame, features: list[str], target: str, label: str, bags: int = 1, weight: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pooled errors of one-split fits at the upper medians of the training folds."""
    ks = sorted(r["fold"] for r in data.select("fold").distinct().collect())
    names = {f"f{f}_{i}": (f, c) for f in ks for i, c in enumerate(features)}
    found = upper_medians(data, {n: F.when(F.col("fold") != f, finite(c)) for n, (f, c) in names.items()})
    medians = {names[n]: m for n, m in found.items()}
    predictions = split_predictions(data, features, target, medians, bags, weight)
    y, own = finite(target), F.coalesce(*[F.when(F.col("fold") == f, sides(features, medians, f)) for f in ks])
    rows = data.where(y.isNotNull()).groupBy("fold", own.alias("side")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")).collect()
    rows = [r for r in rows if (r["fold"], r["side"]) in predictions]
    n, total, squares = (sum(r[c] for r in rows) for c in "nsq")
    sse = sum(r["q"] - 2 * predictions[r["fold"], r["side"]] * r["s"] + r["n"] * predictions[r["fold"], r["side"]] ** 2 for r in rows)
    sst = squares - total * total / n if n else 0.0
    result = (label, n, math.sqrt(max(0.0, sse) / n) if n else None, float(1 - sse / sst) if sst > 0 else None)
    return data.sparkSession.createDataFrame([result], "model string, n long, rmse double, r2 double")


def stump(df: DataFrame, features: list[str], target: str, key: str, k: int = 5, seed: int = 42, fold: str | None = None) -> DataFrame:
    """One split a fold at a feature's upper median, the feature with the least error; pooled errors."""
    return split_model(folded(df, [*features, target], key, k, seed, fold), features, target, "decision stump")


def bagged_stumps(df: DataFrame, features: list[str], target: str, key: str, k: int = 5, bags: int = 25, seed: int = 42, fold: str | None = None) -> DataFrame:
    """Mean of ``bags`` stumps a fold, each on Poisson weights drawn from a hash of the key. All split
    at the training folds' medians, so that one pass over the rows serves all bags."""

    def weight(bag: Column) -> Column:
        u = F.pmod(F.xxhash64(F.col(key), F.lit(seed), bag), F.lit(1000)) / 1000.0
        return F.when(u < 0.368, 0.0).when(u < 0.736, 1.0).when(u < 0.920, 2.0).otherwise(3.0)

    return split_model(folded(df, [*features, target], key, k, seed, fold), features, target, "bagged stumps", bags, weight)


def errors(df: DataFrame, prediction: Column, target: str, model: str) -> DataFrame:
    y = finite(target)
    both = df.select(prediction.alias("p"), y.alias("y")).dropna()
    sse = F.sum((F.col("p") - F.col("y")) ** 2)
    return both.agg(F.lit(model).alias("model"), F.count("*").alias("n"), F.sqrt(sse / F.count("*")).alias("rmse"), (1 - sse / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))).alias("r2"))


def accuracy(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Share of rows on the right side of .5."""
    return df.agg(F.avg(F.when((finite(prediction) >= 0.5) == (finite(target) >= 0.5), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("n"))


def benchmark(df: DataFrame, features: list[str], targets: list[str], key: str, k: int = 5, fold: str | None = None) -> DataFrame:
    """Mean RMSE and R^2 of each model over the targets."""
    out = None
    for t in targets:
        use = [c for c in features if c != t]
        for one in (cross_validated(df, use, t, key, k, fold=fold), cross_validated(df, use, t, key, k, ridge=1.0, label="ridge", fold=fold), stump(df, use, t, key, k, fold=fold)):
            out = one if out is None else out.unionByName(one)
    return out.groupBy("model").agg(F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"), F.count("*").alias("targets"))


def psi(df: DataFrame, column: str, reference: Column, bins: int = 5) -> DataFrame:
    """Population stability index of the monitor rows against quantile bins of the reference rows;
    needs 16 rows of each and three distinct edges."""
    v = finite(column)
    cuts = exact_quantiles(df, {column: F.when(reference, v)}, [i / bins for i in range(bins + 1)])[column]
    edges = sorted({x for x in cuts.values() if x is not None})
    if len(edges) < 3:
        return df.sparkSession.createDataFrame([], "column_name string, psi double, band string")
    number = sum((F.when(v >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    counts = df.where(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count_if(reference).alias("r"), F.count_if(~reference).alias("m"))
    all_bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").fillna(0)
    eps = 1e-6
    total = all_bins.agg(F.sum("r").alias("tr"), F.sum("m").alias("tm"))
    share = all_bins.join(F.broadcast(total), F.lit(True)).where("tr >= 16 and tm >= 16").select(F.greatest(F.col("r") / F.col("tr"), F.lit(eps)).alias("a"), F.greatest(F.col("m") / F.col("tm"), F.lit(eps)).alias("b"))
    out = share.agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi")).where("psi is not null")
    return out.select(F.lit(column).alias("column_name"), "psi", F.when(F.col("psi") >= 0.25, "critical").when(F.col("psi") >= 0.15, "warning").otherwise("stable").alias("band"))


def out_of_distribution(df: DataFrame, columns: list[str], row_id: str, share: float = 0.7, most: int = 24, z_limit: float = 3.5, distance_limit: float = 2.5) -> DataFrame:
    """Monitor rows (the last 30 %) against the reference: the larger of a regularised Mahalanobis
    distance and RMS z, standardised by the reference rows' own distances. A row is out if that
    reaches ``z_limit``, or if the distance reaches ``distance_limit`` and a column lies outside the
    reference's range by far; with the mean PSI and a drift band."""
    spark = df.sparkSession
    schema = "reference_rows long, monitor_rows long, ood long, ood_rate double, mean_distance double, max_distance double, psi_mean double, psi_max double, band string"
    n = df.count()
    ref = F.col(row_id) < int(share * n)
    g = gram(df.where(ref), columns)
    sd, r = g.stddev(), g.correlation()
    kept: list[int] = []
    for i in sorted(range(len(columns)), key=lambda i: -sd[i]):
        if sd[i] > 1e-12 and all(abs(r[i, j]) < 0.95 for j in kept) and len(kept) < most:
            kept.append(i)
    if not kept:
        return spark.createDataFrame([], schema)
    cols = [columns[i] for i in kept]
    inv = np.linalg.inv(r[np.ix_(kept, kept)] + 0.05 * np.eye(len(kept)))
    z = [(finite(x) - F.lit(float(g.mean[i]))) / F.lit(float(sd[i])) for x, i in zip(cols, kept, strict=True)]
    named = df.select(ref.alias("ref"), *[v.alias(f"z{i}") for i, v in enumerate(z)])
    at = [F.col(f"z{i}") for i in range(len(z))]
    d2 = sum((at[a] * at[b] * float(inv[a, b]) for a in range(len(at)) for b in range(len(at))), F.lit(0.0))
    rms = F.sqrt(sum((x * x for x in at), F.lit(0.0)) / len(at))
    top = F.greatest(*[F.abs(x) for x in at], F.lit(0.0))
    scored = named.select("ref", F.greatest(F.sqrt(F.greatest(d2, F.lit(0.0)) / len(at)), rms).alias("d"), (top >= z_limit).alias("extreme"))
    m, s = scored.where("ref").agg(F.avg("d"), F.stddev_samp("d")).first()
    s = s if s and s >= 1e-6 else 1.0
    bad = ((F.col("d") - F.lit(m or 0.0)) / F.lit(s) >= z_limit) | (F.col("extreme") & (F.col("d") >= distance_limit))
    row = scored.agg(F.count_if("ref"), F.count_if(~F.col("ref")), F.count_if(~F.col("ref") & bad), F.avg(F.when(~F.col("ref"), F.col("d"))), F.max(F.when(~F.col("ref"), F.col("d")))).first()
    psis = [x["psi"] for c in cols if (x := psi(df, c, ref).first())]
    mean, most_psi = (sum(psis) / len(psis), max(psis)) if psis else (0.0, 0.0)
    rate = row[2] / max(1, row[1])
    band = "critical" if mean >= 0.25 or most_psi >= 0.375 or rate >= 0.25 else "warning" if mean >= 0.15 or most_psi >= 0.25 or rate >= 0.10 else "stable"
    return spark.createDataFrame([(row[0], row[1], row[2], rate, float(row[3] or 0.0), float(row[4] or 0.0), mean, most_psi, band)], schema)


def kmeans(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (2, 3, 4, 5, 6), seed: int = 42, references: int = 4, reference_rows: int = 5000) -> DataFrame:
    """Silhouette, cost and gap of k-means on standardised columns for each k; the best one is marked.

    The gap is the mean log of the cost a row on ``references`` tables drawn evenly from the columns' ranges, less
    the log of the table's own. A cost a row hardly depends on the number of rows, so those tables have at
    most ``reference_rows``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.storagelevel import StorageLevel

    raw = VectorAssembler(inputCols=columns, outputCol="__raw", handleInvalid="skip").transform(df.select(*[finite(c).alias(c) for c in columns]))
    data = StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(raw).transform(raw).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    at = [vector_to_array("features")[i] for i in range(len(columns))]
    n, *ends = data.agg(F.count("*"), *[f(x) for x in at for f in (F.min, F.max)]).first()
    low, high = np.array(ends[::2], float), np.array(ends[1::2], float)
    rng = np.random.default_rng(seed)
    even = [rng.uniform(low, high, (min(n, reference_rows), len(columns))) for _ in range(references)]
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
        cost = float(model.summary.trainingCost)
        expected = [math.log(max(plain_kmeans(e, k, rng), 1e-12) / len(e)) for e in even]
        out.append((k, float(ClusteringEvaluator().evaluate(model.transform(data))), cost, sum(expected) / max(1, references) - math.log(max(cost, 1e-12) / n)))
    data.unpersist()
    best = max(r[1] for r in out)
    return df.sparkSession.createDataFrame([(*r, r[1] == best) for r in out], "k int, silhouette double, cost double, gap double, best boolean")


def plain_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> float:
    """The cost of k-means on a small table, from centres drawn apart from each other."""
    centres = x[rng.integers(len(x))][None]
    while len(centres) < k:
        d = ((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate([centres, x[rng.choice(len(x), p=d / d.sum())][None]]) if d.sum() > 0 else np.concatenate([centres, centres[:1]])
    for _ in range(rounds):
        own = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
    return float(((x[:, None] - centres) ** 2).sum(axis=2).min(axis=1).sum())


def sampled(df: DataFrame, rows: int, key: str, seed: int = 42) -> DataFrame:
    """A random sample without replacement: the rows with the least seeded hash of their key."""
    return df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))).orderBy("__h").limit(rows).drop("__h")


def evenly(df: DataFrame, rows: int, row_id: str) -> DataFrame:
    """Evenly spaced rows by a dense row id."""
    n = df.count()
    if n <= rows:
        return df
    i = F.col(row_id)
    return df.where(F.floor((i + 1) * rows / n) > F.floor(i * rows / n))


def ridge_fit(df: DataFrame, features: list[str], target: str, strength: float = 1.0) -> DataFrame:
    fit = algebra.ols(gram(df, [*features, target]), features, target, ridge=strength)
    return df.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(["(intercept)", *features], fit.beta, strict=True)] if fit else [], "term string, beta double")

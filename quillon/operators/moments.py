"""The shared sufficient-statistics job: one pass gives n, means and centred cross products.

Pearson correlations, regressions, ridge, VIF, partial correlations, stepwise selection, lasso, PCA,
BIC and Mahalanobis distances are functions of these few numbers, so they never scan rows again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns up to which covariances are updated value by value, which needs no means beforehand.
ONE_PASS_COLUMNS = 8
#: Columns up to which the sums are plain aggregates inside code generation.
AGGREGATE_COLUMNS = 24


@dataclass
class Gram:
    """n rows without nulls, means, and sums of products of deviations from the means."""

    names: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.cross / max(1, self.n - 1)

    def stddev(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.covariance()), 0))

    def correlation(self) -> np.ndarray:
        s = np.sqrt(np.maximum(np.diag(self.cross), 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = self.cross / np.outer(s, s)
        r = np.where(np.isfinite(r), r, 0.0)
        np.fill_diagonal(r, np.where(s > 0, 1.0, 0.0))
        return np.clip(r, -1, 1)

    def pick(self, names: list[str]) -> "Gram":
        at = [self.names.index(x) for x in names]
        return Gram(list(names), self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def __sub__(self, other: "Gram") -> "Gram":
        """The rows of self that are not in other."""
        n = self.n - other.n
        if n <= 0:
            return Gram(self.names, 0, np.zeros_like(self.mean), np.zeros_like(self.cross))
        mean = (self.n * self.mean - other.n * other.mean) / n
        d = other.mean - mean
        return Gram(self.names, n, mean, self.cross - other.cross - np.outer(d, d) * other.n * n / self.n)


def merge(parts: list[Gram]) -> Gram:
    """Rows of all parts together."""
    total = parts[0]
    for p in parts[1:]:
        n = total.n + p.n
        if not p.n:
            continue
        d = p.mean - total.mean
        total = Gram(total.names, n, total.mean + d * p.n / n, total.cross + p.cross + np.outer(d, d) * total.n * p.n / n)
    return total


def gram(df: DataFrame, columns: list[str], fold: str | None = None) -> Gram | dict:
    """The statistics of complete rows; per value of ``fold`` if one is named (a small number).

    Values are shifted by an approximate mean first, so that large offsets lose no digits.
    """
    clean = df.select(*([F.col(fold)] if fold else []), *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    if len(columns) <= ONE_PASS_COLUMNS:
        return _one_pass(clean, columns, fold)
    shift = clean.agg(*[F.avg(c).alias(c) for c in columns]).first()
    k = np.array([float(shift[c] or 0.0) for c in columns])
    if len(columns) <= AGGREGATE_COLUMNS:
        v = [F.col(c) - F.lit(float(x)) for c, x in zip(columns, k, strict=True)]
        sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(v)], *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i in range(len(v)) for j in range(i, len(v))]]
        rows = (clean.groupBy(fold) if fold else clean.groupBy()).agg(*sums).collect()
    else:
        rows = _by_partition(clean, columns, k, fold)
    out = {}
    for r in rows:
        n, m = r["n"], len(columns)
        s = np.array([r[f"s{i}"] or 0.0 for i in range(m)])
        p = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        out[r[fold] if fold else None] = Gram(list(columns), n, k + (s / n if n else 0), p - (np.outer(s, s) / n if n else 0))
    return out if fold else out.get(None) or Gram(list(columns), 0, np.zeros(len(columns)), np.zeros((len(columns), len(columns))))


def _one_pass(clean: DataFrame, columns: list[str], fold: str | None) -> Gram | dict:
    m = len(columns)
    cells = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]]
    cells += [(F.covar_pop(columns[i], columns[j]) if i != j else F.var_pop(columns[i])).alias(f"c{i}_{j}") for i in range(m) for j in range(i, m)]
    out = {}
    for r in (clean.groupBy(fold) if fold else clean.groupBy()).agg(*cells).collect():
        cross = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                cross[i, j] = cross[j, i] = (r[f"c{i}_{j}"] or 0.0) * r["n"]
        out[r[fold] if fold else None] = Gram(list(columns), r["n"], np.array([r[f"m{i}"] or 0.0 for i in range(m)]), cross)
    return out if fold else out[None]


def _by_partition(clean: DataFrame, columns: list[str], k: np.ndarray, fold: str | None) -> list[dict]:
    """Wide tables: a partial matrix a partition, by matrix products over Arrow batches."""
    import pandas as pd

    m = len(columns)

    def partial(batches):
        total: dict = {}
        for b in batches:
            for key, part in b.groupby(b[fold]) if fold else [(None, b)]:
                x = np.hstack([np.ones((len(part), 1)), part[columns].to_numpy(float) - k])
                total[key] = total.get(key, 0) + x.T @ x
        for key, t in total.items():
            yield pd.DataFrame({"fold": [None if key is None else str(key)], "m": [t.ravel().tolist()]})

    rows = clean.mapInPandas(partial, "fold string, m array<double>").groupBy("fold").agg(F.array(*[F.sum(F.col("m")[i]) for i in range((m + 1) ** 2)]).alias("m")).collect()
    out = []
    for r in rows:
        t = np.array(r["m"]).reshape(m + 1, m + 1)
        out.append({fold: r["fold"], "n": int(round(t[0, 0])), **{f"s{i}": t[0, i + 1] for i in range(m)}, **{f"p{i}_{j}": t[i + 1, j + 1] for i in range(m) for j in range(i, m)}})
    return out

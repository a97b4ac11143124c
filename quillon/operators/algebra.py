"""Regression and matrix kernels on sufficient statistics: p by p work on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from ..functions.special import correlation_p, f_upper, t_two_sided
from .moments import Gram


@dataclass
class Fit:
    """A least-squares fit with an intercept in front."""

    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    r2: float
    adjusted_r2: float
    f: float
    f_p: float
    n: int
    rss: float

    def rows(self) -> list[tuple]:
        out = []
        for i, name in enumerate(["(intercept)", *self.names]):
            t = float(self.beta[i] / self.se[i]) if self.se[i] > 0 else 0.0
            out.append((name, float(self.beta[i]), float(self.se[i]), t, t_two_sided(t, self.n - len(self.beta))))
        return out


def ols(g: Gram, features: list[str], target: str, ridge: float = 0.0) -> Fit | None:
    """None where the columns are linearly dependent or there are too few rows. ``ridge`` penalises
    the slopes, not the intercept."""
    p = len(features)
    if g.n <= p + 1:
        return None
    s = g.pick([*features, target])
    xx, xy, yy = s.cross[:p, :p], s.cross[:p, p], float(s.cross[p, p])
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    if p and ((scale <= 0).any() or np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-10) < p) and not ridge:
        return None
    a = xx + ridge * np.eye(p)
    inverse = np.linalg.inv(a) if p else np.zeros((0, 0))
    slopes = inverse @ xy
    rss = max(0.0, yy - 2 * float(slopes @ xy) + float(slopes @ xx @ slopes))
    df = g.n - p - 1
    r2 = 1 - rss / yy if yy > 0 else 0.0
    sigma2 = rss / df
    var = sigma2 * np.diag(inverse)
    m = s.mean[:p]
    var0 = sigma2 * (1 / g.n + float(m @ inverse @ m))
    f = (r2 / p) / ((1 - r2) / df) if p and r2 < 1 else math.inf if p else 0.0
    return Fit(list(features), np.concatenate([[s.mean[p] - slopes @ m], slopes]), np.sqrt(np.maximum(np.concatenate([[var0], var]), 0)), r2, 1 - (1 - r2) * (g.n - 1) / df, f, f_upper(f, p, df) if math.isfinite(f) else 0.0, g.n, rss)


def vif(g: Gram, columns: list[str]) -> dict[str, float]:
    """1 / (1 - R^2) of each column on the others: the diagonal of the inverse correlation matrix."""
    if g.n < len(columns) + 2 or len(columns) < 2:
        return dict.fromkeys(columns, 1.0)
    r = g.pick(columns).correlation()
    try:
        d = np.diag(np.linalg.inv(r))
    except np.linalg.LinAlgError:
        return dict.fromkeys(columns, math.inf)
    return {c: float(x) if 0 < x < 1e12 else math.inf for c, x in zip(columns, d, strict=True)}


def vif_pruned(g: Gram, columns: list[str], limit: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Drop the worst column above the limit until none is, or two are left."""
    kept, gone = list(columns), []
    while len(kept) > 2:
        v = vif(g, kept)
        worst = max(kept, key=lambda c: (v[c], kept.index(c)))
        if v[worst] <= limit:
            break
        kept.remove(worst)
        gone.append((worst, v[worst]))
    return kept, gone


def partial_r(g: Gram, a: str, b: str, given: list[str]) -> float:
    """Correlation of a and b with ``given`` held fixed."""
    r = g.pick([a, b, *given]).correlation()
    inverse = np.linalg.pinv(r)
    d = inverse[0, 0] * inverse[1, 1]
    return float(np.clip(-inverse[0, 1] / math.sqrt(d), -1, 1)) if d > 0 else 0.0


def lasso(g: Gram, features: list[str], target: str, strength: float | None = None, sweeps: int = 80, tol: float = 1e-6) -> dict[str, float]:
    """Standardised coefficients by coordinate descent in covariance form."""
    strength = strength if strength is not None else 0.12 if g.n < 200 else 0.08
    r = g.pick([*features, target]).correlation()
    xx, xy = r[:-1, :-1], r[:-1, -1]
    beta = np.zeros(len(features))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(features)):
            if xx[j, j] <= 0:
                continue
            rho = xy[j] - xx[j] @ beta + beta[j] * xx[j, j]
            new = math.copysign(max(abs(rho) - strength, 0.0), rho) / xx[j, j]
            moved = max(moved, abs(new - beta[j]))
            beta[j] = new
        if moved < tol:
            break
    return dict(zip(features, beta.tolist(), strict=True))


def lasso_gate(g: Gram, features: list[str], target: str, above: int = 30, keep: int = 15) -> list[str]:
    """With more than ``above`` features, the ``keep`` largest non-zero coefficients."""
    if len(features) <= above or g.n < 20:
        return list(features)
    b = lasso(g, features, target)
    ranked = sorted((c for c in features if abs(b[c]) >= 1e-4), key=lambda c: -abs(b[c]))
    return ranked[:keep] or list(features)


def stepwise(g: Gram, features: list[str], target: str, first: str | None = None, additions: int = 2, gain: float = 0.005) -> list[tuple[str, float]]:
    """Start with the best feature; add while adjusted R^2 gains enough. (feature, adjusted R^2)."""
    corr = g.pick([*features, target]).correlation()[-1]
    start = first or max(features, key=lambda c: abs(corr[features.index(c)]))
    fit = ols(g, [start], target)
    if fit is None:
        return []
    steps = [(start, fit.adjusted_r2)]
    while len(steps) <= additions:
        tried = [(c, ols(g, [s for s, _ in steps] + [c], target)) for c in features if c not in {s for s, _ in steps}]
        tried = [(c, f.adjusted_r2) for c, f in tried if f]
        best = max(tried, key=lambda x: x[1], default=None)
        if not best or best[1] - steps[-1][1] <= gain:
            break
        steps.append(best)
    return steps


def hidden_driver(g: Gram, features: list[str], target: str, least: float = 0.25) -> tuple[str, str, float] | None:
    """(best feature, the one most correlated with its residual, that correlation), by sign."""
    if len(features) < 2:
        return None
    r = g.pick([*features, target]).correlation()
    best = int(np.argmax(np.abs(r[:-1, -1])))
    ry = r[best, -1]
    if abs(ry) >= 1:
        return None
    rest = [(i, (r[i, -1] - r[i, best] * ry) / math.sqrt(1 - ry * ry)) for i in range(len(features)) if i != best]
    i, v = max(rest, key=lambda x: abs(x[1]))
    return (features[best], features[i], float(v)) if abs(v) >= least else None


def clusters(r: np.ndarray, names: list[str], limit: float, weight: dict[str, float] | None = None) -> dict[str, str]:
    """Name -> representative of its group, where groups join columns with |r| at the limit."""
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            if abs(r[i, j]) >= limit:
                parent[find(j)] = find(i)
    groups: dict[int, list[str]] = {}
    for i, n in enumerate(names):
        groups.setdefault(find(i), []).append(n)
    w = weight or {}
    return {n: max(m, key=lambda x: (w.get(x, 0.0), -names.index(x))) for m in groups.values() for n in m}


def identity_block(g: Gram, features: list[str], limit: float = 0.98) -> list[str]:
    """Of two features with |r| at the limit the one with less variance goes (ties: the later)."""
    s = g.pick(features)
    r, var = s.correlation(), np.diag(s.covariance())
    gone: set[int] = set()
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            if i not in gone and j not in gone and abs(r[i, j]) >= limit:
                gone.add(i if var[i] < var[j] else j)
    return [c for i, c in enumerate(features) if i not in gone]


def contaminated(g: Gram, features: list[str], target: str, limit: float = 0.99) -> list[str]:
    if g.n < 16:
        return []
    r = g.pick([*features, target]).correlation()[-1]
    return [c for i, c in enumerate(features) if abs(r[i]) > limit]


def pca(g: Gram, columns: list[str], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(explained share, loadings) of standardised columns; loadings' largest entry is positive."""
    values, vectors = np.linalg.eigh(g.pick(columns).correlation())
    order = np.argsort(-values)[:k]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
    return values[order] / max(values.sum(), 1e-12), v


def inverse(m: np.ndarray) -> np.ndarray | None:
    """None for a singular matrix."""
    try:
        out = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return None
    return out if np.abs(m @ out - np.eye(len(m))).max() < 1e-6 else None


def bic(g: Gram, target: str, parents: list[str]) -> float:
    """n ln(RSS / n) + k ln n."""
    s = g.pick([*parents, target])
    p = len(parents)
    rss = float(s.cross[p, p] - s.cross[:p, p] @ np.linalg.pinv(s.cross[:p, :p]) @ s.cross[:p, p]) if p else float(s.cross[p, p])
    return g.n * math.log(max(rss / g.n, 1e-300)) + (p + 1) * math.log(g.n)


def drift(global_r: float, conditional_r: float, least: float = 0.15, ratio: float = 0.50, drop: float = 0.12) -> str:
    """How a correlation changes once others are held fixed."""
    g, c = abs(global_r), abs(conditional_r)
    if g < least:
        return "weak global signal"
    flips = c >= 0.05 and global_r * conditional_r < 0
    falls = c <= g * ratio and g - c >= drop
    if flips and falls:
        return "sign reversal + magnitude collapse"
    return "sign reversal" if flips else "magnitude collapse" if falls else "stable"


def significance(r: float, n: int) -> float:
    return correlation_p(r, n)


def dependence_profile(fit: Fit, means: dict[str, float], points: dict[str, dict[float, float]]) -> list[tuple[str, float, float]]:
    """(feature, value, prediction) with the other features at their means."""
    base = float(fit.beta[0] + sum(b * means[c] for c, b in zip(fit.names, fit.beta[1:], strict=True)))
    return [(c, v, base + float(b) * (v - means[c])) for c, b in zip(fit.names, fit.beta[1:], strict=True) for v in points.get(c, {}).values()]

"""A bounded dense network in NumPy: trained on the driver on a capped, documented sample, applied
to every row by Arrow batches."""

from __future__ import annotations

import copy
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from .models import sampled
from .profile import finite

#: Training rows: the bound of what the driver holds.
TRAIN_ROWS = 25_000


def activate(name: str, x: np.ndarray) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0)
    if name == "tanh":
        return np.tanh(x)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    if name == "gelu":
        return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)))
    return x


def slope(name: str, x: np.ndarray) -> np.ndarray:
    if name == "relu":
        return (x > 0).astype(float)
    if name == "tanh":
        return 1 - np.tanh(x) ** 2
    if name == "sigmoid":
        s = activate("sigmoid", x)
        return s * (1 - s)
    if name == "gelu":
        inner = math.sqrt(2 / math.pi) * (x + 0.044715 * x**3)
        t = np.tanh(inner)
        return 0.5 * (1 + t) + 0.5 * x * (1 - t**2) * math.sqrt(2 / math.pi) * (1 + 3 * 0.044715 * x**2)
    return np.ones_like(x)


@dataclass
class Settings:
    """Training knobs."""

    hidden: tuple[int, ...] = (16, 8)
    activation: str = "relu"
    optimizer: str = "adam"
    rate: float = 0.01
    schedule: str = "cosine"
    warmup: int = 5
    epochs: int = 120
    batch: int = 64
    l2: float = 1e-4
    dropout: float = 0.0
    clip: float = 5.0
    noise: float = 0.0
    smoothing: float = 0.0
    ema: float = 0.0
    lookahead: int = 0
    accumulation: int = 1
    patience: int = 15
    norm: str = "none"
    validation: float = 0.2
    seed: int = 42


@dataclass
class Network:
    """Weights with the scaling of inputs and output, so predictions are in original units."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    settings: Settings
    x_mean: np.ndarray
    x_scale: np.ndarray
    y_mean: float
    y_scale: float
    binary: bool = False
    history: list[tuple[float, float]] = field(default_factory=list)

    def forward(self, z: np.ndarray, rng: np.random.Generator | None = None, drop: float = 0.0) -> tuple[list[np.ndarray], list[np.ndarray]]:
        pre, act = [], [z]
        for i, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            h = act[-1] @ w + b
            last = i + 1 == len(self.weights)
            if not last and self.settings.norm == "layer":
                h = (h - h.mean(axis=1, keepdims=True)) / np.sqrt(h.var(axis=1, keepdims=True) + 1e-5)
            pre.append(h)
            a = activate("sigmoid" if last and self.binary else "linear" if last else self.settings.activation, h)
            if rng is not None and drop and not last:
                a = a * (rng.random(a.shape) >= drop) / (1 - drop)
            act.append(a)
        return pre, act

    def scaled_predict(self, z: np.ndarray, rng=None, drop: float = 0.0) -> np.ndarray:
        out = self.forward(z, rng, drop)[1][-1][:, 0]
        return out if self.binary else out * self.y_scale + self.y_mean

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.scaled_predict((x - self.x_mean) / self.x_scale)

    def uncertainty(self, x: np.ndarray, samples: int = 24, drop: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
        """Mean and 1.96 standard deviations of predictions under dropout."""
        rng = np.random.default_rng(self.settings.seed)
        z = (x - self.x_mean) / self.x_scale
        p = np.stack([self.scaled_predict(z, rng, drop) for _ in range(samples)])
        return p.mean(axis=0), 1.96 * p.std(axis=0, ddof=1)

    def save(self, path: str) -> None:
        arrays = {f"w{i}": w for i, w in enumerate(self.weights)} | {f"b{i}": b for i, b in enumerate(self.biases)}
        np.savez(path, **arrays, x_mean=self.x_mean, x_scale=self.x_scale, y=np.array([self.y_mean, self.y_scale, float(self.binary)]), layers=np.array([len(self.weights)]), activation=np.array([self.settings.activation, self.settings.norm]))

    @staticmethod
    def load(path: str) -> "Network":
        try:
            d = np.load(path)
            n = int(d["layers"][0])
            s = Settings(activation=str(d["activation"][0]), norm=str(d["activation"][1]))
            return Network([d[f"w{i}"] for i in range(n)], [d[f"b{i}"] for i in range(n)], s, d["x_mean"], d["x_scale"], float(d["y"][0]), float(d["y"][1]), bool(d["y"][2]))
        except (OSError, KeyError, ValueError) as e:
            raise ModelError(f"not a saved network: {path}") from e


def split(y: np.ndarray, share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(train, validation) rows, stratified by quintiles of y."""
    order = np.argsort(y, kind="stable")
    held = np.zeros(len(y), bool)
    for part in np.array_split(order, min(5, max(1, len(y) // 10))):
        held[rng.permutation(part)[: int(len(part) * share)]] = True
    return np.flatnonzero(~held), np.flatnonzero(held)


def rate_at(s: Settings, epoch: int, plateau: float) -> float:
    r = s.rate * plateau
    if epoch < s.warmup:
        return r * (epoch + 1) / s.warmup
    if s.schedule == "cosine":
        return r * 0.5 * (1 + math.cos(math.pi * (epoch - s.warmup) / max(1, s.epochs - s.warmup)))
    if s.schedule == "cyclic":
        return r * (0.1 + 0.9 * abs(math.sin(math.pi * epoch / 20)))
    return r


def train(x: np.ndarray, y: np.ndarray, settings: Settings | None = None, binary: bool = False, l2_scale: np.ndarray | None = None) -> Network:
    """Fit by mini-batches with early stopping on held-out rows; the best weights are kept."""
    s = settings or Settings()
    fine = np.isfinite(x).all(axis=1) & np.isfinite(y)
    x, y = x[fine], y[fine]
    if len(y) < 10:
        raise ModelError("fewer than ten complete rows to train on")
    rng = np.random.default_rng(s.seed)
    m, d = x.mean(axis=0), x.std(axis=0)
    d = np.where(d > 1e-12, d, 1.0)
    ym, yd = (0.0, 1.0) if binary else (float(y.mean()), float(y.std()) or 1.0)
    z, t = (x - m) / d, (y - ym) / yd
    if binary and s.smoothing:
        t = t * (1 - s.smoothing) + 0.5 * s.smoothing
    sizes = [z.shape[1], *s.hidden, 1]
    net = Network([rng.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)], [np.zeros(b) for b in sizes[1:]], s, m, d, ym, yd, binary)
    ids, held = split(y, s.validation, rng)
    params = net.weights + net.biases
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    slow = [p.copy() for p in params]
    mean = [p.copy() for p in params]
    best, best_params, wait, plateau, step = math.inf, [p.copy() for p in params], 0, 1.0, 0
    penalty = l2_scale if l2_scale is not None else np.ones(z.shape[1])

    def loss(rows: np.ndarray) -> float:
        p = net.forward(z[rows])[1][-1][:, 0]
        if binary:
            p = np.clip(p, 1e-9, 1 - 1e-9)
            return float(-(t[rows] * np.log(p) + (1 - t[rows]) * np.log(1 - p)).mean())
        return float(((p - t[rows]) ** 2).mean())

    for epoch in range(s.epochs):
        rate = rate_at(s, epoch, plateau)
        held_grads, count = None, 0
        order = rng.permutation(ids)
        for a in range(0, len(order), s.batch):
            rows = order[a : a + s.batch]
            pre, act = net.forward(z[rows], rng, s.dropout)
            delta = (act[-1][:, 0] - t[rows])[:, None] * (1 if binary else 2) / len(rows)
            gw, gb = [None] * len(net.weights), [None] * len(net.biases)
            for i in range(len(net.weights) - 1, -1, -1):
                reg = s.l2 * net.weights[i] * (penalty[:, None] if i == 0 else 1)
                gw[i], gb[i] = act[i].T @ delta + reg, delta.sum(axis=0)
                if i:
                    delta = (delta @ net.weights[i].T) * slope(s.activation, pre[i - 1])
            grads = gw + gb
            held_grads = grads if held_grads is None else [p + q for p, q in zip(held_grads, grads, strict=True)]
            count += 1
            if count < s.accumulation and a + s.batch < len(order):
                continue
            grads = [g / count for g in held_grads]
            held_grads, count = None, 0
            norm = math.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, s.clip / norm) if norm > 0 else 1.0
            step += 1
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                g = g * scale + (rng.normal(0, s.noise, g.shape) if s.noise else 0)
                if s.optimizer == "sgd":
                    p -= rate * g
                else:
                    m1[i] = 0.9 * m1[i] + 0.1 * g
                    m2[i] = 0.999 * m2[i] + 0.001 * g * g
                    p -= rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
                if s.ema:
                    mean[i] = s.ema * mean[i] + (1 - s.ema) * p
            if s.lookahead and step % s.lookahead == 0:
                for i, p in enumerate(params):
                    slow[i] += 0.5 * (p - slow[i])
                    p[...] = slow[i]
        now = loss(held) if len(held) else loss(ids)
        net.history.append((loss(ids), now))
        if now < best - 1e-6:
            best, best_params, wait = now, [p.copy() for p in params], 0
        else:
            wait += 1
            plateau *= 0.5 if wait and wait % 5 == 0 else 1.0
            if wait >= s.patience:
                break
    for p, b in zip(params, mean if s.ema else best_params, strict=True):
        p[...] = b
    return net


def policy(rows: int, features: int) -> Settings:
    """fast, balanced or expressive topology by size."""
    if rows < 500 or features < 4:
        return Settings(hidden=(8,), epochs=80)
    if rows < 5000:
        return Settings(hidden=(16, 8), epochs=120)
    return Settings(hidden=(32, 16), epochs=100, batch=128, dropout=0.05)


def search(x: np.ndarray, y: np.ndarray, base: Settings, binary: bool = False) -> tuple[Settings, list[tuple[str, float]]]:
    """Three candidate topologies by short runs; the least held-out loss wins."""
    out = []
    for scale in (0.5, 1.0, 2.0):
        s = copy.replace(base, hidden=tuple(max(2, int(h * scale)) for h in base.hidden), epochs=20)
        out.append((s, min(v for _, v in train(x, y, s, binary).history)))
    best = min(out, key=lambda r: r[1])[0]
    return copy.replace(best, epochs=base.epochs), [(str(s.hidden), v) for s, v in out]


def sensitivity(net: Network, x: np.ndarray, y: np.ndarray, rows: int = 256, features: int = 64) -> np.ndarray:
    """Mean |change of the prediction| for a step of .05 standard deviations, rows weighted by 1 plus
    their scaled error. Inputs are standardised explicitly, so no step changes units."""
    z = ((x - net.x_mean) / net.x_scale)[:rows]
    base = net.scaled_predict(z)
    w = 1 + np.abs(base - y[:rows]) / (net.y_scale or 1.0)
    out = np.zeros(z.shape[1])
    for j in range(min(features, z.shape[1])):
        up, down = z.copy(), z.copy()
        up[:, j] += 0.05
        down[:, j] -= 0.05
        out[j] = float((w * np.abs(net.scaled_predict(up) - net.scaled_predict(down))).mean())
    return out / out.sum() if out.sum() > 0 else out


def integrated_gradients(net: Network, x: np.ndarray, steps: int = 16, rows: int = 256) -> np.ndarray:
    """Mean |attribution| of each input along the path from the mean row, by finite differences."""
    z = ((x - net.x_mean) / net.x_scale)[:rows]
    out = np.zeros(z.shape[1])
    for j in range(z.shape[1]):
        total = np.zeros(len(z))
        for k in range(max(4, steps)):
            p = z * ((k + 0.5) / max(4, steps))
            up, down = p.copy(), p.copy()
            up[:, j] += 1e-3
            down[:, j] -= 1e-3
            total += (net.scaled_predict(up) - net.scaled_predict(down)) / 2e-3
        out[j] = float(np.abs(z[:, j] * total / max(4, steps)).mean())
    return out / out.sum() if out.sum() > 0 else out


def hybrid(net: Network, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 0.5 * sensitivity(net, x, y) + 0.5 * integrated_gradients(net, x)


def ensemble_disagreement(x: np.ndarray, y: np.ndarray, s: Settings, members: int = 3, binary: bool = False) -> float:
    """Mean spread of members' predictions over the spread of the target."""
    p = np.stack([train(x, y, copy.replace(s, seed=s.seed + i), binary).predict(x) for i in range(members)])
    return float(p.std(axis=0).mean() / (y.std() or 1.0))


def training_stability(history: list[tuple[float, float]]) -> float:
    """Convergence of the training loss and, at .3, how close the held-out loss ends to it."""
    if not history:
        return 0.5
    (start, _), (end, held) = history[0], history[-1]
    converged = float(np.clip(0.5 + 0.5 * (start - end) / max(1e-9, abs(start)), 0, 1))
    general = float(np.clip(1 - abs(held - end) / max(1e-9, abs(end)), 0, 1))
    return 0.7 * converged + 0.3 * general


def confidence(uncertainty: np.ndarray, ensemble: np.ndarray, ood_rate: float, band: str) -> float:
    """1 minus penalties for uncertainty (.5), disagreement (.2), rows out of distribution (.3) and a
    drift band."""
    saturated = lambda v: float(np.mean(np.maximum(v[np.isfinite(v)], 0))) if np.isfinite(v).any() else 0.0
    u, e = saturated(np.asarray(uncertainty, float)), saturated(np.asarray(ensemble, float))
    penalty = 0.50 * u / (1 + u) + 0.20 * e / (1 + e) + 0.30 * min(1.0, max(0.0, ood_rate)) + {"critical": 0.30, "warning": 0.15}.get(band, 0.0)
    return 1 - min(1.0, max(0.0, penalty))


def monotone_penalty(values: np.ndarray, importance: float) -> float:
    """Importance of a column that only counts rows is cut to a tenth."""
    d = np.diff(values)
    return importance * 0.1 if len(d) > 10 and ((d > 0).mean() > 0.99 or (d < 0).mean() > 0.99) else importance


def pruned_inputs(g_corr: np.ndarray, names: list[str], rows: int, floor: int = 4) -> list[str]:
    """With under ten rows a parameter, the inputs most correlated with the target (last row)."""
    keep = max(floor, min(len(names), rows // 10))
    order = sorted(range(len(names)), key=lambda i: -abs(g_corr[-1, i]))[:keep]
    return [names[i] for i in sorted(order)]


def fit(df: DataFrame, features: list[str], target: str, key: str, settings: Settings | None = None, binary: bool = False, rows: int = TRAIN_ROWS) -> tuple[Network, np.ndarray, np.ndarray]:
    """Train on at most ``rows`` rows, those with the least hash of their key. Null targets go."""
    part = sampled(df.where(finite(target).isNotNull()), rows, key).select(*[finite(c).alias(c) for c in [*features, target]]).toPandas().dropna()
    x, y = part[features].to_numpy(float), part[target].to_numpy(float)
    return train(x, y, settings or policy(len(y), len(features)), binary), x, y


@dataclass
class Modelled:
    """A trained network with what was found on the way: inputs kept, candidates tried, and diagnostics."""

    net: Network
    features: list[str]
    x: np.ndarray
    y: np.ndarray
    importance: dict[str, float]
    candidates: list[tuple[str, float]]
    disagreement: float
    half_width: float


def modelled(df: DataFrame, features: list[str], target: str, key: str, binary: bool = False, rows: int = TRAIN_ROWS, members: int = 3) -> Modelled:
    """Prune inputs, search a topology, train, and explain, all on one sample of at most ``rows`` rows (those with
    the least hash of their key). Columns that only count rows lose importance."""
    part = sampled(df.where(finite(target).isNotNull()), rows, key).select(F.col(key).alias("__key"), *[finite(c).alias(c) for c in [*features, target]]).toPandas().dropna().sort_values("__key")
    y = part[target].to_numpy(float)
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(part[[*features, target]].to_numpy(float), rowvar=False)) if len(part) > 2 else np.eye(len(features) + 1)
    kept = pruned_inputs(r, features, len(part))
    x = part[kept].to_numpy(float)
    settings, tried = search(x, y, policy(len(y), len(kept)), binary)
    net = train(x, y, settings, binary)
    weights = hybrid(net, x, y)
    importance = {c: monotone_penalty(x[:, i], float(weights[i])) for i, c in enumerate(kept)}
    few = x[:256]
    return Modelled(net, kept, x, y, importance, tried, ensemble_disagreement(x[:2000], y[:2000], copy.replace(settings, epochs=20), members, binary), float(np.mean(net.uncertainty(few)[1]) / (y.std() or 1.0)))


def score(df: DataFrame, net: Network, features: list[str], key: str, uncertainty: bool = False) -> DataFrame:
    """(key, prediction, and a 95 % half width) of every row, by Arrow batches."""

    def apply(batches):
        for b in batches:
            x = b[features].to_numpy(float)
            p, u = net.uncertainty(x) if uncertainty else (net.predict(x), np.zeros(len(x)))
            yield pd.DataFrame({key: b[key], "prediction": p, "half_width": u})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), *[finite(c).alias(c) for c in features]).mapInPandas(apply, f"{key} {kind}, prediction double, half_width double")

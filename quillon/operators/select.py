"""Target resolution, feature collection and the deterministic selection phases."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions import names as N
from . import algebra
from .features import check_columns
from .moments import gram
from .profile import finite, numeric_columns

STRATEGIES = ("auto", "quality", "max_variance", "last_numeric")


def column_profile(df: DataFrame) -> dict[str, dict]:
    """n, distinct values, variance, non-zero share and entropy of each column: one aggregate, and one
    count of values by their 64-bit hashes. Numbers are counted in steps of a thousandth; the entropy is over its maximum."""
    numbers = set(numeric_columns(df))
    cells = [F.count("*").alias("__n")]
    value = {c: finite(c) if c in numbers else F.col(c).cast("string") for c in df.columns}
    for c, v in value.items():
        extra = [F.var_samp(v).alias("var"), F.avg(F.when(F.abs(v) > 1e-12, 1.0).otherwise(0.0)).alias("nonzero")] if c in numbers else []
        cells.append(F.struct(F.count(v).alias("n"), *extra).alias(c))
    row = df.agg(*cells).first()
    n = row["__n"]
    steps = lambda c, v: F.when(v.isNotNull(), F.xxhash64(F.round(v * 1000) + 0.0 if c in numbers else v))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), steps(c, v).alias("v")) for c, v in value.items()])).alias("x")).select("x.*").where("v is not null")
    counts = long.groupBy("c", "v").agg(F.count("*").cast("double").alias("k")).groupBy("c").agg(F.count("*").alias("distinct"), F.sum(F.col("k") * F.log2("k")).alias("weighted"))
    seen = {r["c"]: r for r in counts.collect()}
    out = {}
    for c in df.columns:
        m, d = row[c]["n"], seen[c]["distinct"] if c in seen else 0
        bits = math.log2(m) - seen[c]["weighted"] / m if m and c in seen else 0.0
        out[c] = {"rows": n, "numeric": c in numbers, "missing": 1 - m / n if n else 1.0, **row[c].asDict(), "distinct": d, "entropy": bits / math.log2(d) if d > 1 else 0.0}
    return out


def numeric_quality(name: str, p: dict, position: float) -> float:
    """How good a target a numeric column would be."""
    n, share = name.strip().lower(), p["distinct"] / max(1, p["n"])
    if p["n"] < 3:
        return -1e9
    penalty = 0.70 if N.is_admin(name) else 0.25 if "id" in n or "index" in n else 0.0
    penalty += 0.15 * any(t in n for t in ("timestamp", "created", "updated", "time", "date"))
    penalty += 0.20 * (share > 0.95) + 0.15 * (share > 0.98) + 0.08 * (share > 0.35 and p["distinct"] > 32)
    spread = min(1.0, math.log1p(max(0.0, p["var"] or 0.0)) / 4)
    bonus = 0.20 * N.is_target_candidate(name) + 0.24 * (2 <= p["distinct"] <= 12) + (0.14 if position == 1.0 else 0.05 if position == 0.0 else 0.0)
    return 0.30 * (1 - p["missing"]) + 0.25 * spread + 0.15 * (p["nonzero"] or 0.0) + 0.30 * p["entropy"] - penalty + bonus


def categorical_quality(name: str, p: dict, position: float) -> float | None:
    n = p["n"]
    if n < 8 or not (p["distinct"] == 2 or 2 < p["distinct"] <= 24 and p["distinct"] / n <= 0.20):
        return None
    score = 0.38 * (1 - p["missing"]) + 0.22 * (p["distinct"] <= 8) + 0.26 * (1 - p["distinct"] / 24)
    score += 0.20 * N.is_target_candidate(name) - 0.60 * N.is_admin(name)
    return score + 0.05 * position


@dataclass
class Target:
    """The chosen column, how it was chosen, its task and every column's score."""

    name: str
    strategy: str
    task: str
    scores: dict[str, float] = field(default_factory=dict)


def resolve_target(df: DataFrame, user: str | None = None, strategy: str = "auto") -> Target:
    """A named column, or by strategy. Auto: a target-like name; then a categorical column that
    beats the best numeric by .04; then a class-like numeric within .10; else the best score."""
    if strategy not in STRATEGIES:
        raise ConfigurationError(f"unknown target strategy {strategy!r}")
    profile = column_profile(df)
    last = max(1, len(df.columns) - 1)
    numeric = {c: numeric_quality(c, p, i / last) for i, (c, p) in enumerate(profile.items()) if p["numeric"] and p["distinct"] > 1}
    text = {c: q for i, (c, p) in enumerate(profile.items()) if not p["numeric"] and (q := categorical_quality(c, p, i / last)) is not None}
    scores = numeric | text

    def made(name: str, how: str) -> Target:
        return Target(name, how, N.task(profile[name]["distinct"], profile[name]["rows"]), scores)

    if user:
        check_columns(df, [user])
        return made(user, "user")
    if not scores:
        raise ConfigurationError("no column can serve as a target")
    if strategy == "max_variance" and numeric:
        return made(max(numeric, key=lambda c: (profile[c]["var"] or 0.0, c)), strategy)
    if strategy == "last_numeric" and numeric:
        return made([c for c in df.columns if c in numeric][-1], strategy)
    best = max(scores, key=lambda c: (scores[c], c))
    if strategy == "quality":
        return made(best, strategy)
    hints = [c for c in scores if N.is_target_candidate(c)]
    if hints:
        return made(max(hints, key=lambda c: (scores[c], c)), "name")
    if text and numeric and max(text.values()) >= max(numeric.values()) + 0.04:
        return made(max(text, key=lambda c: (text[c], c)), "categorical")
    classy = [c for c in numeric if 2 <= profile[c]["distinct"] <= 12]
    if classy and numeric and max(numeric[c] for c in classy) >= max(numeric.values()) - 0.10:
        return made(max(classy, key=lambda c: (numeric[c], c)), "class-like")
    return made(best, "vote")


def collect_features(df: DataFrame, target: str, excluded: list[str] | None = None, policy: str = "adaptive", leak: float = 0.995) -> tuple[list[str], dict[str, str]]:
    """(features, reasons of the others): numeric, not administrative, varying, known often enough
    and not the target in disguise. At least three are kept by relaxing the missingness limit."""
    check_columns(df, [target, *(excluded or [])])
    profile = column_profile(df)
    reasons: dict[str, str] = {}
    ratios = sorted(p["missing"] for c, p in profile.items() if c != target)
    q3 = ratios[int(0.75 * (len(ratios) - 1))] if ratios else 0.0
    limit = {"adaptive": min(0.95, max(0.35, q3 + 0.15)), "aggressive": 0.30, "lenient": 0.80}.get(policy, 0.95)
    for c, p in profile.items():
        if c == target:
            continue
        if c in (excluded or []):
            reasons[c] = "excluded"
        elif not p["numeric"]:
            reasons[c] = "not numeric"
        elif N.is_admin(c):
            reasons[c] = "administrative"
        elif (p["var"] or 0.0) <= 1e-12:
            reasons[c] = "no variance"
    left = [c for c in df.columns if c != target and c not in reasons]
    if left and profile[target]["numeric"]:
        row = df.agg(*[F.corr(finite(c), finite(target)).alias(c) for c in left]).first()
        for c in left:
            r = abs(row[c] or 0.0)
            if r >= leak or r >= 0.98 and (N.leak_hint(c) or target.lower() in c.lower()):
                reasons[c] = "leakage"
    left = [c for c in left if c not in reasons]
    fine = [c for c in left if profile[c]["missing"] <= limit]
    if len(fine) < 3:
        fine = sorted(left, key=lambda c: (profile[c]["missing"], df.columns.index(c)))[: max(3, len(fine))]
        fine = [c for c in df.columns if c in fine]
    reasons |= {c: "missing" for c in left if c not in fine}
    return fine, reasons


def phases(df: DataFrame, target: str, features: list[str]) -> dict:
    """Role tags, rows per feature, the lasso gate, the hidden driver and VIF pruning, all from one
    profile and one matrix of statistics."""
    profile = column_profile(df)
    g = gram(df, [*features, target])
    ratio = g.n / max(1, len(features))
    gated = algebra.lasso_gate(g, features, target)
    kept, gone = algebra.vif_pruned(g, gated)
    return {
        "roles": {c: N.role(c, p["distinct"], p["missing"], p["rows"], not p["numeric"]) for c, p in profile.items()},
        "mode": "conservative" if ratio < 10 else "expressive" if ratio > 100 else "balanced",
        "lasso": gated,
        "hidden": algebra.hidden_driver(g, features, target),
        "kept": kept,
        "collinear": gone,
    }

"""Configuration: typed settings, presets, and a strict parser for JSON, simple YAML and flags."""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from .errors import ConfigurationError

# Allowed words of the enumerated settings.
CHOICES: dict[str, set[str]] = {
    "outlier_method": {"iqr", "zscore", "modified_z", "adjusted_boxplot", "lof"},
    "outlier_action": {"flag", "remove", "cap"},
    "scaling": {"auto", "zscore", "minmax", "none"},
    "profile": {"auto", "quick", "thorough", "minimal"},
    "datetime_locale_hint": {"auto", "dmy", "mdy"},
    "numeric_locale_hint": {"auto", "us", "eu"},
    "export_preprocessed": {"none", "csv", "parquet"},
    "target_strategy": {"auto", "quality", "max_variance", "last_numeric"},
    "feature_strategy": {"auto", "adaptive", "aggressive", "lenient"},
    "neural_strategy": {"auto", "none", "fast", "balanced", "expressive"},
    "bivariate_strategy": {"auto", "balanced", "corr_heavy", "importance_heavy"},
    "neural_optimizer": {"adam", "sgd", "lookahead"},
    "neural_explainability": {"sensitivity", "integrated_gradients", "hybrid"},
}
IMPUTATION = {"auto", "mean", "median", "zero", "mode", "interpolate", "knn", "mice", "matrix_completion"}
TYPES = {"numeric", "categorical", "datetime"}


@dataclass
class Tuning:
    """Thresholds of the statistics."""

    significance_alpha: float = 0.05
    outlier_iqr_multiplier: float = 1.5
    outlier_z_threshold: float = 3.0
    lof_k: int = 20
    lof_threshold: float = 1.5
    scatter_fit_min_abs_corr: float = 0.35
    bivariate_selection_quantile: float = -1.0
    information_cluster_r: float = 0.97
    identity_r: float = 0.98
    contamination_r: float = 0.99
    leakage_r: float = 0.995
    vif_limit: float = 10.0
    lasso_gate: int = 30
    lasso_keep: int = 15
    causal_bootstraps: int = 64
    causal_top: int = 12
    psi_moderate: float = 0.15
    psi_major: float = 0.25
    pair_columns: int = 512
    stratified_eta2: float = 0.20
    stratified_separation: float = 0.75

    def check(self) -> None:
        rules = [
            (0 < self.significance_alpha < 1, "significance_alpha must lie in (0, 1)"),
            (self.outlier_iqr_multiplier > 0, "outlier_iqr_multiplier must be positive"),
            (self.outlier_z_threshold > 0, "outlier_z_threshold must be positive"),
            (self.lof_k >= 1, "lof_k must be at least 1"),
            (self.bivariate_selection_quantile == -1 or 0 <= self.bivariate_selection_quantile <= 1, "bivariate_selection_quantile must be -1 or lie in [0, 1]"),
            (0 < self.identity_r <= 1 and 0 < self.contamination_r <= 1, "correlation limits must lie in (0, 1]"),
            (self.psi_moderate <= self.psi_major, "psi_moderate may not exceed psi_major"),
            (self.causal_bootstraps >= 1 and self.causal_top >= 1, "causal counts must be at least 1"),
        ]
        for fine, message in rules:
            if not fine:
                raise ConfigurationError(message)


@dataclass
class Config:
    """One run. ``dataset`` is a path or table name; everything else has a default."""

    dataset: str = ""
    target: str | None = None
    delimiter: str = ","
    exclude: list[str] = field(default_factory=list)
    report: str = "report.html"
    output_dir: str = "."
    assets_dir: str = "assets"
    export_preprocessed: str = "none"
    export_preprocessed_path: str = "preprocessed"
    outlier_method: str = "iqr"
    outlier_action: str = "flag"
    scaling: str = "auto"
    profile: str = "auto"
    datetime_locale_hint: str = "auto"
    numeric_locale_hint: str = "auto"
    target_strategy: str = "auto"
    feature_strategy: str = "auto"
    neural_strategy: str = "auto"
    bivariate_strategy: str = "auto"
    neural_optimizer: str = "adam"
    neural_explainability: str = "hybrid"
    max_feature_missing_ratio: float = -1.0
    kfold: int = 5
    polynomial_degree: int = 2
    seed: int = 42
    plots: list[str] = field(default_factory=list)
    feature_engineering: bool = True
    store_outlier_flags: bool = False
    low_memory: bool = False
    fast_mode: bool = False
    causal: bool = True
    benchmark: bool = True
    impute: dict[str, str] = field(default_factory=dict)
    type: dict[str, str] = field(default_factory=dict)
    tuning: Tuning = field(default_factory=Tuning)

    def __post_init__(self) -> None:
        for key, allowed in CHOICES.items():
            if getattr(self, key) not in allowed:
                raise ConfigurationError(f"{key} must be one of {sorted(allowed)}, not {getattr(self, key)!r}")
        if len(self.delimiter) != 1:
            raise ConfigurationError("delimiter must be one character")
        if self.kfold < 2:
            raise ConfigurationError("kfold must be at least 2")
        if not 1 <= self.polynomial_degree <= 4:
            raise ConfigurationError("polynomial_degree must lie in 1..4")
        if self.max_feature_missing_ratio != -1 and not 0 <= self.max_feature_missing_ratio <= 1:
            raise ConfigurationError("max_feature_missing_ratio must be -1 or lie in [0, 1]")
        for c, s in self.impute.items():
            if s not in IMPUTATION:
                raise ConfigurationError(f"impute.{c}: unknown strategy {s!r}")
        for c, t in self.type.items():
            if t not in TYPES:
                raise ConfigurationError(f"type.{c}: unknown type {t!r}")
        if unknown := set(self.plots) - {"all", "none", "univariate", "bivariate", "overall"}:
            raise ConfigurationError(f"plots: unknown group {sorted(unknown)[0]!r}")
        self.tuning.check()
        self._preset()

    def _preset(self) -> None:
        if self.profile in ("quick", "minimal"):
            self.neural_strategy = "none" if self.profile == "minimal" else "fast" if self.neural_strategy == "auto" else self.neural_strategy
            self.causal = self.causal and self.profile != "minimal"
            self.kfold = min(self.kfold, 3)
        if self.low_memory:
            if self.outlier_method == "lof":
                self.outlier_method = "iqr"
            self.impute = {c: "mean" if s in ("knn", "mice", "matrix_completion") else s for c, s in self.impute.items()}


def _typed(key: str, kind: Any, value: Any) -> Any:
    try:
        if kind in (bool, "bool"):
            if isinstance(value, bool):
                return value
            word = str(value).strip().lower()
            if word in ("1", "true", "yes", "on"):
                return True
            if word in ("0", "false", "no", "off"):
                return False
            raise ValueError(value)
        if kind in (int, "int"):
            if float(value) != int(float(value)):
                raise ValueError(value)
            return int(float(value))
        if kind in (float, "float"):
            return float(value)
        if str(kind).startswith("list"):
            return [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else [str(x) for x in value]
        return None if value is None else str(value)
    except (TypeError, ValueError) as e:
        raise ConfigurationError(f"{key}: cannot read {value!r} as {kind}") from e


def flatten(tree: dict, prefix: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def read_text(text: str) -> dict[str, Any]:
    """JSON, or lines ``key: value`` with # comments."""
    if text.lstrip().startswith("{"):
        try:
            return flatten(json.loads(text))
        except json.JSONDecodeError as e:
            raise ConfigurationError(f"not valid JSON: {e}") from e
    out: dict[str, Any] = {}
    for i, line in enumerate(text.splitlines(), 1):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, colon, value = line.partition(":")
        if not colon:
            raise ConfigurationError(f"line {i}: expected key: value")
        out[key.strip()] = value.strip().strip("\"'")
    return out


def build(values: dict[str, Any]) -> Config:
    """A checked Config from flat keys; unknown keys are errors."""
    kinds = {f.name: f.type for f in fields(Config)}
    tuning_kinds = {f.name: f.type for f in fields(Tuning)}
    plain: dict[str, Any] = {}
    nested: dict[str, dict[str, str]] = {"impute": {}, "type": {}}
    tuning: dict[str, Any] = {}
    for key, value in values.items():
        key = key.replace("-", "_")
        head, _, rest = key.partition(".")
        head = {"column_imputation": "impute", "column_type_overrides": "type"}.get(head, head)
        if rest and head in nested:
            nested[head][rest] = str(value)
        elif rest and head == "tuning" and rest in tuning_kinds:
            tuning[rest] = _typed(key, tuning_kinds[rest], value)
        elif not rest and key in kinds and key not in ("tuning", "impute", "type"):
            plain[key] = _typed(key, kinds[key], value)
        else:
            raise ConfigurationError(f"unknown setting {key!r}")
    return Config(**plain, **nested, tuning=Tuning(**tuning))


def from_file(path: str | Path, **more: Any) -> Config:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigurationError(f"cannot read {path}") from e
    return build(read_text(text) | more)


def from_args(argv: list[str]) -> Config:
    """dataset [--config FILE] [--key value ...]; every setting is a flag, unknown ones are errors."""
    parser = argparse.ArgumentParser(prog="quillon", allow_abbrev=False)
    parser.add_argument("dataset", nargs="?", default="")
    parser.add_argument("--config")
    for f in fields(Config):
        if f.name not in ("dataset", "tuning", "impute", "type"):
            parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name, nargs="?", const="true")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="tuning.x, impute.<column> or type.<column>")
    try:
        got = vars(parser.parse_args(argv))
    except SystemExit as e:
        if e.code == 0:
            raise
        raise ConfigurationError("bad command line") from e
    values = read_text(Path(got["config"]).read_text(encoding="utf-8")) if got["config"] else {}
    values |= {k: v for k, v in got.items() if v is not None and k not in ("config", "set") and v != ""}
    for pair in got["set"]:
        key, _, value = pair.partition("=")
        values[key] = value
    return build(values)


def describe() -> list[tuple[str, str, str]]:
    """(key, type, default) of every setting."""
    base = [(f.name, str(f.type), repr(getattr(Config(), f.name))) for f in fields(Config) if f.name != "tuning"]
    return base + [(f"tuning.{f.name}", str(f.type), repr(f.default)) for f in fields(Tuning)]


def domain_rules(text: str) -> dict[str, set[str]]:
    """Side file: lines ``key: a, b``. Keys that block causal edges or weaken importance."""
    names = {"suppress_causal": "block", "non_causal": "block", "constructed_index": "block", "block_causal": "block", "downweight_importance": "weaken", "deprioritize": "weaken"}
    out: dict[str, set[str]] = {"block": set(), "weaken": set()}
    for line in text.splitlines():
        key, colon, value = line.split("#", 1)[0].replace("=", ":").partition(":")
        kind = names.get(key.strip().lower())
        if colon and kind:
            out[kind] |= {v.strip() for v in value.split(",") if v.strip()}
    return out

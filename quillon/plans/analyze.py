"""The whole analysis of one table: a sequence of operators whose results are DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, domain_rules
from ..drawing import draw
from ..functions import names as N
from ..operators import algebra, causal, features, impute, models, neural, outliers, plots, profile, relate, select, temporal
from ..operators.moments import Gram, gram
from ..report import Report, graph_page
from ..sources import tabular
from ..sources.scratch import materialised


#: Category columns whose pairs are tabled, and columns whose drift is measured.
CATEGORIES = 8
DRIFT_COLUMNS = 24


@dataclass
class Analysis:
    """Result tables by name, the prepared frame, the target and its features."""

    tables: dict[str, DataFrame]
    prepared: DataFrame
    target: str
    features: list[str]
    notes: list[str] = field(default_factory=list)


def side_rules(source: str) -> dict[str, set[str]]:
    """Domain rules from <dataset>.rules.txt or domain_rules.txt beside a local dataset."""
    path = Path(source.removeprefix("file://"))
    for name in (path.with_name(path.name + ".rules.txt"), path.with_suffix(".rules.txt"), path.with_name("domain_rules.txt")):
        if name.is_file():
            return domain_rules(name.read_text(encoding="utf-8"))
    return {"block": set(), "weaken": set()}


class Cancelled(Exception):
    """The caller's cancel hook said so."""


def prepare(df: DataFrame, config: Config, target: str) -> tuple[DataFrame, dict[str, str]]:
    """Cull, date features, outlier action, imputation and scaling. The target is normalised before
    anything is scaled, and rows without it are left out."""
    df = df.where(F.col(target).isNotNull())
    limit = None if config.max_feature_missing_ratio < 0 else config.max_feature_missing_ratio
    kept, gone = features.cull_columns(df, target, user_limit=limit)
    df = df.select(*kept)
    times = profile.datetime_columns(df)
    numbers = [c for c in profile.numeric_columns(df) if c not in ("row_id", target)]
    if times:
        df = features.date_features(impute.interpolate(df, times, "row_id"), times)
    method = config.outlier_method
    if numbers and method != "lof":
        knobs = {"multiplier": config.tuning.outlier_iqr_multiplier, "z": config.tuning.outlier_z_threshold}
        if config.outlier_action == "remove":
            df = outliers.remove(df, numbers, method, **knobs)
        elif config.outlier_action == "cap":
            df = outliers.cap(df, numbers, method, **knobs)
        elif config.store_outlier_flags:
            df = outliers.flag(df, numbers, method, **knobs)
    plan = {c: config.impute.get(c, "auto") for c in [*numbers, *[c for c in profile.string_columns(df) if c != target]] if c in df.columns}
    df = impute.run(df, plan, "row_id")
    texts = [c for c in profile.string_columns(df) if c != target]
    if texts:
        df = features.normalised_categories(df, texts)
    if config.scaling != "none" and numbers:
        df, _ = features.scaled(df, numbers, config.scaling)
    return df, gone


def analyze(source: DataFrame | str, config: Config | None = None, spark: SparkSession | None = None, progress: Callable[[str, int, int], None] | None = None, cancel: Callable[[], bool] | None = None, rules: dict[str, set[str]] | None = None) -> Analysis:
    """Run the stages in order. ``progress`` gets (label, step, steps); ``cancel`` is asked between.
    ``rules`` name columns that cause nothing (block) or count a quarter (weaken)."""
    config = config or Config()
    rules = rules or (side_rules(source) if isinstance(source, str) else {"block": set(), "weaken": set()})
    if isinstance(source, str):
        if spark is None:
            raise ValueError("a path needs a session")
        raw = tabular.load(spark, source, config.delimiter, config.type, config.numeric_locale_hint, config.datetime_locale_hint)
    else:
        raw = source if "row_id" in source.columns else tabular.with_row_id(source)
    spark = raw.sparkSession
    raw = materialised(raw, "raw")
    features.check_columns(raw, config.exclude)
    steps = ["profile", "target", "prepare", "features", "models", "pairs", "categories", "advanced", "drift", "causal"]
    tables: dict[str, DataFrame] = {}

    def step(label: str) -> None:
        if cancel and cancel():
            raise Cancelled(label)
        if progress:
            progress(label, steps.index(label) + 1, len(steps))

    step("profile")
    body = raw.drop(*config.exclude)
    numbers = [c for c in profile.numeric_columns(body) if c != "row_id"]
    texts = profile.string_columns(body)
    tables["quality"] = profile.quality_matrix(body, [c for c in body.columns if c != "row_id"])
    if numbers:
        tables["numeric_summary"] = profile.moments(body, numbers)
        tables["outliers"] = outliers.counts(body, numbers, config.outlier_method if config.outlier_method != "lof" else "iqr")
    if texts:
        tables["categories"] = profile.category_counts(body, texts)
    if times := profile.datetime_columns(body):
        tables["datetimes"] = profile.datetime_ranges(body, times)

    step("target")
    target = select.resolve_target(body.drop("row_id"), config.target, config.target_strategy)
    notes = [f"target {target.name} ({target.strategy}, {target.task})"]

    step("prepare")
    if target.name in numbers and target.task == "binary":
        body = features.binary_target(body, target.name)
    prepared, gone = prepare(body, config, target.name)
    y = target.name
    if target.name not in numbers:
        prepared = features.encoded_target(prepared, target.name)
        y = f"{target.name}_code"
    prepared = materialised(prepared, "prepared")
    tables["culled"] = spark.createDataFrame(list(gone.items()), "column_name string, reason string")

    step("features")
    chosen, reasons = select.collect_features(prepared.drop("row_id", *([target.name] if y != target.name else [])), y, policy="adaptive" if config.feature_strategy == "auto" else config.feature_strategy)
    if config.feature_engineering and len(chosen) >= 2:
        prepared, made = features.engineered(prepared, chosen[:8], y, degree=config.polynomial_degree)
        chosen += made
        prepared = materialised(prepared, "engineered")
    tables["feature_verdicts"] = spark.createDataFrame([(c, "kept") for c in chosen] + list(reasons.items()), "column_name string, verdict string")
    g = gram(prepared, [*chosen, y]) if chosen else None
    bad = algebra.contaminated(g, chosen, y, config.tuning.contamination_r) if g else []
    chosen = [c for c in chosen if c not in bad]
    chosen = algebra.identity_block(g, chosen, config.tuning.identity_r) if g and chosen else chosen

    step("models")
    if chosen and config.benchmark:
        plain = models.cross_validated(prepared, chosen, y, "row_id", config.kfold)
        tables["models"] = plain.unionByName(models.cross_validated(prepared, chosen, y, "row_id", config.kfold, ridge=1.0, label="ridge")).unionByName(models.stump(prepared, chosen, y, "row_id", config.kfold))
    importance = {c: abs(float(r)) for c, r in zip(chosen, g.pick([*chosen, y]).correlation()[-1], strict=False)} if chosen else {}
    fit = None
    if chosen and config.neural_strategy != "none":
        fit = neural.modelled(prepared, chosen, y, "row_id", target.task == "binary")
        tables["topologies"] = spark.createDataFrame([(n, float(v)) for n, v in fit.candidates], "hidden string, held_out_loss double")
        last = fit.net.history[-1]
        importance = relate.coherent_importance(fit.importance, importance, len(fit.y), last[0], last[1])
        notes.append(f"training stability {neural.training_stability(fit.net.history):.2f}")
    importance = {c: v * (0.25 if c in rules["weaken"] else 1.0) for c, v in importance.items()}
    tables["importance"] = spark.createDataFrame(sorted(importance.items(), key=lambda t: -t[1]), "column_name string, importance double")

    step("pairs")
    if len(chosen) >= 1:
        tables["pairs"] = relate.analyse_pairs(prepared, [*chosen, y], "row_id", {**importance, y: 1.0}, config.bivariate_strategy, config.tuning.significance_alpha, config.tuning.pair_columns, None if config.tuning.bivariate_selection_quantile < 0 else config.tuning.bivariate_selection_quantile, fit_min_corr=config.tuning.scatter_fit_min_abs_corr)

    step("categories")
    levels = [c for c in texts if c in prepared.columns]
    for a in levels:
        tables[f"anova_{a}"] = relate.anova(prepared, a, y)
    for i, a in enumerate(levels[:CATEGORIES]):
        for b in levels[i + 1 : CATEGORIES]:
            tables[f"contingency_{a}_{b}"] = relate.contingency(prepared, a, b)
    if levels:
        tables["pies"] = relate.pie_ranking(prepared, levels, relate.leading(importance, 1)[0] if importance else y)

    step("advanced")
    tables |= advanced(prepared, chosen, y, levels, importance, g)
    if found := temporal.project_timeline(body):
        notes.append(f"schedule from {found[0]} to {found[1]}")

    step("drift")
    n = prepared.count()
    early = F.col("row_id") < int(0.7 * n)
    if chosen:
        per = [models.psi(prepared, c, early) for c in chosen[:DRIFT_COLUMNS]]
        tables["psi"] = reduce(DataFrame.unionByName, per)
        tables["out_of_distribution"] = models.out_of_distribution(prepared, chosen[:DRIFT_COLUMNS], "row_id")
        if fit and (row := tables["out_of_distribution"].first()):
            sure = neural.confidence(np.array([fit.half_width]), np.array([fit.disagreement]), row["ood_rate"], row["band"])
            tables["confidence"] = spark.createDataFrame([(fit.half_width, fit.disagreement, row["ood_rate"], row["band"], sure)], "uncertainty double, disagreement double, ood_rate double, band string, confidence double")

    step("causal")
    if config.causal and chosen:
        blocked = {c for c in chosen if N.is_admin(c)} | rules["block"]
        tables["causal"] = causal.discover(prepared, y, chosen, "row_id", causal.Knobs(alpha=config.tuning.significance_alpha, bootstraps=config.tuning.causal_bootstraps, top=config.tuning.causal_top), blocked)
    return Analysis(tables, prepared, target.name, chosen, notes)


def advanced(df: DataFrame, features: list[str], target: str, levels: list[str], importance: dict[str, float], g: Gram | None) -> dict[str, DataFrame]:
    """Findings beyond pairs: the strongest interaction and its test, correlations with others held fixed, rows that
    are odd in their segment, rows far from the mean, and what they say in words."""
    spark, out, said = df.sparkSession, {}, []
    top = relate.leading({c: importance.get(c, 0.0) for c in features})
    if g and len(top) >= 2:
        out["interactions"] = relate.interactions(df, top, target, importance)
        if best := out["interactions"].first():
            out["interaction_test"] = relate.interaction_test(df, best["a"], best["b"], target)
            row = out["interaction_test"].first()
            said.append(("interaction", f"{best['a']} and {best['b']} act together on {target} (t = {row['t']:.2f})" if row and abs(row["t"]) >= 2 else "No interaction that a test confirms"))
        rows = []
        for a in top:
            given = next(c for c in top if c != a)
            overall, held = float(g.pick([a, target]).correlation()[0, 1]), algebra.partial_r(g, a, target, [given])
            rows.append((a, given, overall, held, algebra.drift(overall, held)))
        out["conditional_drift"] = spark.createDataFrame(rows, "column_name string, given string, overall_r double, conditional_r double, verdict string")
        said.append(("residual", relate.residual_narrative(g, features, target)))
        out["mahalanobis"] = outliers.mahalanobis(df, top, "row_id")
    if levels and top:
        out["outlier_context"] = outliers.outlier_context(df, levels[0], top, "row_id")
    if len(top) >= 2:
        said.append(("drivers", f"{top[0]} carries most of the signal; {top[1]} comes second"))
    out["narrative"] = spark.createDataFrame(relate.narrative_rows(said), "place int, topic string, text string")
    return out


#: Groups of plots, as ``Config.plots`` names them.
PLOTS = ("univariate", "bivariate", "overall")


def drawings(result: Analysis, groups: list[str]) -> list[tuple[str, object, str]]:
    """(kind, data, title) of the plots of the groups: distributions of the leading features, the selected pairs, and
    the correlations, categories and far rows of the whole table. Only bounded tables reach the driver."""
    df, out = result.prepared, []
    names = [r["column_name"] for r in result.tables["importance"].limit(8).collect()] if "importance" in result.tables else []
    if "univariate" in groups:
        for c in names:
            out.append(("bars", [(f"{r['low']:.4g}", float(r["n"])) for r in profile.histogram(df, c).orderBy("bin").collect()], f"Distribution of {c}"))
        shown = [r for c in names for r in plots.box(df, c).where("drawn").withColumn("level", F.lit(c)).collect()]
        out += [("boxes", [(r["level"], r["low"], r["q1"], r["median"], r["q3"], r["high"])], f"Spread of {r['level']}") for r in shown]
    if "bivariate" in groups and "pairs" in result.tables:
        for r in result.tables["pairs"].where("selected").limit(6).collect():
            points = [(p["x"], p["y"]) for p in plots.scatter(df, r["a"], r["b"], "row_id", 1500).collect()]
            out.append(("scatter", {r["relation"]: points}, f"{r['a']} and {r['b']} (r = {r['r']:.2f})"))
    if "overall" in groups:
        if len(names) > 1:
            cells = plots.heatmap(df, names, clustered=True).collect()
            out.append(("heatmap", [(r["i"], r["j"], r["a"], r["b"], r["r"]) for r in cells], "Correlations"))
        if len(names) > 2:
            out.append(("solid", [(p["x"], p["y"], p["z"]) for p in plots.scatter_3d(df, *names[:3], "row_id", 1500).collect()], f"{names[0]}, {names[1]} and {names[2]}"))
        for r in result.tables["pies"].collect() if "pies" in result.tables else []:
            out.append(("pie", [(x["level"], x["n"]) for x in plots.pie(df, r["category"]).orderBy(F.desc("n"), "level").collect()], f"{r['category']} beside {r['anchor']}"))
    return [d for d in out if d[1]]


def write(result: Analysis, config: Config, workspace: str = ".") -> str:
    """Report, graph page and the chosen export, all inside the workspace."""
    base = tabular.safe_path(config.output_dir, workspace)
    where = tabular.safe_path(config.report, str(base))
    report = Report("Analysis")
    for note in result.notes:
        report.paragraph(note)
    for name, df in result.tables.items():
        report.heading(name).table(df)
    for kind, data, title in drawings(result, [g for g in PLOTS if g in config.plots or "all" in config.plots]):
        report.image(draw(kind, data, title, tabular.safe_path(config.assets_dir, str(base))), title)
    report.save(where)
    if "causal" in result.tables:
        graph_page([(r["cause"], r["effect"], r["confidence"]) for r in result.tables["causal"].collect()], tabular.safe_path(f"{config.assets_dir}/graph.html", str(base)))
    if config.export_preprocessed != "none":
        out = str(tabular.safe_path(config.export_preprocessed_path, str(base)))
        (tabular.write_csv if config.export_preprocessed == "csv" else tabular.write_parquet)(result.prepared, out)
    return str(where)

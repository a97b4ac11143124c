"""Derived columns, scaling, encoding and the pre-flight column cull."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions import names
from ..functions.parsing import parse_boolean, tokens
from .profile import datetime_columns, finite, numeric_columns, string_columns

#: Cull limits by policy: the share of nulls beyond which a column goes.
CULL = {"auto": 0.93, "aggressive": 0.85, "lenient": 0.97, "adaptive": 0.92}


def check_columns(df: DataFrame, wanted: list[str]) -> None:
    unknown = [c for c in wanted if c not in df.columns]
    if unknown:
        raise DatasetError(f"no such column: {', '.join(unknown)}")


def cull_columns(df: DataFrame, target: str | None = None, policy: str = "auto", user_limit: float | None = None) -> tuple[list[str], dict[str, str]]:
    """(columns that stay, reasons of those that go), from one aggregate. The target stays."""
    limit = min(0.995, max(0.75, user_limit + 0.05)) if user_limit is not None else CULL[policy]
    numbers = set(numeric_columns(df))
    cells = [F.count("*").alias("__n")]
    for c in df.columns:
        v = finite(c) if c in numbers else F.col(c)
        cells.append(F.struct(F.count(v).alias("n"), *([(F.max(v) - F.min(v)).alias("range")] if c in numbers else [F.approx_count_distinct(v.cast("string")).alias("levels")])).alias(c))
    row = df.agg(*cells).first()
    n, gone = row["__n"], {}
    for c in df.columns:
        if c == target or not n:
            continue
        s = row[c]
        if 1 - s["n"] / n > limit:
            gone[c] = "missing"
        elif c in numbers and s["n"] < max(3, n // 200):
            gone[c] = "few values"
        elif c in numbers and (s["range"] or 0.0) <= 1e-12:
            gone[c] = "constant"
        elif c not in numbers and s["levels"] <= 1:
            gone[c] = "one level"
    return [c for c in df.columns if c not in gone], gone


def date_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Day of week (Sunday 0), month, weekend, day of year and quarter."""
    out: dict[str, Column] = {}
    for c in columns:
        day = F.dayofweek(c) - 1
        out |= {f"{c}_DayOfWeek": day, f"{c}_Month": F.month(c), f"{c}_IsWeekend": F.when(day.isin(0, 6), 1).otherwise(0), f"{c}_DayOfYear": F.dayofyear(c), f"{c}_Quarter": F.quarter(c)}
    return df.withColumns(out)


def polynomials(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    return df.withColumns({f"{c}_pow{p}": F.pow(finite(c), F.lit(float(p))) for c in columns for p in range(2, min(4, degree) + 1)})


def signed_log(c: str | Column) -> Column:
    v = finite(c)
    return F.signum(v) * F.log1p(F.abs(v))


def signed_logs(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_log1p_abs": signed_log(c) for c in columns})


def products(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": finite(a) * finite(b) for a, b in pairs})


def ratios(df: DataFrame, pairs: list[tuple[str, str]], least: float = 1e-9, checked: bool = True) -> DataFrame:
    """Both quotients of each pair of unit-compatible names; null where the divisor is near zero."""
    used = [(a, b) for x, y in pairs if not checked or names.ratio_compatible(x, y) for a, b in ((x, y), (y, x))]
    return df.withColumns({f"{a}_div_{b}": F.when(F.abs(finite(b)) > least, finite(a) / finite(b)) for a, b in used})


def engineered(df: DataFrame, columns: list[str], target: str | None = None, bases: int = 8, degree: int = 2) -> tuple[DataFrame, list[str]]:
    """Candidate features that earn their place: (frame with them, their names).

    Bases are the columns most correlated with the target (else the widest); pairs need both
    correlations at .20 and less than .98 with each other. A candidate stays if it varies, is not its
    parent in disguise (|r| < .985) and, with a target, beats its best parent by 1 %.
    """
    columns = [c for c in columns if c != target]
    if target:
        row = df.agg(*[F.corr(finite(c), finite(target)).alias(c) for c in columns]).first()
        rank = {c: abs(row[c] or 0.0) for c in columns}
    else:
        row = df.agg(*[F.stddev_samp(finite(c)).alias(c) for c in columns]).first()
        rank = {c: row[c] or 0.0 for c in columns}
    top = sorted(columns, key=lambda c: (-rank[c], columns.index(c)))[:bases]
    all_pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    mutual = df.agg(*[F.corr(finite(a), finite(b)).alias(f"{a}|{b}") for a, b in all_pairs]).first() if all_pairs else None
    pairs = [(a, b) for a, b in all_pairs if abs(mutual[f"{a}|{b}"] or 0.0) < 0.98 and (not target or min(rank[a], rank[b]) >= 0.20)]
    before = set(df.columns)
    wide = ratios(products(signed_logs(polynomials(df, top, degree), top), pairs), pairs)
    made = [c for c in wide.columns if c not in before]
    if not made:
        return wide, []
    cells = []
    for c in made:
        parents = [p for p in names.engineered_base(c) if p in before]
        cells.append(F.struct(F.var_samp(finite(c)).alias("v"), *[F.corr(finite(c), finite(p)).alias(f"p{i}") for i, p in enumerate(parents)], *([F.corr(finite(c), finite(target)).alias("t")] if target else [])).alias(c))
    row = wide.agg(*cells).first()
    kept = []
    for c in made:
        s = row[c].asDict()
        parents = [p for p in names.engineered_base(c) if p in before]
        fine = (s["v"] or 0.0) > 1e-10 and all(abs(s[f"p{i}"] or 0.0) < 0.985 for i in range(len(parents)))
        if target:
            fine = fine and abs(s["t"] or 0.0) >= max(0.05, 1.01 * max((rank.get(p, 0.0) for p in parents), default=0.0))
        if fine:
            kept.append(c)
    return wide.select(*df.columns, *kept), kept


def boolean_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_bool": parse_boolean(F.col(c)).cast("int") for c in columns})


def multi_select(df: DataFrame, column: str, max_tokens: int = 6) -> tuple[DataFrame, str | None]:
    """Expand a multi-select column: <c>_selection_count and up to six <c>_has_<token>.

    The best of , ; | is used if at least max(3, 10 %) rows hold it, there are three tokens and 1.3
    tokens a row on average. Returns the frame and the separator, or None if there is none.
    """
    n = df.count()
    stats = df.agg(*[F.struct(F.count_if(F.contains(F.col(column), F.lit(s))).alias("rows"), F.avg(F.size(tokens(F.col(column), s))).alias("mean")).alias(f"s{i}") for i, s in enumerate(",;|")]).first()
    best = max(range(3), key=lambda i: (stats[i]["rows"], -i))
    if stats[best]["rows"] < max(3, -(-n // 10)) or (stats[best]["mean"] or 0.0) < 1.30:
        return df, None
    sep = ",;|"[best]
    ranked = df.select(F.explode(tokens(F.col(column), sep)).alias("t")).groupBy("t").agg(F.count("*").alias("k")).where(F.col("k") >= max(2, 0.04 * n)).orderBy(F.desc("k"), "t").limit(max_tokens).collect()
    parts = tokens(F.col(column), sep)
    made = {f"{column}_selection_count": F.coalesce(F.size(parts), F.lit(0))}
    made |= {f"{column}_has_{names.column_token(r['t'])}": F.coalesce(F.array_contains(parts, r["t"]), F.lit(False)).cast("int") for r in ranked}
    return df.withColumns(made), sep


def normalised_categories(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.lower(F.trim(c)) for c in columns or string_columns(df)})


def scaled(df: DataFrame, columns: list[str], method: str = "auto", skip: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, tuple[str, float, float]]]:
    """z-score, min-max or none. Auto takes min-max where the range or |mean| exceeds 100. Returns
    the frame and (method, offset, divisor) of each column. ``skip``: a binary target, say."""
    row = df.agg(*[F.struct(F.avg(finite(c)).alias("m"), F.stddev_samp(finite(c)).alias("s"), F.min(finite(c)).alias("lo"), F.max(finite(c)).alias("hi")).alias(c) for c in columns]).first()
    used, out = {}, {}
    for c in columns:
        s = row[c]
        kind = method
        if c in skip or s["m"] is None:
            kind = "none"
        elif method == "auto":
            kind = "minmax" if s["hi"] - s["lo"] > 100 or abs(s["m"]) > 100 else "zscore"
        if kind == "minmax":
            span = s["hi"] - s["lo"]
            used[c] = (kind, s["lo"], span if span > 1e-12 else 1.0)
        elif kind == "zscore":
            used[c] = (kind, s["m"], s["s"] if s["s"] and s["s"] > 1e-12 else 1.0)
        else:
            used[c] = ("none", 0.0, 1.0)
        if used[c][0] != "none":
            out[c] = (finite(c) - F.lit(used[c][1])) / F.lit(used[c][2])
    return df.withColumns(out), used


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): by frequency, ties by value. One row a level."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.select("value", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("code"), "n")


def encoded_target(df: DataFrame, column: str) -> DataFrame:
    """<column>_code: 0/1 for boolean-like values, else the label code."""
    as_bool = parse_boolean(F.col(column))
    bad = df.where(F.col(column).isNotNull() & as_bool.isNull()).limit(1).count()
    if not bad:
        return df.withColumn(f"{column}_code", as_bool.cast("double"))
    codes = label_codes(df, column).select(F.col("value").alias(column), F.col("code").cast("double").alias(f"{column}_code"))
    return df.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, column, "left").select(*df.columns, f"{column}_code")


def binary_target(df: DataFrame, column: str) -> DataFrame:
    """0/1 by the midpoint of the two labels; null stays null."""
    lo, hi = df.agg(F.min(finite(column)), F.max(finite(column))).first()
    return df.withColumn(column, F.when(finite(column).isNotNull(), F.when(finite(column) > (lo + hi) / 2, 1.0).otherwise(0.0)))


def one_hot(df: DataFrame, column: str, top: int = 24) -> tuple[DataFrame, list[str]]:
    """<c>=<label> for the most frequent labels (fewer in small tables) and <c>=OTHER."""
    n = df.count()
    keep = min(top, n // 25 + 1) if n < 500 else top
    levels = [r["value"] for r in label_codes(df, column).where(F.col("code") < keep).orderBy("code").collect()]
    made = {f"{column}={v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in levels}
    made[f"{column}=OTHER"] = F.when(F.col(column).isNotNull() & ~F.col(column).isin(levels), 1).otherwise(0)
    return df.withColumns(made), list(made)


def expanded_dates(df: DataFrame) -> DataFrame:
    return date_features(df, datetime_columns(df))

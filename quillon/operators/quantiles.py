"""Exact order statistics at any size, and buckets of even depth.

``percentile`` keeps a count for each distinct value of a column in one buffer, which is right for
small tables. Beyond, ranks are found by narrowing: each pass cuts the value interval of every open
rank into 4096 bins and counts them, for all columns together, with the least and greatest value of
each bin. The bin that holds the rank is the next interval; since its ends are values of the column, a bin
whose ends are equal is the answer. Once the open intervals hold few values these are listed. A
pass returns a bounded table and no task holds more than the bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a column up to which the single-pass aggregate is used.
SINGLE_PASS_VALUES = 100_000
BINS = 4096
#: Values in open intervals that are listed instead of cut again.
LISTED = 100_000
#: Buckets of even depth, as two digits of this base, and the rows that one is worth.
BASE, BUCKET_ROWS = 32, 20_000

Columns = list[str] | dict[str, Column]


def number(c: str | Column) -> Column:
    """The value as a double; null where it is NaN or infinite."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def named(columns: Columns) -> dict[str, Column]:
    return {c: number(c) for c in columns} if isinstance(columns, list) else {c: number(v) for c, v in columns.items()}


def nth_values(df: DataFrame, columns: Columns, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at 0-based ranks among each column's finite values."""
    exprs = {c: v for c, v in named(columns).items() if ranks.get(c)}
    if not exprs:
        return {c: {} for c in ranks}
    names = list(exprs)
    clean = df.select(*[v.alias(f"v{i}") for i, v in enumerate(exprs.values())])
    row = clean.agg(*[F.struct(F.count(f"v{i}"), F.min(f"v{i}"), F.max(f"v{i}")).alias(f"v{i}") for i in range(len(names))]).first()
    # (column, rank) -> values below the interval, its ends, values inside
    spans = {(i, r): (0, row[i][1], row[i][2], row[i][0]) for i, c in enumerate(names) for r in ranks[c]}
    while open_ := sorted({(k[0], s[1], s[2], s[3]) for k, s in spans.items() if s[1] < s[2]}):
        listing = sum(n for *_, n in open_) <= LISTED
        cells = []
        for i in sorted({i for i, *_ in open_}):
            v, which, share = F.col(f"v{i}"), None, None
            for j, (_, a, b, _) in ((j, s) for j, s in enumerate(open_) if s[0] == i):
                inside = v.between(F.lit(a), F.lit(b))
                part = (v / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2)
                which = F.when(inside, j) if which is None else which.when(inside, j)
                share = F.when(inside, part) if share is None else share.when(inside, part)
            cells.append(F.struct(which.alias("j"), (F.lit(0) if listing else F.least(F.lit(BINS - 1), F.floor(share * BINS))).alias("bin"), v.alias("v")))
        each = clean.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("j is not null")
        if listing:
            found = [(r["j"], r["n"], r["v"], r["v"]) for r in each.groupBy("j", "v").agg(F.count("*").alias("n")).collect()]
        else:
            found = [(r["j"], r["n"], r["lo"], r["hi"]) for r in each.groupBy("j", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()]
        bins: dict[int, list] = {}
        for j, n, lo, hi in found:
            bins.setdefault(j, []).append((lo, hi, n))
        for key, (below, a, b, n) in list(spans.items()):
            if a == b:
                continue
            for lo, hi, count in sorted(bins[open_.index((key[0], a, b, n))]):
                if key[1] < below + count:
                    spans[key] = (below, lo, hi, count)
                    break
                below += count
    return {c: {r: spans[(names.index(c), r)][1] for r in ranks[c]} if c in exprs else {} for c in ranks}


def exact_quantiles(df: DataFrame, columns: Columns, probs: list[float], single_pass: int | None = None) -> dict[str, dict[float, float | None]]:
    """Interpolated quantiles at position p * (n - 1) of each column's finite values; null for an empty one."""
    limit = SINGLE_PASS_VALUES if single_pass is None else single_pass
    exprs = named(columns)
    if not exprs:
        return {}
    sizes = df.agg(*[F.count(v).alias(f"v{i}") for i, v in enumerate(exprs.values())]).first()
    size = dict(zip(exprs, sizes, strict=True))
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(probs) for c in exprs}
    small = [c for c in exprs if 0 < size[c] <= limit]
    if small:
        row = df.agg(*[F.percentile(exprs[c], F.array(*[F.lit(float(p)) for p in probs])).alias(f"v{i}") for i, c in enumerate(small)]).first()
        out |= {c: dict(zip(probs, row[i], strict=True)) for i, c in enumerate(small)}
    at = {c: {p: p * (size[c] - 1) for p in probs} for c in exprs if size[c] > limit}
    found = nth_values(df, {c: exprs[c] for c in at}, {c: sorted({r for x in v.values() for r in (math.floor(x), math.ceil(x))}) for c, v in at.items()}) if at else {}
    for c, places in at.items():
        low = lambda x, c=c: found[c][math.floor(x)]
        out[c] = {p: low(x) + (found[c][math.ceil(x)] - low(x)) * (x - math.floor(x)) for p, x in places.items()}
    return out


def medians(df: DataFrame, columns: Columns) -> dict[str, float | None]:
    return {c: q[0.5] for c, q in exact_quantiles(df, columns, [0.5]).items()}


def order_statistics(df: DataFrame, column: str, ranks: list[int], rows: int, single_pass: int | None = None) -> dict[int, float]:
    """The values at 0-based ranks of a column with ``rows`` finite values: one aggregate, or narrowing
    passes above ``single_pass`` values."""
    if rows > (SINGLE_PASS_VALUES if single_pass is None else single_pass):
        return nth_values(df, [column], {column: ranks})[column]
    at = [F.expr(f"percentile_disc({(r + 0.5) / rows}) WITHIN GROUP (ORDER BY __v)").alias(f"r{r}") for r in ranks]
    row = df.select(number(column).alias("__v")).agg(*at).first()
    return {r: row[f"r{r}"] for r in ranks}


def even_cuts(df: DataFrame, value: Column, parts: int = BASE * BASE) -> list[float]:
    """Values that cut a column into parts of about even depth, from a bounded sketch: at most ``parts``, and
    no more than give each BUCKET_ROWS rows. Equal values are never divided, so there may be fewer."""
    return even_cuts_of(df, {"v": value}, parts)["v"]


def even_cuts_of(df: DataFrame, columns: dict[str, Column], parts: int = BASE * BASE) -> dict[str, list[float]]:
    parts = min(parts, max(8, df.count() // BUCKET_ROWS))
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    row = df.agg(*[F.percentile_approx(v, probs, F.lit(10 * parts)) for v in columns.values()]).first()
    return {c: sorted(set(found or [])) for c, found in zip(columns, row, strict=True)}


def with_bucket(df: DataFrame, value: Column, cuts: list[float], name: str) -> DataFrame:
    """Adds the number of cuts at or below a value (at most BASE * BASE - 1 cuts): its first digit by comparing
    with every BASE-th cut, its second inside that range. Buckets follow the order of values."""
    v, tops = value.cast("double"), cuts[BASE - 1 :: BASE]
    total = lambda xs: sum((F.when(x, 1).otherwise(0) for x in xs), F.lit(0))
    if not tops:
        return df.withColumn(name, total(v >= F.lit(float(c)) for c in cuts).cast("int"))
    ranges = [cuts[i : i + BASE - 1] for i in range(0, len(cuts), BASE)] + ([[]] if len(cuts) % BASE == 0 else [])
    listed = F.expr("array(" + ", ".join("array(" + ", ".join(f"double('{c!r}')" for c in r) + ")" if r else "CAST(array() AS array<double>)" for r in ranges) + ")")
    first = df.withColumns({"__v": v, "__top": total(v >= F.lit(float(t)) for t in tops)})
    inside = F.when(F.col("__v").isNull(), 0).otherwise(F.size(F.filter(F.get(listed, F.col("__top")), lambda c: F.col("__v") >= c)))
    return first.withColumn(name, (F.col("__top") * BASE + inside).cast("int")).drop("__v", "__top")

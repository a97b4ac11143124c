"""Drift of a stream against a stored reference: PSI of each micro-batch (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import finite


def reference_bins(df: DataFrame, column: str, bins: int = 5) -> tuple[list[float], list[float]]:
    """(inner edges, shares) of reference quantile bins: a few numbers to keep."""
    edges = sorted(set(df.agg(F.percentile(finite(column), F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]))
    number = sum((F.when(finite(column) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    counts = {r["b"]: r["n"] for r in df.where(finite(column).isNotNull()).groupBy(number.alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) or 1
    return edges, [max(1e-6, counts.get(i, 0) / total) for i in range(len(edges) + 1)]


def monitor(stream: DataFrame, column: str, edges: list[float], shares: list[float], sink: Callable[[DataFrame, int], None]):
    """A writer whose batches reach ``sink`` as one row (batch, n, psi); start() it as any other."""
    number = sum((F.when(finite(column) >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))

    def each(batch: DataFrame, epoch: int) -> None:
        cells = batch.where(finite(column).isNotNull()).agg(F.count("*").alias("n"), *[F.count_if(number == i).alias(f"b{i}") for i in range(len(shares))])
        terms = [(F.greatest(F.col(f"b{i}") / F.greatest(F.col("n"), F.lit(1)), F.lit(1e-6)), F.lit(s)) for i, s in enumerate(shares)]
        psi = sum(((m - r) * F.ln(m / r) for m, r in terms), F.lit(0.0))
        sink(cells.select(F.lit(epoch).cast("long").alias("batch"), "n", psi.alias("psi")), epoch)

    return stream.writeStream.foreachBatch(each)

"""Registered queries over the driver's tables, each beside its DuckDB equivalent.

Doubles are rounded in both, since sums of doubles depend on their order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, negative zero as zero."""
    return df.select(*[(F.round(f"`{f.name}`", digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema])


def query(name: str, oracle: str | None = None, digits: int = DIGITS):
    """Register ``f(spark, sf_dir)``. In the SQL, ``{R:expr}`` is expr rounded as the query is."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if oracle:
            ORACLES[name] = round_in(oracle, digits)
        return f

    return add


def round_in(sql: str, digits: int) -> str:
    out, at = [], 0
    while (a := sql.find("{R:", at)) >= 0:
        depth, b = 1, a + 3
        while depth:
            depth += {"{": 1, "}": -1}.get(sql[b], 0)
            b += 1
        out += [sql[at:a], f"(round(({sql[a + 3 : b - 1]})::DOUBLE, {digits}) + 0.0)"]
        at = b
    return "".join(out) + sql[at:]


from . import queries_associations, queries_preparation, queries_profile, queries_supervised, queries_temporal  # noqa: E402, F401

"""Reading delimited text and Parquet into typed frames, and writing results."""

from __future__ import annotations

import csv
import io
import os
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError, OutputError
from ..functions import names as N
from ..functions import parsing as X
from .scratch import materialised

# Marks of rows that are not data.
CONTROL_MARKS = ["data gap", "maintenance log"]
METADATA_MARKS = ["grand total", "subtotal", "total", "summary", "rollup", "aggregate", "stop:"]


def read_text_table(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as strings. Plain, .gz and .zip files, and the first sheet of .xlsx files; quotes, doubled
    quotes, line breaks in fields and a byte-order mark are understood, malformed rows are skipped.

    A file is split among tasks unless a field holds a line break, which one scan for lines with an odd number
    of quotes finds out: such files are read by one task each.
    """
    if path.lower().endswith(".xls"):
        raise DatasetError("old binary spreadsheets are not read; save the sheet as .xlsx or delimited text")
    if path.lower().endswith(".xlsx"):
        return _from_members(spark, path, lambda content: sheet_rows(content))
    if path.lower().endswith(".zip"):
        return _from_members(spark, path, lambda content: zipped_rows(content, delimiter))
    try:
        broken = spark.read.text(path).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).limit(1).count() > 0
    except Exception as e:
        raise DatasetError(f"cannot read {path}: {str(e)[:200]}") from e
    options = {"header": "false", "inferSchema": "false", "sep": delimiter, "quote": '"', "escape": '"', "multiLine": str(broken).lower(), "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": str(8 << 20), "maxColumns": "20000"}
    try:
        head = spark.read.options(**options).csv(path).first()
    except Exception as e:
        raise DatasetError(f"cannot read {path}: {str(e)[:200]}") from e
    if head is None:
        raise DatasetError(f"{path} is empty")
    columns = N.normalise_header([x or "" for x in head])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(**options | {"header": "true", "enforceSchema": "true"}).schema(schema).csv(path)


def zipped_rows(content: bytes, delimiter: str) -> Iterator[list[str]]:
    """Rows of all members of an archive, by Python's csv module."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if not n.endswith("/")):
            with z.open(name) as f:
                yield from csv.reader(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline=""), delimiter=delimiter)


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """Rows of the first sheet of a workbook. Cells are text as stored: shared and inline strings, numbers,
    booleans as TRUE and FALSE; dates are their day numbers, as formats are not looked at."""
    plain = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if plain(t) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ElementTree.iterparse(f):
                    if plain(e) == "si":
                        shared.append(text(e))
                        e.clear()
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet") and n.endswith(".xml")), key=lambda n: (len(n), n))
        if not sheets:
            return
        with z.open(sheets[0]) as f:
            for _, row in ElementTree.iterparse(f):
                if plain(row) != "row":
                    continue
                cells: dict[int, str] = {}
                for c in row:
                    at = 0
                    for letter in c.get("r", ""):
                        if letter.isalpha():
                            at = at * 26 + ord(letter.upper()) - 64
                    kind = c.get("t")
                    value = text(c) if kind == "inlineStr" else next((v.text or "" for v in c if plain(v) == "v"), "")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells[at - 1 if at else len(cells)] = value
                row.clear()
                yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]


def _from_members(spark: SparkSession, path: str, rows: Callable[[bytes], Iterator[list[str]]], chunk: int = 10_000) -> DataFrame:
    """Files that have to be opened as a whole, parsed where their bytes are; rows leave in chunks."""
    import pandas as pd

    try:
        files = spark.read.format("binaryFile").load(path).select("content")
    except Exception as e:
        raise DatasetError(f"cannot read {path}: {str(e)[:200]}") from e
    first = files.limit(1).collect()
    try:
        columns = N.normalise_header(next(rows(bytes(first[0]["content"])), [])) if first else []
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise DatasetError(f"cannot read {path}: {e}") from e
    if not columns:
        raise DatasetError(f"{path} is empty")
    width = len(columns)

    def parse(batches):
        for b in batches:
            for content in b["content"]:
                lines = rows(content)
                next(lines, None)
                while part := [(r + [None] * width)[:width] for r in islice(lines, chunk)]:
                    yield pd.DataFrame(part, columns=columns, dtype=object)

    return files.mapInPandas(parse, T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A dense index in input order: counts a partition, their running sum, and places inside."""
    tagged = df.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    starts = tagged.groupBy("__part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")
    # monotonically_increasing_id restarts at the partition's number times 2^33
    return tagged.join(F.broadcast(starts), "__part").withColumn(name, F.col("before") + F.col("__at") - F.shiftleft(F.col("__part").cast("long"), 33)).drop("__part", "__at", "before")


def admitted(df: DataFrame) -> DataFrame:
    """Without blank, control and metadata rows of an all-string table."""
    cells = [F.coalesce(X.trimmed(F.col(f"`{c}`")), F.lit("")) for c in df.columns]
    filled = F.size(F.filter(F.array(*cells), lambda x: x != ""))
    first = F.lower(cells[0])
    control = (filled == 1) & (first.startswith("--") | F.greatest(*[F.contains(first, F.lit(m)).cast("int") for m in CONTROL_MARKS]).cast("boolean"))
    meta = F.exists(F.array(*[F.lower(c) for c in cells]), lambda x: x.rlike(r"^\W*(" + "|".join(METADATA_MARKS) + r")\b|\bstop:"))
    return df.where((filled > 0) & ~control & ~meta)


def without_running_totals(df: DataFrame, numeric: list[str], row_id: str = "row_id") -> DataFrame:
    """Drop rows that repeat the sums of the rows before them.

    A row after the eighth with few cells counts if at least two, and three quarters, of its numbers
    equal the column's sum so far. Dropping one changes later sums, so passes repeat until none is
    found; sums run over blocks of rows with carried totals.
    """
    present = [c for c in numeric if c in df.columns]
    if not present:
        return df
    while True:
        block = F.floor(F.col(row_id) / 100_000)
        parsed = df.withColumns({f"__{c}": X.parse_number(F.col(f"`{c}`")) for c in present} | {"__b": block})
        heads = parsed.groupBy("__b").agg(F.count("*").alias("n"), *[F.sum(f"__{c}").alias(f"s_{c}") for c in present])
        earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = heads.select("__b", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), *[F.coalesce(F.sum(f"s_{c}").over(earlier), F.lit(0.0)).alias(f"c_{c}") for c in present])
        inside = Window.partitionBy("__b").orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1)
        wide = parsed.join(F.broadcast(carry), "__b")
        tests, known = [], []
        for c in present:
            total = F.col(f"c_{c}") + F.coalesce(F.sum(f"__{c}").over(inside), F.lit(0.0))
            tests.append(F.when(F.abs(F.col(f"__{c}") - total) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(total)), 1).otherwise(0))
            known.append(F.when(F.col(f"__{c}").isNotNull(), 1).otherwise(0))
        hits, have = sum(tests, F.lit(0)), sum(known, F.lit(0))
        filled = F.size(F.filter(F.array(*[X.missing_to_null(F.col(f"`{c}`")) for c in df.columns if c != row_id]), lambda x: x.isNotNull()))
        seen = F.col("__n") + F.count(F.lit(1)).over(inside)
        bad = (seen >= 8) & (filled <= max(3, len(df.columns) // 3)) & (hits >= 2) & (hits * 4 >= have * 3)
        marked = wide.withColumn("__bad", bad)
        if not marked.where("__bad").limit(1).count():
            return df
        df = materialised(marked.where(~F.col("__bad")).select(*df.columns), "rows")


def infer_types(df: DataFrame, overrides: dict[str, str] | None = None, numbers: str = "auto", dates: str = "auto") -> dict[str, str]:
    """numeric, datetime or categorical for each all-string column, from one conditional count.

    Integer thresholds: 80 % numbers, 80 % dates (60 % under a date-like name), three at least.
    """
    # One row a cell, so that the parsers are compiled once, whatever the number of columns.
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(N.is_date_like(c)).alias("dated"), F.col(f"`{c}`").alias("v")) for c in df.columns])).alias("x")
    v = X.missing_to_null(F.col("x.v"))
    parsed = df.select(cells).select("x.c", "x.dated", v.alias("v")).select("c", "dated", "v", X.parse_number(F.col("v"), numbers).isNotNull().alias("n"), X.parse_datetime(F.col("v"), dates).isNotNull().alias("d"), F.coalesce(X.looks_numeric(F.col("v")), F.lit(False)).alias("l"))
    number = F.col("n") & ~(F.col("dated") & F.col("d"))
    date = F.col("d") & (F.col("dated") | ~F.col("n") & ~F.col("l"))
    found = parsed.groupBy("c").agg(F.count("v").alias("m"), F.count_if(number).alias("num"), F.count_if(date).alias("date"), F.count_if(~F.col("n") & ~(F.col("dated") & F.col("d")) & F.col("l")).alias("like")).collect()
    row = {r["c"]: r for r in found} or {c: {"m": 0, "num": 0, "date": 0, "like": 0} for c in df.columns}
    out = {}
    for c in df.columns:
        s = row[c]
        forced = (overrides or {}).get(c) or (overrides or {}).get(c.lower())
        if forced:
            out[c] = forced
        elif N.is_date_like(c) and s["date"] >= max(3, 6 * s["m"] // 10):
            out[c] = "datetime"
        elif s["num"] >= max(3, 8 * s["m"] // 10):
            out[c] = "numeric"
        elif s["like"] >= max(3, 9 * s["m"] // 10) and s["num"] >= max(2, s["m"] // 3):
            out[c] = "numeric"
        elif s["date"] >= max(3, 8 * s["m"] // 10):
            out[c] = "datetime"
        else:
            out[c] = "categorical"
    return out


def typed(df: DataFrame, types: dict[str, str], numbers: str = "auto", dates: str = "auto") -> DataFrame:
    def cast(c: str) -> Column:
        v = X.missing_to_null(F.col(f"`{c}`"))
        kind = types.get(c)
        if kind == "numeric":
            return F.coalesce(X.parse_number(v, numbers), X.coerce_number(v, numbers))
        return X.parse_datetime(v, dates) if kind == "datetime" else v

    return df.select(*[cast(c).alias(c) if c in types else F.col(f"`{c}`") for c in df.columns])


def load(spark: SparkSession, path: str, delimiter: str = ",", overrides: dict[str, str] | None = None, numbers: str = "auto", dates: str = "auto") -> DataFrame:
    """Any supported input as a typed frame with a dense row_id."""
    if path.lower().rstrip("/").endswith((".parquet", ".orc")):
        kind = "orc" if path.lower().rstrip("/").endswith(".orc") else "parquet"
        return with_row_id(spark.read.format(kind).load(path))
    raw = admitted(read_text_table(spark, path, delimiter))
    types = infer_types(raw, overrides, numbers, dates)
    numbered = without_running_totals(with_row_id(raw), [c for c, t in types.items() if t == "numeric"])
    return typed(numbered, types, numbers, dates)


def repair_width(cells: list[str], width: int, numeric: set[int], dates: set[int]) -> list[str]:
    """A row with too many cells: merge the neighbours whose joined cell suits its column best."""
    import re

    def value(cell: str, i: int) -> int:
        score = 0
        if re.fullmatch(r"[+-]?[\d.,]+%?", cell.strip()):
            score += 4 if i in numeric else 0
        if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}( .*)?|\d{1,2}/\d{1,2}/\d{4}", cell.strip()):
            score += 3 if i in dates else 0
        return score

    row = list(cells)
    while len(row) > width:
        def merged(i: int) -> list[str]:
            return row[:i] + [row[i] + "," + row[i + 1]] + row[i + 2 :]

        best = max(range(len(row) - 1), key=lambda i: (sum(value(c, j) for j, c in enumerate(merged(i)[:width])) + (row[i][-1:].isdigit() and row[i + 1][:1].isdigit()), -i))
        row = merged(best)
    return row + [""] * (width - len(row))


# -- sinks --


def safe_path(path: str, workspace: str = ".") -> Path:
    """A path inside the workspace; traversal, roots and outside places are refused."""
    raw = unquote(urlparse(path).path if path.startswith("file:") else path)
    if not raw.strip():
        raise OutputError("path must not be empty")
    if ".." in Path(raw).parts:
        raise OutputError("path must not contain traversal segments")
    base = Path(workspace).resolve()
    full = (base / raw).resolve() if not os.path.isabs(raw) else Path(raw).resolve()
    if full == Path(full.anchor):
        raise OutputError("path must not be a file system root")
    if full != base and base not in full.parents:
        raise OutputError("path must resolve inside workspace")
    return full


def write_csv(df: DataFrame, path: str, epoch: bool = False) -> None:
    """Missing cells empty, quotes as apostrophes, numbers with six decimals, times as ISO text or
    epoch seconds."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.format_string("%.6f", c)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.unix_timestamp(c).cast("string") if epoch else F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return F.replace(c.cast("string"), F.lit('"'), F.lit("'"))

    df.select(*[F.when(F.col(f"`{f.name}`").isNotNull(), text(f)).alias(f.name) for f in df.schema]).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Non-finite numbers as null."""
    clean = {f.name: F.when(F.abs(F.col(f"`{f.name}`")) < float("inf"), F.col(f"`{f.name}`")) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    df.withColumns(clean).write.mode("overwrite").parquet(path)

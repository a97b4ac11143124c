"""Shared plumbing: scratch tables, per-block sidecar files and column helpers.

Scratch data lives under ``spark.checkpoint.dir``, which driver and executors share; a
local folder is set only where the session has none (tests, notebooks).
"""

from __future__ import annotations

import ctypes
import functools
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points that separate words in every contract: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows handed to a Python worker at a time; texts may be long, so batches stay short.
BATCH_ROWS = 1000


def ship(module_name: str) -> None:
    """Pickle the module's functions by value, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that long texts do not exhaust a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    path = f"{base.rstrip('/')}/quillon-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Scratch folders of this process that are not deleted yet.
_made: list[str] = []


def mark() -> int:
    """A point for :func:`clear`."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch folders made since a mark, but those that hold the frames to keep. Nothing that
    is still to be computed may read the others."""
    kept = {getattr(df, "_quillon_path", None) for df in keep}
    gone = [p for p in _made[since:] if p and p not in kept]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _made[since:] = [p for p in _made[since:] if p in kept]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables made by :func:`saved` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            if path in _made:
                _made[_made.index(path)] = ""  # marks are places in the list


def file_system(uri: str):
    """pyarrow's file system and path for a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def put_file(uri: str, name: str, frames: list[bytes]) -> None:
    """Write length-prefixed frames under a private name, then rename: retries are harmless."""
    filesystem, path = file_system(uri)
    filesystem.create_dir(path, recursive=True)
    private = f"{path}/.{name}-{uuid.uuid4().hex}"
    with filesystem.open_output_stream(private) as out:
        for x in frames:
            out.write(len(x).to_bytes(8, "little"))
            out.write(x)
    filesystem.move(private, f"{path}/{name}")


def get_file(uri: str, name: str) -> list[bytes]:
    """The frames of a file, or none if it does not exist."""
    filesystem, path = file_system(uri)
    if filesystem.get_file_info(f"{path}/{name}").type.name == "NotFound":
        return []
    with filesystem.open_input_stream(f"{path}/{name}") as src:
        data = src.read()
    frames, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        frames.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return frames


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))

def records(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a flat Spark DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().rsplit(" ", 1) for x in ddl.split(","))])

def resting(kernel):
    """A kernel whose worker hands unused memory back once its partition is done: workers stay for
    later tasks, beside an executor's heap."""

    @functools.wraps(kernel)
    def run(*args):
        yield from kernel(*args)
        rest()

    return run


def rest() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to hand back by hand


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast a thin table only when it is counted to hold at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name in df.columns:
        name += "_"
    return name

def text_hash(text_col: str):
    """What tells rows with one id apart; null is not the empty text."""
    return F.xxhash64(F.col(f"`{text_col}`"))

def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows (id, text_hash) of ``gone``, with all columns. A short, counted list
    meets the rows where they are; a longer one joins by both columns."""
    i, h = fresh(docs, "gone_id"), fresh(docs, "gone_hash")
    named = gone.select(F.col("id").alias(i), F.col("text_hash").alias(h)).distinct()
    listed = saved(named, "gone")
    return docs.join(broadcast_if_small(listed), F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (text_hash(text_col) == F.col(h)), "left_anti")

def is_long(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.LongType)

# -- lists that blocks (partitions of one scan) find next to their rows --
#
# A first scan tags rows with their partition and a hash of their raw text. What a later scan must
# know about some of them is written as one file a block in the shared folder, so neither texts are
# shuffled to it nor is it sent through the driver. Each file holds the count and xor of the hashes
# its block had: a scan that was split otherwise fails on that check, and callers fall back to a join.

class BlocksChanged(RuntimeError):
    """The second scan's partitions are not those of the first."""

def raw_id(text: str | bytes | None) -> int:
    import xxhash

    n = xxhash.xxh3_64_intdigest(text or b"")
    return n - (1 << 64) if n >> 63 else n

def write_blocks(rows: DataFrame, wanted: DataFrame, name: str) -> str:
    """``rows`` (block, rid): every row of the scan. ``wanted`` (block, rid, payload array of longs)."""
    uri = scratch(rows.sparkSession, name)
    heads = rows.groupBy("block").agg(F.count("*").alias("n"), F.bit_xor("rid").alias("x")).select("block", F.lit(None).cast("long").alias("rid"), F.array("n", "x").alias("payload"))
    both = heads.unionByName(wanted.select("block", "rid", "payload")).repartition("block").sortWithinPartitions("block", F.asc_nulls_first("rid"))
    both.mapInArrow(lambda it: _store_blocks(it, uri), "done int").agg(F.count("*")).collect()
    return uri

def _store_blocks(batches, uri: str):
    import numpy as np

    now, frames = None, []
    for b in batches:
        for block, rid, payload in zip(*(b.column(c).to_pylist() for c in ("block", "rid", "payload")), strict=True):
            if block != now:
                if frames:
                    put_file(uri, f"block-{now}", frames)
                now, frames = block, []
            frames += [b"" if rid is None else rid.to_bytes(8, "little", signed=True), np.array(payload, np.int64).tobytes()]
    if frames:
        put_file(uri, f"block-{now}", frames)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])

class Block:
    """This task's list: ``take(rid)`` gives a row's payload once; ``close`` checks the block."""

    def __init__(self, uri: str):
        import numpy as np

        frames = get_file(uri, f"block-{partition_id()}")
        self.payload = {int.from_bytes(frames[i], "little", signed=True): np.frombuffer(frames[i + 1], np.int64) for i in range(2, len(frames), 2)}
        head = np.frombuffer(frames[1], np.int64) if frames else np.zeros(2, np.int64)
        self.left, self.xor = int(head[0]), int(head[1])

    def take(self, rid: int):
        self.left -= 1
        self.xor ^= rid
        return self.payload.pop(rid, None)

    def close(self) -> None:
        if self.left or self.xor:
            raise BlocksChanged("BLOCKS_CHANGED: the input was split otherwise than in the first scan")

def blocks_changed(error: Exception) -> bool:
    return "BLOCKS_CHANGED" in str(error)

"""Exact dedup by Golomb-coded fingerprint exchange.

1. Every input partition ("block") hashes its normalised texts, sorts the fingerprints, and
   sends each owner of a fingerprint range one Golomb-Rice coded list.
2. Owners merge the lists and answer each block with a bitmap: bit i says that the i-th
   fingerprint of the list occurs more than once. The answers are written as one sidecar file a
   block in the shared folder, so no fingerprint passes through the driver.
3. Blocks scan their rows again next to their answer. Rows whose fingerprint is unique are
   settled; only suspects ship their text, and the grouping by whole text is the byte check.

A row whose fingerprint is missing from its block's answer (the input was split another way the
second time, as after a lost executor) counts as a suspect, so results never depend on layout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_schema, records, resting, saved, scratch, ship, text_hash, tune, without_rows

ship(__name__)

#: Bits of a fingerprint. Accidental equals cost a byte check, never a wrong result.
FP_BITS = 56
#: Most owners of fingerprint ranges; each holds about rows / owners fingerprints at once.
MAX_OWNERS = 4096

_SENT = "block int, owner int, n int, coded binary, repeated binary"
_ANSWER = "block int, owner int, n int, coded binary, bitmap binary"
_MARKED = "id long, text_hash long, fp long, sha string, text binary"


def golomb_encode(values: np.ndarray, low: int, span: int) -> bytes:
    """Sorted distinct integers in [low, low + span) as one Golomb-Rice coded list."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=low)
    shift = max(0, (span // n).bit_length() - 1)
    ends = np.cumsum((gaps >> shift) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low_bits = ((gaps[:, None] >> np.arange(shift)) & 1).astype(np.uint8)
    return bytes([shift]) + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low_bits).tobytes()


def golomb_decode(coded: bytes, n: int, low: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    shift, length = coded[0], int.from_bytes(coded[1:9], "little")
    cut = 9 + (length + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(coded[9:cut], np.uint8), count=length))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << shift
    if shift:
        bits = np.unpackbits(np.frombuffer(coded[cut:], np.uint8), count=n * shift).reshape(n, shift)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(shift, dtype=np.int64))
    return low + np.cumsum(gaps)


def normalised(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return [(x or b"").lower() for x in texts.cast(pa.large_binary()).to_pylist()]


def fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[: FP_BITS // 8], "big")


@resting
def send(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    found = [fingerprint(hashlib.sha256(x).digest()) for b in batches for x in normalised(b.column(0))]
    values, counts = np.unique(np.array(found, np.int64), return_counts=True)
    span = -(-(1 << FP_BITS) // owners)
    cuts = np.searchsorted(values, np.arange(owners + 1, dtype=np.int64) * span)
    rows: dict[str, list] = {k: [] for k in ("block", "owner", "n", "coded", "repeated")}
    for o in range(owners):
        a, b = cuts[o], cuts[o + 1]
        if a < b:
            for k, v in zip(rows, (common.partition_id(), o, int(b - a), golomb_encode(values[a:b], o * span, span), np.packbits(counts[a:b] > 1).tobytes()), strict=True):
                rows[k].append(v)
    yield records(rows, arrow_schema(_SENT))


def answer(table: pa.Table, owners: int) -> pa.Table:
    """An owner: which fingerprints of each list occur twice or more in all lists together."""
    span = -(-(1 << FP_BITS) // owners)
    rows = table.to_pylist()
    lists = [golomb_decode(r["coded"], r["n"], r["owner"] * span) for r in rows]
    _, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    more, at = counts[inverse] > 1, 0
    out: dict[str, list] = {k: [] for k in ("block", "owner", "n", "coded", "bitmap")}
    for r in rows:
        own_flags = np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool)
        for k in ("block", "owner", "n", "coded"):
            out[k].append(r[k])
        out["bitmap"].append(np.packbits(more[at : at + r["n"]] | own_flags).tobytes())
        at += r["n"]
    return pa.Table.from_batches([records(out, arrow_schema(_ANSWER))])


def store_answers(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by block; each block's answers become one file."""
    now, frames = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["block"] != now:
                if frames:
                    common.put_file(uri, f"block-{now}", frames)
                now, frames = r["block"], []
            frames += [r["owner"].to_bytes(4, "little") + r["n"].to_bytes(4, "little"), r["coded"], r["bitmap"]]
    if frames:
        common.put_file(uri, f"block-{now}", frames)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])


def load_answers(uri: str, block: int, owners: int) -> tuple[np.ndarray, np.ndarray]:
    span = -(-(1 << FP_BITS) // owners)
    frames, values, flags = common.get_file(uri, f"block-{block}"), [], []
    for i in range(0, len(frames), 3):
        owner, n = int.from_bytes(frames[i][:4], "little"), int.from_bytes(frames[i][4:], "little")
        values.append(golomb_decode(frames[i + 1], n, owner * span))
        flags.append(np.unpackbits(np.frombuffer(frames[i + 2], np.uint8), count=n).astype(bool))
    if not values:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    values, flags = np.concatenate(values), np.concatenate(flags)
    order = np.argsort(values)
    return values[order], flags[order]


@resting
def mark(batches: Iterator[pa.RecordBatch], uri: str, owners: int) -> Iterator[pa.RecordBatch]:
    values, flags = load_answers(uri, common.partition_id(), owners)
    for b in batches:
        texts = normalised(b.column(1))
        digests = [hashlib.sha256(x) for x in texts]
        fps = np.array([fingerprint(d.digest()) for d in digests], np.int64)
        at = np.minimum(np.searchsorted(values, fps), max(0, len(values) - 1))
        suspect = np.ones(len(fps), bool) if not len(values) else (values[at] != fps) | flags[at]
        yield records({"id": b.column(0).to_pylist(), "text_hash": b.column(2).to_pylist(), "fp": fps, "sha": [d.hexdigest() for d in digests], "text": [t if s else None for t, s in zip(texts, suspect, strict=True)]}, arrow_schema(_MARKED))


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, keep_id, group_size, sha of every row."""
    spark = docs.sparkSession
    tune(spark)
    began = common.mark()
    # The same columns in both passes, so that files are split alike.
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), text_hash(text_col).alias("text_hash"))
    blocks = max(1, thin.rdd.getNumPartitions())
    owners = max(1, min(MAX_OWNERS, blocks // 4))
    uri = scratch(spark, "answers")
    sent = thin.mapInArrow(lambda it: send((b.select([1]) for b in it), owners), _SENT)
    answers = sent.groupBy("owner").applyInArrow(lambda t: answer(t, owners), _ANSWER)
    stored = answers.repartition("block").sortWithinPartitions("block", "owner").mapInArrow(lambda it: store_answers(it, uri), "done int")
    stored.agg(F.count("*")).collect()
    marked = saved(thin.mapInArrow(lambda it: mark(it, uri, owners), _MARKED), "marked")
    common.clear(spark, began, (marked,))
    classes = (
        marked.where(F.col("text").isNotNull())
        .groupBy("fp", "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.first("sha").alias("sha"))
        .select("fp", "sha", "keep_id", "group_size")
    )
    rows = marked.select("id", "text_hash", "fp", "sha", F.col("text").isNotNull().alias("suspect"))
    single = rows.where(~F.col("suspect")).select("id", "text_hash", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    several = rows.where("suspect").join(classes, ["fp", "sha"]).select("id", "text_hash", "keep_id", "group_size", "sha")
    return single.unionByName(several)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Of equal texts the largest id
    stays. Null text counts as empty, so null and empty texts form one group; a null id never
    wins over another id, and where a group has only null ids its rows get keep_id null and all
    stay. Rows that repeat id and text count as one document: each of them is kept or none. An
    empty table gives an empty result; extra columns are ignored.
    """
    return _decided(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null and empty texts are one group, of which the largest id stays; rows with a null id go where an id is in
    their group and stay where none is. Rows that repeat id and text stay or go together; a row
    whose id is the largest but whose text differs in case from another row of that id stays beside it. An
    empty table stays empty; extra columns may have any names."""
    return without_rows(docs, _decided(docs, id_col, text_col).where(~F.col("id").eqNullSafe(F.col("keep_id"))), id_col, text_col)

"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised next to their text, so only piece lengths are shuffled. Pieces are dealt
by hash into groups of about a quarter million documents, each packed on its own: a group holds
some 10^5 sequences, so what local packing gives away is at most one open sequence a group.
Inside a group work goes by length class, so one pattern fills many sequences in one step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, records, resting, ship, tune

ship(__name__)

CAPACITY = 2048
END_ID = 0
#: Gaps below this are left: two short documents fill more elsewhere.
MIN_GAP = 2
#: Documents in a packing group, on average.
GROUP_DOCS = 250_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"

#: The pre-tokeniser pattern and byte alphabet of byte-level BPE vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class FastTokenizer:
    """Ids of a byte-level BPE ``tokenizer.json``, found by tiktoken's faster merge loop.

    Vocabulary, merge order (a token's id is its rank) and special tokens come from that one
    file; tests hold the ids against the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as src:
            spec = json.load(src)
        rest = [b for b in range(256) if b not in PLAIN_BYTES]
        byte = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.model = tiktoken.Encoding("from_json", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        return self.model.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first of several may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


@resting
def pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = FastTokenizer(path)
    schema = arrow_schema(_PIECES + ", ids binary" * with_ids)
    end = END_ID.to_bytes(4, "little")
    for b in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = tokenizer.encode(text or "") + end
            for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                part = ids[4 * start : 4 * (start + length)]
                for name, value in zip(rows, (doc, k, start, length, zlib.crc32(part), part), strict=False):
                    rows[name].append(value)
        yield records(rows, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length. Where lengths lie so close together that exchanges take
    the short documents that others need, the fill without them is returned, if it needs fewer bins;
    on the lengths of real tables exchanges never lost."""
    both = [fill_bins(lengths, capacity, exchange) for exchange in (True, False)]
    return min(both, key=lambda found: int(found[0].max(initial=-1)))


def fill_bins(lengths: np.ndarray, capacity: int, exchange: bool) -> tuple[np.ndarray, np.ndarray]:
    """A bin takes the longest unpacked document that fits until none does. Then, with ``exchange``, if
    MIN_GAP tokens or more are open and two unpacked documents fill the space of its smallest document
    and the gap more tightly, they replace it."""
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    taken = np.concatenate([[0], np.cumsum(count)])[:-1].copy()  # next place of each length in order
    below = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))  # longest available up to x
    below[0] = 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(x: int, n: int) -> None:
        count[x] -= n
        if not count[x]:
            tail = below[x:]
            stop = int(np.argmax(tail != x)) or len(tail)
            tail[:stop] = below[x - 1]

    def give_back(x: int) -> None:
        count[x] += 1
        if count[x] == 1:
            tail = below[x:]
            stop = int(np.argmax(tail > x)) if tail[-1] > x else len(tail)
            tail[:stop] = x

    left, at = len(lengths), 0
    while left:
        chosen, gap = [], capacity
        while x := int(below[gap]):
            chosen.append(x)
            take(x, 1)
            gap -= x
        if exchange and gap >= MIN_GAP and len(chosen) > 1:
            room = gap + chosen[-1]
            one = np.unique(below[1 : room + 1])
            one = one[one > 0]
            if len(one):
                two = below[room - one]
                two = np.where((two == one) & (count[one] < 2), below[one - 1], two)
                both = np.where(two > 0, one + two, 0)
                k = int(np.argmax(both))
                if both[k] > chosen[-1]:
                    give_back(chosen.pop())
                    for x in (int(one[k]), int(two[k])):
                        chosen.append(x)
                        take(x, 1)
        kinds, uses = np.unique(chosen, return_counts=True)
        more = int((count[kinds] // uses).min())
        for x, n in zip(kinds.tolist(), uses.tolist(), strict=True):
            if more:
                take(x, more * n)
        offset = 0
        for x in chosen:
            # the copies of this pattern take their k-th documents side by side
            rows = order[taken[x] : taken[x] + more + 1]
            bins[rows], offsets[rows] = np.arange(at, at + more + 1), offset
            taken[x] += more + 1
            offset += x
        at += more + 1
        left -= (more + 1) * len(chosen)
    return bins, offsets


def pack_group(table: pa.Table, capacity: int, schema: pa.Schema) -> pa.Table:
    lengths = table.column("length").to_numpy()
    bins, offsets = best_two_fit(lengths, capacity)
    group = np.int64(table.column("grp")[0].as_py())
    out = table.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 36) | bins)).append_column("offset", pa.array(offsets))
    return out.select(schema.names).cast(schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its token ids and a closing id 0; null text counts as empty, so it is that one
    id. Null ids and repeated rows are packed like any others. Only documents longer than a
    sequence are cut. An empty table gives an empty result; extra columns are ignored.
    """
    tune(docs.sparkSession)
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    schema = _PIECES + ", ids binary" * with_ids
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    cut_up = thin.mapInArrow(lambda it: pieces(it, tokenizer, capacity, with_ids), schema)
    # The row's number keeps rows that repeat id and text from filling one group.
    dealt = cut_up.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = schema + ", sequence_id long, offset long"
    shape = arrow_schema(packed)
    return dealt.groupBy("grp").applyInArrow(lambda t: pack_group(t, capacity, shape), packed)

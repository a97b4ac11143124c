"""Minimax contiguous partition of ordered atomic groups into shards.

Groups of equal texts are ordered by a 64-bit hash of the text and stay together. The smallest
capacity that cuts the order into at most k runs is found by binary search with a greedy check.
The check needs prefix sums only where a cut falls, so the driver keeps a tree of range sums
(4096 children a node) and asks Spark for a node's children only when a check depends on them:
what it holds is bounded by cuts x depth x 4096 sums, whatever the number of groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, ship, text_or_empty, tune

ship(__name__)

BITS = 12
_TOP = -(1 << 63)


@dataclass
class Node:
    """A range of hashes: its bytes, where they end in the order, and its children if known."""

    path: int
    depth: int
    size: int
    last: int  # largest hash in the range
    single: bool  # one group only
    children: list["Node"] = field(default_factory=list)


class RangeSums:
    """Prefix sums over ordered groups, fetched level by level."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("h", "size", F.col("h").bitwiseXOR(F.lit(_TOP)).alias("u"))
        self.root = Node(0, 0, 0, 0, False)
        self.fetch([self.root])
        self.root.size = sum(x.size for x in self.root.children)

    def fetch(self, nodes: list[Node]) -> None:
        for depth in {n.depth for n in nodes}:
            here = {n.path: n for n in nodes if n.depth == depth}
            width = min(64, BITS * (depth + 1))
            child = F.shiftrightunsigned("u", 64 - width)
            step = width - BITS * depth
            part = self.rows.withColumn("child", child)
            if depth:
                part = part.where(F.shiftrightunsigned("u", 64 - BITS * depth).isin(list(here)))
            found = part.groupBy("child").agg(F.sum("size").alias("size"), F.max("h").alias("last"), F.min("h").alias("first")).collect()
            for r in sorted(found, key=lambda r: r["last"]):
                parent = here[r["child"] >> step if depth else 0]
                parent.children.append(Node(r["child"], depth + 1, r["size"], r["last"], r["first"] == r["last"]))

    def before(self, limit: int) -> tuple[int, int | None, Node | None]:
        """The last known group end at or before ``limit``: its bytes, its hash, and the node to
        open if a later end may lie inside it."""
        node, done, last = self.root, 0, None
        while True:
            if not node.children:
                return done, last, node
            for child in node.children:
                if done + child.size > limit:
                    break
                done, last = done + child.size, child.last
            else:
                return done, last, None
            if child.single:
                return done, last, None
            node = child


def fits(sums: RangeSums, capacity: int, shards: int, start: int = 0) -> bool:
    """Greedy check from ``start``. Unopened nodes give ends that are too early, never too late,
    so a fit is certain, and a misfit is once no unopened node was met."""
    while True:
        end, unknown = start, []
        for _ in range(shards):
            done, _, node = sums.before(end + capacity)
            end = max(end, done)
            unknown += [node] if node else []
        if end >= sums.root.size:
            return True
        if not unknown:
            return False
        sums.fetch(list({id(n): n for n in unknown}.values()))


def cut_points(sums: RangeSums, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and the last hash of each shard but the last."""
    total = sums.root.size
    if not total:
        return 0, []
    low, high = -(-total // shards) - 1, total
    while high - low > 1:
        mid = (low + high) // 2
        if fits(sums, mid, shards):
            high = mid
        else:
            low = mid
    ends, start = [], 0

    def advance(limit: int) -> tuple[int, int | None]:
        while True:
            done, last, node = sums.before(limit)
            if not node:
                return done, last
            sums.fetch([node])

    for left in range(shards, 1, -1):
        # level the shards as far as the capacity allows: aim at the mean of what is left
        done, last = advance(start + -(-(total - start) // left))
        if done <= start or not fits(sums, high, left - 1, done):
            done, last = advance(start + high)
        if last is not None and done > start:
            ends.append(last)
            start = done
    return high, ends


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes plus 1) are as near equal as whole groups of equal
    texts allow, and the largest shard is the smallest possible for this order. Null text counts
    as empty; null ids and repeated rows are rows like any others. A group larger than the mean
    fills a shard alone; with fewer groups than shards some shards stay empty. An empty table
    gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    text = text_or_empty(f"`{text_col}`")
    rows = saved(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("h"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "sizes",
    )
    _, ends = cut_points(RangeSums(rows), shards)
    number = sum((F.when(F.col("h") > e, 1).otherwise(0) for e in ends), F.lit(0))
    placed = rows.withColumn("shard", number.cast("int"))
    # Slots run through (part, uid): places inside a part by a window bounded by the part's size,
    # and the parts' starts by running sums of their counts.
    starts = (
        placed.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n"))
        .drop("n")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("inside") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )

"""MinHash near-dedup with tensored banding.

A document's shingle set gives two small collections of GROUPS bands, each over BAND minhashes.
Table keys are all pairs (band i of the first, band j of the second): GROUPS^2 tables of 2 * BAND
minhashes each from 2 * GROUPS * BAND minhashes in all, about the square root of what independent
tables need. With 8 and 2, that is 64 tables from 32 minhashes.

Texts with equal sets share one node. Nodes that share a key hang on the key's least node (a star,
linear in the rows of a key), stars grow into clusters, and inside clusters every pair that agrees
in enough bands is confirmed on full shingle sets. A cluster of one block is one task's. In larger
ones each node is first compared with a few of its stars' centres, which is linear; what hangs
together then needs no further comparison among itself, so only blocks of different parts meet, two
at a time. A task holds two blocks at most whatever a cluster's size, and returns a spanning forest of
the confirmed links, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import arrow_schema, discard, records, resting, saved, ship, text_hash, tune, without_rows
from .components import components

ship(__name__)

GROUPS = 8
BAND = 2
#: Bands (of 2 * GROUPS) that a pair in one cluster must share before its sets are compared. At
#: similarity 0.8 a pair shares 10 on average, and fewer than 3 with probability 3e-5.
MIN_BANDS = 3
#: A block of a cluster: nodes and shingles.
BLOCK_NODES = 4096
BLOCK_SHINGLES = 1 << 21
#: Star centres that a node of a larger cluster is compared with first.
CENTRES = 3
#: Bytes of text hashed in one numpy pass.
SLAB_BYTES = 1 << 20

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_SIGS = "doc_id long, text_hash long, block int, rid long, n_shingles long, node long, bands array<long>"
_SETS = "node long, members binary"
_EDGES = "u long, v long"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _RADIX + _U(seed)) | _U(1)


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class WordHashes:
    """64-bit hashes of the words of texts, from differences of one running polynomial."""

    def __init__(self):
        self.power = self.unpower = np.ones(1, _U)

    def prepare(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, SLAB_BYTES + 1)
            self.power = np.full(size, _RADIX, _U)
            self.unpower = np.full(size, _U(inverse(int(_RADIX))), _U)
            self.power[0] = self.unpower[0] = 1
            np.multiply.accumulate(self.power, out=self.power)
            np.multiply.accumulate(self.unpower, out=self.unpower)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Texts are lower-cased bytes; words are runs outside space and \\x09-\\x0D."""
        slab = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.prepare(len(slab))
        inside = (slab != 32) & ((slab < 9) | (slab > 13))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        starts, ends = edge[::2], edge[1::2]
        total = np.concatenate([np.zeros(1, _U), np.cumsum((slab.astype(_U) + _U(1)) * self.power[: len(slab)], dtype=_U)])
        words = mix((total[ends] - total[starts]) * self.unpower[starts])
        limits = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
        return np.split(words, limits)


_STEPS = constants(64, 1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle, no words none."""
    n = len(words)
    if not n:
        return words
    if n < k:
        steps = constants(n, 2 + n)
        return mix(np.array([(words * steps).sum(dtype=_U)], _U))
    h = words[: n - k + 1] * _STEPS[0]
    for j in range(1, k):
        h = h + words[j : n - k + 1 + j] * _STEPS[j]
    return np.unique(mix(h))


_FLIP, _TURN, _JOIN = constants(2 * GROUPS * BAND, 3), constants(2 * GROUPS * BAND, 4), constants(BAND, 5)


def bands(s: np.ndarray) -> np.ndarray:
    least = np.full(len(_FLIP), np.iinfo(_U).max, _U)
    for a in range(0, len(s), 4096):
        least = np.minimum(least, ((s[a : a + 4096, None] ^ _FLIP) * _TURN).min(axis=0))
    return mix((least.reshape(-1, BAND) * _JOIN).sum(axis=1, dtype=_U)).view(np.int64)


def slabs(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLAB_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def lowered(column: pa.Array) -> list[bytes]:
    return [(x or b"").lower() for x in column.cast(pa.large_binary()).to_pylist()]


def sets_of(texts: list[bytes], hashes: WordHashes, k: int) -> Iterator[np.ndarray]:
    for part in slabs(texts):
        for words in hashes.of(part):
            yield shingle_set(words, k)


def node_of(s: np.ndarray) -> int:
    return int(np.int64(_U(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)))


@resting
def signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes, schema = WordHashes(), arrow_schema(_SIGS)
    for b in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        texts = lowered(b.column(1))
        for doc, mark, text, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), texts, sets_of(texts, hashes, k), strict=True):
            values = (doc, mark, common.partition_id(), common.raw_id(text), len(s), node_of(s) if len(s) else None, bands(s) if len(s) else None)
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        yield records(rows, schema)


@resting
def full_sets(batches: Iterator[pa.RecordBatch], k: int, uri: str | None) -> Iterator[pa.RecordBatch]:
    """Full sets of the listed texts, or of all where there are no block files. Column: text."""
    hashes, block = WordHashes(), common.Block(uri) if uri else None
    for b in batches:
        texts = lowered(b.column(0))
        if block:
            texts = [t for t in texts if block.take(common.raw_id(t)) is not None]
        found = [s for s in sets_of(texts, hashes, k) if len(s)]
        yield records({"node": [node_of(s) for s in found], "members": [s.tobytes() for s in found]}, arrow_schema(_SETS))
    if block:
        block.close()


def links(nodes: np.ndarray, sides: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union. Pairs on one
    side are left to the task that has that side alone, if there are two. Nodes of one part are linked
    already; without parts, each is its own."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, nodes, sides, sigs, sets = size[order], nodes[order], sides[order], sigs[order], [sets[i] for i in order]
    n, across = len(nodes), sides.min() != sides.max()
    label, found = np.arange(n) if parts is None else np.unique(parts[order], return_inverse=True)[1], []
    reach = np.searchsorted(size, size * 100 // percent, side="right")
    flat, starts, mark = None, None, None
    for i in range(n - 1):
        a, b = i + 1, int(reach[i])
        if a >= b:
            continue
        open_ = label[a:b] != label[i]
        if across:
            open_ &= sides[a:b] != sides[i]
        open_[open_] = (sigs[a:b][open_] == sigs[i]).sum(axis=1) >= MIN_BANDS
        near = np.flatnonzero(open_) + a
        if not len(near):
            continue
        if len(near) <= 8:
            common = np.array([int((sets[j][np.minimum(np.searchsorted(sets[j], sets[i]), size[j] - 1)] == sets[i]).sum()) for j in near])
        else:
            if flat is None:
                flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
                starts = np.concatenate([[0], np.cumsum(size)])
                mark = np.zeros(int(flat.max()) + 1, bool)
            mine = flat[starts[i] : starts[i + 1]]
            mark[mine] = True
            lo, hi = int(near[0]), int(near[-1]) + 1
            common = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)[near - lo]
            mark[mine] = False
        for j in near[100 * common >= percent * (size[i] + size[near] - common)]:
            if label[j] != label[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                label[label == label[j]] = label[i]
    return found


@resting
def confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (cluster, x, y); each such key is a pair of blocks for one task."""

    def done(rows: list) -> pa.RecordBatch:
        node, side, part, sigs = (np.array([r[i] for r in rows]) for i in range(4))
        edges = links(node, side, sigs, [np.frombuffer(r[4], _U) for r in rows], percent, part)
        return records({"u": [e[0] for e in edges], "v": [e[1] for e in edges]}, arrow_schema(_EDGES))

    now, rows = None, []
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in ("cluster", "x", "y")), strict=True))
        values = zip(*(b.column(c).to_pylist() for c in ("node", "side", "part", "bands", "members")), strict=True)
        for key, value in zip(keys, values, strict=True):
            if key != now:
                if len(rows) > 1:
                    yield done(rows)
                now, rows = key, []
            rows.append(value)
    if len(rows) > 1:
        yield done(rows)


def block_count(n):
    """Blocks that nodes need: ``n`` is a column of their numbers of shingles."""
    return F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum(n) / BLOCK_SHINGLES)).cast("int")


def checked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) inside each (cluster, x, y). ``rows``: those, node, side, part, bands, members."""
    dealt = rows.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return dealt.select("cluster", "x", "y", "node", "side", "part", "bands", "members").mapInArrow(lambda it: confirm(it, percent), _EDGES)


def centre_links(large: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of large clusters and up to CENTRES of their stars' centres. A centre meets its
    nodes in as many parts as they need blocks."""
    own = large.select(F.col("node").alias("u"), "n", "bands")
    rays = saved(stars.join(own.select("u"), "u").groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", F.explode(F.slice(F.array_sort("vs"), 1, CENTRES)).alias("v")).join(own, "u"), "rays")
    parts = rays.groupBy("v").agg(block_count("n").alias("parts"))
    salted = rays.join(parts, "v").select(F.col("v").alias("cluster"), F.pmod(F.xxhash64("u"), F.col("parts")).alias("x"), F.col("u").alias("node"), F.lit(1).alias("side"), "bands")
    centres = parts.join(own.withColumnRenamed("u", "v"), "v").select(F.col("v").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("x"), F.col("v").alias("node"), F.lit(0).alias("side"), "bands")
    rows = salted.unionByName(centres).withColumn("y", F.col("x")).withColumn("part", F.col("node")).join(sets, "node")
    found = saved(checked(rows, percent), "centre_links")
    discard(rays)
    return found


def across_parts(large: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of a large cluster that ``roots`` (node, root) do not join yet. Parts that fill
    half a block have blocks of their own, which are not compared with each other; the rest is pooled."""
    parted = saved(large.join(roots, "node", "left").select("cluster", "node", "n", "bands", F.coalesce("root", "node").alias("part")), "parted")
    sums = parted.groupBy("cluster", "part").agg(block_count("n").alias("blocks"), F.greatest(F.count("*") / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES).alias("fill"))
    wide = sums.where("fill >= 0.5").select("cluster", "part", "blocks")
    pooled = parted.join(wide.select("cluster", "part"), ["cluster", "part"], "left_anti").groupBy("cluster").agg(block_count("n").alias("pool"))
    each = lambda n: F.explode(F.sequence(F.lit(1), F.col(n))).alias("i")
    own_blocks = wide.select("cluster", F.col("part").alias("owner"), each("blocks")).withColumn("block", F.xxhash64("owner", "i"))
    pool_blocks = pooled.select("cluster", F.lit(None).cast("long").alias("owner"), each("pool")).withColumn("block", F.xxhash64(F.lit("pool"), "cluster", "i"))
    blocks = saved(own_blocks.unionByName(pool_blocks).drop("i"), "blocks")
    x, y = (blocks.select("cluster", F.col("block").alias(c), F.col("owner").alias(f"{c}_owner")) for c in "xy")
    pairs = x.join(y, "cluster").where("x <= y and (x_owner is null or y_owner is null or x_owner != y_owner)")
    pairs = pairs.select("cluster", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    sized = parted.join(wide.withColumnRenamed("blocks", "own"), ["cluster", "part"], "left").join(pooled, "cluster", "left")
    in_own = F.xxhash64("part", (F.pmod(F.xxhash64("node"), F.col("own")) + 1).cast("int"))
    in_pool = F.xxhash64(F.lit("pool"), "cluster", (F.pmod(F.xxhash64("part"), F.col("pool")) + 1).cast("int"))
    placed = sized.select("cluster", "node", "bands", "part", F.when(F.col("own").isNotNull(), in_own).otherwise(in_pool).alias("block"))
    rows = placed.join(pairs, ["cluster", "block"]).withColumnRenamed("block", "side").join(sets, "node")
    found = saved(checked(rows, percent), "part_links")
    discard(parted, blocks)
    return found


def _decided(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row."""
    tune(docs.sparkSession)
    began = common.mark()
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), text_hash(text_col).alias("text_hash"))
    sigs = saved(own.mapInArrow(lambda it: signatures(it, words), _SIGS), "signatures")
    nodes = saved(sigs.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.min(F.struct("block", "rid")).alias("at")), "nodes")

    # Table keys: pairs from the two collections of bands.
    tables = nodes.select("node", "bands", F.explode(F.sequence(F.lit(0), F.lit(GROUPS * GROUPS - 1))).alias("t"))
    keys = tables.select("node", F.xxhash64("t", F.get("bands", F.expr(f"t div {GROUPS}")), F.get("bands", F.col("t") % GROUPS + GROUPS)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key", "least")
    stars = saved(keys.join(shared, "key").select(F.col("node").alias("u"), F.col("least").alias("v")).where("u != v").distinct(), "stars")
    clusters = saved(components(stars).withColumnRenamed("root", "cluster").join(nodes, "node"), "clusters")

    # Full sets of the clusters' nodes, each from one text, found where the text is.
    uri = common.write_blocks(sigs.select("block", "rid"), clusters.select("at.block", "at.rid", F.array("node").alias("payload")), "sets")
    beyond = saved(clusters.groupBy("cluster").agg(block_count("n").alias("blocks")).where("blocks > 1").select("cluster"), "large")
    large = None if beyond.isEmpty() else saved(clusters.join(common.broadcast_if_small(beyond), "cluster"), "large_clusters")
    small = clusters if large is None else clusters.join(common.broadcast_if_small(beyond), "cluster", "left_anti")

    def confirmed(sets: DataFrame) -> DataFrame:
        if large is not None:
            sets = saved(sets, "full_sets")
        zero = [F.lit(0).alias(c) for c in ("x", "y", "side")]
        found = saved(checked(small.select("cluster", "node", "bands", F.col("node").alias("part"), *zero).join(sets, "node"), percent), "links")
        if large is None:
            return found
        near = centre_links(large, stars, sets, percent)
        more = across_parts(large, components(near), sets, percent)
        discard(sets)
        return found.unionByName(near).unionByName(more)

    try:
        edges = confirmed(own.mapInArrow(lambda it: full_sets((b.select([1]) for b in it), words, uri), _SETS))
    except Exception as error:
        if not common.blocks_changed(error):
            raise
        # An input that is not split alike twice: texts meet the clusters by a join instead.
        listed = clusters.select(F.col("first_id").alias("__id")).distinct()
        texts = own.join(listed, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
        edges = confirmed(texts.mapInArrow(lambda it: full_sets(it, words, None), _SETS).dropDuplicates(["node"]))

    roots = components(edges).join(nodes.select("node", "first_id"), "node")
    least = roots.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = roots.join(least, "root").select("node", "least_id")
    leaders = saved(nodes.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("least_id", "first_id").alias("leader")), "leaders")
    common.clear(docs.sparkSession, began, (sigs, leaders))
    out = sigs.select("doc_id", "text_hash", "n_shingles", "node").join(leaders, "node", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("leader", "doc_id").alias("component_id"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their distinct ``words``-word
    shingles, A-Z lower-cased; component_id is the least doc_id that links reach. A text shorter
    than a shingle is one shingle; texts without words, and null texts, have none and link with
    nothing. A row with a null id takes its component's least id, is kept only if there is none, and
    never leads. Repeated rows have equal results. An empty table gives an empty result; extra
    columns are ignored.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return _decided(docs, words, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all their columns.

    Of a group the least id stays. Null, empty and blank texts are in no group and all stay, as do rows with a null
    id where their group has no id; rows that repeat id and text stay or go together. An empty table stays empty;
    extra columns may have any names."""
    gone = _decided(docs, words, percent, id_col, text_col).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without_rows(docs, gone.select(F.col("doc_id").alias("id"), "text_hash"), id_col, text_col)

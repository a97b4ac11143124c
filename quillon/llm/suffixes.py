"""Repeated passages by sparse suffix arrays.

Only suffixes that start at minimiser positions are kept: a word position whose k-gram hash is the
least of some window of w. Equal passages choose equal positions, and every passage of MIN_WORDS
words holds one such position early enough for ANCHOR words to follow inside the passage. Suffixes
whose first ANCHOR words are found in one text only drop out by counting. The others carry the
words around them. Two of them share MIN_WORDS words if for some l the l words before and the
MIN_WORDS - ANCHOR - l words after are equal, so grouping by the hash of those words, for every l,
finds all matches without comparing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import arrow_schema, records, resting, saved, ship, tune
from .near_dedup import WordHashes, constants, mix, slabs

ship(__name__)

MIN_WORDS = 50
ANCHOR = 25
GRAM = 8
WINDOW = MIN_WORDS - ANCHOR + 1
#: Different contexts of one anchor that are compared in one task; of more, the keys are grouped by Spark.
GROUP_ROWS = 50_000
#: Suffixes sorted in one numpy pass.
PASS_ROWS = 20_000

_U = np.uint64
_TEXTS = "doc_id long, block int, rid long, tid long, n_words long, starts array<long>, anchors array<long>"
_CONTEXT = "tid long, least_id long, starts array<long>, anchor long, around binary"
_FOUND = "ctx long, left long, right long, other long, second long"
_KEYS = "ctx long, l int, key long, id1 long, tid1 long, id2 long, tid2 long"
_GRAM_STEPS, _ANCHOR_STEPS = constants(GRAM, 11), constants(ANCHOR, 12)
_BEFORE_STEPS, _AFTER_STEPS, _SPLIT_STEPS = constants(MIN_WORDS - ANCHOR, 13), constants(MIN_WORDS - ANCHOR, 14), constants(2, 15)
#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1


def runs_hash(words: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Hashes of all runs of len(steps) words."""
    n = len(words) - len(steps) + 1
    if n <= 0:
        return np.zeros(0, _U)
    h = words[:n] * steps[0]
    for j in range(1, len(steps)):
        h = h + words[j : j + n] * steps[j]
    return mix(h)


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of all runs of w, by doubling."""
    span = 1
    out = x
    while span < w:
        step = min(span, w - span)
        out = pick(out[: len(out) - step], out[step:])
        span += step
    return out


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Positions that are least in some window of WINDOW; all of them where values tie."""
    if len(grams) < WINDOW:
        return np.zeros(0, np.int64)
    least = sliding(grams, WINDOW, np.minimum)
    pad = np.zeros(WINDOW - 1, grams.dtype)
    return np.flatnonzero(sliding(np.concatenate([pad, least, pad]), WINDOW, np.maximum) == grams)


def text_id(text: bytes) -> int:
    return int(_U(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def word_arrays(batch: pa.RecordBatch, column: int, hashes: WordHashes) -> Iterator[tuple[bytes, np.ndarray]]:
    texts = [(x or b"").lower() for x in batch.column(column).cast(pa.large_binary()).to_pylist()]
    for part in slabs(texts):
        yield from zip(part, hashes.of(part), strict=True)


@resting
def suffix_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, schema = WordHashes(), arrow_schema(_TEXTS)
    for b in batches:
        rows: dict[str, list] = {f.name: [] for f in schema}
        for doc, (text, words) in zip(b.column(0).to_pylist(), word_arrays(b, 1, hashes), strict=True):
            anchors = runs_hash(words, _ANCHOR_STEPS)
            at = minimisers(runs_hash(words, _GRAM_STEPS))
            at = at[at < len(anchors)]
            values = (doc, common.partition_id(), common.raw_id(text), text_id(b" ".join(text.split())), len(words), at, anchors[at].view(np.int64))
            for name, value in zip(rows, values, strict=True):
                rows[name].append(value)
        yield records(rows, schema)


def around_starts(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, words around): of each kept suffix the MIN_WORDS - ANCHOR words before it,
    nearest first, and as many after its anchor, as 32-bit hashes; 0 where the text ends."""
    side = MIN_WORDS - ANCHOR
    anchors = runs_hash(words, _ANCHOR_STEPS)
    starts = starts[starts < len(anchors)]
    short = np.concatenate([np.zeros(side, np.uint32), (words >> _U(32)).astype(np.uint32) | np.uint32(1), np.zeros(side, np.uint32)])
    before = short[starts[:, None] + side - 1 - np.arange(side)]
    after = short[starts[:, None] + side + ANCHOR + np.arange(side)]
    return starts, anchors[starts].view(np.int64), np.concatenate([before, after], axis=1)


@resting
def contexts(batches: Iterator[pa.RecordBatch], uri: str | None) -> Iterator[pa.RecordBatch]:
    """Contexts of the listed suffixes. Columns: text and, without block files, payload (the text's
    least id, then starts) and the tid it is of."""
    hashes, block = WordHashes(), common.Block(uri) if uri else None
    for b in batches:
        texts = [(x or b"").lower() for x in b.column(0).cast(pa.large_binary()).to_pylist()]
        if block:
            lists = [block.take(common.raw_id(t)) for t in texts]
        else:  # rows of one id may have other texts
            lists = [x if text_id(b" ".join(t.split())) == tid else None for t, x, tid in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        chosen = [(t, x) for t, x in zip(texts, lists, strict=True) if x is not None]
        rows: dict[str, list] = {f.name: [] for f in arrow_schema(_CONTEXT)}
        done = 0
        for part in slabs([t for t, _ in chosen]):
            for words in hashes.of(part):
                text, listed = chosen[done]
                done += 1
                least_id = int(listed[0])
                starts, anchors, near = around_starts(words, np.array(listed[1:], np.int64))
                # places of one text with equal anchors and contexts share a row
                same: dict[tuple[int, bytes], list[int]] = {}
                for start, anchor, x in zip(starts.tolist(), anchors.tolist(), near, strict=True):
                    same.setdefault((anchor, x.tobytes()), []).append(start)
                tid = text_id(b" ".join(text.split()))
                for (anchor, x), places in same.items():
                    for k, v in zip(rows, (tid, least_id, places, anchor, x), strict=True):
                        rows[k].append(v)
        yield records(rows, arrow_schema(_CONTEXT))
    if block:
        block.close()


def split_keys(anchors: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context and l = 0..side, a hash of the anchor, the l words before it and the side - l
    words after it, and whether the text has so many words there."""
    side = around.shape[1] // 2
    before, after = around[:, :side], around[:, side:]
    n_before, n_after = (before != 0).sum(axis=1), (after != 0).sum(axis=1)
    none = np.zeros((len(around), 1), _U)
    left = np.concatenate([none, np.cumsum(before.astype(_U) * _BEFORE_STEPS, axis=1)], axis=1)
    right = np.concatenate([none, np.cumsum(after.astype(_U) * _AFTER_STEPS, axis=1)], axis=1)[:, ::-1]
    l = np.arange(side + 1)
    keys = mix(left + right + anchors.view(_U)[:, None] * _SPLIT_STEPS[0] + l.astype(_U) * _SPLIT_STEPS[1])
    return keys, (l <= n_before[:, None]) & (side - l <= n_after[:, None])


def compare(ctx: np.ndarray, texts: np.ndarray, anchors: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts that share MIN_WORDS words with another text: ctx, the most words shared before and
    after in such matches, and of all texts that match (their own among them) the two of least id.
    ``texts``: least_id and tid of a context's first text and of its second (or the first again)."""
    n, side = len(ctx), around.shape[1] // 2
    pairs = np.concatenate([texts[:, :2], texts[:, 2:]])
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    rank = np.empty(2 * n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (pairs[order[1:]] != pairs[order[:-1]]).any(axis=1)]))
    tids = np.empty(2 * n, np.int64)
    tids[rank] = pairs[:, 1]
    one, two = rank[:n], rank[n:]
    far = 2 * n
    left, right = np.full(n, -1), np.full(n, -1)
    least, second = np.full(n, far), np.full(n, far)
    keys, fits = split_keys(anchors, around)
    for l in range(side + 1):
        order = np.flatnonzero(fits[:, l])
        if not len(order):
            continue
        order = order[np.argsort(keys[order, l])]
        k = keys[order, l]
        heads = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        run = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(k))))
        x, y = one[order], two[order]
        a = np.minimum.reduceat(x, heads)
        b = np.minimum.reduceat(np.where(x > a[run], x, np.where(y > a[run], y, far)), heads)
        ok = (b < far)[run]
        i, a, b = order[ok], a[run][ok], b[run][ok]
        left[i] = l
        right[i] = np.maximum(right[i], side - l)
        u, v = least[i], second[i]
        least[i] = np.minimum(u, a)
        second[i] = np.minimum(np.where(u > least[i], u, v), np.where(a > least[i], a, b))
    i = np.flatnonzero(left >= 0)
    return ctx[i], left[i], right[i], tids[least[i]], tids[second[i]]


def text_pairs(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in ("id1", "tid1", "id2", "tid2")], axis=1)


def around_words(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint32).reshape(len(t), -1)


@resting
def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by anchor; whole groups are compared, many at a time."""
    held: list[pa.RecordBatch] = []

    def done(t: pa.Table) -> pa.RecordBatch:
        out = compare(t.column("ctx").to_numpy(), text_pairs(t), t.column("anchor").to_numpy(), around_words(t))
        return records(dict(zip(("ctx", "left", "right", "other", "second"), out, strict=True)), arrow_schema(_FOUND))

    rows = 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < PASS_ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        a = t.column("anchor").to_numpy()
        odd = np.flatnonzero(a != a[-1])
        if len(odd):
            cut = int(odd[-1]) + 1
            yield done(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), len(t) - cut
    if rows:
        yield done(pa.Table.from_batches(held).combine_chunks())


@resting
def listed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a context and l: what compare groups, for groups that do not fit one task."""
    for b in batches:
        if not len(b):
            continue
        keys, fits = split_keys(b.column("anchor").to_numpy(), around_words(b))
        i, l = np.nonzero(fits)
        columns = dict(zip(("id1", "tid1", "id2", "tid2"), text_pairs(b)[i].T, strict=True))
        yield records({"ctx": b.column("ctx").to_numpy()[i], "l": l.astype(np.int32), "key": keys[i, l].view(np.int64), **columns}, arrow_schema(_KEYS))


def hot_anchors(places: DataFrame, shared: DataFrame) -> DataFrame | None:
    """Anchors with more than GROUP_ROWS different contexts, if any. They have as many places, so
    others need not be counted."""
    many = shared.where(F.col("n") > GROUP_ROWS).select("anchor")
    if many.isEmpty():
        return None
    contexts_of = places.join(common.broadcast_if_small(many), "anchor").select("anchor", "ctx").distinct()
    hot = saved(contexts_of.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("anchor"), "hot")
    return None if hot.isEmpty() else hot


def found_by_keys(each: DataFrame) -> DataFrame:
    """What compare finds, with the keys grouped by Spark: no task holds a whole group."""
    every = each.mapInArrow(listed_keys, _KEYS)
    pair = lambda i: F.struct(F.col(f"id{i}").alias("id"), F.col(f"tid{i}").alias("tid"))
    # Most keys are of one text: they go before anything else is done, by their least and greatest text.
    several = every.groupBy("l", "key").agg(F.min(pair(1)).alias("least"), F.max(pair(2)).alias("most")).where("least != most").select("l", "key")
    keys = saved(every.join(several, ["l", "key"]), "hot_keys")
    texts = keys.select("l", "key", F.explode(F.array_distinct(F.array(pair(1), pair(2)))).alias("text")).distinct()
    two = texts.withColumn("k", F.row_number().over(Window.partitionBy("l", "key").orderBy("text"))).where("k <= 2")
    met = two.groupBy("l", "key").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b")
    hits = keys.select("ctx", "l", "key").join(met, ["l", "key"])
    # at most 26 rows a context
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))), 1, 2)
    side = MIN_WORDS - ANCHOR
    best = hits.groupBy("ctx").agg(F.max("l").cast("long").alias("left"), (side - F.min("l")).cast("long").alias("right"), least.alias("least"))
    return best.select("ctx", "left", "right", F.col("least")[0]["tid"].alias("other"), F.col("least")[1]["tid"].alias("second"))


def one_a_context(places: DataFrame) -> DataFrame:
    """(ctx, anchor, around, id1, tid1, id2, tid2): each context with its two texts of least id."""
    first_two = F.dense_rank().over(Window.partitionBy("ctx").orderBy("least_id", "tid"))
    two = places.select("ctx", "anchor", "around", "least_id", "tid").withColumn("k", first_two).where("k <= 2")
    text = F.struct("least_id", "tid")
    each = two.groupBy("ctx").agg(F.first("anchor").alias("anchor"), F.first("around").alias("around"), F.min(text).alias("one"), F.max(text).alias("two"))
    return each.select("ctx", "anchor", "around", *[F.col(f"{c}.{f}").alias(f"{x}{i}") for i, c in ((1, "one"), (2, "two")) for f, x in (("least_id", "id"), ("tid", "tid"))])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a repeated passage of a document: doc_id, start_word, end_word, n_words, other_id.

    A passage is a maximal run of words (A-Z lower-cased, split at white space) covered by matches
    of 50 words or more with another text; end_word is exclusive and other_id is the least doc_id
    among the texts it was matched with. Rows with equal texts repeat as a whole, if they have 50
    words; a single text's own repetitions do not count. Null text has no words. Rows with a null id are searched and
    reported with id null. An empty table gives an empty result; extra columns are ignored.
    """
    tune(docs.sparkSession)
    began = common.mark()
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = saved(own.mapInArrow(suffix_keys, _TEXTS), "suffixes")
    # Equal texts are searched once.
    first = F.min(F.struct("block", "rid"))
    texts = saved(rows.groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.max("doc_id").alias("last_id"), F.first("n_words").alias("n_words"), F.first("starts").alias("starts"), F.first("anchors").alias("anchors"), first.alias("at")), "texts")
    each = texts.select("tid", F.explode(F.arrays_zip("starts", "anchors")).alias("s")).select("tid", F.col("s.starts").alias("start"), F.col("s.anchors").alias("anchor"))
    shared = saved(each.groupBy("anchor").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count("*").alias("n")).where("a != b").select("anchor", "n"), "anchors")
    kept = each.join(shared.select("anchor"), "anchor").groupBy("tid").agg(F.collect_list("start").alias("starts"))
    payload = F.concat(F.array(F.coalesce("first_id", F.lit(NO_ID))), "starts").alias("payload")
    wanted = saved(kept.join(texts.select("tid", "at", "first_id"), "tid").select("tid", "at.block", "at.rid", "first_id", payload), "wanted")
    uri = common.write_blocks(rows.select("block", "rid"), wanted, "positions")

    def ranges_of(around: DataFrame) -> DataFrame:
        """(tid, start, end, other): contexts are compared once each, whatever their number of texts;
        what is found goes back to all places that have the context."""
        places = saved(around.withColumn("ctx", F.xxhash64("anchor", "around")), "contexts")
        hot = hot_anchors(places, shared)
        cold = places if hot is None else places.join(common.broadcast_if_small(hot), "anchor", "left_anti")
        found = one_a_context(cold).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sorted_groups, _FOUND)
        if hot is not None:
            each = saved(one_a_context(places.join(common.broadcast_if_small(hot), "anchor")), "hot_contexts")
            found = found.unionByName(found_by_keys(each))
        longest = saved(found, "found")
        back = places.select("tid", "ctx", F.explode("starts").alias("at")).join(longest, "ctx")
        other = F.when(F.col("other") == F.col("tid"), F.col("second")).otherwise(F.col("other"))
        spans = back.select("tid", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + ANCHOR + F.col("right")).alias("end"), other.alias("other"))
        return spans.groupBy("tid", "start", "end").agg(F.min("other").alias("other"))

    try:
        found = ranges_of(own.select("doc_id", "text").mapInArrow(lambda it: contexts((b.select([1]) for b in it), uri), _CONTEXT))
    except Exception as error:
        if not common.blocks_changed(error):
            raise
        # An input that is not split alike twice: the texts go to the lists instead.
        listed = wanted.select(F.col("first_id").alias("__id"), "payload", "tid")
        near = own.join(listed, F.col("doc_id").eqNullSafe(F.col("__id"))).select("text", "payload", "tid")
        found = ranges_of(near.mapInArrow(lambda it: contexts(it, None), _CONTEXT))
    names = texts.select(F.col("tid").alias("other"), F.col("first_id").alias("other_id"))
    ranges = found.join(names, "other").select("tid", "start", "end", "other_id")
    # Touching or overlapping ranges become one.
    order = Window.partitionBy("tid").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = ranges.withColumn("opens", F.when(F.coalesce(reach, F.lit(-1)) < F.col("start"), 1).otherwise(0)).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = opened.groupBy("tid", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other_id").alias("other_id")).drop("run")
    whole = texts.where(f"copies > 1 and n_words >= {MIN_WORDS}").select("tid", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.col("first_id").alias("other_id"), "last_id")
    single = passages.join(whole.select("tid"), "tid", "left_anti").withColumn("last_id", F.lit(None).cast("long"))
    each = saved(single.unionByName(whole), "passages")
    common.clear(docs.sparkSession, began, (rows, each))
    out = rows.select("doc_id", "tid").join(each, "tid")
    other = F.when(F.col("last_id").isNotNull() & F.col("doc_id").eqNullSafe(F.col("other_id")), F.col("last_id")).otherwise(F.col("other_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), other.alias("other_id"))

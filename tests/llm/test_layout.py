import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import mixing, packing, sharding, suffixes, warc

from .helpers import DOC_SCHEMA, EDGE, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tokenizer_equals_library():
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b'll", " ", "  ", "\n", "\t", "é", "1", "!", "<|endoftext|>", " x", " \n", " ", "日本", "\r\n", "'S", "😀"]) for _ in range(rng.randrange(25))) for _ in range(1500)]
    fast, slow = packing.FastTokenizer(PATH), Tokenizer.from_file(PATH)
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode(t) == np.array(e.ids, "<u4").tobytes(), t


def brute_bins(lengths, capacity):
    """Best fit decreasing, for a bound."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= x]
        if fit:
            i = min(fit, key=lambda j: gaps[j])
            gaps[i] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def test_best_two_fit():
    rng = np.random.default_rng(2)
    for n, low, high in ((0, 1, 2), (1, 5, 6), (400, 1, 101), (300, 30, 60), (500, 90, 101), (200, 34, 35)):
        lengths = rng.integers(low, high, n)
        bins, offsets = packing.best_two_fit(lengths, 100)
        used = collections.defaultdict(list)
        for b, o, x in zip(bins, offsets, lengths, strict=True):
            used[b].append((o, x))
        for parts in used.values():
            at = 0
            for o, x in sorted(parts):
                assert o == at
                at += x
            assert at <= 100
        assert len(used) <= brute_bins(lengths.tolist(), 100) + 1


def test_repeated_rows_fill_no_single_group(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCS", 100)
    out = packing.pack(docs(spark, [(7, "the same words")] * 1000), PATH).collect()
    assert len(out) == 1000 and len({r["sequence_id"] >> 36 for r in out}) == 10
    used = collections.defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and sorted(o for o, _ in p) == [sum(x for _, x in sorted(p)[:k]) for k in range(len(p))] for p in used.values())


def test_pack(spark):
    rows = EDGE + [(300 + i, "many words here " * (40 * i)) for i in range(20)]
    out = packing.pack(docs(spark, rows), PATH, with_ids=True).collect()
    slow = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[(i, ids.tobytes())] += 1
        n = len(ids)
        pieces = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        if sum(1 for j, _ in rows if j == i) == 1:
            assert b"".join(bytes(r["ids"]) for r in pieces) == ids.tobytes()
            assert all(r["length"] == 2048 for r in pieces[1:]) and pieces[0]["length"] == (n if n <= 2048 else n % 2048 or 2048)
            assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in pieces)
    used = collections.defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:k]) for k in range(len(parts))] and sum(x for _, x in parts) <= 2048
    assert len(used) <= sum(r["length"] for r in out) / 2048 + 2
    assert packing.pack(spark.createDataFrame([], DOC_SCHEMA), PATH).count() == 0


def least_capacity(sizes, k):
    def fits(c):
        n, a = 1, 0
        for s in sizes:
            if s > c:
                return False
            if a + s > c:
                n, a = n + 1, 0
            a += s
        return n <= k

    lo, hi = 0, sum(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    return hi


@pytest.mark.parametrize("bits", [12, 4])
def test_sharding(spark, monkeypatch, bits):
    monkeypatch.setattr(sharding, "BITS", bits)
    rng = random.Random(3)
    rows = EDGE + [(1000 + i, "x" * rng.randrange(200) if i % 5 else "hot") for i in range(400)]
    df = docs(spark, rows)
    out = sharding.shard(df, 8).collect()
    assert len(out) == len(rows)
    got = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert got == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(8))
    place = collections.defaultdict(set)
    for r in out:
        place[(r["size"], r["text_crc32"])].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    sizes = [r["s"] for r in df.groupBy(F.xxhash64(text).alias("h")).agg(F.sum(F.octet_length(text) + 1).alias("s")).orderBy("h").collect()]
    assert max(sum(r["size"] for r in out if r["shard"] == k) for k in by) == least_capacity(sizes, 8)
    assert sharding.shard(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert {r["shard"] for r in sharding.shard(docs(spark, [(1, "only")])).collect()} == {0}


def test_warc_round_trip(spark):
    rows = [(None, None, None), (1, "u\r\nx: y", ""), (2, "u", None), (3, "u", "dup"), (3, "u", "dup"), (4, "u", "dup"), (5, "z", "é" * 30000), (6, "z", "0\r\n\r\nWARC/1.1"), (7, "z", "é" * 30000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(spark, pages, segment_bytes=700, archive_bytes=2000).collect()
    least = collections.defaultdict(list)
    for i, _, h in rows:
        if i is not None:
            least[h or ""].append(i)
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), min(least[h or ""], default=None)
        again = top is not None and i != top
        want.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None)))
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in out) == sorted(want)
    assert all(r["intact"] for r in out)
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_missing_segment(spark):
    from quillon.llm.common import scratch

    pages = spark.createDataFrame([(1, "u", "payload " * 500)], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, scratch(spark, "w"), segment_bytes=1000, archive_bytes=100)
    names = sorted(r["archive"] for r in manifest.collect())
    whole = warc.read_pages(manifest).first()
    assert whole["intact"] and bytes(whole["payload"]) == b"payload " * 500
    fewer = [bool(r["intact"]) for n in names for r in warc.read_pages(manifest.where(manifest.archive != n)).collect()]
    assert len(names) > 3 and not any(fewer)


def test_warc_headers_of_revisits(spark):
    """A revisit names its response by record id, address and date."""
    from quillon.llm.common import file_system, scratch

    rows = [(1, "a", "same"), (2, "b", "same"), (3, "c", "other"), (3, "c", "other"), (4, "d", "other"), (None, "e", "same")]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch(spark, "w"))
    found = []
    for r in manifest.collect():
        filesystem, path = file_system(r["archive"])
        with filesystem.open_input_file(path) as src:
            found += [h for h, _ in warc.parse(src)]
    ids = {h["x-page-id"]: h["warc-record-id"] for h in found if h["warc-type"] == "response"}
    assert len({h["warc-record-id"] for h in found}) == len(rows)
    by = {h.get("x-page-id"): h for h in found if h["warc-type"] == "revisit"}
    assert by["2"]["warc-refers-to"] == ids["1"] and by["2"]["warc-refers-to-target-uri"] == "a" and by["2"]["warc-refers-to-date"] == "2024-01-01T00:00:00Z"
    assert by[None]["warc-refers-to"] == ids["1"] and "warc-refers-to" not in by["4"] and by["4"]["warc-refers-to-target-uri"] == "c"


def test_warc_broken_archives():
    """What is broken is left out; the records around it are read."""
    import gzip
    import io

    good = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b"x" * i) for i in range(5)]
    no_length = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n")
    bad_length = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nabc\r\n\r\n")
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nabc")
    two = gzip.compress(gzip.decompress(good[3]) + gzip.decompress(good[4]))
    broken = bytearray(warc.record([("WARC-Type", "response")], bytes(range(256)) * 9))
    broken[30] ^= 255
    data = good[0] + no_length + good[1] + bytes(broken) + b"junk" + bad_length + short + good[2] + gzip.compress(b"no record") + two
    for cut in (len(data), len(data) - 9):
        for size in (1, 7, 1 << 20):
            sizes = [len(m) for m in warc.members(io.BytesIO(data[:cut]), size)]
            blocks = [len(b) for _, b in warc.parse(io.BytesIO(data[:cut]))]
            assert blocks == ([0, 1, 2, 3, 4] if cut == len(data) else [0, 1, 2]), (cut, size, sizes)
    assert list(warc.parse(io.BytesIO(b""))) == []


def test_chunks():
    for n in (0, 1, 8191, 8192, 8193, 50000):
        assert warc.unchunked(warc.chunked(b"x" * n)) == b"x" * n
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_fill():
    assert mixing.fill(100, {"a": 10, "b": 100, "c": 100}, {"a": 1, "b": 1, "c": 2}) == {"a": 10, "b": 30, "c": 60}
    assert mixing.fill(10, {"a": 3, "b": 3}, {"a": 1, "b": 1}) == {"a": 3, "b": 3}
    assert sum(mixing.fill(10, {"a": 9, "b": 9, "c": 9}, {"a": 1, "b": 1, "c": 1}).values()) == 10
    leaves = [(("d", "en", "x"), 5), (("d", "en", "y"), 100), (("e", "en", "z"), 100)]
    got = mixing.budgets(leaves, 100, {}, 1)
    assert got == {("d", "en", "x"): 5, ("d", "en", "y"): 45, ("e", "en", "z"): 50}
    short = mixing.budgets([(("d", "en", "x"), 5), (("e", "en", "z"), 100)], 50, {}, 1)
    assert short == {("d", "en", "x"): 5, ("e", "en", "z"): 45}


def level(budget, limits, weights):
    """Water level by bisection: everyone gets min(limit, level * weight)."""
    low, high = 0.0, 1.0 + max(limits[k] / weights[k] for k in limits)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(limits[k], mid * weights[k]) for k in limits) < budget else (low, mid)
    return {k: min(limits[k], high * weights[k]) for k in limits}


def test_budgets_against_water_levels():
    """Every node of random trees gets what a level by bisection gives among its siblings, to a token."""
    rng = random.Random(4)
    for _ in range(200):
        leaves = list({(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{rng.randrange(5)}"): rng.choice([0, 1, 7, 50, 1000]) for _ in range(rng.randrange(1, 14))}.items())
        nodes = {p[:i] for p, _ in leaves for i in range(1, 4)}
        weights = {n: rng.choice([0.5, 1, 2, 3.0]) for n in nodes if rng.random() < 0.7}
        epochs = rng.randrange(1, 4)
        total = epochs * sum(t for _, t in leaves)
        budget = rng.randrange(total + 20)
        given = mixing.budgets(leaves, budget, weights, epochs)
        assert sum(given.values()) == min(budget, total) and all(0 <= given[p] <= t * epochs for p, t in leaves)
        sums = collections.Counter()
        supply = collections.Counter()
        for p, t in leaves:
            for i in range(4):
                sums[p[:i]] += given[p]
                supply[p[:i]] += t * epochs
        for parent in {p[:i] for p, _ in leaves for i in range(3)}:
            children = [n for n in nodes if len(n) == len(parent) + 1 and n[: len(parent)] == parent]
            want = level(sums[parent], {c: supply[c] for c in children}, {c: weights.get(c, 1) for c in children})
            assert all(abs(sums[c] - want[c]) <= 1.001 for c in children), (parent, sums, want)


def test_mix_of_more_leaves_than_are_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (i % 40)) for i in range(200)]
    want = sorted(map(str, mixing.select_mix(docs(spark, rows), mixing.domain_of(), 0.6).collect()))
    monkeypatch.setattr(mixing, "LEAVES", 1)
    assert sorted(map(str, mixing.select_mix(docs(spark, rows), mixing.domain_of(), 0.6).collect())) == want


def test_mix(spark):
    rng = random.Random(8)
    rows = EDGE + [(1000 + i, "w " * rng.randrange(60)) for i in range(500)]
    df = docs(spark, rows)
    out = mixing.select_mix(df, mixing.domain_of(), 0.6, {("domain0",): 3.0}, epochs=2).collect()
    assert len(out) == len(rows)
    stats = collections.Counter()
    for r in out:
        stats[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
    given = mixing.budgets(list(stats.items()), int(0.6 * sum(stats.values())), {("domain0",): 3.0}, 2)
    for leaf, total in stats.items():
        whole, part = divmod(given[leaf], total) if total else (0, 0)
        mine = sorted((hashlib.md5(f"7:{whole}:{'null' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), r["n_tokens"], r["copies"]) for r in out if (r["domain"], r["lang"], r["source"]) == leaf)
        sums = collections.Counter()
        for k, n, _ in mine:
            sums[k] += n
        before, chosen = 0, set()
        for k in sorted(sums):
            if part and before < part:
                chosen.add(k)
            before += sums[k]
        assert all(c == whole + (k in chosen) for k, _, c in mine)
    applied = mixing.apply_mix(docs(spark, rows, extra=False), 0.6, {("domain0",): 3.0})
    assert applied.count() == sum(r["copies"] for r in out) and applied.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert mixing.select_mix(spark.createDataFrame([], DOC_SCHEMA), mixing.domain_of()).count() == 0


def brute_passages(rows, least=50):
    words = [(t or "").encode().lower().split() for _, t in rows]
    seen = collections.defaultdict(set)
    for w in words:
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].add(b" ".join(w))
    texts = collections.Counter(b" ".join(w) for w in words)
    out = collections.defaultdict(set)
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - least + 1):
            if len(seen[tuple(w[i : i + least])]) > 1 or texts[b" ".join(w)] > 1:
                out[d].update(range(i, i + least))
    return dict(out)


def passage_rows():
    rng = random.Random(2)
    g = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    shared = [g(n) for n in (49, 50, 51, 60, 80, 200)]
    rows = [(i, " ".join(g(rng.randrange(60)) + rng.choice(shared) + g(rng.randrange(40)) + rng.choice(shared) + g(rng.randrange(5)))) for i in range(50)]
    return rows + [(100, " ".join(shared[1])), (101, " ".join(shared[0])), (102, "again and " * 40), (103, None), (104, ""), (105, " ".join(shared[2])), (106, " ".join(shared[2]).upper())]


@pytest.mark.parametrize("changed", [False, True])
def test_passages(spark, monkeypatch, changed):
    rows = passage_rows()
    if changed:
        wrong = suffixes.common.scratch(spark, "none")
        monkeypatch.setattr(suffixes.common, "write_blocks", lambda *a: wrong)
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(docs(spark, rows)).collect():
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_id"] is not None
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert dict(got) == brute_passages(rows)


def test_passages_empty(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert suffixes.repeated_passages(docs(spark, EDGE)).where("doc_id = 9").count() == 0


def brute_others(rows, least=50):
    """The least other id of each document's passages, where it has just one."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    runs = [{tuple(w[i : i + least]) for i in range(len(w) - least + 1)} for w in words]
    return {d: min(rows[j][0] for j in range(len(rows)) if words[j] != words[i] and runs[i] & runs[j]) for i, (d, _) in enumerate(rows) if any(words[j] != words[i] and runs[i] & runs[j] for j in range(len(rows)))}


def balanced_rows():
    """Texts 1 and 2 share 12 words before an anchor and 13 after it; around each are texts that share
    more on one side and too little on the other, so neither is the other's neighbour in sorted order."""
    rng = random.Random(8)
    g = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    middle, before, after = g(25), g(12), g(13)
    rows = []
    for d in (1, 2):
        left, right = g(30) + before, after + g(30)
        rows.append((d, left + middle + right))
        for j in range(8):
            rows.append((100 * d + j, g(30) + left[-2:] + middle + right[: 14 + j % 6] + g(30)))
            rows.append((100 * d + 50 + j, g(30) + left[-14 - j % 6 :] + middle + right[:2] + g(30)))
    return [(d, " ".join(w)) for d, w in rows], " ".join(middle)


def found_words(out):
    got = collections.defaultdict(set)
    for r in out:
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return dict(got)


def test_passages_that_are_nobodys_longest(spark, monkeypatch):
    rows, middle = balanced_rows()
    gram = suffixes.runs_hash(suffixes.WordHashes().of([middle.encode()])[0], suffixes._GRAM_STEPS)[0]
    monkeypatch.setattr(suffixes, "minimisers", lambda grams: np.flatnonzero(grams == gram))
    out = suffixes.repeated_passages(docs(spark, rows)).collect()
    assert found_words(out) == brute_passages(rows)
    assert {r["doc_id"]: r["other_id"] for r in out} == brute_others(rows)


def test_passages_of_hot_anchors(spark, monkeypatch):
    """A line of 30 words in every text; few pairs share 50 words around it."""
    monkeypatch.setattr(suffixes, "GROUP_ROWS", 3)
    rng = random.Random(9)
    g = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    line = g(30)
    rows = [(i, " ".join(g(40) + line + g(40))) for i in range(60)]
    for i in range(60, 90, 2):
        left, right = g(i % 21), g(20 - i % 21)
        rows += [(j, " ".join(g(35) + left + line + right + g(35))) for j in (i, i + 1)]
    rows += [(200 + d, t) for d, t in passage_rows()[:30]]
    out = suffixes.repeated_passages(docs(spark, rows)).collect()
    assert found_words(out) == brute_passages(rows)
    assert {d: x for d, x in brute_others(rows).items() if d < 200} == {r["doc_id"]: r["other_id"] for r in out if r["doc_id"] < 200}


def test_compare_equals_all_pairs():
    rng = np.random.default_rng(3)
    side = suffixes.MIN_WORDS - suffixes.ANCHOR
    for _ in range(20):
        base = rng.integers(1, 1000, (3, 2 * side)).astype(np.uint32)
        around = base[rng.integers(0, 3, 60)]
        for row in around:
            row[rng.integers(0, side) : side] = rng.integers(1, 10**9)
            row[side + rng.integers(0, side + 1) :] = rng.choice([0, 5, 7])
        text = rng.integers(0, 25, (60, 1))
        out = suffixes.compare(np.arange(60), np.concatenate([text * 2, text, text * 2, text], axis=1), np.zeros(60, np.int64), around)
        run = lambda a, b: int(np.logical_and.accumulate((a == b) & (a != 0)).sum())
        want = []
        for i in range(60):
            hits = [(run(around[i, :side], around[j, :side]), run(around[i, side:], around[j, side:]), int(text[j, 0])) for j in range(60) if text[j] != text[i]]
            hits = [h for h in hits if h[0] + h[1] >= side]
            if hits:
                near = sorted({h[2] for h in hits} | {int(text[i, 0])})
                want.append((i, max(h[0] for h in hits), max(h[1] for h in hits), near[0], near[1]))
        assert list(zip(*(x.tolist() for x in out))) == want

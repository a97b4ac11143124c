import collections
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import common, components, exact_dedup, near_dedup

from .helpers import DOC_SCHEMA, EDGE, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=300), st.integers(0, 2**20))
def test_golomb_round_trip(values, low):
    v = np.array(sorted(values), np.int64) + low
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(v, low, 2**40), len(v), low).tolist() == v.tolist()


def check_exact(spark, rows):
    out = exact_dedup.exact_groups(docs(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want += [(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_exact_edges(spark):
    check_exact(spark, EDGE)
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_exact_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}" if i % 3 == 1 else f"TEXT {i // 6}") for i in range(600)]
    check_exact(spark, rows)


def test_exact_drop(spark):
    kept = exact_dedup.drop_exact_copies(docs(spark, [(1, "A"), (2, "a"), (3, "b"), (None, None)]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert "uid" in kept.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[150] == got[200] == 100 and got[301] == 300 and got[1049] == 1000
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_near(rows, k, percent=80):
    sets, ids = {}, {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[n] = {b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        ids[n] = i
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = {}
    for n, i in ids.items():
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(str((ids[n], len(sets[n]), least.get(find(n)) if sets[n] else ids[n])) for n in ids)


def near_copies(rng, groups, size):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(30, 160))]
        for j in range(size):
            p = rng.random() * 0.09
            rows.append((g * 1000 + j, " ".join(w if rng.random() > p else f"z{rng.randrange(10**9)}" for w in base)))
    return rows


def test_near_edges_and_groups(spark):
    rows = EDGE + [(1000 + i, t) for i, t in near_copies(random.Random(4), 8, 40)]
    for k in (4, 5):
        out = near_dedup.near_groups(docs(spark, rows), words=k).collect()
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == brute_near(rows, k)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    assert near_dedup.near_groups(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_near_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 30)
    rows = near_copies(random.Random(5), 2, 150)
    out = near_dedup.near_groups(docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == brute_near(rows, 5)


def test_near_parts_of_large_clusters(spark, monkeypatch):
    """Clusters of many blocks: some hang together by their centres, some only by chains, some not at all."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 12)
    monkeypatch.setattr(near_dedup, "MIN_BANDS", 0)
    rng = random.Random(11)
    rows = near_copies(rng, 1, 80)
    line = [f"c{rng.randrange(10**6)}" for _ in range(120)]
    for i in range(60):  # a chain: each text differs from the next in a few words
        line = [w if rng.random() > 0.02 else f"d{rng.randrange(10**9)}" for w in line]
        rows.append((5000 + i, " ".join(line)))
    frame = [f"f{j}" for j in range(60)]
    for i in range(60):  # alike enough for shared keys, too different to be linked; pairs of them are
        own = [f"g{i // 2}_{j}" for j in range(24)] + [f"h{i}_{j}" for j in range(1)]
        rows.append((8000 + i, " ".join(frame + own)))
    for k in (4, 5):
        out = near_dedup.near_groups(docs(spark, rows), words=k).collect()
        assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == brute_near(rows, k)


def test_near_when_blocks_change(spark, monkeypatch):
    rows = near_copies(random.Random(6), 3, 20)
    wrong = common.scratch(spark, "none")
    monkeypatch.setattr(common, "write_blocks", lambda *a: wrong)
    out = near_dedup.near_groups(docs(spark, rows)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == brute_near(rows, 5)


def test_tensored_recall():
    """Tables keyed by pairs of bands find pairs at .8 as the formula says."""
    rng, hit, n = np.random.default_rng(7), 0, 400
    for _ in range(n):
        both, one, two = (rng.integers(0, 2**63, m).astype(np.uint64) for m in (160, 20, 20))
        a, b = near_dedup.bands(np.sort(np.concatenate([both, one]))), near_dedup.bands(np.sort(np.concatenate([both, two])))
        g = near_dedup.GROUPS
        hit += bool((a[:g] == b[:g]).any() and (a[g:] == b[g:]).any())
    assert hit >= n - 4


def test_word_hashes():
    texts = [b"", b" ", b"a", b"a b\tc\x0bd  e\n", "é ü".encode(), b"word " * 1000]
    out = near_dedup.WordHashes().of(texts)
    assert [len(x) for x in out] == [len(t.split()) for t in texts]
    assert out[2][0] == out[3][0] and len(set(out[5].tolist())) == 1

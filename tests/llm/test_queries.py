import hashlib
import random
import re

import pytest

import corpus_pipeline
from quillon.llm import common, exact_dedup, mixing, near_dedup, packing, quality, queries
from tests import oracle

from .helpers import EDGE, docs
from .test_dedup import LOWER, brute_near, near_copies
from .test_rules import brute_quality


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, data, name):
    oracle.compare(queries.QUERIES[name](spark, data), oracle.connect(data), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).columns


def test_one_query_an_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_equals_its_operators(spark, data):
    """Each stage's rows, from the decisions of its operator on the stage before."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in quality.verdicts(quality.ledger(docs)).where("kept").collect()}
    stage = corpus_pipeline.STAGES[0][1](spark, docs, data)
    assert {r["doc_id"] for r in stage.collect()} == kept and stage.columns == docs.columns
    kept = {r["doc_id"] for r in exact_dedup.exact_groups(stage).where("kept").collect()}
    stage = corpus_pipeline.STAGES[1][1](spark, stage, data)
    assert {r["doc_id"] for r in stage.collect()} == kept and stage.columns == docs.columns
    kept = {r["doc_id"] for r in near_dedup.near_groups(stage).where("kept").collect()}
    stage = corpus_pipeline.STAGES[2][1](spark, stage, data)
    assert {r["doc_id"] for r in stage.collect()} == kept and stage.columns == docs.columns
    chosen = mixing.select_mix(stage, mixing.domain_of(), corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_WEIGHTS)
    want = sorted(x for r in chosen.collect() for x in [r["doc_id"]] * r["copies"])
    stage = corpus_pipeline.STAGES[3][1](spark, stage, data)
    assert sorted(r["doc_id"] for r in stage.collect()) == want and stage.columns == docs.columns
    out = corpus_pipeline.STAGES[4][1](spark, stage, data).collect()
    assert sorted(r["doc_id"] for r in out if r["piece"] == 0) == want and all(r["length"] <= packing.CAPACITY for r in out)
    assert len(corpus_pipeline.run(spark, data).collect()) == len(out)


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages on one small table, each by plain Python from what the one before kept."""
    rng = random.Random(12)
    rows = [(1000 + i, t) for i, t in near_copies(rng, 5, 6)]
    rows += [(9000 + i, t.upper()) for i, t in rows[::4]] + [(9500 + i, t) for i, t in rows[::7]]
    rows += [(20_000 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 200)))) for i in range(40)]
    rows += [(30_000, "again and again " * 40), (30_001, "# % & " * 60), (30_002, None), (30_003, ""), (30_004, "\n".join(["a line that repeats itself here"] * 30))]
    rows = list({i: t for i, t in rows}.items())
    docs(spark, rows, extra=False).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    def good(t):
        n, chars, symbols, repeated_lines, repeats = brute_quality(t)
        lines = sum(1 for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        return not (n < 50 or 100 * repeats > 50 * n or 100 * symbols > 10 * chars or 100 * repeated_lines > 50 * lines or chars < 2 * n or chars > 20 * n)

    kept = [(i, t) for i, t in rows if good(t)]
    last = {}
    for i, t in kept:
        last[t.translate(LOWER)] = max(i, last.get(t.translate(LOWER), i))
    kept = [(i, t) for i, t in kept if last[t.translate(LOWER)] == i]
    leaders = {int(i): int(c) for i, _, c in (eval(x) for x in brute_near(kept, 5))}
    kept = [(i, t) for i, t in kept if leaders[i] == i]
    assert 40 < len(kept) < len(rows) - 20
    leaf, words = {}, {i: len(t.split()) for i, t in kept}
    for i, _ in kept:
        leaf.setdefault((f"domain{i % 3}", "en", f"src{i % 3}"), []).append(i)
    stats = [(p, sum(words[i] for i in ids)) for p, ids in leaf.items()]
    given = mixing.budgets(stats, int(corpus_pipeline.MIX_SHARE * sum(n for _, n in stats)), corpus_pipeline.MIX_WEIGHTS, 2)
    want = []
    for p, total in stats:
        whole, part = divmod(given[p], total)
        want += leaf[p] * whole
        done = 0
        for i in sorted(leaf[p], key=lambda i: hashlib.md5(f"7:{whole}:{i}".encode()).hexdigest()):
            if done < part:
                want.append(i)
            done += words[i]
    assert sorted(r["doc_id"] for r in out if r["piece"] == 0) == sorted(want)
    used = {}
    for r in out:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= packing.CAPACITY and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in used.values())
    assert len(used) <= -(-sum(r["length"] for r in out) // packing.CAPACITY) + 1


def test_scratch_tables_go(spark, data):
    """What stays is what results are still read from, and no more of it with each run."""
    began = common.mark()
    for name in sorted(queries.QUERIES):
        queries.QUERIES[name](spark, data).collect()
    assert len([p for p in common._made[began:] if p]) <= 15
    common.clear(spark, began)
    assert not [p for p in common._made[began:] if p]
    began = common.mark()
    corpus_pipeline.run(spark, data).collect()
    assert len([p for p in common._made[began:] if p]) == 1
    common.clear(spark, began)


@pytest.mark.parametrize("kind", ["edge", "empty", "nothing kept"])
def test_pipeline_of_odd_tables(spark, tmp_path, kind):
    """Nulls, ties, repeated rows, long texts and clashing columns; tables without rows, and without rows that stay."""
    rows = {"edge": EDGE + [(40 + i % 3, " ".join(f"w{j * (1 + i % 3)}" for j in range(80))) for i in range(6)] + [(None, " ".join(f"n{j}" for j in range(90)))], "empty": [], "nothing kept": [(1, "too short"), (2, None)]}[kind]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert kind == "edge" or out == []
    if kind == "edge":
        assert {r["doc_id"] for r in out} <= {None, 40, 41, 42} and all(0 < r["length"] <= packing.CAPACITY for r in out)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns

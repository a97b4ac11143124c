"""Mixing sources to target weights by hierarchical budgeting.

Leaves of a domain - language - source tree have tokens; weights propagate from the root, and what
a node cannot supply goes to its siblings in proportion to their weights before an ancestor's
siblings get any. A node can supply its leaves' tokens times the allowed epochs, so a single pass
from the root with those limits does exactly that. A leaf's share is whole epochs and a prefix of
one more: each epoch orders the leaf by a seeded hash. The end of a prefix is found by sums over
hash ranges, and only documents of the one range that holds it are ranked, so a source with a third
of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, ship, text_or_empty, tune

ship(__name__)

#: Hash ranges a leaf's epoch is divided into when its prefix is cut.
RANGES = 4096
#: Leaves up to which their tables are broadcast.
LEAVES = 200_000


def fill(budget: int, limits: dict, weights: dict) -> dict:
    """Share ``budget`` by weight; what exceeds a member's limit goes to the others by weight.

    Whole tokens: fractions are rounded down and the remainder goes, one each, to the members with
    room in order of name. Weights of 0 get something only if nobody else has room.
    """
    given = dict.fromkeys(limits, 0)
    for tier in ([k for k in limits if weights.get(k, 0) > 0], [k for k in limits if weights.get(k, 0) <= 0]):
        open_ = sorted(k for k in tier if limits[k] > 0)
        left = min(budget - sum(given.values()), sum(limits[k] for k in tier))
        while open_ and left > 0:
            total = sum(weights.get(k, 0) or 1 for k in open_)
            full = [k for k in open_ if limits[k] * total <= left * (weights.get(k, 0) or 1)]
            if not full:
                for k in open_:
                    given[k] = min(limits[k], int(left * (weights.get(k, 0) or 1) / total))
                rest = left - sum(given[k] for k in open_)
                while rest > 0:
                    for k in open_:
                        more = int(rest > 0 and given[k] < limits[k])
                        given[k] += more
                        rest -= more
                break
            for k in full:
                given[k] = limits[k]
                left -= limits[k]
            open_ = [k for k in open_ if k not in set(full)]
    return given


def budgets(leaves: list[tuple[tuple, int]], budget: int, weights: dict[tuple, float], epochs: int) -> dict[tuple, int]:
    """Tokens of each leaf path. ``weights`` maps node paths to weights among their siblings; a
    missing one is 1."""
    supply: dict[tuple, int] = defaultdict(int)
    children: dict[tuple, set] = defaultdict(set)
    for path, tokens in leaves:
        for i in range(len(path) + 1):
            supply[path[:i]] += tokens * epochs
            if i:
                children[path[: i - 1]].add(path[:i])
    given = {(): min(budget, supply[()])}
    depth = max((len(p) for p, _ in leaves), default=0)
    for level in range(depth):
        for node in [p for p in given if len(p) == level]:
            given |= fill(given[node], {c: supply[c] for c in children[node]}, {c: weights.get(c, 1) for c in children[node]})
    return {p: given[p] for p, _ in leaves}


def token_count(text: Column) -> Column:
    """Words: runs outside space and \\x09-\\x0D."""
    return F.size(F.array_remove(F.split(text, r"[ \t-\r]+"), "")).cast("long")


def order_key(seed: int, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))))


LEAF = ["domain", "lang", "source"]


def none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("none"))


def leaf_columns(domain: Column, lang_col: str, source_col: str) -> list[Column]:
    return [none(domain).alias("domain"), none(F.col(f"`{lang_col}`")).alias("lang"), none(F.col(f"`{source_col}`")).alias("source")]


def leaf_plan(rows: DataFrame, share: float, weights: dict[tuple, float] | None, epochs: int, seed: int) -> DataFrame:
    """A row a leaf: its whole epochs and the last order key of its prefix (null: no prefix).

    The driver holds the tree, a row a source; tables of leaves are broadcast up to LEAVES of them and
    joined beyond.
    """
    spark = rows.sparkSession
    stats = [((r["domain"], r["lang"], r["source"]), r["t"]) for r in rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("t")).collect()]
    given = budgets(stats, int(share * sum(t for _, t in stats)), weights or {}, epochs)
    plan = {p: (given[p] // t if t else 0, given[p] % t if t else 0) for p, t in stats}
    shares = spark.createDataFrame([(*p, *v) for p, v in plan.items()], "domain string, lang string, source string, whole int, part long")
    small = (lambda df: F.broadcast(df)) if len(plan) <= LEAVES else (lambda df: df)
    keyed = rows.join(small(shares), LEAF).where("part > 0").withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    # Tokens before each of 4096 ranges of a leaf; then the keys inside the range where it ends.
    sums = keyed.groupBy(*LEAF, "range").agg(F.sum("n_tokens").alias("t"), F.first("part").alias("part"))
    running = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("range"))
    ends = sums.withColumn("before", running - F.col("t")).where("before < part and before + t >= part").select(*LEAF, "range", "before")
    edge = keyed.join(small(ends), [*LEAF, "range"]).groupBy(*LEAF, "key").agg(F.sum("n_tokens").alias("t"), F.first("before").alias("before"), F.first("part").alias("part"))
    inside = F.sum("t").over(Window.partitionBy(*LEAF).orderBy("key"))
    last = edge.withColumn("so_far", F.col("before") + inside - F.col("t")).where("so_far < part").groupBy(*LEAF).agg(F.max("key").alias("key"))
    keys = {(r["domain"], r["lang"], r["source"]): r["key"] for r in last.collect()}
    return small(spark.createDataFrame([(*p, v[0], keys.get(p)) for p, v in plan.items()], "domain string, lang string, source string, whole int, last_key string"))


def copies(seed: int) -> Column:
    in_prefix = F.col("last_key").isNotNull() & (order_key(seed, F.col("whole"), F.col("doc_id")) <= F.col("last_key"))
    return (F.col("whole") + F.when(in_prefix, 1).otherwise(0)).cast("long")


def counted(docs: DataFrame, domain: Column, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return saved(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *leaf_columns(domain, lang_col, source_col), token_count(text_or_empty(f"`{text_col}`")).alias("n_tokens")), "tokens")


def select_mix(docs: DataFrame, domain: Column, share: float = 0.5, weights: dict[tuple, float] | None = None, epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row a document: doc_id, domain, lang, source, n_tokens, copies (0 if not selected).

    The budget is ``share`` of all tokens. A leaf of T tokens and budget B gets B // T whole epochs
    and, of the next, the documents before the point where B % T tokens are reached, the document
    that crosses it included. Null domain, lang or source is the value "none"; null text has no
    tokens, and documents without tokens are in every whole epoch and in a prefix by their place.
    Null ids take part as one id; rows that repeat an id stand side by side in the order and share
    its fate. With no tokens at all nothing is selected. Extra columns are ignored.
    """
    tune(docs.sparkSession)
    rows = counted(docs, domain, id_col, text_col, lang_col, source_col)
    plan = leaf_plan(rows, share, weights, epochs, seed)
    return rows.join(plan, LEAF).select("doc_id", *LEAF, "n_tokens", copies(seed).alias("copies"))


def domain_of(source_col: str = "source", domains: int = 3) -> Column:
    """A domain by rule: the number in a source's name modulo ``domains``."""
    number = F.regexp_extract(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (number.cast("long") % domains).cast("string")))


def apply_mix(docs: DataFrame, share: float, weights: dict[tuple, float] | None = None, epochs: int = 2, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as it was selected, with all their columns. The plan has
    a row a source, so documents are selected where they are and nothing but counts is shuffled.

    Nulls, ties, repeated rows, empty tables and extra columns are as in :func:`select_mix`; names of
    extra columns may be any but __row and __n."""
    tune(docs.sparkSession)
    tokens = counted(docs, domain_of(), "doc_id", "text", "lang", "source")
    plan = leaf_plan(tokens, share, weights, epochs, seed)
    discard(tokens)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    leafed = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), *leaf_columns(domain_of(), "lang", "source"))
    chosen = leafed.join(plan, LEAF).withColumn("__n", copies(seed)).where("__n > 0")
    return chosen.select(F.explode(F.array_repeat("__row", F.col("__n").cast("int"))).alias("__row")).select("__row.*")

"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document and stored as one bit beside the measurements it used.
Policies are versioned masks over those bits, so applying another policy, or asking what each rule
costs (an ablation), is bitwise arithmetic on the ledger and never reads a text again. All of it is
DataFrame expressions inside one scan; no row leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, text_or_empty

ship(__name__)

#: Rules in bit order: name and, over the measurements, the condition under which a document fails.
#: Integer arithmetic. Ledger, policies and the pipeline's filter all read this one list.
RULES: list[tuple[str, Callable[[Column], Column]]] = [
    ("too_few_words", lambda m: m["n_words"] < 50),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    ("symbols", lambda m: 100 * m["n_symbols"] > 10 * m["word_chars"]),
    ("repeated_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    ("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    ("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
]

#: Versioned policies: the rules that reject.
POLICIES: dict[str, list[str]] = {
    "base-1": ["too_few_words", "repeated_windows"],
    "web-1": ["too_few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words"],
}

_SPACE = r"[ \t-\r]+"


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that stand in the text twice or more.

    Windows become 64-bit hashes; only texts where some hash repeats sort (hash, place) pairs, mark
    places with an equal neighbour, and add up what their windows cover. O(n log n) in the text.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: F.get(s, k)["h"] == F.get(s, j)["h"]
            repeated = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.sort_array(F.transform(repeated, lambda k: F.get(s, k)["i"]))

        steps = lambda p: F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3)))
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(pairs, places), steps))

    return F.when(F.size(words) < 4, 0).otherwise(let(hashes, covered))


def measures(text: Column) -> Column:
    """A struct of all measurements. Words are split once and lines are split once."""
    words = F.array_remove(F.split(text, _SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))

    def of(w: Column, x: Column) -> Column:
        values = {
            "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_symbols": symbols, "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)),
            "n_repeat_words": repeated_words(w), "n_lines": F.size(x),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def failure_bits(m: Column) -> Column:
    """Bit i set if rule i fails on the measurements."""
    bits = [F.when(rule(m), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    return sum(bits[1:], bits[0]).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, the measurements, and ``failures``, bit i set if rule i fails.

    Words are runs of characters outside space and \\x09-\\x0D. Null text has no words; a text
    without words fails the length rule only. Null ids, repeated rows and texts of any length are
    rows like any others; an empty table gives an empty result; extra columns are ignored.
    """
    entry = let(measures(text_or_empty(f"`{text_col}`")), lambda m: F.struct(m.alias("m"), failure_bits(m).alias("failures")))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), entry.alias("entry")).select("doc_id", "entry.m.*", "entry.failures")


def mask(policy: str) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def verdicts(rows: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    fails = lambda p: F.col("failures").bitwiseAND(F.lit(mask(p))) != 0
    return rows.withColumn("base_failed", fails("base-1")).withColumn("kept", ~(fails("base-1") | fails(policy)))


def ablation(rows: DataFrame, policy: str = "web-1") -> DataFrame:
    """A row a rule of the policy: documents that fail it, those that only it rejects, and those
    still rejected without it. Reads (failures, count) pairs, at most 2^rules of them."""
    m = mask(policy)
    counts = rows.groupBy(F.col("failures").bitwiseAND(F.lit(m)).alias("f")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (n, _) in enumerate(RULES) if m >> i & 1]))
    each = counts.select("f", "n", rules.alias("r")).select("f", "n", "r.rule", "r.bit")
    with_bit = F.col("f").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(with_bit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not("bit")) != 0, F.col("n")).otherwise(0)).alias("rejected_without"),
    )


def keep_good(docs: DataFrame, policy: str = "web-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ledger entry passes a policy, with all their columns: the ledger's
    failure bits under the policy's mask, as a filter inside the scan, so nothing is joined or shuffled.

    Null, empty and blank texts have no words and go; repeated rows share their fate; null ids, very
    long texts and extra columns are as any; an empty table stays empty."""
    failures = let(measures(text_or_empty(f"`{text_col}`")), failure_bits)
    return docs.where(failures.bitwiseAND(F.lit(mask(policy) | mask("base-1"))) == 0)

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``, whatever their names. Every stage makes an empty table of an empty table. :func:`run` writes each stage's result and reads it back, so a stage
that fails is repeated from its predecessor's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import clear, discard, mark, saved
from quillon.llm.exact_dedup import drop_exact_copies
from quillon.llm.mixing import apply_mix
from quillon.llm.near_dedup import drop_near_copies
from quillon.llm.packing import pack
from quillon.llm.quality import keep_good

#: Tokens of the mix, as a share of what the earlier stages kept.
MIX_SHARE = 0.8
#: Weights of nodes among their siblings; a missing one is 1.
MIX_WEIGHTS = {("domain0",): 3.0, ("domain1",): 2.0, ("domain2",): 2.0}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ledger's policy keeps; null, empty and blank texts go, repeated rows share their fate."""
    return keep_good(docs, "web-1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id; null ids go beside an id, rows that repeat id and text stay together."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links of five-word shingles join, the least id; texts without words all stay."""
    return drop_near_copies(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix selects them; null language or source is the value "none"."""
    return apply_mix(docs, MIX_SHARE, MIX_WEIGHTS, epochs=2, seed=7)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece; null texts and ids are packed like any others, repeated rows once each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", packing)]

#: Near-duplicate components, token ids and packing are beyond SQL; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's scratch tables go once its result is written, and that
    once the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        began, before = mark(), docs
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = saved(out, f"stage{i + 1}")
        clear(spark, began, (docs,))
        discard(before)
    return docs

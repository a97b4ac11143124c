import pytest  # noqa: F401

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """Documents from (id, text); with extra columns whose names clash with internal ones."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "uid", "block", "rid", "node", "kept", "size", "h", "words", "__gone", "key", "grp"):
            df = df.withColumn(name, F.lit("x"))
    return df


#: Nulls, empty and blank texts, ties, repeats, long texts, odd characters.
EDGE = [
    (None, None), (None, "alone here"), (1, None), (2, ""), (3, " \t\n"), (4, "Hello World"), (5, "hello world"), (5, "hello world"), (6, "HELLO world "),
    (7, "\x1fodd\x85 text here é İK"), (8, "word " * 30000), (9, "a b c"), (10, "a b c d e f g h"),
]

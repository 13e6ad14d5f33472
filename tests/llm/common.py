"""Small tables and plain reference versions for the operators."""

import pyarrow.parquet as pq

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    None, "", " ", "one", "one two", "Ünïcode ÀÉ text", "a b c a b c a b c", "x" * 3000,
    "same line\nsame line\n \n\nother\nsame line", "\x0b\x0c\r\n\t", "mail a@b.co, c@d.e.f@g.h", "tail " * 70,
]


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], SCHEMA)


def clashing(docs, *names):
    """The same rows with extra columns of awkward names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def small_documents():
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()

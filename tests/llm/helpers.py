"""Small frames that every operator must take, and brute-force helpers."""

from __future__ import annotations

import zlib

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, partitions: int = 2):
    """(id, text) or (id, text, lang) rows as a documents table."""
    full = [(i, t, x[0] if x else "en", "src0", None if t is None else len(t)) for i, t, *x in rows]
    return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)


def with_clashes(df, *names):
    """Extra columns named like an operator's own."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


def crc(i, folds: int) -> int:
    return zlib.crc32(str(i).encode()) % folds


ODD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "\n\n"), (5, "a"), (6, "word " * 30_000), (7, "x" * 100_000),
    (8, "Ünïcödé 漢字 😀 …\t \u0085 end"), (9, "same text here"), (9, "same text here"), (None, "no id here"), (10, "\0 nul \0"),
]


def labels_schema():
    return T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])

"""Shared helpers of the training-data operators."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Upper bound of one Arrow batch sent to a Python worker, unless the session sets its own.
BATCH_BYTES = 4 << 20
#: How many more ids than wanted are ranked when a sample is drawn.
SPARE = 1.5
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; very long rows are kept out of huge Arrow batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so very long texts cannot fill a worker."""
    now = spark.conf.get(_BATCH_CONF, None)
    if now is None or int("".join(c for c in str(now) if c.isdigit()) or 0) in (0, 1, 2**31 - 1):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id (never held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)), F.lit(-1))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what was
    written, and two jobs over the result share one copy.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_label: int,
    max_chars: int,
    folds: int,
    held_out: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> list[tuple[str, object]]:
    """A bounded sample of (text, label) for fitting, chosen by a hash of the id.

    At most ``per_label`` documents and ``max_chars`` characters of whole texts
    for each label, none of the held-out fold. An id with several labels
    takes its largest; null ids, texts and labels, and texts longer than ``max_chars``
    are left out. ``labels`` may
    be ``docs`` itself when the label is a column of the documents.
    """
    rows = sample_rows(docs, labels, label_col, per_label, max_chars, folds, held_out, id_col, text_col)
    return _ordered([(r["_text"], r["_label"]) for r in rows.collect()]) if rows is not None else []


def _ordered(sample: list[tuple[str, object]]) -> list[tuple[str, object]]:
    return sorted(sample, key=lambda x: (str(x[1]), x[0]))


def fit_in_task(rows: DataFrame | None, fit: Callable[[list[tuple[str, object]]], object]) -> object:
    """What ``fit`` makes of a sample of ``sample_rows``, worked out in one task: the driver holds no text.

    The sample is bounded by its parameters, whatever the table. ``fit`` returns plain data (numbers,
    strings, arrays and containers of them); None for the rows is an empty sample.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = [x for b in batches for x in zip(b["_text"].tolist(), b["_label"].tolist())]
        yield pd.DataFrame({"made": [pickle.dumps(fit(_ordered(sample)))]})

    made = rows.coalesce(1).mapInPandas(work, "made binary").collect() if rows is not None else []
    return pickle.loads(made[0]["made"]) if made else fit([])


def sample_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    per_label: int,
    max_chars: int,
    folds: int,
    held_out: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame | None:
    """The rows (_text, _label) of ``labelled_sample``; None if no id has a label."""
    ids = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != held_out))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
    )
    # Only hashes that can be among a label's first are ranked: of a label with many ids, those in the
    # lowest share of the hash range that holds about SPARE times as many as are wanted.
    # one row for each label, as the model has one part for each
    sizes = ids.groupBy("_label").count().collect()
    if not sizes:
        return None
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r["_label"], r["count"])])[F.col("_label")]
    ids = ids.withColumn("_h", F.xxhash64("_id"))
    place = F.col("_h").cast("double") / 2.0**64 + 0.5
    ids = ids.where(place * size <= SPARE * (per_label + 50))
    pick = Window.partitionBy("_label").orderBy("_h", "_id")
    ids = ids.withColumn("_n", F.row_number().over(pick)).where(F.col("_n") <= per_label).select("_id", "_label", "_n")
    texts = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).where(F.length("_text") <= max_chars)
    # at most per_label ids a label: bounded by the parameter, not by the data
    rows = texts.join(F.broadcast(ids), F.col("_key") == F.col("_id"))
    again = Window.partitionBy("_label").orderBy("_n", F.xxhash64("_text"))
    rows = rows.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= per_label)
    running = Window.partitionBy("_label").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chars", F.sum(F.length("_text")).over(running)).where(F.col("_chars") <= max_chars)
    return rows.select("_text", "_label")

"""A corpus from raw documents to tokens: quality, toxicity, near-duplicates, benchmark leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginscope.llm import bpe, common, decontaminate, ngram_join, quality_crf, toxicity
from marginscope.llm.queries import ranks


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field finds good, in one pass."""
    model = quality_crf.fit_documents(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality_crf.quality(docs, model) >= quality_crf.GOOD)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon model finds not toxic, in one pass."""
    model = toxicity.fit_documents(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(docs, model) < toxicity.TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component; every distinct text is judged on its own."""
    return ngram_join.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to the error budget."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of each document's text, and the digests of ids and decoded bytes."""
    return bpe.round_trip(docs, ranks(), keep=("lang", "source", "n_chars"))


STAGES = [
    ("quality", drop_low_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The fitted models and exact joins of texts have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

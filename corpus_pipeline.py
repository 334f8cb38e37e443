"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``; the last adds
the shard and the slot in it. An empty table passes through every stage. Columns beyond those of ``documents`` are
carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import cut, discard
from sitelens.llm.decontaminate import decontaminate
from sitelens.llm.mixing import mixed_documents
from sitelens.llm.near_dedup import drop_near_duplicates
from sitelens.llm.sharding import hilbert_shards
from sitelens.llm.toxicity import score_toxicity, train_toxicity

SHARDS = 24
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go.

    The model learns from a bounded sample of the labelled rows (see ``train_toxicity``); every text is scored whole.
    Null, empty and blank texts have no evidence and stay, unless there are only toxic labels. Repeated rows share their
    fate. Without labels all stay.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, out="__toxicity").where(F.col("__toxicity.score") < TOXIC).drop("__toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the least id: five-word shingles, similarity 0.8 or more.

    Null, empty and blank texts are in no group and stay. Of rows that repeat id and text one stays. A row without an id
    stays if its group has no row with one.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item, or all words of a shorter one, go.

    Null and empty texts and null items have no windows. Repeated rows share their fate. Without items all stay.
    """
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="__contamination")
    return found.where(F.col("__contamination.n_hit") == 0).drop("__contamination")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: a document stands as often as the mix takes it, in training order.

    Null and empty texts have no words to take, so they go; a null source is one of its own. Rows alike in id and text
    may take each other's places.
    """
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows are dealt to SHARDS shards along a Hilbert curve of language, source and size, counts at most one apart.

    Null dimensions lie in the lowest cell, null ids first in theirs; repeated rows take neighbouring slots in either order.
    """
    return hilbert_shards(docs, SHARDS).select(*docs.columns, "shard", "slot")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained score, MinHash groups and range orders have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

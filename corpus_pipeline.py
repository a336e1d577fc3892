"""The training-data pipeline: stages applied in order to the documents.

Stages that pass documents on read texts in batches of bounded size: an executor's memory is shared by Spark, the
Python workers and the batches between them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontamination, ngram_join, packing, substrings, toxicity
from seriesloom.llm.common import table
from seriesloom.llm.encoding import default_tokenizer
from seriesloom.storage import bounded_batches, written_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage, with bounded batches in all that it stores."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with bounded_batches(spark):
            return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity stays: that with the smallest id."""
    return ngram_join.one_per_group(docs)


@bounded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has as well are cut out of the texts; no document goes.

    The result is stored, as its last step passes the texts through Python.
    """
    return written_table(substrings.without_repeats(docs))


@bounded
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids that hold every document left."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

# Models, shingle joins, automata and tokenizers have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn on ``documents``; each reads what the one before stored."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with bounded_batches(spark):
            docs = stage(spark, docs, sf_dir)
            docs = docs if stage is cut_repeats else written_table(docs)
    return STAGES[-1][1](spark, docs, sf_dir)

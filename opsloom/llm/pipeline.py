"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding.

Each stage takes what its predecessor kept, written as Parquet and read again.
All stages but the last return the columns of ``documents``; the last adds the
slot and shard. Rejected, duplicate and contaminated documents go; the mix
repeats rows of sources that are to weigh more than they have and drops rows of
those that are to weigh less.

Defined results, stage by stage:
- language: null texts and texts without a letter go, since they are in no
  language; where no row has a language nothing is rejected; repeated rows are
  judged alike.
- near_duplicates: of the documents that links join, that with the smallest id
  stays; of rows that repeat an id one stays; rows without an id all stay;
  documents without words are no copies of each other.
- decontaminate: every row whose own text holds an item goes, whatever other
  rows of its id hold; without a benchmark nothing goes.
- mix: a null source is a source of its own; documents without words take part
  with size 0 and are never taken; rows of one id are taken alike.
- shard: a null id has the shard of the empty string; repeated ids share one.
Each of them gives an empty table for an empty table and ignores other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom.llm import decontamination, language_id, ngram_join, sharding, source_mixing
from opsloom.llm.workspace import Workspace


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, size=5, percent=80, name="stage-near")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.mix_rows(docs, name="stage-mix")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
    ("sharding", shard),
]

#: Stages 1 to 3 rest on learned weights and alignments, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages, each an operator of siftwood.llm whose decisions take effect on what the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All stages
but the last return the columns of documents (and any further columns that the input has).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwood.llm.common import Scratch, read_table
from siftwood.llm.decontaminate import drop_contaminated
from siftwood.llm.mixing import mix_documents
from siftwood.llm.ngram_join import keep_one_of_each_group
from siftwood.llm.quality import keep_quality
from siftwood.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.7) go."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest doc_id."""
    return keep_one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it (0 to 2 times)."""
    return mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document of the mix; copies of one text are linked."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: The stages learn, draw and iterate, which SQL doesn't express; a test runs their plain versions one after the other and compares.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            out._siftwood_pipeline = scratch
            return out
        docs = scratch.write(out, f"{k}-{name}")
    raise AssertionError("no stages")

"""From raw documents to token ids: quality, near duplicates, mixture of sources, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back
as the next stage's docs; all but the last return the columns of ``documents``, and any further columns
that the documents have. Columns that a stage needs besides have names that none of these has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import byte_bpe, mixing, ngram_join, quality
from graphloom.llm.textarrays import free_name
from graphloom.sources.shared_storage import write_shared

#: Documents whose probability of good quality is below this are rejected.
REJECT_BELOW = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted to the labels of these documents, does not reject.

    Null and empty texts are scored like others; equal texts stay or go together; an empty table stays empty.
    """
    net = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name("quality", docs.columns)
    return quality.score(docs, net, name).where(F.col(name) >= REJECT_BELOW).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles.

    The smallest doc_id stays, of rows that share it one; null and empty texts link with nothing and all
    stay; an empty table stays empty.
    """
    return ngram_join.one_per_group(docs, k=5, num=80, den=100)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: none, once or twice.

    Null sources are a source of their own, and null ids share one place in the random order; an empty
    table stays empty.
    """
    return mixing.mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every remaining row, and of the text that decoding them gives.

    Rows that the mixture repeats are repeated; null texts are empty; an empty table gives an empty result.
    """
    return byte_bpe.digests(docs, *byte_bpe.public_ranks())


STAGES = [("quality_filter", quality_filter), ("near_duplicates", near_duplicates), ("source_mixture", source_mixture), ("token_ids", token_ids)]

#: The first stage learns its filters by gradient descent, which SQL cannot express; tests check the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

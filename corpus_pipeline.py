"""documents -> quality -> toxicity -> near duplicates -> packed sequences.

Each stage works on all rows that the one before it kept, whole texts included; all but the last return the columns
of documents. run() writes each result as Parquet into the shared folder and reads it again. Null and empty texts are scored like
any other, have no near duplicates and are packed as the closing token; rows with a null id stay unless a score rejects
them; a repeated row stays once from the third stage on; further columns pass the filters unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import best_fit_packing, minhash_dedup, quality_rules, toxicity
from quern.llm.common import dropped, stored
from quern.llm.queries import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return quality_rules.kept(docs, _labels(spark, sf_dir), 0.3)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    return toxicity.clean(docs, _labels(spark, sf_dir), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles, that with the smallest id."""
    return minhash_dedup.deduplicated(docs, minhash_dedup.Policy(shingle=5, percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return best_fit_packing.packed(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", packing)]

#: SQL can't express the fitted classifiers; tests/llm holds the stages' columns, that each returns rows of its input, and the share of
#: clean and other labelled documents that stay. The near-duplicate and packing operators have plain versions there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

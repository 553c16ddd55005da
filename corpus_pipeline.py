"""A training-corpus pipeline over the ``documents`` table, in five stages.

Each stage takes what the one before it kept.  All but the last return the
columns of ``documents``.  Defined results: null and empty texts have no language
and go in the first stage; rows that share a key, or have none, are told apart by
their texts, and exact repeats of a row count as copies; columns of any name pass
through; an empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import clear_since, materialize, scratch_mark
from tessella.llm.contamination import drop_contaminated
from tessella.llm.langid import keep_identified
from tessella.llm.mixing import mixed_documents
from tessella.llm.queries import table, tokenizer_path
from tessella.llm.simhash import drop_near_duplicates
from tessella.llm.tokens import token_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return drop_near_duplicates(docs, words_per_shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their targets: a document stands as often as the mix takes it."""
    return mixed_documents(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards; a row for each document in them."""
    return token_shards(docs, tokenizer_path(), end_id=2)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL has neither the context trees nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``, each written before the next one reads it; what a stage has written on its way is deleted then."""
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clear_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

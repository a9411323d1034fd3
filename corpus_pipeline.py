"""A corpus pipeline of five stages over `documents`: reject toxic texts, keep one of each group of near copies, reject
what contains benchmark items, mix sources, deal into shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubespark.llm import decontamination as leaks
from cubespark.llm import mixing, ngram_jaccard, sharding
from cubespark.llm import toxicity as toxic
from cubespark.llm._shared import checkpoint, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled rows of `docs` in the usable fold; documents whose score reaches their language's threshold go."""
    model, limits = toxic.train(docs, table(spark, sf_dir, "labels"))
    return toxic.accepted(docs, model, limits)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays, that with the smallest doc_id."""
    return ngram_jaccard.one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a test item occurs with edits of at most 5 % of its length go."""
    return leaks.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays once; small sources are repeated, twice at most, towards equal weights."""
    return mixing.repeated(docs, mixing.mix(docs, repetition=2.0, cover=True))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: shard and slot in it."""
    return sharding.shard(docs, shards=40)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: The stages train a model and draw at random, which SQL does not express. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return docs

"""A corpus pipeline over ``documents``: five stages, each calling one operator of ``microbook.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``; the last returns the mix: a row per document that is left, with the words it is taken for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from microbook.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from microbook.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores at 0.5 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 of their five-word shingles, the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs, shingle=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ten-word passages of ``benchmark`` items (and shorter items as a whole) are cut; documents that would lose over a tenth of their words go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document that is left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: SQL can express neither the fitted classifier nor the cube method; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

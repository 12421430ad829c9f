"""The corpus pipeline: language identification, exact and near de-duplication, mixing, and piece encoding of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, langid, mixing, near_dedup, pieces
from textloom.llm.common import mark, materialize, release_since, table

#: A prediction whose score is below this many times that of a guess between the learned languages is a rejection.
LEAST_LIFT = 1.2


def least_score(languages: int) -> float:
    """A guess between n languages scores 1 / n; with one or none there is nothing to reject by."""
    return LEAST_LIFT / languages if languages > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that the classifier cannot tell; all stay if no language could be learned."""
    model = langid.train(docs, ~langid.held_out())
    if not model.langs:
        return docs
    told = langid.predict(docs, model)
    return told.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least_score(len(model.langs)))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, width=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents by the sources' weights: some go, some come up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding."""
    return pieces.with_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("pieces", encode),
]

#: Trained classifiers, hashed orders and segmentation cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs, began = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release_since(spark, began, docs)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: toxicity, near-duplicates, personal data, source mix, tokens; each stage works on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, near_dup, pieces, pii, toxicity
from corpusloom.llm.common import free_names, materialize, read_table

THRESHOLD = 0.7
#: The sampled segmentations have no equivalent in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD, by a model of all labels.

    Null and empty texts score as the model's intercept. An empty table stays empty; other columns, whatever their names,
    and repeated rows stay as they are. A text is scored whole, however long.
    """
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), holdout=None)
    (score,) = free_names(docs, "_score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns.

    Null and empty texts are one group. The least doc_id of a group stays, and one of the rows that repeat it, so that
    reruns agree. An empty table stays empty.
    """
    return near_dup.without_near_duplicates(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in the whole text; null texts stay null, other columns as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source of its own, documents without words are never taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document; an empty or null text has one of no pieces, and repeated rows have equal ones."""
    return pieces.segmentations(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("source mix", mix_sources),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs

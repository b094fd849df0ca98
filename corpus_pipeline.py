"""The document pipeline: stages that each read what the one before has written.

Rejected are toxic documents, all but one document of each near-duplicate
group, and documents that hold a benchmark item. The rest has its personal data
masked and is encoded into pieces. All stages but the last return the columns of their input; the last adds
``ids``. A stage judges whole texts and all rows it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.llm import decontamination, minmax, pieces, pii, toxicity
from parcella.llm.common import Scratch, fresh_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last link gives toxicity less than even odds."""
    chances = fresh_name(docs.columns, "p_toxicity")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), output=chances)
    return scored.where(F.element_at(chances, -1) < toxicity.THRESHOLD).drop(chances)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group; rows without an id stay.

    Of rows that repeat an id all stay, as they are one document.
    """
    groups = minmax.near_duplicates(docs.select("doc_id", "text"))
    # Groups are found by id, so a dropped id is a dropped document.
    dropped = groups.where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    leaks = fresh_name(docs.columns, "leaks")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), output=leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans replaced by their kind; n_chars follows a changed text."""
    return pii.mask_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and their piece ids."""
    return pieces.encode(docs, output=fresh_name(docs.columns, "ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("pieces", encode),
]

#: SQL cannot express the learned stages; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs

"""documents to packed training sequences, in five stages; each works on all that the one before it kept.

Every stage but the last returns the columns it got, whatever other columns the table has and whatever their names. Rows
are judged one by one, by a number stored with them: one without an id goes like any other, and of rows of one id a good
one stays where a bad one goes. A null or empty text is good, alike to nothing, not
contaminated and without secrets, and is packed as an end token. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postmill.llm.common import forget, stored, table
from postmill.llm.decontamination import decontaminate
from postmill.llm.near_duplicates import drop_near_duplicates
from postmill.llm.packing import pack_documents
from postmill.llm.quality import keep_good
from postmill.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under trusted text is beyond their language's threshold.

    A null language goes by all languages; without trusted documents all stay.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar ones: five-word shingles, similarity of 0.8 or more.

    It is the one of the smallest id, or one without an id where no row of the group has one; of repeated rows one stays.
    """
    return drop_near_duplicates(docs, width=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents a twentieth of whose words or more stand in windows of benchmark items; an empty benchmark, none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), near=None)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Marks secrets out of the texts; every document stays, with n_chars of the text it has then."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences. Equal texts would be kept apart; the stages
    before leave none, so here bins differ in their sources."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The quality model and the packing order aren't for SQL; tests/llm/test_pipeline.py checks stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's table is stored, and goes once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over the documents table, each written as Parquet and read by the next.

quality: documents that the co-trained classifier rejects go. near_duplicates: one document of each group of
similar ones stays. decontamination: documents with passages of the benchmark go. secrets: secrets in texts are
replaced by a mark. mixing: the places of all documents in a mixture of their sources are added. Texts of any length are
taken whole, extra columns stay whatever their names, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.mixing import mix
from tidemark.llm.secret_scans import redact
from tidemark.llm.store import Shelf
from tidemark.llm.textops import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by ``labels``, keeps. Nulls are values of their own; without labels all stay."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).where("quality_keep").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group. Documents without words, null or empty, all stay."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``. Null and empty texts have none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, with n_chars of the masked text (null for a null text)."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their places in the mixture. A null source is one of its own."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: The first stage can't be told in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is dropped once the next one is written."""
    shelf, docs, last = Shelf(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = shelf.keep(stage(spark, docs, sf_dir))
        if last is not None:
            shelf.drop(last)
        last = docs
    return docs

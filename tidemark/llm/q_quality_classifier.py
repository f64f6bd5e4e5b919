"""op2: quality scores of all documents, learned from the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import quality_classifier as qc
from tidemark.llm.textops import table


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = qc.fit(docs, table(spark, sf_dir, "labels"))
    return qc.score(docs.select("doc_id", "text", "source", "lang"), model).drop("text", "source", "lang")


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
ORACLE_SQL: dict[str, str] = {}

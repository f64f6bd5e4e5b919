"""op7: fingerprints of all documents and of edited ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.fingerprints import edit_likeness
from tidemark.llm.textops import table


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprints": op7_fingerprints}
ORACLE_SQL: dict[str, str] = {}

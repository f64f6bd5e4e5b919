"""op6: language-model scores of all documents, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lm_scoring import lm_scores
from tidemark.llm.textops import table


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return lm_scores(docs, ~F.col("held_out"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE_SQL: dict[str, str] = {}

"""op10: the language of all documents, learned from those that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language_id import fit, identify
from tidemark.llm.textops import table


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out)
    model = fit(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}

"""op9: token counts of all documents with the 32k piece vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.textops import table
from tidemark.llm.token_counts import count_tokens


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}

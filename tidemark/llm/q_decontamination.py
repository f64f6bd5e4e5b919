"""op1: which documents hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.decontamination import decontaminate
from tidemark.llm.textops import LOWER, UPPER, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def decontamination_sql(documents: str = "documents") -> str:
    """CTEs that end in ``decon``: a row for each row of ``documents``, with its number ``rid``."""
    return rf"""
dw AS (SELECT row_number() OVER () AS rid, *, {WORDS} AS w FROM {documents}),
iw AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w, least(len({WORDS}), 10) AS n FROM benchmark),
gram AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM iw WHERE n > 0)),
seen AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM gram) WHERE len(w) >= n)),
found AS (SELECT rid, n, k, g FROM seen WHERE g IN (SELECT g FROM gram)),
words_hit AS (SELECT rid, count(DISTINCT k + j) AS n_hit FROM (SELECT rid, k, unnest(range(0, n)) AS j FROM found) GROUP BY rid),
items_hit AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM found JOIN gram USING (g)) GROUP BY rid),
decon AS (SELECT dw.*, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM dw LEFT JOIN words_hit USING (rid) LEFT JOIN items_hit USING (rid))"""


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE_SQL = {"op1_decontamination": f"WITH {decontamination_sql()} SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM decon"}

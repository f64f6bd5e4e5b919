"""op3: components of documents with similar sets of 5-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.jaccard_join import similarity_components
from tidemark.llm.textops import LOWER, UPPER, table


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def components_sql(documents: str = "documents") -> str:
    """CTEs (some recursive) that end in ``comp``: doc_id, n_shingles, component_id."""
    return rf"""
jw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM {documents}),
js AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM jw WHERE len(w) > 0)),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM js x JOIN js y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
jl AS (SELECT a, b FROM jp JOIN jn na ON na.doc_id = a JOIN jn nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM jw UNION SELECT reach.a, jl.b FROM reach JOIN jl ON reach.b = jl.a),
comp AS (SELECT jw.doc_id, coalesce(jn.n, 0)::BIGINT AS n_shingles, r.component_id
  FROM jw LEFT JOIN jn USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id))"""


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
ORACLE_SQL = {"op3_jaccard_join": f"WITH RECURSIVE {components_sql()} SELECT doc_id, n_shingles, component_id FROM comp"}

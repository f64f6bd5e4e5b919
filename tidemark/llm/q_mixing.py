"""op8: the place of all documents in a mixture of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.mixing import mix
from tidemark.llm.textops import table


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def mixing_sql(documents: str = "documents", block: int = 16) -> str:
    """CTEs (one recursive) that end in ``mixed``: rows of ``documents`` with mix_slot, mix_order, in_mix."""
    return f"""
mcount AS (SELECT coalesce(source, 'null') AS s, count(*) AS n FROM {documents} GROUP BY ALL),
mshare AS (SELECT s, n, greatest(1, floor(100 * sqrt(n) / sqrt((SELECT max(n) FROM mcount)) + 0.5))::BIGINT AS a FROM mcount),
mperiod AS (SELECT sum(a)::BIGINT AS m, list(s ORDER BY s) AS names, list(a ORDER BY s) AS shares FROM mshare),
-- each step runs the released block with the earliest deadline; done counts the blocks that have run
mstep AS (SELECT 0::BIGINT AS slot, list_transform(shares, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM mperiod
  UNION ALL SELECT slot + 1, list_transform(range(1, len(done) + 1), lambda i: done[i] + CASE WHEN i = best THEN 1 ELSE 0 END), best
  FROM (SELECT slot, done, list_min(list_filter(list_transform(range(1, len(done) + 1), lambda i:
      CASE WHEN done[i] < shares[i] AND done[i] * m // shares[i] <= slot THEN ((((done[i] + 1) * m + shares[i] - 1) // shares[i]) * 1000000 + i) END), lambda x: x IS NOT NULL)) % 1000000 AS best
    FROM mstep, mperiod WHERE slot < m)),
mplan AS (SELECT names[pick] AS s, slot - 1 AS slot, done[pick] - 1 AS k FROM mstep, mperiod WHERE pick > 0),
mrow AS (SELECT *, coalesce(source, 'null') AS s, row_number() OVER (PARTITION BY coalesce(source, 'null') ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS place FROM {documents}),
mend AS (SELECT min((n // {block}) // a * m + slot) AS e FROM mshare JOIN mplan USING (s), mperiod WHERE k = (n // {block}) % a),
mixed AS (SELECT mrow.*, ((place // {block}) // a * m + slot)::BIGINT AS mix_slot, (place % {block})::INT AS mix_order,
    (place // {block}) // a * m + slot < (SELECT e FROM mend) AS in_mix
  FROM mrow JOIN mshare USING (s) JOIN mplan USING (s), mperiod WHERE k = (place // {block}) % a)"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLE_SQL = {"op8_mixing": f"WITH RECURSIVE {mixing_sql()} SELECT doc_id, source, mix_slot, mix_order, in_mix FROM mixed"}

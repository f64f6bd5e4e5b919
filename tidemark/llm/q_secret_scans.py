"""op5: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import secret_scans as ss
from tidemark.llm.textops import table


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ss.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), text=False)
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(ss.listed(base), 256).alias("base_sha256"), ss.listed(F.col("secret_spans")).alias("spans"))


#: What the SQL looks for and how it tests, in its own words: patterns of the contract, a coarser pattern of runs than the
#: operator's (it keeps "=" and signs of both kinds of base 64 inside), encodings, limits of strata, and the normal tail.
SQL_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"""
SQL_PATTERNS = (SQL_ASSIGN, "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}", "[A-Za-z0-9+/_=-]{20,}")
SQL_KIND = """CASE
  WHEN regexp_full_match(y, '[0-9a-f]+') AND regexp_matches(y, '[0-9]') AND regexp_matches(y, '[a-f]') THEN '0123456789abcdef'
  WHEN regexp_full_match(y, '[0-9A-F]+') AND regexp_matches(y, '[0-9]') AND regexp_matches(y, '[A-F]') THEN '0123456789ABCDEF'
  WHEN regexp_full_match(y, '[A-Z2-7]+') AND regexp_matches(y, '[2-7]') AND regexp_matches(y, '[A-Z]') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'
  WHEN regexp_full_match(y, '[0-9a-z]+') AND regexp_matches(y, '[0-9]') AND regexp_matches(y, '[a-z]') THEN '0123456789abcdefghijklmnopqrstuvwxyz'
  WHEN NOT (regexp_matches(y, '[0-9]') AND regexp_matches(y, '[a-z]') AND regexp_matches(y, '[A-Z]')) THEN NULL
  WHEN regexp_full_match(y, '[0-9A-Za-z]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'
  WHEN regexp_full_match(y, '[0-9A-Za-z+/]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/'
  WHEN regexp_full_match(y, '[0-9A-Za-z_-]+') THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_' END"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tail(z: str) -> str:
    """The upper tail of a standard normal, by the approximation 26.2.17 of Abramowitz and Stegun."""
    t = f"(1 / (1 + 0.2316419 * {z}))"
    powers = " + ".join(f"({b}) * pow({t}, {k})" for k, b in enumerate((0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 1))
    return f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ({powers}))"


def secrets_sql(documents: str = "documents", alpha: float = 0.05) -> str:
    """CTEs that end in ``secrets``: rid, start, stop, kind rank ``k`` of every span; ``sdocs`` numbers the rows."""
    scans = "\nUNION ALL ".join(
        f"SELECT rid, {k} AS k, string_split_regex(text, {_lit(p)}) AS p, regexp_extract_all(text, {_lit(p)}, 0) AS m, regexp_extract_all(text, {_lit(p)}, {2 if k == 0 else 0}) AS g FROM sdocs WHERE regexp_matches(text, {_lit(p)})"
        for k, p in enumerate(SQL_PATTERNS)
    )
    one = f"CASE WHEN z1 >= 0 THEN {_tail('z1')} ELSE 1 - {_tail('(-z1)')} END"
    stratum = "CASE WHEN n < 48 THEN 0 WHEN n < 80 THEN 1 WHEN n < 160 THEN 2 ELSE 3 END"
    return f"""
sdocs AS (SELECT row_number() OVER () AS rid, * REPLACE (coalesce(text, '') AS text) FROM {documents}),
smatch AS ({scans}),
sone AS (SELECT rid, k, i, length(p[i]) AS lp, length(m[i]) AS lm, m[i] AS x, length(g[i]) AS lg FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM smatch)),
splace AS (SELECT rid, k, x, lg, sum(lp + lm) OVER w - lm AS s, sum(lp + lm) OVER w AS e FROM sone WINDOW w AS (PARTITION BY rid, k ORDER BY i)),
sbase AS (SELECT rid, k, s::BIGINT AS s, e::BIGINT AS e FROM splace WHERE k < 3 AND (k > 0 OR lg >= 6)),
scand AS (SELECT row_number() OVER () AS cid, rid, s::BIGINT AS s, e::BIGINT AS e, rtrim(x, '=') AS y FROM splace c WHERE k = 3
  AND NOT EXISTS (SELECT 1 FROM sbase b WHERE b.rid = c.rid AND b.s < c.e AND c.s < b.e)),
scode AS (SELECT cid, rid, s, e, length(y)::DOUBLE AS n, length(a)::DOUBLE AS k, string_split(y, '') AS ch, a FROM (SELECT *, {SQL_KIND} AS a FROM scand) WHERE a IS NOT NULL AND length(y) >= 20),
schar AS (SELECT cid, n, k, i, (instr(a, ch[i]) - 1)::DOUBLE AS v, ch[i] AS c FROM (SELECT *, unnest(range(1, len(ch) + 1)) AS i FROM scode)),
schi AS (SELECT cid, sum(o * o) AS o FROM (SELECT cid, c, count(*)::DOUBLE AS o FROM schar GROUP BY cid, c) GROUP BY cid),
smean AS (SELECT cid, sum(v) / any_value(n) AS m FROM schar GROUP BY cid),
spair AS (SELECT cid, n, k, v, m, lag(v) OVER (PARTITION BY cid ORDER BY i) AS u FROM schar JOIN smean USING (cid)),
srun AS (SELECT cid, count(*) FILTER (v >= k / 2)::DOUBLE AS up, 1.0::DOUBLE + count(*) FILTER (u IS NOT NULL AND (v >= k / 2) <> (u >= k / 2)) AS runs,
    coalesce(sum((v - m) * (u - m)), 0) / greatest(1e-9, sum((v - m) * (v - m))) AS r FROM spair GROUP BY cid),
sz AS (SELECT cid, rid, s, e, n, k, (k / n * o - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n) AS z1, 2 * up * (n - up) AS u, runs, abs(r + 1 / (n - 1)) * sqrt(n) AS z3 FROM scode JOIN schi USING (cid) JOIN srun USING (cid)),
sz2 AS (SELECT *, CASE WHEN u <= n THEN 9 ELSE abs(runs - 1 - u / n) / sqrt(u * (u - n) / (n * n * (n - 1))) END AS z2 FROM sz),
scell AS (SELECT rid, s, e, {stratum} AS stratum, n * log2(k) AS bits,
    ceil(round((1 - pow(1 - least(1, {one}, 2 * {_tail('z2')}, 2 * {_tail('z3')}), 3)) * 10000, 6))::INT AS cell FROM sz2),
shist AS (SELECT stratum, cell, sum(n) AS n FROM (SELECT stratum, greatest(cell, 50) AS cell, 1 AS n FROM scell WHERE bits >= 90 UNION ALL SELECT DISTINCT stratum, 50, 0 FROM scell WHERE bits >= 90) GROUP BY ALL),
sabove AS (SELECT x.stratum, x.cell, coalesce(sum(y.n) FILTER (y.cell > x.cell), 0) AS above, coalesce(sum(y.n) FILTER (y.cell > 5000), 0) AS half FROM shist x JOIN shist y USING (stratum) GROUP BY x.stratum, x.cell),
slimit AS (SELECT stratum, min(cell) AS top FROM sabove WHERE above - 2 * half * (10000 - cell) / 10000 <= {alpha} * above + 1 + 2 * sqrt(2 * half) GROUP BY stratum),
secrets AS (SELECT rid, k, s, e FROM sbase UNION ALL
  SELECT rid, 3, s, e FROM scell JOIN slimit USING (stratum) WHERE bits >= 90 AND cell > top)"""


LIST = "string_agg(list_extract(['assign', 'access', 'hex', 'random'], k + 1) || ':' || s || ':' || e, ',' ORDER BY s, k)"
QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLE_SQL = {
    "op5_secret_scans": f"""WITH {secrets_sql()}
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM sdocs LEFT JOIN (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  {LIST.replace("ORDER BY s, k)", "ORDER BY s, k) FILTER (k < 3)")} AS base, {LIST} AS spans FROM secrets GROUP BY rid) USING (rid)"""
}

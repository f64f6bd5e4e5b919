"""op4: linked and formatted conversations.

The table holds plain turns, no tool calls. So they are written as tool messages first: each user turn as an
assistant's JSON with a call of the tool ``reply`` and the identifier conv_id:turn, each assistant turn as a tool's JSON with
the result of the call one turn before; all others stay. A call on a turn that leaves 0 or 2 when divided by 6 depends on
the call two turns later, any other on the one six turns earlier (from turn 6 on), so up to three calls stand out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat_formatting import link_tool_calls, tool_messages
from tidemark.llm.textops import table

TOOLS = {"reply": {"properties": {"chars": {"type": "integer", "minimum": 40}, "text": {"type": "string", "minLength": 1}}, "required": ["chars", "text"], "additionalProperties": False}}


def as_messages(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) written as tool messages."""
    name = lambda ahead: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") + ahead).cast("string"))
    text = F.coalesce("text", F.lit(""))
    needs = F.when((F.col("turn") % 6).isin(0, 2), F.array(name(2))).when(F.col("turn") >= 6, F.array(name(-6))).otherwise(F.array().cast("array<string>"))
    call = F.struct(name(0).alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("text"), F.length(text).alias("chars")).alias("arguments"), needs.alias("depends_on"))
    calls = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    result = F.to_json(F.struct(name(-1).alias("tool_call_id"), text.alias("content")))
    role, asks, tells = F.col("role"), F.col("role") == "user", F.col("role") == "assistant"
    return turns.select("conv_id", "turn", F.when(asks, "assistant").when(tells, "tool").otherwise(role).alias("role"), F.when(asks, calls).when(tells, result).otherwise(F.col("text")).alias("text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return link_tool_calls(*tool_messages(as_messages(turns)), TOOLS)


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLE_SQL = {
    "op4_chat_formatting": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT *, conv_id || ':' || turn AS call_id, CASE WHEN turn % 6 IN (0, 2) THEN conv_id || ':' || (turn + 2) WHEN turn >= 6 THEN conv_id || ':' || (turn - 6) END AS needed FROM t WHERE role = 'user'),
a AS (SELECT *, conv_id || ':' || (turn - 1) AS call_id FROM t WHERE role = 'assistant'),
n AS (SELECT call_id, u.turn, any_value(needed) AS needed, min(a.turn) AS reply FROM u LEFT JOIN a USING (call_id) GROUP BY call_id, u.turn),
-- an order counts 1000 a turn and 1 a step; a call comes after what it needs, and after the result of that
o AS (SELECT call_id, reply, 1000 * turn::BIGINT AS place FROM n WHERE needed IS NULL OR needed NOT IN (SELECT call_id FROM n)
  UNION ALL SELECT n.call_id, n.reply, greatest(1000 * n.turn, CASE WHEN o.reply IS NULL THEN o.place + 1 ELSE greatest(1000 * o.reply + 1, o.place + 2) END) FROM n JOIN o ON n.needed = o.call_id),
c AS (SELECT conv_id, floor(place / 1000)::BIGINT AS order_turn, (place % 1000)::INT AS order_step, turn, 0 AS seq, 'call' AS kind, call_id,
    CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.call_id = u.call_id) THEN 'linked' ELSE 'unanswered' END AS status,
    array_to_string(list_filter([CASE WHEN length(text) < 40 THEN 'chars is too small' END, CASE WHEN length(text) < 1 THEN 'text is too short' END,
      CASE WHEN needed IS NOT NULL AND needed NOT IN (SELECT call_id FROM n) THEN 'needs ' || needed END], lambda x: x IS NOT NULL), '; ') AS errors,
    '{"arguments":{"chars":' || length(text) || ',"text":' || to_json(text) || '},"call_id":"' || call_id || '","conv_id":' || conv_id || ',"name":"reply","type":"call"}' AS json FROM u JOIN o USING (call_id)),
r AS (SELECT conv_id, coalesce(floor(greatest(1000 * turn, place + 1) / 1000), turn)::BIGINT, (CASE WHEN place IS NULL THEN 0 ELSE greatest(1000 * turn, place + 1) % 1000 END)::INT, turn, 0, 'result', call_id, CASE WHEN place IS NOT NULL THEN 'linked' ELSE 'orphan' END, '',
    '{"call_id":"' || call_id || '","content":' || to_json(text) || ',"conv_id":' || conv_id || ',"type":"result"}' FROM a LEFT JOIN (SELECT call_id, place FROM o) USING (call_id)),
p AS (SELECT conv_id, turn, 0, turn, 0, 'plain', NULL, 'plain', '',
    '{"content":' || to_json(text) || ',"conv_id":' || conv_id || coalesce(',"role":' || to_json(role), '') || ',"type":"plain"}' FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant'))
SELECT * FROM c UNION ALL SELECT * FROM r UNION ALL SELECT * FROM p"""
}

"""Linking tool calls with their results, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier. Each call is ordered after the results of
the calls that it depends on: its order is its turn, or, where something it needs stands at the same turn or
later, just after that. Calls with one dependency form chains, which are followed by doubling, in rounds that grow with
the logarithm of the longest chain; a chain that comes back to itself is a cycle. Calls with several dependencies are then
relaxed along the chains between them until nothing moves, which takes a round where turns are in order, and
otherwise as many as such calls stand on the longest path out of order; if that does not end soon, the calls that others
need and that need others are trimmed from both ends, and what is left goes in cycles. Arguments are
validated against the tools' schemas, and everything is serialised as canonical JSON: keys sorted at every
depth, no white space. A conversation is never gathered: the result has a row for each call, result or plain
message, and sorting by (conv_id, order_turn, order_step, turn, seq) gives the topological order.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Shelf

#: JSON type -> what the engine calls it.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$|^DECIMAL\\(\\d+,0\\)$", "number": "^BIGINT$|^DOUBLE$|^DECIMAL", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}

#: What of a schema is validated, and what says nothing about values. Any other keyword is an error.
KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "pattern", "items", "properties", "required", "additionalProperties"}
NOTES = {"title", "description", "default", "examples", "$comment"}


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and plain messages of (conv_id, turn, role, text).

    An assistant's text that is a JSON object with a list ``tool_calls`` of {id, name, arguments, depends_on}
    makes calls; a text with role "tool" and a ``tool_call_id`` is a result. All others are plain. White space around
    the object is ignored. What is not as it should be is told in ``malformed`` of calls (no object, no string as id,
    ``depends_on`` no list of strings) and of plain messages (``tool_calls`` no list, or a tool's text without a
    ``tool_call_id``), null if nothing is. Nulls in any column, empty texts, repeated rows and texts of any length are
    taken as they are; other columns are ignored; an empty table gives empty tables.
    """
    v = F.when(F.col("text").rlike(r"^[ \t\r\n]*\{"), F.try_parse_json("text"))
    calls = F.expr("try_variant_get(v, '$.tool_calls', 'array<variant>')")
    kept = messages.select("conv_id", "turn", "role", "text", v.alias("v"))
    kept = kept.withColumns({"calls": F.when(F.col("role") == "assistant", calls), "of": F.when(F.col("role") == "tool", F.expr("try_variant_get(v, '$.tool_call_id', 'string')"))})
    made = kept.where(F.size("calls") > 0).select("conv_id", "turn", F.posexplode("calls").alias("seq", "c"))
    has = lambda key: F.expr(f"try_variant_get(c, '$.{key}', 'variant')")
    listed = F.expr("try_variant_get(c, '$.depends_on', 'array<string>')")
    wrong = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.schema_of_variant("c").startswith("OBJECT"), F.lit(False)), "call is no object"),
            F.when(~F.coalesce(F.schema_of_variant(has("id")) == "STRING", F.lit(False)), "id is no string"),
            F.when(has("depends_on").isNotNull() & ~F.coalesce(F.schema_of_variant(has("depends_on")).isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID"), F.lit(False)), "depends_on is no list of strings"),
        )
    )
    none = F.array().cast("array<string>")
    made = made.select("conv_id", "turn", "seq", F.expr("try_variant_get(c, '$.id', 'string')").alias("call_id"), F.expr("try_variant_get(c, '$.name', 'string')").alias("name"), F.to_json(has("arguments")).alias("arguments"), F.coalesce(F.filter(listed, lambda x: x.isNotNull()), none).alias("depends_on"), wrong.alias("malformed"))
    results = kept.where("of IS NOT NULL").select("conv_id", "turn", F.col("of").alias("call_id"), F.coalesce(F.expr("try_variant_get(v, '$.content', 'string')"), F.lit("")).alias("content"))
    odd = F.when((F.col("role") == "assistant") & F.expr("try_variant_get(v, '$.tool_calls', 'variant') IS NOT NULL AND calls IS NULL"), "tool_calls is no list").when((F.col("role") == "tool") & F.col("of").isNull(), "no tool_call_id")
    plain = kept.where("of IS NULL AND coalesce(size(calls), 0) <= 0").select("conv_id", "turn", "role", "text", odd.alias("malformed"))
    return made, results, plain


def _supported(schema: dict, place: str) -> None:
    """Raises an error for what ``_value_errors`` would pass over."""
    if not isinstance(schema, dict):
        raise ValueError(f"schema of {place}: {schema!r} is not supported")
    for keyword, value in schema.items():
        fits = keyword in KEYWORDS or keyword in NOTES
        if keyword == "type":
            fits = isinstance(value, str) and value in TYPES
        if keyword == "additionalProperties":
            fits = isinstance(value, bool)
        if not fits:
            raise ValueError(f"schema of {place}: {keyword} {value!r} is not supported")
    for key, rule in schema.get("properties", {}).items():
        _supported(rule, f"{place}.{key}")
    if "items" in schema:
        _supported(schema["items"], f"{place}[]")


def _tool_supported(name: str, schema: dict) -> None:
    _supported(schema, name)
    odd = set(schema) - {"properties", "required", "additionalProperties", *NOTES} - ({"type"} if schema.get("type") == "object" else set())
    if odd:
        raise ValueError(f"schema of {name}: {', '.join(sorted(odd))} is not supported for all arguments")


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).rlike(TYPES[kind])


def _among(value: Column, choices: list) -> Column:
    """Whether a value equals one of the choices, numbers by their size and objects whatever the order of keys."""
    found = F.lit(False)
    for x in choices:
        if isinstance(x, int | float) and not isinstance(x, bool):
            same = _is(value, "number") & (F.try_variant_get(value, "$", "double") == float(x))
        else:
            same = F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(x))))
        found = found | F.coalesce(same, F.lit(False))
    return found


def _value_errors(value: Column, label: Column, rule: dict, required: bool) -> Column:
    """What is wrong with one value (null where it is missing), and with what is inside it."""
    found = []
    says = lambda wrong, text: found.append(F.when(wrong, F.concat(label, F.lit(text))))
    if required:
        found.append(F.when(value.isNull(), F.concat(F.lit("missing "), label)))
    if "type" in rule:
        says(~_is(value, rule["type"]), f" is no {rule['type']}")
    if "minimum" in rule:
        says(F.try_variant_get(value, "$", "double") < rule["minimum"], " is too small")
    if "maximum" in rule:
        says(_is(value, "number") & (F.try_variant_get(value, "$", "double") > rule["maximum"]), " is too large")
    if "minLength" in rule:
        says(F.length(F.try_variant_get(value, "$", "string")) < rule["minLength"], " is too short")
    text = F.when(_is(value, "string"), F.try_variant_get(value, "$", "string"))
    if "maxLength" in rule:
        says(F.length(text) > rule["maxLength"], " is too long")
    if "pattern" in rule:
        says(~text.rlike(rule["pattern"]), " does not match")
    if "enum" in rule:
        says(value.isNotNull() & ~_among(value, rule["enum"]), " is none of the choices")
    none = F.array().cast("array<string>")
    out = F.array_compact(F.array(*found)) if found else none
    if "items" in rule:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: _value_errors(x, F.concat(label, F.lit("["), i.cast("string"), F.lit("]")), rule["items"], False))
        out = F.concat(out, F.when(_is(value, "array"), F.flatten(each)).otherwise(none))
    if not {"properties", "required", "additionalProperties"}.isdisjoint(rule):
        out = F.concat(out, F.when(_is(value, "object"), _object_errors(value, F.concat(label, F.lit(".")), rule)).otherwise(none))
    return out


def _object_errors(value: Column, prefix: Column, schema: dict) -> Column:
    """What is wrong with an object's keys, in their order, and which are unknown."""
    rules = dict.fromkeys(schema.get("required", ()), {}) | schema.get("properties", {})
    parts = [F.array().cast("array<string>")]
    for key, rule in sorted(rules.items()):
        parts.append(_value_errors(F.try_variant_get(value, f"$['{key}']", "variant"), F.concat(prefix, F.lit(key)), rule, key in schema.get("required", ())))
    if not schema.get("additionalProperties", True):
        known = F.array(*[F.lit(k) for k in sorted(schema.get("properties", {}))]).cast("array<string>")
        unknown = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(value, "$", "map<string, variant>")), known))
        parts.append(F.transform(unknown, lambda k: F.concat(F.lit("unknown "), prefix, k)))
    return F.concat(*parts)


def _errors(tools: dict[str, dict]) -> Column:
    """What is wrong with the arguments ``_v`` of a call of ``name``, in a fixed order."""
    by_tool = None
    for name, schema in sorted(tools.items()):
        _tool_supported(name, schema)
        listed = _object_errors(F.col("_v"), F.lit(""), schema)
        by_tool = (F.when if by_tool is None else by_tool.when)(F.col("name") == name, listed)
    unknown_tool = F.array(F.lit("unknown tool"))
    known = unknown_tool if by_tool is None else by_tool.otherwise(unknown_tool)
    no_object = F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT")
    return F.when(no_object, F.array(F.lit("arguments are no object"))).otherwise(known)


def _plus(at: Column | str, steps: Column | str) -> Column:
    at, steps = (F.col(x) if isinstance(x, str) else x for x in (at, steps))
    return F.struct(at["turn"].alias("turn"), (at["step"] + steps).alias("step"))


def _hashed(left: DataFrame, right: DataFrame, on: list, how: str = "inner") -> DataFrame:
    """A hash join; the right side has each key once."""
    return left.join(right.hint("shuffle_hash"), on, how)


def _chased(single: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame | None]:
    """Where chains of calls with one dependency (conv_id, call_id, up, least, steps) end; calls in cycles, if any.

    An order is the greatest of ``least`` and of ``steps`` after the order of ``up``. Each round puts the two steps that
    follow each other together, so chains get half as long.
    """
    chains = shelf.keep(single)
    most = chains.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 2):
        on = chains.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up_2"), F.col("least").alias("least_2"), F.col("steps").alias("steps_2"))
        joined = _hashed(chains, on, ["conv_id", "up"], "left")
        hit = F.col("up_2").isNotNull()
        least = F.when(hit, F.greatest("least", _plus("least_2", "steps"))).otherwise(F.col("least"))
        longer = shelf.keep(joined.select("conv_id", "call_id", F.coalesce("up_2", "up").alias("up"), least.alias("least"), (F.col("steps") + F.coalesce("steps_2", F.lit(0))).alias("steps"), hit.alias("hit")))
        ends = longer.where("hit").isEmpty()
        shelf.drop(chains)
        chains = shelf.like(longer.drop("hit"), longer)
        if ends:
            return chains, None
    return chains, longer.where("hit").select("conv_id", F.col("up").alias("call_id")).distinct()


def _trimmed(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """Calls on cycles of ``edges`` (conv_id, call_id, up) or between two: what trimming from both ends leaves."""
    left = shelf.keep(edges.select("conv_id", "call_id", "up").distinct())
    n = left.count()
    while True:
        has = left.select("conv_id", F.col("call_id").alias("up")).distinct()
        needed = left.select("conv_id", F.col("up").alias("call_id")).distinct()
        last, left = left, shelf.keep(left.join(has, ["conv_id", "up"], "left_semi").join(needed, ["conv_id", "call_id"], "left_semi").select("conv_id", "call_id", "up"))
        shelf.drop(last)
        m = left.count()
        if m == n:
            return left.select("conv_id", "call_id").distinct()
        n = m


#: Rounds of relaxing after which cycles are looked for.
_PATIENCE = 32


def _ordered(calls: DataFrame, results: DataFrame, shelf: Shelf) -> DataFrame:
    """(conv_id, call_id, at, cyclic): the order ``at`` (turn, step) of every identifier. Calls in cycles keep their turn."""
    key = ["conv_id", "call_id"]
    nodes = _hashed(calls.groupBy(*key).agg(F.min("turn").alias("turn")), results.groupBy(*key).agg(F.min("turn").alias("reply")), key, "left")
    nodes = shelf.keep(nodes)
    own = F.struct(F.col("turn"), F.lit(0).cast("long").alias("step"))
    start = nodes.select(*key, own.alias("at"))
    needs = calls.select(*key, F.explode("depends_on").alias("up")).distinct()
    # after its dependency, and after the result of that, if there is one
    needs = _hashed(needs, nodes.select("conv_id", F.col("call_id").alias("up"), "reply"), ["conv_id", "up"])
    needs = _hashed(needs, nodes.select(*key, "turn"), key)
    after = F.struct(F.col("reply").alias("turn"), F.lit(1).cast("long").alias("step"))
    needs = shelf.keep(needs.select(*key, "up", F.when(F.col("reply").isNull(), own).otherwise(F.greatest(own, after)).alias("least"), F.when(F.col("reply").isNull(), 1).otherwise(2).cast("long").alias("steps")))
    cyclic = nodes.select(*key).limit(0)
    while True:
        live = needs.join(cyclic, key, "left_anti")
        degree = live.groupBy(*key).agg(F.count("*").alias("d"))
        live = shelf.keep(_hashed(live, degree, key))
        chains, loops = _chased(live.where("d = 1").drop("d"), shelf)
        if loops is None:
            step = chains.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("root"), F.col("least").alias("least_2"), F.col("steps").alias("steps_2"))
            edges = _hashed(live.where("d > 1"), step, ["conv_id", "up"], "left")
            least = F.when(F.col("root").isNull(), F.col("least")).otherwise(F.greatest("least", _plus("least_2", "steps")))
            edges = shelf.keep(edges.select(*key, F.coalesce("root", "up").alias("up"), least.alias("least"), (F.col("steps") + F.coalesce("steps_2", F.lit(0))).alias("steps")))
            at, loops = _relaxed(edges, start, shelf)
        if loops is None:
            ends = at.select("conv_id", F.col("call_id").alias("up"), F.col("at").alias("end"))
            later = _hashed(chains, ends, ["conv_id", "up"]).select(*key, F.greatest("least", _plus("end", "steps")).alias("later"))
            marked = _hashed(_hashed(at, later, key, "left"), cyclic.withColumn("cyclic", F.lit(True)), key, "left")
            return marked.select(*key, F.coalesce("later", "at").alias("at"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
        cyclic = shelf.keep(cyclic.unionByName(loops).distinct())


def _relaxed(edges: DataFrame, start: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame | None]:
    """``start`` (conv_id, call_id, at) after relaxing along ``edges``, and calls in cycles, if it does not end."""
    key, at, rounds = ["conv_id", "call_id"], start, 0
    while True:
        ends = at.select("conv_id", F.col("call_id").alias("up"), F.col("at").alias("end"))
        later = _hashed(edges, ends, ["conv_id", "up"]).groupBy(*key).agg(F.max(F.greatest("least", _plus("end", "steps"))).alias("later"))
        joined = shelf.keep(_hashed(at, later, key, "left").withColumn("moved", F.coalesce(F.col("later") > F.col("at"), F.lit(False))))
        still = joined.where("moved").isEmpty()
        if rounds:
            shelf.drop(at)
        at, rounds = shelf.like(joined.select(*key, F.coalesce(F.greatest("at", "later"), "at").alias("at")), joined), rounds + 1
        if still:
            return at, None
        if rounds == _PATIENCE:
            loops = _trimmed(edges, shelf)
            if not loops.isEmpty():
                return at, loops


def link_tool_calls(calls: DataFrame, results: DataFrame, plain: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """Links calls (conv_id, turn, seq, call_id, name, arguments, depends_on), results (conv_id, turn, call_id,
    content) and plain messages (conv_id, turn, role, text).

    Every input row gives one output row: conv_id, order_turn, order_step, turn, seq, kind (call, result or
    plain), call_id, status, errors (joined by "; ", empty if none) and json. A call's status is linked,
    unanswered, or repeated if its identifier was used before in the conversation (ties by seq); a result's is
    linked, orphan (no such call) or repeated (results on one turn tie by their content; equal ones share their status);
    other messages are plain, or malformed. Errors are what ``malformed`` says, if there is such a column, those of the
    schema, "needs <id>" for a dependency that is no call, and "cycle" for calls on cycles of dependencies or between
    two, which keep their turn. Null texts and contents count as empty, null identifiers link with nothing, a schema
    keyword that is not validated raises ValueError, repeated rows stay, texts of any length are one value, empty tables
    give no rows. Other columns are ignored.
    """
    shelf = Shelf(calls.sparkSession)
    key = ["conv_id", "call_id"]
    none = F.array().cast("array<string>")
    calls = calls.select("conv_id", "turn", "seq", "call_id", "name", "arguments", "depends_on", (F.col("malformed") if "malformed" in calls.columns else none).alias("malformed"))
    results = results.select("conv_id", "turn", "call_id", F.coalesce("content", F.lit("")).alias("content"))
    order = shelf.keep(_ordered(calls.where("call_id IS NOT NULL"), results.where("call_id IS NOT NULL"), shelf))
    first_call = calls.groupBy(*key).agg(F.min(F.struct("turn", "seq")).alias("first"))
    first_result = results.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("reply"))
    lost = calls.select(*key, F.explode("depends_on").alias("needed")).distinct()
    lost = lost.join(order.select("conv_id", F.col("call_id").alias("needed")).hint("shuffle_hash"), ["conv_id", "needed"], "left_anti")
    lost = lost.groupBy(*key).agg(F.array_sort(F.collect_set(F.concat(F.lit("needs "), "needed"))).alias("lost"))  # as many as a call has dependencies

    # one partitioning by identifier serves all four tables
    c = reduce(lambda x, y: _hashed(x, y, key, "left"), (order, first_call, first_result, lost), calls)
    c = c.withColumn("_v", F.try_parse_json("arguments"))
    wrong = F.concat("malformed", F.when(F.size("malformed") > 0, none).otherwise(_errors(tools)), F.coalesce("lost", none), F.when(F.col("cyclic"), F.array(F.lit("cycle"))).otherwise(none))
    repeated = F.struct("turn", "seq") != F.col("first")
    c = c.select(
        "conv_id",
        F.coalesce("at.turn", "turn").alias("order_turn"),
        F.coalesce("at.step", F.lit(0)).cast("int").alias("order_step"),
        "turn",
        F.col("seq").cast("int").alias("seq"),
        F.lit("call").alias("kind"),
        "call_id",
        F.when(repeated, "repeated").when(F.col("reply").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.array_join(wrong, "; ").alias("errors"),
        F.to_json(F.struct(F.col("_v").alias("arguments"), "call_id", "conv_id", F.col("name"), F.lit("call").alias("type"))).alias("json"),
    )
    r = reduce(lambda x, y: _hashed(x, y, key, "left"), (order, first_result), results)
    own = F.struct(F.col("turn"), F.lit(0).cast("long").alias("step"))
    r = r.withColumn("_at", F.when(F.col("at").isNull(), own).otherwise(F.greatest(own, _plus("at", F.lit(1))))).select(
        "conv_id",
        F.col("_at.turn").alias("order_turn"),
        F.col("_at.step").cast("int").alias("order_step"),
        "turn",
        F.lit(0).alias("seq"),
        F.lit("result").alias("kind"),
        "call_id",
        F.when(F.col("at").isNull(), "orphan").when(F.struct("turn", "content") != F.col("reply"), "repeated").otherwise("linked").alias("status"),
        F.lit("").alias("errors"),
        F.to_json(F.struct("call_id", "content", "conv_id", F.lit("result").alias("type"))).alias("json"),
    )
    odd = F.col("malformed") if "malformed" in plain.columns else F.lit(None).cast("string")
    p = plain.select(
        "conv_id",
        F.col("turn").alias("order_turn"),
        F.lit(0).alias("order_step"),
        "turn",
        F.lit(0).alias("seq"),
        F.lit("plain").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.when(odd.isNull(), "plain").otherwise("malformed").alias("status"),
        F.coalesce(odd, F.lit("")).alias("errors"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("content"), "conv_id", "role", F.lit("plain").alias("type"))).alias("json"),
    )
    return c.unionByName(r).unionByName(p)

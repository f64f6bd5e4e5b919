import json

import pytest

from tests.oracle import assert_same
from tidemark.llm import chat_formatting as cf
from tidemark.llm import q_chat_formatting as q

TOOLS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}}, "required": ["a"], "additionalProperties": False}, "echo": {"properties": {"x": {"type": "string", "minLength": 2}}}}


def test_query_equals_sql(spark, small):
    assert_same(spark, q.op4_chat_formatting, q.ORACLE_SQL["op4_chat_formatting"], small)


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "depends_on": d} for i, n, a, d in calls]})


MESSAGES = [
    (1, 0, "user", "hi {"), (1, 1, "assistant", call(("c2", "add", {"b": 1.5, "a": 2}, ["c1"]), ("c1", "add", {"a": -1, "z": {"y": 1, "x": [2]}}, []))),
    (1, 2, "tool", '{"tool_call_id": "c1", "content": "one"}'), (1, 3, "tool", '{"tool_call_id": "c2", "content": "two"}'), (1, 4, "tool", '{"tool_call_id": "c2", "content": "again"}'),
    (1, 5, "tool", '{"tool_call_id": "c9"}'), (1, 6, "assistant", "{not json"), (1, 7, "assistant", None),
    (2, 0, "assistant", call(("x", "echo", {"x": "q"}, ["y"]), ("y", "echo", "text", ["x"]), ("z", "nope", {}, ["w"]))), (2, 0, "assistant", call(("z", "echo", {}, []))),
    (None, None, None, None),
]


def test_links_orders_and_validates(spark):
    df = spark.createDataFrame([(*m, 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, seq int")
    got = cf.link_tool_calls(*cf.tool_messages(df), TOOLS).collect()
    rows = {(r.conv_id, r.turn, r.seq, r.call_id): r for r in got}
    c1, c2 = rows[1, 1, 1, "c1"], rows[1, 1, 0, "c2"]
    assert (c1.status, c1.errors) == ("linked", "a is too small; unknown z") and (c2.status, c2.errors) == ("linked", "")
    assert c1.json == '{"arguments":{"a":-1,"z":{"x":[2],"y":1}},"call_id":"c1","conv_id":1,"name":"add","type":"call"}'
    order = [(r.order_turn, r.order_step) for r in (c1, rows[1, 2, 0, "c1"], c2, rows[1, 3, 0, "c2"])]
    assert order == sorted(order) and len(set(order)) == 4
    assert rows[1, 4, 0, "c2"].status == "repeated" and rows[1, 5, 0, "c9"].status == "orphan"
    assert {r.kind for r in got if r.turn in (6, 7)} == {"plain"}
    assert rows[2, 0, 0, "x"].errors == "x is too short; cycle" and rows[2, 0, 1, "y"].errors == "arguments are no object; cycle"
    assert {r.errors for r in got if r.call_id == "z"} == {"unknown tool; needs w", "needs w"}
    assert len(got) == len(MESSAGES) + 3
    assert cf.link_tool_calls(*cf.tool_messages(df.limit(0)), TOOLS).count() == 0


def orders(spark, needs, replies=()):
    """Orders and errors of calls (turn: what it needs) of one conversation."""
    schema = "conv_id long, turn long, seq int, call_id string, name string, arguments string, depends_on array<string>"
    calls = spark.createDataFrame([(1, t, 0, f"c{t}", "echo", "{}", [f"c{x}" for x in d]) for t, d in needs.items()], schema)
    results = spark.createDataFrame([(1, t, f"c{c}", "") for c, t in replies], "conv_id long, turn long, call_id string, content string")
    plain = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = [r for r in cf.link_tool_calls(calls, results, plain, TOOLS).collect() if r.kind == "call"]
    return {r.turn: (r.order_turn, r.order_step) for r in rows}, {r.turn for r in rows if "cycle" in r.errors}


def brute(needs, replies, cyclic):
    reply, at = dict(replies), {t: (t, 0) for t in needs}
    for _ in needs:
        for t, d in needs.items():
            for x in d if t not in cyclic else ():
                turn, step = at[x]
                ready = max((reply[x], 0), (turn, step + 1)) if x in reply else at[x]
                at[t] = max(at[t], (ready[0], ready[1] + 1))
    return at


def test_orders_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cf, "_PATIENCE", 3)
    import random

    for seed in range(2):
        r = random.Random(seed)
        rank = r.sample(range(40), 40)  # calls need calls of lower rank, whatever their turns
        needs = {t: sorted({x for x in r.choices(range(40), k=r.randrange(4)) if rank[x] < rank[t]}) for t in range(40)}
        replies = [(t, t + r.randrange(1, 6)) for t in range(40) if r.random() < 0.5]
        got, cyclic = orders(spark, needs, replies)
        assert not cyclic and got == brute(needs, replies, set())
    # a cycle of calls that need several, others between two cycles, before and after
    needs = {0: [], 1: [2, 0], 2: [1, 0], 3: [2, 0], 4: [3, 5], 5: [4, 0], 6: [5], 7: [0, 6], 8: [8]}
    got, cyclic = orders(spark, needs)
    assert cyclic == {1, 2, 3, 4, 5, 8} and got == brute(needs, [], cyclic)


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    kept = []
    keep = cf.Shelf.keep
    monkeypatch.setattr(cf.Shelf, "keep", lambda self, df, rows=None: kept.append(1) or keep(self, df, rows))
    n = 10_000
    needs = {t: [t + 1] for t in range(n - 1)} | {n - 1: []}  # all out of order
    got, cyclic = orders(spark, needs)
    assert not cyclic and got == {t: (n - 1, n - 1 - t) for t in range(n)}
    got, cyclic = orders(spark, {t: [(t + 1) % n] for t in range(n)} | {n: [0]})
    assert cyclic == set(range(n)) and got[n] == (n, 0)
    got, cyclic = orders(spark, {t: [t - 1] for t in range(2, n)} | {0: [1], 1: [0]})
    assert cyclic == {0, 1} and got[n - 1] == (n - 1, 0)
    assert len(kept) < 140


def test_white_space_malformed_calls_and_ties(spark):
    rows = [
        (1, 0, "assistant", ' \n{"tool_calls": [{"id": "a", "name": "echo", "arguments": {"x": "yy"}}]} '), (1, 1, "tool", '\t{"tool_call_id": "a", "content": "2"}'), (1, 1, "tool", '{"tool_call_id": "a", "content": "1"}'),
        (1, 2, "assistant", '{"tool_calls": [{"id": "b", "name": "echo", "arguments": {}, "depends_on": "a"}, 5, {"id": 3, "name": "echo", "arguments": {}, "depends_on": [1]}]}'),
        (1, 3, "assistant", '{"tool_calls": {"id": "b"}}'), (1, 4, "tool", "no object"), (1, 5, "user", '{"tool_calls": 1}'), (1, 6, "assistant", '{"tool_calls": [{"id": "e", "name": "echo", "arguments": {}, "depends_on": []}, {"id": "f", "name": "echo", "arguments": {}, "depends_on": null}]}'),
        (1, 7, "assistant", '{"tool_calls": [{"id": "long", "name": "echo", "arguments": {"x": "' + "z" * 300_000 + '"}}]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = cf.link_tool_calls(*cf.tool_messages(df), TOOLS).collect()
    said = sorted((r.turn, r.seq, r.status, r.errors, r.call_id or "") for r in got)
    assert said == [
        (0, 0, "linked", "", "a"), (1, 0, "linked", "", "a"), (1, 0, "repeated", "", "a"), (2, 0, "unanswered", "depends_on is no list of strings", "b"), (2, 1, "unanswered", "call is no object; id is no string", ""),
        (2, 2, "unanswered", "id is no string; depends_on is no list of strings; needs 1", "3"), (3, 0, "malformed", "tool_calls is no list", ""), (4, 0, "malformed", "no tool_call_id", ""), (5, 0, "plain", "", ""),
        (6, 0, "unanswered", "", "e"), (6, 1, "unanswered", "", "f"), (7, 0, "unanswered", "", "long"),
    ]


SCHEMA = {
    "type": "object",
    "required": ["mode", "id"],
    "properties": {
        "mode": {"type": "string", "enum": ["a", "b"], "description": "how"}, "level": {"enum": [1, 2.5, None, {"x": 1, "y": [2]}]}, "n": {"type": "integer", "maximum": 9},
        "code": {"type": "string", "maxLength": 4, "pattern": "^[a-z]+$"}, "tags": {"type": "array", "items": {"type": "array", "items": {"type": "string", "minLength": 2}}},
        "at": {"type": "object", "properties": {"zip": {"type": "integer", "minimum": 5}, "to": {"properties": {"q": {"maximum": 1}}}}, "required": ["zip"], "additionalProperties": False},
    },
}


def test_every_keyword_is_validated(spark):
    good = {"mode": "a", "id": 1, "level": 1.0, "n": 9, "code": "abcd", "tags": [["xx"], []], "at": {"zip": 5, "to": {"q": 1}}}
    cases = [
        (good, ""), (good | {"level": {"y": [2], "x": 1}}, ""), (good | {"level": None}, ""), (good | {"mode": "c"}, "mode is none of the choices"), (good | {"level": 2}, "level is none of the choices"),
        (good | {"n": 10}, "n is too large"), (good | {"code": "abcde"}, "code is too long"), (good | {"code": "ab1"}, "code does not match"), (good | {"tags": [["xx", "y"], 3]}, "tags[0][1] is too short; tags[1] is no array"),
        (good | {"at": {"to": {"q": 2}, "w": 1}}, "at.to.q is too large; missing at.zip; unknown at.w"), (good | {"at": {"zip": 4}}, "at.zip is too small"), (good | {"at": 3, "tags": "x"}, "at is no object; tags is no array"),
        ({"mode": "b"}, "missing id"),
    ]
    rows = [(1, k, "assistant", call((f"c{k}", "t", a, []))) for k, (a, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.errors for r in cf.link_tool_calls(*cf.tool_messages(df), {"t": SCHEMA}).collect()}
    assert [got[k] for k in range(len(cases))] == [e for _, e in cases]


@pytest.mark.parametrize("rule", [{"multipleOf": 2}, {"type": ["string", "null"]}, {"items": {"format": "date"}}, {"properties": {"y": {"oneOf": []}}}, {"additionalProperties": {"type": "string"}}, True])
def test_unsupported_keywords_are_errors(spark, rule):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError, match="not supported"):
        cf.link_tool_calls(*cf.tool_messages(df), {"t": {"properties": {"x": rule}}})

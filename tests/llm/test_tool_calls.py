import json

from riskloom.llm import queries, tool_calls

from .cases import SF, clashing, duck, shown

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}, "l": {"type": "array", "items": {"type": "string", "maxLength": 2}}}, "additionalProperties": False}}
ROWS = [
    (1, "c", 3, "f", '{"x": 1}', ["a", "b"]), (1, "a", 5, "f", '{"x":2}', []), (1, "b", 4, "f", '{"l":["ok","long"],"y":null,"x":true}', ["a", "zz"]),
    (1, "a", 6, "f", '{"x":9}', ["b"]),  # a repeated id: the first by turn counts
    (2, "p", 0, "f", None, ["q"]), (2, "q", 1, "g", "[1]", ["p"]), (2, "r", 2, "f", "{bad", ["q"]), (2, "s", 3, "f", '{"x":1e2}', None),
    (None, "n", None, None, '{"b":1.5,"a":"é\\u2028\\""}', ["n"]), (3, None, 1, "f", "{}", None),
    *[(9, f"k{i}", i, "f", '{"x":1}', [f"k{i - 1}", f"k{i // 2}"] if i else []) for i in range(12)],
]
RES = [(1, "a", 7, "done"), (1, "a", 8, "again"), (1, "lone", 9, None), (None, "n", 2, ""), (2, None, 1, "x")]


def linked(spark, **kw):
    return tool_calls.link(clashing(spark.createDataFrame(ROWS, CALLS)), clashing(spark.createDataFrame(RES, RESULTS)), SCHEMAS, **kw)


def test_links_levels_and_validation(spark):
    got = {(r.conv_id, r.call_id): r for r in linked(spark).collect()}
    assert {k: got[1, k].level for k in "abc"} == {"a": 0, "b": 1, "c": 2}
    assert got[1, "a"].status == "linked" and got[1, "a"].turn == 5 and json.loads(got[1, "a"].message) == {"id": "a", "name": "f", "arguments": {"x": 2}, "result": "done"}
    assert got[1, "b"].missing == "zz" and got[1, "b"].error == "/l/1: maxLength 2; /x: not of type integer; /y: not allowed"
    assert got[1, "lone"].status == "orphan" and got[1, "lone"].level is None and got[1, "lone"].valid is None
    assert [got[2, k].level for k in "pqrs"] == [None, None, None, 0]  # a cycle and what hangs on it
    assert got[2, "p"].error == "/: no JSON object" == got[2, "r"].error and got[2, "s"].valid is False
    assert got[None, "n"].level is None and got[None, "n"].status == "linked" and got[None, "n"].error == "/: unknown tool"
    assert [got[9, f"k{i}"].level for i in range(12)] == list(range(12))
    assert len(got) == 8 + 1 + 12 and all(k[1] is not None for k in got)


def test_long_conversations_get_the_same_levels(spark):
    assert shown(linked(spark, max_calls=2)) == shown(linked(spark))


def test_a_conversation_of_long_chains_takes_few_rounds(spark, monkeypatch):
    n, rounds, write = 20_400, [], tool_calls.materialise
    monkeypatch.setattr(tool_calls, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    calls = [(1, str(i), [str(i - 2)] if i > 1 else []) for i in range(n)]  # two chains
    calls += [(1, "both", [str(n - 1), "7", "both2"]), (1, "both2", [str(n - 2), "0"]), (1, "last", ["both"])]
    calls += [(1, f"c{i}", [f"c{(i + 1) % 7}"]) for i in range(7)] + [(1, "on_cycle", ["c3", "5"]), (1, "after", ["on_cycle"]), (1, "x", ["y", "1"]), (1, "y", ["x", "0"])]
    got = {r.call_id: r.level for r in tool_calls.levels(spark.createDataFrame(calls, "conv_id long, call_id string, needs array<string>")).collect()}
    top = n // 2 - 1
    want = {str(i): i // 2 for i in range(n)} | {"both": top + 2, "both2": top + 1, "last": top + 3}
    want |= {f"c{i}": None for i in range(7)} | dict.fromkeys(("on_cycle", "after", "x", "y"))
    assert got == want and len(rounds) < 60


def test_canonical_json_round_trip():
    v = {"b": [1, 2.0, 1.5, 1e22, True, None], "a": {"é": "x\ny\"", "A": -0.0}}
    text = tool_calls.canonical(v)
    assert text == '{"a":{"A":0,"é":"x\\ny\\""},"b":[1,2,1.5,1e+22,true,null]}' and json.loads(text) == v


def test_empty_tables(spark):
    c, r = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tool_calls.link(c, r, SCHEMAS).count() == 0
    assert {x.status for x in tool_calls.link(c, spark.createDataFrame(RES, RESULTS), SCHEMAS).collect()} == {"orphan"}


def test_query_equals_sql(spark):
    assert shown(queries.op4_tool_calls(spark, SF)) == duck(queries.SQL_CALLS, SF, "conversations")

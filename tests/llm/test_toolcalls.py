import json

from citespark.llm.toolcalls import SCHEMAS, canonical, errors, levels, link_tool_calls, made_of

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after string, json int"
RESULTS = "conv_id long, turn long, call_id string, content string"


def test_links_order_and_states(spark):
    good = '{"query": "a", "limit": 2.0}'
    calls = [(1, 1, "a", "search", good, "b"), (1, 3, "b", "search", '{"limit":1}', None), (1, 5, "c", "nope", "{", "a"),
             (1, 7, "b", "lookup", "{}", None), (2, 1, "a", "lookup", None, "a"), (2, 2, "d", "lookup", '{"query":"é"}', "a"),
             (3, 1, "x", "search", good, "gone"), (None, 1, "a", "search", good, None), (3, 2, None, None, None, None)]
    results = [(1, 2, "a", "second"), (1, 1, "a", "first"), (1, 9, "zz", "loose"), (None, 1, "a", "n"), (3, 3, "x", None)]
    rows = link_tool_calls(spark.createDataFrame([(*c, 1) for c in calls], CALLS),
                           spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    got = {(r["conv_id"], r["turn"], r["call_id"], r["status"]): r for r in rows}
    assert set(got) == {
        (1, 1, "a", "ok"), (1, 3, "b", "invalid"), (1, 5, "c", "unknown tool"), (1, 7, "b", "repeated"),
        (2, 1, "a", "cycle"), (2, 2, "d", "cycle"), (3, 1, "x", "ok"), (None, 1, "a", "no result"),
        (3, 2, None, "unknown tool"), (1, 9, "zz", "orphan"), (None, 1, "a", "orphan"),
        (1, 2, "a", "repeated result")}
    assert got[1, 2, "a", "repeated result"]["json"] == '{"result":"second","tool_call_id":"a"}'
    assert [got[1, t, c, s]["level"] for t, c, s in ((3, "b", "invalid"), (1, "a", "ok"), (5, "c", "unknown tool"))] == [0, 1, 2]
    a = got[1, 1, "a", "ok"]
    assert a["json"] == '{"after":"b","arguments":{"limit":2,"query":"a"},"id":"a","name":"search","result":"first"}'
    assert a["n_results"] == 2 and got[1, 3, "b", "invalid"]["errors"] == "$.query: missing"
    assert '"é"' in got[2, 2, "d", "cycle"]["json"]


def test_odd_arguments_are_invalid(spark):
    odd = ['{"query":"a","limit":1e999}', '{"query":"a","limit":NaN}', '{"query":"\\ud800","limit":1}', "[" * 100_000,
           '{"query":"a","limit":' + "9" * 5000 + "}"]
    calls = spark.createDataFrame([(1, k, f"c{k}", "search", a, None, 1) for k, a in enumerate(odd)], CALLS)
    results = spark.createDataFrame([(1, 9, f"c{k}", "r") for k in range(len(odd))] * 2, RESULTS)
    rows = link_tool_calls(calls, results, SCHEMAS).collect()
    assert sorted(r["status"] for r in rows) == ["invalid"] * len(odd) + ["repeated result"] * len(odd)
    assert all(json.loads(r["json"]) for r in rows)


def test_empty_tables_and_repeats(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert link_tool_calls(calls, results, SCHEMAS).count() == 0
    one = spark.createDataFrame([(1, 1, "a", "lookup", '{"query":"q"}', None, 1)] * 3, CALLS)
    assert sorted(r["status"] for r in link_tool_calls(one, results, SCHEMAS).collect()) == ["no result", "repeated", "repeated"]


def test_long_chains_take_few_rounds(spark):
    rows = [(1, f"c{k}", f"c{k - 1}" if k else None) for k in range(300)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "b")]
    got = {(r[0], r[1]): r[2] for r in levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}
    assert all(got[1, f"c{k}"] == k for k in range(300))
    assert [got[2, x] for x in "abc"] == [None] * 3


def test_conversations_are_brute_force(spark):
    calls, results = made_of(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    own = {(r["conv_id"], r["call_id"]): r for r in calls.collect()}
    answers = {(r["conv_id"], r["call_id"]): r["content"] for r in results.collect()}
    seen = 0
    for r in link_tool_calls(calls, results, SCHEMAS).collect():
        key = r["conv_id"], r["call_id"]
        if r["status"] == "orphan":
            assert key not in own
            continue
        seen += 1
        call, level, at, path = own[key], 0, own[key], {key}
        while (r["conv_id"], at["after"]) in own:
            up = r["conv_id"], at["after"]
            if up in path:
                level = None
                break
            path.add(up)
            at, level = own[up], level + 1
        value = json.loads(call["arguments"])
        wrong = errors(value, SCHEMAS[call["name"]]) if call["name"] in SCHEMAS else []
        status = "cycle" if level is None else "unknown tool" if call["name"] not in SCHEMAS else (
            "invalid" if wrong else "ok" if key in answers else "no result")
        assert (r["level"], r["status"], r["errors"]) == (level, status, "; ".join(wrong))
        assert r["json"] == canonical({"after": call["after"], "arguments": value, "id": call["call_id"],
                                       "name": call["name"], "result": answers.get(key)})
    assert seen == len(own)


def test_schemas():
    schema = {"type": "object", "properties": {"a": {"type": ["integer", "null"], "minimum": 2, "maximum": 5},
              "b": {"type": "array", "items": {"enum": ["x"]}}}, "required": ["a"], "additionalProperties": False}
    assert errors({"a": 3, "b": ["x"]}, schema) == [] == errors({"a": None}, schema)
    assert errors(True, {"enum": [1]}) and not errors(1.0, {"enum": [1]}) and errors("a", {"type": "text"})
    assert errors({"a": True}, schema) and errors({"a": 6}, schema) and errors({"a": 3, "c": 1}, schema)
    assert errors({"a": 3, "b": ["y"]}, schema) == ["$.b[0]: not one of the values"] and errors([], schema)
    assert canonical({"b": 1.0, "a": [1.5, float("nan"), "é"]}) == '{"a":[1.5,null,"é"],"b":1}'

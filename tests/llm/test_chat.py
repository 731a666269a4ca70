"""Tool-call linking."""

import json
from collections import Counter

from pyspark.sql import functions as F

from engram.llm import chat_format, queries

CALLS = "group_id long, call_id string, parent_id string, name string, arguments string, place long, clash string"
RESULTS = "group_id long, call_id string, content string, place long"
SCHEMAS = {
    "add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)},
    "find": {"what": ("string", True), "deep": ("boolean", False), "tags": ("array", False), "by": ("object", False)},
}


def link(spark, calls, results):
    frame = chat_format.link_calls(spark.createDataFrame([(*c, "x") for c in calls], CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {r.call_id: r for r in frame.collect()}


def test_links_order_and_lines(spark):
    out = link(
        spark,
        [
            (1, "c", "b", "find", '{"what": "x\\n\\"y\\"", "by": {"z": 1, "a": [1, 2]}, "deep": true}', 3),
            (1, "b", "a", "add", '{"b": 1.5, "a": 2}', 2),
            (1, "a", "missing", "add", '{"a": 1, "b": 2}', 1),
            (1, "a", None, "add", '{"a": 9, "b": 9}', 5),
            (2, "p", "q", "add", "{}", 1),
            (2, "q", "p", "gone", "{}", 2),
            (3, "s", "s", "find", "[1]", 1),
            (3, None, None, "find", '{"what": 1, "more": 2}', 1),
            (4, "n", None, None, None, None),
        ],
        [(1, "a", "late", 9), (1, "a", "early", 4), (1, "c", None, 5), (7, "lone", "é\t", 1), (7, None, "?", 1), (7, None, "!", 2)],
    )
    assert {k: (r.depth, r.status) for k, r in out.items() if k} == {"a": (0, "linked"), "b": (1, "no_result"), "c": (2, "linked"), "p": (None, "cycle"), "q": (None, "cycle"), "s": (None, "cycle"), "n": (0, "no_result"), "lone": (None, "orphan")}
    assert (out["a"].n_calls, out["a"].n_results) == (2, 2)
    assert out["a"].line == '{"arguments":{"a":1,"b":2},"depth":0,"id":"a","name":"add","parent":"missing","result":"early"}'
    assert json.loads(out["c"].line) == {"arguments": {"what": 'x\n"y"', "by": {"z": 1, "a": [1, 2]}, "deep": True}, "depth": 2, "id": "c", "name": "find", "parent": "b", "result": None}
    assert out["c"].line.startswith('{"arguments":{"by":{"a":[1,2],"z":1},"deep":true,"what":')
    assert {k: out[k].errors for k in ("a", "b", "c", "p", "q", "s", "n")} == {"a": "", "b": "", "c": "", "p": "a: missing; b: missing", "q": "name: unknown tool", "s": "arguments: no object", "n": "arguments: no object"}
    assert out["lone"].args_valid is None and json.loads(out["lone"].line)["result"] == "é\t"


def test_calls_and_results_without_ids(spark):
    frame = chat_format.link_calls(
        spark.createDataFrame([(3, None, None, "find", '{"what": 1, "more": 2}', 1, "x"), (3, None, None, "find", '{"what": "w"}', 2, "x")], CALLS), spark.createDataFrame([(7, None, "?", 1), (7, None, "!", 2)], RESULTS), SCHEMAS
    )
    got = Counter((r.group_id, r.status, r.n_calls, r.n_results, r.errors) for r in frame.collect())
    assert got == Counter([(3, "no_id", 1, 0, "what: not string; more: unknown"), (3, "no_id", 1, 0, ""), (7, "no_id", 0, 2, None)])


def test_long_chain_takes_few_rounds(spark):
    calls = spark.range(700).select(F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("parent_id"))
    assert {int(r.call_id): r.depth for r in chat_format.depths(calls).collect()} == {i: i for i in range(700)}


def test_turns_awkward(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a2"), (1, 3, "user", None), (1, 3, "user", None), (1, 5, "assistant", "lone"), (None, 1, "user", "x"), (2, None, "assistant", "y"), (3, 1, None, "z"), (3, 2, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("clash")).withColumn("call_id", F.lit("clash"))
    got = {(r.conv_id, r.call_id): (r.depth, r.status, r.n_calls, r.n_results, r.errors) for r in chat_format.link_turns(turns).collect()}
    assert got == {
        (1, "1:1"): (0, "linked", 1, 1, ""), (1, "1:3"): (1, "no_result", 2, 0, "prompt: missing"), (1, "1:4"): (None, "orphan", 0, 1, None),
        (None, None): (None, "no_id", 1, 0, ""), (2, None): (None, "no_id", 0, 1, None), (3, "3:2"): (0, "no_result", 1, 0, ""),
    }


def test_empty_and_query(spark, sf_dir):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.link_turns(none).count() == 0
    turns = {(r.conv_id, r.turn): r for r in queries.table(spark, sf_dir, "conversations").collect()}
    out = queries.op7_chat_format(spark, sf_dir).collect()
    calls = [r for r in out if r.n_calls]
    assert len(calls) == sum(t.role == "user" for t in turns.values())
    for r in calls:
        conv, turn = map(int, r.call_id.split(":"))
        line = json.loads(r.line)
        answer = turns.get((conv, turn + 1))
        assert line["arguments"] == {"prompt": turns[conv, turn].text, "turn": turn} and r.args_valid
        assert line["result"] == (answer.text if answer and answer.role == "assistant" else None)
        assert r.line == json.dumps(line, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_plan_has_no_python(spark, sf_dir):
    assert "Python" not in queries.op7_chat_format(spark, sf_dir)._jdf.queryExecution().toString()

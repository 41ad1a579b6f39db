"""Requests: single lines, and a recorded set of sessions replayed as a stream with a restart against the table."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans.request_queries import st_serve
from tidemark.streaming import requests as R
from tidemark.streaming.incremental import run_available

REQUESTS = "session string, place long, line string"


@pytest.fixture(scope="module")
def tools(spark):
    payload = json.dumps({"operation": "draw-card", "gates": [], "stand_in": {"id": "card", "fidelity": 0.25}})
    rows = [("draw-card", "draws", payload, []), ("send-mail", "sends", payload, ["MAIL_KEY", "OTHER"])]
    return spark.createDataFrame(rows, "name string, description string, payload string, credentials array<string>")


def ask(spark, tools, line, **more):
    got = R.answers(spark.createDataFrame([("s", 1, line)], REQUESTS), tools, **more).collect()
    return got[0] if got else None


CALL = '{"id": 7, "method": "tools/call", "params": {"name": "%s", "arguments": {"inputs": {"b": 1, "a": [true]}}}}'


@pytest.mark.parametrize(
    ("line", "id", "code", "message"),
    [
        ("{", None, R.UNREADABLE, "parse error"), ("[1]", None, R.INVALID, "invalid request"), ('"x"', None, R.INVALID, "invalid request"), ('{"id": "a", "method": "nothing"}', '"a"', R.NO_METHOD, "method not found: nothing"),
        ('{"id": 1}', "1", R.NO_METHOD, "method not found: null"), ('{"id": 1, "method": 5}', "1", R.NO_METHOD, "method not found: null"), (CALL % "none", "7", R.BAD_PARAMETERS, "unknown tool: none"), ('{"id": 1, "method": "tools/call"}', "1", R.BAD_PARAMETERS, "unknown tool: null"),
    ],
)
def test_errors(spark, tools, line, id, code, message):
    r = ask(spark, tools, line)
    assert (r["id"], r["code"], r["message"], r["result"], r["is_error"]) == (id, code, message, None, False)


def test_results(spark, tools):
    assert ask(spark, tools, "  ") is None and ask(spark, tools, '{"method": "notifications/initialized"}') is None
    assert ask(spark, tools, '{"id": null, "method": "ping"}')["result"] == "{}"
    listed = json.loads(ask(spark, tools, '{"id": 1, "method": "tools/list"}')["result"])["tools"]
    assert [t["name"] for t in listed] == ["draw-card", "send-mail"] and listed[0]["inputSchema"] == {"type": "object"}
    assert "tools" in json.loads(ask(spark, tools, '{"id": 1, "method": "initialize"}')["result"])["capabilities"]


def test_calls_tell_the_plan(spark, tools):
    r = ask(spark, tools, CALL % "draw-card")
    text = json.loads(r["result"])["content"][0]["text"]
    want = {"operation": "draw-card", "gates": [], "stand_in": {"id": "card", "fidelity": 0.25}, "executed": False, "missing_env": [], "inputs": {"b": 1, "a": [True]}}
    assert text == json.dumps(want, indent=2, sort_keys=True) and not r["is_error"]
    r = ask(spark, tools, CALL % "send-mail", present=("OTHER",))
    assert json.loads(json.loads(r["result"])["content"][0]["text"])["missing_env"] == ["MAIL_KEY"] and r["is_error"]
    assert not ask(spark, tools, CALL % "send-mail", present=("OTHER", "MAIL_KEY"))["is_error"]


def test_sessions_are_opened_before_calls(spark, tools):
    lines = ['{"id": 1, "method": "initialize"}', CALL % "draw-card", ""]
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", i, x) for i, x in enumerate(reversed(lines))]
    table = spark.createDataFrame(rows, REQUESTS)
    strict = {(r["session"], r["place"]): (r["number"], r["opened"], r["code"]) for r in R.answers(table, tools, strict=True).collect()}
    assert strict == {("a", 0): (1, False, None), ("a", 1): (2, True, None), ("b", 1): (1, False, R.NOT_OPENED), ("b", 2): (2, False, None)}
    assert all(r["code"] is None for r in R.answers(table, tools).collect())


@pytest.mark.parametrize("strict", [False, True])
def test_a_replay_with_a_restart_is_the_table(spark, tools, tmp_path, strict):
    kinds = ['{"id": 1, "method": "ping"}', CALL % "draw-card", '{"id": 2, "method": "initialize"}', CALL % "send-mail", "{", "", '{"id": 3, "method": "tools/list"}', '{"method": "initialized"}', CALL % "none"]
    rows = [(f"s{s}", i, kinds[(i * (s + 2) + s) % len(kinds)]) for s in range(5) for i in range(12)]
    for part, keep in enumerate((lambda i: i < 4, lambda i: 4 <= i < 9, lambda i: i >= 9)):
        spark.createDataFrame([r for r in rows if keep(r[1])], REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
        if part != 1:  # two parts in one run, then one more after a restart
            run_available(R.answer_stream(stream, tools, ("OTHER",), strict), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = R.answers(spark.createDataFrame(rows, REQUESTS), tools, ("OTHER",), strict)
    columns = [c.split()[0] for c in R.ANSWER.split(", ")]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert want.where(F.col("code") == R.NOT_OPENED).count() == (0 if not strict else want.where("not opened and code = -32002").count()) and got.count() > 40


def test_the_list_is_made_for_results_alone(spark, data, tools):
    """All tools in one value are as long as the tools are many; who reads no result, as the query, never makes or broadcasts it."""
    lines = ['{"id": 1, "method": "initialize"}', CALL % "draw-card", '{"id": 2, "method": "tools/list"}', CALL % "none", '{"id": 3, "method": "ping"}']
    rows = [("a", i, x) for i, x in enumerate(lines)] + [("b", 0, CALL % "draw-card"), ("b", 1, '{"id": 2, "method": "tools/list"}')]
    got = R.answers(spark.createDataFrame(rows, REQUESTS), tools, strict=True)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan(got) and "scalar-subquery" not in plan(got.drop("result"))
    for df in (got.drop("result"), st_serve(spark, data)):
        assert "collect_list" not in plan(df) and "listed" not in plan(df)
    result = {(r["session"], r["place"]): (r["result"] and json.loads(r["result"]), r["text"]) for r in got.collect()}
    assert [len(result[k][0]["tools"]) for k in (("a", 2), ("b", 1))] == [2, 2]
    assert result["a", 1][1] == result["a", 1][0]["content"][0]["text"] and all(v[1] is None for k, v in result.items() if k != ("a", 1))
    assert result["a", 4][0] == {} and result["a", 3][0] is None and result["b", 0][0] is None

"""Inputs and artefacts of runs, scans under caps, canonical documents: against plain Python."""

import json
import os.path
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.documents import canonical_json
from tidemark.operators import runs
from tidemark.plans.run_queries import INPUTS
from tidemark.sources import repos

DECLARED = [("s", [("a", "string", None, True), ("n", "integer", "1", False), ("x", "number", "0.5", True), ("any", None, None, False)]), ("bare", None)]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ('{"a": "t"}', {("a", "t", None), ("n", "1", None), ("x", "0.5", None)}),
        ('{"a": "t", "n": 2, "x": 3, "any": {"k": [1]}}', {("a", "t", None), ("n", "2", None), ("x", "3.0", None), ("any", '{"k":[1]}', None)}),
        ('{"a": 5, "n": "2", "x": true}', {("a", None, "not-a-string"), ("n", None, "not-a-integer"), ("x", None, "not-a-number")}),
        ('{"a": "", "N": 1}', {("a", "", None), ("n", "1", None), ("x", "0.5", None), ("N", None, "unknown")}),
        ("{}", {("a", None, "missing"), ("n", "1", None), ("x", "0.5", None)}), (None, {("a", None, "missing"), ("n", "1", None), ("x", "0.5", None)}),
        ("[1]", {(None, None, "not-an-object")}), ("no json", {(None, None, "not-an-object")}), ('{"a": null}', {("a", None, "not-a-string"), ("n", "1", None), ("x", "0.5", None)}),
    ],
)
def test_inputs(spark, given, expected):
    rows = runs.resolve_inputs(spark.createDataFrame([("r", "s", given)], "run string, stand_in string, inputs string"), spark.createDataFrame(DECLARED, f"stand_in string, inputs {INPUTS}"))
    assert {(r["name"], r["value"], r["problem"]) for r in rows.collect()} == expected


def test_inputs_of_unknown_and_bare_stand_ins(spark):
    given = spark.createDataFrame([("r", "none", "{}"), ("q", "bare", '{"a": 1}'), ("p", "bare", "{}")], "run string, stand_in string, inputs string")
    rows = runs.resolve_inputs(given, spark.createDataFrame(DECLARED, f"stand_in string, inputs {INPUTS}"))
    assert {(r["run"], r["name"], r["problem"]) for r in rows.collect()} == {("r", None, "no-stand-in"), ("q", "a", "unknown")}


def test_paths_like_the_standard_library(spark):
    r = random.Random(4)
    paths = ["/".join(r.choice(["a", "b", "..", ".", "", "wd", "w"]) for _ in range(r.randint(1, 7))) for _ in range(600)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", runs.contained(F.col("p"), F.lit("/wd/w")).alias("c")).collect()
    for row in rows:
        full = os.path.normpath(os.path.join("/wd/w", row["p"]))
        steps, depth, above = row["p"].split("/"), 0, False
        for s in steps:
            depth += 0 if s in ("", ".") else -1 if s == ".." else 1
            above |= depth < 0 and not row["p"].startswith("/")
        inside = (full == "/wd/w" or full.startswith("/wd/w/")) and not above
        if row["p"].startswith("/") and depth < 0:
            continue  # above the root: here an error, elsewhere the root
        expected = os.path.relpath(full, "/wd/w").replace(".", "", 1) if full == "/wd/w" else os.path.relpath(full, "/wd/w")
        if row["c"] is None and inside and row["p"].startswith("/"):
            continue
        assert row["c"] == (expected if inside else None), row["p"]


def test_artifacts(spark):
    payload = json.dumps({"artifacts": [{"path": "a.txt", "cues": 2}, {"path": "../b"}, {"path": "c"}, {"path": ""}, "x", {"kind": "k"}, {"path": "./a.txt", "kind": "k", "cues": True}]})
    results = spark.createDataFrame([("r", payload), ("q", "{}"), ("p", None), ("o", "bad")], "run string, payload string")
    rows = runs.collect_artifacts(results, spark.createDataFrame([("r", "a.txt"), ("r", "a.txt"), ("q", "c")], "run string, path string")).collect()
    assert sorted(tuple(r) for r in rows) == [("r", 0, "a.txt", "file", 2, "kept"), ("r", 1, "../b", "file", None, "outside"), ("r", 2, "c", "file", None, "not-written"), ("r", 6, "./a.txt", "k", None, "kept")]


def scan_by_hand(sizes, files_most, bytes_most, one_most):
    n = total = 0
    for i, size in enumerate(sizes):
        if n >= files_most:
            return n, total, True, "files", i
        if size is None or size > one_most:
            continue
        if total + size > bytes_most:
            return n, total, True, "bytes", i
        n, total = n + 1, total + size
    return n, total, False, None, None


def test_scans_and_caps_like_a_walk(spark):
    r = random.Random(9)
    scopes = {f"s{i}": [r.choice([None, 0, 5, 10, 50, 200]) for _ in range(r.randint(1, 40))] for i in range(60)}
    files = spark.createDataFrame([(k, i, s) for k, v in scopes.items() for i, s in enumerate(v)], "scope string, ord long, size long")
    for caps in ((10, 150, 100), (5, 10**6, 100), (10**6, 60, 100), (3, 30, 10**6)):
        told = {x["scope"]: x for x in repos.scans(files, ["scope"], "ord", *caps).collect()}
        kept = repos.capped(files, ["scope"], "ord", *caps).groupBy("scope").agg(F.count("*").alias("n"), F.max("ord").alias("last"))
        listed = {x["scope"]: x["n"] for x in kept.collect()}
        for scope, sizes in scopes.items():
            n, total, truncated, reason, at = scan_by_hand(sizes, *caps)
            x = told[scope]
            assert (x["n_files"], x["n_bytes"], x["truncated"], x["at"]) == (n, total, truncated, at)
            assert (x["reason"] is None) == (reason is None) and (reason or "") in (x["reason"] or "")
            assert listed.get(scope, 0) == n


def nested(r, depth):
    kind = r.randint(0, 7 if depth else 4)
    if kind == 0:
        return r.choice([None, True, False])
    if kind == 1:
        return r.randint(-(10**12), 10**12)
    if kind == 2:
        return "".join(r.choice(["a", "é", '"', "\\", "\n", "\x1f", "\x0b", "\x01", "\t", "/", "🙂", "u001F", "\x7f"]) for _ in range(r.randint(0, 8)))
    if kind == 3:
        return r.randint(-1000, 1000) / 4
    if kind == 4:
        return r.choice(["", "x"])
    if kind in (5, 6):
        return {"".join(r.choice('abcBé"_0 .$') for _ in range(r.randint(0, 3))): nested(r, depth - 1) for _ in range(r.randint(0, 4))}
    return [nested(r, depth - 1) for _ in range(r.randint(0, 4))]


def test_canonical_documents_like_the_standard_library(spark):
    r = random.Random(1)
    texts = [json.dumps(nested(r, 4), ensure_ascii=r.random() < 0.5) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", canonical_json(F.col("t"), 5).alias("c")).collect()
    for row in rows:
        assert row["c"] == json.dumps(json.loads(row["t"]), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def test_canonical_documents_that_are_none_or_too_deep(spark):
    one = lambda t, depth: spark.createDataFrame([(t,)], "t string").select(canonical_json(F.col("t"), depth).alias("c")).first()["c"]
    assert one("no json", 3) is None and one(None, 3) is None
    assert one('{"b":[[]],"a":1}', 3) == '{\n  "a": 1,\n  "b": [\n    []\n  ]\n}\n'
    with pytest.raises(Exception, match="nested more than 2 deep"):
        one("[[[]]]", 2)

import pytest
from pyspark.sql import functions as F

from tidemark.operators import routing

OPS = "repo string, id string, requires array<string>, optional boolean, gate array<string>, stand_in string"


def resolved(spark, ops, profiles=(("p", ["text.generate", "file.read"], ["http.request"]),), standins=(("card", 0.25),)):
    o = spark.createDataFrame(ops, OPS).withColumn("declared_stand_in", F.col("stand_in"))
    p = spark.createDataFrame(list(profiles), "profile string, native array<string>, mcp array<string>")
    s = spark.createDataFrame(list(standins), "stand_in string, fidelity double")
    return routing.resolve(o, p, s)


CASES = [
    (("r", "all-native", ["text.generate"], False, ["publish"], None), "native", 1.0),
    (("r", "nothing-required", [], False, [], None), "native", 1.0),
    (("r", "through-service", ["file.read", "http.request"], False, ["spend"], None), "mcp", 0.9),
    (("r", "substitute", ["image.generate"], False, [], "card"), "script", 0.25),
    (("r", "left-out", ["audio.tts"], True, ["publish"], None), "drop", 0.0),
    (("r", "asked", ["audio.tts"], False, ["irreversible", "publish"], None), "ask-user", 0.5),
]


def test_bindings_gates_and_coverage(spark):
    rows = {r["id"]: r for r in resolved(spark, [c[0] for c in CASES]).collect()}
    for op, binding, coverage in CASES:
        r = rows[op[1]]
        assert (r["binding"], r["coverage"]) == (binding, coverage)
        assert r["gates"] == (op[4] if binding in routing.EXECUTING else [])
        assert r["deferred_gates"] == (op[4] if binding == "ask-user" else [])
    assert rows["asked"]["missing"] == ["audio.tts"]


def test_summary_counts_required_only(spark):
    s = routing.summarise(resolved(spark, [c[0] for c in CASES])).first()
    assert (s["operations"], s["required"], s["optional"], s["n_ask_user"], s["n_drop"]) == (6, 5, 1, 1, 1)
    assert s["coverage"] == pytest.approx((1 + 1 + 0.9 + 0.25 + 0.5) / 5)
    assert (s["n_halted"], s["n_lost_optional"], s["n_lost"], s["n_degraded"]) == (1, 1, 0, 1) and not s["executable"]
    told = {(r["outcome"], r["id"], r["stand_in"]) for r in routing.outcomes(resolved(spark, [c[0] for c in CASES])).collect()}
    assert told == {("halted", "asked", None), ("lost_optional", "left-out", None), ("degraded", "substitute", "card")}


def test_sound_rows_break_no_invariant(spark):
    rows = resolved(spark, [c[0] for c in CASES])
    assert routing.violations(rows, rows.where("binding = 'drop'").select("profile", "id")).count() == 0


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({"gates": "cast(array() as array<string>)"}, {("all-native", "I1"), ("all-native", "I6"), ("through-service", "I1")}),
        ({"deferred_gates": "cast(array() as array<string>)"}, {("asked", "I7")}),
        ({"fidelity": "1.0D"}, {("substitute", "I4")}),
    ],
)
def test_damage_is_found(spark, change, expected):
    rows = resolved(spark, [c[0] for c in CASES]).withColumns({k: F.expr(v) for k, v in change.items()})
    assert {(r["id"], r["invariant"]) for r in routing.violations(rows).collect()} == expected


def test_unknown_capability_is_an_error_in_the_plan(spark):
    ops = spark.createDataFrame([("r", "x", ["no.such"], False, [], None)], OPS)
    profiles = spark.createDataFrame([("p", [], [])], "profile string, native array<string>, mcp array<string>")
    words = spark.createDataFrame([("file.read",)], "capability string")
    rows = routing.resolve(ops, profiles, spark.createDataFrame([("card", 0.1)], "stand_in string, fidelity double"), words)
    for column in ("binding", "gates", "coverage", "deferred_gates"):
        with pytest.raises(Exception, match="unknown capabilities: no.such"):
            rows.select(column).collect()
    with pytest.raises(Exception, match="no.such"):
        routing.summarise(rows).collect()


def test_more_profiles_than_allowed_are_an_error(spark):
    ops = spark.createDataFrame([("r", "x", ["a"], False, [], None)], OPS)
    profiles = spark.range(5).select(F.concat(F.lit("p"), "id").alias("profile"), F.array(F.lit("a")).alias("native"), F.array().cast("array<string>").alias("mcp"))
    assert routing.with_profiles(ops, profiles, 5).count() == 5
    with pytest.raises(Exception, match="more than 4 profiles"):
        routing.with_profiles(ops, profiles, 4).select(routing.binding_of().alias("b")).collect()


def test_question_names_every_deferred_gate(spark):
    rows = resolved(spark, [c[0] for c in CASES]).withColumn("question", routing.question(F.col("id"), F.col("missing"), F.col("deferred_gates")))
    assert routing.unsurfaced_gates(rows).count() == 0
    assert routing.unsurfaced_gates(rows.withColumn("question", F.lit("?"))).count() == 2


def test_unknown_stand_in_is_an_error_in_the_plan(spark):
    """Whatever is read, and whether or not the operation needs its stand-in; an empty name is none."""
    for requires in (["a"], ["text.generate"]):
        rows = resolved(spark, [("r", "x", requires, False, ["spend"], "nothing")])
        for column in ("binding", "gates", "coverage", "fidelity"):
            with pytest.raises(Exception, match="unknown stand-in: nothing"):
                rows.select(column).collect()
    assert resolved(spark, [("r", "x", ["a"], False, [], "")]).first()["binding"] == "ask-user"


def test_question_names_the_safe_default(spark):
    row = spark.range(1).select(routing.question(F.lit("x"), F.array(F.lit("a.b")), F.array(F.lit("spend"), F.lit("irreversible"))).alias("q")).first()["q"]
    assert "IRREVERSIBLE" in row and row.endswith("Default: change nothing.")

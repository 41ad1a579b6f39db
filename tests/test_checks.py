from pyspark.sql import functions as F

from tidemark.operators import checks
from tidemark.sources.catalogues import front_matter


def test_profiles(spark):
    rows = [("ok", ["a"], ["b"], None), ("both", ["a"], ["a"], None), ("old", ["a"], [], "2020-01-01"), ("odd", ["zz"], [], "2999-01-01"), ("twice", ["a"], [], None), ("twice", ["b"], [], None)]
    p = spark.createDataFrame(rows, "profile string, native array<string>, mcp array<string>, expiry string")
    v = spark.createDataFrame([("a",), ("b",)], "capability string")
    got = {(r["profile"], r["rule"]) for r in checks.validate_profiles(p, v, F.lit("2025-01-01").cast("date")).collect()}
    assert got == {("both", "both-channels"), ("old", "expired"), ("odd", "unknown-capability"), ("twice", "duplicate-id")}


def test_standins(spark):
    s = spark.createDataFrame([("a", 0.5, "reducing"), ("b", 1.0, "reducing"), ("c", None, "deferred"), ("d", 0.0, "other")], "stand_in string, fidelity double, type string")
    assert {(r["stand_in"], r["rule"]) for r in checks.validate_standins(s).collect()} == {("b", "fidelity"), ("c", "fidelity"), ("d", "type")}


def test_package_budgets(spark):
    f = spark.createDataFrame([("good", "x"), ("Bad", "x"), ("long", "x\n" * 500), ("big", "y" * 20004)], "name string, text string")
    assert {(r["name"], r["rule"]) for r in checks.validate_package(f, "name", "text").collect()} == {("Bad", "name"), ("long", "lines"), ("big", "tokens")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "day string, id string, stage string, effect string, confidence string, requires array<string>, gate array<string>")
    assert checks.validate_operations(none, ["day"]).count() == 0


SKILL = "---\nname: {}\ndescription: x\n{}---\nprofile text\n"


def skill_files(spark):
    rows = [
        ("good", "SKILL.md", SKILL.format("good", "metadata:\n  size: 1\n")), ("good", "references/a.md", "x"), ("bare", "references/a/b.md", "x"), ("bare", "notes.txt", "x"), ("other", "SKILL.md", SKILL.format("name", "odd: x\n")),
        ("deep", "SKILL.md", SKILL.format("deep", "  a: b\nnothing\n")), ("open", "SKILL.md", "---\nname: open\n"), ("twice", "SKILL.md", SKILL.format("wrong", "name: twice\n")), ("none", "SKILL.md", None),
    ]
    return spark.createDataFrame(rows, "package string, rel string, text string")


def test_packages_need_no_join(spark):
    """Rules come from the row of a file: no table of packages is joined, so none is ever broadcast. Of a repeated name the last counts."""
    got = checks.validate_packages(skill_files(spark))
    assert sorted((r["package"], r["rule"]) for r in got.collect()) == sorted([
        ("bare", "no-skill-file"), ("bare", "reference-depth"), ("bare", "unexpected-entry"), ("other", "name-folder"), ("other", "unknown-key"), ("deep", "front-matter-no-parent"), ("deep", "front-matter-no-colon"),
        ("open", "front-matter-not-closed"), ("none", "front-matter-no-opening"),
    ])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_front_matter_needs_no_join(spark):
    """Lines come from the row of a document: nothing is joined, shuffled or broadcast, and texts of one key don't mix."""
    docs = [("a", "---\nx: 1\n# no\n\nm:\n  k: 'v'\nplain\n  l: w\nq: r\n  s: t\n---\nz: 1"), ("a", "---\n  odd: x\n ---"), ("b", "--- y\nx: 1"), ("c", None)]
    entries, faults = front_matter(spark.createDataFrame(docs, "k string, text string"), "k")
    assert sorted(map(tuple, entries.collect()), key=str) == sorted([("a", 2, None, "x", "1"), ("a", 5, None, "m", ""), ("a", 6, "m", "k", "v"), ("a", 8, "m", "l", "w"), ("a", 9, None, "q", "r")], key=str)
    assert sorted(map(tuple, faults.collect())) == [("a", 2, "no-parent"), ("a", 7, "no-colon"), ("a", 10, "no-parent"), ("b", 1, "not-closed"), ("c", 1, "no-opening")]
    for rows in (entries, faults):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan

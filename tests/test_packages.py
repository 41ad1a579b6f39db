"""The package sink: all or nothing, refusals, paths; and what a package says."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.test_routing import CASES, resolved
from tidemark.operators import checks, packages
from tidemark.sources import packages as P
from tidemark.sources.packages import PackageError, PackageWriter, Written, inside, read_packages, write_packages

LINES = "package string, rel string, section int, at string, place long, line string"


def lines(spark, *rows):
    return spark.createDataFrame([(p, rel, 0, "", i, text) for i, (p, rel, text) in enumerate(rows)], LINES)


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_written_and_read_back(spark, tmp_path):
    rows = lines(spark, ("a", "SKILL.md", "one"), ("a", "SKILL.md", ""), ("a", "references/x.md", "é"), ("b", "SKILL.md", "two"), ("a", "SKILL.md", "three"))
    write_packages(rows.orderBy(F.rand(1)), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == ["a/SKILL.md", "a/references/x.md", "b/SKILL.md"]
    got = {(r["package"], r["rel"]): r["text"] for r in read_packages(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "SKILL.md"): "one\n\nthree\n", ("a", "references/x.md"): "é\n", ("b", "SKILL.md"): "two\n"}
    write_packages(lines(spark, ("c", "SKILL.md", "x")), str(tmp_path / "out"))  # beside what is there
    assert {"a", "b", "c"} == set(os.listdir(tmp_path / "out"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    many = spark.range(200).select(F.concat(F.lit("p"), "id").alias("package"), F.lit("SKILL.md").alias("rel"), F.lit(0).alias("section"), F.lit("").alias("at"), F.lit(0).cast("long").alias("place"), F.when(F.col("id") == 150, F.lit(None)).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="NoneType"):
        write_packages(many, str(tmp_path / "out"), parts=8)
    assert os.listdir(tmp_path / "out") == []


def test_a_folder_that_holds_something_stops_everything(spark, tmp_path):
    (tmp_path / "out" / "b").mkdir(parents=True)
    (tmp_path / "out" / "a").mkdir()  # an empty folder is no obstacle
    (tmp_path / "out" / "b" / "mine").write_text("x")
    with pytest.raises(Exception, match="isn't empty"):
        write_packages(lines(spark, ("a", "SKILL.md", "x"), ("b", "SKILL.md", "x")), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == ["b/mine"] and sorted(os.listdir(tmp_path / "out")) == ["a", "b"]


@pytest.mark.parametrize(("package", "rel"), [("../a", "x"), ("/a", "x"), ("a/b", "x"), (".a", "x"), ("a", "../x"), ("a", "/etc/x"), ("a", "x/../../y"), ("", "x"), ("a", "")])
def test_paths_stay_inside(spark, tmp_path, package, rel):
    with pytest.raises(Exception, match="no path inside|no name of a package"):
        write_packages(lines(spark, (package, rel, "x")), str(tmp_path / "out"))
    assert tree(tmp_path) == []


def test_inside_allows_what_stays():
    assert inside("/r", "a/../b") == "/r/b"


def test_a_commit_that_breaks_off_is_taken_back(tmp_path, monkeypatch):
    writer = PackageWriter(str(tmp_path))
    for p in ("a", "b"):
        os.makedirs(os.path.join(writer.staging, "t", p))
    rename, calls = os.rename, []

    def breaking(source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("full")
        rename(source, target)

    monkeypatch.setattr(os, "rename", breaking)
    with pytest.raises(OSError, match="full"):
        writer.commit([Written(os.path.join(writer.staging, "t"), ["a", "b"]), None])
    assert os.listdir(tmp_path) == []
    twice = PackageWriter(str(tmp_path))
    with pytest.raises(PackageError, match="come twice"):
        twice.commit([Written("x", ["a"]), Written("y", ["a"])])


def inventory(spark, **changed):
    rows = resolved(spark, [c[0] for c in CASES]).withColumnRenamed("repo", "scope")
    return rows.withColumns({k: F.lit(v) for k, v in ({"stage": "prepare", "effect": "read-local", "confidence": "low"} | changed).items()})


def meta(spark, status="reviewed", scopes=("r",)):
    return spark.createDataFrame([(s, "https://example.org/shop.git", None, status, None) for s in scopes], "scope string, url string, sha string, status string, repo_class string")


CATALOGUE = "stand_in string, fidelity double, desc string, caveat string, script string"


def test_refusals(spark):
    rows = inventory(spark)
    told = lambda *a, **k: {(r["reason"], r["n"]) for r in packages.refusals(*a, ["scope"], **k).collect()}
    assert told(rows, meta(spark)) == set()
    assert told(rows, meta(spark, "draft")) == {("draft", 1)}
    assert told(rows, meta(spark, "draft"), accept_unreviewed=True) == set()
    assert told(rows.withColumn("gates", F.array().cast("array<string>")), meta(spark)) == {("I1", 2), ("I6", 1)}
    assert told(rows.withColumn("question", F.lit("?")), meta(spark)) == {("gate-not-asked", 2)}
    both = rows.unionByName(rows.withColumn("scope", F.lit("s")))
    assert told(both, meta(spark, scopes=("r", "s"))) == {("name-taken", 1)}


def test_refused_packages_are_not_written(spark, tmp_path):
    rows = inventory(spark)
    with pytest.raises(PackageError, match="draft"):
        write_packages(lines(spark, ("a", "SKILL.md", "x")), str(tmp_path / "out"), packages.refusals(rows, meta(spark, "draft"), ["scope"]))
    assert not (tmp_path / "out").exists()


def test_what_a_package_says(spark, tmp_path):
    catalogue = spark.createDataFrame([("card", 0.25, "a card", "no motion", "card.py")], CATALOGUE)
    evidence = spark.createDataFrame([("r", "asked", 2, "traced", "a.py:3", "post"), ("r", "asked", 1, "declared", "a.py:1", None)], "scope string, id string, ord long, source string, loc string, detail string")
    scripts = spark.createDataFrame([("card.py", "print(1)\n"), ("other.py", "no")], "script string, text string")
    write_packages(packages.package_lines(inventory(spark), meta(spark, "draft"), ["scope"], catalogue, evidence, scripts), str(tmp_path / "out"))
    got = read_packages(spark, str(tmp_path / "out"))
    texts = {r["rel"]: r["text"] for r in got.collect()}
    assert {r["package"] for r in got.collect()} == {"shop-p"} and "scripts/card.py" in texts and "scripts/other.py" not in texts
    assert texts["scripts/card.py"] == "print(1)\n"
    assert "inventory_status: accepted-unreviewed" in texts["SKILL.md"] and "## Not reviewed" in texts["SKILL.md"]
    assert "- `asked` lacks audio.tts; ask about irreversible, publish" in texts["SKILL.md"]
    assert texts["references/bindings.md"].index("- `declared` a.py:1\n") < texts["references/bindings.md"].index("- `traced` a.py:3: post\n")
    assert "IRREVERSIBLE, PUBLISH" in texts["references/blocked.md"] and "25 %" in texts["references/degradation.md"]
    assert checks.validate_packages(got).count() == 0


def test_refusal_documents(spark, tmp_path):
    rows = spark.createDataFrame([("x", "not-suitable", "u", ["a", "b"], ["c"]), ("y", "not-suitable", None, ["a"], []), ("z", "suitable", None, [], [])], "scope string, status string, source string, reasons array<string>, evidence array<string>")
    write_packages(packages.refusal_lines(rows, ["scope"]), str(tmp_path / "out"))
    assert tree(tmp_path / "out") == ["x/NOT-SUITABLE.md", "y/NOT-SUITABLE.md"]
    text = (tmp_path / "out" / "x" / "NOT-SUITABLE.md").read_text()
    assert "Source: `u`" in text and "- a\n- b\n" in text and "## Seen\n\n- c\n" in text
    assert "## Seen" not in (tmp_path / "out" / "y" / "NOT-SUITABLE.md").read_text()


def test_every_name_comes_back(spark, tmp_path):
    """No index of files is made on the driver, which would hold them all, leave out names that begin with _ or . and read + as a blank."""
    rows = [("a", "b+c%20d.txt", "1"), ("a", "_x/.y/z", "2"), ("_p", "x y", "3"), ("é=1", "texts/ü.md", "4"), ("a", "texts/1", "\r"), ("a", "texts/2", "")]
    write_packages(lines(spark, *rows), (tmp_path / "out").as_uri())
    (tmp_path / "out" / ".hidden").mkdir()
    (tmp_path / "out" / ".hidden" / "x").write_text("no package")
    (tmp_path / "out" / "x").write_text("no package")
    (tmp_path / "out" / "a" / "empty").write_text("")
    (tmp_path / "out" / "a" / "odd").write_bytes(b"\xff")
    got = read_packages(spark, (tmp_path / "out").as_uri())
    assert sorted(map(tuple, got.where("rel not in ('empty', 'odd')").collect())) == sorted((p, rel, text + "\n") for p, rel, text in rows)
    assert {r["rel"]: r["h"] for r in got.where("rel in ('empty', 'odd')").select("rel", F.hex("text").alias("h")).collect()} == {"empty": "", "odd": "FF"}
    assert got.inputFiles() == [] and read_packages(spark, str(tmp_path / "out" / "a")).where("package not in ('_x', 'texts')").count() == 0
    with pytest.raises(PackageError, match="share"):
        read_packages(spark, "hdfs://there/out")


def test_files_are_handed_on_in_bounded_batches():
    files = [("p", str(i), b"x" * 1000) for i in range(50)] + [("p", "long", b"x" * 9000), ("p", "last", b"")]
    got = list(P.batches(iter(files), P.TEXT, lambda r: len(r[2]), 4000))
    assert [b.num_rows for b in got] == [4] * 12 + [3, 1] and [tuple(r.values()) for b in got for r in b.to_pylist()] == files
    assert list(P.batches(iter(()), P.TEXT)) == []


def test_a_commit_of_many_packages(tmp_path):
    """Its time grows with the packages, not with their square."""
    names, began = [f"p{i}" for i in range(60_000)], time.monotonic()
    with pytest.raises(PackageError, match=r"come twice: \['p7'\]"):
        PackageWriter(str(tmp_path)).commit([Written("x", names), Written("y", ["p7"])])
    assert time.monotonic() - began < 10

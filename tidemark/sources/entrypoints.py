"""Ways into a repository: console scripts, node binaries and scripts, make targets, conventional file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dialects import make_targets
from tidemark.operators.fusion import first_by
from tidemark.sources.repos import basename

# File names that are entry points by convention, and the npm scripts that count.
CONVENTIONAL = {"__main__.py": "module", "main.py": "script", "cli.py": "cli", "app.py": "server", "server.py": "server", "manage.py": "cli", "wsgi.py": "server", "asgi.py": "server", "run.py": "script"}
NPM_SCRIPTS = ("start", "serve", "dev", "build", "test")
DEEPEST = 2


def entrypoints(files: DataFrame) -> DataFrame:
    """repo, kind, loc, name, source of each entry point; of equal kind and place the first by source and name stays."""
    at = lambda name: files.where((basename(F.col("rel")) == name) & F.col("text").isNotNull())
    row = lambda df, kind, loc, name, source: df.select("repo", kind.alias("kind"), loc.alias("loc"), name.alias("name"), F.lit(source).alias("source"))

    section = F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\[(?:project|tool\.poetry)\.scripts\]\s*$(.*?)(?=^\[|\z)"), F.lit(1)))
    entry = r"""^\s*["']?([A-Za-z0-9_.-]+)["']?\s*=\s*["']([^"']+)["']"""
    lines = at("pyproject.toml").select("repo", section.alias("body")).select("repo", F.explode(F.split("body", "\n")).alias("line"))
    target = F.regexp_extract("line", entry, 2)
    console = row(lines.where(target != ""), F.lit("console-script"), F.concat(F.regexp_extract(target, r"^([^:.]*)", 1), F.lit(".py")), F.regexp_extract("line", entry, 1), "declared")

    package = at("package.json")
    bins = package.select("repo", F.explode(F.from_json(F.get_json_object("text", "$.bin"), "map<string,string>")).alias("name", "target"))
    scripts = package.select("repo", F.explode(F.json_object_keys(F.get_json_object("text", "$.scripts"))).alias("name")).where(F.col("name").isin(*NPM_SCRIPTS))
    kinds = F.create_map(*[F.lit(x) for kv in CONVENTIONAL.items() for x in kv])
    usual = files.withColumn("kind", kinds[F.substring_index("rel", "/", -1)]).where(F.col("kind").isNotNull() & (F.size(F.split("rel", "/")) - 1 <= DEEPEST))
    makes = make_targets(files.where(F.substring_index("rel", "/", -1) == "Makefile"))
    found = (
        console.unionByName(row(bins, F.lit("cli"), F.col("target"), F.col("name"), "declared"))
        .unionByName(row(scripts, F.lit("script"), F.concat(F.lit("package.json#scripts."), "name"), F.col("name"), "declared"))
        .unionByName(row(makes, F.lit("make-target"), F.concat_ws("#", "rel", "op"), F.col("op"), "declared"))
        .unionByName(row(usual, F.col("kind"), F.col("rel"), F.lit(None).cast("string"), "convention"))
    )
    return first_by(found.withColumn("ord", F.when(F.col("source") == "declared", 0).otherwise(1)), ["repo", "kind", "loc"], ["ord", "name"]).select("repo", "kind", "loc", "name", "source")

"""Runs of stand-ins as rows: what goes in, what comes out. The scripts themselves run elsewhere.

declared: stand_in, inputs (array of name, type, default as JSON, required)      given: run, stand_in, inputs (a JSON object)
results:  run, payload (JSON)                                                    written: run, path
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import coerced

KINDS = ("string", "number", "integer")


def reconciled(declared: Column, given: Column) -> Column:
    """Entries (name, value, problem) of declared inputs against a map of given JSON values, in one expression.

    A given value is taken as its declared type, a missing one is its default. Problems: missing, unknown, not-a-<type>.
    """
    none = F.lit(None).cast("string")
    entry = lambda name, value, problem: F.struct(name.alias("name"), value.alias("value"), problem.alias("problem"))

    def of(d: Column) -> Column:
        has, told = F.map_contains_key(given, d["name"]), F.try_element_at(given, d["name"])
        value, typed = coerced(told, d["type"]), F.coalesce(d["type"].isin(*KINDS), F.lit(False))
        problem = F.when(has & typed & value.isNull(), F.concat(F.lit("not-a-"), d["type"])).when(~has & d["default"].isNull() & F.coalesce(d["required"], F.lit(False)), "missing")
        return entry(d["name"], F.when(has, value).otherwise(coerced(d["default"], d["type"])), problem)

    names = F.transform(declared, lambda d: d["name"])
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.array_contains(names, k)), lambda k: entry(k, none, F.lit("unknown")))
    return F.concat(F.transform(declared, of), unknown)


def resolve_inputs(given: DataFrame, declared: DataFrame) -> DataFrame:
    """run, name, value, problem: the inputs of every run, and what is wrong with them.

    Inputs that are declared without a default and not required appear only where they are given. Inputs that aren't a JSON object
    are one row, not-an-object; a run of a stand-in that isn't declared is one row, no-stand-in. Null inputs are none.
    """
    values = F.transform_values(F.from_json(F.coalesce("given", F.lit("{}")), "map<string,variant>"), lambda k, v: F.to_json(v))
    rows = given.select("run", "stand_in", F.col("inputs").alias("given")).join(declared.select("stand_in", F.coalesce("inputs", F.array().cast("array<struct<name:string,type:string,default:string,required:boolean>>")).alias("declared"), F.lit(True).alias("there")), "stand_in", "left")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(F.coalesce("given", F.lit("{}")))).startswith("OBJECT"), F.lit(False))
    alone = lambda problem: F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("value"), F.lit(problem).alias("problem")))
    rows = rows.withColumn("is_object", is_object).withColumn("values", F.when(F.col("is_object"), values))
    entries = F.when(F.col("there").isNull(), alone("no-stand-in")).when(~F.col("is_object"), alone("not-an-object")).otherwise(reconciled(F.col("declared"), F.col("values")))
    return rows.select("run", F.explode(entries).alias("x")).select("run", "x.*").where("value is not null or problem is not null")


def resolved_path(path: Column) -> Column:
    """The parts of a path after '.' and '..' are worked off, in one fold; null where '..' leads above its start. Links aren't followed."""
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))  # null from here on, if there is nothing above
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(F.split(path, "/"), none, step)


def contained(path: Column, folder: Column | None = None) -> Column:
    """A path as it is below a working folder, without '.' and '..'; null where it leads out. ``folder``: for absolute paths into it."""
    relative = F.when(~path.startswith("/"), resolved_path(path))
    if folder is not None:
        base, whole = resolved_path(folder), resolved_path(path)
        below = (F.size(whole) >= F.size(base)) & (F.slice(whole, F.lit(1), F.size(base)) == base)
        relative = F.coalesce(relative, F.when(path.startswith("/") & below, F.slice(whole, F.size(base) + 1, F.greatest(F.size(whole) - F.size(base), F.lit(0)))))
    return F.array_join(relative, "/")


def collect_artifacts(results: DataFrame, written: DataFrame, folder: str | None = None) -> DataFrame:
    """run, place, path, kind, cues, status: what runs say they made. status: kept, outside, or not-written.

    Containment is settled from the path alone, before any file is looked for among ``written`` (run, path below the working folder).
    Entries that aren't objects or have no path are left out. ``folder`` names the column of ``results`` with the working folder.
    """
    listed = F.from_json(F.get_json_object("payload", "$.artifacts"), "array<variant>")
    rows = results.select("run", (F.col(folder) if folder else F.lit(None).cast("string")).alias("folder"), F.posexplode(listed).alias("place", "v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda key: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant")) == "STRING", F.try_variant_get("v", f"$.{key}", "string"))
    cues = F.when(F.schema_of_variant(F.try_variant_get("v", "$.cues", "variant")) == "BIGINT", F.try_variant_get("v", "$.cues", "bigint"))
    rows = rows.select("run", "folder", "place", text("path").alias("path"), F.coalesce(text("kind"), F.lit("file")).alias("kind"), cues.alias("cues")).where("path <> ''")
    rows = rows.withColumn("at", contained(F.col("path"), F.col("folder") if folder else None))
    there = written.select("run", F.col("path").alias("at"), F.lit(True).alias("there")).distinct()
    status = F.when(F.col("at").isNull(), "outside").when(F.col("there").isNull(), "not-written").otherwise("kept")
    return rows.join(there, ["run", "at"], "left").select("run", "place", "path", "kind", "cues", status.alias("status"))


def required_not_run(operations: DataFrame, runs: DataFrame, scope: list[str]) -> DataFrame:
    """scope, failed: whether a required operation (scope, id, optional) has no run (scope, id, status) that went well."""
    good = runs.where("status = 'ok'").select(*scope, "id").distinct()
    open_ = operations.where(~F.col("optional")).join(good, [*scope, "id"], "left_anti").select(*scope).distinct().withColumn("failed", F.lit(True))
    return operations.select(*scope).distinct().join(open_, scope, "left").select(*scope, F.coalesce("failed", F.lit(False)).alias("failed"))

"""Capability routing: every operation against every environment profile, as one projection and one aggregate.

operations: repo, id, name, stage, effect, requires, optional, gate, stand_in, ord
profiles:   profile, native, mcp            stand-ins: stand_in, fidelity, desc
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINDINGS = ("native", "mcp", "script", "ask-user", "drop")
EXECUTING = ("native", "mcp", "script")
CRITICAL = ("publish", "irreversible")
#: How much of an operation a binding keeps; a script keeps its stand-in's fidelity.
KEEPS = {"native": 1.0, "mcp": 0.9, "ask-user": 0.5, "drop": 0.0}
MOST_PROFILES = 10_000


def unknown_capabilities(profiles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Capabilities that a profile offers and the vocabulary (capability) doesn't have: profile, capability."""
    offered = profiles.select("profile", F.explode(F.array_union("native", "mcp")).alias("capability")).distinct()
    return offered.join(vocabulary.select("capability"), "capability", "left_anti").select("profile", "capability")


def missing_of(requires: Column, native: Column, mcp: Column) -> Column:
    """Capabilities that no channel offers, in the order of requires, repeats kept."""
    return F.filter(requires, lambda c: ~(F.array_contains(native, c) | F.array_contains(mcp, c)))


def binding_of() -> Column:
    """First match wins, over the columns requires, native, mcp, stand_in, optional."""
    on_native = F.size(F.array_except("requires", "native")) == 0
    on_both = F.size(missing_of(F.col("requires"), F.col("native"), F.col("mcp"))) == 0
    some_mcp = F.arrays_overlap("requires", "mcp")
    return (
        F.when(on_native, "native").when(on_both & some_mcp, "mcp").when(F.col("stand_in").isNotNull() & (F.col("stand_in") != ""), "script")
        .when(F.coalesce("optional", F.lit(False)), "drop").otherwise("ask-user")
    )


def failing(test: Column, message: Column, value: Column) -> Column:
    """``value``, or an error where ``test`` holds: an assertion that runs with the plan, in a column that is used."""
    return F.when(test, F.raise_error(message)).otherwise(value)


def with_profiles(operations: DataFrame, profiles: DataFrame, most: int = MOST_PROFILES) -> DataFrame:
    """Every operation with every profile. Profiles are a catalogue of a few rows: no more than ``most`` are broadcast, and more are an error.

    The error stands in what profiles offer and are called, so the number is checked wherever a profile is used.
    """
    few = profiles.limit(most + 1)
    counted = few.crossJoin(F.broadcast(few.agg(F.count("*").alias("_profiles"))))
    checked = {c: failing(F.col("_profiles") > most, F.lit(f"more than {most} profiles"), F.col(c)) for c in profiles.columns}
    return operations.crossJoin(F.broadcast(counted.withColumns(checked).drop("_profiles")))


def resolve(operations: DataFrame, profiles: DataFrame, standins: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row for each operation and profile: binding, enforced and deferred gates, stand-in, coverage, missing.

    A stand-in that the catalogue doesn't have is an error, and so is a capability outside the ``vocabulary`` (capability), where one
    is given. Both stand in the binding, from which everything else follows: no job runs ahead of the query.
    """
    known = standins.groupBy("stand_in").agg(F.first("fidelity").alias("fidelity"), F.lit(True).alias("_in_catalogue"))
    rows = operations.join(known, "stand_in", "left")
    named = F.col("stand_in").isNotNull() & (F.col("stand_in") != "")
    binding = failing(named & F.col("_in_catalogue").isNull(), F.concat(F.lit("unknown stand-in: "), "stand_in"), binding_of())
    if vocabulary is not None:
        rows = rows.crossJoin(F.broadcast(vocabulary.agg(F.collect_set("capability").alias("_words"))))  # one row, of a closed list
        odd = F.array_except("requires", "_words")
        binding = failing(F.size(odd) > 0, F.concat(F.lit("unknown capabilities: "), F.array_join(odd, ", ")), binding)
    rows = with_profiles(rows, profiles).withColumn("binding", binding).drop("_in_catalogue", "_words")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("gates", F.when(F.col("binding").isin(*EXECUTING), F.col("gate")).otherwise(none))
    rows = rows.withColumn("deferred_gates", F.when(F.col("binding") == "ask-user", F.col("gate")).otherwise(none))
    rows = rows.withColumn("stand_in", F.when(F.col("binding") == "script", F.col("stand_in")))
    rows = rows.withColumn("missing", missing_of(F.col("requires"), F.col("native"), F.col("mcp"))).drop("native", "mcp")
    rows = rows.withColumn("fidelity", F.when(F.col("binding") == "script", F.col("fidelity")))
    kept = reduce(lambda c, b: c.when(F.col("binding") == b, KEEPS[b]), list(KEEPS), F.when(F.col("binding") == "script", F.coalesce("fidelity", F.lit(0.5))))
    return rows.withColumn("coverage", kept)


def summarise(rows: DataFrame, by: tuple[str, ...] = ("profile",), *more: Column) -> DataFrame:
    """Roll-up of resolved rows in numbers and gates; coverage is over required operations only, unrounded, 0 where there are none.

    One row for a group, whatever its size: gates are a closed list. The ids behind the numbers are rows of ``outcomes``.
    ``more`` are aggregates of one's own, so that the resolved rows are made once.
    """
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    told = [F.count_if(cond).alias(f"n_{name}") for name, cond in outcome_tests().items()]
    return rows.groupBy(*by).agg(*binding_columns(), flat("gates").alias("gates"), F.sum(F.size("gates")).alias("gate_count"), flat("deferred_gates").alias("deferred_gates"), *told, *more)


def outcome_tests() -> dict[str, Column]:
    required, bound = ~F.col("optional"), lambda b: F.col("binding") == b
    return {
        "halted": required & bound("ask-user"), "halted_optional": ~required & bound("ask-user"), "lost": required & bound("drop"), "lost_optional": ~required & bound("drop"), "degraded": bound("script"),
    }


def outcomes(rows: DataFrame, by: tuple[str, ...] = ("profile",)) -> DataFrame:
    """The operations that halt, are lost or run degraded, one row each: group, outcome, id, stand_in, fidelity."""
    tests = outcome_tests()
    name = F.coalesce(*[F.when(cond, F.lit(k)) for k, cond in tests.items()])
    script = F.col("binding") == "script"
    return rows.select(*by, name.alias("outcome"), "id", F.when(script, F.col("stand_in")).alias("stand_in"), F.when(script, F.col("fidelity")).alias("fidelity")).where("outcome is not null")


def binding_columns() -> list[Column]:
    required = ~F.col("optional")
    return [
        F.count("*").alias("operations"), F.count_if(required).alias("required"), F.count_if(~required).alias("optional"),
        *[F.count_if(F.col("binding") == b).alias("n_" + b.replace("-", "_")) for b in BINDINGS],
        F.coalesce(F.avg(F.when(required, F.col("coverage"))), F.lit(0.0)).alias("coverage"),
        (F.count_if(required & F.col("binding").isin("ask-user", "drop")) == 0).alias("executable"),
    ]


def binding_counts(rows: DataFrame, by: tuple[str, ...] = ("profile",)) -> DataFrame:
    return rows.groupBy(*by).agg(*binding_columns())


def violations(rows: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """Broken invariants of resolved rows as (profile, id, invariant); none means that all hold.

    ``rows`` carries what the operation declares (gate, optional, declared_stand_in) and what routing made of it.
    ``reported`` (profile, id) is the loss report that I5 compares with; without it I5 isn't checked.
    """
    executing = F.col("binding").isin(*EXECUTING)
    lost = F.size(F.array_except("gate", "gates")) > 0
    critical = F.arrays_overlap("gate", F.array(*map(F.lit, CRITICAL)))
    fid = F.col("fidelity")
    tests = {
        "I1": executing & lost,
        "I2": ~F.col("optional") & (F.col("binding") == "drop"),
        "I3": ~F.col("optional") & (F.size("missing") > 0) & F.col("declared_stand_in").isNull() & (F.col("binding") != "ask-user"),
        "I4": F.col("declared_stand_in").isNotNull() & (F.col("binding") == "script") & (fid.isNull() | (fid < 0) | (fid >= 1)),
        "I6": executing & critical & ~F.arrays_overlap("gate", "gates"),
        "I7": (F.size("gate") > 0) & (F.col("binding") == "ask-user") & (F.size(F.array_except("gate", "deferred_gates")) > 0),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()]))
    found = rows.select("profile", "id", F.explode(broken).alias("invariant"))
    if reported is not None:
        dropped = rows.where(F.col("binding") == "drop").select("profile", "id")
        found = found.unionByName(dropped.join(reported, ["profile", "id"], "left_anti").withColumn("invariant", F.lit("I5")))
    return found


#: What happens when nobody answers, by gate; the first of an operation's gates in this order decides.
SAFE_DEFAULTS = {
    "publish": "keep it unpublished", "irreversible": "change nothing", "spend": "spend nothing", "legal": "hold it back until the rights are settled", "privacy": "share nothing personal",
}


def safe_default(gates: Column) -> Column:
    out = F.lit("do not proceed")
    for gate, text in reversed(SAFE_DEFAULTS.items()):
        out = F.when(F.array_contains(gates, gate), text).otherwise(out)
    return out


def question(name: Column, missing: Column, gates: Column) -> Column:
    """What is asked where an operation can't run by itself: what is missing, every deferred gate by name, the safe default."""
    gated = F.when(F.size(gates) > 0, F.concat(F.lit(" Gates: "), F.upper(F.concat_ws(", ", gates)), F.lit("."))).otherwise("")
    return F.concat(F.lit("Cannot run '"), name, F.lit("': missing "), F.concat_ws(", ", missing), F.lit("."), gated, F.lit(" Default: "), safe_default(gates), F.lit("."))


def unsurfaced_gates(rows: DataFrame) -> DataFrame:
    """Deferred gates whose name doesn't occur in the question text: profile, id, gate."""
    gates = rows.where(F.col("binding") == "ask-user").select("profile", "id", "question", F.explode("deferred_gates").alias("gate"))
    return gates.where(~F.contains(F.upper("question"), F.upper("gate"))).drop("question")

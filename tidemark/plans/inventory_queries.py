"""Queries of routing, fusion, joins and revisions over operations derived from the tables, with their SQL.

An operation stands for a user's day in ``events``: it requires the event types of that day. That gives every subset of
capabilities, and a number of operations that grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import attribution, checks, fusion, inventory, revisions, routing
from tidemark.sources.tables import read

TYPES = ("click", "error", "purchase", "signup", "view")
KINDS = {"click": "deterministic", "error": "access", "purchase": "human", "signup": "generative", "view": "access"}
PROFILES = {"bare": (["click", "view"], []), "basic": (["click", "view"], ["error"]), "wide": (["click", "signup", "view"], ["error", "purchase"]), "full": (list(TYPES), [])}
STANDINS = {"card": 0.25, "ledger": 0.6}
DEFAULTS = {"error": "card", "purchase": "ledger"}
STAGES = ("acquire", "prepare", "transform", "verify", "deliver", "observe")

strings = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
joined = lambda c: F.concat_ws(",", c)
pick = lambda values, i: F.element_at(strings(values), i.cast("int"))


def one_row(spark: SparkSession, rows: list) -> DataFrame:
    """A small catalogue as a table, made by Spark itself."""
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def profiles(spark: SparkSession) -> DataFrame:
    return one_row(spark, [F.struct(F.lit(p).alias("profile"), strings(n).alias("native"), strings(m).alias("mcp")) for p, (n, m) in PROFILES.items()])


def standins(spark: SparkSession) -> DataFrame:
    return one_row(spark, [F.struct(F.lit(s).alias("stand_in"), F.lit(f).alias("fidelity")) for s, f in STANDINS.items()])


def vocabulary(spark: SparkSession) -> DataFrame:
    return one_row(spark, [F.struct(F.lit(c).alias("capability"), F.lit(k).alias("kind")) for c, k in KINDS.items()])


def operations(events: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    rows = events.groupBy("user_id", day.alias("day")).agg(F.array_sort(F.collect_set("event_type")).alias("requires"), F.count("*").alias("n"), F.min("event_id").alias("ord"))
    has = lambda c: F.array_contains("requires", c)
    gate = F.array_compact(F.array(F.when(F.col("n") % 5 == 0, "irreversible"), F.when(has("signup"), "privacy"), F.when(F.col("user_id") % 4 == 0, "publish"), F.when(has("purchase"), "spend")))
    return rows.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "day").alias("id"), "user_id", "day", "requires", gate.alias("gate"), (F.col("user_id") % 3 == 0).alias("optional"),
        pick(STAGES, F.col("user_id") % 6 + 1).alias("stage"), pick(fusion.EFFECTS, F.col("n") % 4 + 1).alias("effect"), pick(fusion.CONFIDENCE, F.col("ord") % 3 + 1).alias("confidence"),
        inventory.default_stand_in(F.col("requires"), DEFAULTS).alias("stand_in"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("n="), F.col("n"))).otherwise("").alias("summary"), "n", "ord",
    )


def ops(spark: SparkSession, sf: str) -> DataFrame:
    return operations(read(spark, sf, "events"))


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf).withColumn("declared_stand_in", F.col("stand_in"))
    return routing.resolve(rows, profiles(spark), standins(spark), vocabulary(spark))


def op_route(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_profiles(ops(spark, sf), profiles(spark)).select("profile", "id", routing.binding_of().alias("binding"))


def op_gates(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("profile", "id", joined("gates").alias("gates"), joined("deferred_gates").alias("deferred_gates"))


def op_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("profile", "id", "binding", "stand_in", "coverage", joined("missing").alias("missing"))


def op_summarise(spark: SparkSession, sf: str) -> DataFrame:
    covered = F.sum(F.when(~F.col("optional"), F.round(F.col("coverage") * 1000).cast("long")).otherwise(0)).alias("covered_milli")
    out = routing.summarise(resolved(spark, sf), ("profile", "stage"), covered).drop("coverage")
    return out.withColumns({c: joined(c) for c in ("gates", "deferred_gates")})


def agg_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return routing.outcomes(resolved(spark, sf), ("profile", "stage"))


def agg_binding_hist(spark: SparkSession, sf: str) -> DataFrame:
    return routing.binding_counts(resolved(spark, sf), ("profile", "day")).drop("coverage")


def op_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Violations in rows damaged on purpose, a different way for each remainder of the user's number."""
    r, none = F.col("user_id") % 10, strings([])
    rows = resolved(spark, sf)
    report = rows.where((F.col("binding") == "drop") & (r != 5)).select("profile", "id")
    rows = rows.withColumn("gates", F.when(r == 1, none).otherwise(F.col("gates"))).withColumn("deferred_gates", F.when(r == 4, none).otherwise(F.col("deferred_gates")))
    rows = rows.withColumn("binding", F.when(r == 2, "drop").otherwise(F.col("binding"))).withColumn("fidelity", F.when(r == 3, 1.5).otherwise(F.col("fidelity")))
    return routing.violations(rows, report)


def op_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolved(spark, sf).where("binding = 'ask-user'")
    rows = rows.withColumn("question", routing.question(F.col("id"), F.col("missing"), F.col("deferred_gates")))
    return rows.select("profile", "id", F.md5("question").alias("question_md5"))


def prd_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.deterministic(ops(spark, sf), vocabulary(spark))


def jn_provider_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Providers whose capabilities meet those of an operation."""
    table = {"shop": (["purchase", "click"], "spend", False), "crm": (["signup"], "privacy", False), "web": (["view", "click"], "publish", True)}
    p = one_row(spark, [F.struct(F.lit(k).alias("provider"), strings(c).alias("caps"), strings([g]).alias("gates"), F.lit(a).alias("ambiguous")) for k, (c, g, a) in table.items()])
    return inventory.provider_hits(ops(spark, sf), p).withColumn("gate_hints", joined("gate_hints"))


def jn_standin_default(spark: SparkSession, sf: str) -> DataFrame:
    return ops(spark, sf).select("id", "stand_in").join(F.broadcast(standins(spark)), "stand_in", "left").select("id", "stand_in", "fidelity")


def versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = read(spark, sf, "events")
    return operations(events.where("event_id % 9 <> 0")), operations(events.where("event_id % 11 <> 0"))


def jn_diff(spark: SparkSession, sf: str) -> DataFrame:
    return revisions.diff(*versions(spark, sf), ["id"])


def jn_merge_reviewed(spark: SparkSession, sf: str) -> DataFrame:
    old, new = versions(spark, sf)
    return revisions.merge_reviewed(new, old.withColumn("confidence", F.lit("high")), ["id"], "requires", ["stage", "effect", "confidence"])


def jn_apply_proposals(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf)
    asked = rows.where("ord % 7 = 0").select(F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("x"))).alias("id"), strings(["human.review"]).alias("requires"), F.when(F.col("n") > 2, strings(["legal"])).alias("gate"))
    done, unknown = revisions.apply_proposals(rows, asked, ["id"])
    out = done.select("id", joined("requires").alias("requires"), joined("gate").alias("gate"), "confidence")
    return out.unionByName(unknown.select("id", joined("requires").alias("requires"), F.lit("").alias("gate"), F.lit("unknown").alias("confidence")))


def snk_digest(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf).withColumn("sources", F.transform("requires", lambda c: F.when(c == "view", "traced").otherwise("declared")))
    d = revisions.digest(rows)
    return d.withColumns({c: joined(c) for c in ("requires", "gate", "sources")})


def agg_merge_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Merged operations; the ids of a group, which are rows, are listed here to be compared."""
    rows = fusion.drop_plumbing(ops(spark, sf))
    members = fusion.merged_members(rows, ["day"]).groupBy("day", F.col("merged_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("m"))
    m = fusion.merge_operations(rows, ["day"]).join(members, ["day", "id"]).withColumn("merged_ids", F.transform("m", lambda x: x["id"])).drop("m", "n_merged")
    return m.withColumns({c: joined(c) for c in ("requires", "gate", "merged_ids")})


def agg_merge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of merged operations: two pieces an operation, in the order of the operations."""
    piece = lambda source, loc: F.struct(F.lit(source).alias("source"), loc.cast("string").alias("loc"))
    rows = fusion.drop_plumbing(ops(spark, sf)).withColumn("evidence", F.array(piece("traced", F.col("ord")), piece("declared", F.col("n"))))
    return fusion.merged_evidence(rows, ["day"]).withColumn("place", F.col("place").cast("long"))


def topk_class_cap(spark: SparkSession, sf: str) -> DataFrame:
    cls = pick(("library", "cli-tool", "service-app", "agent-system"), F.dayofmonth(F.to_date("day")) % 4 + 1)
    return fusion.cap_by_class(ops(spark, sf).withColumn("cls", cls), ["day"], "cls").select("day", "id", F.col("place").cast("long").alias("place"))


def sort_attention(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("day").orderBy(*fusion.attention_order()))
    return ops(spark, sf).select("day", "id", place.cast("long").alias("place"))


def effect_of_event() -> F.Column:
    table = F.create_map(*[F.lit(x) for k, v in zip(TYPES, (*fusion.EFFECTS, "read-local"), strict=True) for x in (k, v)])
    return table[F.col("event_type")]


def agg_dominant_effect(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").where("event_type <> 'signup' or user_id % 2 = 0").withColumn("effect", effect_of_event())
    return rows.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(fusion.dominant_effect("effect", "event_id").alias("effect"))


def agg_first_opid(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.first_by(read(spark, sf, "events").select("user_id", "event_type", "event_id", "props"), ["user_id", "event_type"], ["event_id"])


def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    source = F.create_map(*[F.lit(x) for k, v in zip(TYPES, ("inferred", "documented", "proposed", "declared", "traced"), strict=True) for x in (k, v)])[F.col("event_type")]
    return read(spark, sf, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("id"), source.alias("source"), F.date_format("ts", "HH").alias("loc"), "event_type", F.col("event_id").alias("ord")).withColumnRenamed("event_type", "detail")


def agg_evidence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    e = fusion.distinct_evidence(evidence_rows(spark, sf), ["id"])
    return e.select("id", F.concat_ws(",", F.transform("evidence", lambda x: F.concat_ws(":", x["source"], x["loc"], x["detail"]))).alias("evidence"))


def fn_confidence_fuse(spark: SparkSession, sf: str) -> DataFrame:
    rows = evidence_rows(spark, sf).groupBy("id").agg(F.collect_set("source").alias("sources"), F.count_distinct("loc").alias("places"), F.min("ord").alias("ord"))
    c = fusion.fuse_confidence(F.col("sources"), F.col("places"), F.col("ord") % 5 == 0, F.col("ord") % 7 == 0, F.col("ord") % 11 == 0)
    return rows.select("id", c.alias("confidence"))


def jn_interval_innermost(spark: SparkSession, sf: str) -> DataFrame:
    """Error events of a user in the narrowest stretch between first and last event of one type that holds them."""
    events = read(spark, sf, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"))
    ranges = events.where("event_type <> 'error'").groupBy("user_id", "month", "event_type").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    sites = events.where("event_type = 'error'").select("user_id", "month", "event_id")
    return attribution.claim_innermost(sites, ranges, ["user_id", "month"], "event_id", "lo", "hi", "event_id", "event_type").select("event_id", "event_type", "lo", "hi")


def jn_leftover(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM").alias("month"))
    ranges = events.where("event_type = 'purchase'").groupBy("user_id", "month").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    sites = events.where("event_type = 'error'").select("user_id", "month", "event_id")
    rangeless = events.where("event_type = 'signup'").select("user_id", "month", F.col("event_id").alias("owner"))
    return attribution.claim_leftovers(sites, ranges, rangeless, ["user_id", "month"], "event_id", "lo", "hi", "owner").select("event_id", F.when(F.col("weak"), F.col("owner")).alias("owner"), "weak")


def jn_enclosing_service(spark: SparkSession, sf: str) -> DataFrame:
    rows = attribution.as_of(read(spark, sf, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")))
    return rows.where("role <> 'user'").select("conv_id", "turn", "as_of")


def jn_class_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = attribution.as_of(read(spark, sf, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), strict=True)
    return rows.where("event_type = 'click'").select("event_id", "as_of")


def jn_play_name(spark: SparkSession, sf: str) -> DataFrame:
    """The signup before a purchase, unless anything but views came in between."""
    named = F.when(F.col("event_type") != "view", F.struct("event_type", "event_id"))
    rows = attribution.as_of(read(spark, sf, "events"), ["user_id"], "event_id", named, strict=True)
    return rows.where("event_type = 'purchase'").select("event_id", F.when(F.col("as_of.event_type") == "signup", F.col("as_of.event_id")).alias("name_id"))


def jn_catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by (type, lower brand) in a catalogue, after the ignored brands are out; unknown ones keep a null provider."""
    known = [("ECONOMY", "brand#1", "acme"), ("SMALL", "brand#2", "beta"), ("PROMO", "brand#11", "acme"), ("LARGE", "brand#25", "core")]
    index = one_row(spark, [F.struct(F.lit(a).alias("p_type"), F.lit(b).alias("name"), F.lit(c).alias("provider")) for a, b, c in known])
    ignored = one_row(spark, [F.struct(F.lit(f"brand#{i}").alias("name")) for i in (3, 7, 9)])
    parts = read(spark, sf, "part").withColumn("name", F.lower("p_brand")).join(F.broadcast(ignored), "name", "left_anti")
    return parts.join(F.broadcast(index), ["p_type", "name"], "left").select("p_partkey", "provider")


def src_caps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source in order as long as their running size stays under a cap; the first that crosses it ends the walk."""
    rows = fusion.running_total(read(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars")
    return rows.where("running <= 200000").select("source", "doc_id", "running")


def prd_expiry(spark: SparkSession, sf: str) -> DataFrame:
    old = F.to_date("o_orderdate") < F.lit("1997-01-01").cast("date")
    return read(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count_if(old).alias("expired"), F.count("*").alias("n"))


def lim_locations(spark: SparkSession, sf: str) -> DataFrame:
    """First five events of a user and type, and how many more."""
    return fusion.first_places(read(spark, sf, "events"), ["user_id", "event_type"], "event_id", 5)


def op_validate_inventory_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields around the operations, wrong by the user's number."""
    r = F.col("user_id") % 7
    rows = read(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("u"), "user_id").alias("repo"), F.when(r == 1, "other").when(r == 2, None).otherwise("library").alias("repo_class"), F.when(r == 3, "open").otherwise("draft").alias("inventory_status"), F.when(r != 4, "1").alias("schema_version"),
    )
    return checks.validate_inventories(rows)


def op_validate_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken by operations damaged on purpose, by the user's number."""
    r = F.col("user_id") % 8
    rows = ops(spark, sf).withColumn("id", F.when(r == 1, F.col("id")).otherwise(F.translate("id", "/", "-"))).withColumn("stage", F.when(r == 2, "later").when(r == 3, None).otherwise(F.col("stage")))
    rows = rows.withColumn("requires", F.when(r == 4, strings([])).otherwise(F.col("requires"))).withColumn("gate", F.when(r == 5, strings(["other"])).otherwise(F.col("gate")))
    return checks.validate_operations(rows.unionByName(rows.where("user_id % 8 = 6")), ["day"])


def op_validate_package(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("-", F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")), F.col("doc_id"))
    return checks.validate_package(read(spark, sf, "documents").select(name.alias("name"), "text"), "name", "text")


def snk_report_json(spark: SparkSession, sf: str) -> DataFrame:
    return checks.report_json(routing.binding_counts(resolved(spark, sf), ("profile", "day")).drop("coverage"), ["profile", "day"])


def snk_report_text(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("profile", "id", checks.report_line().alias("line"))


def snk_review_md(spark: SparkSession, sf: str) -> DataFrame:
    return ops(spark, sf).select("id", checks.review_line().alias("line"))


QUERIES = {f.__name__: f for f in (
    op_validate_inventory, op_validate_inventory_fields, op_validate_package, snk_report_json, snk_report_text, snk_review_md,
    op_route, op_gates, op_resolve, op_summarise, agg_outcomes, agg_binding_hist, op_invariants, op_questions, prd_deterministic, jn_standin_default, jn_provider_caps, jn_diff, jn_merge_reviewed,
    jn_apply_proposals, snk_digest, agg_merge_ops, agg_merge_evidence, topk_class_cap, sort_attention, agg_dominant_effect, agg_first_opid, agg_evidence_dedupe, fn_confidence_fuse, jn_interval_innermost, jn_leftover,
    jn_enclosing_service, jn_class_context, jn_play_name, jn_catalog_lookup, src_caps, prd_expiry, lim_locations,
)}

"""Queries of fallback operations, choices, validators of catalogues and entry points, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import checks, fallback, fusion, inventory, selection
from tidemark.plans import extract_queries as X
from tidemark.plans.inventory_queries import TYPES, joined, one_row, ops, pick, strings, versions
from tidemark.plans.inventory_sql import BOTH, lst
from tidemark.plans.inventory_sql import ops as ops_sql
from tidemark.sources.catalogues import SHIPPED
from tidemark.sources.entrypoints import entrypoints
from tidemark.sources.tables import read

PACKAGES = ("stripe", "boto3", "celery", "redis", "left-pad", "openai", "own-tools")
CLASSES = ("library", "cli-tool", "service-app", "agent-system")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Events as call sites: a repository a user, a file a month, a line an event."""
    return read(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("repo"), F.concat(F.date_format("ts", "yyyy-MM"), F.lit(".py")).alias("rel"), F.col("event_id").alias("line"),
        F.col("event_type").alias("capability"), pick(fusion.EFFECTS, F.col("event_id") % 4 + 1).alias("effect"), "user_id",
    )


def deps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as dependencies: a repository a customer, a package by the order's key."""
    name = pick(PACKAGES, F.col("o_orderkey") % len(PACKAGES) + 1)
    name = F.when(name == "own-tools", F.concat_ws("-", name, F.col("o_orderkey"))).otherwise(name)
    return read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.lit("pypi").alias("ecosystem"), name.alias("name")).distinct()


def agg_sites_by_file_cap(spark: SparkSession, sf: str) -> DataFrame:
    return fallback.from_sites(sites(spark, sf)).select("repo", "id", "effect", joined("requires").alias("requires"), "loc", "summary")


def op_from_providers(spark: SparkSession, sf: str) -> DataFrame:
    rows = fallback.from_providers(inventory.match_providers(deps(spark, sf))[0])
    return rows.select("repo", "id", joined("requires").alias("requires"), joined("gate").alias("gate"), "confidence", "summary")


def op_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    rows = fallback.unresolved(inventory.match_providers(deps(spark, sf))[1])
    return rows.select("repo", "id", "optional", "summary", joined("evidence").alias("evidence"))


def op_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Users with a signup declare; the others have sites unless all they did was view; customers have dependencies alone."""
    rows = sites(spark, sf)
    declared = fallback.from_sites(rows.where("capability = 'signup'"))
    used = fallback.from_providers(inventory.match_providers(deps(spark, sf))[0])
    both = fallback.ladder(declared, fallback.from_sites(rows.where("capability <> 'view'")), used.unionByName(used.withColumn("repo", F.regexp_replace("repo", "^c", "u"))))
    return both.select("repo", "id", "way")


def op_catalog_lint(spark: SparkSession, sf: str) -> DataFrame:
    return selection.catalogue_gaps(*inventory.match_providers(deps(spark, sf)), ["repo"])


def jn_selected_ops(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf)
    wanted = rows.where("ord % 5 = 0").select(F.when(F.col("ord") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("x"))).alias("id"))
    chosen, unknown = selection.selected(rows, wanted, ["id"])
    return chosen.select("id", F.lit("selected").alias("status")).unionByName(unknown.select("id", F.lit("unknown").alias("status")))


def win_pipeline_no(spark: SparkSession, sf: str) -> DataFrame:
    return selection.numbered(ops(spark, sf), ["day"]).select("day", "id", F.col("number").cast("long").alias("number"))


def lim_docs(spark: SparkSession, sf: str) -> DataFrame:
    return selection.first_files(read(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 40).select("source", "doc_id")


def lim_trace_files(spark: SparkSession, sf: str) -> DataFrame:
    """The first 200 documents of a language; those whose length is a multiple of seven stand for entry points."""
    rows = read(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return selection.first_files(rows, ["lang"], "doc_id", 200, F.col("n_chars") % 7 == 0).select("lang", "doc_id", F.col("place").cast("long").alias("place"))


def set_added_removed(spark: SparkSession, sf: str) -> DataFrame:
    return selection.membership(*versions(spark, sf), ["id"])


def agg_credentials(spark: SparkSession, sf: str) -> DataFrame:
    kind = pick(("apikey", "oauth", "token"), F.col("event_id") % 3 + 1)
    rows = read(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), kind.alias("kind"), F.concat(F.lit("E"), "event_id").alias("env"), F.col("event_id").alias("ord"))
    out = selection.credentials(rows, ["user_id"])
    return out.select("user_id", F.concat_ws(",", F.transform("credentials", lambda c: F.concat_ws(":", c["name"], c["kind"], c["env"]))).alias("credentials"))


def op_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf).withColumn("cls", pick(CLASSES, F.dayofmonth(F.to_date("day")) % 4 + 1))
    rows = rows.withColumn("requires", F.when(F.col("n") % 7 == 0, strings([])).otherwise(F.col("requires"))).withColumn("gate", F.when(F.col("n") % 7 == 0, strings([])).otherwise(F.col("gate")))
    return selection.coalesced(rows, ["day"], "cls")[1]


def op_standins(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = one_row(spark, [F.struct(F.lit(s).alias("stand_in"), F.lit(script).cast("string").alias("script"), strings(t).alias("tools")) for s, script, t in (("card", "card.py", ("python", "ffmpeg")), ("ledger", "ledger.py", ("python",)))])
    rows = selection.standin_status(ops(spark, sf), catalogue, one_row(spark, [F.struct(F.lit("python").alias("tool"))]))
    return rows.select("id", "status", joined("lacks").alias("lacks"))


def op_validate_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Users as profiles: event types of even events are native, of odd ones offered through a service."""
    even = F.col("event_id") % 2 == 0
    rows = read(spark, sf, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("profile")).agg(F.collect_set(F.when(even, F.col("event_type"))).alias("native"), F.collect_set(F.when(~even, F.col("event_type"))).alias("mcp"), F.max(F.date_format("ts", "yyyy-MM-dd")).alias("expiry"), F.count("*").alias("n"))
    known = one_row(spark, [F.struct(F.lit(t).alias("capability")) for t in TYPES if t != "error"])
    return checks.validate_profiles(rows.unionByName(rows.where("n % 5 = 0")), known, F.lit("2024-01-25").cast("date"))


def op_validate_standins(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("stand_in"), (F.col("p_size") / 40).alias("fidelity"), pick(("reducing", "deferred", "no-op", "other"), F.col("p_partkey") % 4 + 1).alias("type"))
    return checks.validate_standins(rows)


def op_suitability(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count_if(F.col("n_chars") > 20000).alias("n_ops"), F.count_if(F.col("doc_id") % 2 == 0).alias("n_documents"), F.count_if(F.col("doc_id") % 2 == 1).alias("n_code"))
    return rows.select("source", "lang", selection.suitability(F.col("n_ops"), F.col("n_documents"), F.col("n_code")).alias("status"))


def fn_timeout(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.get_json_object("props", "$.k"), F.lit("0"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("-"), F.get_json_object("props", "$.k"))).otherwise(F.col("event_type"))
    return read(spark, sf, "events").select("event_id", selection.timeout(value).cast("long").alias("seconds"))


def fn_join_path(spark: SparkSession, sf: str) -> DataFrame:
    """An address with a path behind it, and a name in camel case taken apart."""
    camel = F.regexp_replace(F.initcap(F.col("p_type")), " ", "")
    base = F.concat(F.lit("/api/"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "/").otherwise(""))
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/"), "p_name")).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", T.join_path(base, path).alias("route"), T.split_camel(F.concat(camel, F.initcap(F.substring_index("p_name", " ", 1)))).alias("title"))


def op_entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    """Console scripts, binaries, npm scripts, make targets and main files of folders made of parts."""
    name = X.named()
    makes = X.files(spark, sf, "Makefile", F.concat(name, F.lit(": deps")))
    tomls = X.files(spark, sf, "pyproject.toml", F.concat(name, F.lit(' = "m'), F.col("p_partkey"), F.lit('.sub:run"')), "[project]\nname = \"x\"\n[project.scripts]\n", "\n[tool.other]\nz = \"q:r\"")
    bins = X.files(spark, sf, "package.json", F.concat(F.lit('"'), name, F.lit('": "./b'), F.col("p_partkey"), F.lit('.js"')), '{"scripts": {"start": "x", "lint": "y"}, "bin": {', "}}", ", ")
    mains = X.files(spark, sf, "main.py", name)
    return entrypoints(makes.unionByName(tomls).unionByName(bins).unionByName(mains))


QUERIES = {f.__name__: f for f in (
    agg_sites_by_file_cap, op_from_providers, op_unresolved, op_ladder, op_catalog_lint, jn_selected_ops, win_pipeline_no, lim_docs, lim_trace_files, set_added_removed, agg_credentials, op_coalesce, op_standins,
    op_validate_profile, op_validate_standins, op_suitability, fn_timeout, fn_join_path, op_entrypoints,
)}

SITES = "sites AS (SELECT 'u' || user_id AS repo, strftime(ts, '%Y-%m') AS stem, event_id, event_type AS cap, event_id % 4 + 1 AS rank FROM events)"
DEPS = f"deps AS (SELECT DISTINCT 'c' || o_custkey AS repo, CASE o_orderkey % 7 WHEN 6 THEN 'own-tools-' || o_orderkey ELSE {lst(PACKAGES)}[o_orderkey % 7 + 1] END AS name FROM orders)"
CATALOGUE = "cat(name, provider, caps, gates, ambiguous) AS (VALUES " + ", ".join(f"('{x[5:]}', '{p}', {lst(sorted(set(c.split())))}, '{','.join(sorted(set(g.split())))}', {a})" for p, n, c, g, _, a in SHIPPED for x in n.split() if x.startswith("pypi:")) + ")"
USES = f"{DEPS}, {CATALOGUE}, uses AS (SELECT repo, 'use-' || provider AS id, caps, gates, ambiguous, name FROM deps JOIN cat USING (name))"
SQL = {
    "agg_sites_by_file_cap": f"WITH {SITES} SELECT repo, cap || '-' || stem AS id, {lst(fusion.EFFECTS)}[max(rank)] AS effect, cap AS requires, stem || '.py:' || min(event_id) AS loc, 'derived from ' || count(*) || ' traced effect sites' AS summary FROM sites GROUP BY repo, stem, cap",
    "op_from_providers": f"WITH {USES} SELECT repo, id, array_to_string(caps, ',') AS requires, gates AS gate, CASE WHEN ambiguous THEN 'low' ELSE 'medium' END AS confidence, 'dependency ' || name || ' (pypi)' AS summary FROM uses",
    "op_unresolved": f"WITH {DEPS}, {CATALOGUE}, u AS (SELECT repo, name, row_number() OVER (PARTITION BY repo ORDER BY name) AS place FROM deps ANTI JOIN cat USING (name)) SELECT repo, 'unresolved-external-calls' AS id, true AS optional, count(*) || ' dependencies outside the catalogue' AS summary, string_agg('pypi:' || name, ',' ORDER BY place) FILTER (place <= 20) AS evidence FROM u GROUP BY repo",
    "op_ladder": f"""WITH {SITES}, {USES}, a AS (SELECT DISTINCT repo, cap || '-' || stem AS id FROM sites WHERE cap = 'signup'), b AS (SELECT DISTINCT repo, cap || '-' || stem AS id FROM sites WHERE cap <> 'view'), c AS (SELECT repo, id FROM uses UNION ALL SELECT 'u' || repo[2:], id FROM uses)
SELECT repo, id, 'declared' AS way FROM a UNION ALL SELECT repo, id, 'sites' FROM b WHERE repo NOT IN (SELECT repo FROM a) UNION ALL SELECT repo, id, 'providers' FROM c WHERE repo NOT IN (SELECT repo FROM a UNION ALL SELECT repo FROM b)""",
    "op_catalog_lint": f"WITH {DEPS}, {CATALOGUE} SELECT repo, count(*) FILTER (cat.name IS NOT NULL) AS matched, count(*) FILTER (cat.name IS NULL) AS unknown FROM deps LEFT JOIN cat USING (name) GROUP BY repo",
    "jn_selected_ops": f"WITH {ops_sql()} SELECT id, 'selected' AS status FROM ops WHERE ord % 10 = 0 UNION ALL SELECT id || 'x', 'unknown' FROM ops WHERE ord % 10 = 5",
    "win_pipeline_no": f"WITH {ops_sql()} SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY stage, id) AS number FROM ops",
    "lim_docs": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 40",
    "lim_trace_files": "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 7 <> 0, doc_id) AS place FROM documents QUALIFY place <= 200",
    "set_added_removed": f"WITH {BOTH} SELECT id, CASE WHEN o.day IS NULL THEN 'added' WHEN n.day IS NULL THEN 'removed' ELSE 'both' END AS status FROM old o FULL JOIN new n USING (id)",
    "agg_credentials": "WITH c AS (SELECT user_id, event_type AS name, ['apikey', 'oauth', 'token'][event_id % 3 + 1] AS kind, min(event_id) AS ord FROM events GROUP BY ALL) SELECT user_id, string_agg(name || ':' || kind || ':E' || ord, ',' ORDER BY ord) AS credentials FROM c GROUP BY user_id",
    "op_coalesce": f"""WITH {ops_sql()}, x AS (SELECT day, stage, effect, optional, {lst(CLASSES)}[CAST(day[9:10] AS INT) % 4 + 1] AS cls, CASE WHEN n % 7 = 0 THEN '' ELSE array_to_string(requires, ',') END AS r, CASE WHEN n % 7 = 0 THEN '' ELSE array_to_string(gate, ',') END AS g FROM ops),
m AS (SELECT DISTINCT day, cls, stage, effect, optional, r, g FROM x), c AS (SELECT day, cls, count(*) AS n_merged, count(*) FILTER (r <> '' OR g <> '') AS n_needed FROM m GROUP BY ALL),
k AS (SELECT day, n_merged, n_needed, least(n_needed, CASE cls WHEN 'library' THEN 25 WHEN 'cli-tool' THEN 60 WHEN 'service-app' THEN 80 ELSE 40 END) AS n_kept FROM c)
SELECT day, t.n - n_merged AS duplicates, n_merged - n_needed AS plumbing, n_needed - n_kept AS over_limit, n_kept FROM k JOIN (SELECT day, count(*) AS n FROM x GROUP BY day) t USING (day)""",
    "op_standins": f"WITH {ops_sql()} SELECT id, CASE stand_in WHEN 'card' THEN 'blocked' WHEN 'ledger' THEN 'runnable' ELSE 'not-runnable' END AS status, CASE stand_in WHEN 'card' THEN 'ffmpeg' ELSE '' END AS lacks FROM ops",
    "op_validate_profile": """WITH p AS (SELECT 'u' || user_id AS profile, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 0), []) AS native, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []) AS mcp, CAST(max(ts) AS DATE) AS expiry, count(*) AS n FROM events GROUP BY user_id),
q AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE n % 5 = 0) SELECT profile, 'both-channels' AS rule FROM q WHERE list_has_any(native, mcp) UNION ALL SELECT profile, 'expired' FROM q WHERE expiry < DATE '2024-01-25'
UNION ALL SELECT profile, 'unknown-capability' FROM p WHERE list_contains(list_concat(native, mcp), 'error') UNION ALL SELECT profile, 'duplicate-id' FROM p WHERE n % 5 = 0""",
    "op_validate_standins": "SELECT p_partkey AS stand_in, 'fidelity' AS rule FROM part WHERE p_size >= 40 OR p_size < 0 UNION ALL SELECT p_partkey, 'type' FROM part WHERE p_partkey % 4 = 3",
    "op_suitability": "SELECT source, lang, CASE WHEN count(*) FILTER (n_chars > 20000) > 0 THEN 'suitable' WHEN count(*) FILTER (doc_id % 2 = 0) >= 3 OR count(*) FILTER (doc_id % 2 = 1) >= 10 THEN 'knowledge-only' ELSE 'not-suitable' END AS status FROM documents GROUP BY source, lang",
    "fn_timeout": "WITH k AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 10 * CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS n FROM events) SELECT event_id, least(CASE WHEN n > 0 THEN n ELSE 120 END, 900) AS seconds FROM k",
    "fn_join_path": r"""WITH w AS (SELECT p_partkey, p_brand, p_name, list_transform(list_concat(string_split(p_type, ' '), [string_split(p_name, ' ')[1]]), lambda x: upper(x[1]) || lower(x[2:])) AS t FROM part)
SELECT p_partkey, '/api/' || p_brand || '/' || p_name AS route, regexp_replace(array_to_string(t, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g') AS title FROM w""",
    "op_entrypoints": f"""WITH d AS (SELECT DISTINCT p_brand AS repo, 'd' || (p_partkey // 50) AS d FROM part)
SELECT p_brand AS repo, 'make-target' AS kind, 'd' || (p_partkey // 50) || '/Makefile#' || {X.N} AS loc, {X.N} AS name, 'declared' AS source FROM part UNION ALL
SELECT p_brand, 'console-script', 'm' || p_partkey || '.py', {X.N}, 'declared' FROM part UNION ALL SELECT p_brand, 'cli', './b' || p_partkey || '.js', {X.N}, 'declared' FROM part UNION ALL
SELECT DISTINCT repo, 'script', 'package.json#scripts.start', 'start', 'declared' FROM d UNION ALL SELECT repo, 'script', d || '/main.py', NULL, 'convention' FROM d""",
}

"""Queries of repository profiles, catalogue readers, validators, reports and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dialects as D
from tidemark.functions import text as T
from tidemark.operators import checks, profile, routing, selection
from tidemark.plans.extract_queries import named
from tidemark.plans.inventory_queries import joined, one_row, ops, pick, resolved, strings, vocabulary
from tidemark.plans.inventory_sql import RES
from tidemark.plans.inventory_sql import ops as ops_sql
from tidemark.sources import catalogues
from tidemark.sources.tables import new_path, read

PATHS = ("a.py", "b.rs", "readme.md", "package.json", "c.kt", "Makefile")
PACKAGES = ("langchain", "flask", "click", "terraform")


def repo_files(spark: SparkSession, sf: str) -> DataFrame:
    """A repository a customer, a file an order."""
    return read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.concat(F.lit("d"), "o_orderkey", F.lit("/"), pick(PATHS, F.col("o_orderkey") % 6 + 1)).alias("rel"))


def repo_deps(spark: SparkSession, sf: str) -> DataFrame:
    name = F.coalesce(F.when(F.col("o_orderkey") % 40 < 4, pick(PACKAGES, F.least(F.col("o_orderkey") % 40, F.lit(3)) + 1)), F.lit("zz"))
    return read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.lit("pypi").alias("ecosystem"), name.alias("name"))


def op_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Class of each customer's repository by its packages, entry points, code files and manifests."""
    k = F.col("o_orderkey") % 30
    kind = F.when(k == 4, "server").when(k == 5, "console-script").otherwise("script")
    entries = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), kind.alias("kind"), F.concat(F.lit("l"), "o_orderkey").alias("loc"), F.concat(F.lit("n"), "o_orderkey").alias("name"), F.when(k == 5, "declared").otherwise("convention").alias("source"))
    rows = profile.classify(repo_files(spark, sf), repo_deps(spark, sf), entries)
    return rows.withColumn("signals", joined("signals"))


def agg_tracing(spark: SparkSession, sf: str) -> DataFrame:
    files = repo_files(spark, sf)
    return profile.tracing(files, files.where("rel like '%.py'").select("repo")).withColumn("languages", joined("languages"))


def agg_sources_run(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("repo"), F.col("o_orderkey").alias("k"))
    out = profile.sources_run(rows, T0=rows.where("k % 7 = 0"), T1=rows.where("k % 11 = 0"), T2=rows.where("k % 3 = 0"), T3=rows.where("k % 50 = 0"))
    return out.withColumn("sources", joined("sources"))


def skill_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A skill file for each part, some of them faulty."""
    head = F.when(F.col("p_size") % 7 == 0, "").otherwise("---\n")
    close = F.when(F.col("p_size") % 11 == 0, "").otherwise("---\n")
    deep = F.when(F.col("p_size") % 5 == 0, "license: MIT\n  odd: x\n").otherwise("")
    front = F.concat(F.lit("name: "), named(), F.lit("\n# note\ndescription: 'A "), "p_name", F.lit("'\nmetadata:\n  size: "), F.col("p_size"), F.lit("\n"), deep, F.when(F.col("p_size") % 6 == 0, "nothing here\n").otherwise(""))
    return read(spark, sf, "part").select(named().alias("package"), F.col("p_size"), F.concat(head, front, close, F.lit("profile text, native\n")).alias("text"))


def src_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    entries, faults = catalogues.front_matter(skill_texts(spark, sf), "package")
    out = entries.select("package", F.col("line").cast("long").alias("line"), F.concat_ws("/", "parent", "name").alias("name"), "value")
    return out.unionByName(faults.select("package", F.col("line").cast("long").alias("line"), F.lit("fault").alias("name"), F.col("fault").alias("value")))


def op_validate_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken by packages: faulty front matter, other folder names, deep references, odd entries, no skill file."""
    rows = skill_texts(spark, sf)
    package = F.when(F.col("p_size") % 8 == 0, F.concat("package", F.lit("-x"))).otherwise(F.col("package"))
    main = rows.where("p_size % 13 <> 0").select(package.alias("package"), F.lit("SKILL.md").alias("rel"), "text")
    odd = F.when(F.col("p_size") % 3 == 0, "references/a/b.md").when(F.col("p_size") % 3 == 1, "notes.txt").otherwise("references/a.md")
    return checks.validate_packages(main.unionByName(rows.select(package.alias("package"), odd.alias("rel"), F.lit("x").alias("text"))))


def op_validate_declaration(spark: SparkSession, sf: str) -> DataFrame:
    return checks.validate_declaration(read(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 > 0, "Profile X. ").otherwise(""), F.when(F.col("doc_id") % 2 > 0, "MCP.").otherwise(""), F.lit(" ."), "lang").alias("body")), "doc_id", "body")


def json_folder(spark: SparkSession, sf: str) -> str:
    """Profiles of suppliers as JSON files: a list of some of them in each."""
    rows = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("k"), F.concat(F.lit("s-"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), strings(["file.read"]).alias("native"), F.when(F.col("s_nationkey") % 2 == 0, strings(["http.request"])).otherwise(strings([])).alias("mcp"),
        F.lit(None).cast("string").alias("probe"), F.when(F.col("s_nationkey") % 3 == 0, "2020-01-01").alias("expiry"),
    )
    path = new_path(spark, "profiles")
    lists = rows.groupBy((F.col("k") % 16).alias("part")).agg(F.to_json(F.collect_list(F.struct("id", "name", "native", "mcp", "probe", "expiry"))).alias("value"))
    lists.repartition("part").write.partitionBy("part").text(path)
    return path


def src_profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalogues.load_profiles(spark, json_folder(spark, sf))
    return rows.select("id", "name", joined("native").alias("native"), joined("mcp").alias("mcp"), "expiry")


def src_json(spark: SparkSession, sf: str) -> DataFrame:
    return catalogues.load_json(spark, json_folder(spark, sf), "id string, expiry string").groupBy("expiry").agg(F.count("*").alias("n"))


def src_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals of events' JSON: documents, lists, ones without an id, and text that is no JSON."""
    one = F.concat(F.lit('{"op_id": "'), F.when(F.col("event_id") % 5 == 1, "").otherwise(F.col("event_type")), F.lit('", "requires": ["a.b"], "rationale": "'), F.repeat(F.lit("why "), F.when(F.col("event_id") % 4 == 0, 80).otherwise(1)), F.lit('"}'))
    doc = F.when(F.col("event_id") % 5 == 2, F.concat(F.lit("["), one, F.lit("]"))).when(F.col("event_id") % 5 == 3, "{oops").when(F.col("event_id") % 5 == 4, '{"other": 1}').otherwise(F.concat(F.lit('{"proposals": ['), one, F.lit("]}")))
    good, bad = catalogues.proposals(read(spark, sf, "events").select("event_id", doc.alias("text")))
    told = good.select("event_id", "op_id", joined("requires").alias("requires"), F.length("rationale").cast("long").alias("length"), F.lit("").alias("problem"))
    return told.unionByName(bad.select("event_id", F.lit("").alias("op_id"), F.lit("").alias("requires"), F.lit(0).cast("long").alias("length"), "problem"))


def fn_wrap(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name", F.lit("averylongwordwithoutend"), "p_type")
    return read(spark, sf, "part").select("p_partkey", F.array_join(T.wrap(text, 16), "|").alias("lines"))


def fn_srt_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", T.srt_seconds(F.col("p_partkey") * 3.5 + F.col("p_size") / 2000).alias("stamp"))


VALUES = ('"text"', "12", "1.5", "true", "null", "{oops")
KINDS = ("string", "number", "integer", "other")


def fn_coerce(spark: SparkSession, sf: str) -> DataFrame:
    value, kind = pick(VALUES, F.col("event_id") % 6 + 1), pick(KINDS, F.floor(F.col("event_id") / 6) % 4 + 1)
    return read(spark, sf, "events").select("event_id", T.coerced(value, kind).alias("value"))


def lim_output(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.md5(T.clip(F.concat(F.lit("token = abcdefgh12345 "), "html"), 300)).alias("clipped_md5"))


def fn_mask_note(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select("p_partkey", T.with_note(F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(""), F.lit("check it")).alias("notes"))


def fn_top_scalar(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of YAML-like texts, and whether they have one."""
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "  kind: no\n").when(F.col("p_size") % 3 == 1, F.concat(F.lit("'kind' : \""), "p_name", F.lit('"\nkind: two\n'))).otherwise("kind: # none\n"), F.lit("name: x\n"))
    rows = read(spark, sf, "part").select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", D.top_scalar(F.col("text"), "kind").alias("kind"), D.has_top_key(F.col("text"), "kind").alias("has_kind"))


def sort_final_id(spark: SparkSession, sf: str) -> DataFrame:
    return selection.by_id(ops(spark, sf), ["day"]).select("day", "id", F.col("place").cast("long").alias("place"))


def agg_eval_layers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select(F.concat_ws("-", "event_type", F.col("user_id") % 50).alias("layer"), F.when(F.col("event_id") % 31 == 0, "fail").when(F.col("event_id") % 3 == 0, "skip").otherwise("pass").alias("status"))
    return checks.eval_layers(rows)


def op_validate_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken by providers made of parts, a different one for each remainder of the size."""
    s = F.col("p_size") % 9
    cred = F.array(F.struct(F.when(s == 5, "").otherwise("KEY").alias("name"), F.when(s == 6, "magic").otherwise("apikey").alias("kind")))
    packages = F.when(s == 1, F.create_map().cast("map<string,array<string>>")).when(s == 2, F.create_map(F.lit("pypi"), strings([]))).otherwise(F.create_map(F.lit("pypi"), F.array(named())))
    rows = read(spark, sf, "part").select(
        F.when(s == 0, "").otherwise(named()).alias("provider"), packages.alias("packages"), F.array(F.when(s == 8, "no.such").otherwise("file.read")).alias("caps"), F.when(s == 3, "strange").when(F.col("p_partkey") % 2 == 0, "read-local").alias("effect"),
        F.array(F.when(s == 4, "fun").otherwise("spend")).alias("gates"), cred.alias("credentials"), (s == 7).alias("ambiguous"), F.lit("").alias("note"),
    )
    return checks.validate_catalogue(rows, one_row(spark, [F.struct(F.lit("file.read").alias("capability"))])).groupBy("provider", "rule").agg(F.count("*").alias("n"))


def op_validate_exec(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size") % 8
    inputs = F.array(F.struct(F.lit("x").alias("name"), F.when(s == 4, "date").otherwise("integer").alias("type"), F.when(s == 5, "true").when(s == 6, "1.5").when(s == 7, "7").cast("string").alias("default")))
    rows = read(spark, sf, "part").select(
        named().alias("stand_in"), F.when(s.isin(0, 1), "").otherwise(F.concat(F.lit("run"), F.col("p_partkey") % 3, F.lit(".py"))).alias("script"), F.when(s.isin(1, 2), "no tool").alias("unavailable"),
        F.array(F.when(s == 3, " ").otherwise("python")).alias("tools"), inputs.alias("inputs"),
    )
    return checks.validate_execution(rows, one_row(spark, [F.struct(F.lit(f"run{i}.py").alias("script")) for i in (0, 1)]))


def op_validate_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The rules on evidence, gate confidence, trigger, vocabulary and stand-ins of operations damaged on purpose."""
    r, none = F.col("user_id") % 9, F.lit(None).cast("string")
    proof = F.array(F.struct(F.when(r == 1, "guess").otherwise("traced").alias("source"), F.when(r == 2, "").otherwise("a:1").alias("loc"), F.lit("x").alias("detail")))
    rows = ops(spark, sf).withColumn("id", F.translate("id", "/", "-")).withColumn("evidence", F.when(r == 3, F.slice(proof, 1, 0)).otherwise(proof))
    rows = rows.withColumn("gate_confidence", F.when(r == 4, none).when(r == 5, "sure").otherwise("low")).withColumn("trigger", F.when(r == 6, "never").when(r == 7, none).otherwise("manual"))
    cards = one_row(spark, [F.struct(F.lit("card").alias("stand_in"))])
    return checks.validate_operations(rows, ["day"], vocabulary(spark).where("capability <> 'view'"), cards)


def set_unknown_ids(spark: SparkSession, sf: str) -> DataFrame:
    """What users as profiles offer beyond the vocabulary."""
    even = F.col("event_id") % 2 == 0
    rows = read(spark, sf, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("profile")).agg(F.collect_set(F.when(even, F.col("event_type"))).alias("native"), F.collect_set(F.when(~even, F.col("event_type"))).alias("mcp"))
    return routing.unknown_capabilities(rows, vocabulary(spark).where("capability not in ('error', 'view')"))


def prd_needs_attention(spark: SparkSession, sf: str) -> DataFrame:
    rows = ops(spark, sf).withColumn("requires", F.when(F.col("n") % 3 == 0, strings(["external.call"])).otherwise(F.col("requires")))
    return rows.select("id", checks.needs_attention().alias("needs_attention"))


def snk_review_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with all their sections: a scope a day."""
    rows = ops(spark, sf).withColumn("evidence", F.array(F.struct(F.lit("traced").alias("source")), F.struct(F.lit("declared").alias("source")))).withColumn("notes", F.col("summary"))
    n = F.dayofmonth(F.to_date("day"))
    days = rows.select("day").distinct()
    meta = days.select("day", F.when(n % 2 == 0, F.concat(F.lit("u/"), "day")).alias("url"), F.when(n % 3 == 0, "v1").alias("sha"), F.lit("draft").alias("status"), F.lit("library").alias("repo_class"))
    warned = days.where(n % 5 == 0).select("day", F.lit(1).alias("ord"), F.lit("stopped at a cap").alias("warning"))
    unknown = rows.where("n % 4 = 0").select("day", F.col("user_id").alias("name"))
    return checks.review_lines(rows, ["day"], meta, warned, unknown).select("day", "section", F.col("place").cast("long").alias("place"), "line")


def snk_report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return checks.summary_lines(routing.summarise(resolved(spark, sf), ("profile", "day")), ["profile", "day"]).select("profile", "day", F.col("place").cast("long").alias("place"), "line")


def snk_report_notes(spark: SparkSession, sf: str) -> DataFrame:
    return resolved(spark, sf).select("profile", "id", checks.report_note().alias("note"))


def set_distinct_files(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.repos import walked

    rows = read(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.col("l_suppkey") % 7).alias("repo"), F.concat(F.lit("f"), "l_partkey").alias("rel"))
    return walked(rows).select("repo", "rel", F.col("walk_ord").cast("long").alias("walk_ord")).distinct()


def src_find(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.sources.repos import find

    name = F.when(F.col("p_size") % 3 == 0, "Setup.py").when(F.col("p_size") % 3 == 1, "setup.py").otherwise("other.py")
    rows = read(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", name).alias("rel"))
    return find(rows, "setup.py")


def fn_pkg_deps(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.plans.extract_queries import files
    from tidemark.sources.repos import dependencies

    line = F.concat(F.lit('"'), named(), F.lit('": "^1"'))
    return dependencies(files(spark, sf, "package.json", line, '{"dependencies": {"React": "1", ', '}, "scripts": {"start": "x"}}', ", "))


QUERIES = {f.__name__: f for f in (
    op_classify, agg_tracing, agg_sources_run, src_frontmatter, op_validate_packages, op_validate_declaration, src_profiles, src_json, src_proposals, fn_wrap, fn_srt_timestamp, fn_coerce, lim_output, fn_mask_note, fn_top_scalar,
    sort_final_id, agg_eval_layers, op_validate_catalog, op_validate_exec, op_validate_fields, set_unknown_ids, prd_needs_attention, snk_review_lines, snk_report_summary, snk_report_notes, set_distinct_files, src_find, fn_pkg_deps,
)}

N = "replace(p_name, ' ', '-') || '-' || p_partkey"
P = f"p AS (SELECT *, {N} AS k FROM part)"
ORDERS = "x AS (SELECT 'c' || o_custkey AS repo, o_orderkey AS k, ['a.py', 'b.rs', 'readme.md', 'package.json', 'c.kt', 'Makefile'][o_orderkey % 6 + 1] AS f, CASE o_orderkey % 40 WHEN 0 THEN 'langchain' WHEN 1 THEN 'flask' WHEN 2 THEN 'click' WHEN 3 THEN 'terraform' END AS d FROM orders)"
GOOD = "p_size % 7 <> 0 AND p_size % 11 <> 0"
NO_FAULT = f"{GOOD} AND p_size % 5 <> 0 AND p_size % 6 <> 0"
PACKAGE = "CASE WHEN p_size % 8 = 0 THEN k || '-x' ELSE k END"
NO = "CAST('' AS VARCHAR)"
EMPTY = "left(r, 300) || chr(10) || '[... ' || (length(r) - 300) || ' chars truncated]'"


def clipped() -> str:
    from tidemark.plans.text_queries import rx

    red = "('token = abcdefgh12345 ' || html)"
    for pattern in T.SECRET_PATTERNS:
        red = f"regexp_replace({red}, '{rx(pattern)}', '[redacted]', 'g')"
    return f"WITH x AS (SELECT page_id, {red} AS r FROM pages) SELECT page_id, md5(CASE WHEN length(r) > 300 THEN {EMPTY} ELSE r END) AS clipped_md5 FROM x"


def rules(source: str, key: str, table: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{rule}' AS rule FROM {source} WHERE {test}" for rule, test in table.items())


SQL = {
    "op_classify": f"""WITH {ORDERS}, r AS (SELECT repo, bool_or(d = 'langchain') AS agent, bool_or(d = 'flask') AS web, bool_or(d = 'click') AS cli, bool_or(d = 'terraform') AS infra, count(*) FILTER (f IN ('a.py', 'b.rs')) AS code, bool_or(f = 'package.json') AS node, bool_or(f = 'Makefile') AS mk,
 min('l' || k) FILTER (k % 30 = 4) AS server, min('n' || k) FILTER (k % 30 = 5) AS command FROM x GROUP BY repo),
c AS (SELECT *, coalesce(agent, false) AS a, coalesce(web, false) AS w, coalesce(cli, false) AS l, coalesce(infra, false) AS i FROM r)
SELECT repo, CASE WHEN a THEN 'agent-system' WHEN w OR server IS NOT NULL THEN 'service-app' WHEN command IS NOT NULL OR l THEN 'cli-tool' WHEN i AND code < 10 THEN 'infra-config' WHEN node AND code > 0 THEN 'library' WHEN mk THEN 'infra-config' ELSE 'unknown' END AS repo_class,
 CASE WHEN a THEN 'high' WHEN w THEN 'high' WHEN server IS NOT NULL THEN 'medium' WHEN command IS NOT NULL THEN 'high' WHEN l THEN 'medium' WHEN i AND code < 10 THEN 'medium' WHEN node AND code > 0 THEN 'medium' ELSE 'low' END AS class_confidence,
 CASE WHEN a THEN 'langchain' WHEN w THEN 'flask' WHEN server IS NOT NULL THEN server WHEN command IS NOT NULL THEN command WHEN l THEN 'click' WHEN i AND code < 10 THEN 'terraform' WHEN node AND code > 0 THEN 'javascript' ELSE '' END AS signals FROM c""",
    "agg_tracing": f"""WITH {ORDERS}, r AS (SELECT repo, count(*) FILTER (f = 'a.py') AS traceable, count(*) FILTER (f IN ('b.rs', 'c.kt')) AS untraceable, coalesce(string_agg(DISTINCT f[3:], ',' ORDER BY f[3:]) FILTER (f IN ('b.rs', 'c.kt')), '') AS languages FROM x GROUP BY repo)
SELECT *, CASE WHEN traceable + untraceable = 0 THEN 'none' WHEN untraceable = 0 THEN 'high' ELSE 'partial' END AS fidelity, traceable AS effect_sites FROM r""",
    "agg_sources_run": f"WITH {ORDERS} SELECT repo, array_to_string(list_filter([CASE WHEN bool_or(k % 7 = 0) THEN 'T0' END, CASE WHEN bool_or(k % 11 = 0) THEN 'T1' END, CASE WHEN bool_or(k % 3 = 0) THEN 'T2' END, CASE WHEN bool_or(k % 50 = 0) THEN 'T3' END], lambda s: s IS NOT NULL), ',') AS sources FROM x GROUP BY repo",
    "src_frontmatter": f"""WITH {P} SELECT k AS package, CAST(2 AS BIGINT) AS line, 'name' AS name, k AS value FROM p WHERE {GOOD} UNION ALL SELECT k, 4, 'description', 'A ' || p_name FROM p WHERE {GOOD} UNION ALL SELECT k, 5, 'metadata', '' FROM p WHERE {GOOD}
UNION ALL SELECT k, 6, 'metadata/size', CAST(p_size AS VARCHAR) FROM p WHERE {GOOD} UNION ALL SELECT k, 7, 'license', 'MIT' FROM p WHERE {GOOD} AND p_size % 5 = 0
UNION ALL SELECT k, 8, 'fault', 'no-parent' FROM p WHERE {GOOD} AND p_size % 5 = 0 UNION ALL SELECT k, CASE WHEN p_size % 5 = 0 THEN 9 ELSE 7 END, 'fault', 'no-colon' FROM p WHERE {GOOD} AND p_size % 6 = 0
UNION ALL SELECT k, 1, 'fault', 'no-opening' FROM p WHERE p_size % 7 = 0 UNION ALL SELECT k, 1, 'fault', 'not-closed' FROM p WHERE p_size % 7 <> 0 AND p_size % 11 = 0""",
    "op_validate_packages": f"""WITH {P}, q AS (SELECT *, {PACKAGE} AS package FROM p), m AS (SELECT * FROM q WHERE p_size % 13 <> 0) {rules("m", "package", {
        "front-matter-no-opening": "p_size % 7 = 0", "front-matter-not-closed": "p_size % 7 <> 0 AND p_size % 11 = 0", "front-matter-no-parent": f"{GOOD} AND p_size % 5 = 0", "front-matter-no-colon": f"{GOOD} AND p_size % 6 = 0", "name-folder": f"{NO_FAULT} AND p_size % 8 = 0",
    })} UNION ALL {rules("q", "package", {"no-skill-file": "p_size % 13 = 0", "reference-depth": "p_size % 3 = 0", "unexpected-entry": "p_size % 3 = 1"})}""",
    "op_validate_declaration": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'no-profile' ELSE 'no-channels' END AS rule FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0",
    "src_profiles": "SELECT 's-' || s_suppkey AS id, s_name AS name, 'file.read' AS native, CASE WHEN s_nationkey % 2 = 0 THEN 'http.request' ELSE '' END AS mcp, CASE WHEN s_nationkey % 3 = 0 THEN '2020-01-01' END AS expiry FROM supplier",
    "src_json": "SELECT CASE WHEN s_nationkey % 3 = 0 THEN '2020-01-01' END AS expiry, count(*) AS n FROM supplier GROUP BY ALL",
    "src_proposals": """SELECT event_id, CASE WHEN event_id % 5 IN (0, 2) THEN event_type ELSE '' END AS op_id, CASE WHEN event_id % 5 IN (0, 2) THEN 'a.b' ELSE '' END AS requires, CAST(CASE WHEN event_id % 5 NOT IN (0, 2) THEN 0 WHEN event_id % 4 = 0 THEN 200 ELSE 4 END AS BIGINT) AS length,
 CASE event_id % 5 WHEN 1 THEN 'no-op-id' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'unreadable' ELSE '' END AS problem FROM events""",
    "fn_wrap": """WITH w AS (SELECT p_partkey, string_split(concat_ws(' ', p_name, p_type, p_brand, p_name, 'averylongwordwithoutend', p_type), ' ') AS w FROM part)
SELECT p_partkey, list_reduce(w, lambda a, b: CASE WHEN length(string_split(a, '|')[-1]) + 1 + length(b) <= 16 THEN a || ' ' || b ELSE a || '|' || b END) AS lines FROM w""",
    "fn_srt_timestamp": "WITH m AS (SELECT p_partkey, CAST(round_even((p_partkey * 3.5 + p_size / 2000) * 1000, 0) AS BIGINT) AS ms FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)) SELECT p_partkey, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp FROM m",
    "fn_coerce": """SELECT event_id, CASE (event_id // 6) % 4 WHEN 0 THEN CASE event_id % 6 WHEN 0 THEN 'text' END WHEN 1 THEN CASE event_id % 6 WHEN 1 THEN '12.0' WHEN 2 THEN '1.5' END WHEN 2 THEN CASE event_id % 6 WHEN 1 THEN '12' END
 ELSE ['"text"', '12', '1.5', 'true', 'null', '{oops'][event_id % 6 + 1] END AS value FROM events""",
    "lim_output": clipped(),
    "fn_mask_note": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '; ' ELSE '' END || 'check it' AS notes FROM part",
    "fn_top_scalar": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE '' END AS kind, p_size % 3 <> 0 AS has_kind FROM part",
    "sort_final_id": f"WITH {ops_sql()} SELECT day, id, row_number() OVER (PARTITION BY day ORDER BY id) AS place FROM ops",
    "agg_eval_layers": "WITH x AS (SELECT event_type || '-' || (user_id % 50) AS layer, CASE WHEN event_id % 31 = 0 THEN 'fail' WHEN event_id % 3 = 0 THEN 'skip' ELSE 'pass' END AS s FROM events), c AS (SELECT layer, count(*) FILTER (s = 'pass') AS passed, count(*) FILTER (s = 'fail') AS failed, count(*) FILTER (s = 'skip') AS skipped FROM x GROUP BY layer) SELECT *, failed = 0 AND passed > 0 AS ok FROM c",
    "op_validate_catalog": f"WITH p AS (SELECT p_size % 9 AS s, CASE WHEN p_size % 9 = 0 THEN '' ELSE {N} END AS provider FROM part), r AS ({rules('p', 'provider', {'id-missing': 's = 0', 'no-packages': 's = 1', 'empty-packages': 's = 2', 'effect': 's = 3', 'gate': 's = 4', 'credential-name': 's = 5', 'credential-kind': 's = 6', 'ambiguous-without-note': 's = 7', 'unknown-capability': 's = 8'})}) SELECT provider, rule, count(*) AS n FROM r GROUP BY ALL",
    "op_validate_exec": f"WITH p AS (SELECT p_partkey, p_size % 8 AS s, {N} AS stand_in FROM part) {rules('p', 'stand_in', {'neither-runs-nor-says-why': 's = 0', 'runs-and-says-why-not': 's = 2', 'tool-empty': 's = 3', 'input-type': 's = 4', 'input-default': 's IN (5, 6)', 'script-not-shipped': 's >= 2 AND p_partkey % 3 = 2'})}",
    "op_validate_fields": f"""WITH {ops_sql()}, o AS (SELECT day, replace(replace(id, '/', '-'), '/', '-') AS id, user_id % 9 AS r, len(gate) AS g, requires, stand_in FROM ops) {rules("o", "day, id", {
        "evidence-source": "r = 1", "evidence-loc": "r = 2", "evidence-empty": "r = 3", "gate-confidence-missing": "r = 4 AND g > 0", "gate-confidence": "r = 5", "trigger": "r = 6", "unknown-capability": "list_contains(requires, 'view')", "unknown-stand-in": "stand_in = 'ledger'",
    })}""",
    "set_unknown_ids": "SELECT DISTINCT 'u' || user_id AS profile, event_type AS capability FROM events WHERE event_type IN ('error', 'view')",
    "prd_needs_attention": f"WITH {ops_sql()} SELECT id, confidence = 'low' OR len(gate) > 0 OR n % 3 = 0 AS needs_attention FROM ops",
    "snk_review_lines": f"""WITH {ops_sql()}, c AS (SELECT day, count(*) AS n, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (len(gate) > 0) AS gated, CAST(substr(day, 9, 2) AS INT) AS d FROM ops GROUP BY day),
h AS (SELECT day, 3 AS section, unnest(['Operations: **' || n || '**', '- low confidence: **' || low || '**', '- with gates: **' || gated || '**', '- nothing known but `external.call`: **0**']) AS line, unnest(range(4)) AS place FROM c
 UNION ALL SELECT day, 1, unnest(l), unnest(range(len(l))) FROM (SELECT day, list_filter([CASE WHEN d % 2 = 0 THEN 'Source: `u/' || day || '`' ELSE 'Source: unknown' END, CASE WHEN d % 3 = 0 THEN 'Version: `v1`' END, 'Class: `library`', 'Status: `draft`'], lambda x: x IS NOT NULL) AS l FROM c)
 UNION ALL SELECT day, 2, '- stopped at a cap', 1 FROM c WHERE d % 5 = 0
 UNION ALL SELECT day, 4, '- dependencies outside the catalogue: ' || array_to_string(u[1:8], ', ') || CASE WHEN len(u) > 8 THEN ' and ' || (len(u) - 8) || ' more' ELSE '' END, 0 FROM (SELECT day, list(user_id ORDER BY user_id) AS u FROM ops WHERE n % 4 = 0 GROUP BY day)
 UNION ALL SELECT day, 5, unnest(['| operation | stage | effect | requires | gates | confidence | evidence |', '|---|---|---|---|---|---|---|']), unnest(range(2)) FROM c
 UNION ALL SELECT day, 8, unnest({['%d. %s' % (i, t) for i, t in enumerate(checks.CONFIRM, 1)]}), unnest(range(4)) FROM c),
o AS (SELECT *, CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS a, len(gate) = 0 AS b FROM ops)
SELECT day, section, CAST(place AS BIGINT) AS place, line FROM h UNION ALL SELECT day, 6, row_number() OVER (PARTITION BY day ORDER BY a, b, id), '| `' || id || '` | ' || stage || ' | ' || effect || ' | ' || array_to_string(requires, ', ') || ' | ' || CASE WHEN len(gate) > 0 THEN array_to_string(gate, ', ') ELSE '-' END || ' | ' || confidence || ' | declared, traced |' FROM o
UNION ALL SELECT day, 7, row_number() OVER (PARTITION BY day ORDER BY a, b, id), '- `' || id || '`: ' || summary FROM o WHERE summary <> ''""",
    "snk_report_summary": f"""WITH {RES}, s AS (SELECT profile, day, count(*) AS n, count(*) FILTER (NOT optional) AS req, count(*) FILTER (binding = 'native') AS b1, count(*) FILTER (binding = 'mcp') AS b2, count(*) FILTER (binding = 'script') AS b3, count(*) FILTER (binding = 'ask-user') AS b4, count(*) FILTER (binding = 'drop') AS b5,
 count(*) FILTER (NOT optional AND binding IN ('ask-user', 'drop')) = 0 AS ok, list_sort(list_distinct(flatten(list(gates)))) AS g, sum(len(gates)) AS gn, list_sort(list_distinct(flatten(list(deferred_gates)))) AS d FROM res GROUP BY profile, day)
SELECT profile, day, CAST(i AS BIGINT) AS place, ['operations ' || n || '   required ' || req || '   optional ' || (n - req), 'native ' || b1 || '   mcp ' || b2 || '   script ' || b3 || '   ask-user ' || b4 || '   drop ' || b5, 'all required operations executable: ' || CASE WHEN ok THEN 'yes' ELSE 'no' END,
 'gates enforced: ' || CASE WHEN len(g) > 0 THEN array_to_string(g, ', ') ELSE '-' END || '  (' || gn || ' total)', 'gates deferred: ' || CASE WHEN len(d) > 0 THEN array_to_string(d, ', ') ELSE '-' END][i + 1] AS line FROM s, range(5) AS r(i)""",
    "snk_report_notes": f"WITH {RES} SELECT profile, id, CASE binding WHEN 'script' THEN 'stand-in ' || stand_in || ' f=' || fidelity WHEN 'ask-user' THEN 'needs ' || CASE WHEN len(missing) > 0 THEN array_to_string(missing, ', ') ELSE 'human' END WHEN 'drop' THEN 'optional, lost' ELSE '' END AS note FROM res",
    "set_distinct_files": "SELECT repo, rel, row_number() OVER (PARTITION BY repo ORDER BY rel) AS walk_ord FROM (SELECT DISTINCT 'r' || (l_suppkey % 7) AS repo, 'f' || l_partkey AS rel FROM lineitem)",
    "src_find": "SELECT p_partkey, p_brand || '/' || CASE WHEN p_size % 3 = 0 THEN 'Setup.py' ELSE 'setup.py' END AS rel FROM part WHERE p_size % 3 < 2",
    "fn_pkg_deps": f"SELECT p_brand AS repo, 'npm' AS ecosystem, {N} AS name FROM part UNION ALL SELECT DISTINCT p_brand, 'npm', 'react' FROM part",
}

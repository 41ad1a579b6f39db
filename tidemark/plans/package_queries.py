"""Queries of packages that are written and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import packages, routing, selection
from tidemark.plans.inventory_queries import STANDINS, one_row, ops, profiles, resolved, standins
from tidemark.plans.inventory_sql import RES
from tidemark.sources.packages import read_packages, write_packages
from tidemark.sources.tables import materialise, new_path, read

TOLD = {"card": ("a still card", "no motion", "card.py"), "ledger": ("an entry in a list", "paid later", None)}
SCRIPT = "import json\nprint(json.dumps({}))\n"


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("stand_in"), F.lit(STANDINS[k]).alias("fidelity"), F.lit(d).alias("desc"), F.lit(c).alias("caveat"), F.lit(s).cast("string").alias("script")) for k, (d, c, s) in TOLD.items()]
    return one_row(spark, rows)


def meta(rows: DataFrame) -> DataFrame:
    """An inventory a day: every third is a draft, every other has a pinned version."""
    n = F.dayofmonth(F.to_date("day"))
    return rows.select("day").distinct().select("day", F.concat(F.lit("https://example.org/d"), F.translate("day", "-", ""), F.lit(".git")).alias("url"), F.when(n % 2 == 0, F.concat(F.lit("v"), n)).alias("sha"), F.when(n % 3 == 0, "draft").otherwise("reviewed").alias("status"), F.lit("library").alias("repo_class"))


def written(spark: SparkSession, lines: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    root = new_path(spark, "packages")
    write_packages(lines, root, refused)
    return read_packages(spark, root).select("package", "rel", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


def snk_package(spark: SparkSession, sf: str) -> DataFrame:
    """A package a day and profile, its operations a user's day, written by the sink with commit and read back."""
    rows = materialise(resolved(spark, sf), "resolved")  # every file of a package reads them
    days = meta(rows)
    evidence = rows.where("profile = 'full' and n % 2 = 0").select("day", "id", "ord", F.lit("traced").alias("source"), F.concat(F.lit("event "), "ord").alias("loc"), F.col("summary").alias("detail"))
    script = one_row(spark, [F.struct(F.lit("card.py").alias("script"), F.lit(SCRIPT).alias("text"))])
    lines = packages.package_lines(rows, days, ["day"], catalogue(spark), evidence, script)
    return written(spark, lines, packages.refusals(rows, days, ["day"], accept_unreviewed=True))


def snk_refused(spark: SparkSession, sf: str) -> DataFrame:
    """Drafts, and invariants broken on purpose: gates taken from every eleventh user's operations."""
    rows = resolved(spark, sf)
    rows = rows.withColumn("gates", F.when(F.col("user_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("gates")))
    return packages.refusals(rows, meta(rows), ["day"])


def snk_not_suitable(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as scopes: orders count as operations, documents and code; who has none is told why."""
    own = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = read(spark, sf, "customer").join(own, "c_custkey", "left").select(F.col("c_custkey").alias("customer"), "c_nationkey", F.coalesce("n", F.lit(0)).alias("n"))
    status = selection.suitability(F.when(F.col("n") > 5, 1).otherwise(0), F.when(F.col("c_nationkey") == 3, 3).otherwise(0), F.lit(0))
    reasons = F.array_compact(F.array(F.lit("no operation was found"), F.when(F.col("n") > 0, F.concat("n", F.lit(" orders are too few")))))
    seen = F.when(F.col("n") > 0, F.array(F.concat(F.lit("nation "), "c_nationkey"))).otherwise(F.array().cast("array<string>"))
    verdicts = rows.select(F.concat(F.lit("c"), "customer").alias("customer"), status.alias("status"), F.when(F.col("n") > 2, F.concat(F.lit("n"), "c_nationkey")).alias("source"), reasons.alias("reasons"), seen.alias("evidence"))
    return written(spark, packages.refusal_lines(verdicts, ["customer"]))


def snk_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as files: a folder a source, a file a document."""
    rows = read(spark, sf, "documents").where("text is not null")
    files = rows.select(F.concat_ws("-", F.lit("s"), F.regexp_replace("source", "[^a-z0-9]+", "-")).alias("package"), F.concat(F.lit("texts/"), "doc_id", F.lit(".txt")).alias("rel"), F.translate("text", "\r", "").alias("text"))
    return written(spark, packages.file_lines(files))


def op_validate_packages_written(spark: SparkSession, sf: str) -> DataFrame:
    """Packages read back from their folders pass the rules for packages, but for the budget of lines."""
    from tidemark.operators.checks import validate_packages

    rows = routing.resolve(ops(spark, sf).withColumn("declared_stand_in", F.col("stand_in")), profiles(spark), standins(spark))
    rows, root = materialise(rows, "resolved"), new_path(spark, "packages")
    write_packages(packages.package_lines(rows, meta(rows), ["day"], catalogue(spark)), root)
    return validate_packages(read_packages(spark, root))


QUERIES = {"snk_package": snk_package, "snk_refused": snk_refused, "snk_not_suitable": snk_not_suitable, "snk_text": snk_text, "op_validate_packages_written": op_validate_packages_written}

CELLS = lambda *cells: "'| ' || concat_ws(' | ', " + ", ".join(cells) + ") || ' |'"
CODE = lambda c: f"'`' || {c} || '`'"
LISTED = lambda c, none="-": f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE '{none}' END"
INFO = """info AS (SELECT day, 'https://example.org/d' || replace(day, '-', '') || '.git' AS url, CASE WHEN d % 2 = 0 THEN 'v' || d END AS sha, CASE WHEN d % 3 = 0 THEN 'draft' ELSE 'reviewed' END AS status
 FROM (SELECT DISTINCT day, CAST(substr(day, 9, 2) AS INT) AS d FROM ops))"""
STAND = "stand(stand_in, descr, caveat, script) AS (VALUES " + ", ".join(f"('{k}', '{d}', '{c}', {'NULL' if s is None else repr(s)})" for k, (d, c, s) in TOLD.items()) + ")"
UNREVIEWED = "status = 'draft'"
CHANNEL_ROWS = [f"'| {b} | ' || n_{b.replace('-', '_')} || ' | {text} |'" for b, text in packages.CHANNELS.items()]
COVERAGE = "'Coverage of required operations: **' || (cov // 100) || '.' || lpad(CAST(cov % 100 AS VARCHAR), 2, '0') || ' %**'"
RUNS = "CASE WHEN n_halted + n_lost = 0 THEN 'All required operations run here.' ELSE '**' || n_halted || '** required operation(s) stop for a person and **' || n_lost || '** are lost.' END"
HEADS: list[tuple[str, int, str, list[str]]] = [
    ("SKILL.md", 0, "true", ["'---'", "'name: ' || package", "'description: Work with ' || url || ' in ' || n || ' operations, each bound for the profile ' || profile || ', with what is replaced, asked or left out said beforehand.'", "'license: MIT'", "'compatibility: made for the profile ' || profile || coalesce(' at ' || sha, '')", "'metadata:'", "'  repo_class: library'", "'  profile: ' || profile", f"'  inventory_status: ' || CASE WHEN {UNREVIEWED} THEN 'accepted-unreviewed' ELSE status END", "'  source: ' || url", "'  source_sha: ' || sha", "'---'", "''"]),
    ("SKILL.md", 1, "true", ["'# Operations of ' || url", "''", "'## Profile'", "''", "'All bindings below hold for the profile `' || profile || '` and for no other.'", "''", "'| Channel | Operations | Meaning |'", "'|---|---|---|'", *CHANNEL_ROWS, "''", COVERAGE, "''", RUNS, "''"]),
    ("SKILL.md", 2, UNREVIEWED, ["'## Not reviewed'", "''", "'Nobody has confirmed this inventory; these operations are the least certain:'", "''"]), ("SKILL.md", 4, UNREVIEWED, ["''"]),
    ("SKILL.md", 5, "true", ["'## Operations in order'", "''", "'| # | Operation | Stage | Effect | Binding | Gates | Confidence |'", "'|---|---|---|---|---|---|---|'"]),
    ("SKILL.md", 7, "true", ["''", "'## Where it stops'", "''"]), ("SKILL.md", 8, "n_ask_user > 0", ["'Stop for a person:'", "''"]), ("SKILL.md", 10, "n_ask_user > 0", ["''"]),
    ("SKILL.md", 11, "n_script > 0", ["'Run as something lesser; say so in what is delivered:'", "''"]), ("SKILL.md", 13, "n_script > 0", ["''"]), ("SKILL.md", 14, "n_drop > 0", ["'Left out:'", "''"]), ("SKILL.md", 16, "n_drop > 0", ["''"]),
    ("SKILL.md", 17, "n_ask_user + n_script + n_drop = 0", ["'Nothing stops, is replaced or left out.'", "''"]),
    ("SKILL.md", 18, "true", ["'## Gates'", "''", "CASE WHEN len(g) > 0 THEN 'Held here: ' || array_to_string(g, ', ') || '.' ELSE 'No gate is held here.' END", "CASE WHEN len(dg) > 0 THEN 'Left to the questions: ' || array_to_string(dg, ', ') || '.' END"]),
    ("SKILL.md", 19, "true", ["''", "'## References'", "''", "'- `references/bindings.md`'", "CASE WHEN n_script > 0 THEN '- `references/degradation.md`' END", "CASE WHEN n_ask_user > 0 THEN '- `references/blocked.md`' END", "'- `references/gates.md`'"]),
    ("references/bindings.md", 0, "true", ["'# Bindings'", "''", "'Profile `' || profile || '`, ' || n || ' operations.'", "''", "'| Operation | Stage | Effect | Requires | Binding | Gates | Confidence |'", "'|---|---|---|---|---|---|---|'"]), ("references/bindings.md", 2, "true", ["''", "'## Evidence'", "''"]),
    ("references/degradation.md", 0, "true", ["'# Degradation'", "''", "CASE WHEN n_script > 0 THEN '| Operation | Stand-in | Fidelity | Runs as | Instead | Caveat |' ELSE 'Nothing runs as something lesser.' END", "CASE WHEN n_script > 0 THEN '|---|---|---|---|---|---|' END"]),
    ("references/blocked.md", 0, "true", ["'# Questions'", "''", "CASE WHEN n_ask_user = 0 THEN 'Nothing needs to be asked.' END"]),
    ("references/gates.md", 0, "true", ["'# Gates'", "''", "'| Gate | Meaning |'", "'|---|---|'", *[f"'| `{g}` | {m} |'" for g, m in packages.GATE_MEANING.items()], "''"]),
    ("references/gates.md", 1, "len(g) > 0", ["'## Held'", "''", "'| Operation | Gates |'", "'|---|---|'"]), ("references/gates.md", 3, "len(g) > 0", ["''"]),
    ("references/gates.md", 4, "len(dg) > 0", ["'## Left to questions'", "''", "'| Operation | Gates |'", "'|---|---|'"]), ("references/gates.md", 6, "len(dg) > 0", ["''"]), ("references/gates.md", 7, "len(g) + len(dg) = 0", ["'No operation has a gate.'"]),
]
DEFAULT_OF = " ".join(f"WHEN list_contains(deferred_gates, '{g}') THEN '{t}'" for g, t in routing.SAFE_DEFAULTS.items())
QUESTION = f"'Cannot run ''' || id || ''': missing ' || array_to_string(missing, ', ') || '.' || CASE WHEN len(deferred_gates) > 0 THEN ' Gates: ' || upper(array_to_string(deferred_gates, ', ')) || '.' ELSE '' END || ' Default: ' || CASE {DEFAULT_OF} ELSE 'do not proceed' END || '.'"
SHOWN = "CASE WHEN len(gates) > 0 THEN array_to_string(gates, ', ') WHEN len(deferred_gates) > 0 THEN 'asked: ' || array_to_string(deferred_gates, ', ') ELSE '-' END"
ROWS: list[tuple[str, int, str, list[str]]] = [
    ("SKILL.md", 3, f"{UNREVIEWED} AND confidence = 'low'", [f"'- ' || {CODE('id')} || ' needs ' || {LISTED('requires', 'nothing')}"]),
    ("SKILL.md", 9, "binding = 'ask-user'", [f"'- ' || {CODE('id')} || ' lacks ' || {LISTED('missing', 'a decision')} || CASE WHEN len(deferred_gates) > 0 THEN '; ask about ' || array_to_string(deferred_gates, ', ') ELSE '' END"]),
    ("SKILL.md", 12, "binding = 'script'", [f"'- ' || {CODE('id')} || ': ' || descr || ' (stand-in ' || {CODE('stand_in')} || ')'"]), ("SKILL.md", 15, "binding = 'drop'", [f"'- ' || {CODE('id')}"]),
    ("references/bindings.md", 1, "true", [CELLS(CODE("id"), "stage", "effect", LISTED("requires"), "binding", LISTED("gates"), "confidence")]),
    ("references/bindings.md", 3, "true", [f"'### ' || {CODE('id')}", "CASE WHEN n % 2 = 0 THEN '- `traced` event ' || ord || ': ' || summary ELSE '- nothing recorded' END"]),
    ("references/degradation.md", 1, "binding = 'script'", [CELLS(CODE("id"), CODE("stand_in"), "CAST(round(fidelity * 100) AS INT) || ' %'", "coalesce('`scripts/' || script || '`', 'not runnable')", "descr", "caveat")]),
    ("references/blocked.md", 1, "binding = 'ask-user'", [f"'## ' || {CODE('id')}", "''", QUESTION, "''"]), ("references/gates.md", 2, "len(gates) > 0", [CELLS(CODE("id"), LISTED("gates"))]), ("references/gates.md", 5, "len(deferred_gates) > 0", [CELLS(CODE("id"), LISTED("deferred_gates"))]),
]


def unnested(blocks: list[tuple[str, int, str, list[str]]], source: str, at: str) -> str:
    items = [f"{{'rel': '{rel}', 'section': {section}, 'place': {i}, 'line': CASE WHEN {cond} THEN {line} END}}" for rel, section, cond, lines in blocks for i, line in enumerate(lines)]
    return f"SELECT package, {at} AS spot, x.rel AS rel, x.section AS section, x.place AS place, x.line AS line FROM (SELECT *, unnest([{', '.join(items)}]) AS x FROM {source})"


bound = lambda b: f"count(*) FILTER (binding = '{b}')"
PACKAGE_LINES = f"""{RES}, {INFO}, {STAND},
told AS (SELECT r.*, url, sha, status, descr, caveat, script, 'd' || replace(day, '-', '') || '-' || profile AS package FROM res r JOIN info USING (day) LEFT JOIN stand USING (stand_in)),
pk AS (SELECT package, url, sha, status, profile, count(*) AS n, {bound('native')} AS n_native, {bound('mcp')} AS n_mcp, {bound('script')} AS n_script, {bound('ask-user')} AS n_ask_user, {bound('drop')} AS n_drop,
 count(*) FILTER (NOT optional AND binding = 'ask-user') AS n_halted, count(*) FILTER (NOT optional AND binding = 'drop') AS n_lost, coalesce(CAST(sum(CAST(round(coverage * 10000) AS BIGINT)) FILTER (NOT optional) AS BIGINT) // nullif(count(*) FILTER (NOT optional), 0), 0) AS cov,
 list_sort(list_distinct(flatten(list(gates)))) AS g, list_sort(list_distinct(flatten(list(deferred_gates)))) AS dg FROM told GROUP BY ALL),
lines AS ({unnested(HEADS, 'pk', "''")} UNION ALL {unnested(ROWS, 'told', 'id')}
 UNION ALL SELECT package, '', 'SKILL.md', 6, row_number() OVER w, {CELLS("CAST(row_number() OVER w AS VARCHAR)", CODE('id'), 'stage', 'effect', 'binding', SHOWN, 'confidence')} FROM told WINDOW w AS (PARTITION BY package ORDER BY stage, id)
 UNION ALL SELECT package, '', 'scripts/card.py', 0, i, ['import json', 'print(json.dumps({{}}))'][i] FROM (SELECT DISTINCT package FROM told WHERE script IS NOT NULL), (VALUES (1), (2)) v(i))"""
TEXTS = "SELECT package, rel, string_agg(line, chr(10) ORDER BY section, spot, place) || chr(10) AS text FROM lines WHERE line IS NOT NULL GROUP BY package, rel"
LOST = f"""{RES}, {INFO}, bad AS (SELECT * REPLACE (CASE WHEN user_id % 11 = 0 THEN [] ELSE gates END AS gates) FROM res)"""
SQL = {
    "snk_package": f"WITH {PACKAGE_LINES}, t AS ({TEXTS}) SELECT package, rel, md5(text) AS text_md5, length(text) AS n_chars FROM t",
    "snk_refused": f"""WITH {LOST}, x AS (SELECT day, profile, 'draft' AS reason FROM (SELECT DISTINCT day, profile FROM bad) JOIN info USING (day) WHERE {UNREVIEWED}
 UNION ALL SELECT day, profile, 'I1' FROM bad WHERE binding IN ('native', 'mcp', 'script') AND NOT list_has_all(gates, gate)
 UNION ALL SELECT day, profile, 'I6' FROM bad WHERE binding IN ('native', 'mcp', 'script') AND list_has_any(gate, ['publish', 'irreversible']) AND NOT list_has_any(gate, gates)) SELECT day, profile, reason, count(*) AS n FROM x GROUP BY ALL""",
    "snk_not_suitable": """WITH o AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
t AS (SELECT 'c' || c_custkey AS package, 'NOT-SUITABLE.md' AS rel, concat_ws(chr(10), '# Not converted', '', CASE WHEN n > 2 THEN 'Source: `n' || c_nationkey || '`' || chr(10) END, '## Why', '', '- no operation was found', CASE WHEN n > 0 THEN '- ' || n || ' orders are too few' END, '',
 CASE WHEN n > 0 THEN '## Seen' || chr(10) || chr(10) || '- nation ' || c_nationkey || chr(10) END, '## What would help', '', 'An entry point, or a declared surface such as commands, routes, jobs or tools.') || chr(10) AS text FROM o WHERE n <= 5 AND c_nationkey <> 3)
SELECT package, rel, md5(text) AS text_md5, length(text) AS n_chars FROM t""",
    "snk_text": r"""WITH t AS (SELECT 's-' || regexp_replace(source, '[^a-z0-9]+', '-', 'g') AS package, 'texts/' || doc_id || '.txt' AS rel, regexp_replace(replace(text, chr(13), ''), '\n$', '') || chr(10) AS text FROM documents WHERE text IS NOT NULL)
SELECT package, rel, md5(text) AS text_md5, length(text) AS n_chars FROM t""",
    "op_validate_packages_written": f"WITH {PACKAGE_LINES}, n AS (SELECT package, count(*) AS n, sum(length(line) + 1) - 1 AS c FROM lines WHERE rel = 'SKILL.md' AND section > 0 AND line IS NOT NULL GROUP BY package) SELECT package, 'lines' AS rule FROM n WHERE n > 500 UNION ALL SELECT package, 'tokens' FROM n WHERE c // 4 > 5000",
}

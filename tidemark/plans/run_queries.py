"""Queries of scans, runs of stand-ins and canonical documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.documents import canonical_json
from tidemark.operators import runs
from tidemark.plans.inventory_queries import one_row, ops
from tidemark.plans.inventory_sql import ops as ops_sql
from tidemark.sources import repos
from tidemark.sources.tables import read

FILES_MOST, BYTES_MOST, ONE_MOST = 60, 120_000, 9_000
INPUTS = "array<struct<name:string,type:string,default:string,required:boolean>>"
#: Inputs of two stand-ins: name, type, default as JSON, required.
DECLARED = {"card": [("ratio", "number", None, False), ("title", "string", None, True), ("width", "integer", "640", False)], "ledger": [("note", None, '["x"]', False), ("title", "string", '"none"', True)]}


def src_caps_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as files of a scan: how many come before a cap, and which cap it is."""
    rows = read(spark, sf, "documents").select("source", "doc_id", F.col("n_chars").alias("size"))
    return repos.scans(rows, ["source"], "doc_id", FILES_MOST, BYTES_MOST, ONE_MOST)


def snk_json(spark: SparkSession, sf: str) -> DataFrame:
    """A document for each conversation, made with unsorted keys, in canonical form."""
    turn = F.struct(F.col("turn"), F.col("text"), F.col("role"))
    rows = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["text"].alias("text"), x["role"].alias("role"), F.array(x["turn"]).alias("at")))
    document = F.to_json(F.struct(turns.alias("turns"), F.struct(F.array().cast("array<int>").alias("none"), F.struct(F.lit(True).alias("b"), F.lit(1.5).alias("a")).alias("é")).alias("meta"), F.col("conv_id")))
    return rows.select("conv_id", F.md5(canonical_json(document, 5)).alias("document_md5"))


def declared(spark: SparkSession) -> DataFrame:
    entry = lambda i: F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(i, ("name", "type", "default", "required"), ("string", "string", "string", "boolean"), strict=True)])
    return one_row(spark, [F.struct(F.lit(k).alias("stand_in"), F.array(*map(entry, v)).cast(INPUTS).alias("inputs")) for k, v in DECLARED.items()])


def ex_resolve_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as runs: titles that are absent, texts or numbers; widths that are numbers or texts; unknown names; what is no object."""
    key, size = F.col("p_partkey"), F.col("p_size")
    title = F.when(size % 5 == 0, F.concat(F.lit('"title": '), size)).when(size % 3 != 0, F.concat(F.lit('"title": "'), "p_name", F.lit('"')))
    width = F.when(size % 7 == 0, F.lit('"width": "x"')).when(size % 2 == 0, F.concat(F.lit('"width": '), size))
    more = F.when(key % 11 == 0, F.lit('"depth": [1]')), F.when(key % 4 == 0, F.concat(F.lit('"ratio": '), size, F.lit(".5"))), F.when(key % 6 == 0, F.lit('"note": {"a": 1}'))
    given = F.when(key % 97 == 0, "[1]").when(key % 89 == 0, F.lit(None)).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", title, width, *more), F.lit("}")))
    stand_in = F.when(key % 31 == 0, "other").when(key % 3 == 0, "ledger").otherwise("card")
    return runs.resolve_inputs(read(spark, sf, "part").select(key.alias("run"), stand_in.alias("stand_in"), given.alias("inputs")), declared(spark))


PATHS = ("out/{}.txt", "./a/../out//{}.txt", "../{}.txt", "a/../../out/{}.txt", "/etc/{}", "/work/out/{}.txt", "/work/../work/./out/{}.txt", "/worker/{}.txt", "out", "", "a/b/..")


def ex_collect_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as runs that report three paths each; every fourth page wrote nothing."""
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("run"))
    path = lambda i: F.element_at(F.array(*[F.concat(F.lit(p.partition("{}")[0]), F.col("run"), F.lit(p.partition("{}")[2])) if "{}" in p else F.lit(p) for p in PATHS]), ((F.col("run") + i) % len(PATHS) + 1).cast("int"))
    entries = F.concat_ws(", ", F.concat(F.lit('{"path": "'), path(0), F.lit('", "kind": "text", "cues": 3}')), F.concat(F.lit('{"path": "'), path(4), F.lit('", "cues": "3"}')), F.lit('"odd"'), F.lit('{"path": 5}'))
    results = pages.select("run", F.lit("/work").alias("folder"), F.concat(F.lit('{"artifacts": ['), entries, F.lit("]}")).alias("payload"))
    written = pages.where("run % 4 <> 0").select("run", F.concat(F.lit("out/"), "run", F.lit(".txt")).alias("path"))
    return runs.collect_artifacts(results, written, "folder").withColumn("place", F.col("place").cast("long"))


def ex_run_command(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which a required operation has no run that went well."""
    rows = ops(spark, sf)
    status = F.when(F.col("ord") % 9 == 0, "failed").when(F.col("ord") % 10 == 0, "unavailable").otherwise("ok")
    made = rows.where("user_id % 50 <> 0 or day < '2024-01-15'").select("day", "id", F.when(F.dayofmonth(F.to_date("day")) % 2 == 0, "ok").otherwise(status).alias("status"))
    return runs.required_not_run(rows, made, ["day"])


QUERIES = {f.__name__: f for f in (src_caps_reason, snk_json, ex_resolve_inputs, ex_collect_artifacts, ex_run_command)}

WALK = f"""w AS (SELECT source, doc_id, n_chars, n_chars <= {ONE_MOST} AS small, coalesce(sum(CASE WHEN n_chars <= {ONE_MOST} THEN n_chars END) OVER o, 0) AS b, count(*) FILTER (n_chars <= {ONE_MOST}) OVER o AS f
 FROM documents WINDOW o AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
KEPT = f"small AND b <= {BYTES_MOST} AND f <= {FILES_MOST}"
CROSS = f"CASE WHEN f - small::INT >= {FILES_MOST} THEN 'more than {FILES_MOST} files' WHEN small AND b > {BYTES_MOST} THEN 'more than {BYTES_MOST} bytes' END"
TITLE = "CASE WHEN p_size % 5 = 0 THEN 'n' WHEN p_size % 3 <> 0 THEN 's' END"
STAND_IN = "CASE WHEN p_partkey % 31 = 0 THEN 'other' WHEN p_partkey % 3 = 0 THEN 'ledger' ELSE 'card' END"
PATH = lambda i: "[" + ", ".join("'" + p.replace("{}", "' || run || '") + "'" for p in PATHS) + f"][(run + {i}) % {len(PATHS)} + 1]"
#: How each path ends: o for the file that may be written, n for another one inside, x for outside.
ENDS = "'ooxxxooxnnn'"
SQL = {
    "src_caps_reason": f"""WITH {WALK}, c AS (SELECT *, {CROSS} AS crossed FROM w)
SELECT source, count(*) FILTER ({KEPT}) AS n_files, CAST(coalesce(sum(n_chars) FILTER ({KEPT}), 0) AS BIGINT) AS n_bytes, count(crossed) > 0 AS truncated, arg_min(crossed, doc_id) FILTER (crossed IS NOT NULL) AS reason, min(doc_id) FILTER (crossed IS NOT NULL) AS at FROM c GROUP BY source""",
    "snk_json": """WITH t AS (SELECT conv_id, string_agg('    {' || chr(10) || '      "at": [' || chr(10) || '        ' || turn || chr(10) || '      ],' || chr(10) || '      "role": ' || CAST(to_json(role) AS VARCHAR) || ',' || chr(10) || '      "text": ' || CAST(to_json(text) AS VARCHAR) || chr(10) || '    }', ',' || chr(10) ORDER BY turn, text, role) AS x FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('{' || chr(10) || '  "conv_id": ' || conv_id || ',' || chr(10) || '  "meta": {' || chr(10) || '    "none": [],' || chr(10) || '    "é": {' || chr(10) || '      "a": 1.5,' || chr(10) || '      "b": true' || chr(10) || '    }' || chr(10) || '  },' || chr(10) || '  "turns": [' || chr(10) || x || chr(10) || '  ]' || chr(10) || '}' || chr(10)) AS document_md5 FROM t""",
    "ex_resolve_inputs": f"""WITH p AS (SELECT p_partkey AS run, p_size, p_name, {STAND_IN} AS s, p_partkey % 97 = 0 AS odd, p_partkey % 97 <> 0 AND p_partkey % 89 = 0 AS bare FROM part),
g AS (SELECT *, CASE WHEN NOT bare THEN {TITLE} END AS t, CASE WHEN NOT bare THEN CASE WHEN p_size % 7 = 0 THEN 's' WHEN p_size % 2 = 0 THEN 'n' END END AS w, NOT bare AND run % 11 = 0 AS d, NOT bare AND run % 4 = 0 AS r, NOT bare AND run % 6 = 0 AS n FROM p WHERE NOT odd AND s <> 'other')
SELECT run, NULL AS name, NULL AS value, 'no-stand-in' AS problem FROM p WHERE s = 'other' UNION ALL SELECT run, NULL, NULL, 'not-an-object' FROM p WHERE odd AND s <> 'other'
UNION ALL SELECT run, 'title', CASE WHEN t = 's' THEN p_name WHEN t IS NULL AND s = 'ledger' THEN 'none' END, CASE WHEN t = 'n' THEN 'not-a-string' WHEN t IS NULL AND s = 'card' THEN 'missing' END FROM g
UNION ALL SELECT run, 'width', CASE WHEN w IS NULL THEN '640' WHEN w = 'n' THEN CAST(p_size AS VARCHAR) END, CASE WHEN w = 's' THEN 'not-a-integer' END FROM g WHERE s = 'card'
UNION ALL SELECT run, 'ratio', p_size || '.5', NULL FROM g WHERE s = 'card' AND r UNION ALL SELECT run, 'note', CASE WHEN n THEN '{{"a":1}}' ELSE '["x"]' END, NULL FROM g WHERE s = 'ledger'
UNION ALL SELECT run, 'depth', NULL, 'unknown' FROM g WHERE d UNION ALL SELECT run, 'note', NULL, 'unknown' FROM g WHERE s = 'card' AND n UNION ALL SELECT run, 'ratio', NULL, 'unknown' FROM g WHERE s = 'ledger' AND r UNION ALL SELECT run, 'width', NULL, 'unknown' FROM g WHERE s = 'ledger' AND w IS NOT NULL""",
    "ex_collect_artifacts": f"""WITH r AS (SELECT page_id AS run FROM pages), e AS (SELECT run, 0 AS place, {PATH(0)} AS path, 'text' AS kind, 3 AS cues, substr({ENDS}, CAST(run % {len(PATHS)} + 1 AS INT), 1) AS ends FROM r UNION ALL SELECT run, 1, {PATH(4)}, 'file', NULL, substr({ENDS}, CAST((run + 4) % {len(PATHS)} + 1 AS INT), 1) FROM r)
SELECT run, CAST(place AS BIGINT) AS place, path, kind, CAST(cues AS BIGINT) AS cues, CASE WHEN ends = 'x' THEN 'outside' WHEN ends = 'o' AND run % 4 <> 0 THEN 'kept' ELSE 'not-written' END AS status FROM e WHERE path <> ''""",
    "ex_run_command": f"""WITH {ops_sql()}, m AS (SELECT id, CASE WHEN CAST(substr(day, 9, 2) AS INT) % 2 = 0 THEN 'ok' WHEN ord % 9 = 0 THEN 'failed' WHEN ord % 10 = 0 THEN 'unavailable' ELSE 'ok' END AS status FROM ops WHERE user_id % 50 <> 0 OR day < '2024-01-15')
SELECT day, bool_or(NOT optional AND coalesce(status, '') <> 'ok') AS failed FROM ops LEFT JOIN m USING (id) GROUP BY day""",
}

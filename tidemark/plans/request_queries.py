"""Queries of requests to tools, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.inventory_queries import resolved
from tidemark.plans.inventory_sql import RES
from tidemark.plans.package_queries import STAND, catalogue
from tidemark.sources.tables import read
from tidemark.streaming import requests as R


def request_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests: a session a user, a line an event, told by its type; views of some days have odd forms."""
    day, n = F.date_format("ts", "yyyy-MM-dd"), F.col("event_id")
    call = F.concat(F.lit('{"jsonrpc": "2.0", "id": '), n, F.lit(', "method": "tools/call", "params": {"name": "'), "user_id", F.lit("/"), day, F.lit('", "arguments": {"inputs": {"b": 1, "a": "x"}}}}'))
    method = lambda m: F.concat(F.lit('{"id": "'), n, F.lit(f'", "method": "{m}"}}'))
    odd = F.when(n % 5 == 0, "{no json").when(n % 5 == 1, "[1]").when(n % 5 == 2, method("other")).when(n % 5 == 3, '{"method": "notifications/initialized"}').otherwise("  ")
    line = F.when(F.col("event_type") == "click", call).when(F.col("event_type") == "signup", method("initialize")).when(F.col("event_type") == "purchase", method("tools/list")).when(F.col("event_type") == "error", method("ping")).otherwise(odd)
    return read(spark, sf, "events").select(F.concat(F.lit("s"), "user_id").alias("session"), F.col("event_id").alias("place"), line.alias("line"))


def tools(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolved(spark, sf).where("profile = 'bare'")
    creds = rows.where("n % 3 = 0").select("id", F.array(F.struct(F.lit("k").alias("name"), F.lit("apikey").alias("kind"), F.concat(F.lit("KEY_"), F.col("user_id") % 2).alias("env"))).alias("credentials"))
    return R.tool_table(rows, catalogue(spark), creds)


def st_serve(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of whole sessions; calls before a session is open are refused."""
    out = R.answers(request_lines(spark, sf), tools(spark, sf), ("KEY_0",), strict=True)
    return out.select("session", "place", "number", "opened", "id", F.col("code").cast("long").alias("code"), "message", "is_error", F.md5("text").alias("text_md5"))


QUERIES = {"st_serve": st_serve}

LIST = lambda c: f"CASE WHEN len({c}) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform({c}, lambda x: '    \"' || x || '\"'), ',' || chr(10)) || chr(10) || '  ]' END"
LINES = [
    "'{'", "'  \"binding\": \"script\",'", f"'  \"deferred_gates\": ' || {LIST('deferred_gates')} || ','", "'  \"effect\": \"' || effect || '\",'", "'  \"executed\": false,'", f"'  \"gates\": ' || {LIST('gates')} || ','", "'  \"inputs\": {'", "'    \"a\": \"x\",'", "'    \"b\": 1'", "'  },'",
    f"'  \"missing_env\": ' || {LIST('missing_env')} || ','", "'  \"operation\": \"' || id || '\",'", f"'  \"requires\": ' || {LIST('requires')} || ','", "'  \"stage\": \"' || stage || '\",'", "'  \"stand_in\": {'", "'    \"caveat\": \"' || caveat || '\",'", "'    \"does\": \"' || descr || '\",'", "'    \"fidelity\": ' || fidelity || ','", "'    \"id\": \"' || stand_in || '\"'", "'  }'", "'}'",
]
SQL = {
    "st_serve": f"""WITH {RES}, {STAND},
tool AS (SELECT r.id, md5(concat_ws(chr(10), {', '.join(LINES)})) AS text_md5, len(missing_env) > 0 AS lacks FROM (SELECT *, CASE WHEN n % 3 = 0 AND user_id % 2 = 1 THEN ['KEY_1'] ELSE CAST([] AS VARCHAR[]) END AS missing_env FROM res JOIN stand USING (stand_in) WHERE profile = 'bare' AND binding = 'script') r),
q AS (SELECT 's' || user_id AS session, event_id AS place, CASE event_type WHEN 'click' THEN 'call' WHEN 'signup' THEN 'initialize' WHEN 'purchase' THEN 'list' WHEN 'error' THEN 'ping' ELSE ['bad', 'odd', 'other', 'silent', 'none'][event_id % 5 + 1] END AS what, user_id || '/' || strftime(ts, '%Y-%m-%d') AS tool FROM events),
m AS (SELECT *, row_number() OVER o AS number, coalesce(bool_or(what = 'initialize') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS opened FROM q WHERE what <> 'none' WINDOW o AS (PARTITION BY session ORDER BY place)),
a AS (SELECT m.*, tool.id IS NOT NULL AS there, text_md5, lacks, what = 'call' AND NOT opened AND tool.id IS NOT NULL AS refused FROM m LEFT JOIN tool ON tool.id = m.tool AND what = 'call')
SELECT session, place, number, opened, CASE WHEN what = 'call' THEN CAST(place AS VARCHAR) WHEN what IN ('bad', 'odd') THEN NULL ELSE '"' || place || '"' END AS id,
 CAST(CASE WHEN what = 'bad' THEN -32700 WHEN what = 'odd' THEN -32600 WHEN what = 'other' THEN -32601 WHEN refused THEN -32002 WHEN what = 'call' AND NOT there THEN -32602 END AS BIGINT) AS code,
 CASE WHEN what = 'bad' THEN 'parse error' WHEN what = 'odd' THEN 'invalid request' WHEN what = 'other' THEN 'method not found: other' WHEN refused THEN 'the session isn''t open' WHEN what = 'call' AND NOT there THEN 'unknown tool: ' || tool END AS message,
 there AND lacks AND NOT refused AS is_error, CASE WHEN NOT refused THEN text_md5 END AS text_md5 FROM a WHERE what <> 'silent'""",
}

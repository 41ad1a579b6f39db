"""Call sites of Python files (T1): calls as rows, matched with ordered effect patterns, kept where the file's entry reaches them.

``ast`` only turns a file into rows of calls and of functions that it defines. Which pattern a call matches, which
functions are reached and which calls stay is settled by joins.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.repos import of

#: ``scope`` is the top-level function around a call ('' for the module and for class bodies), ``ord`` the order of the walk.
CALL = "repo string, rel string, line int, ord int, func string, verb string, arg0 string, arg0_read boolean, mode string, method string, local boolean, scope string"
DEPTH = 3

# Beginnings and calls that tell a reading statement.
READ_WORDS, READ_CALLS = ("select", "with", "show", "describe", "explain", "pragma"), ("select", "text", "query")
# Modes that open a file for writing.
WRITE_MODES = ("w", "a", "x", "wb", "ab", "xb", "w+", "a+", "r+")
# Effect patterns in the order in which they are tried: id, functions, modules, further test, capability, effect.
HTTP = "requests httpx aiohttp urllib3 urllib session client http api resp response"
PATTERNS = [
    ("file-write-open", "open", "", "write-mode", "file.write", "effectful-local"),
    ("file-read-open", "open", "", "no-write-mode", "file.read", "read-local"),
    ("pathlib-write", "write_text write_bytes touch unlink rmdir rename replace mkdir makedirs", "", "", "file.write", "effectful-local"),
    ("pathlib-read", "read_text read_bytes iterdir rglob glob", "", "", "file.read", "read-local"),
    ("subprocess-exec", "run call check_call check_output Popen system popen execv spawn spawnv", "subprocess os", "", "shell.exec", "effectful-local"),
    ("http-mutating", "post put patch delete", HTTP, "", "http.request", "effectful-external"),
    ("http-reading", "get head options", HTTP, "", "http.request", "read-external"),
    ("http-request-generic", "request", "requests httpx aiohttp urllib3", "", "http.request", "effectful-external"),
    ("db-session-write", "commit flush add_all bulk_save_objects upsert save insert_one update_one delete_one delete_many", "", "", "data.write", "effectful-external"),
    ("db-session-mutate", "add delete merge update", "session db conn cursor repo repository store", "", "data.write", "effectful-external"),
    ("sql-select", "select", "", "", "data.query", "read-external"),
    ("db-read", "fetchall fetchone fetchmany scalar scalars find_one aggregate distinct", "", "", "data.query", "read-external"),
    ("object-storage", "upload_file upload_fileobj put_object download_file download_fileobj get_object upload_blob download_blob put_blob", "", "", "storage.object", "effectful-external"),
    ("queue-send", "delay apply_async send_task publish_message enqueue produce dispatch_task send_message_to_queue", "", "", "queue.publish", "effectful-external"),
    ("cache-set", "setex hset hmset lpush rpush sadd zadd expire setnx", "", "", "cache.write", "effectful-external"),
    ("cache-get", "hget hgetall lrange smembers zrange mget exists", "", "", "cache.read", "read-external"),
    ("payment", "charge capture refund create_payment_intent create_charge", "", "", "payment.charge", "effectful-external"),
    ("payment-resource", "create capture refund retrieve update", "stripe payment payments billing charge charges", "", "payment.charge", "effectful-external"),
    ("db-execute-read", "execute executemany", "session cursor conn connection db engine", "arg0-read", "data.query", "read-external"),
    ("notify", "sendmail send_email send_sms sendgrid_send messages_create", "", "", "notify.message", "effectful-external"),
    ("browser", "goto new_page screenshot fill press_key", "", "", "browser.automate", "effectful-external"),
    ("media-encode", "write_videofile write_audiofile write_gif concat overlay encode_video", "", "", "media.assemble", "effectful-local"),
    ("env-secret", "getenv environ load_dotenv", "os dotenv", "", "secret.read", "read-local"),
    ("scheduler", "add_job periodic_task crontab_schedule cron_schedule", "", "", "schedule.cron", "effectful-external"),
    ("git-op", "clone_from create_tag checkout pull fetch", "git pygit2 subprocess", "", "git.op", "effectful-local"),
]
# Names that are no effect when called without a module.
PLUMBING = (
    "print len str int float format join append extend update keys values items debug info warning error exception critical log echo "
    "secho style rule confirm prompt read close raise_for_status json get set add execute filter map sorted list dict setdefault strip "
    "split lower upper replace"
).split()


def dotted(node: ast.AST) -> str:
    """a.b.c of names and attributes; '' where the chain begins with anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def text_of(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def arg0_read(call: ast.Call) -> bool:
    """The first argument is a reading statement, or a call that builds one."""
    first = call.args[0] if call.args else None
    if isinstance(first, ast.Call):
        return dotted(first.func).rpartition(".")[2] in READ_CALLS
    return (text_of(first) or "").strip().lower().startswith(READ_WORDS)


def keyword(call: ast.Call, *names: str) -> str | None:
    return next((text_of(k.value) for k in call.keywords if k.arg in names), None)


def open_mode(call: ast.Call) -> str | None:
    return text_of(call.args[1]) if len(call.args) > 1 else keyword(call, "mode")


def python_call_rows(text: str) -> Iterator[tuple]:
    """The fields of CALL from ``line`` on, for every call with a dotted name; none where the file doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    functions = {n.name: n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    place = 0
    for scope, top in [("", n) for n in tree.body if n not in functions.values() and not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] + list(functions.items()):
        for node in ast.walk(top):
            if isinstance(node, ast.Call) and (name := dotted(node.func)):
                verb = name.rpartition(".")[2]
                method = keyword(node, "method", "verb")
                yield node.lineno, place, name, verb, text_of(node.args[0]) if node.args else None, arg0_read(node), open_mode(node) if verb == "open" else None, method and method.upper(), name in functions, scope
                place += 1


def python_calls(files: DataFrame) -> DataFrame:
    """CALL rows of all Python files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, rel, *x) for repo, rel, text in zip(b.repo, b.rel, b.text, strict=True) for x in python_call_rows(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CALL.split(", ")]).astype({"line": "Int32", "ord": "Int32"})

    return of(files, "python").where(F.col("rel").endswith(".py") & F.contains("text", F.lit("("))).select("repo", "rel", "text").mapInPandas(run, CALL)


def pattern_table(spark) -> DataFrame:
    """The patterns that a function's name may match, in order: key, patterns (id, modules, test, capability, effect)."""
    words = lambda x: F.array(*map(F.lit, x.split())) if x else F.array().cast("array<string>")
    rows = [
        F.struct(F.lit(i).alias("place"), F.lit(p).alias("pattern"), words(f).alias("funcs"), words(m).alias("modules"), F.lit(t).alias("test"), F.lit(c).alias("capability"), F.lit(e).alias("effect"))
        for i, (p, f, m, t, c, e) in enumerate(PATTERNS)
    ]
    table = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x", F.explode("x.funcs").alias("key"))
    return table.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("x.place", "x.pattern", "x.modules", "x.test", "x.capability", "x.effect"))).alias("patterns"))


def matched(calls: DataFrame) -> DataFrame:
    """Calls with capability, effect and pattern of the first pattern they match; null where they match none. Moves no row."""
    module = F.regexp_extract("func", r"^(.*)\.[^.]*$", 1)
    asked = calls.withColumn("_module", module).join(F.broadcast(pattern_table(calls.sparkSession)), F.col("verb") == F.col("key"), "left")  # a row a name
    writes = F.coalesce(F.col("mode").isin(*WRITE_MODES), F.lit(False))

    def holds(p):
        of_module = (F.size(p["modules"]) == 0) | F.exists(p["modules"], lambda m: (F.col("_module") == m) | F.col("_module").startswith(F.concat(m, F.lit("."))))
        test = F.when(p["test"] == "write-mode", writes).when(p["test"] == "no-write-mode", ~writes).when(p["test"] == "arg0-read", F.col("arg0_read")).otherwise(True)
        return of_module & test

    bare = F.col("verb").isin(*PLUMBING) & (F.col("_module") == "")
    hit = F.when(~bare, F.try_element_at(F.filter("patterns", holds), F.lit(1)))
    return asked.withColumn("_hit", hit).select(*calls.columns, "_hit.capability", "_hit.effect", "_hit.pattern")


def visited(depth: int) -> Column:
    """Names that a depth-first walk from the module level ('') visits, over the column ``steps`` (scope, next, in the calls' order).

    A function is walked once, where it is met first; from ``depth`` functions deep no further one is entered. So a function met
    first on a long path can hide what it calls from a shorter one. One fold in another for each level.
    """

    def visit(seen: Column, name: Column, level: int) -> Column:
        grown = F.concat(seen, F.array(name))
        if level < depth:
            grown = F.aggregate(F.filter("steps", lambda s: s["scope"] == name), grown, lambda a, s: visit(a, s["next"], level + 1))
        return F.when(F.array_contains(seen, name), seen).otherwise(grown)

    return F.aggregate(F.filter("steps", lambda s: s["scope"] == ""), F.array(F.lit("")), lambda a, s: visit(a, s["next"], 1))


def effect_sites(calls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One site a line: repo, rel, line, capability, effect, pattern, detail.

    Calls of the module level and of the functions that a depth-first walk from it visits count; a call that matches a pattern ends
    its path. In a file where none of these calls matches, all calls in its top-level functions do. Of several matches on a line
    the first of the walk stays. Calls are gathered by file, whose size is bounded, in one shuffle.
    """
    step = F.when(F.col("capability").isNull(), F.struct("ord", "scope", F.col("func").alias("next")))
    hit = F.when(F.col("capability").isNotNull(), F.struct("ord", "line", "capability", "effect", "pattern", "func", "scope"))
    told = matched(calls).where("capability is not null or (local and instr(func, '.') = 0)")
    files = told.groupBy("repo", "rel").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.collect_list(hit).alias("hits")).where("size(hits) > 0")
    files = files.withColumn("seen", visited(depth)).withColumn("reached", F.filter("hits", lambda h: F.array_contains("seen", h["scope"])))
    hits = files.select("repo", "rel", F.explode(F.when(F.size("reached") > 0, F.col("reached")).otherwise(F.col("hits"))).alias("h")).select("repo", "rel", "h.*")
    origin = F.when(F.col("scope") == "", "module").otherwise(F.col("scope"))
    detail = F.concat(F.col("func"), F.lit(" matched "), F.col("pattern"), F.lit(" (via "), origin, F.lit(")"))
    best = F.min_by(F.struct("capability", "effect", "pattern", detail.alias("detail")), "ord")
    return hits.groupBy("repo", "rel", "line").agg(best.alias("x")).select("repo", "rel", "line", "x.*")

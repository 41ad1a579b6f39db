"""Declarations in source files (T0) as rows.

Each dialect reads one family of files and returns CANDIDATE rows: what is declared, where, the body's lines where there
is one, and what the declaration itself tells: capabilities, effect, trigger, inputs. Matches of regular expressions come
with their place and body from ``regexes.find``, which looks at each text once for all that a language declares; Python files go through ``ast`` in a small helper, as nothing in SQL can parse
them. ``register`` adds a dialect of one's own.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.regexes import Rule, find, group
from tidemark.sources.repos import basename, file_name, of, stem

CANDIDATE = ["repo", "rel", "line", "dialect", "kind", "op", "id", "name", "loc", "lo", "hi", "detail", "caps", "effect", "trigger", "inputs"]
PYTHON = "repo string, rel string, line int, dialect string, kind string, op string, label string, name string, lo int, hi int, detail string, inputs array<string>"


def line_rows(files: DataFrame, *carried: str) -> DataFrame:
    rows = files.where("text is not null").select("repo", "rel", *carried, F.posexplode(F.split("text", "\n")).alias("i", "text_line"))
    return rows.select("repo", "rel", *carried, (F.col("i") + 1).alias("line"), "text_line")


def strings(*values) -> Column:
    """An array of text columns or texts, without nulls."""
    return F.array_compact(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])) if values else F.array().cast("array<string>")


def declaration(dialect: str, kind, op: Column, *, id: Column, name: Column, detail: Column, caps: Column | None = None, effect=None, trigger="manual", loc: Column | None = None, body: bool = False, inputs: Column | None = None) -> Column:
    """What a row with rel, line (and lo, hi where ``body``) declares, as a struct; ``id`` is slugified, ``effect`` 'local' or 'external'."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    caps = strings() if caps is None else caps
    effects = {None: F.lit(None).cast("string"), "local": F.lit("effectful-local"), "external": F.lit("effectful-external")}
    told = {
        "dialect": F.lit(dialect), "kind": column(kind), "op": op, "id": T.slugify(id), "name": name, "loc": F.concat_ws(":", "rel", F.col("line").cast("string")) if loc is None else loc,
        "lo": F.col("lo") if body else F.lit(None).cast("int"), "hi": F.col("hi") if body else F.lit(None).cast("int"), "detail": detail, "caps": caps,
        "effect": F.when(F.size(caps) > 0, effects[effect]) if effect else effects[None], "trigger": column(trigger), "inputs": strings() if inputs is None else inputs,
    }
    return F.struct(*[v.alias(k) for k, v in told.items()])


def declared(rows: DataFrame, dialect: str, kind, op: Column, **told) -> DataFrame:
    """CANDIDATE rows: every row declares the same kind of thing."""
    return rows.select("repo", "rel", F.col("line").cast("int").alias("line"), declaration(dialect, kind, op, **told).alias("d")).select("repo", "rel", "line", "d.*")


def by_rule(rows: DataFrame, told: dict[str, Column | tuple[Column, Column]]) -> DataFrame:
    """CANDIDATE rows from matches: for each rule what it declares, with a condition where it doesn't always."""
    pairs = [(name, *(x if isinstance(x, tuple) else (F.lit(True), x))) for name, x in told.items()]
    chosen = reduce(lambda c, p: c.when((F.col("rule") == p[0]) & p[1], p[2]), pairs[1:], F.when((F.col("rule") == pairs[0][0]) & pairs[0][1], pairs[0][2]))
    return rows.withColumn("d", chosen).where("d is not null").select("repo", "rel", "line", "d.*")


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)


# ---------------------------------------------------------------- workflow files

MAKE_TARGET = r"(?m)^([A-Za-z0-9_][A-Za-z0-9_.\-/]*)\s*:(?!=)"


def make_targets(files: DataFrame) -> DataFrame:
    """``name:`` at the start of a line of a makefile; no special, pattern or variable targets."""
    made = of(files, "make").where(file_name(F.col("rel")).isin("Makefile", "makefile", "GNUmakefile") | F.col("rel").endswith(".mk"))
    rows = find(made, {"target": Rule(MAKE_TARGET)}).withColumn("t", group(1))
    t = F.col("t")
    return declared(rows, "make-target", "make-target", t, id=prefixed("make-", t), name=T.humanize(t), detail=prefixed("Make target ", t), caps=strings("shell.exec"), effect="local")


def package_scripts(files: DataFrame) -> DataFrame:
    """Keys of ``scripts`` in package.json."""
    rows = of(files, "json").where(file_name(F.col("rel")) == "package.json").select("repo", "rel", F.lit(1).alias("line"), F.explode(F.json_object_keys(F.get_json_object("text", "$.scripts"))).alias("s"))
    s = F.col("s")
    return declared(rows, "package-scripts", "npm-script", s, id=prefixed("script-", s), name=T.humanize(s), detail=prefixed("package.json script ", s), caps=strings("shell.exec"), effect="local", loc=F.concat("rel", F.lit(":scripts."), s))


def cron_lines(files: DataFrame) -> DataFrame:
    """Entries of crontabs: five fields or a named time, then a command, named by its first word."""
    name = basename(F.col("rel"))
    rows = line_rows(of(files, "cron", "other", "document").where(name.startswith("crontab") | name.endswith(".cron") | F.contains("rel", F.lit("/cron.d/"))))
    entry = r"^\s*(?:@(?:reboot|yearly|annually|monthly|weekly|daily|hourly|midnight)\b|(?:\S+\s+){4}\S+)\s+(\S+)"
    rows = rows.where(~F.col("text_line").rlike(r"^\s*(#|$)")).withColumn("c", F.regexp_extract("text_line", entry, 1)).where("c <> ''")
    c, slug = F.col("c"), T.slugify(prefixed("cron-", F.col("c")))
    id = F.when(slug == "", F.concat(F.lit("cron-entry-"), F.col("line"))).otherwise(slug)
    return declared(rows, "crontab", "crontab-entry", c, id=id, name=T.humanize(prefixed("cron ", c)), detail=prefixed("scheduled command ", c), caps=strings("shell.exec"), effect="local", trigger="scheduled")


def yaml_children(files: DataFrame, key: str, *carried: str) -> DataFrame:
    """Names one level below a top-level key: repo, rel, carried, line, op; and all lines of the block with the name above them.

    A child is a line indented like the first line under the key, up to the next top-level key. ``own`` tells children from
    the lines inside them.
    """
    rows = line_rows(files, *carried).where(~F.col("text_line").rlike(r"^\s*(#|$)"))
    above = Window.partitionBy("repo", "rel").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    top = F.regexp_extract("text_line", r"^[\"']?([A-Za-z0-9_.-]+)[\"']?\s*:", 1)
    rows = rows.withColumn("top", F.last(F.when(top != "", top), ignorenulls=True).over(above)).withColumn("indent", F.length(F.regexp_extract("text_line", r"^([ \t]*)", 1)))
    child = rows.where((F.col("top") == key) & (F.col("indent") > 0))
    least = child.groupBy("repo", "rel").agg(F.min_by("indent", "line").alias("least"))
    name = F.regexp_extract("text_line", r"^[ \t]+[\"']?([^\"':#\s][^\"':#]*?)[\"']?\s*:(?:\s|$)", 1)
    child = child.join(least, ["repo", "rel"]).withColumn("own", (F.col("indent") == F.col("least")) & (name != ""))
    return child.withColumn("op", name).withColumn("op_line", F.last(F.when(F.col("own"), F.col("line")), ignorenulls=True).over(above))


YAML = r"[.]ya?ml$"


def github_jobs(files: DataFrame) -> DataFrame:
    flows = of(files, "yaml").where(F.col("rel").startswith(".github/workflows/") & F.col("rel").rlike(YAML) & F.contains("text", F.lit("jobs:")))
    rows = yaml_children(flows.withColumn("timed", F.col("text").rlike(r"(?m)^\s+schedule\s*:")), "jobs", "timed").where("own")
    op = F.col("op")
    caps = strings("shell.exec", F.when(F.lower(op).rlike("deploy|release|ship|publish"), "deploy.op"))
    return declared(rows, "github-actions", "github-job", op, id=prefixed("job-", op), name=T.humanize(op), detail=prefixed("GitHub Actions job ", op), caps=caps, effect="local", trigger=F.when(F.col("timed"), "scheduled").otherwise("event"))


# What a service's image tells, and which capability a resource's type or kind declares (the first that fits).
IMAGE_CAPABILITIES = {
    "postgres": "data.write", "mysql": "data.write", "mariadb": "data.write", "mongo": "data.write", "redis": "cache.write", "memcached": "cache.write", "minio": "storage.object",
    "rabbitmq": "queue.publish", "kafka": "queue.publish", "nats": "queue.publish", "elasticsearch": "search.index", "opensearch": "search.index",
}
TERRAFORM_CAPABILITIES = {
    "s3": "storage.object", "bucket": "storage.object", "storage": "storage.object", "gcs": "storage.object", "blob": "storage.object", "filestore": "storage.object", "db_instance": "data.write",
    "rds": "data.write", "dynamodb": "data.write", "_sql": "data.write", "postgres": "data.write", "mysql": "data.write", "database": "data.write", "bigquery": "data.write", "spanner": "data.write",
    "redis": "cache.write", "elasticache": "cache.write", "memcache": "cache.write", "sqs": "queue.publish", "kinesis": "queue.publish", "pubsub": "queue.publish", "eventhub": "queue.publish",
    "sns": "notify.message", "ses": "notify.message", "lambda": "code.exec", "cloudfunctions": "code.exec", "cloudfunction": "code.exec", "batch": "code.exec", "instance": "code.exec",
    "kms": "secret.apikey", "secret": "secret.apikey", "vault": "secret.apikey", "ssm": "secret.apikey", "ecs": "container.op", "eks": "container.op", "container": "container.op",
    "docker": "container.op", "ecr": "container.op", "scheduler": "schedule.cron", "cron": "schedule.cron", "eventbridge": "schedule.cron", "cloudfront": "deploy.op", "cdn": "deploy.op",
    "api_gateway": "deploy.op", "apigateway": "deploy.op", "load_balancer": "deploy.op", "elasticsearch": "search.index", "opensearch": "search.index", "search": "search.index",
}
KUBERNETES_CAPABILITIES = {
    "deployment": "deploy.op", "statefulset": "deploy.op", "daemonset": "deploy.op", "replicaset": "deploy.op", "job": "deploy.op", "cronjob": "schedule.cron", "service": "deploy.op", "ingress": "deploy.op",
    "horizontalpodautoscaler": "deploy.op", "secret": "secret.apikey", "persistentvolumeclaim": "storage.object", "persistentvolume": "storage.object",
}
COMPOSE_NAMES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")


def compose_services(files: DataFrame) -> DataFrame:
    """Services with what the markers in their image tell."""
    block = yaml_children(of(files, "yaml").where(basename(F.col("rel")).isin(*COMPOSE_NAMES)), "services")
    value = F.lower(F.regexp_replace(F.trim(F.regexp_extract("text_line", r"^\s*image:\s*(.*)$", 1)), r"^[\"']+|[\"']+$", ""))
    images = block.where(~F.col("own") & F.col("text_line").rlike(r"^\s*image:")).groupBy("repo", "rel", "op_line").agg(F.min_by(value, "line").alias("image"))
    rows = block.where("own").join(images.withColumnRenamed("op_line", "line"), ["repo", "rel", "line"], "left").withColumn("image", F.coalesce("image", F.lit("")))
    op, image = F.col("op"), F.col("image")
    caps = strings("container.op", *[F.when(F.contains(image, F.lit(k)), c) for k, c in IMAGE_CAPABILITIES.items()])
    detail = F.concat(F.lit("compose service "), op, F.when(image != "", F.concat(F.lit(" ("), image, F.lit(")"))).otherwise(""))
    return declared(rows, "compose-services", "compose-service", op, id=prefixed("svc-", op), name=T.humanize(op), detail=detail, caps=caps, effect="local")


def systemd_units(files: DataFrame) -> DataFrame:
    units = of(files, "unit").where(F.col("rel").rlike(r"[.](service|timer|socket)$") & F.contains("text", F.lit("[Unit]"))).withColumn("line", F.lit(1))
    rows = units.withColumn("suffix", F.substring_index("rel", ".", -1)).withColumn("unit", stem(F.col("rel")))
    unit, suffix = F.col("unit"), F.col("suffix")
    starts = (suffix == "service") & F.contains("text", F.lit("ExecStart="))
    caps = F.when(suffix == "timer", strings("schedule.cron")).when(starts, strings("shell.exec")).otherwise(strings())
    detail = F.concat(F.lit("systemd "), suffix, F.lit(" unit "), unit)
    return declared(rows, "systemd-unit", prefixed("systemd-", suffix), unit, id=prefixed("unit-", unit), name=T.humanize(unit), detail=detail, caps=caps, effect="local", trigger=F.when(suffix == "timer", "scheduled").otherwise("manual"))


# ---------------------------------------------------------------- infrastructure files

TERRAFORM = r'(?m)^\s*(resource|module|data)\s+(?:"([^"]+)"\s+)?"([^"]+)"'


def first_marker(told: Column, table: dict[str, str]) -> Column:
    """The capability of the first marker in order that a lower-cased text holds, as an array of one or none."""
    marker = reduce(lambda c, kv: c.when(F.contains(told, F.lit(kv[0])), kv[1]), list(table.items())[1:], F.when(F.contains(told, F.lit(next(iter(table)))), next(iter(table.values()))))
    return strings(marker)


def terraform_blocks(files: DataFrame) -> DataFrame:
    rows = find(of(files, "terraform").where(F.col("rel").endswith(".tf")), {"block": Rule(TERRAFORM)})
    rows = rows.select("repo", "rel", "line", group(1).alias("block"), group(2).alias("type"), group(3).alias("label"))
    block, typed = F.col("block"), F.trim(F.concat_ws(" ", "type", "label"))
    caps = F.when(block == "module", strings()).otherwise(first_marker(F.lower("type"), TERRAFORM_CAPABILITIES))
    return declared(rows, "terraform", prefixed("terraform-", block), typed, id=prefixed("tf-", typed), name=T.humanize(typed), detail=F.concat(F.lit("Terraform "), block, F.lit(" "), typed), caps=caps, effect="external")


def top_scalar(text: Column, key: str) -> Column:
    """The value of the first top-level ``key:`` line of a YAML-like text: '' where it has none, null without such a line."""
    line = rf"(?m)^[\"']?{key}[\"']?[ \t]*:(?=\s|$)[ \t]*(.*)$"
    value = F.regexp_replace(F.trim(F.regexp_extract(text, line, 1)), r"^[\"']+|[\"']+$", "")
    return F.when(text.rlike(line), F.when(value.startswith("#"), "").otherwise(value))


def has_top_key(text: Column, key: str) -> Column:
    return top_scalar(text, key).isNotNull()


def kubernetes_objects(files: DataFrame) -> DataFrame:
    """One object a file: its first top-level kind, and the name under ``metadata`` or else the file's."""
    rows = of(files, "yaml").where(F.col("rel").rlike(YAML) & F.contains("text", F.lit("kind"))).withColumn("k", top_scalar(F.col("text"), "kind")).where("k <> ''").withColumn("line", F.lit(1))
    named = F.regexp_replace(F.trim(F.regexp_extract("text", r"(?m)^metadata:\n(?:(?:[ \t].*|#.*|)\n)*?[ \t]+name:[ \t]*(.*)$", 1)), r"^[\"']+|[\"']+$", "")
    rows = rows.withColumn("object", F.when(named != "", named).otherwise(stem(F.col("rel"))))
    k, o, low = F.col("k"), F.col("object"), F.lower("k")
    caps = strings(F.create_map(*[F.lit(x) for kv in KUBERNETES_CAPABILITIES.items() for x in kv])[low])
    return declared(rows, "kubernetes", prefixed("kubernetes-", low), F.concat_ws("/", k, o), id=F.concat_ws("-", F.lit("k8s"), k, o), name=T.humanize(F.concat_ws(" ", k, o)), detail=F.concat_ws(" ", F.lit("Kubernetes"), k, o), caps=caps, effect="external", trigger=F.when(low == "cronjob", "scheduled").otherwise("manual"))


def ansible_plays(files: DataFrame) -> DataFrame:
    """``hosts:`` plays, named by the ``name:`` right above where only comments and blank lines come between; and task files."""
    books = of(files, "yaml").where(F.col("rel").rlike(YAML) & ~F.coalesce(has_top_key(F.col("text"), "kind"), F.lit(False)))
    hosts = r"(?m)^\s*-?\s*hosts\s*:\s*\S"
    rows = line_rows(books.where(F.col("text").rlike(hosts))).where(~F.col("text_line").rlike(r"^\s*(#|$)"))
    before = F.lag("text_line").over(Window.partitionBy("repo", "rel").orderBy("line"))
    named = F.regexp_replace(F.regexp_extract(before, r"^\s*-?\s*name\s*:\s*(\S.*?)\s*$", 1), r"^[\"']+|[\"']+$", "")
    plays = rows.withColumn("label", named).where(F.col("text_line").rlike(hosts))
    plays = plays.withColumn("label", F.when(F.col("label") != "", F.col("label")).otherwise(F.concat_ws("-", stem(F.col("rel")), F.col("line").cast("string")))).withColumn("play", F.lit("play"))
    tasks = books.where(~F.col("text").rlike(hosts) & F.col("text").rlike(r"(?m)^\s*(?:- )?tasks\s*:") & F.contains("rel", F.lit("/tasks/")))
    tasks = tasks.select("repo", "rel", F.lit(1).alias("line"), stem(F.col("rel")).alias("label"), F.lit("tasks").alias("play"))
    rows = plays.select("repo", "rel", "line", "label", "play").unionByName(tasks)
    label, play = F.col("label"), F.col("play")
    return declared(rows, "ansible", prefixed("ansible-", play), label, id=prefixed("play-", label), name=T.humanize(label), detail=F.concat(F.lit("Ansible "), play, F.lit(" "), label), caps=strings("shell.exec"), effect="local")


# ---------------------------------------------------------------- documents that describe services

METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
SERVICE = r"(?m)^\s*service\s+(\w+)\s*\{"
RPC = r"(?m)^\s*rpc\s+(\w+)\s*\("


def proto_calls(files: DataFrame) -> DataFrame:
    """``rpc X(`` with the nearest service above it: an as-of window by line."""
    rows = line_rows(of(files, "proto").where(F.col("rel").endswith(".proto") & F.contains("text", F.lit("rpc"))))
    service, call = (F.regexp_extract("text_line", p, 1) for p in (SERVICE, RPC))
    above = Window.partitionBy("repo", "rel").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("repo", "rel", "line", F.last(F.when(service != "", service), ignorenulls=True).over(above).alias("service"), call.alias("call")).where("call <> ''")
    dots, words = F.concat_ws(".", "service", "call"), F.concat_ws(" ", "service", "call")
    return declared(rows, "proto-service", "proto-rpc", dots, id=F.concat_ws("-", F.coalesce("service", F.lit("rpc")), "call"), name=T.humanize(words), detail=prefixed("gRPC method ", dots))


def routed(dialect: str, kind, method: Column, path: Column, detail: Column | None = None, body: bool = False) -> Column:
    """A method and path as an operation named by both."""
    op = F.concat_ws(" ", method, path)
    return declaration(dialect, kind, op, id=F.concat_ws("-", method, path), name=op, detail=F.concat_ws(" ", method, F.lit("route"), path) if detail is None else detail, body=body)


def openapi_operations(files: DataFrame) -> DataFrame:
    """Path and method of each operation of an OpenAPI document, JSON or YAML."""
    name = basename(F.col("rel"))
    specs = of(files, "json", "yaml").where(name.rlike(r"(openapi|swagger).*[.](json|ya?ml)$"))
    paths = F.from_json(F.get_json_object("text", "$.paths"), "map<string,map<string,string>>")
    listed = specs.where(name.endswith(".json")).select("repo", "rel", F.split("text", "\n").alias("lines"), F.explode(paths).alias("path", "methods"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.concat(F.lit('"'), F.col("path"), F.lit('"')))), F.lit(True))
    listed = listed.select("repo", "rel", F.greatest(at, F.lit(1)).cast("int").alias("line"), "path", F.explode(F.map_keys("methods")).alias("method"))

    head = F.col("text_line").rlike(r"^\s*/.*:\s*$")
    rows = line_rows(specs.where(~name.endswith(".json") & (has_top_key(F.col("text"), "openapi") | has_top_key(F.col("text"), "swagger")))).where(~F.col("text_line").rlike(r"^\s*(#|$)"))
    rows = rows.withColumn("indent", F.length(F.regexp_extract("text_line", r"^( *)", 1))).withColumn("is_path", head).withColumn("bare", F.trim("text_line"))
    file = Window.partitionBy("repo", "rel")
    start = F.min(F.when(F.col("bare").startswith("paths:"), F.col("line"))).over(file)
    rows = rows.withColumn("start", start).where("line > start")
    rows = rows.withColumn("first", F.min(F.when(F.col("is_path"), F.struct("line", "indent"))).over(file)).where("line >= first.line").withColumn("deep", F.col("first.indent"))
    rows = rows.withColumn("stop", F.min(F.when((F.col("indent") <= F.col("deep")) & ~F.col("is_path"), F.col("line"))).over(file)).where("stop is null or line < stop")
    above = file.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.last(F.when(F.col("is_path") & (F.col("indent") <= F.col("deep")), F.struct("line", "bare")), ignorenulls=True).over(above)).where("line > p.line")
    inner = F.min(F.struct("line", "indent")).over(Window.partitionBy("repo", "rel", "p.line"))
    rows = rows.withColumn("inner", inner).where("indent = inner.indent and bare like '%:'")
    drawn = rows.select("repo", "rel", "line", F.expr("substring(p.bare, 1, length(p.bare) - 1)").alias("path"), F.expr("substring(bare, 1, length(bare) - 1)").alias("method"))
    both = listed.unionByName(drawn).where(F.lower("method").isin(*METHODS))
    method = F.upper("method")
    told = routed("openapi-spec", "openapi-operation", method, F.col("path"), detail=F.concat_ws(" ", F.lit("OpenAPI operation"), method, "path"))
    return both.select("repo", "rel", F.col("line").cast("int").alias("line"), told.alias("d")).select("repo", "rel", "line", "d.*")


def tool_manifests(files: DataFrame) -> DataFrame:
    """Distinct names of ``tools`` (or of the top-level list) in a JSON manifest."""
    name = basename(F.col("rel"))
    rows = of(files, "json").where(name.rlike("tool|mcp|manifest|capabilities|schema|registry") & name.endswith(".json") & F.contains("text", F.lit("tools")))
    rows = rows.select("repo", "rel", F.lit(1).alias("line"), F.explode(T.tool_names(F.col("text"))).alias("t"))
    t = F.col("t")
    return declared(rows, "tool-manifest", "tool-manifest", t, id=prefixed("tool-", t), name=T.humanize(t), detail=F.concat(F.lit("tool "), t, F.lit(" declared in a manifest")), loc=F.concat("rel", F.lit(":tools."), t))


# ---------------------------------------------------------------- braced languages

# Names of objects that carry routes.
ROUTE_OBJECTS = "app application router routes api bp blueprint server web public admin fastapi flask".split()
GO_ROUTE_OBJECTS = "r router e app api g group mux srv server engine fiber public admin v1 routes".split()
JS_ROUTE = r"\b([A-Za-z_$][\w$]*)\s*\.\s*(get|post|put|patch|delete|head|options|all)\s*\(\s*(['\"`])([^'\"`]+)\3"
NEST_ROUTE = r"@(Get|Post|Put|Patch|Delete|Head|Options|All)\s*\(\s*(?:(['\"`])([^'\"`]*)\2)?"
GO_FUNC = r"(?m)^func\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*\(([^)]*)\)\s*([^{]{0,120})"
GO_HANDLE = r'([A-Za-z_]\w*)\.Handle(?:Func)?\(\s*"([^"]*)"'
GO_ROUTE = r'([A-Za-z_]\w*)\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|TRACE|CONNECT|Any|Get|Post|Put|Patch|Delete|Head|Options|All)\s*\(\s*"([^"]+)"'
COBRA = r"&cobra\.Command\s*\{"


# What declarations of these languages are told as; {} stands for what is declared.
TOLD = {
    "go-main": "main entry point",
    "go-func": "exported command function {}()",
    "go-http": "net/http handler for {}",
    "java-main": "public static void main entry point",
    "kotlin-main": "Kotlin main entry point",
    "rust-main": "main entry point",
    "rust-async-main": "async main entry point",
}


def tell(kind: str, what: Column | None = None) -> Column:
    ahead, _, behind = TOLD[kind].partition("{}")
    return F.lit(ahead) if what is None else F.concat(F.lit(ahead), what, F.lit(behind))


def shell() -> dict:
    return {"caps": strings("shell.exec"), "effect": "local"}


def titled(c: Column) -> Column:
    return T.humanize(T.split_camel(c))


JS_RULES = {"call": Rule(JS_ROUTE, body="end"), "nest": Rule(NEST_ROUTE, body="end")}


def web_js(files: DataFrame) -> DataFrame:
    """Routes of Express and Fastify (of known receivers) and Nest decorators, with the braces after them."""
    code = of(files, "javascript").where(F.col("rel").rlike(r"[.](js|mjs|cjs|jsx|ts|tsx)$") & F.col("text").rlike(r"[.]get\(|[.]post\(|@Get|@Post|@Put"))
    path = F.when(group(3) == "", "/").otherwise(group(3))
    return by_rule(find(code, JS_RULES, "js"), {
        "call": (group(1).isin(*ROUTE_OBJECTS), routed("web-js", "route-call", F.upper(group(2)), group(4), body=True)),
        "nest": routed("web-js", "nest-decorator", F.upper(group(1)), path, body=True),
    })


GO_RULES = {
    "func": Rule(GO_FUNC, body="start"),
    "cobra": Rule(COBRA, body="start", inside=(r'\bUse\s*:\s*"\s*([^"\s]+)', r'\bShort\s*:\s*"([^"]*)"')),
    "handle": Rule(GO_HANDLE),
    "route": Rule(GO_ROUTE),
}


def go_declarations(files: DataFrame) -> DataFrame:
    """main, exported command functions, cobra commands, net/http handlers and router calls."""
    code = of(files, "go").where(F.col("rel").endswith(".go"))
    f, params = group(1), F.trim(group(2))
    is_main = f == "main"
    command = f.rlike("^[A-Z]") & ~F.contains(group(3), F.lit("*cobra.Command")) & ((params == "") | params.startswith("cmd *cobra.Command"))
    use, short = F.coalesce(group(0, "inner"), F.lit("")), group(1, "inner")
    path, at = group(2), F.when(group(2) == "", "/").otherwise(group(2))
    http = F.when(T.slugify(path) == "", prefixed("http-", group(1))).otherwise(prefixed("http-", path))
    summary = F.concat(F.lit("cobra command "), use, F.when(short != "", F.concat(F.lit(" — "), short)).otherwise(""))
    return by_rule(find(code, GO_RULES, "go"), {
        "func": (is_main | command, declaration("go", F.when(is_main, "go-main").otherwise("go-func"), f, id=f, name=T.humanize(f), detail=F.when(is_main, tell("go-main")).otherwise(tell("go-func", f)), body=True, **shell())),
        "cobra": (use != "", declaration("go", "cobra-command", use, id=use, name=T.humanize(use), detail=summary, body=True, **shell())),
        "handle": declaration("go", "http-handle", prefixed("HTTP ", path), id=http, name=prefixed("HTTP ", path), detail=tell("go-http", at)),
        "route": (group(1).isin(*GO_ROUTE_OBJECTS) & group(3).startswith("/"), routed("go", "router-route", F.upper(group(2)), group(3))),
    })


MAPPING = r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b[ \t]*(?:\(([^)]*)\))?"
LIFECYCLE = r"@(Scheduled|KafkaListener|JmsListener|EventListener)\b[ \t]*(?:\(([^)]*)\))?"
CLASS = r"\b(?:class|interface|enum|record|object)\s+([A-Za-z_]\w*)"
JAVA_MAIN = r"\bstatic\s+void\s+main\s*\(\s*String\s*(?:\[\s*\]|\.\.\.)\s*[A-Za-z_]\w*\s*\)"
KOTLIN_MAIN = r"(?m)^[ \t]*fun\s+main\s*\("
#: What stands between an annotation and the end of the head it belongs to.
HEAD = r"\A([^{};]*)([{};])"
JVM_RULES = {
    "class": Rule(CLASS, before=400),
    "mapping": Rule(MAPPING, then=HEAD, window=1400, body="start"),
    "lifecycle": Rule(LIFECYCLE, then=HEAD, window=1400, body="start"),
    "java-main": Rule(JAVA_MAIN, body="start"),
    "kotlin-main": Rule(KOTLIN_MAIN, body="start"),
}


def annotation_path(args: Column) -> Column:
    """The first string of an annotation's arguments, with a slash before it."""
    path = F.regexp_extract(F.coalesce(args, F.lit("")), r'"([^"]*)"', 1)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def jvm_declarations(files: DataFrame) -> DataFrame:
    """Spring mappings under their class's path, schedules, listeners and main functions of Java and Kotlin.

    An annotation belongs to the method whose head follows it, and to the class above it, with the annotations right before that
    class: one window over the matches of a file.
    """
    rows = find(of(files, "jvm").where(F.col("rel").rlike(r"[.](java|kt)$")), JVM_RULES, "jvm")
    before = F.regexp_extract("ahead", r"([^{};]*)$", 1)
    last = F.try_element_at(F.regexp_extract_all(before, F.lit(MAPPING), F.lit(0)), F.lit(-1))
    base = F.when(last.startswith("@Request"), annotation_path(F.regexp_extract(last, MAPPING, 2))).otherwise("")
    context = F.when(F.col("rule") == "class", F.struct(before.rlike(r"@(?:RestController|Controller)\b").alias("controller"), base.alias("base")))
    above = Window.partitionBy("repo", "rel").orderBy("start", F.col("rule") != "class").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("context", F.last(context, ignorenulls=True).over(above)).where("rule <> 'class'")

    head, stop = group(1, "t"), group(2, "t")
    member = F.try_element_at(F.regexp_extract_all(head, F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)), F.lit(-1))
    is_member = F.col("t").isNotNull() & ((stop != "{") | (F.length(head) <= 400)) & ~head.rlike(CLASS) & member.isNotNull()
    opens = F.col("rule").isin("mapping", "lifecycle") & (F.coalesce(stop, F.lit("")) != "{")
    rows = rows.withColumns({"member": member, "is_member": is_member}).withColumns({c: F.when(~opens, F.col(c)) for c in ("lo", "hi")})

    ann, args, member = group(1), group(2), F.col("member")
    base, own = F.coalesce("context.base", F.lit("")), annotation_path(args)
    path = F.when(base.isin("", "/"), own).when(own == "/", base).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(own, F.lit("/"))))
    asked = F.regexp_extract(args, r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)", 1)
    method = F.when(ann != "Request", F.upper(ann)).when(asked != "", asked).otherwise("ANY")
    controller = F.coalesce("context.controller", F.lit(False))
    detail = F.concat_ws(" ", F.when(controller, "Spring controller").otherwise("Spring"), method, F.lit("route"), path)
    label, short = T.split_camel(member), F.lower(F.regexp_replace(ann, "Listener$", ""))
    timed = ann == "Scheduled"
    caps = F.when(timed, strings("schedule.cron")).when(ann == "EventListener", strings()).otherwise(strings("queue.consume"))
    kind = F.when(timed, "spring-scheduled").otherwise(F.concat(F.lit("spring-"), short, F.lit("-listener")))
    main = lambda kind: declaration("jvm", kind, F.lit("main"), id=F.lit("main"), name=F.lit("Main"), detail=tell(kind), body=True, **shell())
    return by_rule(rows, {
        "mapping": (F.col("is_member"), routed("jvm", F.when(controller, "spring-controller-route").otherwise("spring-route"), method, path, detail=detail, body=True)),
        "lifecycle": (F.col("is_member"), declaration("jvm", kind, F.concat_ws(" ", short, label), id=F.concat_ws("-", short, label), name=T.humanize(label), detail=F.concat(F.lit("@"), ann, F.lit(" on "), member, F.lit("()")), caps=caps, effect="external", trigger=F.when(timed, "scheduled").otherwise("manual"), body=True)),
        "java-main": main("java-main"),
        "kotlin-main": main("kotlin-main"),
    })


DERIVE = r"#\[\s*derive\s*\(([^)]*)\)\s*\]"
RUST_ITEM = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(struct|enum)\s+([A-Za-z_]\w*)"
COMMAND_ATTR = r"#\[\s*command\s*\(([^\]]*)\)\s*\]"
RUST_ROUTE = r"#\[\s*(get|post|put|patch|delete|head|options)\s*\(\s*([\"'])([^\"']*)\2"
RUST_FN = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:const\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+([A-Za-z_]\w*)"
AXUM_ROUTE = r"\.route\(\s*([\"'])([^\"']+)\1\s*,\s*([^;\n]{0,300})"
AXUM_SERVICE = r"\.service\(\s*([A-Za-z_]\w*)\s*\)"
RUST_MAIN = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+main\s*\("


def enum_variants(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Variants in the lines of an enum's body: place of the line, name, summary; attributes since the variant before count."""
    given = {"name": "", "about": ""}
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare or bare.startswith("//"):
            continue
        told = re.match(r"(?:#\[[^\]]*\]\s*)*", bare)[0]
        for key in given:
            if m := re.search(rf'#\[command[^\]]*\b{key}\s*=\s*"([^"]*)"', told):
                given[key] = m[1] or given[key]
        if m := re.match(r"([A-Z]\w*)\s*(?:[({,]|$)", bare[len(told) :]):
            yield i, [m[1], given["name"] or m[1], given["about"]]
            given = dict.fromkeys(given, "")


RUST_RULES = {
    "derive": Rule(DERIVE, then=RUST_ITEM, window=4000, before=400, body="then", each=enum_variants),
    "marked": Rule(RUST_ROUTE, then=RUST_FN, window=4000, body="then"),
    "axum": Rule(AXUM_ROUTE),
    "service": Rule(AXUM_SERVICE),
    "main": Rule(RUST_MAIN, before=200, body="start"),
}


def command_name(attributes: Column) -> Column:
    """The name that the last #[command(...)] of a stretch gives; '' without one."""
    last = F.try_element_at(F.regexp_extract_all(attributes, F.lit(COMMAND_ATTR), F.lit(1)), F.lit(-1))
    return F.coalesce(F.regexp_extract(last, r'\bname\s*=\s*"([^"]*)"', 1), F.lit(""))


def rust_declarations(files: DataFrame) -> DataFrame:
    """clap parsers and subcommands, route attributes, axum routes and services, main functions, Cargo bins and members."""
    rows = find(of(files, "rust").where(F.col("rel").endswith(".rs")), RUST_RULES, "rust")
    derives = lambda what, name, of="g": F.coalesce(F.col("gap") <= 400, F.lit(False)) & (group(1, "t") == what) & F.array_contains(F.transform(F.split(group(1, of), ","), lambda x: F.trim(x)), name)
    given = F.when(F.col("between").rlike(COMMAND_ATTR), command_name(F.col("between"))).otherwise(command_name(F.col("ahead")))
    label = F.when(given != "", given).otherwise(group(2, "t"))
    variant, about = group(1), group(2)
    sub = declaration("rust", "clap-subcommand", variant, id=variant, name=titled(variant), detail=F.concat(F.lit("clap subcommand "), variant, F.when(about != "", F.concat(F.lit(" — "), about)).otherwise("")), **shell())
    method, path = F.upper(group(1)), F.when(group(3) == "", "/").otherwise(group(3))
    handled = F.concat(method, F.lit(" route "), path, F.lit(" handled by "), group(1, "t"), F.lit("()"))
    asked = F.array_distinct(F.transform(F.regexp_extract_all(group(3), F.lit(r"\b(get|post|put|patch|delete|head|options|trace)\s*\("), F.lit(1)), F.upper))
    rows = rows.withColumn("asked", F.explode(F.when(F.col("rule") == "axum", asked).otherwise(strings(""))))
    is_async = F.col("ahead").rlike(r"#\[\s*tokio::main\s*\]")
    own, crate = stem(F.col("rel")), F.regexp_extract("rel", r"(?:^|/)([^/]+)/src/", 1)
    id = F.when(own != "main", F.concat_ws("-", F.lit("main"), own)).when(crate != "", F.concat_ws("-", crate, F.lit("main"))).otherwise("main")
    out = by_rule(rows, {
        "derive": (derives("struct", "Parser"), declaration("rust", "clap-parser", label, id=label, name=titled(label), detail=prefixed("clap Parser ", group(2, "t")), **shell())),
        "derive.each": (derives("enum", "Subcommand", "inner"), sub),
        "marked": (F.col("gap") <= 2000, routed("rust", "route-attribute", method, path, detail=handled, body=True)),
        "axum": routed("rust", "axum-route", F.col("asked"), group(2)),
        "service": declaration("rust", "axum-service", group(1), id=prefixed("service-", group(1)), name=titled(group(1)), detail=prefixed("axum service ", group(1))),
        "main": declaration("rust", F.when(is_async, "rust-async-main").otherwise("rust-main"), F.lit("main"), id=id, name=F.lit("Main"), detail=F.when(is_async, tell("rust-async-main")).otherwise(tell("rust-main")), body=True, **shell()),
    })

    cargo = of(files, "toml").where(file_name(F.col("rel")) == "Cargo.toml").withColumn("line", F.lit(1))
    bins = cargo.select("repo", "rel", "line", F.explode(F.filter(F.transform(F.slice(F.split("text", r"(?m)^\[\[bin\]\]\s*$"), 2, 1000), lambda b: F.regexp_extract(F.regexp_extract(b, r"(?s)^(.*?)(?:\n\[|\z)", 1), r'(?m)^\s*name\s*=\s*"([^"]+)"', 1)), lambda n: n != "")).alias("n"))
    n = F.col("n")
    out = out.unionByName(declared(bins, "rust", "cargo-bin", n, id=prefixed("bin-", n), name=titled(n), detail=prefixed("Cargo bin target ", n), **shell()))
    listed = F.regexp_extract(F.regexp_extract("text", r"(?ms)^\[workspace\]\s*$(.*?)(?=^\[|\z)", 1), r"members\s*=\s*\[([^\]]*)\]", 1)
    parts = cargo.select("repo", "rel", "line", F.explode(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1))).alias("member"))
    leaf = F.substring_index(F.rtrim("member", F.lit("/")), "/", -1)
    return out.unionByName(declared(parts, "rust", "cargo-workspace-member", leaf, id=prefixed("member-", leaf), name=titled(leaf), detail=prefixed("Cargo workspace member ", F.col("member"))))


# ---------------------------------------------------------------- Python

# Decorators that declare an operation, decorators of containers, and calls that name one.
COMMANDS, CONTAINERS = ("command", "task", "job", "flow"), ("group", "cli", "app", "add_typer")
TOOLS = ("tool", "function_tool", "register_tool")
PIPELINES = ("dag", "op", "asset", "schedule", "sensor", "graph", "materialize")
ROUTES = (*METHODS, "route", "websocket")


def literal(node: ast.AST) -> str | None:
    """A text constant's value."""
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def first_text(call: ast.AST) -> str | None:
    return next((x for x in map(literal, call.args) if x is not None), None) if isinstance(call, ast.Call) else None


def last_name(node: ast.AST) -> str:
    node = node.func if isinstance(node, ast.Call) else node
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else ""


def python_function(node: ast.FunctionDef | ast.AsyncFunctionDef) -> Iterator[tuple]:
    """What a function's decorators declare: dialect, kind, op, label of the id, name, detail."""
    names = [last_name(d) for d in node.decorator_list]
    if not set(names) & set(CONTAINERS):
        for d, name in zip(node.decorator_list, names, strict=True):
            if name in COMMANDS and (isinstance(d, (ast.Call, ast.Attribute))):
                label = first_text(d) or node.name
                yield "cli-python", f"{name}-decorator", label, label, label, f"@{name} on {node.name}()"
                break
    for dialect, known, prefix in (("agent-tools", TOOLS, "tool"), ("orchestrator-dag", PIPELINES, None)):
        if hit := next((n for n in names if n in known), None):
            yield dialect, f"{hit}-decorator", node.name, f"{prefix or hit}-{node.name}", node.name, f"@{hit} on {node.name}()"
    for d, name in zip(node.decorator_list, names, strict=True):
        target = d.func if isinstance(d, ast.Call) else d
        if isinstance(target, ast.Attribute) and name in ROUTES and (not isinstance(target.value, ast.Name) or target.value.id in ROUTE_OBJECTS):
            path, method = first_text(d) or "/", name.upper()
            if name == "route":
                listed = next((k.value.elts for k in getattr(d, "keywords", []) if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))), [])
                method = "|".join(sorted(x.upper() for x in map(literal, listed) if x)) or "ANY"
            op = f"{method} {path}"
            yield "web-python", "route-decorator", op, op, None, f"{method} route {path} handled by {node.name}()"
            break


def python_call(node: ast.Call) -> Iterator[tuple]:
    """What a call declares: subparsers, DAG("x") and Flow("x"), entries of a Django urlconf."""
    first = first_text(node)
    if isinstance(node.func, ast.Attribute) and node.func.attr == "add_parser" and first:
        yield "cli-python", "argparse-subparser", first, first, first, "argparse subparser"
    if isinstance(node.func, ast.Name) and node.func.id in ("DAG", "Flow") and first:
        yield "orchestrator-dag", "dag-constructor", first, f"dag-{first}", first, f"{node.func.id} {first}"
    if isinstance(node.func, ast.Name) and node.func.id in ("path", "re_path", "url") and len(node.args) > 1 and literal(node.args[0]) is not None:
        target = node.args[1]
        view = target.func.attr if isinstance(target, ast.Call) and isinstance(target.func, ast.Attribute) else "" if isinstance(target, ast.Call) else last_name(target)
        if view and view not in ("include", "static"):
            label = next((literal(k.value) for k in node.keywords if k.arg == "name"), None) or view
            yield "web-python", "django-urlconf", label, f"url-{label}", label, f"Django urlconf entry for {view}"


def python_declarations(text: str) -> Iterator[tuple]:
    """(line, dialect, kind, op, label, name, lo, hi, detail, inputs) of a file; none where it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = node.args
            inputs = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
            for dialect, kind, op, label, name, detail in python_function(node):
                yield node.lineno, dialect, kind, op, label, name, node.lineno, node.end_lineno, detail, inputs
        elif isinstance(node, ast.Call):
            for dialect, kind, op, label, name, detail in python_call(node):
                inputs = [x for x in map(literal, node.args) if x is not None] if kind == "argparse-subparser" else []
                yield node.lineno, dialect, kind, op, label, name, None, None, detail, inputs


def python_candidates(files: DataFrame, *dialects: str) -> DataFrame:
    """Declarations of Python files, of the given dialects or all four."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(repo, rel, *x) for repo, rel, text in zip(b.repo, b.rel, b.text, strict=True) for x in python_declarations(text)]
            out = pd.DataFrame(rows, columns=["repo", "rel", "line", "dialect", "kind", "op", "label", "name", "lo", "hi", "detail", "inputs"])
            yield out.astype({c: "Int32" for c in ("line", "lo", "hi")})

    maybe = F.col("text").rlike(r"@|add_parser|DAG\(|Flow\(|path\(|url\(")
    rows = of(files, "python").where(F.col("rel").endswith(".py") & maybe).select("repo", "rel", "text").mapInPandas(run, PYTHON)
    rows = rows.where(F.col("dialect").isin(*dialects)) if dialects else rows
    none = F.lit(None).cast("string")
    return rows.select(
        "repo", "rel", "line", "dialect", "kind", "op", T.slugify(F.col("label")).alias("id"), F.when(F.col("name").isNull(), F.col("op")).otherwise(T.humanize(F.col("name"))).alias("name"),
        F.concat_ws(":", "rel", F.col("line").cast("string")).alias("loc"), "lo", "hi", "detail", strings().alias("caps"), none.alias("effect"), F.lit("manual").alias("trigger"), "inputs",
    )


def one(dialect: str) -> Callable[[DataFrame], DataFrame]:
    return lambda files: python_candidates(files, dialect)


# ---------------------------------------------------------------- the registry

# The classes of repositories that each dialect fits; none: all.
CLASSES = {
    "agent-tools": "agent-system library service-app unknown", "ansible": "infra-config unknown", "cli-python": "cli-tool library agent-system service-app unknown",
    "compose-services": "infra-config service-app unknown", "crontab": "infra-config unknown", "github-actions": "infra-config service-app library unknown",
    "go": "cli-tool service-app library infra-config agent-system unknown", "jvm": "cli-tool service-app library infra-config agent-system unknown", "kubernetes": "infra-config service-app unknown",
    "make-target": "infra-config library service-app cli-tool unknown", "openapi-spec": "service-app infra-config library unknown",
    "orchestrator-dag": "agent-system service-app library infra-config unknown", "package-scripts": "service-app library cli-tool agent-system unknown", "proto-service": "",
    "rust": "cli-tool service-app library infra-config agent-system unknown", "systemd-unit": "infra-config service-app unknown", "terraform": "infra-config library unknown",
    "tool-manifest": "agent-system library infra-config unknown", "web-js": "service-app library unknown", "web-python": "service-app library unknown agent-system",
}
#: Reader of each dialect. The four Python dialects share one reading of the files.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ansible": ansible_plays, "compose-services": compose_services, "crontab": cron_lines, "github-actions": github_jobs, "go": go_declarations, "jvm": jvm_declarations, "kubernetes": kubernetes_objects,
    "make-target": make_targets, "openapi-spec": openapi_operations, "package-scripts": package_scripts, "proto-service": proto_calls, "python": python_candidates, "rust": rust_declarations,
    "systemd-unit": systemd_units, "terraform": terraform_blocks, "tool-manifest": tool_manifests, "web-js": web_js,
}


#: The families of files that each reader looks at; a reader that isn't listed looks at all.
FAMILIES = {
    "ansible": ("yaml",), "compose-services": ("yaml",), "crontab": ("cron", "other", "document"), "github-actions": ("yaml",), "go": ("go",), "jvm": ("jvm",), "kubernetes": ("yaml",), "make-target": ("make",),
    "openapi-spec": ("json", "yaml"), "package-scripts": ("json",), "proto-service": ("proto",), "python": ("python",), "rust": ("rust", "toml"), "systemd-unit": ("unit",), "terraform": ("terraform",),
    "tool-manifest": ("json",), "web-js": ("javascript",),
}


def register(dialect: str, reader: Callable[[DataFrame], DataFrame], classes: tuple[str, ...] = ()) -> None:
    """Add a dialect: ``reader`` takes files and returns CANDIDATE rows (``declared`` makes them)."""
    if dialect in READERS or dialect in CLASSES:
        raise ValueError(f"dialect {dialect!r} is registered already")
    READERS[dialect], CLASSES[dialect] = reader, " ".join(classes)


def fitting(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates whose dialect fits the class of their repository; ``classes``: repo, repo_class."""
    known = F.create_map(*[F.lit(x) for d, c in CLASSES.items() for x in (d, c)])
    allowed = F.split(F.coalesce(known[F.col("dialect")], F.lit("")), " ")
    return rows.join(classes.select("repo", "repo_class"), "repo").where((allowed == F.array(F.lit(""))) | F.array_contains(allowed, F.col("repo_class"))).drop("repo_class")


def candidates(files: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """All dialects together; of equal ids in a repository the first by dialect, path and line stays. ``ord`` is its place."""
    from tidemark.operators.fusion import first_by

    readers = READERS
    if "family" in files.columns:  # readers of families that no file belongs to have nothing to do; the families are folder names
        there = {r["family"] for r in files.select("family").distinct().collect()}
        readers = {d: r for d, r in READERS.items() if d not in FAMILIES or there & set(FAMILIES[d])} or {"python": python_candidates}
    parts = [reader(files).select(*CANDIDATE) for reader in readers.values()]
    every = reduce(DataFrame.unionByName, parts).where("id <> ''")
    if classes is not None:
        every = fitting(every, classes)
    return first_by(every, ["repo", "id"], ["dialect", "rel", "line", "op"]).select(*CANDIDATE)


def order_hints(rows: DataFrame) -> DataFrame:
    """Add order_hint, the 0-based place of a candidate in its repository and dialect."""
    place = F.row_number().over(Window.partitionBy("repo", "dialect").orderBy("rel", "line", "op"))
    return rows.withColumn("order_hint", place - 1)

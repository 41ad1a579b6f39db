"""Queries of the dialects over source files that Spark derives from ``part``, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dialects as D
from tidemark.plans.extract_queries import ROWS, N, REL, files, named, python_files
from tidemark.plans.inventory_queries import joined, pick
from tidemark.sources.tables import read

METHODS = ("get", "post", "put", "zap")
KINDS = ("Service", "CronJob", "Secret", "Widget")
TYPES = ("aws_s3_bucket", "aws_sqs_queue", "gcp_spanner", "own_thing")
BLOCKS = ("resource", "data", "module", "locals")
IMAGES = ("redis:7", "Postgres", "busybox")
key = lambda: F.col("p_partkey")


def told(rows: DataFrame, *more: str) -> DataFrame:
    """What a dialect tells, as comparable columns."""
    return rows.select("repo", "rel", F.col("line").cast("long").alias("line"), "kind", "op", "id", joined(F.array_sort("caps")).alias("caps"), "effect", "trigger", *[F.col(c).cast("long").alias(c) if c in ("lo", "hi") else joined(c).alias(c) if c == "inputs" else c for c in more])


def dl_make_target(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_size") % 5 == 0, F.concat(named(), F.lit(" := x"))).when(F.col("p_size") % 7 == 0, F.concat(F.lit(".hidden"), named(), F.lit(": x"))).otherwise(F.concat(named(), F.lit(": deps")))
    return told(D.make_targets(files(spark, sf, "Makefile", line)), "detail")


def dl_package_scripts(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit('"'), named(), F.lit('": "run"'))
    return told(D.package_scripts(files(spark, sf, "package.json", line, '{"name": "x", "scripts": {', "}}", ", ")), "loc")


def dl_terraform(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(pick(BLOCKS, F.col("p_size") % 4 + 1), F.lit(' "'), pick(TYPES, key() % 4 + 1), F.lit('" "'), named(), F.lit('" {}'))
    return told(D.terraform_blocks(files(spark, sf, "main.tf", line)), "detail")


def dl_proto_service(spark: SparkSession, sf: str) -> DataFrame:
    """jn_enclosing_service over lines: every sixth part names a service, others calls."""
    line = F.when(key() % 6 == 0, F.concat(F.lit("service S"), key(), F.lit(" {"))).otherwise(F.concat(F.lit("  rpc C"), key(), F.lit("(X) returns (Y);")))
    return told(D.proto_calls(files(spark, sf, "api.proto", line)))


def dl_crontab(spark: SparkSession, sf: str) -> DataFrame:
    """Entries by field and by name, among comments and odd lines."""
    entry = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("5 "), F.col("p_size") % 24, F.lit(" * * *"))).otherwise("@daily"), F.lit(" /usr/bin/"), named(), F.lit(" --all"))
    return told(D.cron_lines(files(spark, sf, "crontab", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# "), named())).otherwise(entry))), "detail")


def dl_systemd_unit(spark: SparkSession, sf: str) -> DataFrame:
    """A service and a timer a folder; a file without a unit section is none."""
    head = F.concat(F.lit("ExecStart=/bin/"), named())
    units = files(spark, sf, "backup.service", head, "[Unit]\n").unionByName(files(spark, sf, "notes.service", head)).unionByName(files(spark, sf, "night.timer", head, "[Unit]\n"))
    return told(D.systemd_units(units), "detail")


def dl_tool_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return told(D.tool_manifests(tool_files(spark, sf)))


def tool_files(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit('{"name": "'), F.when(F.col("p_size") % 3 == 0, " ").otherwise(""), F.translate("p_name", " ", "_"), F.lit('"}'))
    return files(spark, sf, "tools.json", line, '{"tools": [', "]}", ", ")


def fn_tool_names(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions.text import tool_names

    return tool_files(spark, sf).select("repo", "rel", joined(tool_names(F.col("text"))).alias("names"))


def dl_openapi_spec(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit('"/'), named(), F.lit('": {"'), pick(METHODS, F.col("p_size") % 4 + 1), F.lit('": {"summary": "x"}, "delete": {}}'))
    return told(D.openapi_operations(files(spark, sf, "openapi.json", line, '{"paths": {\n', "\n}}", ",\n")))


def dl_openapi_yaml(spark: SparkSession, sf: str) -> DataFrame:
    """The same as YAML: methods are the lines indented like the first one under a path."""
    line = F.concat(F.lit("  /"), named(), F.lit(":\n    "), pick(METHODS, F.col("p_size") % 4 + 1), F.lit(":\n      get:\n    # why\n    delete:"))
    return told(D.openapi_operations(files(spark, sf, "swagger.yml", line, "swagger: '2.0'\npaths:\n", "\ndefinitions:\n  /no:\n    get:\n")))


def dl_github_actions(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("p_size") % 4 == 0, F.lit("#")).otherwise("")
    line = F.concat(mark, F.lit("  "), F.when(F.col("p_size") % 5 == 0, "ship").otherwise("j"), key(), F.lit(":\n"), mark, F.lit("    runs-on: x"))
    flows = files(spark, sf, "ci.yml", line, "on: push\njobs:\n", "\nenv:\n  A: b")
    timed = F.substring("rel", 2, 1).isin("1", "2")
    text = F.when(timed, F.concat(F.lit("on:\n  schedule:\n  - cron: x\n"), F.expr("substring(text, 10)"))).otherwise(F.col("text"))
    rows = flows.select("repo", F.concat(F.lit(".github/workflows/"), F.translate("rel", "/", "-")).alias("rel"), text.alias("text"))
    return told(D.github_jobs(rows))


def dl_compose_services(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("  s"), key(), F.lit(':\n    image: "'), pick(IMAGES, F.col("p_size") % 3 + 1), F.lit('"'))
    return told(D.compose_services(files(spark, sf, "docker-compose.yml", line, "services:\n", "\nvolumes:\n  v: {}")), "detail")


def part_files(spark: SparkSession, sf: str, name: str, text: F.Column) -> DataFrame:
    """A file for each part."""
    return read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.concat(F.lit("p"), key(), F.lit("/" + name)).alias("rel"), text.alias("text"))


def dl_kubernetes(spark: SparkSession, sf: str) -> DataFrame:
    """One object a file, named by its metadata or else by the file; later documents of the file don't count."""
    kind = F.when(F.col("p_size") % 5 == 0, "# no ").otherwise(F.concat(F.lit("kind: "), pick(KINDS, F.col("p_size") % 4 + 1), F.lit(" ")))
    named_ = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("\n  labels: {}\n  name: 'p"), key(), F.lit("'")))
    text = F.concat(F.lit("apiVersion: v1\n"), kind, F.lit("\nmetadata:"), named_, F.lit("\nspec:\n  name: q\n---\nkind: Job\n"))
    rows = part_files(spark, sf, "all.yaml", text).where(F.contains("text", F.lit("# no ")) == F.lit(False))
    return told(D.kubernetes_objects(rows))


def dl_ansible(spark: SparkSession, sf: str) -> DataFrame:
    """Plays, every third without a name right above."""
    between = F.when(F.col("p_size") % 3 == 0, "  gather_facts: no\n").otherwise("  # why\n")
    line = F.concat(F.lit("- name: Play "), key(), F.lit("\n"), between, F.lit("  hosts: h"), key())
    return told(D.ansible_plays(files(spark, sf, "site.yml", line)))


def dl_web_js(spark: SparkSession, sf: str) -> DataFrame:
    """Routes with the range of their bodies; braces in strings and comments don't count, nor do calls of other objects.

    A file without a call of get or post and without such decorators isn't read.
    """
    owner = F.when(F.col("p_size") % 7 == 0, "client").otherwise("app")
    line = F.concat(owner, F.lit("."), pick(METHODS, F.col("p_size") % 4 + 1), F.lit("('/p"), key(), F.lit("', (q) => {\n  const s = '}'; // }\n  if (q) { y() }\n});"))
    return told(D.web_js(files(spark, sf, "index.js", line)), "lo", "hi")


def dl_go(spark: SparkSession, sf: str) -> DataFrame:
    """Router calls inside exported and unexported functions; the exported ones without parameters are commands."""
    head = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("func Run"), key(), F.lit("() {"))).otherwise(F.concat(F.lit("func init"), key(), F.lit("(r *gin.Engine) {")))
    line = F.concat(head, F.lit("\n\tr."), F.upper(pick(METHODS, F.col("p_size") % 4 + 1)), F.lit('("/p'), key(), F.lit('", f) // }\n}'))
    return told(D.go_declarations(files(spark, sf, "main.go", line, "package main\n")), "lo", "hi")


def dl_jvm(spark: SparkSession, sf: str) -> DataFrame:
    """Mappings under their class's path, and schedules; a string with a brace doesn't end a body."""
    mark = F.when(F.col("p_size") % 3 == 0, '  @Scheduled(cron = "0")\n').otherwise(F.concat(F.lit('  @GetMapping("/p'), key(), F.lit('")\n')))
    line = F.concat(mark, F.lit("  public String runJob"), key(), F.lit('() {\n    return "}";\n  }'))
    return told(D.jvm_declarations(files(spark, sf, "Api.java", line, '@RestController\n@RequestMapping("/api")\npublic class Api {\n', "\n}")), "lo", "hi")


def dl_rust(spark: SparkSession, sf: str) -> DataFrame:
    """Route attributes; braces in raw strings and lifetimes don't disturb the range."""
    line = F.concat(F.lit("#["), pick(METHODS, F.col("p_size") % 4 + 1), F.lit('("/p'), key(), F.lit("\")]\nasync fn f"), key(), F.lit("<'a>(x: &'a str) {\n    g(r#\"{\"#);\n}"))
    return told(D.rust_declarations(files(spark, sf, "api.rs", line)), "lo", "hi")


def dl_web_nest(spark: SparkSession, sf: str) -> DataFrame:
    """Nest decorators, every fifth without a path; a brace in a text doesn't end the method."""
    name = F.initcap(pick(METHODS, F.col("p_size") % 4 + 1))
    path = F.when(F.col("p_size") % 5 == 0, "()").otherwise(F.concat(F.lit("('/n"), key(), F.lit("')")))
    line = F.concat(F.lit("  @"), name, path, F.lit("\n  m"), key(), F.lit("() {\n    return '}';\n  }"))
    return told(D.web_js(files(spark, sf, "app.controller.ts", line, "@Get\n")), "lo", "hi")


def dl_go_cobra(spark: SparkSession, sf: str) -> DataFrame:
    """cobra commands, every third without a use, and net/http handlers; braces in the summary don't count."""
    use = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit('\tUse: "run'), key(), F.lit(' all",')))
    line = F.concat(F.lit("var c"), key(), F.lit(" = &cobra.Command{\n"), use, F.lit('\n\tShort: "does {'), key(), F.lit('",\n}\nhttp.HandleFunc("/h'), key(), F.lit('", h)'))
    return told(D.go_declarations(files(spark, sf, "cmd.go", line)), "detail", "lo", "hi")


def dl_jvm_listeners(spark: SparkSession, sf: str) -> DataFrame:
    """Listeners of three kinds, one without a body, and a main function a file."""
    kind = pick(("Kafka", "Jms", "Event"), F.col("p_size") % 3 + 1)
    body = F.when(F.col("p_size") % 4 == 0, ";\n\n").otherwise(" {\n    x();\n  }")
    line = F.concat(F.lit("  @"), kind, F.lit('Listener(topics = "t")\n  public void onMsg'), key(), F.lit("(String m)"), body)
    return told(D.jvm_declarations(files(spark, sf, "Jobs.java", line, "class Jobs {\n  public static void main(String[] args) {\n  }\n", "\n}")), "detail", "lo", "hi")


def dl_rust_clap(spark: SparkSession, sf: str) -> DataFrame:
    """clap parsers, every third without a name of its own, a subcommand each, and axum routes of two methods with a service."""
    name = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit('#[command(name = "tool'), key(), F.lit('")]')))
    clap = F.concat(F.lit("#[derive(Parser)]\n"), name, F.lit("\nstruct Cli"), key(), F.lit(" {}\n#[derive(Debug, Subcommand)]\nenum Todo"), key(), F.lit(' {\n    #[command(about = "do it")]\n    Run'), key(), F.lit(",\n}\n"))
    axum = F.concat(F.lit('fn app() { Router::new().route("/a'), key(), F.lit('", get(h).post(h)).service(page'), key(), F.lit("); }"))
    return told(D.rust_declarations(files(spark, sf, "cli.rs", F.concat(clap, axum))), "detail")


def dl_cargo(spark: SparkSession, sf: str) -> DataFrame:
    """Bins and members of Cargo files."""
    bins = files(spark, sf, "Cargo.toml", F.concat(F.lit('[[bin]]\nname = "b'), key(), F.lit('"')), '[package]\nname = "no"\n')
    members = files(spark, sf, "Cargo.toml", F.concat(F.lit('"crates/m'), key(), F.lit('"')), "[workspace]\nmembers = [", "]\n", ", ").withColumn("rel", F.concat(F.lit("w/"), "rel"))
    return told(D.rust_declarations(bins.unionByName(members)))


def dl_ansible_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Task files below a folder of tasks; with hosts in them they are plays, elsewhere nothing."""
    rows = part_files(spark, sf, "x", F.when(F.col("p_size") % 3 == 0, F.lit("- name: Go\n  hosts: all\n  tasks:\n")).otherwise("- tasks:\n  - debug: x\n"))
    folder = F.when(F.length("rel") % 2 == 0, "roles/tasks/").otherwise("roles/")
    return told(D.ansible_plays(rows.withColumn("rel", F.concat(folder, F.translate("rel", "/x", ""), F.lit(".yml")))))


def dl_cli_python(spark: SparkSession, sf: str) -> DataFrame:
    return told(D.python_candidates(python_files(spark, sf), "cli-python"), "lo", "hi")


def dl_agent_tools(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "@tool").otherwise("@agent.function_tool()"), F.lit("\ndef t"), key(), F.lit("(self, query):\n    pass"))
    return told(D.python_candidates(files(spark, sf, "tools.py", line), "agent-tools"), "inputs")


def dl_orchestrator_dag(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("@asset\ndef a"), key(), F.lit("():\n    pass"))).otherwise(F.concat(F.lit('d = DAG("flow '), key(), F.lit('")\n\n')))
    return told(D.python_candidates(files(spark, sf, "dags.py", line), "orchestrator-dag"), "detail")


def dl_web_python(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of known receivers, routes with methods, and entries of a urlconf."""
    route = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("@app.get('/p"), key(), F.lit("')"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("@bp.route('/p"), key(), F.lit("', methods=['PUT', 'GET'])"))).otherwise(F.concat(F.lit("@client.get('/p"), key(), F.lit("')")))
    line = F.when(F.col("p_size") % 4 == 3, F.concat(F.lit("x = path('p/', views.show"), key(), F.lit(")\n\n"))).otherwise(F.concat(route, F.lit("\ndef f"), key(), F.lit("(q):\n    pass")))
    return told(D.python_candidates(files(spark, sf, "web.py", line), "web-python"))


def win_order_hint(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.order_hints(D.proto_calls(files(spark, sf, "api.proto", F.concat(F.lit("  rpc C"), key(), F.lit("(X) returns (Y);")))))
    return rows.select("repo", "rel", "op", F.col("order_hint").cast("long").alias("order_hint"))


def flt_class_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Make targets, plays and calls of repositories whose class is told by the brand's number."""
    made = D.make_targets(files(spark, sf, "Makefile", F.concat(named(), F.lit(": deps"))))
    plays = D.ansible_plays(files(spark, sf, "site.yml", F.concat(F.lit("- hosts: h"), key())))
    calls = D.proto_calls(files(spark, sf, "api.proto", F.concat(F.lit("  rpc C"), key(), F.lit("(X) returns (Y);"))))
    classes = read(spark, sf, "part").select(F.col("p_brand").alias("repo")).distinct()
    classes = classes.withColumn("repo_class", pick(("library", "agent-system", "infra-config"), F.length("repo") % 3 + 1))
    return D.fitting(made.unionByName(plays).unionByName(calls), classes).groupBy("repo", "dialect").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    dl_make_target, dl_package_scripts, dl_terraform, dl_proto_service, dl_crontab, dl_systemd_unit, dl_tool_manifest, fn_tool_names, dl_openapi_spec, dl_openapi_yaml, dl_github_actions, dl_compose_services, dl_kubernetes,
    dl_ansible, dl_web_js, dl_web_nest, dl_go, dl_go_cobra, dl_jvm, dl_jvm_listeners, dl_rust, dl_rust_clap, dl_cargo, dl_ansible_tasks, dl_cli_python, dl_agent_tools, dl_orchestrator_dag, dl_web_python, win_order_hint, flt_class_fit,
)}

rel = lambda name: f"{REL.format(name)} AS rel"
M = "['get', 'post', 'put', 'zap'][p_size % 4 + 1]"
K = "p_partkey"
LOCAL, EXTERNAL = "'effectful-local'", "'effectful-external'"


def row(name: str, line: str, kind: str, op: str, id: str, caps: str = "''", effect: str = "NULL", trigger: str = "'manual'", more: str = "", where: str = "true", source: str = "x", path: str | None = None) -> str:
    """SELECT of the columns of told()."""
    return f"SELECT repo, {path or REL.format(name)} AS rel, CAST({line} AS BIGINT) AS line, {kind} AS kind, {op} AS op, {id} AS id, {caps} AS caps, {effect} AS effect, {trigger} AS trigger{more} FROM {source} WHERE {where}"


HEAD = f"WITH {ROWS} "
TF_TYPE = "['aws_s3_bucket', 'aws_sqs_queue', 'gcp_spanner', 'own_thing'][p_partkey % 4 + 1]"
TF_BLOCK = "['resource', 'data', 'module'][p_size % 4 + 1]"
TF_CAPS = "CASE WHEN p_size % 4 = 2 THEN '' ELSE ['storage.object', 'queue.publish', 'data.write', ''][p_partkey % 4 + 1] END"
SERVICES = HEAD.rstrip() + ", y AS (SELECT *, last_value(CASE WHEN p_partkey % 6 = 0 THEN 'S' || p_partkey END IGNORE NULLS) OVER (PARTITION BY repo, d ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x) "
K8S = "CASE WHEN p_size % 3 = 0 THEN 'all' ELSE 'p' || p_partkey END"
KIND = "['Service', 'CronJob', 'Secret', 'Widget'][p_size % 4 + 1]"
K8S_CAPS = "['deploy.op', 'schedule.cron', 'secret.apikey', ''][p_size % 4 + 1]"
JOB = "CASE WHEN p_size % 5 = 0 THEN 'ship' ELSE 'j' END || p_partkey"
TIMED = "left(CAST(p_partkey // 50 AS VARCHAR), 1) IN ('1', '2')"
IMAGE = "['redis:7', 'postgres', 'busybox'][p_size % 3 + 1]"
PLAY = "CASE WHEN p_size % 3 = 0 THEN 'site-' || (line * 3) ELSE 'Play ' || p_partkey END"
BODY = ", CAST({} AS BIGINT) AS lo, CAST({} AS BIGINT) AS hi"
SQL = {
    "dl_make_target": HEAD + row("Makefile", "line", "'make-target'", N, f"'make-' || {N}", "'shell.exec'", LOCAL, more=f", 'Make target ' || {N} AS detail", where="p_size % 5 <> 0 AND p_size % 7 <> 0"),
    "dl_package_scripts": HEAD + row("package.json", "1", "'npm-script'", N, f"'script-' || {N}", "'shell.exec'", LOCAL, more=f", {REL.format('package.json')} || ':scripts.' || {N} AS loc"),
    "dl_terraform": HEAD + row("main.tf", "line", f"'terraform-' || {TF_BLOCK}", f"{TF_TYPE} || ' ' || {N}", f"'tf-' || replace({TF_TYPE}, '_', '-') || '-' || {N}", TF_CAPS, f"CASE WHEN {TF_CAPS} <> '' THEN {EXTERNAL} END", more=f", 'Terraform ' || {TF_BLOCK} || ' ' || {TF_TYPE} || ' ' || {N} AS detail", where="p_size % 4 < 3"),
    "dl_proto_service": SERVICES + row("api.proto", "line", "'proto-rpc'", f"concat_ws('.', s, 'C' || {K})", f"lower(coalesce(s, 'rpc')) || '-c' || {K}", where="p_partkey % 6 <> 0", source="y"),
    "dl_crontab": HEAD + row("crontab", "line", "'crontab-entry'", f"'/usr/bin/' || {N}", f"'cron-usr-bin-' || {N}", "'shell.exec'", LOCAL, "'scheduled'", more=f", 'scheduled command /usr/bin/' || {N} AS detail", where="p_size % 3 <> 0"),
    "dl_systemd_unit": HEAD + row("backup.service", "1", "'systemd-service'", "'backup'", "'unit-backup'", "'shell.exec'", LOCAL, more=", 'systemd service unit backup' AS detail", where="line = 1") + " UNION ALL " + row("night.timer", "1", "'systemd-timer'", "'night'", "'unit-night'", "'schedule.cron'", LOCAL, "'scheduled'", more=", 'systemd timer unit night' AS detail", where="line = 1"),
    "dl_tool_manifest": HEAD + "SELECT DISTINCT * FROM (" + row("tools.json", "1", "'tool-manifest'", "replace(p_name, ' ', '_')", "'tool-' || replace(p_name, ' ', '-')") + ")",
    "fn_tool_names": HEAD + f"SELECT repo, {rel('tools.json')}, string_agg(DISTINCT replace(p_name, ' ', '_'), ',' ORDER BY replace(p_name, ' ', '_')) AS names FROM x GROUP BY ALL",
    "dl_openapi_spec": HEAD + row("openapi.json", "line + 1", "'openapi-operation'", f"upper({M}) || ' /' || {N}", f"{M} || '-' || {N}", where="p_size % 4 < 3") + " UNION ALL " + row("openapi.json", "line + 1", "'openapi-operation'", f"'DELETE /' || {N}", f"'delete-' || {N}"),
    "dl_openapi_yaml": HEAD + row("swagger.yml", "line * 5 - 1", "'openapi-operation'", f"upper({M}) || ' /' || {N}", f"{M} || '-' || {N}", where="p_size % 4 < 3") + " UNION ALL " + row("swagger.yml", "line * 5 + 2", "'openapi-operation'", f"'DELETE /' || {N}", f"'delete-' || {N}"),
    "dl_github_actions": HEAD + row("", f"line * 2 + 1 + CASE WHEN {TIMED} THEN 2 ELSE 0 END", "'github-job'", JOB, f"'job-' || {JOB}", "CASE WHEN p_size % 5 = 0 THEN 'deploy.op,shell.exec' ELSE 'shell.exec' END", LOCAL, f"CASE WHEN {TIMED} THEN 'scheduled' ELSE 'event' END", where="p_size % 4 <> 0", path="'.github/workflows/d' || (p_partkey // 50) || '-ci.yml'"),
    "dl_compose_services": HEAD + row("docker-compose.yml", "line * 2", "'compose-service'", f"'s' || {K}", f"'svc-s' || {K}", "['cache.write,container.op', 'container.op,data.write', 'container.op'][p_size % 3 + 1]", LOCAL, more=f", 'compose service s' || {K} || ' (' || {IMAGE} || ')' AS detail"),
    "dl_kubernetes": HEAD + row("", "1", f"'kubernetes-' || lower({KIND})", f"{KIND} || '/' || {K8S}", f"'k8s-' || lower({KIND}) || '-' || {K8S}", K8S_CAPS, f"CASE WHEN {K8S_CAPS} <> '' THEN {EXTERNAL} END", "CASE WHEN p_size % 4 = 1 THEN 'scheduled' ELSE 'manual' END", where="p_size % 5 <> 0", path="'p' || p_partkey || '/all.yaml'"),
    "dl_ansible": HEAD + row("site.yml", "line * 3", "'ansible-play'", PLAY, f"'play-' || replace(lower({PLAY}), ' ', '-')", "'shell.exec'", LOCAL),
    "dl_web_js": HEAD.rstrip() + ", y AS (SELECT *, max(CASE WHEN p_size % 4 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, d) AS read FROM x) " + row("index.js", "line * 4 - 3", "'route-call'", f"upper({M}) || ' /p' || {K}", f"{M} || '-p' || {K}", more=BODY.format("line * 4 - 3", "line * 4"), where="p_size % 4 < 3 AND p_size % 7 <> 0 AND read = 1", source="y"),
    "dl_go": HEAD + row("main.go", "line * 3", "'router-route'", f"upper({M}) || ' /p' || {K}", f"{M} || '-p' || {K}", more=BODY.format("NULL", "NULL"), where="p_size % 4 < 3") + " UNION ALL " + row("main.go", "line * 3 - 1", "'go-func'", f"'Run' || {K}", f"'run' || {K}", "'shell.exec'", LOCAL, more=BODY.format("line * 3 - 1", "line * 3 + 1"), where="p_size % 3 = 0"),
    "dl_jvm": HEAD + row("Api.java", "line * 4", "'spring-controller-route'", f"'GET /api/p' || {K}", f"'get-api-p' || {K}", more=BODY.format("line * 4", "line * 4 + 3"), where="p_size % 3 <> 0") + " UNION ALL " + row("Api.java", "line * 4", "'spring-scheduled'", f"'scheduled run Job' || {K}", f"'scheduled-run-job' || {K}", "'schedule.cron'", EXTERNAL, "'scheduled'", more=BODY.format("line * 4", "line * 4 + 3"), where="p_size % 3 = 0"),
    "dl_rust": HEAD + row("api.rs", "line * 4 - 3", "'route-attribute'", f"upper({M}) || ' /p' || {K}", f"{M} || '-p' || {K}", more=BODY.format("line * 4 - 2", "line * 4"), where="p_size % 4 < 3"),
    "dl_web_nest": HEAD.rstrip() + ", y AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN '/' ELSE '/n' || p_partkey END AS path FROM x) " + row("app.controller.ts", "line * 4 - 2", "'nest-decorator'", f"upper({M}) || ' ' || path", f"{M} || CASE WHEN path = '/' THEN '' ELSE '-n' || {K} END", effect="CAST(NULL AS VARCHAR)", more=BODY.format("line * 4 - 2", "line * 4 + 1"), where="p_size % 4 < 3", source="y"),
    "dl_go_cobra": HEAD + row("cmd.go", "line * 5 - 4", "'cobra-command'", f"'run' || {K}", f"'run' || {K}", "'shell.exec'", LOCAL, more=f", 'cobra command run' || {K} || ' — does {{' || {K} AS detail" + BODY.format("line * 5 - 4", "line * 5 - 1"), where="p_size % 3 <> 0") + " UNION ALL " + row("cmd.go", "line * 5", "'http-handle'", f"'HTTP /h' || {K}", f"'http-h' || {K}", more=f", 'net/http handler for /h' || {K} AS detail" + BODY.format("NULL", "NULL")),
    "dl_jvm_listeners": HEAD + row("Jobs.java", "line * 4", "'spring-' || ['kafka', 'jms', 'event'][p_size % 3 + 1] || '-listener'", f"['kafka', 'jms', 'event'][p_size % 3 + 1] || ' on Msg' || {K}", f"['kafka', 'jms', 'event'][p_size % 3 + 1] || '-on-msg' || {K}", "CASE WHEN p_size % 3 < 2 THEN 'queue.consume' ELSE '' END", f"CASE WHEN p_size % 3 < 2 THEN {EXTERNAL} END", more=f", '@' || ['Kafka', 'Jms', 'Event'][p_size % 3 + 1] || 'Listener on onMsg' || {K} || '()' AS detail" + BODY.format("CASE WHEN p_size % 4 <> 0 THEN line * 4 END", "CASE WHEN p_size % 4 <> 0 THEN line * 4 + 3 END")) + " UNION ALL " + row("Jobs.java", "2", "'java-main'", "'main'", "'main'", "'shell.exec'", LOCAL, more=", 'public static void main entry point' AS detail" + BODY.format("2", "3"), where="line = 1"),
    "dl_rust_clap": HEAD.rstrip() + ", y AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN 'Cli' || p_partkey ELSE 'tool' || p_partkey END AS label FROM x) " + row("cli.rs", "line * 9 - 8", "'clap-parser'", "label", "lower(label)", "'shell.exec'", LOCAL, more=f", 'clap Parser Cli' || {K} AS detail", source="y") + " UNION ALL " + row("cli.rs", "line * 9 - 2", "'clap-subcommand'", f"'Run' || {K}", f"'run' || {K}", "'shell.exec'", LOCAL, more=f", 'clap subcommand Run' || {K} || ' — do it' AS detail", source="y") + "".join(" UNION ALL " + row("cli.rs", "line * 9", "'axum-route'", f"'{m} /a' || {K}", f"'{m.lower()}-a' || {K}", more=f", '{m} route /a' || {K} AS detail", source="y") for m in ("GET", "POST")) + " UNION ALL " + row("cli.rs", "line * 9", "'axum-service'", f"'page' || {K}", f"'service-page' || {K}", more=f", 'axum service page' || {K} AS detail", source="y"),
    "dl_cargo": HEAD + row("Cargo.toml", "1", "'cargo-bin'", f"'b' || {K}", f"'bin-b' || {K}", "'shell.exec'", LOCAL) + " UNION ALL " + row("", "1", "'cargo-workspace-member'", f"'m' || {K}", f"'member-m' || {K}", path="'w/d' || (p_partkey // 50) || '/Cargo.toml'"),
    "dl_ansible_tasks": HEAD.rstrip() + ", y AS (SELECT *, 'p' || p_partkey AS stem, (length('p' || p_partkey || '/x') % 2 = 0) AS deep FROM x) " + row("", "2", "'ansible-play'", "'Go'", "'play-go'", "'shell.exec'", LOCAL, where="p_size % 3 = 0", source="y", path="CASE WHEN deep THEN 'roles/tasks/' ELSE 'roles/' END || stem || '.yml'") + " UNION ALL " + row("", "1", "'ansible-tasks'", "stem", "'play-' || stem", "'shell.exec'", LOCAL, where="p_size % 3 <> 0 AND deep", source="y", path="'roles/tasks/' || stem || '.yml'"),
    "dl_cli_python": HEAD + row("cli.py", "line * 3 - 1", "'command-decorator'", f"replace(p_name, ' ', '_') || '_' || {K}", N, more=BODY.format("line * 3 - 1", "line * 3")),
    "dl_agent_tools": HEAD + row("tools.py", "line * 3 - 1", "CASE WHEN p_size % 2 = 0 THEN 'tool-decorator' ELSE 'function_tool-decorator' END", f"'t' || {K}", f"'tool-t' || {K}", more=", 'query' AS inputs"),
    "dl_orchestrator_dag": HEAD + row("dags.py", "line * 3 - 1", "'asset-decorator'", f"'a' || {K}", f"'asset-a' || {K}", more=f", '@asset on a' || {K} || '()' AS detail", where="p_size % 2 = 0") + " UNION ALL " + row("dags.py", "line * 3 - 2", "'dag-constructor'", f"'flow ' || {K}", f"'dag-flow-' || {K}", more=f", 'DAG flow ' || {K} AS detail", where="p_size % 2 = 1"),
    "dl_web_python": HEAD + row("web.py", "line * 3 - 1", "'route-decorator'", f"'GET /p' || {K}", f"'get-p' || {K}", where="p_size % 4 = 0") + " UNION ALL " + row("web.py", "line * 3 - 1", "'route-decorator'", f"'GET|PUT /p' || {K}", f"'get-put-p' || {K}", where="p_size % 4 = 1") + " UNION ALL " + row("web.py", "line * 3 - 2", "'django-urlconf'", f"'show' || {K}", f"'url-show' || {K}", where="p_size % 4 = 3"),
    "win_order_hint": f"WITH {ROWS} SELECT repo, {rel('api.proto')}, 'C' || p_partkey AS op, row_number() OVER (PARTITION BY repo ORDER BY {REL.format('api.proto')}, line) - 1 AS order_hint FROM x",
    "flt_class_fit": """WITH c AS (SELECT p_brand AS repo, count(*) AS n, ['library', 'agent-system', 'infra-config'][length(p_brand) % 3 + 1] AS cls FROM part GROUP BY p_brand)
SELECT repo, 'make-target' AS dialect, n FROM c WHERE cls <> 'agent-system' UNION ALL SELECT repo, 'ansible', n FROM c WHERE cls = 'infra-config' UNION ALL SELECT repo, 'proto-service', n FROM c""",
}

"""Queries of the extraction operators over source files that Spark derives from ``part``, with their SQL.

Each folder holds the parts of fifty keys of a brand as lines of a file, so files stay small and their number grows with
the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import effects as E
from tidemark.operators import inventory
from tidemark.sources import repos
from tidemark.sources.tables import materialise, read


def named() -> Column:
    return F.concat_ws("-", F.translate("p_name", " ", "-"), F.col("p_partkey"))


def files(spark: SparkSession, sf: str, name: str, line: Column, head: str = "", foot: str = "", sep: str = "\n") -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.concat(F.lit("d"), F.floor(F.col("p_partkey") / 50), F.lit("/" + name)).alias("rel"), "p_partkey", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), sep)
    return rows.groupBy("repo", "rel").agg(F.concat(F.lit(head), text, F.lit(foot)).alias("text"))


def src_manifest_deps(spark: SparkSession, sf: str) -> DataFrame:
    line = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("# "), named())).otherwise(F.concat(F.initcap(F.translate("p_name", " ", "_")), F.lit(">=1.0  # why")))
    return repos.dependencies(files(spark, sf, "requirements.txt", line))


def src_toml(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies of pyproject and Cargo files, read by a TOML parser; a file that is no TOML is reported."""
    python = files(spark, sf, "pyproject.toml", F.concat(F.lit('  "'), F.initcap(F.translate("p_name", " ", "_")), F.lit(">=1\",  # '")), '[project]\nname = "x"\ndependencies = [\n', "\n]\n[tool.poetry.dependencies]\npython = '3'\n")
    cargo = files(spark, sf, "Cargo.toml", F.concat(F.lit("crate-"), F.col("p_size"), F.lit("-"), F.col("p_partkey"), F.lit(' = { version = "1" }')), "[package]\nname = 'y'\n[dev-dependencies]\n")
    bad = files(spark, sf, "Cargo.toml", F.lit("= 1")).withColumn("rel", F.concat(F.lit("bad/"), "rel"))
    both = materialise(python.unionByName(cargo).unionByName(bad), "manifests")
    problems = repos.manifest_problems(both).select("repo", "problem", F.col("rel").alias("name"))
    return repos.dependencies(both).unionByName(problems.select("repo", F.col("problem").alias("ecosystem"), "name"))


def src_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates of pom files in any namespace; entries without a group don't count, and a file that is no XML is reported."""
    group = F.when(F.col("p_size") % 4 == 0, "").otherwise("<groupId>org.x</groupId>")
    line = F.concat(F.lit("<dependency>"), group, F.lit("<artifactId> "), named(), F.lit(" </artifactId></dependency>"))
    poms = files(spark, sf, "pom.xml", line, '<project xmlns="http://m"><dependencyManagement><dependencies>', "</dependencies></dependencyManagement></project>")
    bad = files(spark, sf, "pom.xml", F.lit("<project>")).withColumn("rel", F.concat(F.lit("bad/"), "rel"))
    both = materialise(poms.unionByName(bad), "manifests")
    return repos.dependencies(both).unionByName(repos.manifest_problems(both).select("repo", F.col("problem").alias("ecosystem"), F.col("rel").alias("name")))


def agg_deps_union(spark: SparkSession, sf: str) -> DataFrame:
    """One set of names for each repository and ecosystem over package.json, go.mod and Gradle files."""
    node = files(spark, sf, "package.json", F.concat(F.lit('"'), F.translate("p_name", " ", "-"), F.lit('": "1"')), '{"devDependencies": {"own": "2", ', "}}", ", ")
    go = files(spark, sf, "go.mod", F.concat(F.lit("\texample.com/"), F.translate("p_name", " ", "-"), F.lit(" v1.0.0 // indirect")), "module m\n\ngo 1.2\n\nrequire (\n", "\n)\nrequire example.com/last v2\n")
    gradle = files(spark, sf, "build.gradle", F.concat(F.when(F.col("p_size") % 2 == 0, "  implementation 'g:").otherwise("  // implementation 'g:"), F.translate("p_name", " ", "-"), F.lit(":1.0'")))
    return repos.dependencies(materialise(node.unionByName(go).unionByName(gradle), "manifests")).groupBy("repo", "ecosystem").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def src_secret_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Listable files among paths made of pages' addresses."""
    name = F.element_at(F.array(*map(F.lit, ("main.py", ".env.local", "id_rsa", "x_pb2.py", "readme.md", "server.pem", "app.min.js", "Kubeconfig", ".git-credentials", "prod.env", "shadow"))), (F.col("page_id") % 11 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("src", "node_modules", "lib/vendor", "docs"))), (F.floor(F.col("page_id") / 11) % 4 + 1).cast("int"))
    return repos.listable(read(spark, sf, "pages").select("page_id", F.concat_ws("/", folder, name).alias("rel")))


def src_walk(spark: SparkSession, sf: str) -> DataFrame:
    """Places in the walk: a folder's files come before its subfolders."""
    folder = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat(F.lit("b"), F.col("p_size"), F.lit("/"))).otherwise(F.concat(F.lit("b"), F.col("p_size") - 1, F.lit("/a/")))
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.concat(folder, F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("rel"))
    return repos.walked(rows).select("repo", "rel", F.col("walk_ord").cast("long").alias("walk_ord"))


CALLS = ("requests.get('u')", "session.commit()", "open('f')", "print('x')")


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """A command for each part, whose body makes the call that its size selects."""
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("p_size") % 4 + 1).cast("int"))
    line = F.concat(F.lit("@app.command()\ndef "), F.translate("p_name", " ", "_"), F.lit("_"), F.col("p_partkey"), F.lit("():\n    "), call)
    return files(spark, sf, "cli.py", line)


def site_rows(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "rel", F.col("line").cast("long").alias("line"), "capability", "effect", "pattern", "detail")


def udf_t1_trace(spark: SparkSession, sf: str) -> DataFrame:
    return site_rows(E.effect_sites(E.python_calls(python_files(spark, sf))))


def udf_t1_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Functions that call the next one: the first three are reached; where they do nothing, all functions count."""
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("p_size") % 4 + 1).cast("int"))
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.floor(F.col("p_partkey") / 50).alias("d"), "p_partkey", call.alias("call"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("repo", "d").orderBy("p_partkey")))
    line = F.format_string("def f_%d():\n    %s\n    f_%d()", F.col("i"), F.col("call"), F.col("i") + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")
    made = rows.groupBy("repo", "d").agg(F.concat(text, F.lit("\nf_1()\n")).alias("text")).select("repo", F.concat(F.lit("d"), "d", F.lit("/run.py")).alias("rel"), "text")
    return site_rows(E.effect_sites(E.python_calls(made)))


def udf_t1_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of four functions entered twice: where the long way to the third comes first, the fourth stays hidden."""
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    chain = F.format_string("def a%1$d():\n    b%1$d()\ndef b%1$d():\n    c%1$d()\ndef c%1$d():\n    d%1$d()\ndef d%1$d():\n    %2$s", F.col("p_partkey"), call)
    entered = F.format_string("a%1$d()\nc%1$d()", F.col("p_partkey")), F.format_string("c%1$d()\na%1$d()", F.col("p_partkey"))
    line = F.concat(chain, F.lit("\n"), F.when(F.col("p_size") % 2 == 0, entered[0]).otherwise(entered[1]))
    return site_rows(E.effect_sites(E.python_calls(files(spark, sf, "walk.py", line, "open('z')\n"))))


MODES = ("open('f', 'w')", "open('f', mode='rb')", "cur.execute('SELECT 1')", "db.execute(select(x))", "db.execute('delete')", "os.environ.get('X')", "os.getenv('X')", "shutil.get('u')", "requests.request('GET')", "add(1)")


def udf_mode(spark: SparkSession, sf: str) -> DataFrame:
    """Modes of open, first arguments of execute, modules and plumbing: which pattern each call matches."""
    call = F.element_at(F.array(*map(F.lit, MODES)), (F.col("p_size") % len(MODES) + 1).cast("int"))
    calls = E.python_calls(files(spark, sf, "m.py", call))
    return E.matched(calls).groupBy("repo", "rel", F.col("line").cast("long").alias("line")).agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"), F.max("method").alias("method"))


def op_build_operation(spark: SparkSession, sf: str) -> DataFrame:
    rows = inventory.build_inventory(materialise(python_files(spark, sf), "files"))
    return rows.select("repo", "id", "effect", F.concat_ws(",", "requires").alias("requires"), "confidence", "loc", "trigger", "deterministic", "optional", "summary")


def set_union_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of each operation: its declaration, its sites, the providers that know a traced capability, or a placeholder."""
    deps = read(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.lit("pypi").alias("ecosystem"), F.when(F.col("p_size") % 2 == 0, "requests").otherwise("sqlalchemy").alias("name")).distinct()
    rows = inventory.build_inventory(materialise(python_files(spark, sf), "files"), deps.where("length(repo) = 8"))
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["source"], e["loc"], e["detail"])), ";")
    creds = F.array_join(F.transform("credentials", lambda c: F.concat_ws(":", c["name"], c["kind"])), ",")
    return rows.select("repo", "id", evidence.alias("evidence"), creds.alias("credentials"), "confidence")


def prd_optional(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of which a longer word stands in a line that calls something optional."""
    p = read(spark, sf, "part")
    word = F.regexp_extract("p_name", r"^\w+ (\w+)", 1)
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), F.upper(word), F.lit("s step is optional."))).otherwise(F.concat(F.lit("Always do "), "p_name"))
    lines = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("repo"), said.alias("text_line")).withColumn("low", F.lower("text_line"))
    return inventory.optional_operations(lines, p.select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("id"), F.translate("p_name", " ", "-").alias("name")))


QUERIES = {f.__name__: f for f in (src_manifest_deps, src_toml, src_xml, agg_deps_union, src_secret_exclude, src_walk, udf_t1_trace, udf_t1_graph, udf_t1_depth, udf_mode, op_build_operation, set_union_evidence, prd_optional)}

N = "replace(p_name, ' ', '-') || '-' || p_partkey"
REL = "'d' || (p_partkey // 50) || '/{}'"
ROWS = "x AS (SELECT *, p_brand AS repo, p_partkey // 50 AS d, row_number() OVER (PARTITION BY p_brand, p_partkey // 50 ORDER BY p_partkey) AS line FROM part)"
CAPABILITY, EFFECT = "['http.request', 'data.write', 'file.read'][p_size % 4 + 1]", "['read-external', 'effectful-external', 'read-local'][p_size % 4 + 1]"
PATTERN, CALL = "['http-reading', 'db-session-write', 'file-read-open'][p_size % 4 + 1]", "['requests.get', 'session.commit', 'open'][p_size % 4 + 1]"
F_NAME = "replace(p_name, ' ', '_') || '_' || p_partkey"
OPS = f"o AS (SELECT repo, {N} AS id, {REL.format('cli.py')} AS rel, line * 3 AS line, p_size % 4 AS c, '@command on ' || {F_NAME} || '()' AS detail, {CALL} || ' matched ' || {PATTERN} || ' (via ' || {F_NAME} || ')' AS traced FROM x)"
SQL = {
    "src_manifest_deps": "SELECT DISTINCT p_brand AS repo, 'pypi' AS ecosystem, replace(lower(p_name), ' ', '-') AS name FROM part WHERE p_size % 4 <> 0",
    "src_toml": "SELECT DISTINCT p_brand AS repo, 'pypi' AS ecosystem, replace(lower(p_name), ' ', '-') AS name FROM part UNION ALL SELECT p_brand, 'cargo', 'crate-' || p_size || '-' || p_partkey FROM part UNION ALL SELECT DISTINCT p_brand, 'malformed-toml', 'bad/d' || (p_partkey // 50) || '/Cargo.toml' FROM part",
    "src_xml": f"SELECT p_brand AS repo, 'maven' AS ecosystem, 'org.x:' || {N} AS name FROM part WHERE p_size % 4 <> 0 UNION ALL SELECT DISTINCT p_brand, 'malformed-xml', 'bad/d' || (p_partkey // 50) || '/pom.xml' FROM part",
    "agg_deps_union": """WITH n AS (SELECT p_brand AS repo, p_size, replace(p_name, ' ', '-') AS n FROM part), e AS (SELECT repo, 'npm' AS ecosystem, n FROM n UNION SELECT repo, 'npm', 'own' FROM n UNION SELECT repo, 'go', 'example.com/' || n FROM n UNION SELECT repo, 'go', 'example.com/last' FROM n UNION SELECT repo, 'gradle', 'g:' || n FROM n WHERE p_size % 2 = 0)
SELECT repo, ecosystem, string_agg(DISTINCT n, ',' ORDER BY n) AS names FROM e GROUP BY repo, ecosystem""",
    "src_secret_exclude": "SELECT page_id, ['src', 'node_modules', 'lib/vendor', 'docs'][(page_id // 11) % 4 + 1] || '/' || ['main.py', '', '', '', 'readme.md'][page_id % 11 + 1] AS rel FROM pages WHERE page_id % 11 IN (0, 4) AND (page_id // 11) % 4 IN (0, 3)",
    "src_walk": """WITH f AS (SELECT p_brand AS repo, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'b' || p_size || '/' ELSE 'b' || (p_size - 1) || '/a/' END AS folder, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name FROM part)
SELECT repo, folder || name AS rel, row_number() OVER (PARTITION BY repo ORDER BY string_split(folder, '/')[1], CASE WHEN folder LIKE '%/a/' THEN 1 ELSE 0 END, name) AS walk_ord FROM f""",
    "udf_t1_trace": f"WITH {ROWS} SELECT repo, {REL.format('cli.py')} AS rel, line * 3 AS line, {CAPABILITY} AS capability, {EFFECT} AS effect, {PATTERN} AS pattern, {CALL} || ' matched ' || {PATTERN} || ' (via ' || {F_NAME} || ')' AS detail FROM x WHERE p_size % 4 < 3",
    "udf_t1_graph": f"WITH {ROWS}, h AS (SELECT *, max(CASE WHEN line <= 3 AND p_size % 4 < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, d) AS n_some FROM x) SELECT repo, {REL.format('run.py')} AS rel, line * 3 - 1 AS line, {CAPABILITY} AS capability, {EFFECT} AS effect, {PATTERN} AS pattern, {CALL} || ' matched ' || {PATTERN} || ' (via f_' || line || ')' AS detail FROM h WHERE p_size % 4 < 3 AND (line <= 3 OR n_some = 0)",
    "udf_t1_depth": f"WITH {ROWS} SELECT repo, {REL.format('walk.py')} AS rel, line * 10 - 1 AS line, {CAPABILITY.replace('p_size', 'p_partkey')} AS capability, {EFFECT.replace('p_size', 'p_partkey')} AS effect, {PATTERN.replace('p_size', 'p_partkey')} AS pattern, {CALL.replace('p_size', 'p_partkey')} || ' matched ' || {PATTERN.replace('p_size', 'p_partkey')} || ' (via d' || p_partkey || ')' AS detail FROM x WHERE p_size % 2 = 1 AND p_partkey % 4 < 3 UNION ALL SELECT DISTINCT repo, {REL.format('walk.py')}, 1, 'file.read', 'read-local', 'file-read-open', 'open matched file-read-open (via module)' FROM x",
    "udf_mode": f"WITH {ROWS} SELECT repo, {REL.format('m.py')} AS rel, line, ['file-write-open', 'file-read-open', '', 'db-execute-read,sql-select', '', '', 'env-secret', '', 'http-request-generic', ''][p_size % 10 + 1] AS patterns, CAST(NULL AS VARCHAR) AS method FROM x",
    "op_build_operation": f"WITH {ROWS} SELECT repo, {N} AS id, coalesce({EFFECT}, 'effectful-external') AS effect, coalesce({CAPABILITY}, 'external.call') AS requires, CASE WHEN p_size % 4 = 3 THEN 'low' ELSE 'high' END AS confidence, {REL.format('cli.py')} || ':' || (line * 3 - 1) AS loc, 'manual' AS trigger, p_size % 4 = 2 AS deterministic, false AS optional, '@command on ' || {F_NAME} || '()' AS summary FROM x",
    "set_union_evidence": f"""WITH {ROWS}, {OPS}, k AS (SELECT p_brand AS repo, bool_or(p_size % 2 = 0) AS req, bool_or(p_size % 2 = 1) AS sqla FROM part WHERE length(p_brand) = 8 GROUP BY p_brand)
SELECT o.repo, id, 'declared|' || rel || ':' || (line - 1) || '|' || detail || ';' || CASE WHEN c = 3 THEN 'proposed|' || rel || ':' || (line - 1) || '|no effect traced for this operation; requires external.call as a placeholder pending review' ELSE 'traced|' || rel || ':' || line || '|' || traced END
 || CASE WHEN c = 0 AND coalesce(req, false) THEN ';inferred|manifest|pypi:requests -> requests (ambiguous)' WHEN c = 1 AND coalesce(sqla, false) THEN ';inferred|manifest|pypi:sqlalchemy -> sqlalchemy (ambiguous)' ELSE '' END AS evidence,
 CASE WHEN c = 1 AND coalesce(sqla, false) THEN 'DATABASE_URL:password' ELSE '' END AS credentials, CASE WHEN c = 3 THEN 'low' WHEN (c = 0 AND coalesce(req, false)) OR (c = 1 AND coalesce(sqla, false)) THEN 'medium' ELSE 'high' END AS confidence FROM o LEFT JOIN k USING (repo)""",
    "prd_optional": """WITH l AS (SELECT p_brand AS repo, lower('The ' || upper(regexp_extract(p_name, '^\\w+ (\\w+)', 1)) || 's step is optional.') AS low FROM part WHERE p_size % 6 = 0),
w AS (SELECT p_brand AS repo, p_partkey AS id, unnest(string_split(p_name, ' ')) AS w FROM part) SELECT DISTINCT w.repo, id FROM w JOIN l ON l.repo = w.repo AND length(w) > 3 AND contains(low, w)""",
}

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dialects, effects, regexes
from tidemark.operators import attribution, fallback, fusion, inventory, profile
from tidemark.sources import repos
from tidemark.sources.entrypoints import entrypoints

TREE = {
    "Makefile": "build: deps\n\tgcc\nVAR := 1\n.PHONY: build\n",
    "package.json": '{"scripts": {"start": "x", "lint": "y"}, "dependencies": {"KafkaJS": "1"}}',
    "requirements.txt": "requests>=2\n# none\nFoo_Bar\n",
    "app/cli.py": 'import requests\n\n@app.command()\ndef fetch():\n    requests.get("u")\n\n@app.command("push")\ndef push_all():\n    session.commit()\n',
    "app/job.py": 'def inner():\n    deep()\n\ndef deep():\n    requests.post("u")\n\ndef unused():\n    open("y", "w")\n\ninner()\n',
    "app/broken.py": "@app.command(\n",
    "README.md": "# x\nThe push command will publish results and costs money.\nNothing else is irreversible.\n",
    ".env": "SECRET=1",
    ".github/workflows/ci.yml": "on: push\njobs:\n  test:\n    runs-on: x\n  deploy:\n    steps: []\n",
    "node_modules/x/index.js": "app.get('/hidden', x)",
    "srv/index.js": "app.get('/users', (q) => {\n  const s = '}';\n  if (q) { y() }\n});\n",
    "srv/api.proto": "service Shop {\n  rpc Buy(X) returns (Y);\n}\n",
    "infra/main.tf": 'resource "aws_s3_bucket" "logs" {\n}\n',
    "k8s/a.yaml": "apiVersion: v1\nkind: Service\nmetadata:\n  name: web\n---\napiVersion: v1\nkind: Job\nmetadata:\n  labels: {}\n  name: sync\n",
    "site.yml": "- name: Setup hosts\n  hosts: all\n",
    "crontab": "0 1 * * * /usr/bin/backup --all\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return repos.read_repo(spark, str(root), "r").cache()


def test_walk(files):
    listed = {r["rel"]: r["walk_ord"] for r in files.collect()}
    assert set(listed) == set(TREE) - {".env", "node_modules/x/index.js"}
    order = sorted(listed, key=lambda rel: (rel.split("/")[:-1], rel))
    assert [listed[r] for r in order] == list(range(1, len(listed) + 1))
    assert order[0] == "Makefile" and listed["crontab"] < listed[".github/workflows/ci.yml"] < listed["app/cli.py"]


def test_unreadable_files_are_listed_without_a_text(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "kubeconfig").write_text("secret")
    (tmp_path / "prod.env").write_text("secret")
    rows = {r["rel"]: r["text"] for r in repos.read_repo(spark, str(tmp_path)).collect()}
    assert rows == {"a.py": "x = 1"}


def test_subdir_must_stay_inside(spark, tmp_path):
    with pytest.raises(Exception, match="no folder"):
        repos.read_repo(spark, str(tmp_path), subdir="../..").collect()


def test_caps(spark):
    f = spark.createDataFrame([("r", i, f"f{i}", s) for i, s in enumerate([10, 50, 10, 10, 90, 10])], "repo string, walk_ord long, rel string, size long")
    kept = repos.capped(f, ["repo"], "walk_ord", files_most=10, bytes_most=75, one_most=60)
    assert {r["rel"] for r in kept.collect()} == {"f0", "f1", "f2"}


def test_dependencies(files):
    assert {(r["ecosystem"], r["name"]) for r in repos.dependencies(files).collect()} == {("npm", "kafkajs"), ("pypi", "requests"), ("pypi", "foo-bar")}
    known, unknown = inventory.match_providers(repos.dependencies(files))
    assert {r["name"] for r in unknown.collect()} == {"foo-bar"} and known.count() == 2


def test_candidates(files):
    got = {(r["dialect"], r["id"]) for r in dialects.candidates(repos.stored(files)).collect()}
    assert got == {
        ("make-target", "make-build"), ("package-scripts", "script-start"), ("package-scripts", "script-lint"), ("cli-python", "fetch"), ("cli-python", "push"), ("github-actions", "job-test"),
        ("github-actions", "job-deploy"), ("web-js", "get-users"), ("proto-service", "shop-buy"), ("terraform", "tf-aws-s3-bucket-logs"), ("kubernetes", "k8s-service-web"),
        ("ansible", "play-setup-hosts"), ("crontab", "cron-usr-bin-backup"),
    }


def test_declarations_tell_capabilities_and_triggers(files):
    rows = {r["id"]: r for r in dialects.candidates(repos.stored(files)).collect()}
    told = {i: (rows[i]["caps"], rows[i]["effect"], rows[i]["trigger"]) for i in ("job-deploy", "cron-usr-bin-backup", "tf-aws-s3-bucket-logs", "k8s-service-web", "fetch")}
    assert told == {
        "job-deploy": (["shell.exec", "deploy.op"], "effectful-local", "event"), "cron-usr-bin-backup": (["shell.exec"], "effectful-local", "scheduled"),
        "tf-aws-s3-bucket-logs": (["storage.object"], "effectful-external", "manual"), "k8s-service-web": (["deploy.op"], "effectful-external", "manual"), "fetch": ([], None, "manual"),
    }


def test_own_dialects(files, spark):
    def notes(df):
        rows = df.where("rel = 'README.md'").select("repo", "rel", F.lit(1).alias("line"))
        return dialects.declared(rows, "notes", "note", F.lit("read me"), id=F.lit("read me"), name=F.lit("Read me"), detail=F.lit("a note"))

    dialects.register("notes", notes, ("library",))
    files = repos.stored(files)
    try:
        with pytest.raises(ValueError, match="registered already"):
            dialects.register("notes", notes)
        classes = spark.createDataFrame([("r", "library")], "repo string, repo_class string")
        got = {r["dialect"] for r in dialects.candidates(files, classes).collect()}
        assert "notes" in got and "ansible" not in got and "make-target" in got
        assert "notes" not in {r["dialect"] for r in dialects.candidates(files, classes.withColumn("repo_class", F.lit("unknown"))).collect()}
    finally:
        del dialects.READERS["notes"], dialects.CLASSES["notes"]


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("js", "f(() => {\n  const s = '}';\n  /* } */\n})", (1, 4)), ("js", "f(`}${x}`, { a: '\\\'}' })", (1, 1)), ("js", "f({ // }\n", None), ("go", "func a() {\n\tx := `}`\n}", (1, 3)), ("go", "func a() { s := \"}", None),
        ("jvm", 'void a() {\n  String s = """\n  } " }\n  """;\n}', (1, 5)), ("jvm", "char c() { return '}'; }", (1, 1)), ("rust", 'fn f<\'a>(x: &\'a str) {\n  let s = r#"}"#;\n  let c = \'}\';\n}', (1, 4)),
        ("rust", "fn f() { /* } /* } */ } */ }", (1, 1)), ("rust", 'format!("{{}}") }', None), ("js", "no braces", None),
    ],
)
def test_brace_range(language, text, expected):
    assert regexes.brace_range(text, 0, language) == expected


@pytest.mark.parametrize("language", ["js", "go", "jvm", "rust"])
def test_braces_from_every_start(language):
    """One matching of all braces gives what a scan from each start gives, inside literals and after broken ones too."""
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice(["{", "}", "{", "}", '"', "'", "`", "/*", "*/", "//", "\n", "a", "\\", 'r#"', '"#']) for _ in range(r.randint(0, 40)))
        braces = regexes.Braces(text, language)
        for start in range(len(text) + 1):
            depth, at, expected = 0, start, None
            while p := braces.piece(at):
                if p[0] == "!":
                    break
                if p[0] == "{":
                    depth += 1
                elif p[0] == "}" and depth:
                    depth -= 1
                    if not depth:
                        expected = p[1]
                        break
                at = p[2]
            assert braces.end(start) == expected, (text, start)


def test_find_gives_places(spark):
    text = "ab\nxx ab\n\nab"
    rows = regexes.find(spark.createDataFrame([("r", "f", text), ("r", "g", None), ("r", "h", "")], "repo string, rel string, text string"), {"x": regexes.Rule("a(b)", before=3)}).collect()
    assert [(r["rel"], r["line"], r["start"], r["g"], r["ahead"]) for r in rows] == [("f", 1, 0, ["ab", "b"], ""), ("f", 2, 6, ["ab", "b"], "xx "), ("f", 4, 10, ["ab", "b"], "b\n\n"[-3:])]


def test_a_text_of_many_matches_is_looked_at_in_linear_time(spark):
    """20,000 routes in one text of nested and unclosed braces; time grows in proportion, and no text leaves the function."""
    def seconds(n):
        text = "{" * 50 + "app.get('/p', (q) => {\n  if (q) { y('}') }\n});\n" * n
        rules = {k: (r, re.compile(r.pattern), None, []) for k, r in dialects.JS_RULES.items()}
        began = time.process_time()
        rows = list(regexes.looked(text, rules, "js"))
        assert len(rows) == n and all(r[9] - r[8] == 2 for r in rows)
        return time.process_time() - began

    small, large = min(seconds(2_000) for _ in range(3)), seconds(20_000)
    assert large < 30 * small
    files = spark.createDataFrame([("r", "a.js", "app.get('/p', (q) => {})\n" * 20_000)], "repo string, rel string, text string")
    rows = dialects.web_js(files)
    assert rows.count() == 20_000 and "text#" not in rows._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def sites_by_hand(graph, module, acting, depth=3):
    """Names of functions whose effect a depth-first walk finds; all of them where it finds none."""
    seen, found = set(), set()

    def walk(calls, level):
        for name in calls:
            if name in graph and name not in seen and level < depth:
                seen.add(name)
                if name in acting:
                    found.add(name)
                walk(graph[name], level + 1)

    walk(module, 0)
    return found or set(acting)


def test_trace_walks_depth_first(spark):
    r, rows, expected = random.Random(3), [], set()
    for i in range(60):
        names = [f"f{j}" for j in range(r.randint(1, 9))]
        graph = {n: [r.choice([*names, "other"]) for _ in range(r.randint(0, 4))] for n in names}
        module, acting = [r.choice(names) for _ in range(r.randint(0, 3))], {n for n in names if r.random() < 0.4}
        body = lambda n, graph=graph, acting=acting: [*(f"{c}()" for c in graph[n]), *(["requests.post('u')"] if n in acting else []), "pass"]
        text = "\n".join(f"def {n}():\n" + "\n".join(f"    {x}" for x in body(n)) for n in names) + "\n" + "\n".join(f"{m}()" for m in module)
        rows.append(("r", f"{i}.py", text))
        expected |= {(f"{i}.py", n) for n in sites_by_hand(graph, module, acting)}
    sites = effects.effect_sites(effects.python_calls(spark.createDataFrame(rows, "repo string, rel string, text string")))
    assert {(x["rel"], x["detail"].rpartition(" ")[2].rstrip(")")) for x in sites.collect()} == expected


RUST = {
    "Cargo.toml": '[workspace]\nmembers = ["crates/tool"]\n',
    "crates/tool/Cargo.toml": '[package]\nname = "t"\n[[bin]]\nname = "tool-main"\npath = "x"\n[dependencies]\nredis = "1"\n',
    "crates/tool/src/main.rs": '#[derive(Parser)]\n#[command(name = "tool", about = "x")]\nstruct Cli {}\n\n#[derive(Debug, Subcommand)]\nenum Todo {\n    /// fetch\n    FetchAll { url: String },\n    #[command(name = "show", about = "Show it")]\n    Report,\n    Status(u8),\n}\n\n#[tokio::main]\nasync fn main() {\n    println!("{{}}");\n}\n',
    "crates/tool/src/web.rs": 'fn app() {\n    Router::new().route("/a", get(h).post(h)).service(metrics_page);\n}\n\n#[get("/b")]\nasync fn b<\'a>() {\n}\n',
}
GO = {
    "cmd/x/main.go": 'package main\n\nfunc main() {\n\tcommands.Run()\n}\n',
    "cmd/root.go": 'var c = &cobra.Command{\n\tUse: "drain all",\n\tShort: "Drain {it}",\n}\n\nfunc Serve() {\n\thttp.HandleFunc("/healthz", h)\n\tclient.Get("/no")\n\tr.GET("/items/:id", h)\n}\n\nfunc NewCmd() *cobra.Command {\n\treturn nil\n}\n',
}
JVM = {
    "A.java": '@RestController\n@RequestMapping("/api")\npublic class A {\n  @GetMapping\n  public String all() {\n    return "}";\n  }\n  @RequestMapping(value = "/x", method = RequestMethod.PUT)\n  abstract String put();\n  @Scheduled(cron = "0")\n  void cleanUp() {\n  }\n}\nclass B {\n  @KafkaListener(topics = "t")\n  void onOrder(String o) {}\n  public static void main(String[] args) {}\n}\n',
}


@pytest.mark.parametrize(
    ("tree", "expected"),
    [
        (RUST, {"member-tool", "bin-tool-main", "tool", "fetchall", "show", "status", "tool-main", "get-a", "post-a", "service-metrics-page", "get-b"}),
        (GO, {"main", "drain", "serve", "http-healthz", "get-items-id"}),
        (JVM, {"get-api", "put-api-x", "scheduled-clean-up", "kafka-on-order", "main"}),
    ],
)
def test_declarations_of_braced_languages(spark, tree, expected):
    df = spark.createDataFrame([("r", k, v) for k, v in tree.items()], "repo string, rel string, text string")
    rows = {r["id"]: r for r in dialects.candidates(repos.stored(df)).collect()}
    assert set(rows) == expected
    if tree is JVM:
        assert (rows["get-api"]["lo"], rows["get-api"]["hi"]) == (4, 7) and rows["put-api-x"]["lo"] is None
        assert rows["scheduled-clean-up"]["trigger"] == "scheduled" and rows["kafka-on-order"]["caps"] == ["queue.consume"]
    if tree is RUST:
        assert rows["show"]["detail"] == "clap subcommand show — Show it" and rows["tool-main"]["kind"] == "rust-async-main"


@pytest.mark.parametrize(
    ("call", "pattern"),
    [
        ("os.environ.get('X')", None), ("d.get('X')", None), ("open('f')", "file-read-open"), ("open('f', 'w')", "file-write-open"), ("open('f', mode='rb')", "file-read-open"),
        ("session.execute('select 1')", "db-execute-read"), ("session.execute('delete')", None), ("session.execute(x)", None), ("cursor.executemany(text('x'))", "db-execute-read"), ("requests.request('GET')", "http-request-generic"),
        ("a.b.requests.get('u')", None), ("requests.sessions.get('u')", "http-reading"), ("print('x')", None), ("f(x)[0].save()", None), ("stripe.Charge.create()", "payment-resource"), ("subprocess.run([])", "subprocess-exec"), ("run()", None),
    ],
)
def test_patterns(spark, call, pattern):
    df = spark.createDataFrame([("r", "a.py", call)], "repo string, rel string, text string")
    rows = effects.matched(effects.python_calls(df)).where("pattern is not null").collect()
    assert [r["pattern"] for r in rows] == ([pattern] if pattern else [])


def test_only_what_the_module_reaches_is_traced(files):
    got = {(r["rel"], r["line"], r["capability"]) for r in effects.effect_sites(effects.python_calls(files)).collect()}
    assert got == {("app/cli.py", 5, "http.request"), ("app/cli.py", 9, "data.write"), ("app/job.py", 5, "http.request")}


def test_depth_ends_the_trace(spark):
    chain = "".join(f"def f{i}():\n    f{i + 1}()\n" for i in range(1, 5)) + "def f5():\n    open('x')\n"
    df = spark.createDataFrame([("r", "a.py", chain + "f1()\nopen('y')\n"), ("r", "b.py", chain + "f3()\nopen('y')\n")], "repo string, rel string, text string")
    got = {(r["rel"], r["line"]) for r in effects.effect_sites(effects.python_calls(df)).collect()}
    assert got == {("a.py", 12), ("b.py", 10), ("b.py", 12)}


def test_inventory(files):
    ops = {r["id"]: r for r in inventory.build_inventory(files, repos.dependencies(files)).collect()}
    assert ops["fetch"]["requires"] == ["http.request"] and ops["fetch"]["stage"] == "acquire"
    assert ops["push"]["requires"] == ["data.write"] and ops["push"]["gate"] == ["publish", "spend"] and ops["push"]["confidence"] == "high" and ops["push"]["gate_confidence"] == "low"
    assert ops["fetch"]["confidence"] == "medium"  # an import of requests alone leaves its use open
    assert ops["make-build"]["requires"] == ["shell.exec"] and ops["make-build"]["confidence"] == "medium" and ops["make-build"]["deterministic"]
    assert ops["get-users"]["requires"] == ["external.call"] and ops["get-users"]["confidence"] == "low"
    assert [(e["source"], e["loc"]) for e in ops["fetch"]["evidence"]] == [("declared", "app/cli.py:4"), ("traced", "app/cli.py:5"), ("inferred", "manifest")]
    assert {e["source"] for e in ops["get-users"]["evidence"]} == {"declared", "proposed"}
    assert all(o["requires"] and o["evidence"] for o in ops.values())


SYNC = """import click, requests, sqlalchemy


def _engine():
    return sqlalchemy.create_engine("x")


@click.group()
def cli():
    pass


@cli.command()
def fetch():
    r = requests.get("u")
    with Session(_engine()) as session:
        session.add(r)
        session.commit()


@cli.command()
def publish(target):
    body = open("d.md").read()
    requests.post(target, json=body)


@cli.command()
def status():
    with Session(_engine()) as session:
        return session.execute(select(1))


if __name__ == "__main__":
    cli()
"""


def test_a_command_line_tool_end_to_end(spark):
    tree = {
        "src/cli.py": SYNC, "pyproject.toml": '[project]\ndependencies = ["click>=8", "requests", "sqlalchemy", "feedparser", "pytest"]\n[project.scripts]\nsync = "src.cli:cli"\n',
        "README.md": "Publishing cannot be undone.\nThe status step is optional.\n",
    }
    df = spark.createDataFrame([("r", k, v, len(v)) for k, v in tree.items()], "repo string, rel string, text string, size long")
    deps = repos.dependencies(df)
    rows = {r["id"]: r for r in fallback.draft_inventory(df, deps).collect()}
    assert {"fetch", "publish", "status", "unresolved-external-calls"} <= set(rows) and "cli" not in rows
    assert set(rows["fetch"]["requires"]) == {"http.request", "data.write"}
    assert rows["status"]["stage"] == "observe" and rows["status"]["requires"] == ["data.query"] and rows["status"]["optional"]
    assert rows["publish"]["stage"] == "deliver" and rows["publish"]["effect"] == "effectful-external" and rows["publish"]["gate"] == ["irreversible", "publish"]
    assert {r["name"] for r in inventory.match_providers(deps)[1].collect()} == {"feedparser"}
    cls = profile.classify(df, deps, entrypoints(df)).first()
    assert (cls["repo_class"], cls["class_confidence"]) == ("cli-tool", "high")


def test_leftovers(spark):
    sites = spark.createDataFrame([("f", 5), ("f", 50), ("g", 1), ("h", 1)], "rel string, line int")
    ranges = spark.createDataFrame([("f", 1, 10)], "rel string, lo int, hi int")
    free = spark.createDataFrame([("f", "only"), ("g", "a"), ("g", "b")], "rel string, owner string")
    got = attribution.claim_leftovers(sites, ranges, free, ["rel"], "line", "lo", "hi", "owner").collect()
    assert {(r["rel"], r["line"], r["owner"], r["weak"]) for r in got} == {("f", 50, "only", True), ("g", 1, None, False)}


@pytest.mark.parametrize(
    ("sources", "corroboration", "ambiguous", "weak", "placeholder", "expected"),
    [
        ([], 0, False, False, False, "low"), (["proposed"], 0, False, False, False, "low"), (["declared"], 0, False, False, True, "low"), (["declared"], 0, False, False, False, "high"),
        (["declared"], 0, False, True, False, "medium"), (["declared"], 0, True, False, False, "medium"), (["traced"], 0, False, False, False, "medium"), (["traced", "inferred"], 0, False, False, False, "high"),
        (["inferred"], 2, False, False, False, "high"), (["inferred"], 1, False, False, False, "medium"), (["inferred"], 2, True, False, False, "low"), (["documented"], 0, False, False, False, "low"),
    ],
)
def test_confidence(spark, sources, corroboration, ambiguous, weak, placeholder, expected):
    df = spark.createDataFrame([(sources, corroboration, ambiguous, weak, placeholder)], "s array<string>, c int, a boolean, w boolean, p boolean")
    assert df.select(fusion.fuse_confidence(*map(F.col, "scawp")).alias("x")).first()["x"] == expected


def test_running_total_in_two_levels(spark):
    df = spark.range(1000).select(F.lit("s").alias("scope"), F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r["id"]: r["running"] for r in fusion.running_total(df, ["scope"], "id", "v", width=100).collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_draft_ladder_and_unknown_dependencies(spark):
    files = spark.createDataFrame([
        ("declares", "cli.py", '@app.command()\ndef fetch():\n    requests.get("u")\n'), ("traced", "job.py", 'requests.post("u")\nopen("f")\n'),
        ("plain", "readme.md", "nothing here"), ("traced", "other.py", "x = 1"),
    ], "repo string, rel string, text string").withColumn("size", F.length("text").cast("long"))
    deps = spark.createDataFrame([("declares", "pypi", "stripe"), ("traced", "pypi", "redis"), ("plain", "pypi", "stripe"), ("plain", "pypi", "zz"), ("plain", "npm", "zz")], "repo string, ecosystem string, name string")
    rows = {(r["repo"], r["id"], r["way"]) for r in fallback.draft_inventory(files, deps).collect()}
    assert rows == {
        ("declares", "fetch", "declared"), ("traced", "http-request-job", "sites"), ("traced", "file-read-job", "sites"),
        ("plain", "use-stripe", "providers"), ("plain", "unresolved-external-calls", "unresolved"),
    }


def test_entry_points_of_a_tree(spark):
    files = spark.createDataFrame([
        ("r", "pyproject.toml", '[project.scripts]\nx = "pkg.cli:main"\n[other]\ny = "a:b"\n'), ("r", "package.json", '{"bin": {"b": "./b.js"}, "scripts": {"start": "x", "lint": "y"}}'),
        ("r", "Makefile", "build: x\n.PHONY: build\n"), ("r", "a/b/app.py", ""), ("r", "a/b/c/app.py", ""), ("r", "main.py", None),
    ], "repo string, rel string, text string")
    assert {(r["kind"], r["loc"]) for r in entrypoints(files).collect()} == {
        ("console-script", "pkg.py"), ("cli", "./b.js"), ("script", "package.json#scripts.start"), ("make-target", "Makefile#build"), ("server", "a/b/app.py"), ("script", "main.py"),
    }

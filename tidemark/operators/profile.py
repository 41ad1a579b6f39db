"""What a repository is: manifest flags, class, reach of the tracing, sources that gave something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.repos import file_name

# Packages that tell a class.
AGENT_MARKERS = "langgraph langchain langchain-core crewai autogen pyautogen agents openai-agents smolagents llama-index llama-index-core haystack-ai semantic-kernel dspy dspy-ai".split()
WEB_MARKERS = "fastapi flask django starlette aiohttp tornado bottle sanic falcon quart express fastify koa nestjs hapi restify sails meteor".split()
CLI_MARKERS = "click typer argparse docopt fire rich-click cleo commander yargs oclif meow cac minimist inquirer prompt-toolkit textual".split()
INFRA_MARKERS = "ansible ansible-core terraform pulumi boto3-cdk".split()
# Manifests that tell a language, and suffixes of application code.
LANGUAGES = {
    "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python", "package.json": "javascript", "go.mod": "go", "Cargo.toml": "rust", "composer.json": "php",
    "Gemfile": "ruby", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
}
TONGUES = sorted(set(LANGUAGES.values()))
CODE = ("py", "js", "ts", "go", "rs", "rb", "java")
# Suffixes of code files for the tracing report; only the first is traced.
TRACED, UNTRACED = "py", tuple("js mjs cjs jsx ts tsx go rs rb java kt cs php swift c cc cpp h hpp scala ex exs".split())
FEW_CODE_FILES = 10


def suffix(rel) -> Column:
    return F.regexp_extract(rel, r"[.]([^./]+)$", 1)


def bits(value: Column, values: list[str]) -> Column:
    """Aggregate: which of a closed list of values occur, as bits of a whole number, so that a group's state is one long."""
    table = F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(v), F.lit(1 << i).cast("long"))])
    return F.coalesce(F.bit_or(table[value]), F.lit(0).cast("long"))


def named_bits(mask: str, values: list[str]) -> Column:
    """The values that bits() found, sorted."""
    return F.array_compact(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(v)) for i, v in sorted(enumerate(values), key=lambda x: x[1])]))


def flags() -> list[Column]:
    """Aggregates over the paths of a repository's files."""
    name, table = file_name(F.col("rel")), F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return [
        bits(table[name], TONGUES).alias("languages"), F.count_if(suffix("rel").isin(*CODE)).alias("n_code"), some(name == "Makefile").alias("has_make"),
        some(name.isin("Dockerfile", "docker-compose.yml", "compose.yml")).alias("has_docker"), some(F.col("rel").startswith(".github/workflows/")).alias("has_ci"), some(F.col("rel").endswith(".tf")).alias("has_terraform"),
    ]


def manifest_flags(files: DataFrame) -> DataFrame:
    """repo, languages, n_code, has_make, has_docker, has_ci, has_terraform, by the files' paths alone."""
    return files.groupBy("repo").agg(*flags()).withColumn("languages", named_bits("languages", TONGUES))


def classify(files: DataFrame, deps: DataFrame, entries: DataFrame) -> DataFrame:
    """repo, repo_class, class_confidence, signals of every repository; the first rule that holds decides.

    deps: repo, ecosystem, name; entries: repo, kind, loc, name, source. ``signals`` holds what told the class, sorted: at most
    the markers themselves and one name or place of an entry point. All three tables meet in one aggregate.
    """
    none = F.lit(None).cast("string")
    parts = {"rel": none, "package": none, "kind": none, "loc": none, "entry": none, "source": none}
    row = lambda df, **told: df.select("repo", *[told.get(k, v).alias(k) for k, v in parts.items()])
    every = row(files, rel=F.col("rel")).unionByName(row(deps.where(F.col("name").isin(*AGENT_MARKERS, *WEB_MARKERS, *CLI_MARKERS, *INFRA_MARKERS)), package=F.col("name")))
    every = every.unionByName(row(entries, kind=F.col("kind"), loc=F.col("loc"), entry=F.col("name"), source=F.col("source")))
    markers = {"agent": AGENT_MARKERS, "web": WEB_MARKERS, "cli": CLI_MARKERS, "infra": INFRA_MARKERS}
    own = (F.col("source") == "declared") & F.col("kind").isin("console-script", "cli")
    rows = every.groupBy("repo").agg(
        F.count("rel").alias("n_files"), *flags(), *[bits(F.col("package"), v).alias(k) for k, v in markers.items()],
        F.min(F.when(F.col("kind") == "server", F.col("loc"))).alias("server"), F.min(F.when(own, F.col("entry"))).alias("command"),
    ).where("n_files > 0")
    nothing = F.array().cast("array<string>")
    some = lambda c: F.col(c) != 0
    names = lambda c: named_bits(c, (markers | {"languages": TONGUES})[c])
    web, command, library = some("web") | F.col("server").isNotNull(), F.col("command").isNotNull(), some("languages") & (F.col("n_code") > 0)
    infra = some("infra") & (F.col("n_code") < FEW_CODE_FILES)
    automated = F.col("has_make") | F.col("has_docker") | F.col("has_ci")
    rules = [
        (some("agent"), "agent-system", F.lit("high"), names("agent")),
        (web, "service-app", F.when(some("web"), "high").otherwise("medium"), F.when(some("web"), names("web")).otherwise(F.array("server"))),
        (command | some("cli"), "cli-tool", F.when(command, "high").otherwise("medium"), F.when(command, F.array("command")).otherwise(names("cli"))),
        (infra, "infra-config", F.lit("medium"), names("infra")),
        (library, "library", F.lit("medium"), names("languages")),
        (automated, "infra-config", F.lit("low"), nothing),
    ]

    def first(value) -> Column:
        out = None
        for rule in rules:
            out = F.when(rule[0], value(rule)) if out is None else out.when(rule[0], value(rule))
        return out

    return rows.select(
        "repo", first(lambda r: F.lit(r[1])).otherwise("unknown").alias("repo_class"), first(lambda r: r[2]).otherwise("low").alias("class_confidence"), first(lambda r: r[3]).otherwise(nothing).alias("signals"),
    )


def tracing(files: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """How far call tracing can see a repository: repo, traceable, untraceable, languages, fidelity, effect_sites."""
    end = suffix("rel")
    rows = files.groupBy("repo").agg(F.count_if(end == TRACED).alias("traceable"), F.count_if(end.isin(*UNTRACED)).alias("untraceable"), F.array_sort(F.collect_set(F.when(end.isin(*UNTRACED), end))).alias("languages"))
    fidelity = F.when(F.col("traceable") + F.col("untraceable") == 0, "none").when(F.col("untraceable") == 0, "high").otherwise("partial")
    rows = rows.withColumn("fidelity", fidelity)
    if sites is None:
        return rows
    counts = sites.groupBy("repo").agg(F.count("*").alias("effect_sites"))
    return rows.join(counts, "repo", "left").withColumn("effect_sites", F.coalesce("effect_sites", F.lit(0)))


def sources_run(repos: DataFrame, **tables: DataFrame) -> DataFrame:
    """repo, sources: which of the tables (T0=candidates, T1=sites, T2=matches, T3=signals, T4=proposals) have rows of it."""
    out = repos.select("repo").distinct()
    for name, rows in sorted(tables.items()):
        out = out.join(rows.select("repo").distinct().withColumn(name, F.lit(name)), "repo", "left")
    return out.select("repo", F.array_compact(F.array(*sorted(tables))).alias("sources"))

"""Repositories as tables: a Python data source that walks source trees, and readers of dependency manifests.

``spark.read.format("repo").option("path", dir).load()`` gives files (repo, rel, size, text). Every directory below
``path`` that holds files is a task of its own, so a tree is read by many executors; hidden names, which Spark's own file
readers skip, are read too. Credential files are neither listed nor read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.operators.fusion import running_total
from tidemark.sources.tables import new_path

# Directories that a walk leaves out.
IGNORED_DIRS = (
    ".git .hg .svn node_modules vendor dist build target .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox "
    "site-packages .next .nuxt coverage htmlcov .idea .vscode bower_components"
).split()
# Suffixes of generated code.
GENERATED = ("_pb2.py", "_pb2_grpc.py", ".min.js", ".bundle.js", ".lock")
# Names and suffixes of credential files, compared in lower case; names that begin with .env count as well.
SECRET_NAMES = (
    ".env .env.local .env.production .env.development .env.test .netrc _netrc .npmrc .pypirc .dockercfg .git-credentials credentials "
    "credentials.json secrets.json secrets.yaml secrets.yml id_rsa id_dsa id_ecdsa id_ed25519 service-account.json kubeconfig "
    ".htpasswd shadow"
).split()
SECRET_SUFFIXES = (".pem", ".key", ".pfx", ".p12", ".jks", ".keystore", ".ppk", ".env", ".envrc")
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 20_000, 2_000_000, 200_000_000
SCHEMA = "repo string, rel string, size long, text string"
#: What a file's readers tell it by: the extensions of each family; names and folders decide before them.
FAMILIES = {
    "python": ("py",), "javascript": ("js", "mjs", "cjs", "jsx", "ts", "tsx"), "go": ("go",), "jvm": ("java", "kt"), "rust": ("rs",), "terraform": ("tf",), "proto": ("proto",),
    "yaml": ("yml", "yaml"), "json": ("json",), "toml": ("toml",), "unit": ("service", "timer", "socket"), "make": ("mk",), "cron": ("cron",), "xml": ("xml",), "gradle": ("gradle", "kts"), "mod": ("mod",),
    "document": ("md", "rst", "txt"),
}


def basename(rel) -> Column:
    return F.lower(F.substring_index(rel, "/", -1))


def file_name(rel) -> Column:
    return F.substring_index(rel, "/", -1)


def stem(rel) -> Column:
    """The file name up to its last dot."""
    return F.regexp_replace(file_name(rel), r"[.][^.]*$", "")


def is_secret_file(rel) -> Column:
    name = basename(rel)
    return name.isin(*SECRET_NAMES) | name.startswith(".env") | name.rlike("(" + "|".join(s.replace(".", "[.]") for s in SECRET_SUFFIXES) + ")$")


def in_ignored_dir(rel) -> Column:
    dirs = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    return F.arrays_overlap(dirs, F.array(*map(F.lit, IGNORED_DIRS)))


def is_generated(rel) -> Column:
    return rel.rlike("(" + "|".join(s.replace(".", "[.]") for s in GENERATED) + ")$")


def listable(files: DataFrame) -> DataFrame:
    """Files that a scan may list, from rows with ``rel``."""
    return files.where(~(in_ignored_dir(F.col("rel")) | is_generated(F.col("rel")) | is_secret_file(F.col("rel"))))


def under_caps(files: DataFrame, scope: list[str], order: str, files_most: int, bytes_most: int, one_most: int) -> DataFrame:
    """Files with ``_kept`` and ``_crossed``: the cap that ends the walk at this file, if one does there.

    A file over ``one_most`` is passed over, but there being one more file after the last allowed one ends the walk like any other.
    Running counts and sizes of what is kept go in two levels, so a large scope is never one task.
    """
    small = F.coalesce(F.col("size") <= one_most, F.lit(False))
    rows = files.withColumn("_small", small).withColumn("_one", small.cast("long")).withColumn("_size", F.when(small, F.col("size")).otherwise(0))
    placed = running_total(running_total(rows, scope, order, "_size").withColumnRenamed("running", "_bytes"), scope, order, "_one").withColumnRenamed("running", "_files")
    crossed = F.when(F.col("_files") - F.col("_one") >= files_most, "files").when(F.col("_small") & (F.col("_bytes") > bytes_most), "bytes")
    kept = F.col("_small") & (F.col("_bytes") <= bytes_most) & (F.col("_files") <= files_most)
    return placed.withColumn("_kept", kept).withColumn("_crossed", crossed).drop("_bytes", "_files", "_one", "_size", "_small")


def capped(files: DataFrame, scope: list[str], order: str, files_most: int = MAX_FILES, bytes_most: int = MAX_TOTAL_BYTES, one_most: int = MAX_FILE_BYTES) -> DataFrame:
    """Files of a scope in walk order (an integer) until its caps: a file over ``one_most`` is left out; the one that crosses the total ends the walk."""
    return under_caps(files, scope, order, files_most, bytes_most, one_most).where("_kept").drop("_kept", "_crossed")


def scans(files: DataFrame, scope: list[str], order: str, files_most: int = MAX_FILES, bytes_most: int = MAX_TOTAL_BYTES, one_most: int = MAX_FILE_BYTES) -> DataFrame:
    """How the scan of each scope went: scope, n_files and n_bytes kept, truncated, reason (the cap that was crossed first), at (where)."""
    rows = under_caps(files, scope, order, files_most, bytes_most, one_most)
    first = F.min(F.when(F.col("_crossed").isNotNull(), F.struct(F.col(order).alias("at"), F.col("_crossed").alias("reason"))))
    out = rows.groupBy(*scope).agg(F.count_if("_kept").alias("n_files"), F.coalesce(F.sum(F.when(F.col("_kept"), F.col("size"))), F.lit(0)).alias("n_bytes"), first.alias("x"))
    told = F.when(F.col("x.reason") == "files", f"more than {files_most} files").when(F.col("x.reason") == "bytes", f"more than {bytes_most} bytes")
    return out.select(*scope, "n_files", "n_bytes", F.col("x").isNotNull().alias("truncated"), told.alias("reason"), "x.at")


def find(files: DataFrame, name: str) -> DataFrame:
    """Files of a base name, shallowest first, then by path."""
    return files.where(basename(F.col("rel")) == name.lower()).orderBy(F.size(F.split("rel", "/")), "rel")


def walked(files: DataFrame) -> DataFrame:
    """Add walk_ord, the place (from 1) of a file in a walk of its repository: a folder's files by name, then its subfolders.

    Only paths are numbered, texts stay where they are: files are counted by folder, folders' running sums go over the folders
    alone, and a file's place in its folder comes last. The numbers are joined to the files by path.
    """
    parts = F.split("rel", "/")
    folder = F.slice(parts, 1, F.size(parts) - 1)
    paths = files.select("repo", "rel", folder.alias("_folder")).distinct()
    # A folder comes after the files of the folder that holds it, so shorter paths sort first: array order does that.
    before = Window.partitionBy("repo").orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = paths.groupBy("repo", "_folder").agg(F.count("*").alias("_n"))
    folders = folders.select("repo", "_folder", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = paths.withColumn("_place", F.row_number().over(Window.partitionBy("repo", "_folder").orderBy("rel")))
    numbers = inside.join(folders, ["repo", "_folder"]).select("repo", "rel", (F.col("_base") + F.col("_place")).alias("walk_ord"))
    return files.join(numbers, ["repo", "rel"])


def family_of(rel: Column) -> Column:
    """The family of readers that a file belongs to; 'other' where none reads it."""
    extension, name = F.lower(F.regexp_extract(rel, r"[.]([^./]+)$", 1)), basename(rel)
    table = F.create_map(*[F.lit(x) for family, ends in FAMILIES.items() for e in ends for x in (e, family)])
    return (
        F.when(name.isin("makefile", "gnumakefile"), "make").when(name.startswith("crontab") | F.contains(rel, F.lit("/cron.d/")), "cron")
        .otherwise(F.coalesce(table[extension], F.when(name.rlike("readme|contributing|architecture|security|adr"), "document"), F.lit("other")))
    )


def stored(files: DataFrame) -> DataFrame:
    """The files, written once to the shared folder by family: each dialect then reads the folder of its own family alone."""
    if "family" in files.columns:
        return files
    path = new_path(files.sparkSession, "files")
    files.withColumn("family", family_of(F.col("rel"))).write.partitionBy("family").parquet(path)
    schema = files.select("*", F.lit("").alias("family")).schema
    return files.sparkSession.read.schema(schema).parquet(path)


def of(files: DataFrame, *families: str) -> DataFrame:
    """Rows with a text, of the given families where the files are stored by family."""
    kept = files.where("text is not null")
    return kept.where(F.col("family").isin(*families)) if "family" in files.columns else kept


class Folder(InputPartition):
    def __init__(self, root: str, rel: str):
        super().__init__(None)
        self.root, self.rel = root, rel


class RepoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        sub = options.get("subdir", "")
        self.start = os.path.normpath(os.path.join(self.root, sub))
        if os.path.commonpath([self.root, self.start]) != self.root or not os.path.isdir(self.start):
            raise ValueError(f"no folder {sub!r} inside {self.root}")
        self.repo = options.get("repo", os.path.basename(self.root))
        self.most = int(options.get("maxFileBytes", MAX_FILE_BYTES))

    def partitions(self) -> list[Folder]:
        found = []
        for here, dirs, names in os.walk(self.start, followlinks=False):
            dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS and not os.path.islink(os.path.join(here, d)))
            if names:
                found.append(Folder(self.root, os.path.relpath(here, self.root)))
        return found or [Folder(self.root, os.path.relpath(self.start, self.root))]

    def read(self, part: Folder) -> Iterator[tuple]:
        here = os.path.join(part.root, part.rel)
        for name in sorted(os.listdir(here)):
            path, low = os.path.join(here, name), name.lower()
            if os.path.islink(path) or not os.path.isfile(path) or name.endswith(GENERATED):
                continue
            if low in SECRET_NAMES or low.startswith(".env") or low.endswith(SECRET_SUFFIXES):
                continue
            text, size = None, None
            try:
                size = os.path.getsize(path)
                if size <= self.most:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        text = f.read()
            except OSError:  # a file that can't be read is listed with a null text
                pass
            yield self.repo, os.path.normpath(os.path.join(part.rel, name)).replace(os.sep, "/"), size, text


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoReader:
        return RepoReader(self.options)


def read_repo(spark: SparkSession, path: str, repo: str | None = None, subdir: str = "") -> DataFrame:
    """Files of a source tree with their place in the walk."""
    spark.dataSource.register(RepoSource)
    options = {"path": path, "subdir": subdir} | ({"repo": repo} if repo else {})
    return walked(spark.read.format("repo").options(**options).load())


def toml_json(text: Column, strict: bool = False) -> Column:
    """A TOML document as JSON, by an Arrow UDF over the standard parser; a malformed one is null, or raises if ``strict``."""
    import json
    import tomllib

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                try:
                    out.append(None if t is None else json.dumps(tomllib.loads(t), default=str))
                except tomllib.TOMLDecodeError as e:
                    if strict:
                        raise ValueError(f"malformed TOML: {e}") from None
                    out.append(None)
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(text)


def well_formed(text: Column) -> Column:
    """Whether a text is an XML document; xpath() fails on one that isn't."""
    kept = F.from_xml(text, "_bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    return kept.isNotNull() & kept["_bad"].isNull()


def manifest_problems(files: DataFrame) -> DataFrame:
    """Manifests that can't be read: repo, rel, problem. Their dependencies are missing from ``dependencies``."""
    name = file_name(F.col("rel"))
    toml = of(files, "toml").where(name.isin("pyproject.toml", "Cargo.toml")).withColumn("_json", toml_json(F.col("text"))).where("_json is null").select("repo", "rel", F.lit("malformed-toml").alias("problem"))
    bad_json = of(files, "json").where((name == "package.json") & F.get_json_object("text", "$").isNull()).select("repo", "rel", F.lit("malformed-json").alias("problem"))
    xml = of(files, "xml").where((name == "pom.xml") & ~well_formed(F.col("text"))).select("repo", "rel", F.lit("malformed-xml").alias("problem"))
    mod = of(files, "mod").where((name == "go.mod") & ~F.col("text").rlike(r"(?m)^module\s+\S")).select("repo", "rel", F.lit("no-module").alias("problem"))
    return toml.unionByName(bad_json).unionByName(xml).unionByName(mod)


def dependencies(files: DataFrame) -> DataFrame:
    """deps (repo, ecosystem, name) of all manifests: requirements, pyproject, setup.cfg, package.json, Cargo, go.mod, pom and Gradle files."""
    from tidemark.functions.text import requirement_name

    name = file_name(F.col("rel"))
    none = F.array().cast("array<string>")
    at = lambda family, *names: of(files, family, "document", "other").where(name.isin(*names))
    row = lambda rows, eco, names: rows.select("repo", F.lit(eco).alias("ecosystem"), F.explode(names).alias("name"))
    keys = lambda json, *paths: F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object(json, p)), none) for p in paths]))
    strings = lambda json, path: F.coalesce(F.from_json(F.get_json_object(json, path), "array<string>"), none)
    wanted = lambda lines: F.filter(F.transform(lines, requirement_name), lambda n: n.isNotNull())

    listed = row(at("document", "requirements.txt"), "pypi", wanted(F.split("text", "\n")))
    toml = at("toml", "pyproject.toml", "Cargo.toml").withColumn("json", toml_json(F.col("text"))).where("json is not null")
    extras = F.flatten(F.map_values(F.coalesce(F.from_json(F.get_json_object("json", "$.project.optional-dependencies"), "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))))
    poetry = F.transform(F.filter(keys("json", "$.tool.poetry.dependencies"), lambda n: F.lower(n) != "python"), lambda n: F.translate(F.lower(n), "_", "-"))
    project = row(toml.where(name == "pyproject.toml"), "pypi", F.concat(wanted(F.concat(strings("json", "$.project.dependencies"), extras)), poetry))
    section = F.regexp_extract("text", r"(?m)^\s*install_requires[^\n]*\n((?:[ \t]+[^\n]*(?:\n|\z)|\n)*)", 1)
    setup = row(at("other", "setup.cfg"), "pypi", wanted(F.split(section, "\n")))
    node = row(at("json", "package.json"), "npm", keys("text", "$.dependencies", "$.devDependencies", "$.peerDependencies"))
    cargo = row(toml.where(name == "Cargo.toml"), "cargo", keys("json", "$.dependencies", "$.dev-dependencies", "$.build-dependencies", "$.workspace.dependencies"))
    bare = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(F.substring_index(x, "//", 1), r"^\s+|\s+$", ""))
    block = F.flatten(F.transform(F.regexp_extract_all(F.array_join(bare, "\n"), F.lit(r"(?ms)^require\s*\($(.*?)(?:^\)|\z)"), F.lit(1)), lambda b: F.regexp_extract_all(b, F.lit(r"(?m)^(\S+)"), F.lit(1))))
    single = F.regexp_extract_all(F.array_join(bare, "\n"), F.lit(r"(?m)^require\s+([^\s(]\S*)\s+\S+"), F.lit(1))
    go = row(at("mod", "go.mod").where(F.col("text").rlike(r"(?m)^module\s+\S")), "go", F.concat(block, single))
    dependency = '//*[local-name()="dependencies"]/*[local-name()="dependency"][*[local-name()="groupId"]/text() and *[local-name()="artifactId"]/text()]/*[local-name()="{}"]/text()'
    group, artifact = (F.xpath("text", F.lit(dependency.format(x))) for x in ("groupId", "artifactId"))
    pom = row(at("xml", "pom.xml").where(well_formed(F.col("text"))), "maven", F.zip_with(group, artifact, lambda g, a: F.concat_ws(":", F.trim(g), F.trim(a))))
    gradle_line = (
        r"(?m)^[ \t]*(?:implementation|api|compileOnly|compileOnlyApi|runtimeOnly|testImplementation|testRuntimeOnly|testCompileOnly|annotationProcessor|kapt|ksp|developmentOnly|providedCompile)"
        r"\s*[(\s]\s*[\"']([^\"':\s]+:[^\"':\s]+)(?::[^\"']*)?[\"']"
    )
    gradle = row(at("gradle", "build.gradle", "build.gradle.kts"), "gradle", F.regexp_extract_all("text", F.lit(gradle_line), F.lit(1)))
    every = listed
    for rows in (project, setup, node, cargo, go, pom, gradle):
        every = every.unionByName(rows)
    return every.select("repo", "ecosystem", F.lower("name").alias("name")).distinct()

"""Folders of text files: a data source that writes lines as packages, all or none, and a reader of what was written.

Each task writes its packages into a folder of its own under a staging folder of the root, which driver and executors share; a
retried or speculative task has another one. The commit moves whole packages into place, first making sure that none of their
folders holds anything; if a move fails, those already moved are taken back. An abort renames the staging folder before it
deletes it, so tasks that are still running find no place to write and leave nothing behind.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.operators.packages import LINE


class PackageError(Exception):
    pass


@dataclass
class Written(WriterCommitMessage):
    folder: str
    packages: list[str]


def inside(root: str, *parts: str) -> str:
    """The path of parts below a root; an error where they lead out of it or to it."""
    path = os.path.normpath(os.path.join(root, *parts))
    if os.path.isabs(os.path.join(*parts)) or os.path.commonpath([root, path]) != root or path == root:
        raise PackageError(f"{os.path.join(*parts)!r} is no path inside {root}")
    return path


def local(root: str) -> str:
    """The path of a root, which may be given as a URL of files."""
    if "://" in root and not root.startswith("file://"):
        raise PackageError(f"{root!r} is no folder that driver and executors share")
    return os.path.abspath(root.removeprefix("file://"))


def make_folders(top: str, path: str) -> None:
    """Make the folders of a path below ``top``, which must be there."""
    at = top
    for part in os.path.relpath(path, top).split(os.sep):
        at = os.path.join(at, part)
        if not os.path.isdir(at):
            os.mkdir(at)


def occupied(path: str) -> bool:
    return os.path.lexists(path) and not (os.path.isdir(path) and not os.listdir(path))


class PackageWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = os.path.abspath(root)
        self.staging = os.path.join(self.root, f".staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        """Rows of LINE, a package's together and in order; a file stays open until the next one's first line."""
        folder, packages, last, out, made = os.path.join(self.staging, uuid.uuid4().hex), [], None, None, None
        try:
            for r in iterator:
                if last is None or r["package"] != last[0]:
                    if occupied(inside(self.root, r["package"])):
                        raise PackageError(f"the folder of package {r['package']!r} isn't empty")
                    if os.path.dirname(r["package"]) or r["package"].startswith("."):
                        raise PackageError(f"{r['package']!r} is no name of a package")
                    packages.append(r["package"])
                if last != (r["package"], r["rel"]):
                    if out:
                        out.close()
                    last = (r["package"], r["rel"])
                    path = inside(os.path.join(folder, r["package"]), r["rel"])
                    if os.path.dirname(path) != made:
                        make_folders(self.staging, made := os.path.dirname(path))
                    out = open(path, "x", encoding="utf-8", newline="\n")  # noqa: SIM115
                out.write(r["line"] + "\n")
        finally:
            if out:
                out.close()
        return Written(folder, packages)

    def commit(self, messages: list[Written | None]) -> None:
        moves = lambda: ((os.path.join(m.folder, p), os.path.join(self.root, p)) for m in messages if m for p in m.packages)
        seen, taken, done = set(), set(), 0
        try:
            for _, target in moves():
                name = os.path.basename(target)
                if name in seen or occupied(target):
                    taken.add(name)
                seen.add(name)
            if taken:
                raise PackageError(f"folders of packages aren't empty or come twice: {sorted(taken)[:10]}")
            for source, target in moves():
                if os.path.isdir(target):
                    os.rmdir(target)
                os.rename(source, target)
                done += 1
        except BaseException:
            for source, target in reversed(list(islice(moves(), done))):
                os.rename(target, source)
            raise
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.staging}-gone"
        if os.path.isdir(self.staging):
            os.rename(self.staging, gone)
        shutil.rmtree(gone, ignore_errors=True)


class PackageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return "package string, rel string, section int, at string, place long, line string"

    def writer(self, schema, overwrite: bool) -> PackageWriter:
        writer = PackageWriter(self.options["path"])
        os.makedirs(writer.staging)
        return writer


def write_packages(lines: DataFrame, root: str, refused: DataFrame | None = None, parts: int | None = None) -> None:
    """Write the packages of ``lines`` (operators.packages.LINE) below ``root``, a folder that driver and executors share.

    Nothing is written if anything is refused (rows of packages.refusals), if a package's folder holds anything, or if a task fails
    for good. The lines of a package meet in one task, sorted on disk if need be, and are streamed to its files.
    """
    if refused is not None and (found := refused.limit(10).collect()):
        raise PackageError(f"refused: {[tuple(r) for r in found]}")
    os.makedirs(local(root), exist_ok=True)
    lines.sparkSession.dataSource.register(PackageSink)
    dealt = lines.repartition(parts, "package") if parts else lines.repartition("package")
    typed = dealt.select("package", "rel", F.col("section").cast("int").alias("section"), "at", F.col("place").cast("long").alias("place"), "line")
    typed.sortWithinPartitions(*LINE).write.format("packages").mode("append").save(local(root))


def entries(folder: str) -> Iterator[os.DirEntry]:
    """What a folder holds, one at a time: no list of it is kept."""
    with os.scandir(folder) as found:
        yield from found


def batches(rows: Iterator[tuple], schema: pa.Schema, size=lambda row: 1, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as batches, each ended by the row that brings it to ``most``."""
    kept, n = [], 0
    for r in rows:
        kept.append(r)
        n += size(r)
        if n >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
            kept, n = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), schema)], schema=schema)


PACKAGE = pa.schema([("package", pa.string())])
FILE = pa.schema([*PACKAGE, ("rel", pa.string())])
TEXT = pa.schema([*FILE, ("text", pa.binary())])
#: Bytes of files that are handed on together; a longer file goes alone.
BATCH_BYTES = 4 << 20


def packages_in(root: str) -> Iterator[tuple[str]]:
    return ((e.name,) for e in entries(root) if not e.name.startswith(".") and e.is_dir())


def files_in(root: str, package: str) -> Iterator[tuple[str, str]]:
    """The files of a package at any depth; of folders only those still to be looked into are kept."""
    top, left = os.path.join(root, package), [""]
    while left:
        at = left.pop()
        for e in entries(os.path.join(top, at)):
            if e.is_dir():
                left.append(os.path.join(at, e.name))
            elif e.is_file():
                yield package, os.path.join(at, e.name)


def content(root: str, package: str, rel: str) -> tuple[str, str, bytes]:
    with open(os.path.join(root, package, rel), "rb") as f:
        return package, rel, f.read()


def read_packages(spark: SparkSession, root: str) -> DataFrame:
    """package, rel and text of the files below a root, a folder that driver and executors share.

    The driver lists nothing: one task streams the names of the packages, those are dealt to tasks that stream the names of their
    files, and these, whatever package they are of, to tasks that read them. So no memory grows with the number of files.
    """
    top, parts = local(root), int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = lambda batch: zip(*(c.to_pylist() for c in batch.columns))
    names = spark.range(0, 1, 1, 1).mapInArrow(lambda given: (b for _ in given for b in batches(packages_in(top), PACKAGE)), "package string")
    below = lambda given: batches((f for b in given for (p,) in told(b) for f in files_in(top, p)), FILE)
    texts = lambda given: batches((content(top, p, rel) for b in given for p, rel in told(b)), TEXT, lambda r: len(r[2]) + 1024, BATCH_BYTES)
    files = names.repartition(parts, "package").mapInArrow(below, "package string, rel string").repartition(parts, "package", "rel")
    return files.mapInArrow(texts, "package string, rel string, text binary").withColumn("text", F.col("text").cast("string"))

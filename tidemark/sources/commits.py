"""Files of a pinned commit, read from a local object store without a checkout.

The driver resolves the commit and walks its trees; executors read the blobs of their share of the paths, loose or from packs, by
pack index and along delta chains. Files that a walk of the working tree leaves out are left out here as well; links and
modules are no files. Object stores are those of the version control's format with 20-byte names and index version 2.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.repos import GENERATED, IGNORED_DIRS, MAX_FILE_BYTES, SCHEMA, SECRET_NAMES, SECRET_SUFFIXES, walked

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAMED_DELTA = 6, 7
PATHS_A_PART = 500
NAME = re.compile(r"[0-9a-f]{7,40}")
REFS = ("{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}", "refs/remotes/origin/{}")
#: Addresses that can't be taken for an option: of the web, of a file, or git@host:path.
ADDRESS = r"^(?:(?:https?|git|ssh)://\S+|git@[A-Za-z0-9._-]+:\S+|file:///\S+)$"


class StoreError(Exception):
    pass


def safe_address(address: Column) -> Column:
    """An address that may be handed on; false for null, empty and what begins like an option."""
    return F.coalesce(address.rlike(ADDRESS) & ~address.startswith("-"), F.lit(False))


def inflated(data, at: int, size: int) -> bytes:
    """``size`` bytes of the stream that begins at an offset, read in steps."""
    unpack, out = zlib.decompressobj(), []
    while not unpack.eof:
        piece = data[at : at + 65536]
        if not piece:
            raise StoreError("a packed object breaks off")
        out.append(unpack.decompress(piece))
        at += len(piece)
    whole = b"".join(out)
    if len(whole) != size:
        raise StoreError(f"a packed object has {len(whole)} bytes in place of {size}")
    return whole


def varint(data, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, least first, and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return value, at


def patched(base: bytes, delta: bytes) -> bytes:
    """A delta's copies and inserts worked off against its base."""
    size, at = varint(delta, 0)
    want, at = varint(delta, at)
    if size != len(base):
        raise StoreError("a delta doesn't fit its base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            fields = []
            for bits in (4, 3):
                value = 0
                for i in range(bits):
                    if op & 1:
                        value |= delta[at] << 8 * i
                        at += 1
                    op >>= 1
                fields.append(value)
            start, n = fields[0], fields[1] or 0x10000
            out += base[start : start + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise StoreError("a delta has an empty step")
    if len(out) != want:
        raise StoreError("a delta gives another size than it says")
    return bytes(out)


class Pack:
    """One pack and its index, both mapped."""

    def __init__(self, index: str):
        self.names, self.data = (self.mapped(p) for p in (index, index[:-3] + "pack"))
        if self.names[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise StoreError(f"{index}: no index of version 2")
        self.fan = struct.unpack(">256I", self.names[8 : 8 + 1024])
        self.n, self.known = self.fan[255], OrderedDict()

    @staticmethod
    def mapped(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def name(self, i: int) -> bytes:
        return self.names[1032 + 20 * i : 1052 + 20 * i]

    def range_of(self, prefix: bytes) -> range:
        """Places of the names that begin with some bytes."""
        lo, hi = self.fan[prefix[0] - 1] if prefix[0] else 0, self.fan[prefix[0]]
        first = bisect_left(range(lo, hi), prefix, key=lambda i: self.name(i)[: len(prefix)]) + lo
        last = first
        while last < hi and self.name(last).startswith(prefix):
            last += 1
        return range(first, last)

    def offset(self, sha: bytes) -> int | None:
        found = self.range_of(sha)
        if not found:
            return None
        at = 1032 + 24 * self.n + 4 * found[0]
        (small,) = struct.unpack(">I", self.names[at : at + 4])
        if small < 1 << 31:
            return small
        at = 1032 + 28 * self.n + 8 * (small & 0x7FFFFFFF)
        return struct.unpack(">Q", self.names[at : at + 8])[0]

    def read(self, offset: int, store: Store) -> tuple[str, bytes]:
        """Kind and bytes of an object: deltas are gathered down to a whole object, then worked off upwards."""
        chain, at = [], offset
        while True:
            if at in self.known:
                kind, body = self.known[at]
                break
            b = self.data[at]
            code, size, pos, shift = b >> 4 & 7, b & 15, at + 1, 4
            while b & 128:
                b = self.data[pos]
                size, pos, shift = size | (b & 127) << shift, pos + 1, shift + 7
            if code == OFFSET_DELTA:
                b = self.data[pos]
                back, pos = b & 127, pos + 1
                while b & 128:
                    b = self.data[pos]
                    back, pos = (back + 1) << 7 | b & 127, pos + 1
                chain.append((at, inflated(self.data, pos, size)))
                at -= back
            elif code == NAMED_DELTA:
                base = self.data[pos : pos + 20]
                chain.append((at, inflated(self.data, pos + 20, size)))
                kind, body = store.read(base)
                break
            elif code in KINDS:
                kind, body = KINDS[code], inflated(self.data, pos, size)
                self.keep(at, kind, body)
                break
            else:
                raise StoreError(f"a packed object of kind {code}")
        for place, delta in reversed(chain):
            body = patched(body, delta)
            self.keep(place, kind, body)
        return kind, body

    def keep(self, at: int, kind: str, body: bytes) -> None:
        """The last few objects stay at hand, as deltas of neighbours share bases."""
        if len(body) < 1 << 20:
            self.known[at] = (kind, body)
            if len(self.known) > 64:
                self.known.popitem(last=False)


class Store:
    """The objects of a repository: its own folder, and those it borrows from."""

    def __init__(self, path: str):
        inner = os.path.join(path, ".git")
        if os.path.isfile(inner):  # a working tree that keeps its store elsewhere
            with open(inner, encoding="utf-8") as f:
                inner = os.path.join(path, f.read().removeprefix("gitdir:").strip())
        self.root = inner if os.path.isdir(inner) else path
        common = os.path.join(self.root, "commondir")
        self.shared = self.root
        if os.path.isfile(common):
            with open(common, encoding="utf-8") as f:
                self.shared = os.path.normpath(os.path.join(self.root, f.read().strip()))
        if not os.path.isdir(os.path.join(self.shared, "objects")):
            raise StoreError(f"no object store in {path}")
        self.folders, self.packs = [os.path.join(self.shared, "objects")], None
        for folder in self.folders:
            borrowed = os.path.join(folder, "info", "alternates")
            if os.path.isfile(borrowed):
                with open(borrowed, encoding="utf-8") as f:
                    self.folders += [p for line in f.read().split("\n") if line and not line.startswith("#") and (p := os.path.normpath(os.path.join(folder, line))) not in self.folders]

    def all_packs(self) -> list[Pack]:
        if self.packs is None:
            found = [os.path.join(f, "pack", n) for f in self.folders if os.path.isdir(os.path.join(f, "pack")) for n in sorted(os.listdir(os.path.join(f, "pack"))) if n.endswith(".idx")]
            self.packs = [Pack(p) for p in found]
        return self.packs

    def read(self, sha: bytes) -> tuple[str, bytes]:
        name = sha.hex()
        for folder in self.folders:
            path = os.path.join(folder, name[:2], name[2:])
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    head, _, body = zlib.decompress(f.read()).partition(b"\0")
                kind, _, size = head.decode().partition(" ")
                if int(size) != len(body):
                    raise StoreError(f"object {name} is damaged")
                return kind, body
        for pack in self.all_packs():
            if (at := pack.offset(sha)) is not None:
                return pack.read(at, self)
        raise StoreError(f"object {name} isn't in the store")

    def ref(self, name: str, depth: int = 8) -> str | None:
        """What a name of a branch, a tag or HEAD stands for."""
        if depth == 0 or ".." in name or os.path.isabs(name):
            return None
        for root in (self.root, self.shared):
            path = os.path.join(root, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8") as f:
                    told = f.read().strip()
                return self.ref(told[5:].strip(), depth - 1) if told.startswith("ref:") else told
        packed = os.path.join(self.shared, "packed-refs")
        if os.path.isfile(packed):
            with open(packed, encoding="utf-8") as f:
                for line in f:
                    sha, _, known = line.strip().partition(" ")
                    if known == name and not line.startswith(("#", "^")):
                        return sha
        return None

    def commit(self, pin: str) -> bytes:
        """The commit that a name, a whole or a shortened hash, or a tag stands for."""
        told = next((r for form in REFS if (r := self.ref(form.format(pin)))), None) if not pin.startswith("-") else None
        if told is None and NAME.fullmatch(pin.lower()):
            told = self.whole(pin.lower())
        if told is None:
            raise StoreError(f"no commit {pin!r}")
        sha = bytes.fromhex(told)
        for _ in range(8):
            kind, body = self.read(sha)
            if kind == "commit":
                return sha
            if kind != "tag":
                break
            sha = bytes.fromhex(body[7:47].decode())
        raise StoreError(f"{pin!r} is no commit")

    def whole(self, short: str) -> str | None:
        if len(short) == 40:
            return short
        even = bytes.fromhex(short[: len(short) // 2 * 2])
        found = {p.name(i).hex() for p in self.all_packs() for i in p.range_of(even)}
        for folder in self.folders:
            loose = os.path.join(folder, short[:2])
            found |= {short[:2] + n for n in os.listdir(loose)} if os.path.isdir(loose) else set()
        fit = sorted(x for x in found if x.startswith(short))
        if len(fit) > 1:
            raise StoreError(f"{short!r} stands for {len(fit)} objects")
        return fit[0] if fit else None

    def files(self, commit: bytes) -> Iterator[tuple[str, bytes]]:
        """Paths and names of the blobs of a commit's tree that a walk would list."""
        kind, body = self.read(commit)
        open_ = [("", bytes.fromhex(body[5:45].decode()))]
        while open_:
            folder, sha = open_.pop()
            _, tree = self.read(sha)
            at = 0
            while at < len(tree):
                end = tree.index(b"\0", at)
                mode, _, name = tree[at:end].partition(b" ")
                name, child, at = name.decode("utf-8", "replace"), tree[end + 1 : end + 21], end + 21
                if mode == b"40000":
                    if name not in IGNORED_DIRS:
                        open_.append((f"{folder}{name}/", child))
                elif mode.startswith(b"100"):
                    low = name.lower()
                    if not (name.endswith(GENERATED) or low in SECRET_NAMES or low.startswith(".env") or low.endswith(SECRET_SUFFIXES)):
                        yield folder + name, child


class Share(InputPartition):
    def __init__(self, blobs: list[tuple[str, bytes]]):
        super().__init__(None)
        self.blobs = blobs


class CommitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = os.path.abspath(options["path"])
        self.pin, self.sub = options.get("commit", "HEAD"), options.get("subdir", "").strip("/")
        self.repo = options.get("repo", os.path.basename(self.path).removesuffix(".git"))
        self.most = int(options.get("maxFileBytes", MAX_FILE_BYTES))

    def partitions(self) -> list[Share]:
        store = Store(self.path)
        commit = store.commit(self.pin)
        inside = f"{self.sub}/" if self.sub else ""
        blobs = sorted(b for b in store.files(commit) if b[0].startswith(inside))
        if inside and not blobs:
            raise StoreError(f"no folder {self.sub!r} in {self.pin}")
        return [Share(blobs[i : i + PATHS_A_PART]) for i in range(0, len(blobs), PATHS_A_PART)] or [Share([])]

    def read(self, part: Share) -> Iterator[tuple]:
        store = Store(self.path)
        for rel, sha in part.blobs:
            _, body = store.read(sha)
            text = None
            if len(body) <= self.most:
                text = body.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            yield self.repo, rel, len(body), text


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "commit"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommitReader:
        return CommitReader(self.options)


def read_commit(spark: SparkSession, path: str, commit: str = "HEAD", repo: str | None = None, subdir: str = "") -> DataFrame:
    """Files of a commit with their place in the walk, as repos.read_repo gives those of a working tree. No commit of that name is an error."""
    spark.dataSource.register(CommitSource)
    options = {"path": path, "commit": commit, "subdir": subdir} | ({"repo": repo} if repo else {})
    return walked(spark.read.format("commit").options(**options).load())


def origin(path: str, pin: str = "HEAD") -> tuple[str | None, str | None]:
    """Where a checkout comes from and its commit's name, each null where it can't be found out."""
    try:
        store = Store(path)
        sha = store.commit(pin).hex()
    except (StoreError, OSError, ValueError):
        return None, None
    config, inside, address = os.path.join(store.shared, "config"), False, None
    if os.path.isfile(config):
        with open(config, encoding="utf-8", errors="replace") as f:
            for line in map(str.strip, f):
                inside = line == '[remote "origin"]' if line.startswith("[") else inside
                if inside and (m := re.match(r"url\s*=\s*(.+)$", line)):
                    address = m[1].strip()
    return address, sha

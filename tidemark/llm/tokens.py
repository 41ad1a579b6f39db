"""Token ids in length-delimited binary record files, with an offset index for shuffled reads.

Record: u64 length of the payload, u32 masked crc32 of those 8 bytes, payload, u32 masked crc32 of the payload.
Payload: i64 document id, u8 1 if the id is null, u8 bytes an id (2 where the vocabulary has at most 65,536 ids, else
4), u32 number of ids, the ids. All little-endian. A mask (rotation and constant) keeps a checksum of data that holds checksums from being trivial. Beside each shard lies
its index: for every record a u64 offset and a u64 length, so a reader can draw records in any order.

Texts are range-partitioned by document id, so shards follow each other in ascending id order, whatever the number
of tasks. A task's files have names of their own; the manifest lists only the files of the attempt that succeeded,
so a task that is run again after a lost executor leaves no double records.

Defined results: a null or empty text is encoded as an end id alone; every document ends with ``end_id``; whole texts are
encoded, in memory that grows with the one text; repeated rows give repeated records, and documents of equal or null id follow
each other by the hash of their text; an empty table gives no shard and no row; columns of the input beside doc_id and
text, whatever their names, are not carried.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, new_path, read, text_udf

ADJACENT = re.compile("[\\s᠎][\\s᠎]")
#: Letters, then marks that the tokenizer's splitting keeps together in a piece of their own.
WORD_AND_MARKS = re.compile("(.+?)([.,;:!?#$%&*)]+)")
MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def byte_level(tokenizer) -> bool:
    """Whether a tokenizer is a BPE model behind the usual byte-level splitting alone, for which chunks may be encoded apart."""
    import json

    told = json.loads(tokenizer.to_str())
    split = told["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    model = told["model"]
    return bool(plain and told["normalizer"] is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges"))


class Known(dict):
    """Ids of space-separated chunks, each with ``lead`` before it; chunks not seen yet are encoded on the way."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead, self.shown = encoder, lead, lead.translate(encoder.alphabet)

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii():
                code = self.encoder.code
                ids = b"".join([code[t.id] for t in self.encoder.model.tokenize(self.shown + chunk)])
            else:
                ids = self.encoder.piece(self.lead + chunk)
        elif (m := WORD_AND_MARKS.fullmatch(chunk)) and m[1].isalpha():
            ids = self[m[1]] + self.encoder.marks[m[2]]
        else:
            ids = self.encoder.whole(self.lead + chunk)
        self[chunk] = ids
        return ids


class Marks(dict):
    """Ids of the marks behind words, which are few and come often."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, marks: str) -> bytes:
        ids = self[marks] = self.encoder.piece(marks)
        return ids


class Encoder:
    """Exact ids of a byte-level BPE tokenizer of the tokenizers library, through a cache of space-separated chunks.

    Where no two whitespace characters meet, the tokenizer's own splitting always parts a text before a space and
    around a newline, so the chunks between them can be encoded apart. A chunk of letters alone is one piece for the
    library's BPE model; marks that follow it are another piece. All else, texts in which whitespace meets, and texts
    that hold one of the special tokens' strings, goes through the library's whole encode, and so do all texts where the
    tokenizer isn't a byte-level BPE of that splitting. ``entries`` bounds the cache.
    """

    def __init__(self, path: str, entries: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = byte_level(self.tokenizer)
        self.model, self.entries = self.tokenizer.model, entries
        top = max(self.tokenizer.get_vocab().values(), default=0)
        self.width = 2 if top < 1 << 16 else 4
        self.code = [i.to_bytes(self.width, "little") for i in range(top + 1)]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.whole("\n")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}  # byte-level BPE shows other bytes as they are
        self.forget()

    def forget(self) -> None:
        self.first, self.rest, self.marks = Known(self, ""), Known(self, " "), Marks(self)
        self.first[""] = b""

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what the tokenizer's splitting leaves in one piece."""
        shown = text.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.code[t.id] for t in self.model.tokenize(shown)])

    def one(self, text: str | None) -> bytes:
        """The ids of a text, little-endian, ``width`` bytes each."""
        if not text:
            return b""
        if not self.cached or ADJACENT.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.first) + len(self.rest) + len(self.marks) > self.entries:
            self.forget()
        first, rest = self.first, self.rest.__getitem__
        lines = []
        for line in text.split("\n"):
            head, *tail = line.split(" ")
            lines.append(first[head] + b"".join(map(rest, tail)))
        return self.newline.join(lines)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t) for t in texts]


@lru_cache(maxsize=1)
def kept_encoder(path: str, changed: int, size: int) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """The encoder of a file as it is now: a Python worker keeps the last one, with the chunks it knows, for its next tasks."""
    told = os.stat(path)
    return kept_encoder(path, told.st_mtime_ns, told.st_size)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<qBBI", doc_id or 0, doc_id is None, width, len(ids) // width) + ids
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def records(data: memoryview) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, ids as u32) of each record of a shard; raises on a length or checksum that doesn't hold."""
    at = 0
    while at < len(data):
        head = data[at : at + 8]
        (size,) = struct.unpack("<Q", head)
        if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
            raise ValueError(f"damaged length at byte {at}")
        payload = data[at + 12 : at + 12 + size]
        if len(payload) != size or struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, null, width, n = struct.unpack_from("<qBBI", payload)
        if size != 14 + width * n:
            raise ValueError(f"record at byte {at} has {size} bytes for {n} ids")
        yield None if null else doc_id, np.frombuffer(payload, f"<u{width}", n, 14).astype("<u4")
        at += 16 + size


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, shard_bytes: int = 64 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into record shards under ``folder``; returns the manifest, one row a shard.

    A shard ends once it holds ``shard_bytes``. The manifest is written before it is returned: the files are there.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, made, out, index = encoder(tokenizer_path), TaskContext.get().partitionId(), [], None, b""
        end = end_id.to_bytes(encode.width, "little")
        store, root = filesystem(folder)
        run = uuid.uuid4().hex[:12]

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                with store.open_output_stream(made[-1]["path"] + ".index") as f:
                    f.write(bytes(index))
                out = None

        at = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(c).slice(lo, 256).to_pylist() for c in ("doc_id", "text"))
                for doc_id, x in zip(ids, encode(texts), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        path = f"{root}/part-{part:06d}-{len(made):04d}-{run}.records"
                        made.append({"part": part, "seq": len(made), "path": path, "n_docs": 0, "n_ids": 0})
                        out, at, index = store.open_output_stream(path), 0, bytearray()
                    record = framed(doc_id, x + end, encode.width)
                    out.write(record)
                    index += struct.pack("<QQ", at, len(record))
                    at += len(record)
                    made[-1]["n_docs"] += 1
                    made[-1]["n_ids"] += len(x) // encode.width + 1
                    if at >= shard_bytes:
                        close()
        close()
        schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist(made, schema=schema)

    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return materialise(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def shard_starts(manifest: DataFrame, team: int = 256) -> DataFrame:
    """path, base, n_ids of each shard, base being the ids of all shards before it: sums over parts, then within a part.

    Parts are numbered in order of ids. Their running sum goes in two levels, teams of ``team`` parts and the parts of a team,
    so no task gets all shards; the one window without a key is over teams.
    """
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids")).withColumn("team", F.expr(f"part div {team}"))
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    teams = parts.groupBy("team").agg(F.sum("ids").alias("ids")).select("team", before(Window.orderBy("team")).alias("team_base"))
    parts = parts.select("part", "team", before(Window.partitionBy("team").orderBy("part")).alias("part_base")).join(teams, "team")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.join(parts.select("part", (F.col("team_base") + F.col("part_base")).alias("part_base")), "part")
    return shards.select("path", (F.col("part_base") + F.coalesce(F.sum("n_ids").over(own), F.lit(0))).alias("base"), "n_ids")


def read_records(manifest: DataFrame, folder: str, with_ids: bool = True, task_ids: int = 64 << 20) -> DataFrame:
    """Read record shards back: doc_id, start (ids before the document), n_tokens, ids_crc32 and, if asked for, ids.

    Shards are dealt to tasks of about ``task_ids`` ids, at least one for each core: their number comes from the manifest.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    data = memoryview(f.read())
                rows: list[tuple] = []
                for doc_id, ids in records(data):
                    rows.append((doc_id, base, len(ids), zlib.crc32(ids), ids if with_ids else None))
                    base += len(ids)
                    if len(rows) == 512:
                        yield table(rows)
                        rows = []
                yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    total = manifest.agg(F.sum("n_ids").alias("ids"), F.count("*").alias("shards")).first()
    tasks = max(1, min(total["shards"], max(manifest.sparkSession.sparkContext.defaultParallelism, -(-(total["ids"] or 0) // task_ids))))
    shards = shard_starts(manifest).select("path", "base").repartition(tasks, "base")
    return shards.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def token_counts(tokenizer_path: str):
    """An Arrow UDF: number of ids of a text, without an end id; null counts as empty."""

    def make():
        encode = encoder(tokenizer_path)
        return lambda texts: [[len(x) // encode.width for x in encode(texts)]]

    return lambda text: text_udf({"n": "long"}, make)(text)["n"]


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "records")
    manifest = write_records(read(spark, sf_dir, "documents"), byte_bpe(), folder)
    return read_records(manifest, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")

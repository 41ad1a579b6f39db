"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct shingles (as 64-bit hashes); documents of equal sets are one node, so copies meet
once. Shingles have one global order, rarest first by a count sketch over all documents. For a set of n shingles and
o = ceil(threshold * n), any similar set shares at least o of them, so the prefixes of n - o + l shingles share at
least l, for every l up to o. Each document picks its own l: a longer prefix costs more postings, but l shared ones
are demanded before a pair is verified, and by Markov's bound at most (expected meetings) / l pairs get that far.
For a pair the smaller l of both holds, over the prefixes that belong to it.

Postings meet by shingle. A bucket of at most SMALL nodes yields its pairs, and those with enough meetings are verified
on their whole sets. A larger bucket yields a chain of neighbours only. What chains leave open is settled without all
pairs: nodes linked so far form components, components of which some nodes are half alike form loose groups, and a loose
group with several components is compared block against block inside tasks of bounded size, blocks of the same component
left out; only links come back. Across loose groups, nodes that meet in a large bucket are paired within neighbouring bands of
set size, and those with enough meetings are verified one by one. So no link between different components is lost, and no
link inside one needs to be looked for.

A node is named by a 64-bit hash of its sorted set: sets of 3e10 documents would hold some tens of accidental matches.

Defined results: null, empty and wordless texts have an empty set, link with nothing and are components of their own; whole
texts are read, in memory that grows with the one text; repeated rows and equal texts share a component, and ties don't
arise, as a component is named by its smallest id; a null id gets its component like others (its own id counts as
absent; a component of such rows alone is null); an empty table gives no rows; columns of the input beside doc_id and text,
whatever their names, are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import materialise, read, text_udf
from tidemark.llm.components import connected_components

SKETCH_BITS, SLICE = 20, 1 << 12
SMALL, BLOCK, HOT = 16, 512, 100_000
#: Shingles gathered before those that occur OFTEN among them are counted by themselves; how many of them a task and the order keep.
GATHERED, OFTEN, LISTED = 1 << 22, 2, 1 << 16
#: Counts of slots up to which a shingle that is counted by itself is weighed like those of its slot.
NOISE = 300
MOST_MATCHES, RECENT = 16, 1 << 16
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words, but not none, has one."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(xxh3_64_intdigest, words), U, n)
    k = min(size, n)
    z = np.full(n - k + 1, k, U)
    for j in range(k):
        z = z * U(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    return np.unique(mixed(z))


def node_of(s: np.ndarray) -> int:
    return xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def need(n: np.ndarray | int, percent: int):
    """ceil(percent * n / 100)"""
    return -(-percent * n // 100)


def similar(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


class Frequent:
    """Shingles that occur often in a task, with their counts: those of OFTEN or more among GATHERED ones, the LISTED most frequent."""

    def __init__(self):
        self.held, self.size, self.token, self.count = [], 0, np.zeros(0, U), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.held.append(s)
        self.size += len(s)
        if self.size >= GATHERED:
            self.settle()

    def settle(self) -> None:
        token, count = np.unique(np.concatenate([*self.held, np.zeros(0, U)]), return_counts=True)
        often = count >= OFTEN
        token, place = np.unique(np.concatenate([self.token, token[often]]), return_inverse=True)
        count = np.bincount(place, np.concatenate([self.count, count[often]]), len(token)).astype(np.int64)
        if len(token) > LISTED:
            most = np.sort(np.argpartition(count, -LISTED)[-LISTED:])
            token, count = token[most], count[most]
        self.held, self.size, self.token, self.count = [], 0, token, count


def digests(docs: DataFrame, size: int) -> DataFrame:
    """For every document doc_id, n, node; each task's shingle counts by sketch slot, in slices of bytes; its frequent shingles."""
    names = ["doc_id", "n", "node", "task", "slice", "counts", "token", "seen"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def rows(**columns) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(k, t) for c, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, frequent = np.zeros(1 << SKETCH_BITS, np.uint64), Frequent()
        for batch in batches:
            n, node = [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                np.add.at(count, (s & U((1 << SKETCH_BITS) - 1)).astype(np.int64), U(1))
                frequent.add(s)
            yield rows(doc_id=batch.column("doc_id"), n=n, node=node)
        if count.any():
            parts = np.minimum(count, U(0xFFFFFFFF)).astype("<u4").reshape(-1, SLICE)
            yield rows(task=[TaskContext.get().partitionId()] * len(parts), slice=range(len(parts)), counts=[p.tobytes() for p in parts])
            frequent.settle()
            if len(frequent.token):
                yield rows(token=frequent.token.view(np.int64), seen=frequent.count)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, task long, slice int, counts binary, token long, seen long")


def slot_counts(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' counts by slot: summed in groups of 512 tasks, then over the groups."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), c_type).astype(np.uint64) for c in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    c_type = "<u4"
    some = rows.where("counts is not null").withColumn("team", F.expr("task div 512")).groupBy("slice", "team").applyInArrow(add, "slice int, counts binary")

    def add_wide(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), "<u8") for c in table.column("counts"))
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    count = np.zeros(1 << SKETCH_BITS)
    for r in some.groupBy("slice").applyInArrow(add_wide, "slice int, counts binary").collect():  # of a fixed size
        count[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<u8")
    return count


def ranked(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of eight steps for each doubling, in a byte."""
    return np.minimum(255, np.round(8 * np.log2(np.maximum(1, count)))).astype(np.uint8)


class Order:
    """How often shingles occur: by how far their slot is over the usual one, or by themselves for the LISTED most frequent.

    Shingles of slots that don't stand out come in the order of their slots' counts, which tells something as long as slots hold
    few shingles. Of a fixed size, whatever the corpus. Any order gives the same links; this one keeps frequent shingles out of
    prefixes.
    """

    def __init__(self, count: np.ndarray, token: np.ndarray, seen: np.ndarray):
        self.usual = max(1.0, float(np.median(count)))
        self.over, self.slot = ranked(count - 1.25 * self.usual), ranked(count)
        order = np.argsort(token)
        self.token, self.seen = token[order], seen[order].astype(float)

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For shingles: their place in the order, how often they occur over the usual, how many meetings each is expected to bring."""
        slot = (s & U((1 << SKETCH_BITS) - 1)).astype(np.int64)
        rank = self.over[slot]
        over = 2.0 ** (rank / 8.0)
        meetings = np.maximum(0, over - 2.75 * self.usual)
        if len(self.token):
            place = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
            at = np.flatnonzero(self.token[place] == s)
            seen = self.seen[place[at]]
            rank[at], over[at] = np.maximum(rank[at], ranked(seen)), np.maximum(over[at], seen)
            meetings[at] = np.maximum(meetings[at], seen - 4 * min(self.usual, NOISE))
        return rank.astype(U) << U(56) | self.slot[slot].astype(U) << U(48) | s >> U(16), over, meetings + 0.02


def sketch(rows: DataFrame) -> Order:
    most = rows.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(LISTED)
    found = most.toArrow()  # LISTED rows at most
    return Order(slot_counts(rows), found.column("token").to_numpy().view(U), found.column("seen").to_numpy())


def prefix(s: np.ndarray, known: Order, percent: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """The set's prefix: shingles in the global order, the least l that each belongs to, the chosen l, how often they occur."""
    place, over, meetings = known.of(s)
    n = len(s)
    o = int(need(n, percent))
    most = min(MOST_MATCHES, o)
    order = np.argsort(place, kind="stable")[: n - o + most]
    cost = np.cumsum(meetings[order])[n - o :]
    l = np.arange(1, most + 1)
    best = int(np.argmin(n - o + l + 20 * cost / l)) + 1
    k = n - o + best
    return s[order[:k]], np.maximum(1, np.arange(k) - (n - o) + 1), best, over[order[:k]]


def postings(docs: DataFrame, known: Order, size: int, percent: int) -> DataFrame:
    """token, node, n, level (the least l that the token belongs to), l, salt (spreads tokens that HOT documents hold, from 1; 0: whole).

    A task leaves out copies of the last RECENT nodes or fewer; meet() leaves out the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # of a fixed size
    names = ["token", "node", "n", "level", "l", "salt"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, recent = shared.value, set()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                cols: list[list] = [[] for _ in names]
                for t in batch.column("text").slice(i, 500).to_pylist():
                    s = shingles(t, size)
                    if not len(s) or (node := node_of(s)) in recent:
                        continue
                    if len(recent) == RECENT:
                        recent.clear()
                    recent.add(node)
                    token, level, l, seen = prefix(s, table, percent)
                    k = len(token)
                    salt = np.where(seen > HOT, 1 + node % np.maximum(1, (seen / (HOT / 2)).astype(np.int64)), 0)
                    for c, v in zip(cols, (token.view(np.int64), np.full(k, node), np.full(k, len(s)), level, np.full(k, l), salt), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types, strict=True)], names)

    return docs.select("text").mapInArrow(run, "token long, node long, n int, level short, l short, salt int")


def band(n: str | Column, percent: int) -> Column:
    """Band of a set's size: sets that can be similar lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n)) / np.log(100 / percent) - 1e-9).cast("int")


def fits(percent: int) -> Column:
    """Sets of sizes n and m can be similar."""
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))


def meet(posts: DataFrame, percent: int) -> DataFrame:
    """Postings whose bucket holds another node, with the nodes before them in the bucket: all in a small bucket, else one.

    Nodes stand in order of the band of their size, then in one of four orders by hash, so that neighbours in large
    buckets can be similar and differ from shingle to shingle. A node comes once in a bucket, however many copies there are. A salted bucket is but a part of its token's nodes:
    all its rows stay, as of a large bucket, whatever its size.
    """
    bucket = Window.partitionBy("token", "salt")
    line = bucket.orderBy("band", "turn", "node")
    before = F.collect_list(F.struct("node", "n", "level", "l")).over(line.rowsBetween(-(SMALL - 1), -1))
    rows = posts.withColumn("turn", F.xxhash64("node", F.pmod("token", F.lit(4)))).withColumn("band", band("n", percent))
    rows = rows.withColumn("last", F.lag("node").over(line)).where("last is null or last <> node")  # once a node; same sort as below
    rows = rows.select(*posts.columns, "turn", F.count("*").over(bucket).alias("size"), before.alias("before")).where("size > 1 or salt > 0")
    rows = rows.withColumn("large", (F.col("size") > SMALL) | (F.col("salt") > 0))
    return rows.withColumn("before", F.when(F.col("large"), F.slice("before", -1, 1)).otherwise(F.col("before"))).drop("size", "turn", "salt") \
        .withColumn("before", F.when(F.size("before") > 0, F.col("before")).otherwise(F.expr("cast(array() as array<struct<node:long,n:int,level:short,l:short>>)")))


def counted(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) that share enough prefix tokens; ``hits`` counts them."""
    return pairs.groupBy("a", "b").agg(F.sum("hits").alias("hits"), F.min("enough").alias("enough")).where("hits >= enough").select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, n, m and the size of the intersection, from both whole texts."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [[shingles(unpack.decompress(x).decode(), size) for x in batch.column(c).to_pylist()] for c in ("text_a", "text_b")]
            both = [len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(*sets, strict=True)]
            n, m = ([len(x) for x in s] for s in sets)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "n", "m", "inter"])

    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, n long, m long, inter long")


def packed_texts(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, packed: one compressed text for each node in ``nodes`` (node, doc_id)."""
    import zstandard

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def run(texts: list[str | None]) -> list[list]:
            sets = [shingles(t, size) for t in texts]
            return [[node_of(s) if len(s) else None for s in sets], [press.compress((t or "").encode()) for t in texts]]

        return run

    wanted = docs.select("doc_id", "text").join(nodes, F.col("doc_id").eqNullSafe(F.col("first_id")))
    made = wanted.select("node", text_udf({"own": "long", "packed": "binary"}, make)("text").alias("r")).where("r.own = node")
    return made.groupBy("node").agg(F.first("r.packed").alias("packed"))


def compared(blocks: DataFrame, percent: int, size: int) -> DataFrame:
    """Links (a, b) inside pairs of blocks: rows (pair, side, node, component, packed), at most some BLOCKs a pair.

    Intersections of one row with all rows of the other block come from one count over an index of that block.
    One link for each node and component of the other side is enough.
    """
    import zstandard

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        side, node, comp = (np.array(table.column(c).to_pylist()) for c in ("side", "node", "component"))
        sets = [shingles(unpack.decompress(x).decode(), size) for x in table.column("packed").to_pylist()]
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        owner = np.repeat(b, [len(sets[i]) for i in b])
        token = np.concatenate([sets[i] for i in b])
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        length = np.array([len(s) for s in sets])
        found: set[tuple[int, int]] = set()
        for i in a.tolist():
            lo, hi = np.searchsorted(token, sets[i], "left"), np.searchsorted(token, sets[i], "right")
            runs = hi - lo
            at = np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            inter = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((100 * inter >= percent * (length + len(sets[i]) - inter)) & (inter > 0) & (comp != comp[i]))
            _, firsts = np.unique(comp[hit], return_index=True)
            found.update((int(node[i]), int(node[j])) for j in hit[firsts])
        x, y = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return blocks.groupBy("loose", "one", "two").applyInArrow(run, "a long, b long")


def alike(odds: int) -> str:
    """Condition on n, m, inter: similarity of ``odds`` percent or more."""
    return f"100 * inter >= {odds} * (n + m - inter)"


def open_links(met: DataFrame, checked: DataFrame, strict: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between different components (``strict``: node, component) that large buckets may still hide.

    Written down in steps: the driver plans a job anew after each of its stages, so one job of all steps takes its memory.
    """
    large = met.where("large").select("token", "node", "n", "level", "l", band("n", percent).alias("band"))
    half = of_components(checked.where(alike(50)).select("a", "b"), strict)
    loose = connected_components(half).select(F.col("node").alias("component"), F.col("component").alias("loose"))
    named = large.select("node").distinct().join(strict, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    named = materialise(named.join(loose, "component", "left").select("node", "component", F.coalesce("loose", "component").alias("loose")), "named")

    # Inside loose groups: blocks of one large component, or of several small ones, by hash.
    sized = named.groupBy("loose", "component").count()
    several = sized.groupBy("loose").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("count") < BLOCK, F.col("count")).otherwise(0)).alias("rest")).where("kinds > 1")
    placed = named.join(sized.join(several, "loose"), ["loose", "component"])
    own = F.col("count") >= BLOCK
    team = F.when(own, F.col("component")).otherwise(F.lit(None).cast("long"))
    part = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / BLOCK))).otherwise(F.pmod(F.xxhash64("component"), F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK))))
    placed = materialise(placed.select("node", "component", "loose", team.alias("team"), F.xxhash64(team, part).alias("block")), "placed")
    kinds = placed.select("loose", "team", "block").distinct()
    pairs = kinds.select("loose", F.col("team").alias("team_one"), F.col("block").alias("one")).join(kinds.select("loose", F.col("team").alias("team_two"), F.col("block").alias("two")), "loose")
    pairs = pairs.where("one <= two and not (team_one is not null and team_one <=> team_two)").select("loose", "one", "two")
    left = pairs.join(placed, (pairs.loose == placed.loose) & (pairs.one == placed.block)).select(pairs.loose, "one", "two", F.lit(0).alias("side"), "node", "component")
    right = pairs.where("one < two").join(placed, (pairs.loose == placed.loose) & (pairs.two == placed.block)).select(pairs.loose, "one", "two", F.lit(1).alias("side"), "node", "component")
    inside = materialise(compared(left.unionByName(right).join(texts, "node"), percent, size), "inside")

    # Across loose groups: pairs of groups that share a token in bands that fit, then the pairs of their nodes.
    where = large.join(named.select("node", "loose"), "node")
    mixed_tokens = where.groupBy("token").agg(F.min("loose").alias("lo"), F.max("loose").alias("hi")).where("lo < hi").select("token")
    where = materialise(where.join(mixed_tokens, "token", "left_semi"), "across")
    groups = where.select("token", "band", "loose").distinct()
    others = groups.select("token", F.col("band").alias("other_band"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("loose").alias("other"))
    met_groups = materialise(groups.join(others, ["token", "band"]).where("loose <> other and (band <> other_band or loose < other)"), "groups")
    sides = met_groups.join(where, ["token", "band", "loose"]).select("token", "other_band", "other", F.col("node").alias("a"), "n", F.col("level").alias("la"), F.col("l").alias("l1"))
    sides = sides.join(where.select("token", F.col("band").alias("other_band"), F.col("loose").alias("other"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("level").alias("lb"), F.col("l").alias("l2")), ["token", "other_band", "other"])
    many = sides.where(fits(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *meeting("la", "lb", "l1", "l2"))
    few = small_pairs(met, percent).join(many.select("a", "b").distinct(), ["a", "b"], "left_semi")
    across = materialise(counted(many.unionByName(few)).join(checked.select("a", "b"), ["a", "b"], "left_anti"), "across")
    across = verified(across, texts, size).where(alike(percent))
    return inside.unionByName(across.select("a", "b"))


def of_components(links: DataFrame, components: DataFrame) -> DataFrame:
    """Links of nodes (a, b) as links of their components (node, component); nodes without one stand for themselves."""
    side = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}"))
    named = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()


def meeting(level_a: str, level_b: str, l_a: str, l_b: str) -> list[Column]:
    """hits: 1 where the token belongs to the prefixes that count for the pair; enough: how many hits the pair needs."""
    l = F.least(F.col(l_a), F.col(l_b))
    return [((F.col(level_a) <= l) & (F.col(level_b) <= l)).cast("int").alias("hits"), l.cast("int").alias("enough")]


def small_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs that meet in small buckets, with hits and enough."""
    rows = met.where("not large").select("node", "n", "level", "l", F.explode("before").alias("x"))
    rows = rows.select("node", "n", "level", "l", F.col("x.node").alias("other"), F.col("x.n").alias("m"), F.col("x.level").alias("lb"), F.col("x.l").alias("l2"))
    return rows.where((F.col("node") != F.col("other")) & fits(percent)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), *meeting("level", "lb", "l", "l2"))


def clustered(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, node, component, component_id for every row of ``docs`` (doc_id, text).

    ``node`` names the set of the row's shingles, ``component`` the group of linked sets (both null for an empty set), and
    component_id is the smallest id in it.
    """
    rows = materialise(digests(docs, size), "digests")
    known = sketch(rows)
    ids = rows.where("n is not null").select("doc_id", "n", "node")
    met = materialise(meet(postings(docs, known, size, percent), percent), "met")

    chains = met.where("large").select("node", "n", F.explode("before").alias("x")).select("node", "n", F.col("x.node").alias("other"), F.col("x.n").alias("m"))
    chains = chains.where((F.col("node") != F.col("other")) & fits(percent)).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), F.lit(1).alias("hits"), F.lit(1).alias("enough"))
    pairs = materialise(counted(small_pairs(met, percent).unionByName(chains)), "pairs")

    in_pairs = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = in_pairs.unionByName(met.where("large").select("node")).distinct()
    firsts = ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    texts = materialise(packed_texts(docs, firsts.join(wanted, "node", "left_semi"), size), "texts")
    checked = materialise(verified(pairs, texts, size), "checked")

    group = connected_components(checked.where(alike(percent)).select("a", "b"))
    if not met.where("large").isEmpty():
        more = materialise(of_components(open_links(met, checked, group, texts, percent, size), group), "more")
        if not more.isEmpty():  # components that meet after all take the name of the smallest
            renamed = connected_components(more).withColumnRenamed("component", "merged")
            named = group.unionByName(renamed.select("node", F.col("node").alias("component")).join(group, "node", "left_anti"))
            renamed = renamed.withColumnRenamed("node", "component")
            group = named.join(renamed, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    nodes = materialise(firsts.join(group, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component")), "nodes")
    least = nodes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(least, "component").select("node", "component", "component_id")
    whole = ids.where("node is not null").join(nodes, "node").select("doc_id", F.col("n").alias("n_shingles"), "node", "component", "component_id")
    none = F.lit(None).cast("long")
    return whole.unionByName(ids.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), "node", none.alias("component"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) for every row of ``docs`` (doc_id, text)."""
    return clustered(docs, percent, size).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of similar texts: that of the smallest id (null last), then set.

    Rows whose id and set both repeat are one document and stay once, with the smallest text. Texts without words are groups of
    their own, one for each id.
    """
    groups = clustered(docs, percent, size)
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("node").alias("set"))
    kept = groups.where("component is not null").groupBy("component").agg(F.min(key).alias("_key")).select("_key")
    kept = kept.unionByName(groups.where("component is null").select(key.alias("_key")).distinct())
    own = text_udf({"n": "long"}, lambda: lambda texts: [[node_of(s) if len(s) else None for s in (shingles(t, size) for t in texts)]])
    rows = docs.withColumn("_node", own("text")["n"])
    rows = rows.select(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("_node").alias("set")).alias("_key"), F.struct(*docs.columns).alias("_row"))
    rows = rows.join(kept, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.coalesce(F.col("_row.text"), F.lit(""))).alias("_row"))
    return rows.select("_row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS sh
  FROM w, LATERAL unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 75 * (na.n + nb.n - inter)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

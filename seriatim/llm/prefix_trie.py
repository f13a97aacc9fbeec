"""A trie over conversations: what they share from the first turn on, and what that saves.

Every conversation is a path of turns; a turn is known by 16 bytes of the SHA-256 of its role and text, so a node is the bytes of a path's
first turns. The trie is built by a splitter skeleton:

1. paths are sorted by (path, conversation id) and cut into shards at splitters taken from a bounded sample (``SAMPLE`` rows a shard; it
   decides balance only, never a result). A splitter is no longer than what tells it from the path before it;
2. only a node on a splitter's path can have members in two shards. The trie of these paths, the skeleton, is broadcast: at most
   ``SHARDS`` splitters of ``DEPTH`` turns; a splitter that would be deeper is left out, and its two shards are one;
3. each shard is read once in order with a stack of open nodes and finishes all others: a node's children are handed on when it closes,
   and its ends are hashed as they pass. Of skeleton nodes it gives partial counts;
4. partial counts are reduced by node, rolled up along the skeleton, and joined to the children that wait for them.

Copies of one conversation differ in their id, so a group of copies of any size is cut like everything else; a shard holds a stack and at most ``WAITING`` waiting
children in memory, whatever the size of a node: beyond that children wait for a join too. The ids of copies that end at one node across shards are
gathered as texts of ``CHUNK`` ids and hashed in order, one row at a time, since the hash is defined over all of them in a row.

Conversations are ordered by turn (null first), then role and the turn's digest; rows that tie or repeat are turns each. Null role or text: empty. Rows with a null conv_id take
no part. A conversation's digests (24 bytes a turn) are one row. An empty table gives no rows; one conversation without turns gives the root. Very long texts are digested by Spark where
they are read. Columns other than conv_id, turn, role and text are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import mapped, stored

WIDTH = 16
SHARDS, SAMPLE, DEPTH = 8192, 16, 64
WAITING, CHUNK = 1 << 16, 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind 0: a finished node; 1: a child that waits for its parent; 2: part of a skeleton node; 3: who is the parent of children that wait; 4: ids that end at a skeleton node
SCHEMA = f"kind int, {NODE}, node binary, words long, first long, ids string"
FIELDS = ["kind", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "words", "first", "ids"]
TYPES = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the digest and the number of words of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps role and text apart
    digest = F.substring(F.unhex(F.sha2(F.concat_ws("\x00", F.octet_length(role).cast("string"), role, text), 256)), 1, WIDTH)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Conversations that start like another: (conv_id, turns) with the first h turns of conversation c - c % every, then its own after the first h; h = crc32(c) % kinds.

    A conversation is started by ``every`` others at most on either side of 0, so the join has no hot key.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("int")
    mine = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(1, kinds - 1)).alias("start"))
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("start", none), F.lit(1), F.col("h"))).otherwise(none)
    tail = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(none)
    return mine.join(base, "base", "left").select("conv_id", F.concat(head, tail).alias("turns"))


def separator(before: tuple[bytes, int], at: tuple[bytes, int]) -> tuple[bytes, int] | None:
    """The shortest bound (path, id) that is above ``before`` and not above ``at``; None if it is longer than DEPTH turns."""
    if before[0] == at[0]:
        bound = at
    else:
        d = 0
        while before[0][d * WIDTH : (d + 1) * WIDTH] == at[0][d * WIDTH : (d + 1) * WIDTH]:
            d += 1
        bound = (at[0][: (d + 1) * WIDTH], -(1 << 63))
    return bound if len(bound[0]) <= DEPTH * WIDTH else None


def splitters(rows: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Bounds of shards from about SAMPLE sampled rows for each, by a hash of the id."""
    n = rows.count()
    share = min(1.0, shards * SAMPLE / max(n, 1))
    # a path is cut where no bound can follow it
    picked = rows.where(F.pmod(F.xxhash64("conv_id", F.lit(5)), F.lit(1 << 30)) <= int(share * (1 << 30))).select(F.substring("path", 1, (DEPTH + 1) * WIDTH).alias("path"), "conv_id")
    order = sorted((bytes(p), c) for p, c in picked.collect())
    step = max(1, len(order) // shards)
    found = {separator(order[i - 1], order[i]) for i in range(step, len(order), step)}
    return sorted(x for x in found if x is not None)


class Open:
    """A node whose members are passing."""

    __slots__ = ("path", "words", "skeleton", "n", "least", "children", "leaves", "saved", "hash", "some", "first", "ids", "waiting")

    def __init__(self, path: bytes, words: int, skeleton: bool):
        self.path, self.words, self.skeleton = path, words, skeleton
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.hash, self.some, self.first, self.ids, self.waiting = hashlib.sha256(), False, None, [], []


class Scan:
    """One shard in order of (path, conv_id)."""

    def __init__(self, skeleton: frozenset[bytes]):
        self.skeleton, self.stack, self.rows, self.waiting = skeleton, [], [], 0

    def out(self, kind: int, conv=None, depth=None, parent=None, n=None, children=None, leaves=None, saved=None, ends=None, node=None, words=None, first=None, ids=None) -> None:
        self.rows.append((kind, conv, depth, parent, n, children, leaves, saved, ends, node, words, first, ids))

    def flushed(self, size: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), TYPES)], names=FIELDS)
            self.rows = []

    def ended(self, node: Open) -> None:
        if node.ids:
            self.out(4, node=node.path, first=node.first, ids=",".join(map(str, node.ids)))
            node.ids = []

    def late(self, node: Open) -> None:
        """The children so far wait for a join."""
        for x in node.waiting:
            self.out(1, *x[:2], None, *x[2:], node=node.path)
        self.waiting -= len(node.waiting)
        node.waiting = []

    def close(self) -> None:
        node = self.stack.pop()
        depth = len(node.path) // WIDTH
        if node.skeleton:
            self.ended(node)
            self.late(node)
            self.out(2, node.least, depth, None, node.n, node.children, node.leaves, node.saved, node=node.path, words=node.words)
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.words
        for conv, at, *rest in node.waiting:
            self.out(0, conv, at, node.least, *rest)
        if len(node.waiting) < node.children:
            self.out(3, node.least, node=node.path)
        self.waiting -= len(node.waiting)
        up = self.stack[-1]  # the root is on the skeleton, so there is one
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        up.waiting.append((node.least, depth, node.n, node.children, leaves, saved, node.hash.hexdigest()))
        self.waiting += 1
        if self.waiting > WAITING:
            self.late(max(self.stack, key=lambda x: len(x.waiting)))

    def take(self, path: bytes, conv: int, words: np.ndarray) -> None:
        while self.stack and not path.startswith(self.stack[-1].path):
            self.close()
        for d in range(len(self.stack), len(path) // WIDTH + 1):
            prefix = path[: d * WIDTH]
            self.stack.append(Open(prefix, int(words[d - 1]) if d else 0, prefix in self.skeleton))
        for node in self.stack:
            node.n += 1
            if node.least is None or conv < node.least:
                node.least = conv
        end = self.stack[-1]
        if end.skeleton:
            end.first = end.first if end.ids else conv
            end.ids.append(conv)
            if len(end.ids) >= CHUNK:
                self.ended(end)
        else:
            end.hash.update(b"," * end.some + str(conv).encode())
            end.some = True


def scanned(rows: DataFrame, bounds: list[tuple[bytes, int]], skeleton: frozenset[bytes]) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((bounds, skeleton))  # SHARDS bounds and their prefixes at most

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value[0]
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([bisect.bisect_right(cuts, k) for k in keys], pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, at = Scan(shared.value[1]), None
        for batch in batches:
            words = batch.column("words")
            flat, first = words.flatten().to_numpy(), np.append(0, np.cumsum(np.diff(words.offsets.to_numpy())))
            for i, (number, path, conv) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id")))):
                if number != at:
                    while scan.stack:
                        scan.close()
                    at = number
                scan.take(path, conv, flat[first[i] : first[i + 1]])
                yield from scan.flushed(4096)
        while scan.stack:
            scan.close()
            yield from scan.flushed(4096)
        yield from scan.flushed()

    dealt = mapped(rows, shard, "shard int, conv_id long, path binary, words array<long>")
    parts = max(1, min(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return mapped(dealt.repartition(parts, "shard").sortWithinPartitions("shard", "path", "conv_id"), run, SCHEMA)


def hashes(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ids given as (node, first, ids), read in order, one row at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if key != node or sha is None:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["node", "ends"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends"])

    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return mapped(chunks.repartition(parts, "node").sortWithinPartitions("node", "first").select("node", "ids"), run, "node binary, ends string")


def parent_of(node: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.substring(node, F.lit(1), ((depth - 1) * WIDTH).cast("int")))


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """A row for each node of the paths ``conversations`` (conv_id, turns: array of (digest, words)): conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    digests, words = (F.col("turns").getField(c) for c in ("digest", "words"))
    # one concatenation of hex digits: arrays of binary have no join of their own
    path = F.unhex(F.array_join(F.transform(digests, lambda x: F.hex(x)), ""))
    rows = stored(conversations.select("conv_id", path.alias("path"), words.alias("words")), "paths")
    wanted = shards or min(SHARDS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = splitters(rows, wanted)
    skeleton = frozenset(p[: d * WIDTH] for p in [b"", *(b[0] for b in bounds)] for d in range(len(p) // WIDTH + 1))
    parts = stored(scanned(rows, bounds, skeleton), "trie", ["kind"])

    def kind(k: int) -> DataFrame:
        return parts.where(F.col("kind") == k).drop("kind")

    # the skeleton: a row for each prefix of a splitter
    sums = kind(2).groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    own = stored(sums.withColumn("parent", parent_of(F.col("node"), F.col("depth"))), "skeleton")
    inner = own.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("inner"))
    counted = own.join(inner, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("inner", F.lit(0)))
    counted = counted.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")})
    # every node adds to all above it, DEPTH at most
    above = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.substring(F.col("node"), F.lit(1), d * WIDTH))
    totals = counted.select(F.explode(above).alias("node"), "n_leaves", "saved_tokens").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    empty = hashlib.sha256().hexdigest()
    shared = counted.drop("n_leaves", "saved_tokens").join(totals, "node").join(hashes(kind(4)), "node", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(empty)))
    shared = stored(shared.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent"), "shared")

    parents = shared.select("node", F.col("conv_id").alias("up")).unionByName(kind(3).select("node", F.col("conv_id").alias("up")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    late = kind(1).join(parents, "node").withColumn("parent_conv_id", F.col("up"))
    upper = shared.join(shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", "left")
    return kind(0).select(names).unionByName(late.select(names)).unionByName(upper.select(names))

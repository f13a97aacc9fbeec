"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Each text becomes its set of distinct shingles of ``width`` words (A-Z lowered), a fingerprint of the set, and a
   signature of ``COORDINATES`` minima. Texts with equal sets form one class, whose node is its smallest doc_id; only
   nodes go on, so groups of copies cost one row each afterwards.
2. Nodes are posted under each (coordinate, value) pair. Pairs with one node match nothing. Two nodes are candidates when
   ``MATCHES`` coordinates or more collide, so with the postings of a node ordered from rare to common, each candidate
   pair shares one of the first COORDINATES - MATCHES + 1 (the prefix). The rest is skipped while merging: its collisions
   are counted where two nodes of a list meet, on 4 bits of each coordinate, and a pair goes on only when no more
   than COORDINATES - MATCHES of these differ. A node with fewer than MATCHES shared pairs is out at once.
3. Only connections matter to the result, so pairs are not expanded within a posting list at first: each node is
   paired with the list's most shared node (the one with most shared postings, as the original of a group of edited copies
   has), candidates are counted, confirmed on full sets, and joined into components.
4. Pairs across components remain. A node goes on when some node of another component meets it in a list (a semi-join: no
   pair is emitted). The full sets of these nodes are then posted under their rarest shingles: two sets of sizes m <= n
   that reach the similarity p share p / (1 + p) * (m + n) shingles, so one of the first n - p n + 1 of the larger meets one
   of the first m - 2 p / (1 + p) m + 1 of the smaller, in one order of all shingles. What follows the place where they meet
   bounds what they can share. Pairs that also have the collisions are confirmed on full sets.
   A large group of edited copies that resemble each other by less than the similarity thus yields few
   pairs: the rarest shingles of each are its own edits. In every list, members of its largest component are not
   compared with each other.

A pair of similarity 0.8 has 51 collisions expected of 64; it has fewer than 34 with probability below 1e-6.
Confirmation compares 64-bit shingle hashes of whole texts.

Null or empty text: no shingles, linked with nothing. Fewer words than ``width``: the whole sequence as one shingle. Rows that
repeat a doc_id count as one node where their sets are equal, and are linked where not. A null doc_id gets
component_id null and kept false, and links nothing. Equal rows all carry the same result.
Texts of any length are taken whole, and a longer one stands alone in memory; an empty table gives no rows. Columns other than doc_id and text are
not read, whatever their names, and ``keep_one`` passes them through. Ids are cast to 64-bit integers: ids that are no numbers fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import counted, discard, mapped, stored
from ._text import FOLDED, Words, mixed, slices, utf8

COORDINATES, MATCHES = 64, 34
PACKED = COORDINATES // 16  # longs that hold 4 bits of each coordinate
SALT_ROWS = 512
FILTER_BITS = 1 << 26
_rng = np.random.Generator(np.random.PCG64(99))
FACTOR = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(1, 2**63, COORDINATES, dtype=np.uint64)


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, sorted within a text; first shingle of each text and one more)."""
    words = Words(*utf8(column), FOLDED)
    n = words.count
    few = (n > 0) & (n < width)
    per = np.where(few, 1, np.maximum(n - width + 1, 0))
    text = np.repeat(np.arange(len(n)), per)
    at = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(words.first[:-1], per)
    size = np.where(few, n, width)[text]
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        use = size > k
        h = np.where(use, mixed(h * np.uint64(0x9E3779B97F4A7C15) + words.hash[np.where(use, at + k, 0)]) if len(words.hash) else h, h)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts x COORDINATES 32-bit minima; zeros for empty sets."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, COORDINATES), np.int32)
    if len(some):
        for k in range(COORDINATES):
            value = (h * FACTOR[k] + SHIFT[k]) >> np.uint64(32)
            out[some, k] = np.minimum.reduceat(value, first[some]).astype(np.uint32).view(np.int32)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, f1, f2 (fingerprint of the set), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = shingles(part.column("text"), width)
            n = np.diff(first)
            prints = []
            for seed in (1, 2):
                total = np.concatenate([[0], np.cumsum(mixed(h + np.uint64(seed * 0x51ED270B)))]).astype(np.uint64)
                prints.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
            sig = pa.FixedSizeListArray.from_arrays(pa.array(signatures(h, first).ravel()), COORDINATES).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), sig], names=["doc_id", "n_shingles", "f1", "f2", "sig"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_shingles long, f1 long, f2 long, sig array<int>")


def packed(sig: Column) -> list[Column]:
    """4 bits of each coordinate in PACKED longs."""
    longs = []
    for k in range(PACKED):
        nibbles = [F.shiftleft(sig[16 * k + i].cast("long").bitwiseAND(15), 4 * i) for i in range(16)]
        out = nibbles[0]
        for x in nibbles[1:]:
            out = out.bitwiseOR(x)
        longs.append(out)
    return longs


def meets(a: str, b: str, percent: int) -> Column:
    """Whether the nodes with columns n_a, k0_a, .. and n_b, k0_b, .. may reach the similarity: by their sizes, and by the coordinates of which 4 bits differ."""
    differ = F.lit(0)
    for k in range(PACKED):
        x = F.col(f"k{k}_{a}").bitwiseXOR(F.col(f"k{k}_{b}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(0x1111111111111111)
        differ = differ + F.bit_count(x)
    return (100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")) & (differ <= COORDINATES - MATCHES)


def sets(docs: DataFrame, width: int, wanted: np.ndarray | None = None) -> DataFrame:
    """Per row of (node, bit, text): node, hashes of the full set. With ``wanted``, of rows whose bit is set there only."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if shared.value is not None:
                bit = part.column("bit").fill_null(0).to_numpy()
                part = part.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            h, first = shingles(part.column("text"), width)
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "full"])

    return mapped(docs, run, "node long, full array<long>")


def full_sets(nodes: DataFrame, docs: DataFrame, width: int, name: str) -> DataFrame:
    """A written table of (node, full) that holds the distinct ``nodes``, and a few others. docs: node and text of each node.

    The nodes are looked up in a filter of FILTER_BITS bits, which is all that is broadcast, so texts need no shuffle. Where
    so many are wanted that they would fill a tenth of it, a join picks them instead; the links found are the same.
    """
    bit = F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS))
    marked = docs.withColumn("bit", bit)
    if nodes.count() > FILTER_BITS // 10:
        return stored(sets(marked.join(nodes, "node", "left_semi"), width), name)
    # at most FILTER_BITS / 32768 rows of 4 kB; the functions count from 1
    bits = nodes.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in bits.collect():
        at = (row["bucket"] - 1) * 4096
        wanted[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return stored(sets(marked, width, wanted), name)


def spread(pairs: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """pairs x right on pairs[key] = right.node, where a key may hold many pairs: such keys are cut into salts of about SALT_ROWS pairs."""
    salts = pairs.groupBy(F.col(key).alias("node")).agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    wide = right.join(salts, "node").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    # a salt is drawn below the number that the key has by way of the largest, which is known once
    most = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    if most <= 4 * SALT_ROWS:
        return pairs.join(right.withColumnRenamed("node", key), key)
    dealt = pairs.join(salts.withColumnRenamed("node", key), key).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts")).cast("int")).drop("salts")
    return dealt.join(wide.withColumnRenamed("node", key), [key, "salt"]).drop("salt")


def confirmed(close: DataFrame, full: DataFrame, percent: int, name: str) -> DataFrame:
    """Of distinct candidates (a, b), a written table, those whose full sets reach the similarity."""
    both = spread(close.join(full.select(F.col("node").alias("a"), F.col("full").alias("full_a")), "a"), full.withColumnRenamed("full", "full_b"), "b")
    shared = F.size(F.array_intersect("full_a", "full_b"))
    return stored(both.where(100 * shared >= percent * (F.size("full_a") + F.size("full_b") - shared)).select("a", "b"), f"{name}-links")


def side(frame: DataFrame, name: str, key: str) -> DataFrame:
    """The columns of ``frame`` with the name of a side of a join at their end, but for the key; node becomes the name itself."""
    return frame.select(key, F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in frame.columns if c not in (key, "node")))


def divided(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The written ``rows`` whose key is in several components, with main: whether the row's component is the key's most frequent."""
    each = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n_rows"))
    several = each.groupBy(key).agg(F.max_by("component", F.struct("n_rows", "component")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(key, "top")
    return stored(rows.join(stored(several, f"{name}-several"), key).withColumn("main", F.col("component") == F.col("top")).drop("top"), name)


def crossing(a: DataFrame, b: DataFrame, key: str, condition: Column, how: str) -> DataFrame:
    """Joins divided rows across components. Two rows of a key's main component are never compared."""
    differ = condition & (F.col("component_a") != F.col("component_b"))
    one = side(a, "a", key).join(side(b.where("not main"), "b", key).withColumnRenamed(key, "key_b"), (F.col(key) == F.col("key_b")) & differ, how)
    other = side(a.where("not main"), "a", key).join(side(b.where("main"), "b", key).withColumnRenamed(key, "key_b"), (F.col(key) == F.col("key_b")) & differ, how)
    return one.unionByName(other)


def rarest(nodes: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(shingle, the columns of nodes, rest, place, short) of each node's prefix, where rest is the number of its shingles that other nodes
    have too, and short marks the prefix that it needs as the smaller of two. Shingles that no other node has come first and are left out."""
    rows = full.select("node", F.explode("full").alias("shingle"))
    common = counted(rows, ["shingle"], "near-common").withColumnRenamed("n", "df")
    # a node's own set in one row, as it was before
    ordered = rows.join(common, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
    wide = ordered.join(nodes, "node").withColumn("rest", F.size("common"))
    longer = F.col("rest") - F.ceil(percent * F.col("n") / 100) + 1
    shorter = F.col("rest") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    wide = wide.where(longer > 0).withColumn("until", shorter).withColumn("common", F.slice("common", F.lit(1), F.greatest(longer, F.lit(0)).cast("int")))
    return wide.select(*nodes.columns, "rest", "until", F.posexplode("common").alias("place", "one")).select(F.col("one.shingle").alias("shingle"), *nodes.columns, "rest", "place", (F.col("place") < F.col("until")).alias("short"))


def rooted(parent: DataFrame, name: str) -> DataFrame:
    """Follows (node, component) to the end: components that are nodes themselves are replaced until none is."""
    step = 0
    while True:
        up = parent.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = stored(parent.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved")), f"{name}-jump{step}")
        parent, step = moved.select("node", "component"), step + 1
        if moved.where("moved").isEmpty():
            return parent


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches; nodes that are their own component are left out.

    In each round every node with a smaller neighbour hooks to the smallest one, the trees are followed to
    their roots, and the edges are contracted to the roots. Every tree joins two nodes at least, so rounds and steps
    grow with the logarithm of the longest chain.
    """
    hooked = None
    round_ = 0
    left = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    while not left.isEmpty():
        hook = stored(left.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node"), f"{name}-hook{round_}")
        root = rooted(hook, f"{name}-{round_}")
        hooked = root if hooked is None else hooked.unionByName(root)
        a, b = (root.select(F.col("node").alias(c), F.col("component").alias(f"root_{c}")) for c in "ab")
        ends = left.join(a, "a").join(b, "b", "left").select("root_a", F.coalesce("root_b", "b").alias("root_b")).where("root_a <> root_b")
        left = stored(ends.select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct(), f"{name}-left{round_}")
        round_ += 1
    if hooked is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return hooked if round_ == 1 else rooted(stored(hooked, f"{name}-hooked"), f"{name}-all")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    base = stored(sketches(docs, width), "near-sketch")
    filled = base.where("n_shingles > 0 and doc_id is not null")
    classes = stored(filled.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig")), "near-class")
    # one doc_id with several sets: its rows are one document, so their classes are linked
    again = filled.select("doc_id", "f1", "f2", "n_shingles").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    same = filled.join(again, "doc_id").join(classes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()

    posted = classes.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("post"))
    frequent = stored(posted.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-posts")
    shared = posted.join(frequent, "post").groupBy("node").agg(F.collect_list(F.struct("df", "post")).alias("posts")).where(F.size("posts") >= MATCHES)
    prefix = F.slice(F.array_sort("posts"), F.lit(1), F.size("posts") - MATCHES + 1)
    brief = classes.select("node", F.col("n_shingles").alias("n"), *(x.alias(f"k{k}") for k, x in enumerate(packed(F.col("sig")))))
    keys = ["n", *(f"k{k}" for k in range(PACKED))]
    lists = shared.select("node", F.size("posts").alias("u"), F.transform(prefix, lambda p: p["post"]).alias("posts")).join(brief, "node").select(F.explode("posts").alias("post"), "node", "u", *keys)
    lists = stored(lists, "near-lists")
    discard(frequent)

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    first = lists.groupBy("post").agg(F.count(F.lit(1)).alias("size"), F.max(F.struct("u", (-F.col("node")).alias("minus"), *keys)).alias("one")).where("size > 1").select("post", (-F.col("one.minus")).alias("node"), "one.*")
    first = stored(first, "near-first")
    met = side(lists, "a", "post").join(side(first, "b", "post"), "post").where((F.col("a") != F.col("b")) & meets("a", "b", percent))
    star = stored(met.select("a", "b").distinct(), "near-star")
    ends = stored(star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ends")
    full = full_sets(ends, texts, width, "near-sets1")
    links = stored(confirmed(star, full, percent, "near1").unionByName(same), "near-links")
    discard(first, star, ends, full)
    found = components(links, "near1")

    # pairs across components
    placed = stored(lists.drop("u").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed")
    open_ = divided(placed, "post", "near-open")
    discard(lists, placed)
    nodes = stored(crossing(open_, open_, "post", meets("a", "b", percent), "left_semi").select(F.col("a").alias("node"), *(F.col(f"{c}_a").alias(c) for c in ("component", *keys))).distinct(), "near-across")
    discard(open_)
    full = full_sets(nodes.select("node"), texts, width, "near-sets2")
    prefixes = divided(stored(rarest(nodes, full, percent), "near-prefix"), "shingle", "near-posted")
    smaller = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a")))
    enough = (100 + percent) * F.least(F.col("rest_a") - F.col("place_a"), F.col("rest_b") - F.col("place_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    cross = stored(crossing(prefixes, prefixes.where("short"), "shingle", smaller & enough & meets("a", "b", percent), "inner").select("a", "b").distinct(), "near-cross")
    more = confirmed(cross, full, percent, "near2")
    discard(prefixes, nodes, full)
    if not more.isEmpty():
        found = components(links.unionByName(more), "near2")

    member = base.join(classes.select("f1", "f2", "n_shingles", "node"), ["f1", "f2", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("node")).otherwise(F.col("doc_id"))
    final = member.withColumn("node", own).join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return final.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose document is the smallest of its group.

    Of rows that share doc_id and text, a null doc_id included, one stays: the least by its other columns, in their order.
    Rows with a null doc_id and texts of their own stay, as do different texts under one doc_id.
    """
    gone = near_duplicates(docs, width, percent).where("component_id <> doc_id").select("doc_id").distinct()
    gone = stored(gone.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")), "near-gone")
    own = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    # few rows share a hash of both; only these are compared
    marked = own.withColumn("seriatim_print", F.xxhash64("doc_id", "text"))
    again = counted(marked.select("seriatim_print"), ["seriatim_print"], "near-again").select("seriatim_print")
    if again.isEmpty():
        return own
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = marked.join(again, "seriatim_print", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("seriatim_zero"), *(F.col(f"`{c}`") for c in others))).alias("seriatim_row"))
    one = first.select(*(F.col(f"seriatim_row.`{c}`") if c in others else F.col(c) for c in docs.columns))
    return marked.join(again, "seriatim_print", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(one)

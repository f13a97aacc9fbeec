"""Removal of repeated byte strings by distributed prefix doubling over content-defined positions.

A byte goes when a string of ``WIDTH`` bytes that covers it also starts anywhere else, in any text. Sorting every position of
a large corpus is out of reach, so the suffix array is sparse: its positions are anchors, where the hash of ``GRAM`` bytes is the
least within ``RADIUS``, on one side at least without an equal (so runs of one pattern have anchors at both ends). Whether a position is an anchor depends only on the bytes near it, so equal
strings have equal anchors, and a string of WIDTH bytes holds about five.

1. A position's first rank is the hash of the chunk from its anchor to the next one. Spark groups the (position, rank) pairs;
   unique ranks drop out. Rank pairs at offsets of 1 and then 2 chunks are ranked again, and unique ones drop
   out, until a chain is as long as WIDTH can hold.
2. The windows (strings of WIDTH bytes) of a text fall into intervals with the same anchors. An interval is left when all its
   chains are. Its core (from its first anchor to its last) is the same for equal windows wherever they are;
   its outer string covers all its windows. Intervals are grouped by core and outer string:
     a core with one member is unique; members with equal outer strings repeat each other whole;
     where a core has several outer strings, one member of each is opened, and its windows are compared as such.
   A window with one anchor has no chunk; its first rank is that of the anchor's surroundings.
3. Windows without an anchor (long runs of one pattern) are compared as such from the start, after those that
   repeat within their own text are settled there.

So every window is settled by equality of 128-bit hashes, and the result is the same as comparing all windows. Only texts
with surviving chains are shuffled with their bytes, and each of their rows stands for about 60 bytes until a core is
opened. Hot passages become one row for each distinct outer string before anything is opened.

Null text counts as empty. Texts shorter than WIDTH lose nothing. Rows are judged on the input as given: equal rows repeat
each other, also with one doc_id, and a null doc_id is an ordinary one.
A text of any length is taken whole, and a longer one stands alone in memory; an empty table gives no rows. Columns other than doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import counted, discard, mapped, shuffles_dropped, stored
from ._text import Prefix, slices, utf8

WIDTH = 400
GRAM, RADIUS = 16, 31
REACH = RADIUS + GRAM  # an anchor is decided by the bytes from RADIUS before it to REACH after it
NEVER = np.uint64(2**64 - 1)


def anchors(raw: np.ndarray, offsets: np.ndarray, prefix: Prefix) -> np.ndarray:
    """Positions of all anchors, in order; their surroundings lie within one text."""
    n = len(raw)
    if n < 2 * REACH:
        return np.zeros(0, np.int64)
    h = np.full(n + 2 * RADIUS + 1, NEVER)
    h[RADIUS : RADIUS + n - GRAM + 1] = prefix.windows(GRAM)
    low = h
    for step in (1, 2, 4, 8):  # the least of 16, then of 31 in a row
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: len(low) - RADIUS + 16], low[RADIUS - 16 :])
    here = h[RADIUS : RADIUS + n]
    before, after = low[:n], low[RADIUS + 1 : RADIUS + 1 + n]
    is_anchor = ((here < before) & (here <= after)) | ((here <= before) & (here < after))
    at = np.flatnonzero(is_anchor)
    text = np.searchsorted(offsets, at, "right") - 1
    return at[(at - RADIUS >= offsets[text]) & (at + REACH <= offsets[text + 1])]


def intervals(a: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Ranges of window starts with one set of anchors: (text, first start, last start, first anchor, last anchor).

    Windows start where ``width`` bytes of their text are left; a window holds an anchor with its surroundings.
    """
    begin, until = offsets[:-1], offsets[1:] - width  # of window starts, inclusive
    texts = np.flatnonzero(until >= begin)
    if not len(texts):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    cuts = np.unique(np.concatenate([begin[texts], until[texts] + 1, a - RADIUS + 1, a + REACH - width]))
    cuts = cuts[(cuts >= 0) & (cuts <= offsets[-1])]
    start, end = cuts[:-1], cuts[1:] - 1
    text = np.searchsorted(offsets, start, "right") - 1
    text = np.minimum(text, len(offsets) - 2)
    good = (start >= begin[text]) & (end <= until[text])
    text, start, end = text[good], start[good], end[good]
    return text, start, end, np.searchsorted(a, start + RADIUS), np.searchsorted(a, start + width - REACH, "right") - 1


def runs(start: np.ndarray, width: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted window starts of texts to byte ranges (text, start, end)."""
    if not len(start):
        return text, start, start
    new = np.ones(len(start), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return text[first], start[first], start[last] + width


def members(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the interval, position) of every position in intervals with inclusive ends."""
    n = end - start + 1
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[of]


def double(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Sortable 128-bit values."""
    out = np.empty(len(h1), [("a", np.uint64), ("b", np.uint64)])
    out["a"], out["b"] = h1, h2
    return out


def table(rows: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in rows.values()], names=list(rows))


POSITIONS = "kind int, key long, i int, p long, w1 long, w2 long"


def positions(docs: DataFrame, width: int) -> DataFrame:
    """From key and text: kind 0, chunks (key, i, w1 rank); kind 1, windows without an anchor, each once for a text
    (key, p, w1, w2, i = 1 if it repeats there); kind 2, byte ranges covered by the latter (key, p start, w1 end);
    kind 3, anchors that are alone in some window (key, i, w1 rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            key = part.column("key").to_numpy()
            raw, offsets = utf8(part.column("text"))
            p1 = Prefix(raw)
            a = anchors(raw, offsets, p1)
            of = np.searchsorted(offsets, a, "right") - 1
            long_ = np.diff(offsets) >= width
            link = np.flatnonzero((of[1:] == of[:-1]) & long_[of[1:]]) if len(a) else a
            base = np.searchsorted(of, np.arange(len(offsets) - 1))
            zeros = np.zeros(len(link), np.int64)
            rank = p1.spans(a[link] - RADIUS, a[link + 1] + REACH)
            yield table({"kind": zeros.astype(np.int32), "key": key[of[link]], "i": (link - base[of[link]]).astype(np.int32), "p": zeros, "w1": rank, "w2": zeros})
            text, start, end, f, l = intervals(a, offsets, width)
            lone = np.unique(f[l == f])
            if len(lone):
                zeros = np.zeros(len(lone), np.int64)
                yield table({"kind": np.full(len(lone), 3, np.int32), "key": key[of[lone]], "i": (lone - base[of[lone]]).astype(np.int32), "p": zeros, "w1": p1.spans(a[lone] - RADIUS, a[lone] + REACH), "w2": zeros})
            bare = l < f
            if not bare.any():
                continue
            p2 = Prefix(raw, family=1)
            which, at = members(start[bare], end[bare])
            t = text[bare][which]
            h1, h2 = p1.spans(at, at + width), p2.spans(at, at + width)
            order = np.lexsort((at, h2, h1, t))
            t, at, h1, h2 = t[order], at[order], h1[order], h2[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(t)))
            yield table({"kind": np.ones(len(first), np.int32), "key": key[t[first]], "i": (n > 1).astype(np.int32), "p": at[first] - offsets[t[first]], "w1": h1[first], "w2": h2[first]})
            again = np.repeat(n > 1, n)
            order = np.lexsort((at[again], t[again]))
            rt, rs, re_ = runs(at[again][order], width, t[again][order])
            yield table({"kind": np.full(len(rt), 2, np.int32), "key": key[rt], "i": np.zeros(len(rt), np.int32), "p": rs - offsets[rt], "w1": re_ - offsets[rt], "w2": np.zeros(len(rt), np.int64)})

    return mapped(docs, run, POSITIONS)


def repeating(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Written: the distinct (key, i, rank) whose ``keys`` have several rows."""
    often = counted(rows, keys, f"{name}-often")
    left = stored(rows.join(often.select(*keys), keys, "left_semi").select("key", "i", "rank").distinct(), name)
    discard(often)
    return left


def doubled(level: DataFrame, offset: int, name: str) -> DataFrame:
    """(key, i, rank) of the chains that join each chain with the one ``offset`` chunks on, where both are left and the result repeats."""
    order = Window.partitionBy("key").orderBy("i")
    # the rows of a text are distinct in i, so the one at i + offset is at most ``offset`` rows on
    ahead = F.array(*(F.lead(F.struct("i", "rank"), k).over(order) for k in range(1, offset + 1)))
    there = F.filter(ahead, lambda x: x["i"] == F.col("i") + offset)
    pairs = level.withColumn("there", there).where(F.size("there") > 0).select("key", "i", F.xxhash64("rank", F.col("there")[0]["rank"]).alias("rank"))
    pairs = stored(pairs, f"{name}-pairs")
    often = counted(pairs, ["rank"], f"{name}-often")
    left = stored(pairs.join(often.select("rank"), "rank", "left_semi"), name)
    discard(pairs, often)
    return left


def cores(chosen: DataFrame, width: int) -> DataFrame:
    """From key, text and the chains left (lists i0, i1, i2 by offset, i3 of lone anchors): (key, at, core, o1, o2) of the intervals left, where at
    is the first start times 2**16 plus the length less 1. Cores only bring intervals together, so 64 bits do; outer strings decide, and have 128."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            key = part.column("key").to_numpy()
            raw, offsets = utf8(part.column("text"))
            p1, p2 = Prefix(raw), Prefix(raw, family=1)
            a = anchors(raw, offsets, p1)
            base = np.searchsorted(a, offsets[:-1])
            missing = []
            for c in ("i0", "i1", "i2", "i3"):
                lists = part.column(c)
                count = lists.value_lengths().fill_null(0).to_numpy()
                left = np.zeros(len(a) + 1, bool)
                left[np.repeat(base, count) + lists.flatten().to_numpy()] = True
                missing.append(np.concatenate([[0], np.cumsum(~left)]))
            text, start, end, f, l = intervals(a, offsets, width)
            chunks = l - f
            # chains of ``span`` chunks begin at f .. last - 1; a lone anchor is a chain of its own
            good = np.zeros(len(f), bool)
            for level, span, fits in ((0, 1, chunks == 1), (1, 2, (chunks == 2) | (chunks == 3)), (2, 4, chunks >= 4), (3, 0, chunks == 0)):
                some = np.flatnonzero(fits)
                last = l[some] - span + 1
                good[some] = missing[level][last] == missing[level][f[some]]
            text, start, end, f, l = (x[good] for x in (text, start, end, f, l))
            lead = (a[f] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out = {"key": key[text], "at": (start - offsets[text] << 16) + (end - start)}
            out["core"] = p1.spans(a[f] - RADIUS, a[l] + REACH)
            for name, p in (("o1", p1), ("o2", p2)):
                out[name] = p.spans(start, end + width) ^ lead
            yield table(out)

    return mapped(chosen, run, "key long, at long, core long, o1 long, o2 long")


def windows(chosen: DataFrame, width: int) -> DataFrame:
    """From key, text and open (list of at, single): (key, q, w1, w2) of every window, q twice its start plus single."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            key = part.column("key").to_numpy()
            raw, offsets = utf8(part.column("text"))
            opened = part.column("open")
            of = np.repeat(np.arange(part.num_rows), opened.value_lengths().to_numpy())
            packed, single = (opened.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
            start = (packed >> 16) + offsets[of]
            which, at = members(start, start + (packed & 0xFFFF))
            out = {"key": key[of[which]], "q": 2 * (at - offsets[of[which]]) + single[which]}
            for k in (0, 1):
                out[f"w{k + 1}"] = Prefix(raw, family=k).spans(at, at + width)
            yield table(out)

    return mapped(chosen, run, "key long, q long, w1 long, w2 long")


def removed(chosen: DataFrame) -> DataFrame:
    """From key, text and cover (list of byte ranges): (key, spans, kept, kept_text) as ``kept_texts`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, offsets = utf8(part.column("text"))
            kept, texts, edges = [], [], []
            for i in range(part.num_rows):
                data = raw[offsets[i] : offsets[i + 1]]
                n = len(data)
                ranges = part.column("cover").slice(i, 1).flatten()
                edge = np.bincount(ranges.field(0).to_numpy(), minlength=n + 1) - np.bincount(ranges.field(1).to_numpy(), minlength=n + 1)
                gone = np.cumsum(edge)[:n] > 0
                edges.append(np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))))
                kept.append(data[~gone].tobytes())
                letter = np.cumsum((data & 0xC0) != 0x80)  # bytes 10xxxxxx go on with the letter before them
                cut = np.bincount(letter, gone, minlength=1) > 0
                texts.append(data[~cut[letter]].tobytes().decode("utf-8", "replace"))
            ends = np.concatenate(edges)
            pairs = pa.StructArray.from_arrays([pa.array(ends[0::2], pa.int64()), pa.array(ends[1::2], pa.int64())], names=["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) // 2 for x in edges]), pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([part.column("key"), spans, pa.array(kept, pa.binary()), pa.array(texts, pa.string())], names=["key", "spans", "kept", "kept_text"])

    return mapped(chosen, run, "key long, spans array<struct<start:long,end:long>>, kept binary, kept_text string")


def row_key(salt: int) -> Column:
    return F.xxhash64("doc_id", "text", *([F.lit(salt)] if salt else []))


def known_by_hash(docs: DataFrame, hashed: Callable[[int], Column] = row_key) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text, key), written (key, n, n_bytes, sha)). Rows share a key only where their texts are equal; these repeat each other whole.

    64 bits are few for 10^10 rows, so keys under which different texts meet are found, and their rows get hashes with another salt until none is left.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", hashed(0))
    salt = 0
    while True:
        sha = F.sha2("text", 256)
        twins = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("n_bytes"), F.max(sha).alias("sha"), F.min(sha).alias("other"))
        twins = stored(twins, "repeat-texts")
        met = twins.where("sha <> other").select("key", F.lit(True).alias("met"))
        if met.isEmpty():
            return keyed, twins.drop("other")
        salt += 1
        keyed = keyed.join(met, "key", "left").select("doc_id", "text", F.when(F.col("met"), hashed(salt)).otherwise(F.col("key")).alias("key"))


def without_repeats(keyed: DataFrame, twins: DataFrame, width: int) -> DataFrame:
    """Written: (key, spans, kept, kept_text) of the texts of ``known_by_hash`` that lose bytes.

    A table goes as soon as all that reads it has been written, so the disk in use follows the widest step, not their sum.
    """
    found = stored(positions(keyed.select("key", "text"), width), "repeat-positions", ["kind"])
    chunks = found.where("kind = 0").select("key", "i", F.col("w1").alias("rank"))
    lone = found.where("kind = 3").select("key", "i", F.col("w1").alias("rank"))
    level0 = repeating(chunks, ["rank"], "repeat-level0")
    lone = repeating(lone, ["rank"], "repeat-lone")
    bare = stored(found.where("kind = 1").select("key", (2 * F.col("p") + 1 - F.col("i")).alias("q"), "w1", "w2"), "repeat-bare")
    within = stored(found.where("kind = 2").groupBy("key").agg(F.collect_list(F.struct(F.col("p").alias("start"), F.col("w1").alias("end"))).alias("cover")), "repeat-within")
    discard(found)
    level1 = doubled(level0, 1, "repeat-level1")
    level2 = doubled(level1, 2, "repeat-level2")
    left = level0.select("key", "i", F.lit(0).alias("level"))
    for k, level in ((1, level1), (2, level2), (3, lone)):
        left = left.unionByName(level.select("key", "i", F.lit(k).alias("level")))
    lists = left.groupBy("key").agg(*(F.collect_list(F.when(F.col("level") == k, F.col("i"))).alias(f"i{k}") for k in range(4)))
    some = stored(lists.join(bare.select("key").distinct(), "key", "full").join(twins.where(f"n_bytes >= {width}").select("key"), "key"), "repeat-lists")
    discard(level0, level1, level2, lone)
    texts = stored(keyed.select("key", "text").join(some, "key"), "repeat-chosen")
    discard(some)

    grouped = stored(cores(texts.where("i0 is not null"), width), "repeat-cores")
    # equal outer strings have equal cores
    outer = stored(grouped.groupBy("o1", "o2").agg(F.min("core").alias("core"), F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("one")), "repeat-outer")
    equal = stored(outer.where("n > 1").select("o1", "o2"), "repeat-equal")
    first = F.shiftright("at", 16)
    whole = grouped.select("key", "at", "o1", "o2").join(equal, ["o1", "o2"], "left_semi").select("key", first.alias("start"), (first + F.col("at").bitwiseAND(0xFFFF) + width).alias("end"))
    whole = stored(whole.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("cover")), "repeat-whole")
    discard(grouped, equal)
    mixed_ = stored(outer.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("core"), "repeat-mixed")
    opened = outer.join(mixed_, "core", "left_semi").select("one.key", F.struct("one.at", (F.col("n") == 1).alias("single")).alias("x")).groupBy("key").agg(F.collect_list("x").alias("open"))
    opened = stored(opened, "repeat-open")
    discard(outer, mixed_)
    single = stored(windows(texts.select("key", "text").join(opened, "key"), width).unionByName(bare), "repeat-windows")
    discard(opened, bare)
    often = counted(single, ["w1", "w2"], "repeat-often")
    again = single.where("q % 2 = 1").join(often.select("w1", "w2"), ["w1", "w2"], "left_semi").select("key", F.shiftright("q", 1).alias("start")).withColumn("end", F.col("start") + width)
    again = stored(again.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("cover")), "repeat-again")
    discard(single, often)

    cover = whole.unionByName(again).unionByName(within).groupBy("key").agg(F.flatten(F.collect_list("cover")).alias("cover"))
    cover = stored(cover, "repeat-cover")
    discard(whole, again, within)
    gone = stored(removed(texts.select("key", "text").join(cover, "key")).dropDuplicates(["key"]), "repeat-removed")
    discard(texts, cover)
    return gone


def kept_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, spans (removed byte ranges in order, end exclusive), kept (the other bytes), kept_text (the letters of which every byte is kept)."""
    if width < 2 * (RADIUS + REACH):
        raise ValueError(f"width must be {2 * (RADIUS + REACH)} or more, so that windows can hold anchors")
    with shuffles_dropped(docs.sparkSession):
        keyed, twins = known_by_hash(docs)
        gone = without_repeats(keyed, twins, width)

    n_bytes = F.col("n_bytes").cast("long")
    twin = (F.col("n") > 1) & (F.col("n_bytes") >= width)
    per_text = twins.select("key", "n", "n_bytes").join(gone, "key", "left")
    return keyed.join(per_text, "key").select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        F.when(twin, F.array(F.struct(F.lit(0).cast("long").alias("start"), n_bytes.alias("end")))).otherwise(F.coalesce("spans", F.expr("array()"))).alias("spans"),
        F.when(twin, F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept"),
        F.when(twin, F.lit("")).otherwise(F.coalesce("kept_text", "text")).alias("kept_text"),
    )


def digests(kept: DataFrame, *more: Column | str) -> DataFrame:
    """From ``kept_texts``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``more``."""
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), *more)


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return digests(kept_texts(docs, width))

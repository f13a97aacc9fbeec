"""Language ID by n-gram filters with a bit for each language.

Fitting counts the n-grams of each language over all labelled documents of the learning fold, or with ``bound`` over a sample of about so many. An n-gram enters a language's filter when its share of that language's n-grams is at least
``MIN_SHARE`` and at least ``MIN_LIFT`` of its largest share in any language, so one language holds at most
(orders / MIN_SHARE) n-grams and the broadcast filter is bounded whatever the input. The filter is bit-sliced: slot s
holds a mask with one bit per language (several 64-bit words beyond 64 languages), and the AND of an n-gram's slots names all languages that hold it.

Prediction looks up every n-gram of the whole text, counts set bits per language, takes off the hits that
the filters' measured false-positive rates explain, and picks the largest corrected count; ties go to the
language that sorts first. The score is the winner's share of all corrected counts.

Text null, empty or without a letter: ``und``, score 0. With no labelled rows at all: ``und`` throughout. A text of which no
n-gram is known takes the first language, score 0. Rows keep their multiplicity and equal texts get equal results; null doc_id
is kept and never learned from. Texts of any length are read whole, one at a time where they are long; an empty table gives no rows. Columns other than
doc_id, text and lang are not read, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import hash_mod, mapped
from ._text import COUNT_BYTES, mixed, slices, summed

ORDERS = (1, 2, 3, 4)
MIN_SHARE = 2e-5
MIN_LIFT = 0.3
#: A text is in no learned language where its share of known n-grams is below LEAST of this quantile of labelled texts.
QUANTILE, LEAST = 0.001, 0.5
HASHES = 3
#: Rows of each language at least, where a sample is asked for.
LEAST_DOCS = 100
SALT = np.uint64(0x2545F4914F6CDD1D)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, lower-cased, with every run of others than letters as one space; offsets, a space around each text; letters per text)."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = letters()[points]
    n_letters = summed(letter.astype(np.int64), offsets)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each run of others only the first, which follows a letter
    keep[offsets[:-1]] = True
    first = np.concatenate([[0], np.cumsum(keep)])[offsets]
    return np.where(letter, points, 32)[keep].astype(np.uint64), first, n_letters


def grams(points: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram within a text, first n-gram of each text). Lone spaces are no n-grams."""
    n = len(points) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    h = points[:n].copy()
    for k in range(1, order):
        h = h * np.uint64(0x10FFFF + 2) + points[k : k + n]
    inside = np.ones(n, bool)
    for k in range(1, order):  # n-grams that run over the end of their text
        over = first[1:-1] - k
        inside[over[(over >= 0) & (over < n)]] = False
    if order == 1:
        inside &= points[:n] != 32
    starts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(first, n)]
    return mixed(h[inside] + np.uint64(order) * SALT), starts


def slot(h: np.ndarray, k: int, size: int) -> np.ndarray:
    """The k-th slot of each hash in a table of ``size`` slots, a power of two."""
    bits = size.bit_length() - 1
    return ((h ^ (h >> np.uint64(7 * k + 11))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x51ED27) >> np.uint64(64 - bits)).view(np.int64)


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``slots`` has one mask per word of 64 languages and slot, bit i % 64 of word i // 64 for ``languages[i]``."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Words x n-grams."""
        size = self.slots.shape[1]
        out = self.slots[:, slot(h, 0, size)]
        for k in range(1, HASHES):
            out &= self.slots[:, slot(h, k, size)]
        return out

    def held(self, masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected hits per text and language, n-grams per text, letters per text)."""
        points, first, n_letters = codes(texts)
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for order in ORDERS:
            h, starts = grams(points, first, order)
            mask = self.masks(h)
            total += np.diff(starts)
            for i in range(len(self.languages)):
                hits[:, i] += summed(self.held(mask, i), starts)
        corrected = (hits - total[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        return np.maximum(corrected, 0), total, n_letters


def build(languages: list[str], members: list[np.ndarray]) -> Filters:
    """Filters with at least 16 slots for each member; the false-positive rate of each language is measured on random n-grams."""
    size = 1 << max(10, int(16 * max(1, sum(map(len, members)))).bit_length())
    out = Filters(languages, np.zeros((-(-len(languages) // 64), size), np.uint64), np.zeros(len(languages)))
    for i, h in enumerate(members):
        for k in range(HASHES):
            out.slots[i // 64, np.unique(slot(h, k, size))] |= np.uint64(1 << i % 64)
    probe = out.masks(np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, 200_000, dtype=np.uint64))
    out.false_rate = np.array([out.held(probe, i).mean() for i in range(len(languages))])
    return out


def labelled(docs: DataFrame, bound: int | None = None) -> DataFrame:
    """lang and text of the learning fold, or of about ``bound`` of its rows: an equal number of each language, or all it has; LEAST_DOCS for each at least."""
    pool = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (hash_mod(F.col("doc_id"), 3) != 1))
    if bound is None:
        return pool.select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    share, left, names = bound, bound, sorted(sizes, key=lambda x: sizes[x])
    for k, x in enumerate(names):  # what small languages leave goes to larger ones
        share = max(LEAST_DOCS, left // (len(names) - k))
        if sizes[x] > share:
            break
        left -= sizes[x]
    spaces = 1 << 20
    chosen = F.lit(False)
    rates = {x: spaces if n <= share else int(spaces * share / n) for x, n in sizes.items()}
    if rates:
        chosen = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(spaces)) < F.create_map(*(F.lit(y) for pair in rates.items() for y in pair))[F.col("lang")]
    return pool.where(chosen).select("lang", "text")


def fit(docs: DataFrame, bound: int | None = None) -> Filters | None:
    """Learns from text and lang where lang is not null and crc32(doc_id as text) mod 3 is not 1: all rows, or about ``bound``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=COUNT_BYTES):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in sorted(set(langs)):
                points, first, _ = codes([t for t, x in zip(texts, langs) if x == lang])
                for order in ORDERS:
                    h, n = np.unique(grams(points, first, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), order, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "ord", "gram", "n"])

    counts = mapped(labelled(docs, bound), count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang", "ord").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), ["lang", "ord"]).select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    best = share.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("of"))
    kept = best.select("gram", F.expr(f"transform(filter(of, x -> x.share >= {MIN_LIFT} * best), x -> x.lang)").alias("langs"))
    rows = kept.collect()  # at most orders / MIN_SHARE for each language
    names = sorted({lang for r in rows for lang in r["langs"]})
    if not names:
        return None
    members: dict[str, list[int]] = {x: [] for x in names}
    for r in rows:
        for lang in r["langs"]:
            members[lang].append(r["gram"])
    return build(names, [np.array(members[x], np.int64).view(np.uint64) for x in names])


def decided(filters: Filters | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if filters is None:
        return ["und"] * len(texts), np.zeros(len(texts))
    hits, _, n_letters = filters.counts(texts)
    best, total = hits.argmax(axis=1), hits.sum(axis=1)
    score = np.where(total > 0, hits.max(axis=1) / np.maximum(total, 1e-12), 0.0)
    return [filters.languages[b] if n else "und" for b, n in zip(best, n_letters)], np.where(n_letters > 0, score, 0.0)


def predict(docs: DataFrame, filters: Filters | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, score = decided(model.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def known_share(filters: Filters, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(corrected hits of the best language per n-gram, letters) of each text."""
    hits, total, n_letters = filters.counts(texts)
    return hits.max(axis=1) / np.maximum(total, 1), n_letters


#: Ranges that a step of a search for a rank counts.
RANGES = 4096


def lower_quantile(shares: DataFrame, q: float) -> float | None:
    """The value of the column share (0 to 1) with floor(q * (n - 1)) of all n before it; None without any.

    Each step counts the rows of RANGES ranges of equal width and goes on in the one that holds the rank, until that has one value.
    """
    low, high, before = 0.0, 1.0, 0
    inside, rank = shares, None
    while True:
        place = F.floor((F.col("share") - low) * (RANGES / (high - low)))
        counts = inside.groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min("share").alias("low"), F.max("share").alias("high")).collect()
        if not counts:
            return None
        rank = int(np.floor(q * (sum(r["n"] for r in counts) - 1))) if rank is None else rank
        for r in sorted(counts, key=lambda r: r["at"]):
            if before + r["n"] > rank:
                break
            before += r["n"]
        low, high = r["low"], r["high"]
        if low == high:
            return low
        inside = shares.where((F.col("share") >= low) & (F.col("share") <= high))


def least_share(docs: DataFrame, filters: Filters | None) -> float:
    """Half (``LEAST``) of the share of known n-grams that all but one in a thousand (``QUANTILE``) texts of the learning fold reach; 0 without any."""
    if filters is None:
        return 0.0
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            share, n_letters = known_share(model.value, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(share[n_letters > 0])], names=["share"])

    shares = mapped(labelled(docs), run, "share double").persist(StorageLevel.DISK_ONLY)  # a number for each text
    least = lower_quantile(shares, QUANTILE)
    shares.unpersist()
    return LEAST * (least or 0.0)


def keep_known(docs: DataFrame, filters: Filters | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language.

    Those decided ``und`` go, and those of which no n-gram, or a share below ``least`` (see ``least_share``), is known.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if model.value is not None:
                share, n_letters = known_share(model.value, part.column("text").to_pylist())
                yield part.filter(pa.array((n_letters > 0) & (share > 0) & (share >= least), pa.bool_()))

    return mapped(docs, run, docs.schema)

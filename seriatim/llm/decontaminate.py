"""Benchmark decontamination: BM25 over the test items, searched with block-max bounds, then verified.

Words are maximal runs of letters, digits and bytes of other alphabets, lower-cased. Test items are cut into segments of at most
``STRIDE`` words, which are the documents of the index. Every training text is read whole, in passages of 2 * STRIDE
words that begin every STRIDE words (the last may be shorter), so a copied segment always lies whole in
some passage. A passage is the query; its distinct words are the query terms. A segment's score is divided by the score of the
segment against itself, and every segment of ``THRESHOLD`` or more is retrieved.

As in block-max WAND, bounds decide what is scored: the sum of the words' greatest impacts over all segments rules
out most passages, then the sum of their greatest impacts in a block of ``BLOCK`` segments rules out blocks,
and only postings of the blocks left are summed. The bounds never fall below a score, so nothing above the threshold is lost.

A retrieved item is verified on the whole text: the share of the 3-word sequences of its question, and of its answer, that
occur there must reach ``OVERLAP`` each. The answer is the item's last sentence, or its last third where it has one
sentence, but 3 words at least, and so is the question. Items of fewer than 3 words are too short to tell and match nothing.

The index is broadcast in shards of about ``SHARD`` items. Document frequencies, the number of segments and their mean length are
counted over all items, so scores do not depend on how the index is cut. An item without an id is searched like any other, and its matches have a null item_id. Null or empty texts and items without
words match nothing. Rows of documents keep their multiplicity; of items that share an id the best match counts, and equal items or
texts match alike. Texts of any length are read whole, one at a time where they are long. An empty table on either side gives no match. Columns other
than doc_id, text and item_id are not read, whatever their names; ``clean`` passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import mapped
from ._text import Prefix, mixed, slices, utf8

STRIDE, BLOCK, SHARD = 32, 64, 20_000
AT_ONCE, TEXT_BYTES = 256, 1 << 19
K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.5, 0.5
GRAM = 3
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SENTENCE = re.compile(r"(?<=[.!?。])\s+")


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and one more)."""
    raw, offsets = utf8(pc.utf8_lower(column))
    solid = WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return Prefix(raw).spans(start, np.flatnonzero(last) + 1), np.searchsorted(start, offsets)


def sequences(h: np.ndarray) -> np.ndarray:
    """Hashes of the distinct sequences of GRAM words."""
    n = max(0, len(h) - GRAM + 1)
    out = h[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, GRAM):
        out = mixed(out) + h[k : n + k]
    return np.unique(mixed(out))


def parts(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of (question, answer) of a test item with the words ``h``."""
    sentences = [s for s in SENTENCE.split(text.strip()) if s]
    tail = int(np.diff(words(pa.array(sentences[-1:]))[1]).sum()) if len(sentences) > 1 else len(h) // 3
    cut = min(max(len(h) - max(tail, GRAM), 0), len(h))
    return h[: max(cut, GRAM)], h[cut:]


@dataclass
class Index:
    item_ids: list[int | None]  # by item
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    segment_item: np.ndarray
    terms: np.ndarray  # sorted word hashes
    greatest: np.ndarray  # by term: its greatest impact
    first: np.ndarray  # by term: its first posting, and one more
    segment: np.ndarray  # by posting, ascending within a term
    impact: np.ndarray
    block_first: np.ndarray  # by term: its first block, and one more
    block: np.ndarray
    block_impact: np.ndarray
    block_posting: np.ndarray  # by block entry: its first posting, and one more


@dataclass
class Statistics:
    """What BM25 needs of all items: number and mean length of segments, and of each word (sorted hashes) how many hold it."""

    segments: int
    mean_length: float
    terms: np.ndarray
    df: np.ndarray


def segmented(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments of each text, segment of each word): texts cut evenly into pieces of at most STRIDE words."""
    n_words = np.diff(first)
    n_pieces = -(-n_words // STRIDE)
    within = np.arange(first[-1]) - np.repeat(first[:-1], n_words)
    piece = within * np.repeat(n_pieces, n_words) // np.repeat(np.maximum(n_words, 1), n_words)
    return n_pieces, np.repeat(np.cumsum(n_pieces) - n_pieces, n_words) + piece


def statistics(items: DataFrame) -> Statistics:
    """Over all items, added up in Spark. The words of the test items are what the indexes hold anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, first = words(part.column("text"))
            n_pieces, segment = segmented(first)
            once = np.unique(np.stack([h, segment.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(h) else h
            keys, n = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(np.zeros(len(keys), np.int64))], names=["term", "n", "n_words"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(n_pieces.sum())]), pa.array([len(h)])], names=["term", "n", "n_words"])

    rows = mapped(items.select("text"), run, "term long, n long, n_words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words")).toArrow()
    whole = {r["term"]: r for r in rows.filter(pc.is_null(rows.column("term"))).to_pylist()}.get(None, {"n": 0, "n_words": 0})
    own = rows.filter(pc.is_valid(rows.column("term")))
    terms = own.column("term").to_numpy().view(np.uint64)
    order = np.argsort(terms)
    return Statistics(whole["n"], whole["n_words"] / max(whole["n"], 1), terms[order], own.column("n").to_numpy()[order])


def build(item_ids: list[int | None], texts: list[str | None], known: Statistics | None = None) -> Index | None:
    """The index of test items; impacts are BM25 term scores over the segment's score against itself. ``known``: statistics of more items than these."""
    h, first = words(pa.array(texts, pa.string()))
    n_words = np.diff(first)
    some = n_words > 0
    if not some.any():
        return None
    both = [parts(t or "", h[a:b]) for t, a, b in zip(texts, first[:-1], first[1:])]
    n_pieces, segment_of = segmented(first)
    base = np.concatenate([[0], np.cumsum(n_pieces)])
    n_segments = int(base[-1])
    length = np.bincount(segment_of, minlength=n_segments)
    terms, term_of = np.unique(h, return_inverse=True)
    posting, tf = np.unique(term_of.astype(np.int64) * n_segments + segment_of, return_counts=True)
    term, segment = posting // n_segments, posting % n_segments
    known = known or Statistics(n_segments, length.mean(), terms, np.bincount(term, minlength=len(terms)))
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log1p((known.segments - df + 0.5) / (df + 0.5))
    score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[segment] / known.mean_length))
    own = np.bincount(segment, score, n_segments)
    impact = score / own[segment]
    at = np.searchsorted(term, np.arange(len(terms) + 1))
    entry = term * (n_segments // BLOCK + 1) + segment // BLOCK
    opens = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    return Index(
        list(item_ids),
        [sequences(q) for q, _ in both],
        [sequences(a) for _, a in both],
        np.repeat(np.arange(len(texts)), n_pieces),
        terms, np.maximum.reduceat(impact, at[:-1]), at, segment, impact,
        np.searchsorted(term[opens], np.arange(len(terms) + 1)), segment[opens] // BLOCK, np.maximum.reduceat(impact, opens), np.append(opens, len(term)),
    )


def expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first[i]:last[i], (i of each member, each member)."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def totals(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, back = np.unique(key, return_inverse=True)
    return distinct, np.bincount(back, weight, len(distinct))


def retrieved(index: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, best score) of every item with a segment of THRESHOLD or more in a passage of the text."""
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, np.zeros(0)
    term = np.searchsorted(index.terms, h)
    term[term == len(index.terms)] = 0
    term = np.where(index.terms[term] == h, term, -1)
    # a passage is two neighbouring strides of one text
    n_words = np.diff(first)
    n_strides = -(-n_words // STRIDE)
    base = np.concatenate([[0], np.cumsum(n_strides)])
    stride = np.repeat(base[:-1], n_words) + (np.arange(len(h)) - np.repeat(first[:-1], n_words)) // STRIDE
    hit = np.flatnonzero(term >= 0)
    mass = np.bincount(stride[hit], index.greatest[term[hit]], base[-1])
    follows = np.ones(base[-1], bool)
    follows[base[1:] - 1] = False
    reach = mass + np.where(follows, np.append(mass[1:], 0), 0)
    passage = np.flatnonzero(reach >= THRESHOLD - 1e-9)
    if not len(passage):
        return none, none, np.zeros(0)
    # distinct terms of each passage left
    slot = np.full(base[-1] + 1, -1)
    slot[passage] = np.arange(len(passage))
    pairs = [np.stack([slot[s], t]) for s, t in ((stride[hit], term[hit]), (stride[hit] - 1, term[hit]))]
    second = stride[hit] - 1
    pairs[1] = pairs[1][:, (second >= 0) & follows[np.maximum(second, 0)]]
    pair = np.concatenate(pairs, axis=1)
    pair = np.unique(pair[0][pair[0] >= 0] * len(index.terms) + pair[1][pair[0] >= 0])
    p, t = pair // len(index.terms), pair % len(index.terms)
    # bounds by block, then scores in the blocks left, for AT_ONCE passages at a time
    n_blocks, n_segments = int(index.block.max()) + 1, len(index.segment_item)
    parts_found, parts_score = [], []
    cuts = np.searchsorted(p, np.arange(0, len(passage) + AT_ONCE, AT_ONCE))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        of, entry = expanded(index.block_first[t[lo:hi]], index.block_first[t[lo:hi] + 1])
        key = p[lo:hi][of] * n_blocks + index.block[entry]
        blocks, bound = totals(key, index.block_impact[entry])
        live = np.isin(key, blocks[bound >= THRESHOLD - 1e-9])
        of, entry = of[live], entry[live]
        of2, posting = expanded(index.block_posting[entry], index.block_posting[entry + 1])
        some, score = totals(p[lo:hi][of[of2]] * n_segments + index.segment[posting], index.impact[posting])
        parts_found.append(some[score >= THRESHOLD])
        parts_score.append(score[score >= THRESHOLD])
    found, score = np.concatenate(parts_found), np.concatenate(parts_score)
    text = np.searchsorted(base, passage[found // n_segments], "right") - 1
    match = text * len(index.item_ids) + index.segment_item[found % n_segments]
    distinct, back = np.unique(match, return_inverse=True)
    best = np.zeros(len(distinct))
    np.maximum.at(best, back, score)
    return distinct // len(index.item_ids), distinct % len(index.item_ids), best


def matches(index: Index, column: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
    """(text, item id, score, question overlap, answer overlap) of every verified match in a slice."""
    h, first = words(column)
    out: dict[tuple[int, int | None], tuple[float, float, float]] = {}
    grams: tuple[int, np.ndarray] = (-1, h[:0])
    for text, item, score in zip(*(x.tolist() for x in retrieved(index, h, first))):
        if grams[0] != text:
            grams = (text, sequences(h[first[text] : first[text + 1]]))
        q, a = (float(np.isin(x, grams[1]).mean()) if len(x) else 0.0 for x in (index.questions[item], index.answers[item]))
        if q >= OVERLAP and a >= OVERLAP:
            key = (text, index.item_ids[item])
            out[key] = max(out.get(key, (0.0, 0.0, 0.0)), (score, q, a))
    return [(*k, *v) for k, v in sorted(out.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]


def indexes(items: DataFrame) -> Iterator[Index]:
    """The index of each shard of (item_id, text)."""
    known = items.select("item_id", "text").where("text is not null")
    shards = -(-known.count() // SHARD)
    over_all = statistics(known) if shards else None
    for k in range(shards):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        index = build(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), over_all)
        if index is not None:
            yield index


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every verified match: doc_id, item_id, score, question_overlap, answer_overlap."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, limit=TEXT_BYTES):
                if got := matches(shared.value, part.column("text")):
                    text, *rest = zip(*got)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(rest[0], pa.int64()), *(pa.array(c, pa.float64()) for c in rest[1:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(mapped(docs.select("doc_id", "text"), run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that match no test item."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, limit=TEXT_BYTES):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in matches(shared.value, part.column("text"))]] = False
                yield part.filter(pa.array(keep))

        docs = mapped(docs, run, docs.schema)
    return docs

"""Toxicity by maximum-scoring segments.

A token is a maximal run of letters, digits and bytes of other alphabets, with A-Z lowered; its stem is its first
``STEM`` bytes. The score of either is the log-odds of occurring in toxic against other labelled texts (a text counts
once for each), under a Dirichlet prior proportional to the count over *all* documents, taken at the end of the
confidence interval that lies nearer to zero. A token scores as itself or its stem, whichever says more; a small cost
per token makes the expected score negative. What is not in the labelled sample costs the same.

For each document one linear scan finds every maximal-scoring segment. A segment of score S in a text of m tokens
has the extreme-value expectation E = K m exp(-lambda S), with lambda solving the Karlin-Altschul equation on the scores of non-toxic
text. Segments with E below ``SIGNIFICANT`` are the toxic passages. A document's evidence sums lambda S - ln(K m) over
its passages (the best segment stands in, also below 0, where none is significant), and a logistic curve fitted on the labelled sample turns it into
the score.

At most ``FIT_DOCS`` labelled rows outside the held-out fold are used, by a hash of doc_id; their vocabulary bounds the prior and the
broadcast table. Null or empty text scores as evidence 0. Without labels of both kinds every score is 0. Rows keep their
multiplicity; a null doc_id is scored, held_out null, and never learned from; a doc_id with several label rows counts
once, with the largest label.
A text of any length is scanned whole, one at a time where it is long; equal texts get equal scores; an empty table gives no rows. Columns other than
doc_id, text and toxic are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_rows, hash_mod, hashed_sample, mapped, stored
from ._text import COUNT_BYTES, FOLDED, Prefix, slices, summed, utf8

FIT_DOCS = 12_000
PRIOR_MASS, LEAST_PRIOR = 500.0, 0.5
COST = 0.05
Z = 2.5
K = 0.1
SIGNIFICANT = 0.05
STEM = 6
STEM_SALT = np.uint64(0x5BD1E9955BD1E995)
THRESHOLD = 0.5
TOKEN = np.zeros(256, bool)
TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of tokens and of their stems, byte start within the text, byte end, first token of each text and one more)."""
    raw, offsets = utf8(column)
    solid = TOKEN[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(start, offsets)
    base = np.repeat(offsets[:-1], np.diff(at))
    prefix = Prefix(raw, FOLDED)
    stem = prefix.spans(start, np.minimum(end, start + STEM)) ^ STEM_SALT
    return np.stack([prefix.spans(start, end), stem]), start - base, end - base, at


@dataclass
class Model:
    keys: np.ndarray  # sorted token hashes
    scores: np.ndarray
    rate: float  # lambda
    slope: float
    bias: float

    def of(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        word, stem = np.where(self.keys[at] == h, self.scores[at], 0.0)
        return np.where(np.abs(word) > np.abs(stem), word, stem) - COST


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, left to right, in one linear scan.

    Runs of one sign are merged first. Each positive run opens a candidate with the totals before (left) and after
    (right) it; it joins back to the nearest candidate with a lower left, provided that one's right is below its own.
    ``link`` leads from a candidate to that nearest lower one, so no candidate is looked at twice.
    """
    positive = score > 0
    if not positive.any():
        return []
    bounds = np.flatnonzero(np.diff(positive)) + 1
    begins = np.concatenate([[0], bounds])
    ends = np.concatenate([bounds, [len(score)]])
    total = np.concatenate([[0.0], np.cumsum(score)])
    stack: list[list] = []  # [left, right, start, end, link]
    for b, e in zip(begins.tolist(), ends.tolist()):
        if not positive[b]:
            continue
        left, right, start = total[b], total[e], b
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append([left, right, start, e, j])
                break
            left, start = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, float(r - lo)) for lo, r, s, e, _ in stack]


def evidence(score: np.ndarray, first: np.ndarray, rate: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(evidence per text, significant segments per text). A text without any positive token has that of a segment of score 0."""
    n = np.diff(first)
    out, passages = -np.log(K * np.maximum(n, 1 / K)), [[] for _ in n]
    best_possible = summed(np.maximum(score, 0), first)
    for i in np.flatnonzero(best_possible > 0):
        found = maximal_segments(score[first[i] : first[i + 1]])
        bits = [(s, e, rate * x - np.log(max(1.0, K * n[i]))) for s, e, x in found]
        passages[i] = [x for x in bits if x[2] > -np.log(SIGNIFICANT)]
        out[i] = sum(x[2] for x in passages[i]) or max(x[2] for x in bits)
    return out, passages


def karlin(scores: np.ndarray, weights: np.ndarray) -> float:
    """lambda > 0 with sum(w exp(lambda s)) = 1 for weights that sum to 1; 1 where none exists."""
    if (weights * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (weights * np.exp(np.minimum(hi * scores, 500))).sum() < 1 and hi < 64:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (weights * np.exp(np.minimum(mid * scores, 500))).sum() < 1 else (lo, mid)
    return max(lo, 1e-3)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a lightly regularised logistic fit on one feature, by Newton steps."""
    slope, bias = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + bias, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - y) * x).sum() + 0.1 * slope, (p - y).sum() + 1e-3 * bias])
        hess = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        slope, bias = slope - step[0], bias - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(bias)


def corpus_counts(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """How often each token of a bounded vocabulary occurs over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        n = np.zeros(len(keys), np.int64)
        for part in slices(batches, limit=COUNT_BYTES):
            h = tokens(part.column("text"))[0].ravel()
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            n += np.bincount(at[keys[at] == h], minlength=len(keys))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["i", "n"])

    rows = mapped(docs.select("text"), run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys))
    out[rows.column("i").to_numpy()] = rows.column("n").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> Model | None:
    known = labels.where(F.col("toxic").isin(0, 1) & (hash_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = hashed_sample(known, bound, F.col("doc_id"))
    # about ``bound`` rows at most, so it may be broadcast; ids may repeat in docs, so rows are bounded too
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    sample = stored(bounded_rows(joined, bound).select("text", "label"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=COUNT_BYTES):
            h, _, _, first = tokens(part.column("text"))
            text = np.repeat(np.arange(part.num_rows), np.diff(first))
            label = part.column("label").to_numpy()
            once = np.unique(np.stack([np.tile(text, 2).astype(np.uint64), h.ravel()], axis=1), axis=0)
            for y in (0, 1):
                keys, n = np.unique(once[label[once[:, 0].astype(np.int64)] == y, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), y, np.int32)), pa.array(n)], names=["key", "label", "n"])

    counted = mapped(sample, count, "key long, label int, n long").groupBy("key").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    rows = counted.where(F.col("toxic") + F.col("clean") >= 4).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, toxic, clean = keys[order], rows.column("toxic").to_numpy()[order].astype(float), rows.column("clean").to_numpy()[order].astype(float)
    if toxic.sum() == 0 or clean.sum() == 0:
        return None
    prior = corpus_counts(docs, keys)
    prior = LEAST_PRIOR + PRIOR_MASS * prior / max(prior.sum(), 1)
    a, b = toxic + prior, clean + prior
    ratio = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    slack = Z * np.sqrt(1 / a + 1 / b)
    scores = np.where(ratio > 0, np.maximum(ratio - slack, 0), np.minimum(ratio + slack, 0))
    model = Model(keys, scores, karlin(scores - COST, b / b.sum()), 1.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, _, _, first = tokens(part.column("text"))
            x, _ = evidence(shared.value.of(h), first, shared.value.rate)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(x)], names=["label", "x"])

    got = mapped(sample, measure, "label int, x double").toArrow()
    model.slope, model.bias = logistic(got.column("x").to_numpy(), got.column("label").to_numpy().astype(float))
    return model


def passages(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: doc_id, score, passages (array of byte start, byte end and evidence of each significant segment)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches):
            score, found = np.zeros(part.num_rows), [[]] * part.num_rows
            if m is not None:
                h, start, end, first = tokens(part.column("text"))
                x, segments = evidence(m.of(h), first, m.rate)
                score = 1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -40, 40)))
                found = [[{"start": int(start[first[i] + s]), "end": int(end[first[i] + e - 1]), "evidence": float(v)} for s, e, v in got] for i, got in enumerate(segments)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:bigint,end:bigint,evidence:double>>")


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_passages."""
    scored = passages(docs, fit(docs, labels, bound))
    return scored.select("doc_id", (hash_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))

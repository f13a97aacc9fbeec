"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

A word is a maximal run of letters and digits, or of other visible characters; case counts. Words are hashed to
``BUCKETS`` buckets. Each bucket has a fixed sparse ternary index vector; the vector of a bucket is the sum of the
index vectors of the words beside it over *all* documents (random indexing), damped to unit length. A document's
features are the mean of its words' vectors and the mean of the products of the sign vectors of adjacent
words, which shows repetition. The network (one hidden layer) learns on labelled rows outside the held-out fold, at
most ``FIT_DOCS`` of them by a hash of doc_id; a tenth of these sets the temperature that calibrates its
probabilities.

Sizes: the word vectors are BUCKETS x DIMS whatever the input; each task sends at most BUCKETS rows to their sum.
Null or empty text has zero features and still gets a score. Without any usable label every score is the prior 0.5.
Rows keep their multiplicity; a null doc_id is scored, held_out null, and never learned from. A doc_id with several label
rows counts once, with the largest label. A text of any length is taken whole, one at a time where it is long; equal texts get equal scores;
an empty table gives no rows. Columns other than doc_id, text and quality are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_rows, hash_mod, hashed_sample, mapped
from ._text import COUNT_BYTES, SPACE, Prefix, slices, summed, utf8

BUCKETS, DIMS, NONZERO, SIGNS = 4096, 64, 6, 16
FIT_DOCS = 12_000
HIDDEN, EPOCHS, RATE = 32, 60, 0.01
THRESHOLD = 0.3

#: Character classes of bytes: 0 white space, 1 letters, digits and bytes of other alphabets, 2 the rest.
CLASS = np.full(256, 2, np.int8)
CLASS[SPACE] = 0
CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

_rng = np.random.Generator(np.random.PCG64(11))
SIGN = _rng.choice(np.array([-1, 1], np.int8), (BUCKETS, SIGNS))
#: For each bucket, the places and signs of its index vector.
PLACES = np.argsort(_rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
VALUES = _rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, number of the first word of each text and one more)."""
    kind = CLASS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = kind > 0
    first[1:] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    last = kind > 0
    last[:-1] &= (kind[1:] != kind[:-1]) | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return (Prefix(raw).spans(start, end) & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(start, offsets)


def neighbours(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where word i and word i + 1 are of one text."""
    inside = np.ones(max(0, len(word) - 1), bool)
    over = first[1:-1] - 1
    inside[over[(over >= 0) & (over < len(inside))]] = False
    return np.flatnonzero(inside)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS context vectors, summed over all documents."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMS)
        for part in slices(batches, limit=COUNT_BYTES):
            word, first = buckets(*utf8(part.column("text")))
            i = neighbours(word, first)
            pair, n = np.unique(np.concatenate([word[i] * BUCKETS + word[i + 1], word[i + 1] * BUCKETS + word[i]]), return_counts=True)
            of, beside = pair // BUCKETS, pair % BUCKETS
            for k in range(NONZERO):
                total += np.bincount(of * DIMS + PLACES[beside, k], VALUES[beside, k] * n, BUCKETS * DIMS)
        table = total.reshape(BUCKETS, DIMS).astype(np.int64)
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, d]) for d in range(DIMS))], names=["bucket", *(f"d{d}" for d in range(DIMS))])

    schema = "bucket int, " + ", ".join(f"d{d} long" for d in range(DIMS))
    rows = mapped(docs.select("text"), contexts, schema).groupBy("bucket").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS))).toArrow()
    vectors = np.zeros((BUCKETS, DIMS), np.float32)
    if rows.num_rows:
        got = np.stack([rows.column(f"d{d}").to_numpy() for d in range(DIMS)], axis=1).astype(float)
        got = np.sign(got) * np.log1p(np.abs(got))
        vectors[rows.column("bucket").to_numpy()] = got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
    return vectors


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Texts x (DIMS + SIGNS) pooled features."""
    word, first = buckets(*utf8(column))
    n = np.diff(first)
    out = np.zeros((len(n), DIMS + SIGNS))
    text = np.repeat(np.arange(len(n)), n)
    for at in range(0, len(n), 256):  # counts of 256 texts at a time
        to = min(at + 256, len(n))
        lo, hi = first[at], first[to]
        counts = np.bincount((text[lo:hi] - at) * BUCKETS + word[lo:hi], minlength=(to - at) * BUCKETS).reshape(to - at, BUCKETS)
        out[at:to, :DIMS] = counts.astype(np.float32) @ vectors
    if len(word) > 1:
        i = neighbours(word, first)
        product = (SIGN[word[i]] * SIGN[word[i + 1]]).astype(np.float32)
        out[:, DIMS:] = summed(product, np.searchsorted(i, first))
    return out / np.maximum(n, 1)[:, None]


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Network:
    """Adam on cross-entropy over the rows not set aside; those set aside choose the temperature."""
    rng = np.random.Generator(np.random.PCG64(3))
    fit = ~aside if (~aside).any() else np.ones(len(y), bool)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, 1.0)
    z, t = (x[fit] - mean) / scale, y[fit].astype(float)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            rows = order[at : at + 256]
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -40, 40)))
            d = (p - t[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - hidden**2)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p_, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    held = aside if aside.any() else fit
    logits, target = net.logits(x[held]), y[held].astype(float)

    def loss(temperature: float) -> float:
        s = logits / temperature
        return float(np.mean(np.logaddexp(0, s) - target * s))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, bound: int = FIT_DOCS) -> Network | None:
    """A network for labels.quality from rows whose crc32(doc_id as text) mod 5 is not 0; None without labels."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & (hash_mod(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = hashed_sample(known, bound, F.col("doc_id"))
    shared = spark.sparkContext.broadcast(vectors)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = features(part.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([part.column("pick"), part.column("label"), part.column("aside"), pa.array(list(x), pa.list_(pa.float64()))], names=["pick", "label", "aside", "x"])

    # chosen holds about ``bound`` rows at most, so it may be broadcast; ids may repeat in docs, so rows are bounded too
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    sample = bounded_rows(joined, bound).select("pick", "text", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).alias("aside"))
    rows = mapped(sample, extract, "pick long, label int, aside boolean, x array<double>").toArrow().sort_by("pick")
    y = rows.column("label").to_numpy()
    if rows.num_rows == 0:
        return None
    x = np.array(rows.column("x").to_pylist()).reshape(len(y), -1)
    return train(x, y, rows.column("aside").to_numpy(zero_copy_only=False).astype(bool))


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            vectors, network = shared.value
            p = np.full(part.num_rows, 0.5) if network is None else network.probabilities(features(part.column("text"), vectors))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (hash_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCS) -> DataFrame:
    vectors = word_vectors(docs)
    return score(docs, vectors, fit(docs, labels, vectors, bound))

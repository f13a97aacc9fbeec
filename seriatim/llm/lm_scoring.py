"""Language-model scores: the marginal probability of a text over all segmentations into subword pieces.

Tokens are the words of a text, A-Z in lower case, and one end. The pieces of an installed vocabulary span a lattice over each word (a space
in front, as the vocabulary has it); no piece crosses a space, so the forward recursion over a text falls into recursions over its words,
and is run once for each distinct word. Weights of pieces start from the vocabulary's own scores and are fitted by expected counts (forward
and backward recursion, ``ROUNDS`` rounds, all training words as types). The vocabulary itself, its pieces and cuts, is never trained. Characters without a piece
are spelt in bytes, all of one weight.

A word that the training rows hold has an edge of its own over the whole lattice: with c its count, N all and V distinct training tokens,
P(word) = (c + (V + 1) * marginal) / (N + V + 1), and the end, as a piece of weight ``END``, likewise. Both are proper distributions, so ``score`` is a
log10 probability; ``lattice_score`` is the lattice alone, and ``base_score`` the smoothed counts alone, sum of log10((c + 0.5) / (N + 0.5 * (V + 1))).

Spark counts words with partial sums by slice. Words that make up 1 / ``HOT`` of all tokens or more (so ``HOT`` at most, of ``HOT_BYTES``
at most) are broadcast and summed up beside the text; only pairs of a document and a rarer word are shuffled to join their word, each word having
less than 1 / ``HOT`` of the tokens. Documents are read twice, and no text, word list or count is gathered on the driver but for sums by piece.

Null text: empty, one token. Rows whose training flag is null or false are scored and not learned from. Rows keep their multiplicity; repeated and
tied rows are scored and learned each. No training row: N = V = 0 and the weights stay those of the vocabulary. An empty table gives no rows. Long texts and words are taken whole: a slice holds ``SLICE`` bytes
or the longest text, a recursion 8 bytes for each character of its word. Columns other than doc_id, text and those of the flag are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import mapped, stored
from ._text import SPACE, slices, utf8

SLICE = 4 << 20
HOT, HOT_BYTES = 1 << 16, 64
ROUNDS = 2
END = 0.01
#: Cells (word x character) of a batch of words, and characters whose edges are held at once.
CELLS, SPAN = 1 << 17, 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
OUT = -np.inf


@dataclass
class Lattice:
    """A trie of pieces and their log weights; piece ``size`` is any byte."""

    keys: np.ndarray  # sorted node << 21 | code point
    child: np.ndarray
    piece: np.ndarray  # by node; -1: none
    single: np.ndarray  # by code point: whether a piece of this character exists
    width: int
    weight: np.ndarray  # by piece, then one byte, then OUT for no edge
    ascii: np.ndarray | None = None  # [node, code point below 128]: the next node, 0: none; filled on first use, by each worker

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each character, 0 where there is none."""
        if self.ascii is None:
            self.ascii = np.zeros((len(self.piece), 128), np.int32)
            low = (self.keys & ((1 << 21) - 1)) < 128
            self.ascii[self.keys[low] >> 21, self.keys[low] & 127] = self.child[low]
        plain = code < 128
        if plain.all():
            return self.ascii[node, code]
        out = np.zeros(len(node), np.int32)
        out[plain] = self.ascii[node[plain], code[plain]]
        key = node[~plain].astype(np.int64) << 21 | code[~plain]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        out[~plain] = np.where(self.keys[place] == key, self.child[place], 0)
        return out

    @property
    def size(self) -> int:
        return len(self.weight) - 2

    def weighed(self, mass: np.ndarray) -> Lattice:
        """The same pieces with ``mass`` (by piece, and of all bytes together) as weights."""
        with np.errstate(divide="ignore"):
            logs = np.log(mass / mass.sum())
        logs[-1] -= math.log(256)
        return Lattice(self.keys, self.child, self.piece, self.single, self.width, np.append(logs, OUT))


def load(path: str) -> tuple[Lattice, np.ndarray]:
    """The lattice of a SentencePiece model and the starting mass of its pieces.

    Scores of a unigram model are log weights. Models of the BPE kind have ranks as scores; there the mass is 1 / (rank + 1), as
    frequencies by rank are. Bytes together have the mass of the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in usable]
    score = np.array([model.get_score(i) for i in usable])
    if np.array_equal(score, np.round(score)):
        rank = np.empty(len(score))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
        mass = 1 / (rank + 1)
    else:
        mass = np.exp(score)
    mass = np.append(mass, mass.min())
    return built(pieces).weighed(mass), mass / mass.sum()


def built(pieces: list[str]) -> Lattice:
    child: dict[int, int] = {}
    last: list[int] = [-1]
    single = np.zeros(0x110000, bool)
    for i, name in enumerate(pieces):
        node = 0
        for c in name:
            key = node << 21 | ord(c)
            if key not in child:
                child[key] = len(last)
                last.append(-1)
            node = child[key]
        last[node] = i
        if len(name) == 1:
            single[ord(name)] = True
    keys = np.array(sorted(child), np.int64)
    return Lattice(keys, np.array([child[int(k)] for k in keys], np.int32), np.array(last, np.int32), single, max(map(len, pieces), default=1), np.zeros(len(pieces) + 2))


def byte_count(codes: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def edges(lattice: Lattice, codes: np.ndarray, size: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """[word, end - lo - 1, length - 1]: the piece that ends at ``end`` in (lo, hi], else ``size + 1``; lengths up to the longest found."""
    n, none = len(codes), lattice.size + 1
    out = np.full((n, hi - lo, lattice.width), none, np.int32)
    begin = max(0, lo - lattice.width + 1)
    word, at = np.divmod(np.arange(n * (hi - begin)), hi - begin)
    at += begin
    node = np.zeros(len(word), np.int32)
    stop = np.minimum(size, hi)
    longest = 1
    for k in range(1, lattice.width + 1):
        inside = at + k <= stop[word]
        word, at, node = word[inside], at[inside], node[inside]
        node = lattice.step(node, codes[word, at + k - 1])
        found = node > 0
        word, at, node = word[found], at[found], node[found]
        got = lattice.piece[node]
        some = (got >= 0) & (at + k > lo)
        if some.any():
            longest = k
            out[word[some], at[some] + k - lo - 1, k - 1] = got[some]
        if not len(word):
            break
    return out[:, :, :longest]


def spelt(lattice: Lattice, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """[word, character]: log weight of the character in bytes where it has no piece, else OUT."""
    known = lattice.single[codes] | (np.arange(codes.shape[1]) >= size[:, None])
    return np.where(known, OUT, byte_count(codes) * lattice.weight[lattice.size])


def log_sum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials along the last axis; OUT where all are."""
    top = x.max(axis=-1)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe[..., None]).sum(axis=-1)) + safe


class Edges:
    """The edges of a batch by span; those of the last span asked for are kept."""

    def __init__(self, lattice: Lattice, codes: np.ndarray, size: np.ndarray):
        self.lattice, self.codes, self.size, self.at, self.got = lattice, codes, size, -1, None

    def span(self, lo: int) -> np.ndarray:
        if self.at != lo:
            self.at, self.got = lo, edges(self.lattice, self.codes, self.size, lo, min(self.codes.shape[1], lo + SPAN))
        return self.got


def forward(lattice: Lattice, codes: np.ndarray, size: np.ndarray, found: Edges | None = None) -> np.ndarray:
    """[word, width + j]: log weight of all segmentations of the first j characters; the first columns are padding."""
    n, length = codes.shape
    w = lattice.width
    found = found or Edges(lattice, codes, size)
    a = np.full((n, w + length + 1), OUT)
    a[:, w] = 0.0
    alone = spelt(lattice, codes, size)
    spelling = np.isfinite(alone).any(axis=0)
    for lo in range(0, length, SPAN):
        piece = found.span(lo)
        k = piece.shape[2]
        for j in range(lo + 1, min(length, lo + SPAN) + 1):
            ways = a[:, w + j - k : w + j][:, ::-1] + lattice.weight[piece[:, j - lo - 1]]
            if spelling[j - 1]:
                ways[:, 0] = np.logaddexp(ways[:, 0], a[:, w + j - 1] + alone[:, j - 1])
            a[:, w + j] = log_sum(ways)
    return a


def expected(lattice: Lattice, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log marginal of each word, expected uses of each piece and of bytes over all words)."""
    n, length = codes.shape
    w, rows = lattice.width, np.arange(n)
    found = Edges(lattice, codes, size)
    a = forward(lattice, codes, size, found)
    total = a[rows, w + size]
    b = np.full((n, w + length + 1), OUT)  # b[:, w + j]: all segmentations of what follows the first j characters
    b[rows, w + size] = 0.0
    alone = spelt(lattice, codes, size)
    spelling = np.isfinite(alone).any(axis=0)
    uses = np.zeros(lattice.size + 2)
    for lo in reversed(range(0, length, SPAN)):
        piece = found.span(lo)
        k = piece.shape[2]
        for j in range(min(length, lo + SPAN), lo, -1):
            # all that begins at j is done; hand it on to where its edges begin
            back = b[:, w + j][:, None] + lattice.weight[piece[:, j - lo - 1]]
            share = np.exp(a[:, w + j - k : w + j][:, ::-1] + back - total[:, None])
            uses += np.bincount(piece[:, j - lo - 1].ravel(), share.ravel(), len(uses))
            if spelling[j - 1]:
                byte = b[:, w + j] + alone[:, j - 1]
                uses[lattice.size] += (np.exp(a[:, w + j - 1] + byte - total) * byte_count(codes[:, j - 1])).sum()
                b[:, w + j - 1] = np.logaddexp(b[:, w + j - 1], byte)
            b[:, w + j - k : w + j] = np.logaddexp(b[:, w + j - k : w + j], back[:, ::-1])
    return total, uses[:-1]


def batches_of(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, code points, lengths) of batches of words of like length, a space before each; about CELLS cells, or one word, at a time."""
    size = np.array([len(x) + 1 for x in words])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * size[order[to]] <= CELLS:
            to += 1
        some = order[at:to]
        codes = np.zeros((len(some), int(size[some].max())), np.int64)
        for row, i in enumerate(some):
            text = np.frombuffer(words[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            codes[row, 1 : len(text) + 1] = text
        codes[:, 0] = 0x20
        yield some, codes, size[some]
        at = to


def marginals(lattice: Lattice, words: list[str]) -> np.ndarray:
    """Log marginal probability of each word."""
    out = np.zeros(len(words))
    for some, codes, size in batches_of(words):
        out[some] = forward(lattice, codes, size)[np.arange(len(some)), lattice.width + size]
    return out


def split(batch: pa.RecordBatch) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of the texts of a slice, dictionary-encoded, and the number of the text of each."""
    raw, offsets = utf8(batch.column("text"))
    raw = LOWER[raw]
    solid = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    if len(raw):
        first[1:] &= ~solid[:-1] | edge[1:-1]
    start = np.flatnonzero(first)
    text = np.searchsorted(offsets, start, "right") - 1
    kept = np.cumsum(solid)
    at = np.append(kept[start] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(raw[solid]))
    return words.dictionary_encode(), text


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): count in rows with ``train``; every word of any row is there, and '' is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            train = pc.fill_null(batch.column("train"), False).to_numpy(zero_copy_only=False)
            words, text = split(batch)
            c = np.bincount(words.indices.to_numpy()[train[text]], minlength=len(words.dictionary))
            names = pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([""], pa.string())])
            yield pa.RecordBatch.from_arrays([names, pa.array(np.append(c, train.sum()).astype(np.int64))], names=["word", "c"])

    return mapped(docs.select("train", "text"), run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, lattice: Lattice, prior: np.ndarray, rounds: int = ROUNDS) -> Lattice:
    """The lattice with weights from expected counts over all training words, each once, and one use in all for each piece spread as ``prior``."""
    sc = words.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(lattice)  # as large as the vocabulary

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            uses = np.zeros(shared.value.size + 1)
            for batch in slices(batches, "word"):
                for _, codes, size in batches_of(batch.column("word").to_pylist()):
                    uses += expected(shared.value, codes, size)[1]
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(uses[some])], names=["piece", "uses"])

        got = mapped(words.where("c > 0 and word <> ''").select("word"), run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        mass = prior * len(prior)
        for piece, uses in got:  # a row for each piece of the vocabulary
            mass[piece] += uses
        lattice = lattice.weighed(mass)
    return lattice


def priced(words: DataFrame, lattice: Lattice) -> tuple[DataFrame, int]:
    """(word, c, lattice, base, model) with the log10 price of every word and of the end, as a written table; and N."""
    shared = words.sparkSession.sparkContext.broadcast(lattice)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word"):
            names = batch.column("word").to_pylist()
            log = marginals(shared.value, names)
            log = np.where(np.array([x == "" for x in names]), math.log(END), log + math.log(1 - END))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(log)], names=["word", "c", "log"])

    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    base = F.log10((F.col("c") + 0.5) / (total + 0.5 * (distinct + 1)))
    back = F.lit(float(distinct + 1))
    model = F.when(F.col("c") > 0, F.log10(F.col("c") + back * F.exp("log"))).otherwise(F.log10(back) + F.col("log") / math.log(10)) - math.log10(total + distinct + 1)
    out = mapped(words, run, "word string, c long, log double").select("word", "c", (F.col("log") / math.log(10)).alias("lattice"), base.alias("base"), model.alias("model"))
    return stored(out, "words"), total


def score(docs: DataFrame, is_training: Column, model: str, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, trained (whether it was learned from), n_tokens, n_known (tokens that the training rows hold), train_tokens, base_score, lattice_score, score."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(is_training, F.lit(False)).alias("train"))
    words = stored(count_words(rows), "counts")
    lattice, prior = load(model)
    prices, total = priced(words, fit(words, lattice, prior, rounds))

    # words that are 1 / HOT of the training tokens or more, and the end: bounded in number and length
    common = prices.where((F.col("word") == "") | ((F.col("c") * HOT >= total) & (F.col("c") > 0) & (F.octet_length("word") <= HOT_BYTES))).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast({c: common.column(c).combine_chunks() if c == "word" else common.column(c).to_numpy() for c in common.column_names})
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        names = hot["word"].cast(pa.large_string())
        if not len(names):
            return
        end = pc.index_in(pa.scalar("", pa.large_string()), names).as_py()
        per = np.stack([np.ones(len(names)), hot["c"] > 0, hot["base"], hot["lattice"], hot["model"]], axis=1).astype(float)
        for batch in slices(batches, limit=SLICE):
            words, text = split(batch)
            n, kinds = batch.num_rows, max(1, len(words.dictionary))
            pairs, c = np.unique(text * kinds + words.indices.to_numpy(), return_counts=True)
            text, code = np.divmod(pairs, kinds)
            at = pc.fill_null(pc.index_in(words.dictionary, names), -1).to_numpy()[code] if len(pairs) else code
            is_hot = at >= 0
            sums = np.tile(per[end], (n, 1))
            for j in range(per.shape[1]):
                sums[:, j] += np.bincount(text[is_hot], c[is_hot] * per[at[is_hot], j], n)
            ids, key, train = batch.column("doc_id"), batch.column("key").to_numpy(), batch.column("train")
            nothing = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(key), ids, train, nothing, *(pa.array(sums[:, j].astype(np.int64)) for j in (0, 1)), *(pa.array(sums[:, j]) for j in (2, 3, 4))], names=NAMES)
            rare = np.flatnonzero(~is_hot)
            for lo in range(0, len(rare), 1 << 16):
                some = rare[lo : lo + (1 << 16)]
                m = len(some)
                zeros = pa.array(np.zeros(m))
                yield pa.RecordBatch.from_arrays([pa.array(key[text[some]]), pa.nulls(m, kind), pa.nulls(m, pa.bool_()), words.dictionary.take(pa.array(code[some])).cast(pa.string()), pa.array(c[some].astype(np.int64)), pa.nulls(m, pa.int64()), zeros, zeros, zeros], names=NAMES)

    schema = f"key long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, train boolean, word string, n long, known long, base double, lattice double, model double"
    parts = stored(mapped(rows.withColumn("key", F.monotonically_increasing_id()), run, schema), "tokens")
    rare = parts.where("word is not null").select("key", "n", "word").join(prices.where("word <> ''"), "word")
    n = F.col("n")
    joined = rare.select("key", F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("boolean").alias("train"), "n", F.when(F.col("c") > 0, n).otherwise(0).alias("known"), *((n * F.col(x)).alias(x) for x in ("base", "lattice", "model")))
    per = parts.where("word is null").drop("word").unionByName(joined).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("trained"), *(F.sum(x).alias(x) for x in ("n", "known", "base", "lattice", "model")))
    return per.select("doc_id", "trained", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lattice").alias("lattice_score"), F.col("model").alias("score"))


NAMES = ["key", "doc_id", "train", "word", "n", "known", "base", "lattice", "model"]

"""SentencePiece encoding and decoding by suffix-array matching, for models of the BPE kind.

No piece of such a model holds a space after another character, so a text (a space in front, spaces as U+2581)
falls into segments of leading spaces and what follows them, which are encoded apart. For each slice of a batch:

1. the distinct segments are concatenated, and the suffixes are sorted by as many characters as the longest
   piece has, by prefix doubling;
2. every piece is binary-searched for the range of suffixes that begin with it; each suffix in the range is an
   edge (position, piece);
3. the edges are bucketed by end position, and relaxed from left to right, all segments at once: at each
   position the edge is taken whose piece and the piece before it are what merging leaves side by side.

The last step makes it exact for BPE. Merging, best score first and leftmost among equals, leaves the pieces a and b beside
one another unless at some moment the symbols at their border would have merged before a and b were complete;
``compatible`` undoes the merges of a and b from the last to the first and looks for such a moment. For every prefix
of a segment exactly one edge fits, so the relaxation needs no choice.

Characters that no piece has become byte pieces. Null text: null ids and null decoded text; empty text: no ids. Rows
keep their multiplicity and stand alone, so skew does not arise. U+2581 in a text decodes as a space, as in the library.
A text of any length is taken whole; one without spaces is a single segment, relaxed one position at a time. Equal texts get equal ids; an empty table
gives no rows. Columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import mapped
from ._text import slices

SLICE, POINTS = 3 << 19, 300_000
SEGMENT = re.compile(" +[^ ]*")
CACHE_BITS = 21
NONE = -1


@dataclass
class Vocabulary:
    """What the encoder needs of a model, as arrays. Pieces hold a space for U+2581; piece ``size`` stands for any unknown character."""

    pieces: list[str]  # of BPE pieces; '' for others
    score: np.ndarray
    raw: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray
    usable: np.ndarray  # ids that merging can yield
    left: np.ndarray  # the last merge of each piece, NONE for characters
    right: np.ndarray
    pair_keys: np.ndarray  # sorted left * (size + 1) + right
    pair_ids: np.ndarray
    symbols: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))  # by code point
    width: int = 16
    # filled on first use, by each worker
    cache: tuple[np.ndarray, np.ndarray] | None = None
    keys: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def size(self) -> int:
        return len(self.pieces)

    def merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) * (self.size + 1) + y
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NONE)


def merges(text: str, ids: dict[str, int], score: np.ndarray) -> list[tuple[str, str, str]]:
    """The merges of BPE on a short text, as (left, right, result), and as the last entry ('', '', rest joined) if not one piece is left."""
    parts, done = list(text), []
    while len(parts) > 1:
        best = max(((score[ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
        if best is None:
            return [*done, ("", "", text)]
        i = -best[1]
        done.append((parts[i], parts[i + 1], parts[i] + parts[i + 1]))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return done


def load(path: str) -> Vocabulary:
    """Reads a model file with the library; pieces, scores and kinds only."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids, pieces, raw = np.full(256, NONE), [], []
    for i in range(n):
        name = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            raw.append(bytes([int(name[1:-1], 16)]))
        else:
            raw.append(b"" if special else name.replace("▁", " ").encode())
        pieces.append("" if special or model.is_byte(i) else name.replace("▁", " "))
    if any(" " in p.lstrip(" ") for p in pieces):
        raise ValueError("a piece holds a space after another character: segments would not be independent")
    return prepared(pieces, np.array([model.get_score(i) for i in range(n)]), raw, byte_ids)


def prepared(pieces: list[str], score: np.ndarray, raw: list[bytes], byte_ids: np.ndarray) -> Vocabulary:
    n = len(pieces)
    ids = {p: i for i, p in enumerate(pieces) if p}
    left, right, usable = np.full(n + 1, NONE), np.full(n + 1, NONE), np.zeros(n, bool)
    pairs: dict[int, int] = {}
    for p, i in ids.items():
        for cut in range(1, len(p)):
            if p[:cut] in ids and p[cut:] in ids:
                pairs[ids[p[:cut]] * (n + 1) + ids[p[cut:]]] = i
        if len(p) == 1:
            usable[i] = True
        elif (steps := merges(p, ids, score)) and steps[-1][2] == p and steps[-1][0]:
            usable[i] = True
            left[i], right[i] = ids[steps[-1][0]], ids[steps[-1][1]]
    keys = np.array(sorted(pairs), np.int64)
    out = Vocabulary(pieces, np.append(score, 0.0), raw, byte_ids, np.flatnonzero(usable), left, right, keys, np.array([pairs[int(k)] for k in keys], np.int64))
    alphabet = sorted({c for p in ids for c in p})
    out.symbols = np.full(0x110000, len(alphabet) + 1, np.uint16)
    out.symbols[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    out.width = max(4, 1 << (max(map(len, ids), default=1) - 1).bit_length())
    return out


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves a and b side by side."""
    ok = np.ones(len(a), bool)
    at, x, y = np.arange(len(a)), a.copy(), b.copy()
    limit, ties = np.full(len(a), -np.inf), np.ones(len(a), bool)
    while len(at):
        c = v.merged(x, y)
        s = v.score[c]
        crossed = (c != NONE) & ((s > limit) | ((s == limit) & ties))
        ok[at[crossed]] = False
        go = ~crossed & ((v.left[x] != NONE) | (v.left[y] != NONE))
        at, x, y = at[go], x[go], y[go]
        sx = np.where(v.left[x] != NONE, v.score[x], np.inf)
        sy = np.where(v.left[y] != NONE, v.score[y], np.inf)
        undo = sx < sy  # the later merge goes first; among equals the right one is later
        limit, ties = np.where(undo, sx, sy), ~undo
        x, y = np.where(undo, v.right[x], x), np.where(undo, y, v.left[y])
    return ok


def fits(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``compatible`` through a direct-mapped cache of pairs."""
    if v.cache is None:
        v.cache = (np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, bool))
    keys, values = v.cache
    key = a * (v.size + 1) + b
    slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
    out, miss = values[slot], np.flatnonzero(keys[slot] != key)
    if len(miss):
        _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
        some = miss[first]
        got = compatible(v, a[some], b[some])
        out[miss] = got[back]
        keys[slot[some]], values[slot[some]] = key[some], got  # where two share a slot, the last one wins in both
    return out


def suffixes(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions sorted by their first ``width`` symbols, the keys of 4 symbols at 0, 4, .. of each position)."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(width + 4, np.uint16)]).astype(np.uint64)
    four = padded[: n + width] << np.uint64(48)
    for k in (1, 2, 3):
        four = four | padded[k : n + width + k] << np.uint64(16 * (3 - k))
    order = np.argsort(four[:n])
    got = 4
    rank = np.empty(n + width, np.uint64)
    while True:
        if got == 4:
            key = four[:n]
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]).astype(np.uint64) + np.uint64(1)
        rank[n:] = 0
        if got >= width:
            return order, four
        key = rank[:n] << np.uint64(32) | rank[got : n + got]
        order = np.argsort(key)
        got *= 2


def piece_keys(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, lower keys, upper keys) of the usable pieces: their symbols, then the least and the greatest."""
    words = [v.pieces[i] for i in v.usable]
    length = np.array([len(w) for w in words])
    low = np.zeros((len(words), v.width), np.uint64)
    for i, w in enumerate(words):
        low[i, : len(w)] = v.symbols[[ord(c) for c in w]]
    high = np.where(np.arange(v.width) < length[:, None], low, np.uint64(0xFFFF))

    def packed(x: np.ndarray) -> np.ndarray:
        return x[:, 0::4] << np.uint64(48) | x[:, 1::4] << np.uint64(32) | x[:, 2::4] << np.uint64(16) | x[:, 3::4]

    return length, packed(low), packed(high)


def bound(order: np.ndarray, four: np.ndarray, keys: np.ndarray, after: bool) -> np.ndarray:
    """For each key, how many suffixes sort before it, or with ``after`` before or like it."""
    lo, hi = np.zeros(len(keys), np.int64), np.full(len(keys), len(order))
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        at, key = order[mid], keys[open_]
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k in range(keys.shape[1]):
            word = four[at + 4 * k]
            less |= same & (word < key[:, k])
            same &= word == key[:, k]
        less |= same & after
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)


def encode_segments(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all segments in a row, first id of each segment and one more)."""
    points = np.frombuffer("\0".join(segments).encode("utf-32-le") + b"\0\0\0\0", np.uint32)
    length = np.array([len(s) for s in segments])
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    symbols = v.symbols[points]
    symbols[start + length] = 0  # a separator is no symbol of a piece
    order, four = suffixes(symbols, v.width)
    if v.keys is None:
        v.keys = piece_keys(v)
    size, low, high = v.keys
    lo, hi = bound(order, four, low, False), bound(order, four, high, True)
    found = np.flatnonzero(hi > lo)
    n = hi[found] - lo[found]
    place = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    edges = np.full((len(points) + 1, v.width + 1), NONE, np.int32)
    span = np.repeat(size[found], n)
    edges[order[place] + span, span] = np.repeat(v.usable[found], n)
    unknown = np.flatnonzero((symbols != 0) & (edges[1:, 1] == NONE))
    edges[unknown + 1, 1] = v.size

    last, taken = np.full(len(points) + 1, NONE, np.int64), np.zeros(len(points) + 1, np.int64)
    by_length = np.argsort(-length, kind="stable")
    begin, sorted_length = start[by_length], length[by_length]
    for e in range(1, int(length.max(initial=0)) + 1):
        open_ = begin[: np.searchsorted(-sorted_length, -e, "right")] + e
        for k in range(min(e, v.width), 0, -1):
            piece = edges[open_, k]
            some = np.flatnonzero(piece != NONE)
            if not len(some):
                continue
            end, b = open_[some], piece[some].astype(np.int64)
            good = np.ones(len(some), bool) if k == e else fits(v, last[end - k], b)
            last[end[good]], taken[end[good]] = b[good], k
            left = np.ones(len(open_), bool)
            left[some[good]] = False
            open_ = open_[left]
            if not len(open_):
                break
    cut = np.zeros(len(points) + 1, bool)
    at = (start + length)[length > 0]
    floor = start[length > 0]
    while len(at):
        cut[at] = True
        at = at - taken[at]
        more = at > floor
        at, floor = at[more], floor[more]
    ends = np.flatnonzero(cut)
    ids, first = last[ends], np.searchsorted(ends, start, "right")
    first = np.append(first, len(ids))
    if (ids == v.size).any():  # bytes of unknown characters
        out, counts = [], np.ones(len(ids), np.int64)
        for i in np.flatnonzero(ids == v.size):
            raw = chr(points[ends[i] - 1]).encode()
            counts[i] = len(raw)
            out.append(v.byte_ids[list(raw)])
        wide = np.repeat(ids, counts)
        wide[np.repeat(ids == v.size, counts)] = np.concatenate(out)
        ids, first = wide, np.concatenate([[0], np.cumsum(counts)])[first]
    return ids, first


def encode_in_turn(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``encode_segments`` for groups of about POINTS characters, so that the index stays small."""
    group = np.cumsum([len(s) + 1 for s in segments]) // POINTS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(segments)]
    parts = [encode_segments(v, segments[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    base = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([*(first[:-1] + at for (_, first), at in zip(parts, base)), base[-1:]])


def encode_texts(v: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, first id of each text and one more)."""
    known: dict[str, int] = {}
    uses: list[int] = []
    counts = []
    for text in texts:
        before = len(uses)
        if text:
            uses += [known.setdefault(s, len(known)) for s in SEGMENT.findall(" " + text.replace("▁", " "))]
        counts.append(len(uses) - before)
    if not uses:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ids, first = encode_in_turn(v, list(known))
    use = np.array(uses)
    n = first[use + 1] - first[use]
    total = np.concatenate([[0], np.cumsum(n)])
    flat = ids[np.repeat(first[use] - total[:-1], n) + np.arange(total[-1])]
    return flat, total[np.concatenate([[0], np.cumsum(counts)])]


def decode_ids(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
    if v.table is None:
        size = np.array([len(r) for r in v.raw])
        v.table = (np.frombuffer(b"".join(v.raw), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    table, begin, size = v.table
    n = size[ids]
    total = np.concatenate([[0], np.cumsum(n)])
    raw = table[np.repeat(begin[ids] - total[:-1], n) + np.arange(total[-1])].tobytes()
    out = []
    for a, b in zip(total[first[:-1]].tolist(), total[first[1:]].tolist()):
        text = raw[a:b].decode("utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return out


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, ids, decoded (the text got back from the ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for part in slices(batches, limit=SLICE):
            texts = part.column("text").to_pylist()
            ids, first = encode_texts(v, texts)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            decoded = decode_ids(v, ids, first)
            null = pa.array([t is None for t in texts])
            lists = pa.array([None if t is None else x for t, x in zip(texts, lists.to_pylist())], pa.list_(pa.int32())) if part.column("text").null_count else lists
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([None if z else t for z, t in zip(null.to_pylist(), decoded)], pa.string())], names=["doc_id", "ids", "decoded"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text again)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for part in slices(batches, limit=SLICE):
            texts = part.column("text").to_pylist()
            ids, first = encode_texts(v, texts)
            raw = ids.astype("<i4")
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            same = [a == (b or "").replace("▁", " ") for a, b in zip(decode_ids(v, ids, first), texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(sha), pa.array(same)], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, round_trip boolean")

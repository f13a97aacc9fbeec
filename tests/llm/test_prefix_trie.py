"""The trie against one built by plain dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from seriatim.llm import prefix_trie
from seriatim.llm.queries import op12_prefix_trie

TURN = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - int(c - 20 * int(c / 20)), [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}
    out = []
    for n in members:
        below = [m for m in members if m[: len(n)] == n]
        saved = sum((len(members[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in below if m)
        out.append((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), sum(not children[m] for m in below), saved, hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng, n=160):
    rows = []
    for c in range(-45, n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t else "system", rng.choice(["hi", "how are  you", "a b\tc", "", None, "long " * 30])))
    rows += [(c, t, "user", f"shared {t}") for c in range(1000, 1300) for t in range(4)]  # a group of copies, cut by their ids
    rows += [(2000, None, None, "null turn"), (2000, None, "a", "null turn"), (2000, 1, "a", "x"), (None, 0, "user", "no id"), (2001, 0, "user", "x"), (2001, 1, "a", "y")]
    rows += [(c, t, "user", "deep") for c in (3000, 3001) for t in range(150)]  # far deeper than a splitter may be
    return rows


@pytest.mark.parametrize("shards", [None, 1, 40])
def test_trie_is_the_plain_one(spark, shards, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    rows = table(random.Random(3))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN + ", path string, node int").repartition(5)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(df)), shards)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(rows)


def test_query_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLUMNS) for r in op12_prefix_trie(spark, sf).collect()), key=str) == plain(rows)


def shard_rows(paths, skeleton):
    scan = prefix_trie.Scan(frozenset(skeleton))
    for path, conv in sorted(paths):
        scan.take(path, conv, [1] * (len(path) // prefix_trie.WIDTH))
    while scan.stack:
        scan.close()
    return scan.rows


def test_children_beyond_the_bound_wait_for_a_join(monkeypatch):
    key = lambda *x: b"".join(bytes([i]) * prefix_trie.WIDTH for i in x)
    paths = [(key(1, i), i) for i in range(20)] + [(key(2), 99)]
    whole = shard_rows(paths, [b""])
    monkeypatch.setattr(prefix_trie, "WAITING", 3)
    cut = shard_rows(paths, [b""])
    parent = {r[9]: r[1] for r in cut if r[0] == 3}
    joined = [(r[1], r[2], parent[r[9]], *r[4:9]) for r in cut if r[0] == 1 and r[9]]
    assert sorted(r[1:9] for r in whole if r[0] == 0) == sorted([*joined, *(r[1:9] for r in cut if r[0] == 0)]) and len(joined) > 10


def test_tables_without_conversations_or_turns(spark):
    empty = spark.createDataFrame([], TURN)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(empty))).count() == 0
    # conversation 1 loses its only turn to the missing conversation 0
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    (row,) = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(spark.createDataFrame([(c, 0, "user", "x")], TURN)))).collect()
    assert (row["conv_id"], row["depth"], row["parent_conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"]) == (c, 0, None, 1, 0, 1, 0)

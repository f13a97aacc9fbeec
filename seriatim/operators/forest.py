"""Random forests for many keys at once: one pass over all rows for each level of all trees of all keys.

Features are cut into BINS bins of equal width between their least and greatest training value. A level's pass adds up, task by task, the weights of both classes by
(key, tree, node, candidate feature, bin); Spark sums them, finds the cut of least Gini impurity of each node, and only the cuts, which are the model, come to the driver.
Rows are drawn by Poisson weights, candidate features by a hash: both depend on ids and the seed, not on how rows are dealt, so a fit can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

BINS, ROWS = 32, 8192
#: Distribution of a Poisson weight of mean 1.
POISSON = np.cumsum([0.36787944, 0.36787944, 0.18393972, 0.06131324, 0.01532831, 0.00306566, 0.00051094])


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Forest:
    """The cuts of the trees of one key; a node's children are 2 * node + 1 and + 2."""

    number: int
    features: int
    feature: np.ndarray  # [tree, node]; -1: a leaf
    cut: np.ndarray
    leaf: np.ndarray  # [tree, node]: share of class 1

    @staticmethod
    def bare(number: int, features: int, trees: int, depth: int) -> Forest:
        nodes = 2 ** (depth + 1) - 1
        return Forest(number, features, np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes), np.int16), np.full((trees, nodes), np.nan, np.float32))

    @property
    def slots(self) -> int:
        return max(1, int(np.sqrt(self.features)))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """[row, tree]: the node of each row after at most ``levels`` steps."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(bins), len(trees)), np.int64)
        for _ in range(levels):
            feature = self.feature[trees, node]
            right = np.take_along_axis(bins, np.maximum(feature, 0), axis=1) > self.cut[trees, node]
            node = np.where(feature < 0, node, 2 * node + 1 + right)
        return node

    def candidates(self, tree: np.ndarray, node: np.ndarray, seed: int) -> np.ndarray:
        """[entry, slot]: the features that a node may be cut by."""
        with np.errstate(over="ignore"):
            key = ((np.uint64(seed * 7919 + self.number) * np.uint64(1 << 20) + tree.astype(np.uint64)) * np.uint64(1 << 20) + node.astype(np.uint64))[:, None] * np.uint64(1 << 10) + np.arange(self.slots, dtype=np.uint64)
        return (scrambled(key) % np.uint64(self.features)).astype(np.int64)


def weights(ids: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """[row, tree]: how often a row is drawn."""
    with np.errstate(over="ignore"):
        h = scrambled(scrambled(ids.astype(np.uint64) + np.uint64(seed))[:, None] + np.arange(trees, dtype=np.uint64))
    return np.searchsorted(POISSON, h / 2.0**64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, ids, labels, bins) of up to ROWS rows of one key, gathered over batches: the more rows a part has, the fewer sums it leaves."""
    held: dict[str, list[tuple[np.ndarray, ...]]] = {}
    for batch in batches:
        keys = batch.column("key").dictionary_encode()
        for i, key in enumerate(keys.dictionary.to_pylist()):
            some = np.flatnonzero(keys.indices.to_numpy() == i)
            for lo in range(0, len(some), ROWS):
                taken = batch.take(pa.array(some[lo : lo + ROWS]))
                bins = np.stack([np.frombuffer(x, np.uint8) for x in taken.column("bins").to_pylist()])
                own = held.setdefault(key, [])
                if own and sum(len(x[0]) for x in own) + len(bins) > ROWS:
                    yield key, *(np.concatenate(x) for x in zip(*own))
                    own.clear()
                own.append((taken.column("id").to_numpy(), taken.column("label").to_numpy(), bins))
    for key, own in held.items():
        if own:
            yield key, *(np.concatenate(x) for x in zip(*own))


def binned(rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(key, id, label, test, bins) as a written table, and the number of features of each key. Unknown cells fall into the first bin."""
    cells = rows.where("not test").select("key", F.posexplode("v").alias("f", "x"))
    spans: dict[str, dict[int, tuple]] = {}
    for key, f, lo, hi in cells.groupBy("key", "f").agg(F.min("x"), F.max("x")).collect():  # a row for each feature
        spans.setdefault(key, {})[f] = (lo or 0.0, hi or 0.0)
    limits = {key: np.array([x.get(f, (0.0, 0.0)) for f in range(max(x) + 1)]) for key, x in spans.items()}
    shared = rows.sparkSession.sparkContext.broadcast(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, v in zip(batch.column("key").to_pylist(), batch.column("v")):
                lo, hi = shared.value[key].T
                x = np.nan_to_num(v.values.to_numpy(zero_copy_only=False).astype(float)[: len(lo)], nan=-np.inf)
                x = np.append(x, np.full(len(lo) - len(x), -np.inf))
                with np.errstate(divide="ignore", invalid="ignore"):
                    place = np.where(hi > lo, (x - lo) * (BINS / np.where(hi > lo, hi - lo, 1)), 0)
                out.append(np.clip(place, 0, BINS - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id", "label", "test")), pa.array(out, pa.binary())], names=["key", "id", "label", "test", "bins"])

    known = rows.where(F.col("key").isin(*limits)) if limits else rows.limit(0)
    return written(known.select("key", "id", "label", "test", "v").mapInArrow(run, "key string, id long, label int, test boolean, bins binary"), "binned"), {k: len(x) for k, x in limits.items()}


def level_cuts(train: DataFrame, forests: dict[str, Forest], level: int, seed: int) -> list:
    """(key, tree, node, feature, bin) of the best cut of each node of a level that has one."""
    shared = train.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, labels, bins in parts(batches):
            forest = shared.value[key]
            drawn, node = weights(ids, len(forest.feature), seed), forest.places(bins, level) - (2**level - 1)
            for tree in range(len(forest.feature)):
                row = np.flatnonzero((drawn[:, tree] > 0) & (node[:, tree] >= 0))
                if not len(row):
                    continue
                at, place = np.unique(node[row, tree], return_inverse=True)
                feature = forest.candidates(np.full(len(at), tree), at + 2**level - 1, seed)
                shape = (len(at), forest.slots, BINS, 2)
                cell = ((place[:, None] * forest.slots + np.arange(forest.slots)) * BINS + bins[row[:, None], feature[place]]) * 2 + labels[row][:, None]
                sums = np.bincount(cell.ravel(), np.repeat(drawn[row, tree], forest.slots), np.prod(shape)).reshape(shape)
                where, slot, bin_ = np.nonzero(sums.any(axis=3))
                kinds = [np.full(len(where), tree), at[where] + 2**level - 1, slot, feature[where, slot], bin_]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(where), pa.string()), *(pa.array(x.astype(np.int32)) for x in kinds), *(pa.array(sums[where, slot, bin_, c]) for c in (0, 1))],
                    names=["key", "tree", "node", "slot", "feature", "bin", "n0", "n1"],
                )

    sums = train.mapInArrow(run, "key string, tree int, node int, slot int, feature int, bin int, n0 double, n1 double").groupBy("key", "tree", "node", "slot", "feature", "bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    whole = Window.partitionBy("key", "tree", "node", "slot")  # BINS rows
    sums = sums.withColumns({f"l{c}": F.sum(f"n{c}").over(whole.orderBy("bin")) for c in (0, 1)} | {f"t{c}": F.sum(f"n{c}").over(whole) for c in (0, 1)})
    left, right = F.col("l0") + F.col("l1"), F.col("t0") + F.col("t1") - F.col("l0") - F.col("l1")
    # twice the weighted impurity of a side is what its smaller class leaves: 2 * a * b / (a + b)
    impurity = F.col("l0") * F.col("l1") / left + F.try_divide((F.col("t0") - F.col("l0")) * (F.col("t1") - F.col("l1")), right)
    gain = F.col("t0") * F.col("t1") / (F.col("t0") + F.col("t1")) - impurity
    cuts = sums.where(right > 0).withColumn("gain", gain).where("gain > 1e-9").groupBy("key", "tree", "node").agg(F.max_by(F.struct("feature", "bin"), F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("best"))
    return cuts.select("key", "tree", "node", "best.feature", "best.bin").collect()


def leaves(train: DataFrame, forests: dict[str, Forest], depth: int, seed: int) -> None:
    """Fills in the shares of class 1."""
    shared = train.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, labels, bins in parts(batches):
            forest = shared.value[key]
            trees, nodes = forest.feature.shape
            drawn = weights(ids, trees, seed)
            cell = (np.arange(trees) * nodes + forest.places(bins, depth)).ravel()
            n, ones = (np.bincount(cell, (drawn * w).ravel(), trees * nodes) for w in (1, labels[:, None]))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(some), pa.string()), pa.array((some // nodes).astype(np.int32)), pa.array((some % nodes).astype(np.int32)), pa.array(n[some]), pa.array(ones[some])], names=["key", "tree", "node", "n", "ones"])

    sums = train.mapInArrow(run, "key string, tree int, node int, n double, ones double").groupBy("key", "tree", "node").agg((F.sum("ones") / F.sum("n")).alias("share"))
    for key, tree, node, share in sums.collect():  # the model
        forests[key].leaf[tree, node] = share


def fitted(rows: DataFrame, trees: int, depth: int, seed: int) -> tuple[DataFrame, dict[str, Forest]]:
    """Forests by key, and the binned rows. ``rows``: key, id (of a row, long), label (0 or 1), test (rows that are not learned from), v (features, as many for every row of a key)."""
    table, features = binned(rows)
    train = table.where("not test")
    forests = {key: Forest.bare(i, n, trees, depth) for i, (key, n) in enumerate(sorted(features.items()))}
    for level in range(depth):
        cuts = level_cuts(train, forests, level, seed) if forests else []
        for key, tree, node, feature, cut in cuts:
            forests[key].feature[tree, node], forests[key].cut[tree, node] = feature, cut
        if not cuts:
            break
    leaves(train, forests, depth, seed)
    return table, forests


def predicted(rows: DataFrame, trees: int = 50, depth: int = 10, seed: int = 42) -> DataFrame:
    """key, label, p (mean share of class 1 over the trees) of the test rows, by forests learned from the others. Keys without training rows have no rows."""
    table, forests = fitted(rows, trees, depth, seed)
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, labels, bins in parts(batches):
            forest = shared.value[key]
            share = forest.leaf[np.arange(len(forest.leaf)), forest.places(bins, depth)]
            known = ~np.isnan(share)  # a leaf that no drawn row reaches says nothing
            p = np.where(known, share, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(p), pa.string()), pa.array(labels), pa.array(p.astype(float))], names=["key", "label", "p"])

    return table.where("test").mapInArrow(run, "key string, label int, p double")

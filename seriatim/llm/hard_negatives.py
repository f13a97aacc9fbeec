"""Hard negatives for contrastive training, by exact search under segment summary bounds.

Each component x becomes floor(256 * x), x as double; a score is the integer inner product with an anchor. An anchor's positives are its ``positives`` best
other rows of its label, its negatives for a positive of score p the ``negatives`` best rows of other labels with low * p <= 100 * score <= high * p;
ties go to the smaller id.

A vector is cut into 1, 2, 4 and ``SEGMENTS`` segments. Of a segment its mean m and deviation d (root of the squared distances from m) are kept; two
segments of n components have a product within n * m * m' plus or minus d * d'. Levels refine one another, and only what the finest
leaves undecided is scored:

1. rows go to the nearest of at most ``PIVOTS`` pivots, and the rows of a pivot to groups of about ``GROUP``, by a hash, so that a vector of which there are
   many copies fills many groups. A group's summary is the range of its rows' means and their largest deviation by segment;
2. each anchor is searched in its own group first; its last score there is a bound that holds everywhere;
3. an anchor is sent to the groups whose summaries can pass its bound, and to no others. Groups stay where they are: what is shuffled are anchors,
   and each group once. In a group candidates are dropped level by level;
4. the positives found give windows of scores, and the anchors go to the groups whose summaries can fall into one.

Group summaries are broadcast: ``GROUPS`` of some 200 bytes at most, since groups grow beyond that. Pivots are a sample that shapes groups, never a result.

Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors meet only vectors of their own dimension. Rows that repeat an id are
rows each, but not partners of anchors with that id; anchor rows that repeat are mined each. Fewer positives or negatives: all; none: no row. Scores beyond 64 bits
are clipped to the end of the range; integers beyond 2**53 are added as Python's. An empty table, or one without anchors, gives no rows. Ids and labels are cast to 64-bit integers. Columns
other than these three are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import mapped, stored

GROUP, GROUPS, PIVOTS, AT_ONCE, BLOCK = 4096, 1 << 16, 1024, 32, 512
SEGMENTS = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1
KEY = ["d", "cluster", "sub"]
KEYS = "d int, cluster int, sub int"


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, means, deviations) of ``segments`` segments of each row."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    size = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    return size, mean, np.sqrt(np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, cuts[:-1], axis=1))


def levels(d: int) -> list[int]:
    return [s for s in (1, 2, 4, SEGMENTS) if s <= d]


@dataclass
class Rows:
    """Vectors of one dimension."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(cell: pa.Array) -> Rows:
        """From one list of (row, id, label, q) structs."""
        flat = cell.flatten()
        n = len(flat)
        q = flat.field(3).flatten().to_numpy(zero_copy_only=False).astype(float)
        return Rows(*(flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)), q.reshape(n, -1) if n else np.zeros((0, 0)))

    def at(self, some: np.ndarray) -> Rows:
        return Rows(self.row[some], self.id[some], self.label[some], self.x[some])


def exact(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, a.shape[1]) < 2.0**53:
        return (a @ x.T).astype(np.int64)
    left, right = ([[int(v) for v in row] for row in m] for m in (a, x))
    return np.array([[max(LEAST, min(MOST, sum(u * v for u, v in zip(p, q)))) for q in right] for p in left], np.int64).reshape(len(a), len(x))


def surviving(a: Rows, group: Rows, known: dict[int, tuple], alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, alive): candidates that bounds cannot keep out of every window [least, most] (anchor x window) of some anchor, refined level by level."""
    columns = np.arange(len(group.row))
    for s, (size, mean, deviation) in known.items():
        _, m, d = summaries(a.x, s)
        middle, spread = (m * size) @ mean[columns].T, d @ deviation[columns].T
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-3
        high, low = middle + spread + slack, middle - spread - slack
        can = np.zeros_like(alive)
        for w in range(least.shape[1]):
            can |= (high >= least[:, w, None].astype(float)) & (low <= most[:, w, None].astype(float))
        alive &= can
        keep = alive.any(axis=0)
        if keep.mean() < 0.9:
            columns, alive = columns[keep], alive[:, keep]
    return columns, alive


def searched(anchors: Rows, group: Rows, least: np.ndarray, most: np.ndarray, same: bool, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, window, candidate, score): the k best candidates of each anchor and window; of its own label, or of others."""
    known = {s: summaries(group.x, s) for s in levels(group.x.shape[1])}
    for at in range(0, len(anchors.row), AT_ONCE):
        some = np.arange(at, min(at + AT_ONCE, len(anchors.row)))
        a = anchors.at(some)
        alive = ((a.label[:, None] == group.label) == same) & (a.id[:, None] != group.id)
        columns, alive = surviving(a, group, known, alive, least[some], most[some])
        score = exact(a.x, group.x[columns])
        for i, j in enumerate(some):
            for w in range(least.shape[1]):
                fit = np.flatnonzero(alive[i] & (score[i] >= least[j, w]) & (score[i] <= most[j, w]))
                if len(fit) > k:
                    floor = np.partition(score[i, fit], len(fit) - k)[len(fit) - k]
                    fit = fit[score[i, fit] >= floor]
                for c in fit[np.lexsort((group.row[columns[fit]], group.id[columns[fit]], -score[i, fit]))][:k]:
                    yield j, w, columns[c], score[i, c]


def prepared(vectors: DataFrame, is_anchor: Column, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """(row, id, label, q, anchor, d) of the rows that take part, as a written table: a row keeps its number."""
    valid = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    valid = valid.where("id is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    q = F.transform("v", lambda x: x.cast("double") * 256)  # cut to integers where they are grouped: they may pass 64 bits
    return stored(valid.select(F.monotonically_increasing_id().alias("row"), "id", "label", q.alias("q"), "anchor", F.size("v").alias("d")), "vectors")


def grouped(rows: DataFrame) -> DataFrame:
    """A written row for each group: d, cluster, sub, x (row, id, label, q, anchor)."""
    spark = rows.sparkSession
    n = rows.count()
    size = max(GROUP, -(-n // GROUPS))
    wanted = min(PIVOTS, -(-max(n, 1) // size))
    pivots: dict[int, list] = {}
    for d, q in rows.orderBy(F.xxhash64("row"), "row").limit(wanted).select("d", "q").collect():
        pivots.setdefault(d, []).append(np.floor(q))
    shared = spark.sparkContext.broadcast({d: (m := np.array(x), (m * m).sum(axis=1)) for d, x in pivots.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, q = batch.column("d").to_numpy(), batch.column("q")
            flat = np.floor(q.flatten().to_numpy(zero_copy_only=False))
            cluster = np.zeros(len(d), np.int32)
            first = np.append(0, np.cumsum(d))
            for kind in np.unique(d):
                if kind in shared.value and kind:
                    m, square = shared.value[kind]
                    some = np.flatnonzero(d == kind)
                    x = flat[first[some][:, None] + np.arange(kind)]
                    cluster[some] = np.argmin(square - 2 * (x @ m.T), axis=1)
            floored = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "label")), floored, batch.column("anchor"), batch.column("d"), pa.array(cluster)], names=["row", "id", "label", "q", "anchor", "d", "cluster"])

    placed = stored(mapped(rows.select("row", "id", "label", "q", "anchor", "d"), run, "row long, id long, label long, q array<double>, anchor boolean, d int, cluster int"), "placed")
    subs = placed.groupBy("d", "cluster").agg(F.ceil(F.count(F.lit(1)) / size).alias("subs"))
    sub = F.pmod(F.xxhash64("row"), F.col("subs")).cast("int")
    return stored(placed.join(subs, ["d", "cluster"]).withColumn("sub", sub).groupBy(*KEY).agg(F.collect_list(F.struct("row", "id", "label", "q", "anchor")).alias("x")), "groups")


def own_search(groups: DataFrame, positives: int) -> DataFrame:
    """kind 0: the summary of each group (low, high, deviation); kind 1: each anchor with the bound that its own group gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", *KEY, "low", "high", "deviation", "row", "id", "label", "q", "bound"]
        types = [pa.int32()] * 4 + [pa.list_(pa.float64())] * 3 + [pa.int64()] * 3 + [pa.list_(pa.float64()), pa.int64()]
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column("x").slice(i, 1)
                group = Rows.of(cell)
                key = [batch.column(c)[i].as_py() for c in KEY]
                out = []
                if group.x.shape[1]:
                    _, mean, deviation = summaries(group.x, min(SEGMENTS, group.x.shape[1]))
                    out.append((0, *key, mean.min(axis=0), mean.max(axis=0), deviation.max(axis=0), None, None, None, None, None))
                else:
                    out.append((0, *key, [], [], [], None, None, None, None, None))
                chosen = np.flatnonzero(cell.flatten().field(4).to_numpy(zero_copy_only=False))
                for lo in range(0, len(chosen), BLOCK):
                    a = group.at(chosen[lo : lo + BLOCK])
                    open_ = np.full((len(a.row), 1), LEAST), np.full((len(a.row), 1), MOST)
                    found: dict[int, list] = {}
                    for j, _, _, score in searched(a, group, *open_, True, positives):
                        found.setdefault(j, []).append(score)
                    for j in range(len(a.row)):
                        full = found.get(j, [])
                        out.append((1, *key, None, None, None, a.row[j], a.id[j], a.label[j], a.x[j], full[-1] if len(full) == positives else LEAST))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return stored(mapped(groups, run, f"kind int, {KEYS}, low array<double>, high array<double>, deviation array<double>, row long, id long, label long, q array<double>, bound long"), "own")


def sent(anchors: DataFrame, own: DataFrame) -> DataFrame:
    """Every anchor (d, row, id, label, q, least, most) beside the key of each group that a window [least, most] can reach."""
    spark = anchors.sparkSession
    summary: dict[int, list] = {}
    for r in own.where("kind = 0").select(*KEY, "low", "high", "deviation").toLocalIterator():  # a row for each group, GROUPS at most
        summary.setdefault(r["d"], []).append((r["cluster"], r["sub"], np.array(r["low"]), np.array(r["high"]), np.array(r["deviation"])))
    shared = spark.sparkContext.broadcast({d: (np.array([x[:2] for x in rows], np.int32), *(np.stack([x[i] for x in rows]) for i in (2, 3, 4))) for d, rows in summary.items()})
    columns = ["d", "row", "id", "label", "q", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = batch.column("d")[i].as_py()
                key, low, high, deviation = shared.value[d]
                reach = np.ones(len(key), bool)
                if d:
                    size, mean, own_deviation = summaries(np.array([batch.column("q")[i].as_py()]), low.shape[1])
                    at = (mean * size)[0]
                    spread = deviation @ own_deviation[0]
                    top, bottom = np.maximum(low * at, high * at).sum(axis=1) + spread, np.minimum(low * at, high * at).sum(axis=1) - spread
                    slack = 1e-9 * (np.abs(low * at).sum(axis=1) + np.abs(high * at).sum(axis=1) + spread) + 1e-3
                    least, most = (np.array(batch.column(c)[i].as_py(), float) for c in ("least", "most"))
                    reach = (((top + slack)[:, None] >= least) & ((bottom - slack)[:, None] <= most)).any(axis=1)
                places = np.flatnonzero(reach)
                if len(places):
                    one = pa.array(np.full(len(places), i))
                    yield pa.RecordBatch.from_arrays([pa.array(key[places, 0]), pa.array(key[places, 1]), *(batch.column(c).take(one) for c in columns)], names=["cluster", "sub", *columns])

    return mapped(anchors.select(columns), run, "cluster int, sub int, d int, row long, id long, label long, q array<double>, least array<long>, most array<long>")


def found(anchors: DataFrame, own: DataFrame, groups: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, anchor_id, window, other_row, other_id, score): the k best in each window over all groups."""
    n = anchors.count()
    block = F.pmod(F.xxhash64("row"), F.lit(-(-max(n, 1) // BLOCK)))
    cells = sent(anchors, own).groupBy(*KEY, block.alias("block")).agg(F.collect_list(F.struct("row", "id", "label", "q", "least", "most")).alias("a"))
    names = ["row", "anchor_id", "window", "other_row", "other_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, cell = Rows.of(batch.column("x").slice(i, 1)), batch.column("a").slice(i, 1)
                a, flat = Rows.of(cell), cell.flatten()
                count = np.diff(flat.field(4).offsets.to_numpy())
                least, most = np.full((len(count), count.max(initial=1)), MOST), np.full((len(count), count.max(initial=1)), LEAST)
                inside = np.arange(least.shape[1]) < count[:, None]
                least[inside], most[inside] = (flat.field(f).flatten().to_numpy(zero_copy_only=False) for f in (4, 5))
                rows = [(a.row[j], a.id[j], w, group.row[c], group.id[c], score) for j, w, c, score in searched(a, group, least, most, same, k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    # never broadcast: anchors beside every group they reach are taken for as few as there are anchors, and would all go through the driver
    local = mapped(groups.select(*KEY, "x").join(cells.hint("merge"), KEY).select("x", "a"), run, ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "other_id", "other_row")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score."""
    groups = grouped(prepared(vectors, is_anchor, id_column, label_column, vector_column))
    own = own_search(groups, positives)
    anchors = own.where("kind = 1").select("d", "row", "id", "label", "q", F.array("bound").alias("least"), F.array(F.lit(MOST)).alias("most"))
    near = stored(found(anchors, own, groups, True, positives).select("row", F.col("rank").alias("place"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the windows of an anchor, in order of its positives
    score = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct("place", F.ceil(score * low / 100).cast("long").alias("least"), F.floor(score * high / 100).cast("long").alias("most"))
    windows = near.groupBy("row").agg(F.array_sort(F.collect_list(window)).alias("w"))
    wide = own.where("kind = 1").select("d", "row", "id", "label", "q").join(windows, "row").select("d", "row", "id", "label", "q", F.col("w").getField("least").alias("least"), F.col("w").getField("most").alias("most"))
    far = found(wide, own, groups, False, negatives).withColumn("place", F.col("window") + 1)
    return far.join(near, ["row", "place"]).select(F.col("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

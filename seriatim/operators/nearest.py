"""Exact nearest neighbours between two sets of series, and correlations within one, without broadcasting or gathering a side.

Nearest neighbours are pruned by pivots. At most ``PIVOTS`` rows of the searched side are pivots; a row goes to the block of its nearest pivot (about as many blocks as pivots, of ``BLOCK`` rows
at least and ``BLOCK_BYTES`` at most, by a hash where a pivot has more), and a block keeps the range of its rows' distances to every pivot. By the triangle inequality these ranges bound the distance
of any row to a block. Each row first searches the block with the least bound; its k-th distance there is what it carries on: it searches the blocks whose
bound is not above it, and no others. Rows that are to search few blocks (``COPIES`` each on the mean) are sent to them. Where little can be excluded, as among unrelated points of many dimensions, copies
would grow with the square of the rows: there groups of rows and blocks are written once, and each task reads some of both and compares them.

Searches of several keys are one search: a row meets blocks of its own key only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import mapped, written

BLOCK, BLOCKS, PIVOTS, AT_ONCE, COPIES = 2048, 1 << 14, 32, 4096, 4
#: Bytes of a block's vectors, and cells of a matrix of distances or correlations that a worker holds.
BLOCK_BYTES, CELLS = 16 << 20, 1 << 20


def unpacked(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    flat = column.flatten()
    ids = flat.field(0)
    return ids, flat.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y. They lose digits near 0, as sums of squares less products do."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def strips(x: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first row, rows) of pieces of x whose products with ``width`` rows have CELLS cells at most."""
    step = max(1, CELLS // max(width, 1))
    for lo in range(0, len(x), step):
        yield lo, x[lo : lo + step]


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def by_key(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each key of a batch."""
    keys = batch.column("key").dictionary_encode()
    for i, key in enumerate(keys.dictionary.to_pylist()):
        yield key, batch if len(keys.dictionary) == 1 else batch.take(pa.array(np.flatnonzero(keys.indices.to_numpy() == i)))


class Blocks:
    """The searched side: pivots of each key, a written table of blocks (key, pivot, sub, rows, x) and on the driver a range of distances for each."""

    def __init__(self, others: DataFrame, size: int | None = None):
        others = written(known(others), "searched")
        sizes, wanted = {}, {}
        for key, m, width in others.groupBy("key").agg(F.count(F.lit(1)), F.max(F.size("v"))).collect():
            # a row may be sent to every block, so their number must not grow with the rows
            least = size or max(BLOCK, min(-(-m // PIVOTS), BLOCK_BYTES // (8 * max(width or 1, 1))))
            sizes[key] = max(least, -(-m // BLOCKS))
            wanted[key] = min(PIVOTS, -(-m // sizes[key]))
        firsts = [others.where(F.col("key") == key).orderBy(F.xxhash64("series"), "series").limit(n).select("key", "v") for key, n in wanted.items()]
        chosen = reduce(DataFrame.unionByName, firsts).collect() if firsts else []  # PIVOTS rows for each key
        self.pivots = {key: np.array([r["v"] for r in chosen if r["key"] == key]) for key in wanted}
        pivots = others.sparkSession.sparkContext.broadcast(self.pivots)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, part in by_key(batch):
                    nearest_ = euclidean(matrix(part), pivots.value[key]).argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "series", "v")), pa.array(nearest_.astype(np.int32))], names=["key", "series", "v", "pivot"])

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                low, high = [], []
                for i in range(batch.num_rows):
                    d = euclidean(unpacked(batch.column("x").slice(i, 1))[1], pivots.value[batch.column("key")[i].as_py()])
                    low.append(d.min(axis=0))
                    high.append(d.max(axis=0))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "pivot", "sub", "rows", "x")), pa.array(low, pa.list_(pa.float64())), pa.array(high, pa.list_(pa.float64()))], names=["key", "pivot", "sub", "rows", "x", "low", "high"])

        self.kind = others.schema["series"].dataType.simpleString()
        placed = mapped(others, place, f"key string, series {self.kind}, v array<double>, pivot int")
        subs = F.lit(1)
        if any(n > 1 for n in wanted.values()):
            placed = written(placed, "placed")
            for key, numbers in self.subs(placed, sizes, wanted).items():
                subs = F.when(F.col("key") == key, F.element_at(F.array(*(F.lit(n) for n in numbers)), F.col("pivot") + 1)).otherwise(subs)
        dealt = placed.withColumn("sub", F.pmod(F.xxhash64("series"), subs).cast("int")).groupBy("key", "pivot", "sub").agg(F.count(F.lit(1)).cast("int").alias("rows"), F.collect_list(F.struct("series", "v")).alias("x"))
        self.table = written(mapped(dealt, bound, f"key string, pivot int, sub int, rows int, x array<struct<series:{self.kind},v:array<double>>>, low array<double>, high array<double>"), "blocks")
        self.ranges = self.table.select("key", "pivot", "sub", "low", "high").toArrow()  # of each key BLOCKS rows of 2 * PIVOTS numbers at most, and PIVOTS more

    @staticmethod
    def subs(placed: DataFrame, sizes: dict[str, int], wanted: dict[str, int]) -> dict[str, list[int]]:
        """The number of blocks of each pivot of a key, of which there are PIVOTS at most."""
        n = {(key, pivot): rows for key, pivot, rows in placed.groupBy("key", "pivot").count().collect()}
        return {key: [max(1, -(-n.get((key, p), 0) // size)) for p in range(wanted[key])] for key, size in sizes.items()}

    def spans(self) -> dict[str, tuple[np.ndarray, ...]]:
        """Of each key: pivot, sub, low and high of its blocks, and the pivots."""
        return {key: (own.column("pivot").to_numpy(), own.column("sub").to_numpy(), *(np.array(own.column(c).to_pylist()) for c in ("low", "high")), self.pivots[key]) for batch in self.ranges.combine_chunks().to_batches() for key, own in by_key(batch)}


def keyed(rows: DataFrame) -> DataFrame:
    """Rows that have no key get one in common."""
    return rows if "key" in rows.columns else rows.withColumn("key", F.lit(""))


def known(rows: DataFrame) -> DataFrame:
    return keyed(rows).select("key", "series", "v").where(F.forall("v", lambda x: x.isNotNull()))


def bounds(own: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[row, block]: what the distance of a row to any of a block is not below, by the row's distances to the pivots."""
    return np.stack([np.maximum(np.maximum(own - h, l - own), 0).max(axis=1) for l, h in zip(low, high)], axis=1)


def within(bound: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether a block of that bound may hold rows up to reach; distances lose digits near 0."""
    return bound <= reach * (1 + 1e-9) + 1e-6


def places(batch: pa.RecordBatch, spans: dict[str, tuple[np.ndarray, ...]], first: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows of a key, row, block) of what the rows search: first the block with the least bound, then all others up to reach."""
    for key, part in by_key(batch):
        if key not in spans:
            continue
        pivot, sub, low, high, pivots = spans[key]
        step = max(1, CELLS // len(low))
        for lo in range(0, part.num_rows, step):
            some = part.slice(lo, step)
            bound = bounds(euclidean(matrix(some), pivots), low, high)
            home = bound.argmin(axis=1)
            if first:
                yield some, np.arange(len(home)), home
            else:
                wanted = within(bound, some.column("reach").to_numpy()[:, None])
                if "home" in some.schema.names:  # bounds that differ by rounding must not choose another one
                    at = some.column("home").flatten()
                    wanted &= (pivot != at[0].to_numpy()[:, None]) | (sub != at[1].to_numpy()[:, None])
                else:
                    wanted[np.arange(len(home)), home] = False
                yield some, *np.nonzero(wanted)


def sent(rows: DataFrame, blocks: Blocks, first: bool) -> DataFrame:
    """Rows (key, series, v, and reach but for the first time) beside the blocks they search: the one with the least bound, or all others with a bound up to reach."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks.spans())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, block in places(batch, shared.value, first):
                pivot, sub = shared.value[part.column("key")[0].as_py()][:2]
                for lo in range(0, len(row), AT_ONCE):
                    at, to = pa.array(row[lo : lo + AT_ONCE]), block[lo : lo + AT_ONCE]
                    yield pa.RecordBatch.from_arrays([part.column("key").take(at), pa.array(pivot[to]), pa.array(sub[to]), part.column("series").take(at), part.column("v").take(at)], names=["key", "pivot", "sub", "series", "v"])

    return mapped(keyed(rows), run, f"key string, pivot int, sub int, series {blocks.kind}, v array<double>")


def copies(rows: DataFrame, blocks: Blocks) -> int:
    """The number of rows that ``sent`` would have but for the first time."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks.spans())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum(len(row) for batch in batches for _, row, _ in places(batch, shared.value, False))
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return mapped(rows, run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def least(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """The k least distances (all, if fewer) of each row of x to rows of y."""
    squares = (y * y).sum(axis=1)
    some = np.concatenate([np.argpartition(squares - 2 * (part @ y.T), min(k + 3, len(y)) - 1, axis=1)[:, : k + 3] for _, part in strips(x, len(y))])
    # the few best are measured again, without loss of digits
    return np.sort(np.stack([np.sqrt(((x - y[some[:, j]]) ** 2).sum(axis=1)) for j in range(some.shape[1])], axis=1), axis=1)[:, :k]


def searched(cells: DataFrame, blocks: Blocks, k: int, rows: int) -> DataFrame:
    """(key, series, distance, home) of the k nearest in each block, home, that a row was sent to."""
    part = F.pmod(F.xxhash64("series"), F.lit(-(-max(rows, 1) // AT_ONCE))).alias("part")
    packed = cells.groupBy("key", "pivot", "sub", part).agg(F.collect_list(F.struct("series", "v")).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x = unpacked(batch.column("a").slice(i, 1))
                d = least(x, unpacked(batch.column("x").slice(i, 1))[1], k)
                own = [batch.column(c).take(pa.array(np.full(d.size, i))) for c in ("key", "home")]
                yield pa.RecordBatch.from_arrays([own[0], ids.take(pa.array(np.repeat(np.arange(len(ids)), d.shape[1]))), pa.array(d.ravel()), own[1]], names=["key", "series", "distance", "home"])

    joined = blocks.table.select("key", "pivot", "sub", "x").join(packed, ["key", "pivot", "sub"]).select("key", F.struct("pivot", "sub").alias("home"), "x", "a")
    return mapped(joined, run, f"key string, series {blocks.kind}, distance double, home struct<pivot:int,sub:int>")


def compared(rows: DataFrame, blocks: Blocks, k: int, n: int) -> DataFrame:
    """(key, series, distance) of the k nearest in all blocks with a bound up to reach, for ``n`` rows (key, series, v, reach).

    Rows are written in groups of AT_ONCE (BLOCK_BYTES at most), and every task reads some groups and some blocks of a key: nothing is copied by shuffles, and of a group only the best so far is kept.
    """
    width = max(1, *(p.shape[-1] for p in blocks.pivots.values()))
    groups = -(-n // max(1, min(AT_ONCE, BLOCK_BYTES // (8 * width))))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("series"), F.lit(groups)).cast("int")).repartition(min(groups * len(blocks.pivots), AT_ONCE), "key", "group")
    packed = written(dealt.groupBy("key", "group").agg(F.collect_list(F.struct("series", "v", "reach")).alias("a")), "groups")
    shared = rows.sparkSession.sparkContext.broadcast(blocks.pivots)

    def best(key: str, ids: pa.Array, d: np.ndarray) -> pa.RecordBatch:
        row, rank = np.nonzero(np.isfinite(d))
        return pa.RecordBatch.from_arrays([pa.array([key] * len(row), pa.string()), ids.take(pa.array(row)), pa.array(d[row, rank])], names=["key", "series", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("key")[i].as_py(), batch.column("group")[i].as_py()
                if held != name:
                    if held is not None:
                        yield best(held[0], ids, found)
                    ids, x = unpacked(batch.column("a").slice(i, 1))
                    reach = batch.column("a").slice(i, 1).flatten().field(2).to_numpy()
                    held, own, found = name, euclidean(x, shared.value[name[0]]), np.full((len(x), k), np.inf)
                low, high = (np.array([batch.column(c)[i].as_py()]) for c in ("low", "high"))
                some = np.flatnonzero(within(bounds(own, low, high)[:, 0], reach))
                if len(some):
                    d = least(x[some], unpacked(batch.column("x").slice(i, 1))[1], k)
                    found[some] = np.sort(np.concatenate([found[some], d], axis=1), axis=1)[:, :k]
        if held is not None:
            yield best(held[0], ids, found)

    pairs = [packed.where(F.col("key") == key).crossJoin(blocks.table.where(F.col("key") == key).select("x", "low", "high")) for key in blocks.pivots]
    return mapped(reduce(DataFrame.unionByName, pairs), run, f"key string, series {blocks.kind}, distance double")


def nearest(rows: DataFrame, others: DataFrame, k: int = 1, size: int | None = None) -> DataFrame:
    """The k least Euclidean distances from each of ``rows`` to ``others`` (both: series, v, all of one length): series, rank (from 1), distance, as a written table.

    Rows with an unknown cell take no part on either side. Fewer than k others: all. With a column key on both sides, rows meet others of their key, lengths are those of a key, and key is returned too.
    """
    own = ["key"] if "key" in rows.columns else []
    rows = written(known(rows), "rows")
    n, blocks = rows.count(), Blocks(others, size)
    found = searched(sent(rows, blocks, True), blocks, k, n)
    if blocks.ranges.num_rows > len(blocks.pivots):
        found = written(found, "home")
        reach = found.groupBy("key", "series").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(float("inf")).alias("reach"), F.first("home").alias("home"))
        rows = written(rows.join(reach, ["key", "series"]), "reaching")
        if copies(rows, blocks) <= COPIES * n:
            found = found.unionByName(searched(sent(rows, blocks, False), blocks, k, n))
        else:
            found = compared(rows, blocks, k, n)
    order = Window.partitionBy("key", "series").orderBy("distance")
    return written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*own, "series", "rank", "distance"), "nearest")


def absolute_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x with each of y, over cells that both know; NaN where either is constant."""

    def centred(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = ~np.isnan(rows)
        z = np.where(known, rows - (np.where(known, rows, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1))[:, None], 0)
        lo, hi = np.where(known, rows, np.inf).min(axis=1), np.where(known, rows, -np.inf).max(axis=1)
        z[lo >= hi] = 0
        return z, known.astype(float)

    (a, in_a), (b, in_b) = centred(x), centred(y)
    n = np.maximum(in_a @ in_b.T, 1)
    sum_a, sum_b, square_a, square_b = a @ in_b.T, in_a @ b.T, (a * a) @ in_b.T, in_a @ (b * b).T
    var_a, var_b = square_a - sum_a**2 / n, square_b - sum_b**2 / n
    # what is left of a row that is constant on the common cells is rounding
    varies = (var_a > 1e-12 * square_a) & (var_b > 1e-12 * square_b)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(varies, np.abs(a @ b.T - sum_a * sum_b / n) / np.sqrt(var_a * var_b), np.nan)


def pair_sums(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[float, int]:
    """Total and number of the defined absolute correlations of rows of x with rows of y, in strips; of a block with itself (``same``) each pair once."""
    total, n = 0.0, 0
    for lo, part in strips(x, len(y)):
        r = absolute_correlations(part, y)
        if same:
            r[np.arange(lo, lo + len(part))[:, None] >= np.arange(len(y))] = np.nan
        defined = ~np.isnan(r)
        total, n = total + float(r[defined].sum()), n + int(defined.sum())
    return total, n


def correlation_sums(rows: DataFrame) -> DataFrame:
    """Partial sums over all pairs of ``rows`` (series, v): total of the absolute correlations that are defined, and their number n.

    Rows are dealt to blocks; a block goes to one task cell for each block not before it.
    """
    rows = written(rows.select("series", "v"), "correlated")
    m = -(-max(rows.count(), 1) // BLOCK)
    dealt = rows.groupBy(F.pmod(F.xxhash64("series"), F.lit(m)).cast("int").alias("a")).agg(F.collect_list(F.struct("series", "v")).alias("a_rows"))
    other = dealt.select(F.col("a").alias("b"), F.col("a_rows").alias("b_rows"), F.explode(F.sequence(F.lit(0), F.col("a"))).alias("a"))
    grid = dealt.withColumn("b", F.explode(F.sequence(F.col("a"), F.lit(m - 1)))).join(other, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (_, x), (_, y) = (unpacked(batch.column(c).slice(i, 1)) for c in ("a_rows", "b_rows"))
                same = batch.column("a")[i].as_py() == batch.column("b")[i].as_py()
                total, n = pair_sums(x, y, same)
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], names=["total", "n"])

    return mapped(grid.select("a", "b", "a_rows", "b_rows"), run, "total double, n long")

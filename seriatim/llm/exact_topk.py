"""Exact top-k inner-product search by columnar branch and bound.

Each component x becomes floor(256 * x), x as double; the score is the integer inner product. Queries are the rows that a
condition marks, candidates every row with another id. Both sides are cut into blocks: candidates into groups of about
``GROUP`` rows, queries into groups of about ``QUERIES``; every pair of blocks meets in one task cell, so the work is an even grid however
large either side is, and a cell holds GROUP + QUERIES vectors at most. A group of candidates is shuffled once; what is sent to every group are queries.

Within a cell candidates lie in vertical layout (a row for each dimension). Scores are accumulated a block of dimensions at a
time; after each block a candidate's score can grow by at most |rest of q| * |rest of x|. Candidates that no
query of the cell can still place among its k best are dropped and the columns compacted. The k-th best score so far, first of
a few long candidates scored whole, is the bound; equal scores are never dropped, so ties end with the smaller id.

Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Vectors meet only
vectors of their own dimension. Rows that repeat an id are candidates each, but not for queries with that id. Fewer
than k candidates: all. Integers are exact in float64 up to 2**53; a cell that could pass this uses Python's integers, and scores
beyond 64 bits are clipped to the end of the range.
An empty table gives no rows. Columns other than the two named are not read, whatever their names; ids are cast to 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import mapped, stored

GROUP, QUERIES, AT_ONCE, DIMS_AT_ONCE, SEEDS = 8192, 1024, 32, 16, 128


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer components as float64, a row for each vector) of one list of (id, vector) structs."""
    flat = column.flatten()
    ids, vectors = flat.field(0).to_numpy(), flat.field(1)
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    return ids, np.floor(256 * x)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def cell(qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, candidate id, score) of each query's k best candidates in one cell."""
    out: tuple[list, list, list] = ([], [], [])
    dims = q.shape[1]
    if dims and float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= 2.0**53:
        exact = [[int(v) for v in row] for row in x]
        for one, row in zip(qid, q):
            a = [int(v) for v in row]
            scores = [(-sum(u * v for u, v in zip(a, b)), int(i)) for b, i in zip(exact, xid) if i != one]
            for s, i in sorted(scores)[:k]:
                out[0].append(one), out[1].append(i), out[2].append(max(-(2**63), min(2**63 - 1, -s)))
        return out
    vertical = np.ascontiguousarray(x.T)
    cuts = [*range(0, dims, DIMS_AT_ONCE), dims] if dims else [0, 0]
    # length of what is left of each vector after each block
    rest_x = [np.sqrt((vertical[b:] ** 2).sum(axis=0)) for b in cuts[1:]]
    longest = np.argsort(-(vertical**2).sum(axis=0), kind="stable")[:SEEDS]
    for at in range(0, len(q), AT_ONCE):
        qs, ids = q[at : at + AT_ONCE], qid[at : at + AT_ONCE]
        seed = np.where(xid[longest] == ids[:, None], -np.inf, qs @ vertical[:, longest])
        bound = np.sort(seed, axis=1)[:, -k] if seed.shape[1] >= k else np.full(len(qs), -np.inf)
        alive = np.arange(len(xid))
        score = np.zeros((len(qs), len(xid)))
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
            score += qs[:, lo:hi] @ (vertical[lo:hi] if len(alive) == len(xid) else vertical[lo:hi, alive])
            if hi < dims:
                reach = score + np.sqrt((qs[:, hi:] ** 2).sum(axis=1))[:, None] * rest_x[b][alive] * (1 + 1e-9)
                keep = (reach + 1e-3 >= bound[:, None]).any(axis=0)
                if keep.mean() < 0.9:
                    alive, score = alive[keep], score[:, keep]
        for one, row in zip(ids, score):
            others = np.flatnonzero(xid[alive] != one)
            for j in best(row[others], xid[alive][others], k):
                out[0].append(one), out[1].append(xid[alive[others[j]]]), out[2].append(int(row[others[j]]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Each query's k best rows: query_id, rank (from 1), vec_id, score."""
    valid = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("is_query")).where(
        "id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    n, n_queries = valid.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    groups, blocks = -(-max(n, 1) // GROUP), -(-max(n_queries, 1) // QUERIES)
    # dealt by row number, so that neither a common id nor a common vector fills one group
    dealt = stored(valid.select("*", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")), "vectors")
    mixed = F.xxhash64("row")
    candidates = dealt.groupBy("d", F.pmod(mixed, F.lit(groups)).cast("int").alias("g")).agg(F.collect_list(F.struct("id", "v")).alias("x"))
    queries = dealt.where("is_query").groupBy("d", F.pmod(mixed, F.lit(blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    # the optimizer takes the exploded queries for as small as they were before, and would broadcast a copy for each group through the driver
    grid = candidates.join(queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).hint("merge"), ["d", "g"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xid, x = matrix(batch.column("x").slice(i, 1))
                qid, q = matrix(batch.column("q").slice(i, 1))
                a, b, c = cell(qid, q, xid, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["query_id", "vec_id", "score"])

    local = mapped(grid.select("x", "q"), run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

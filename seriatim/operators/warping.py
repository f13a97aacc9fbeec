"""Dynamic time warping, one anti-diagonal of many pairs at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of the padded sides of a batch of pairs; a longer pair stands alone.
CELLS = 1 << 19


def batches_of(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs of like lengths, CELLS padded cells at most, or one pair, at a time."""
    order, at = np.lexsort((m, n)), 0
    while at < len(order):
        to, widest = at + 1, m[order[at]]
        while to < len(order) and (to + 1 - at) * (n[order[to]] + max(widest, m[order[to]])) <= CELLS:
            widest = max(widest, m[order[to]])
            to += 1
        yield order[at:to]
        at = to


def warped(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Root of the least sum of squared differences along a warping path, of each row of a (its first n cells) with the row of b (its first m).

    Cells of one anti-diagonal depend on the two before it only, which are all that is kept. What pads a row comes after its end,
    so no path of the pair passes it.
    """
    out = np.zeros(len(a))
    last = n + m - 2
    width = a.shape[1] + 1  # column 0 stands for what is before the first row
    before, two_before = np.full((len(a), width), np.inf), np.full((len(a), width), np.inf)
    for d in range(int(last.max()) + 1):
        i = np.arange(max(0, d - b.shape[1] + 1), min(d, a.shape[1] - 1) + 1)
        least = np.minimum(np.minimum(before[:, i], before[:, i + 1]), two_before[:, i])
        now = np.full((len(a), width), np.inf)
        now[:, i + 1] = (a[:, i] - b[:, d - i]) ** 2 + (least if d else 0.0)
        ended = last == d
        out[ended] = now[ended, n[ended]]
        before, two_before = now, before
    return np.sqrt(out)


def padded(values: np.ndarray, first: np.ndarray, size: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Rows of the given places and sizes in ``values``, padded with 0 or ``fill``."""
    inside = np.arange(int(size.max(initial=0))) < size[:, None]
    out = np.full(inside.shape, fill)
    out[inside] = values[np.concatenate([np.arange(f, f + s) for f, s in zip(first, size)])] if len(size) else []
    return out


def distances(pairs: DataFrame, left: str = "v_o", right: str = "v_s") -> DataFrame:
    """``pairs`` (ord, column and two arrays of one value or more, without NULLs): ord, column, score: the warping distance over the longer length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (left, right):
                size = np.diff(batch.column(c).offsets.to_numpy())
                sides.append((batch.column(c).flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size, size))
            (x, x_first, n), (y, y_first, m) = sides
            score = np.zeros(batch.num_rows)
            for some in batches_of(n, m):
                score[some] = warped(padded(x, x_first[some], n[some]), padded(y, y_first[some], m[some]), n[some], m[some]) / np.maximum(n[some], m[some])
            yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("column"), pa.array(score)], names=["ord", "column", "score"])

    kind = pairs.schema["ord"].dataType.simpleString()
    return pairs.select("ord", "column", left, right).mapInArrow(run, f"ord {kind}, column string, score double")

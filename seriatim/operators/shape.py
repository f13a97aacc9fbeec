"""Reshaping points to feature matrices.

A matrix is a long table (variant, series, ord, f, value): feature f of a series is its f-th cell, row by row, in a row by col_ord and name. Two
rules exist and are not interchangeable: ``overlap`` keeps what all original series have, ``padded`` standardises
within each series and pads.
"""

from __future__ import annotations

import contextlib
import functools
import threading
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ORIGINAL, SYNTHETIC, of
from ..sources.store import discard, written
from .ranks import percentiles

SERIES = ("variant", "series", "ord")


class Matrices:
    """The matrices of one points frame that several measures ask for, each a written table, and a lock for each."""

    def __init__(self) -> None:
        self.tables: dict[str, DataFrame] = {}
        self.locks = {name: threading.Lock() for name in ("overlap", "padded")}


SHARED: dict[int, Matrices] = {}


@contextlib.contextmanager
def shared(points: DataFrame) -> Iterator[None]:
    """While it lasts, a matrix of this very frame is computed for the first measure that asks for it, and read by the others."""
    own = SHARED[id(points)] = Matrices()
    try:
        yield
    finally:
        del SHARED[id(points)]
        discard(*own.tables.values())


def once(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A matrix with no more arguments than points, written once where its points are ``shared``."""
    name = make.__name__

    @functools.wraps(make)
    def matrix(points: DataFrame, *args: object, **more: object) -> DataFrame:
        own = SHARED.get(id(points))
        if own is None or args or more:
            return make(points, *args, **more)
        with own.locks[name]:
            if name not in own.tables:
                own.tables[name] = written(make(points), name)
        return own.tables[name]

    return matrix


def kept(make: Callable[[DataFrame], DataFrame], points: DataFrame) -> DataFrame:
    """A matrix as a written table: that of all measures where points are ``shared``, else one of its own."""
    return make(points) if id(points) in SHARED else written(make(points), make.__name__)


def without(points: DataFrame, name: str = "OpenInt", exact: bool = False) -> DataFrame:
    """Drops a column by name, in any case unless ``exact``."""
    return points.where(F.col("column") != name) if exact else points.where(F.lower("column") != name.lower())


def cells(points: DataFrame) -> DataFrame:
    """Adds f, the place of a cell in its series read row by row, and n, the series' number of cells."""
    series = Window.partitionBy(*SERIES)
    return points.withColumn("f", F.row_number().over(series.orderBy("t", "col_ord", "column")) - 1).withColumn("n", F.count(F.lit(1)).over(series))


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))


@once
def overlap(points: DataFrame, length: int | None = None) -> DataFrame:
    """The first L cells of every series with L or more; L is the least length of the original unless given."""
    least = F.lit(length) if length is not None else lengths(points).agg(F.min(of(ORIGINAL, F.col("n")))).scalar()
    return cells(points).where((F.col("n") >= least) & (F.col("f") < least)).select(*SERIES, "f", "value")


@once
def padded(points: DataFrame) -> DataFrame:
    """Each column standardised within its series (population deviation; untouched where that is 0), flattened to
    L cells, the 75th percentile of the original's lengths. Series from L // 2 up to L are filled with their last
    cell, shorter ones dropped. OpenInt is left out."""
    own = Window.partitionBy(*SERIES, "column")
    kept = without(points, exact=True)
    sd = F.stddev_pop("value").over(own)
    z = kept.withColumn("value", F.when(sd > 0, (F.col("value") - F.avg("value").over(own)) / sd).otherwise(F.col("value")))
    rows = z.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "col_ord", "column", "value"))), lambda x: x["value"]).alias("v"))
    size = lengths(kept).agg(F.percentile(of(ORIGINAL, F.col("n")), F.lit(0.75)).cast("int")).scalar()
    fit = rows.withColumn("size", size).where(F.size("v") >= F.floor(F.col("size") / 2))
    long_ = fit.select(*SERIES, F.slice(F.concat("v", F.array_repeat(F.element_at("v", -1), F.greatest(F.col("size") - F.size("v"), F.lit(0)))), F.lit(1), F.col("size")).alias("v"))
    return long_.select(*SERIES, F.posexplode("v").alias("f", "value"))


def padded_columns(points: DataFrame) -> DataFrame:
    """As ``padded``, for each column by itself and over its known values: key (the column), variant, series, ord, f, value. A column's size L is that of its original series."""
    own = Window.partitionBy(*SERIES, "column")
    sd = F.stddev_pop("value").over(own)
    kept = points.where(F.col("value").isNotNull())
    z = kept.withColumn("value", F.when(sd > 0, (F.col("value") - F.avg("value").over(own)) / sd).otherwise(F.col("value")))
    rows = z.groupBy(F.col("column").alias("key"), *SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("v"))
    n = kept.groupBy("variant", "series", F.col("column").alias("key")).agg(F.count(F.lit(1)).alias("value")).where(F.col("variant") == ORIGINAL)
    size = percentiles(n, ["key"], [0.75]).select("key", F.col("q")[0].cast("int").alias("size"))
    fit = rows.join(size, "key").where(F.size("v") >= F.floor(F.col("size") / 2))
    filled = F.slice(F.concat("v", F.array_repeat(F.element_at("v", -1), F.greatest(F.col("size") - F.size("v"), F.lit(0)))), F.lit(1), F.col("size"))
    return fit.select("key", *SERIES, filled.alias("v")).select("key", *SERIES, F.posexplode("v").alias("f", "value"))


def column_matrices(points: DataFrame) -> DataFrame:
    """Each side cut to the row count of its shortest series."""
    rows = points.groupBy("variant", "series").agg(F.max("t").alias("last"))
    least = rows.groupBy("variant").agg((F.min("last") + 1).alias("rows"))
    return without(points).join(F.broadcast(least), "variant").where(F.col("t") < F.col("rows")).drop("rows")


def column_stats(matrices: DataFrame) -> DataFrame:
    """Per column: mean, sample deviation, least and greatest value, range and series of the original."""
    o = matrices.where(F.col("variant") == ORIGINAL)
    return o.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("value") - F.min("value")).alias("range"), F.countDistinct("series").alias("n_series"))


def normalized_columns(points: DataFrame) -> DataFrame:
    """Column matrices with both sides standardised by the original, only centred where its deviation is 1e-8 or less. Columns of both sides only."""
    m = column_matrices(points)
    o = of(ORIGINAL, F.col("value"))
    sides = [F.count(of(x, F.lit(1))).alias(f"n_{x}") for x in (ORIGINAL, SYNTHETIC)]
    stats = m.groupBy("column").agg(F.avg(o).alias("mean"), F.stddev_samp(o).alias("sd"), *sides).where("n_o > 0 and n_s > 0").drop("n_o", "n_s")
    # a row for each column, so it may be broadcast
    joined = m.join(F.broadcast(stats), "column")
    return joined.withColumn("value", (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 1e-8, F.col("sd")).otherwise(1.0)).drop("mean", "sd")


def standardized(matrix: DataFrame, fit_on: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each feature less its mean over its population deviation (1 where that is 0), fitted on the original or on ``fit_on`` rows.

    The statistics have a row for each feature of one series, so they may be broadcast.
    """
    rows = F.col("variant") == ORIGINAL if fit_on is None else fit_on
    stats = matrix.where(rows).groupBy(*keys, "f").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return matrix.join(stats, [*keys, "f"]).withColumn("value", (F.col("value") - F.col("mean")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).drop("mean", "sd")


def vectors(matrix: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each series (and key): its values in order of f."""
    return matrix.groupBy(*keys, *SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "value"))), lambda x: x["value"]).alias("v"))


def truncated(points: DataFrame, length: int | None = None) -> DataFrame:
    """All series cut to ``length`` rows, or to the shortest."""
    least = F.lit(length) if length is not None else points.groupBy("variant", "series").agg((F.max("t") + 1).alias("rows")).agg(F.min("rows")).scalar()
    return points.where(F.col("t") < least)


def extended(points: DataFrame, length: int | None = None) -> DataFrame:
    """All series brought to ``length`` rows, or to the longest, by repeating their last row; longer ones are cut."""
    greatest = F.lit(length) if length is not None else points.agg(F.max("t") + 1).scalar()
    by_column = points.groupBy(*SERIES, "column", "col_ord").agg(F.max("t").alias("last"), F.max_by("value", "t").alias("value")).withColumn("rows", greatest)
    more = by_column.where(F.col("last") + 1 < F.col("rows")).withColumn("t", F.explode(F.sequence(F.col("last") + 1, F.col("rows") - 1)))
    columns = [*SERIES, "t", "column", "col_ord", "value"]
    return points.where(F.col("t") < greatest).select(*columns).unionByName(more.select(*columns))


def chained(points: DataFrame) -> DataFrame:
    """Adds before, the value one step earlier in the series and column, and whether a step is the first and the last one there."""
    order = Window.partitionBy(*SERIES, "column").orderBy("t")
    return points.withColumns({"before": F.lag("value").over(order), "first": F.lag("t").over(order).isNull(), "last": F.lead("t").over(order).isNull()})


def lagged(points: DataFrame, horizon: int = 1) -> DataFrame:
    """Sliding windows within a series and column: x, the ``horizon`` values before, oldest first; y, the value."""
    order = Window.partitionBy(*SERIES, "column").orderBy("t")
    lags = [F.lag("value", k).over(order) for k in range(horizon, 0, -1)]
    return points.select(*SERIES, "column", "t", F.array(*lags).alias("x"), F.col("value").alias("y")).where(F.col("t") >= horizon)


def overlay(points: DataFrame) -> DataFrame:
    """One series of each variant, to be drawn over each other: the smallest id that all variants have, else each variant's smallest.

    overlap_end is the last step that all of them reach, and within says whether a step is not past it.
    """
    lengths = points.groupBy("variant", "series").agg((F.max("t") + 1).alias("rows"))
    firsts = lengths.groupBy("variant").agg(F.min("series").alias("first"))
    sides = lengths.groupBy("series").agg(F.count(F.lit(1)).alias("sides"))
    common = sides.where(F.col("sides") == firsts.agg(F.count(F.lit(1))).scalar()).agg(F.min("series")).scalar()
    chosen = firsts.select("variant", F.coalesce(common, "first").alias("series"))
    end = lengths.join(chosen, ["variant", "series"]).agg(F.min("rows") - 1).scalar()
    drawn = without(points).join(chosen, ["variant", "series"]).withColumn("overlap_end", end)
    return drawn.select("variant", "series", "column", "t", "value", "overlap_end", (F.col("t") <= F.col("overlap_end")).alias("within"))

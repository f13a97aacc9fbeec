"""Exact percentiles and numbering without gathering a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

#: Values of a key among which a rank is looked up by sorting; more are narrowed first, by EDGES ranges at a time.
LIMIT, EDGES, ACCURACY = 1 << 20, 64, 4000


def narrowed(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """One step: the ranks of a key that lie in a range of values are parted among smaller ranges. A range is known by the number of values below it.

    Bounds of ranges come from a sketch of bounded size, so they split any distribution about evenly, and a bound is a range of its own, so a value
    of many rows ends the search; the counts of the ranges are exact.
    """
    inside = values.join(state, keys).where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    grid = F.percentile_approx("value", F.array(*(F.lit(i / EDGES) for i in range(EDGES + 1))), ACCURACY)
    bounds = written(inside.groupBy(*keys, "below").agg(F.array_distinct(grid).alias("bounds")), "bounds")
    number = F.size(F.filter("bounds", lambda x: x < F.col("value"))) + F.size(F.filter("bounds", lambda x: x <= F.col("value")))
    counts = inside.join(bounds, [*keys, "below"]).groupBy(*keys, "below", number.alias("range")).agg(F.count(F.lit(1)).alias("inside"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    order = Window.partitionBy(*keys, "below").orderBy("range")  # 2 * EDGES + 3 rows
    placed = counts.withColumn("upto", F.col("below") + F.sum("inside").over(order)).join(state.select(*keys, "below", "ranks"), [*keys, "below"]).withColumn("below", F.col("upto") - F.col("inside"))
    held = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("below")))
    return placed.withColumn("ranks", held).where(F.size("ranks") > 0).select(*keys, "ranks", "below", "inside", "lo", "hi")


def percentiles(values: DataFrame, keys: Sequence[str], at: Sequence[float], limit: int = LIMIT) -> DataFrame:
    """(keys, q): the percentiles ``at`` of the column value by key, linear between neighbours, NULLs left out; keys without a value have no row.

    Ranks are looked up among the distinct values of the range that holds them. Where such a range has more than ``limit`` rows it
    is narrowed first, step by step, by counting.
    """
    keys = list(keys)
    values = values.where(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value"))
    grouped = keys or ["one"]
    values = values if keys else values.select(F.lit(1).alias("one"), "value")
    sizes = values.groupBy(*grouped).agg(F.count(F.lit(1)).alias("inside"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    h = [(F.col("inside") - 1) * F.lit(float(q)) for q in at]
    ranks = F.array_distinct(F.array(*(f(x) for x in h for f in (F.floor, F.ceil))))
    state = written(sizes.select(*grouped, F.lit(0).cast("long").alias("below"), "inside", "lo", "hi", ranks.alias("ranks")).select(*grouped, "ranks", "below", "inside", "lo", "hi"), "ranks")
    total = state
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > limit)
    while state.where(wide).count():
        state = written(narrowed(values, state.where(wide), grouped).unionByName(state.where(~wide)), "ranks")
    held = values.join(state.drop("ranks"), grouped).where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    counts = held.groupBy(*grouped, "below", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*grouped, "below").orderBy("value"))
    asked = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    found = counts.withColumn("upto", upto).join(state.select(*grouped, "below", "ranks"), [*grouped, "below"]).select(*grouped, F.explode(asked).alias("rank"), F.col("value").alias("x"))
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", "x")))
    n = total.select(*grouped, "inside").distinct()
    joined = found.groupBy(*grouped).agg(by_rank.alias("x")).join(n, grouped)
    # as the library's percentile does it: a weighted mean of both neighbours
    q = [F.when(F.floor(x) == F.ceil(x), F.element_at("x", F.floor(x))).otherwise((F.ceil(x) - x) * F.element_at("x", F.floor(x)) + (x - F.floor(x)) * F.element_at("x", F.ceil(x))) for x in h]
    return joined.select(*keys, F.array(*q).alias("q"))


def numbered(ids: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "ord") -> DataFrame:
    """``ids`` with ``name``, the place (from 0) of a row among those of equal ``within``, in ``order``, which tells rows apart.

    Rows are sorted by ranges over all tasks; the place in a range and the counts of the ranges before it give the number.
    """
    keys = [*within, *order]
    ranges = ids.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    table = written(ranges, "numbered")
    part = F.shiftright("at", 33)
    starts = table.groupBy(*within, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offsets = starts.select(*within, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = table.withColumn("part", part).join(offsets, [*within, "part"])
    return placed.select(*ids.columns, (F.col("at") - F.col("first") + F.col("offset")).cast("int").alias(name))

"""Series views over warehouse tables: every view is a ``points`` table.

points: variant ('o' original, 's' synthetic), series, ord (place of the series in its variant), t (time step), column,
col_ord, value. Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(points: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Adds ord. Only the distinct series ids, of ``source`` where that has the same at less work, are ordered, by ranges over all tasks, never the points."""
    ids = (points if source is None else source).select("variant", "series").distinct()
    return points.join(ranks.numbered(ids, ["variant"], ["series"]), ["variant", "series"])


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant and series of each event where series are users."""
    return table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 2 == 0, "o").otherwise("s").alias("variant"), F.col("user_id").alias("series"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user of ``events``, columns value and k; even users are the original, odd ones the synthetic side."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "o").otherwise("s").alias("variant"),
        F.col("user_id").alias("series"),
        (F.row_number().over(order) - 1).alias("t"),
        F.struct(F.lit("value").alias("column"), F.lit(0).alias("col_ord"), F.col("value").alias("value")).alias("a"),
        F.struct(F.lit("k").alias("column"), F.lit(1).alias("col_ord"), F.get_json_object("props", "$.k").cast("double").alias("value")).alias("b"),
    )
    return numbered(steps, events_by_user(spark, sf_dir)).select("variant", "series", "t", F.inline(F.array("a", "b")), "ord").select("variant", "series", "t", "column", "col_ord", "value", "ord")


def event_type_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each user, a column for each event type: ragged and short."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    long_ = table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "o").otherwise("s").alias("variant"),
        F.col("user_id").alias("series"),
        (F.row_number().over(order) - 1).alias("t"),
        F.col("event_type").alias("column"),
        F.lit(0).alias("col_ord"),
        "value",
    )
    return numbered(long_, events_by_user(spark, sf_dir))


def half_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``event_type_points``, but each user's events with even ids are the original and those with odd ids the synthetic side, so sides share series."""
    half = F.col("event_id") % 2
    order = Window.partitionBy("user_id", half, "event_type").orderBy("ts", "event_id")
    long_ = table(spark, sf_dir, "events").select(
        F.when(half == 0, "o").otherwise("s").alias("variant"),
        F.col("user_id").alias("series"),
        (F.row_number().over(order) - 1).alias("t"),
        F.col("event_type").alias("column"),
        F.lit(0).alias("col_ord"),
        "value",
    )
    return numbered(long_, table(spark, sf_dir, "events").select(F.when(half == 0, "o").otherwise("s").alias("variant"), F.col("user_id").alias("series")))


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each supplier and month of ``lineitem``: Open, High, Low, Close of the price, Volume, OpenInt; odd suppliers are the original."""
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    bars = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("series"), F.date_trunc("month", "l_shipdate").alias("month"))
        .agg(
            F.min_by("l_extendedprice", at).alias("Open"),
            F.max("l_extendedprice").alias("High"),
            F.min("l_extendedprice").alias("Low"),
            F.max_by("l_extendedprice", at).alias("Close"),
            F.sum("l_quantity").alias("Volume"),
        )
    )
    t = F.row_number().over(Window.partitionBy("series").orderBy("month")) - 1
    return bars.select(F.when(F.col("series") % 2 == 1, "o").otherwise("s").alias("variant"), "series", t.alias("t"), "Open", "High", "Low", "Close", "Volume", F.lit(0.0).alias("OpenInt"))


def bar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Open", "High", "Low", "Close", "Volume", "OpenInt"]
    cells = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(i).alias("col_ord"), F.col(n).alias("value")) for i, n in enumerate(names)))
    ids = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 2 == 1, "o").otherwise("s").alias("variant"), F.col("l_suppkey").alias("series"))
    return numbered(monthly_bars(spark, sf_dir), ids).select("variant", "series", "t", F.inline(cells), "ord").select("variant", "series", "t", "column", "col_ord", "value", "ord")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of one step for each embedding, a column for each dimension; even labels are the original."""
    rows = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") % 2 == 0, "o").otherwise("s").alias("variant"), F.col("vec_id").alias("series"), F.posexplode("embedding").alias("col_ord", "x"))
    return numbered(rows.select("variant", "series", F.lit(0).alias("t"), F.format_string("d%02d", "col_ord").alias("column"), "col_ord", F.col("x").cast("double").alias("value")))

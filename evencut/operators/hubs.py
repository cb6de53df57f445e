"""Hubs: the vertices before the tangent at the end of the degree concentration curve meets the axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evencut.functions.loop import materialize
from evencut.functions.select import ID_RANGE, smallest_per_group


def lorenz_curve(degrees: DataFrame) -> DataFrame:
    """Vertices in ascending (degree, id) with their places and cumulative shares.

    Places come from counts: running sums over the distinct degrees, then over the id ranges of a degree, then
    places inside a range, so no task orders more than the ids of a range.
    """
    degrees = materialize(degrees, "degrees")
    dealt = degrees.withColumn("_r", F.floor(F.col("id") / ID_RANGE))
    ranges = dealt.groupBy("degree", "_r").agg(F.count("*").alias("_n"))
    up = lambda *keys: Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    levels = ranges.groupBy("degree").agg(F.sum("_n").alias("_n"))  # at most sqrt(2 * arcs) rows
    levels = levels.select("degree", F.coalesce(F.sum("_n").over(up("degree")), F.lit(0)).alias("_below"), F.coalesce(F.sum(F.col("_n") * F.col("degree")).over(up("degree")), F.lit(0)).alias("_sum"))
    inside = Window.partitionBy("degree").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0))).drop("_n").join(levels, "degree")
    total = degrees.agg(F.sum("degree").alias("t"), F.count("*").alias("n"))  # one row
    rows = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("degree", "_r").orderBy("id"))).join(ranges, ["degree", "_r"]).join(F.broadcast(total))
    rows = rows.withColumn("_in", F.col("_off") + F.col("_rn"))
    rows = rows.select("id", "degree", (F.col("_below") + F.col("_in")).alias("pos"), (F.col("_sum") + F.col("degree") * F.col("_in")).alias("cum"), "t", "n")
    share = F.when(F.col("t") > 0, F.col("cum") / F.col("t")).otherwise(0.0)
    return rows.select("id", "degree", "pos", "cum", F.round(F.col("pos") / F.col("n"), 6).alias("x"), F.round(share, 6).alias("y"))


def hub_count(degrees: DataFrame) -> int:
    """ceil(sum / max) of the degrees; 0 without edges or with under two vertices."""
    t = degrees.agg(F.sum("degree").alias("t"), F.max("degree").alias("m"), F.count("*").alias("n")).first()
    return 0 if not t.m or t.n < 2 else -(-t.t // t.m)


def hub_nodes(degrees: DataFrame) -> DataFrame:
    """(id, degree) of the hubs; order by (degree desc, id)."""
    degrees = materialize(degrees, "degrees")
    h = hub_count(degrees)
    one = degrees.select(F.lit(0).alias("g"), (-F.col("degree")).alias("o"), "id", "degree")
    wanted = degrees.sparkSession.createDataFrame([(0, h)], "g int, k long")
    return smallest_per_group(one, "g", "o", wanted).select("id", "degree")


def first_seed(degrees: DataFrame) -> DataFrame:
    """(id, degree) of the vertex of highest degree, lowest id first."""
    return degrees.orderBy(F.desc("degree"), "id").limit(1)

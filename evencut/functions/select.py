"""Top-k per group without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ID_RANGE = 1 << 20


def smallest_per_group(rows: DataFrame, group: str, order: str, wanted: DataFrame | float) -> DataFrame:
    """The rows of each group with the smallest (order, id): wanted.k of them, or ceil(wanted * rows of the group).

    rows has group, order (integer) and id, with distinct ids in a group; wanted, if a table, has group and k, one
    row a group. Rows are counted by (order, id range). Running sums over the counts of a group's orders, then over
    the ranges of the one order that is cut, tell which rows go whole; only the rows of the range that is cut are
    ranked (ID_RANGE at most), never a group. Groups missing from wanted, or with k <= 0, give no row; an empty
    input gives an empty result.
    """
    dealt = rows.withColumn("_r", F.floor(F.col("id") / ID_RANGE))
    ranges = dealt.groupBy(group, order, "_r").agg(F.count("*").alias("_n"))
    orders = ranges.groupBy(group, order).agg(F.sum("_n").alias("_n"))
    if isinstance(wanted, DataFrame):
        orders = orders.join(F.broadcast(wanted.select(group, "k")), group)
    else:
        orders = orders.withColumn("k", F.ceil(F.lit(wanted) * F.sum("_n").over(Window.partitionBy(group))))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    orders = orders.withColumn("_room", F.col("k") - F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_room > 0").drop("k")
    whole = dealt.join(orders.filter("_n <= _room").select(group, order), [group, order], "left_semi")
    inside = Window.partitionBy(group, order).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranges.join(orders.filter("_n > _room").select(group, order, "_room"), [group, order])
    cut = cut.withColumn("_room", F.col("_room") - F.coalesce(F.sum("_n").over(inside), F.lit(0))).filter("_room > 0").select(group, order, "_r", "_room")
    ranked = dealt.join(cut, [group, order, "_r"]).withColumn("_rn", F.row_number().over(Window.partitionBy(group, order, "_r").orderBy("id")))
    return whole.select(*rows.columns).unionByName(ranked.filter("_rn <= _room").select(*rows.columns))

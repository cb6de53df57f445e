"""Per-rank export views: ghosts and compressed rows under modulo ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evencut.operators.graph import Graph, degrees


def _rank(col: str, ranks: int):
    return F.pmod(F.col(col), F.lit(ranks)).cast("int")


def ghosts(graph: Graph, labels: DataFrame, ranks: int) -> DataFrame:
    """(rank, gid, owner, label): remote neighbours that a rank sees."""
    seen = graph.arcs.select(_rank("src", ranks).alias("rank"), F.col("dst").alias("gid")).filter(F.col("rank") != _rank("gid", ranks)).distinct()
    return seen.join(labels.select(F.col("id").alias("gid"), "label"), "gid", "left").select("rank", "gid", _rank("gid", ranks).alias("owner"), "label")


def csr_row_ptr(graph: Graph, labels: DataFrame, ranks: int) -> DataFrame:
    """(rank, local_idx, gid, label, row_start, row_end). Ids are dense, so a local index is id div ranks; row starts sum degrees by blocks first."""
    block = 1 << 16
    d = degrees(graph).join(labels, "id").select(_rank("id", ranks).alias("rank"), F.floor(F.col("id") / ranks).alias("local_idx"), F.col("id").alias("gid"), "label", "degree")
    d = d.withColumn("blk", F.floor(F.col("local_idx") / block))
    before = Window.partitionBy("rank").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("rank", "blk").agg(F.sum("degree").alias("s")).select("rank", "blk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
    inner = Window.partitionBy("rank", "blk").orderBy("gid").rowsBetween(Window.unboundedPreceding, 0)
    out = d.withColumn("end", F.sum("degree").over(inner)).join(sums, ["rank", "blk"])
    return out.select("rank", "local_idx", "gid", "label", (F.col("off") + F.col("end") - F.col("degree")).alias("row_start"), (F.col("off") + F.col("end")).alias("row_end"))


def csr_col_idx(graph: Graph, labels: DataFrame, ranks: int) -> DataFrame:
    """(rank, pos, col_index): neighbours in (row, neighbour) order; local ones by local index, ghosts after all locals by gid."""
    ptr = csr_row_ptr(graph, labels, ranks).select("rank", "gid", "row_start")
    arcs = graph.arcs.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    g = ghosts(graph, labels, ranks).select("rank", "gid")
    locals_n = g.sparkSession.range(ranks).select(F.col("id").cast("int").alias("rank"), F.floor((F.lit(graph.n) - F.col("id") + ranks - 1) / ranks).alias("n_local"))
    block = 1 << 16
    g = g.withColumn("blk", F.floor(F.col("gid") / block))
    before = Window.partitionBy("rank").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = g.groupBy("rank", "blk").agg(F.count("*").alias("c")).select("rank", "blk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    g = g.withColumn("rn", F.row_number().over(Window.partitionBy("rank", "blk").orderBy("gid"))).join(offs, ["rank", "blk"])
    g = g.join(F.broadcast(locals_n), "rank").select("rank", F.col("gid").alias("dst"), (F.col("n_local") + F.col("off") + F.col("rn") - 1).alias("ghost_idx"))
    rows = arcs.withColumn("rank", _rank("src", ranks)).join(ptr.withColumnRenamed("gid", "src"), ["rank", "src"]).join(g, ["rank", "dst"], "left")
    return rows.select("rank", (F.col("row_start") + F.col("k")).alias("pos"), F.coalesce("ghost_idx", F.floor(F.col("dst") / ranks)).alias("col_index"))

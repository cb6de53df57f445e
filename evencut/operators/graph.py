"""Normalised graphs and their degree statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.functions.loop import materialize


@dataclass(frozen=True)
class Graph:
    """n vertices 0..n-1; edges (src < dst), distinct; arcs hold both directions; pairs are the edges, or rows of them that may repeat."""

    n: int
    vertices: DataFrame
    edges: DataFrame
    arcs: DataFrame
    pairs: DataFrame

    def kept(self) -> Graph:
        """The same graph with its arcs and edges written once, for loops."""
        if self.pairs is self.edges:
            return self
        edges = materialize(self.edges, "edges")
        return replace(self, edges=edges, arcs=both_ways(edges), pairs=edges)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def normalize(raw: DataFrame, n: int) -> Graph:
    """Range check, no self-loops, (min, max) orientation, distinct, both directions. Null ends are dropped."""
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    inside = src.between(0, n - 1) & dst.between(0, n - 1) & (src != dst)
    pairs = raw.filter(inside).select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst"))
    edges = pairs.distinct()
    return Graph(n, raw.sparkSession.range(n), edges, both_ways(edges), pairs)


def adjacency(graph: Graph) -> DataFrame:
    """(id, nbrs): sorted neighbour lists of the vertices that have any."""
    return graph.arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def clean_list(nbrs, own):
    """A raw neighbour list sorted, without repeats and without the vertex itself."""
    return F.array_sort(F.array_remove(F.array_distinct(nbrs), own))


def degrees(graph: Graph) -> DataFrame:
    """(id, degree), 0 for isolated vertices."""
    d = graph.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary(graph: Graph) -> DataFrame:
    """One row: vertices, edges, average degree, largest degree, isolated vertices and their share in percent."""
    d = degrees(graph).agg(
        F.count("*").alias("vertices"),
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("edges"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("dangling"),
    )
    per = lambda x, digits: F.round(F.when(F.col("vertices") > 0, x / F.col("vertices")).otherwise(0.0), digits)
    return d.withColumn("avg_degree", per(2.0 * F.col("edges"), 3)).withColumn("dangling_pct", per(100.0 * F.col("dangling"), 2))


def conversion_stats(graph: Graph) -> DataFrame:
    """One row: unique edges, vertices with and without neighbours, and the bytes of the graph as adjacency text."""
    counts = degrees(graph).agg(
        (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("long").alias("unique_edges"),
        F.count_if(F.col("degree") > 0).alias("non_empty"),
        F.count_if(F.col("degree") == 0).alias("empty"),
    )
    ids = graph.arcs.agg(F.coalesce(F.sum(F.length(F.col("dst").cast("string")) + 1), F.lit(0)).alias("b"))  # a space or line end behind each
    size = F.col("b") + F.col("empty") + len(str(graph.n)) + 1
    return counts.join(F.broadcast(ids)).select("unique_edges", "non_empty", "empty", size.alias("text_bytes"))


def owners(graph: Graph, ranks: int) -> DataFrame:
    """(id, owner) under modulo ownership by a number of virtual ranks."""
    return graph.vertices.select("id", F.pmod("id", F.lit(ranks)).cast("int").alias("owner"))

"""Adjacency text: the first line holds the vertex count, line i + 1 the neighbours of vertex i."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evencut.functions.loop import materialize
from evencut.operators.graph import Graph, normalize


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value), 0-based in file order. Every split counts its own lines; only the per-split counts are summed up."""
    raw = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    raw = materialize(raw, "lines")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = raw.groupBy("b").agg(F.count("*").alias("n")).select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    rn = F.row_number().over(Window.partitionBy("b").orderBy("m"))
    return raw.withColumn("rn", rn).join(offsets, "b").select((F.col("off") + F.col("rn") - 1).alias("line"), "value")


def read_adjacency(spark: SparkSession, path: str, strict: bool = False) -> Graph:
    """Reads directed or undirected adjacency text as a normalised graph.

    Blank lines are isolated vertices; runs of white space (also CR) separate; ids out of range are dropped.
    A header that is no non-negative integer, or a neighbour that is no integer, raises; so does a header
    that differs from the number of lines if strict, else the number of lines holds. An empty file raises.
    """
    lines = materialize(numbered_lines(spark, path), "numbered")
    head = lines.filter("line = 0").select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("v")).collect()
    if not head or not head[0].v.isdigit():
        raise ValueError(f"{path}: the first line must be the number of vertices")
    n = lines.count() - 1
    if strict and int(head[0].v) != n:
        raise ValueError(f"{path}: the header says {head[0].v} vertices, there are {n} lines")
    arcs = (
        lines.filter("line > 0")
        .select((F.col("line") - 1).alias("src"), F.explode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias("d"))
        .filter("d <> ''").select("src", F.col("d").cast("long").alias("dst"))
    )
    return normalize(arcs, n)


def adjacency_text(graph: Graph, arcs: DataFrame | None = None) -> DataFrame:
    """(id, value): each vertex's neighbours (or those by the given arcs) in ascending order, space-joined; "" for a vertex without any."""
    lists = (graph.arcs if arcs is None else arcs).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    return graph.vertices.join(lists, graph.vertices.id == lists.src, "left").select("id", F.coalesce(F.concat_ws(" ", "nbrs"), F.lit("")).alias("value"))


def write_adjacency(graph: Graph, path: str, arcs: DataFrame | None = None) -> None:
    """One folder of text files that read in name order as one adjacency text, directed if arcs are given; a range sort, never a single task."""
    head = graph.vertices.sparkSession.createDataFrame([(-1, str(graph.n))], "id long, value string")
    head.unionByName(adjacency_text(graph, arcs)).orderBy("id").select("value").write.text(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a key=value file; comment and blank lines are skipped."""
    kv = F.split(F.col("value"), "=", 2)
    return spark.read.text(path).filter("value not like '#%' and value like '%=%'").select(F.trim(kv[0]).alias("key"), F.trim(kv[1]).alias("value"))


def write_properties(properties: DataFrame, path: str) -> None:
    """(key, value) as a key=value file."""
    properties.select(F.concat_ws("=", F.col("key").cast("string"), F.col("value").cast("string")).alias("value")).write.text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.select("id", "label").write.parquet(path)

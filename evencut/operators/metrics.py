"""Partition statistics, balance and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.operators.graph import Graph


def labelled_edges(graph: Graph, labels: DataFrame) -> DataFrame:
    """(src, dst, lu, lv): edges with the labels of both ends."""
    lu = labels.select(F.col("id").alias("src"), F.col("label").alias("lu"))
    lv = labels.select(F.col("id").alias("dst"), F.col("label").alias("lv"))
    return graph.edges.join(lu, "src").join(lv, "dst")


def label_pairs(graph: Graph, labels: DataFrame) -> DataFrame:
    """(lu, lv, n): edges by the labels of their ends; parts * parts rows at most."""
    return labelled_edges(graph, labels).groupBy("lu", "lv").agg(F.count("*").alias("n"))


def edge_cut(graph: Graph, labels: DataFrame) -> DataFrame:
    return labelled_edges(graph, labels).agg(F.count_if(F.col("lu") != F.col("lv")).alias("edge_cut"))


def _filled(counts: DataFrame, parts: int, name: str) -> DataFrame:
    all_parts = counts.sparkSession.range(parts).select(F.col("id").cast("int").alias("label"))
    return all_parts.join(counts, "label", "left").select("label", F.coalesce(name, F.lit(0)).alias(name))


def part_vertex_counts(labels: DataFrame, parts: int) -> DataFrame:
    return _filled(labels.groupBy("label").agg(F.count("*").alias("vertices")), parts, "vertices")


def part_edge_counts(graph: Graph, labels: DataFrame, parts: int) -> DataFrame:
    inner = label_pairs(graph, labels).filter("lu = lv").select(F.col("lu").alias("label"), F.col("n").alias("edges"))
    return _filled(inner, parts, "edges")


def part_stats(graph: Graph, labels: DataFrame, parts: int) -> DataFrame:
    """(label, vertices, edges) with every part present."""
    return part_vertex_counts(labels, parts).join(part_edge_counts(graph, labels, parts), "label")


def _ratio(col: str, parts: int):
    return F.when(F.sum(col) > 0, F.max(col) * float(parts) / F.sum(col)).otherwise(0.0)


def balance(stats: DataFrame, parts: int) -> DataFrame:
    """One row: largest part over the mean part, by vertices and by internal edges; 0 where there are none."""
    return stats.agg(F.round(_ratio("vertices", parts), 6).alias("vertex_balance"), F.round(_ratio("edges", parts), 6).alias("edge_balance"))


def label_ratios(stats: DataFrame, parts: int) -> DataFrame:
    """(label, vertices, edges, rv, re): the per-part sizes relative to their means."""
    t = stats.agg(F.sum("vertices").alias("tv"), F.sum("edges").alias("te"))
    per = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) * float(parts) / F.col(b)).otherwise(0.0), 6)
    return stats.join(F.broadcast(t)).select("label", "vertices", "edges", per("vertices", "tv").alias("rv"), per("edges", "te").alias("re"))


def partition_summary(labels: DataFrame, parts: int, n: int) -> DataFrame:
    """One row on part sizes: total, min, max, average, population deviation, imbalance, coverage in percent."""
    s = part_vertex_counts(labels.dropDuplicates(["id"]), parts)
    return s.agg(
        F.sum("vertices").alias("total"), F.min("vertices").alias("min_size"), F.max("vertices").alias("max_size"),
        F.round(F.avg("vertices"), 6).alias("avg_size"), F.round(F.stddev_pop("vertices"), 6).alias("stddev"),
        F.round(_ratio("vertices", parts), 6).alias("imbalance"),
        F.round(100.0 * F.sum("vertices") / F.lit(max(n, 1)), 6).alias("coverage_pct"),
    )


def label_counts(graph: Graph, labels: DataFrame) -> DataFrame:
    """(lu, lv, n): edges by the labels of their ends, and vertices by their label, with lv null; parts * (parts + 1) rows at most."""
    held = labels.groupBy(F.col("label").alias("lu")).agg(F.lit(None).cast("int").alias("lv"), F.count("*").alias("n"))
    return label_pairs(graph, labels).unionByName(held)


def measure(graph: Graph, labels: DataFrame, parts: int) -> dict:
    """The metrics as driver-side numbers, from one job."""
    return summed_up(label_counts(graph, labels), parts)


def summed_up(counts: DataFrame, parts: int) -> dict:
    found = counts.collect()
    pairs = {(r.lu, r.lv): r.n for r in found if r.lv is not None}
    vertices = dict.fromkeys(range(parts), 0) | {r.lu: r.n for r in found if r.lv is None}
    edges = {p: pairs.get((p, p), 0) for p in range(parts)}
    rate = lambda d: max(d.values()) * parts / sum(d.values()) if sum(d.values()) else 0.0
    cut = sum(n for (a, b), n in pairs.items() if a != b)
    return {"vertices": vertices, "edges": edges, "edge_cut": cut, "vertex_balance": rate(vertices), "edge_balance": rate(edges), "total_vertices": sum(vertices.values()), "total_edges": sum(edges.values())}


def phase_report(counts: DataFrame, parts: int) -> DataFrame:
    """One row with the metrics of an initial partition, from its label_counts, and its per-part counts as arrays; total_edges counts all edges, cut ones too."""
    m = summed_up(counts, parts)
    row = (m["edge_cut"], m["vertex_balance"], m["edge_balance"], m["total_vertices"], m["total_edges"] + m["edge_cut"], [m["vertices"][p] for p in range(parts)], [m["edges"][p] for p in range(parts)])
    return counts.sparkSession.createDataFrame([row], "edge_cut long, vertex_balance double, edge_balance double, total_vertices long, total_edges long, part_vertices array<long>, part_edges array<long>")


def comparison_report(graph: Graph, before: DataFrame, after: DataFrame, parts: int, times_ms: tuple[float, float] | None = None) -> DataFrame:
    """(metric, phase1, phase2, improvement_pct, verdict) for cut, balances and, if given, both phases' times; what is not improved is worsened, also if equal."""
    a, b = measure(graph, before, parts), measure(graph, after, parts)
    rows = []
    told = [(k, float(a[k]), float(b[k])) for k in ("edge_cut", "vertex_balance", "edge_balance")]
    for k, x, y in told + ([("time_ms", *map(float, times_ms))] if times_ms else []):
        rows.append((k, round(x, 6), round(y, 6), round((x - y) / x * 100 if x else 0.0, 4), "improved" if x > y else "worsened"))
    return before.sparkSession.createDataFrame(rows, "metric string, phase1 double, phase2 double, improvement_pct double, verdict string")

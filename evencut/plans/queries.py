"""The registered queries of the graph engine: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.config import PartitionConfig
from evencut.functions.loop import materialize, new_path
from evencut.operators import graph as g
from evencut.operators import hubs, initial, layout, metrics, refine, traverse
from evencut.plans.sweep import sweep
from evencut.sources import tables, text

P, THETA, RANKS = 4, 1000, 4



def _ids(spark, found) -> DataFrame:
    return spark.createDataFrame([(i, s) for i, s in enumerate(found)], "position int, id long")


def _modulo(spark, d):
    graph = tables.order_part(spark, d)
    return graph, initial.modulo_labels(graph, P)


def edges_normalized(spark, d):
    return tables.order_part(spark, d).edges


def arcs_per_vertex(spark, d):
    return tables.order_part(spark, d).arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("arcs"))


def adjacency_lists(spark, d):
    return g.adjacency(tables.order_part(spark, d)).select("id", F.concat_ws(" ", "nbrs").alias("nbrs"))


def adjacency_lists_cleaned(spark, d):
    """Neighbour lists built from raw rows and cleaned as lists."""
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    raw = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey") + n).alias("raw"))
    return raw.select("id", F.concat_ws(" ", g.clean_list(F.col("raw"), F.col("id"))).alias("nbrs"))


def vertex_degrees(spark, d):
    return g.degrees(tables.order_part(spark, d))


def graph_summary(spark, d):
    return g.graph_summary(tables.order_part(spark, d))


def graph_summary_dense(spark, d):
    return g.graph_summary(tables.part_part(spark, d))


def graph_summary_cust_supp(spark, d):
    return g.graph_summary(tables.cust_supp(spark, d))


def graph_summary_cust_part(spark, d):
    return g.graph_summary(tables.cust_part(spark, d))


def conversion_stats(spark, d):
    return g.conversion_stats(tables.order_part(spark, d))


def lorenz_curve(spark, d):
    return hubs.lorenz_curve(g.degrees(tables.order_part(spark, d)))


def hub_nodes(spark, d):
    return hubs.hub_nodes(g.degrees(tables.order_part(spark, d)))


def first_seed(spark, d):
    return hubs.first_seed(g.degrees(tables.order_part(spark, d)))


def _first(spark, d):
    graph = tables.order_part(spark, d).kept()
    deg = g.degrees(graph)
    return graph, deg, hubs.first_seed(deg)


def bfs_levels(spark, d):
    graph, _, s = _first(spark, d)
    return traverse.bfs_levels(graph, s, 3)


def coverage_ball(spark, d):
    graph, _, s = _first(spark, d)
    return traverse.coverage_ball(graph, s)


def next_seed(spark, d):
    graph, deg, s = _first(spark, d)
    return hubs.hub_nodes(deg).join(traverse.coverage_ball(graph, s), "id", "left_anti").orderBy(F.desc("degree"), "id").limit(1)


def seeds_p4(spark, d):
    graph = tables.order_part(spark, d).kept()
    return _ids(spark, traverse.find_seeds(graph, g.degrees(graph), P))


def seeds_topup_dense(spark, d):
    graph = tables.cust_supp(spark, d).kept()
    return _ids(spark, traverse.find_seeds(graph, g.degrees(graph), P))


def modulo_labels(spark, d):
    return _modulo(spark, d)[1]


def rank_ownership(spark, d):
    return g.owners(tables.order_part(spark, d), RANKS).groupBy("owner").agg(F.count("*").alias("vertices"))


def edge_cut(spark, d):
    return metrics.edge_cut(*_modulo(spark, d))


def part_vertex_counts(spark, d):
    return metrics.part_vertex_counts(_modulo(spark, d)[1], P)


def part_edge_counts(spark, d):
    return metrics.part_edge_counts(*_modulo(spark, d), P)


def part_balance(spark, d):
    return metrics.balance(metrics.part_stats(*_modulo(spark, d), P), P)


def label_ratios(spark, d):
    return metrics.label_ratios(metrics.part_stats(*_modulo(spark, d), P), P)


def partition_summary(spark, d):
    graph, labels = _modulo(spark, d)
    return metrics.partition_summary(labels.unionByName(labels.filter("id % 3 = 0")), P, graph.n)  # a repeated vertex counts once


def penalties_iter1(spark, d):
    return refine.penalty_frame(*_modulo(spark, d), P, 1)


def penalties_iter5(spark, d):
    return refine.penalty_frame(*_modulo(spark, d), P, 5)


def boundary_vertices(spark, d):
    graph, labels = _modulo(spark, d)
    return refine.boundary(refine.vertex_scores(graph, labels, P)).select("id", "label")


def _chosen(spark, d):
    graph, labels = _modulo(spark, d)
    graph = graph.kept()
    m = metrics.measure(graph, labels, P)
    pen, re = refine.penalties(m["vertices"], m["edges"], P, 1)
    scores = materialize(refine.vertex_scores(graph, labels, P), "scores")
    return graph, labels, refine.select_boundary(refine.boundary(scores), re, 1), pen


def boundary_selected_iter1(spark, d):
    return _chosen(spark, d)[2].select("id", "label")


def boundary_candidates(spark, d):
    graph, _, chosen, _ = _chosen(spark, d)
    return refine.candidates(graph, chosen)


def boundary_subgraph(spark, d):
    graph, labels, chosen, _ = _chosen(spark, d)
    return refine.boundary_subgraph(graph, chosen, labels)


def neighbor_label_scores(spark, d):
    return refine.label_rows(refine.vertex_scores(*_modulo(spark, d), P))


def lp_step(spark, d):
    _, _, chosen, pen = _chosen(spark, d)
    return refine.lp_moves(chosen, pen)


def lp_apply_deltas(spark, d):
    _, labels, chosen, pen = _chosen(spark, d)
    return refine.apply_deltas(labels, refine.lp_moves(chosen, pen))


def lp_3_iters(spark, d):
    graph, labels = _modulo(spark, d)
    return refine.refine(graph.kept(), labels, PartitionConfig(parts=P, max_iter=3))[0]


def refine_full(spark, d):
    graph, labels = _modulo(spark, d)
    return refine.refine(graph.kept(), labels, PartitionConfig(parts=P))[0]


def refine_trace(spark, d):
    graph, labels = _modulo(spark, d)
    trace = refine.refine(graph.kept(), labels, PartitionConfig(parts=P))[1]
    return refine.trace_frame(spark, trace)


def comparison_report(spark, d):
    graph, labels = _modulo(spark, d)
    graph = graph.kept()
    return metrics.comparison_report(graph, labels, refine.refine(graph, labels, PartitionConfig(parts=P))[0], P)


def _seeded(spark, d):
    graph = tables.order_part(spark, d).kept()
    deg = materialize(g.degrees(graph), "degrees")
    labels = initial.start_labels(graph, traverse.find_seeds(graph, deg, P))
    frontier = labels.join(deg, "id").select(F.col("label").alias("part"), "id", "degree")
    return graph, deg, labels, frontier


def frontier_topk(spark, d):
    """The 5 lightest vertices of each part among all, as a frontier."""
    graph, labels = _modulo(spark, d)
    return initial.frontier_topk(g.degrees(graph).join(labels, "id").select(F.col("label").alias("part"), "id", "degree"), 5)


def expansion_claims(spark, d):
    graph, _, labels, frontier = _seeded(spark, d)
    return initial.claims(graph, frontier, labels)


def expansion_round1(spark, d):
    graph, _, labels, frontier = _seeded(spark, d)
    return initial.expand_round(graph, labels, frontier, initial.part_sizes(labels, P), THETA)


def expansion_full(spark, d):
    return initial.expansion(tables.order_part(spark, d), PartitionConfig(parts=P, mode="expand", theta=THETA))


def expansion_report(spark, d):
    cfg = PartitionConfig(parts=P, mode="expand", theta=THETA)
    told = metrics.phase_report(initial.expansion_counts(tables.order_part(spark, d), cfg), P)
    lists = [F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c) for c in ("part_vertices", "part_edges")]
    return told.select("edge_cut", "total_vertices", "total_edges", *[F.round(c, 6).alias(c) for c in ("vertex_balance", "edge_balance")], *lists)


def leftover_assign(spark, d):
    """Vertices that no round reaches, and the part that the leftover rule gives them to."""
    return initial.expansion(tables.order_part(spark, d), PartitionConfig(parts=P, mode="expand", theta=THETA), leave=True)


def ghosts_r3(spark, d):
    return layout.ghosts(*_modulo(spark, d), 3)


def csr_row_ptr_r3(spark, d):
    return layout.csr_row_ptr(*_modulo(spark, d), 3)


def csr_col_idx_r3(spark, d):
    return layout.csr_col_idx(*_modulo(spark, d), 3)


def adjacency_text_roundtrip(spark, d):
    path = new_path(spark, "adjacency")
    text.write_adjacency(tables.order_part(spark, d), path)
    return text.read_adjacency(spark, path, strict=True).edges


def directed_text_roundtrip(spark, d):
    """Orders with their parts as directed adjacency text, read as a normalised graph."""
    path, graph = new_path(spark, "directed"), tables.order_part(spark, d)
    text.write_adjacency(graph, path, graph.edges)
    return text.read_adjacency(spark, path, strict=True).edges


def properties_roundtrip(spark, d):
    path = new_path(spark, "properties")
    summary = g.graph_summary(tables.order_part(spark, d))
    pairs = F.explode(F.create_map(F.lit("nodes"), F.col("vertices"), F.lit("arcs"), 2 * F.col("edges")))
    text.write_properties(summary.select(pairs), path)
    return text.read_properties(spark, path)


def labels_roundtrip(spark, d):
    path = new_path(spark, "labels")
    text.write_labels(_modulo(spark, d)[1], path)
    return spark.read.parquet(path)


def merged_levels(spark, d):
    """Levels up to 2 from the first two seeds, found one by one."""
    graph = tables.order_part(spark, d).kept()
    found = traverse.find_seeds(graph, g.degrees(graph), 2)
    return traverse.merge_levels([traverse.bfs_levels(graph, spark.createDataFrame([(s,)], "id long"), 2) for s in found])


def sweep_rows(spark, d):
    rows = sweep(spark, {"order_part": tables.order_part(spark, d)}, modes=("modulo",), parts=(P,), thetas=(THETA,))
    return rows.select("graph", "mode", "parts", "theta", "cut1", "cut2", *[F.round(c, 6).alias(c) for c in ("vertex_balance", "edge_balance")], "iterations")


NAMES = """edges_normalized arcs_per_vertex adjacency_lists adjacency_lists_cleaned vertex_degrees graph_summary
graph_summary_dense graph_summary_cust_supp graph_summary_cust_part conversion_stats lorenz_curve hub_nodes first_seed
bfs_levels coverage_ball next_seed seeds_p4 seeds_topup_dense modulo_labels rank_ownership edge_cut part_vertex_counts
part_edge_counts part_balance label_ratios partition_summary penalties_iter1 penalties_iter5 boundary_vertices
boundary_selected_iter1 boundary_candidates boundary_subgraph neighbor_label_scores lp_step lp_apply_deltas lp_3_iters
refine_full refine_trace comparison_report frontier_topk expansion_claims expansion_round1 expansion_full
expansion_report leftover_assign ghosts_r3 csr_row_ptr_r3 csr_col_idx_r3 adjacency_text_roundtrip
directed_text_roundtrip properties_roundtrip labels_roundtrip merged_levels sweep_rows""".split()
QUERIES = {name: globals()[name] for name in NAMES}

"""Initial partitions: modulo labels and throttled multi-source expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evencut.config import PartitionConfig
from evencut.functions.loop import Loop
from evencut.operators import metrics, packed
from evencut.operators.graph import Graph, degrees
from evencut.operators.traverse import find_seeds


def modulo_labels(graph: Graph, parts: int) -> DataFrame:
    """(id, label) with label = id mod parts."""
    return graph.vertices.select("id", F.pmod("id", F.lit(parts)).cast("int").alias("label"))


def frontier_topk(frontier: DataFrame, theta: int) -> DataFrame:
    """The theta frontier vertices of lowest (degree, id) of each part."""
    w = Window.partitionBy("part").orderBy("degree", "id")
    return frontier.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= theta).drop("rn")


def claims(graph: Graph, picked: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, part): unlabelled neighbours of the picked vertices and who claims them."""
    near = graph.arcs.join(picked.select(F.col("id").alias("src"), "part"), "src").select(F.col("dst").alias("id"), "part")
    return near.distinct().join(labels.select("id"), "id", "left_anti")


def arbitrate(claimed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, label): each claimed vertex goes to the claiming part that is smallest, then lowest."""
    s = claimed.join(F.broadcast(sizes), "part")
    return s.groupBy("id").agg(F.min(F.struct("size", "part")).alias("b")).select("id", F.col("b.part").cast("int").alias("label"))


def part_sizes(labels: DataFrame, parts: int) -> DataFrame:
    """(part, size) with zero rows kept."""
    n = labels.groupBy("label").agg(F.count("*").alias("c"))
    return labels.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).join(n, F.col("part") == F.col("label"), "left").select("part", F.coalesce("c", F.lit(0)).alias("size"))


def start_labels(graph: Graph, seeds: list[int]) -> DataFrame:
    return graph.vertices.sparkSession.createDataFrame([(s, p) for p, s in enumerate(seeds)], "id long, label int")


def expand_round(graph: Graph, labels: DataFrame, frontier: DataFrame, sizes: DataFrame, theta: int) -> DataFrame:
    """(id, label) newly labelled in one round; sizes are those at its start."""
    return arbitrate(claims(graph, frontier_topk(frontier, theta), labels), sizes)


def next_frontier(frontier: DataFrame, new: DataFrame, deg: DataFrame, theta: int) -> DataFrame:
    """What was not picked, and the newly labelled."""
    carry = frontier.join(frontier_topk(frontier, theta).select("id"), "id", "left_anti")
    entering = new.select("id", F.col("label").alias("part")).join(deg, "id")
    return carry.select("part", "id", "degree").unionByName(entering.select("part", "id", "degree"))


def leftovers(graph: Graph, labels: DataFrame, size: dict[int, int]) -> DataFrame:
    """(id, label): the vertices without label, all of the part that is smallest, then lowest."""
    small = min(size, key=lambda p: (size[p], p))
    return graph.vertices.join(labels, "id", "left_anti").select("id", F.lit(small).cast("int").alias("label"))


def expansion(
    graph: Graph, cfg: PartitionConfig, seeds: list[int] | None = None, max_rounds: int | None = None, trace: list | None = None, leave: bool = False
) -> DataFrame:
    """(id, label) after multi-source expansion; when every frontier is empty, all leftovers go to the smallest part and expand on, or, if asked, only they are returned.

    Up to packed.VERTICES all rounds run in one task; beyond, each is a few Spark jobs.
    """
    if graph.n <= packed.VERTICES:
        seeds = _strict(graph, cfg) if seeds is None else seeds
        logged = trace is not None or cfg.verbose
        found = packed.expansion(graph, cfg.parts, cfg.theta, seeds, max_rounds, leave and not logged)
        if logged:
            _log_rounds(cfg, trace, found, graph.n, max_rounds, leave)
        return (found.filter("round < 0") if leave else found).select("id", "label")
    graph = graph.kept()
    loop = Loop(graph.vertices.sparkSession)
    deg = loop.put("degrees", degrees(graph))
    seeds = find_seeds(graph, deg, cfg.parts, cfg.strict_seeds) if seeds is None else seeds
    labels = loop.put("labels", start_labels(graph, seeds))
    frontier = loop.put("frontier", labels.join(deg, "id").select(F.col("label").alias("part"), "id", "degree"))
    size = {p: 0 for p in range(cfg.parts)} | {p: 1 for p in range(len(seeds))}
    rounds, waiting = 0, len(seeds)
    while sum(size.values()) < graph.n and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        if not waiting:
            rest = leftovers(graph, labels, size)
            if leave:
                return rest
            labels = loop.put("labels", labels.unionByName(rest))
            _log(cfg, trace, (rounds, "leftover", graph.n - sum(size.values())))
            break  # all are labelled: the same round would expand them without a further claim
        sizes = graph.vertices.sparkSession.createDataFrame(list(size.items()), "part int, size long")
        new = loop.put("new", expand_round(graph, labels, frontier, sizes, cfg.theta))
        frontier = loop.put("frontier", next_frontier(frontier, new, deg, cfg.theta))
        labels = loop.put("labels", labels.unionByName(new))
        for r in new.groupBy("label").count().collect():
            size[r.label] += r["count"]
        waiting = frontier.count()
        _log(cfg, trace, (rounds, "round", sum(size.values())))
    return labels if not leave else labels.limit(0)


def expansion_counts(graph: Graph, cfg: PartitionConfig) -> DataFrame:
    """(lu, lv, n): metrics.label_counts of an expansion; up to packed.VERTICES the task of its rounds counts them."""
    if graph.n <= packed.VERTICES:
        return packed.expansion_counts(graph, cfg.parts, cfg.theta, _strict(graph, cfg))
    graph = graph.kept()
    return metrics.label_counts(graph, expansion(graph, cfg))


def _strict(graph: Graph, cfg: PartitionConfig) -> list[int] | None:
    """The seeds, where too few are an error; else the task finds them."""
    if not cfg.strict_seeds:
        return None
    graph = graph.kept()
    return find_seeds(graph, degrees(graph), cfg.parts, strict=True)


def _log(cfg: PartitionConfig, trace: list | None, row: tuple) -> None:
    if trace is not None:
        trace.append(row)
    if cfg.verbose:
        print("round {}: {}, {}".format(*row))


def _log_rounds(cfg: PartitionConfig, trace: list | None, found: DataFrame, n: int, max_rounds: int | None, leave: bool) -> None:
    """The log of a loop whose rounds stand in a column."""
    new = {r["round"]: r["count"] for r in found.groupBy("round").count().collect()}
    last, total = min(new, default=0), new.get(0, 0)
    rounds = -last - 1 if last < 0 else max(new, default=0) if sum(new.values()) == n else max_rounds
    for k in range(1, rounds + 1):
        total += new.get(k, 0)
        _log(cfg, trace, (k, "round", total))
    if last < 0 and not leave:
        _log(cfg, trace, (-last, "leftover", n - total))


def initial_partition(graph: Graph, cfg: PartitionConfig) -> DataFrame:
    return modulo_labels(graph, cfg.parts) if cfg.mode == "modulo" else expansion(graph, cfg)

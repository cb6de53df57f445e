"""Golden values of the ten-vertex graph, edge cases and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from evencut.config import PartitionConfig
from evencut.functions.select import smallest_per_group
from evencut.operators import graph as g
from evencut.operators import hubs, initial, metrics, refine, traverse
from evencut.sources import text

TINY = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6), (6, 7), (7, 8), (6, 8)]


def make(spark, edges, n):
    return g.normalize(spark.createDataFrame(edges, "src long, dst long"), n)


@pytest.fixture(scope="module")
def tiny(spark):
    return make(spark, TINY, 10).kept()


def labels_of(df):
    return [r.label for r in df.orderBy("id").collect()]


def test_degrees_hubs_seeds(spark, tiny):
    d = g.degrees(tiny)
    assert [r.degree for r in d.orderBy("id").collect()] == [2, 2, 3, 3, 2, 3, 3, 2, 2, 0]
    assert [r.id for r in hubs.hub_nodes(d).orderBy(F.desc("degree"), "id").collect()] == [2, 3, 5, 6, 0, 1, 4, 7]
    assert traverse.find_seeds(tiny, d, 2) == [2, 6]


def test_modulo_refined(spark, tiny):
    first = initial.modulo_labels(tiny, 2)
    m = metrics.measure(tiny, first, 2)
    assert (m["edge_cut"], m["edges"], m["vertex_balance"]) == (8, {0: 2, 1: 1}, 1.0) and round(m["edge_balance"], 4) == 1.3333
    assert [round(x, 6) for x in refine.penalties(m["vertices"], m["edges"], 2, 1)[0]] == [-0.333333, 0.333333]
    last, trace = refine.refine(tiny, first, PartitionConfig(parts=2))
    assert labels_of(last) == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1]
    assert trace[-1][0] == 6 or trace[-1][5] == "empty boundary"
    assert metrics.measure(tiny, last, 2)["edge_cut"] == 1


def test_expansion(spark, tiny):
    trace = []
    got = initial.expansion(tiny, PartitionConfig(parts=2, mode="expand", theta=1), trace=trace)
    assert labels_of(got) == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]
    assert [t[1] for t in trace].count("leftover") == 1
    last, tr = refine.refine(tiny, got, PartitionConfig(parts=2))
    assert labels_of(last) == [0, 0, 0, 0, 0, 0, 1, 1, 1, 1] and tr[-1][5] == "no change"


def test_leftovers_of_a_component_without_seed(spark, capsys):
    graph = make(spark, [*TINY, (10, 11), (11, 12)], 14).kept()
    cfg = PartitionConfig(parts=2, mode="expand", theta=1, verbose=True)
    rest = initial.expansion(graph, cfg, seeds=[2, 6], leave=True)
    assert sorted(map(tuple, rest.collect())) == [(9, 1), (10, 1), (11, 1), (12, 1), (13, 1)]
    labels = {r.id: r.label for r in initial.expansion(graph, cfg, seeds=[2, 6]).collect()}
    assert [labels[i] for i in range(14)] == [0] * 5 + [1] * 9
    assert "leftover, 5" in capsys.readouterr().out
    first = initial.expansion(graph, cfg, seeds=[2, 6], max_rounds=1)
    assert sorted(map(tuple, first.collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (5, 1), (6, 1), (7, 1), (8, 1)]


def test_packed_expansion_equals_the_loop(spark, monkeypatch):
    rng = random.Random(8)
    graph = make(spark, list({(rng.randrange(30), rng.randrange(90)) for _ in range(140)}), 100).kept()
    for parts, theta, most, leave in ((4, 30, None, True), (3, 9, 2, False)):
        cfg, out = PartitionConfig(parts=parts, mode="expand", theta=theta), []
        for vertices in (1 << 24, -1):
            monkeypatch.setattr(initial.packed, "VERTICES", vertices)
            trace = []
            got = initial.expansion(graph, cfg, max_rounds=most, trace=trace, leave=leave)
            out.append((sorted(map(tuple, got.collect())), trace))
        assert out[0] == out[1], parts
    with pytest.raises(ValueError, match="only 1 seeds for 2 parts"):
        monkeypatch.setattr(initial.packed, "VERTICES", 1 << 24)
        star = make(spark, [(0, i) for i in range(1, 6)], 6)
        initial.expansion(star, PartitionConfig(parts=2, mode="expand", strict_seeds=True))


def test_neighbour_lists_of_repeated_pairs(spark, monkeypatch):
    import numpy as np

    rng = random.Random(4)
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(4000)] + [(7, i) for i in range(0, 2600)]
    graph = make(spark, pairs * 2 + [(b, a) for a, b in pairs], 3000)
    want = {}
    for a, b in pairs:
        if a != b:
            want.setdefault(a, set()).add(b)
            want.setdefault(b, set()).add(a)
    for arcs in (1 << 20, 300):  # in one piece, and in pieces that repeat each other
        monkeypatch.setattr(initial.packed, "ARCS", arcs)
        got = {}
        for row in initial.packed.neighbour_lists(graph).collect():
            ids, many, near = (np.frombuffer(x, "<i4").tolist() for x in row)
            for i, k in zip(ids, many, strict=True):
                assert i not in got
                got[i], near = near[:k], near[k:]
            assert not near
        assert got == {i: sorted(x) for i, x in want.items()}


def _tables_of(spark, name):
    """What a query returns at sf0.001, and the names of the tables that it wrote."""
    from evencut.functions import loop
    from evencut.plans.queries import QUERIES

    before = set(loop._made)
    out = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    return out, sorted(p.rpartition("/")[2].rpartition("-")[0] for p in set(loop._made) - before)


def test_report_writes_no_edges_and_joins_no_labels(spark, monkeypatch):
    out, made = _tables_of(spark, "expansion_report")
    assert made == ["counts", "lists"]
    monkeypatch.setattr(initial.packed, "VERTICES", -1)
    assert _tables_of(spark, "expansion_report")[0] == out
    monkeypatch.setattr(initial.packed, "VERTICES", 1 << 24)
    graph, cfg = make(spark, [*TINY, *TINY, (10, 11)], 13), PartitionConfig(parts=3, mode="expand", theta=1)
    rows = lambda df: sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())
    assert rows(initial.expansion_counts(graph, cfg)) == rows(metrics.label_counts(graph, initial.expansion(graph, cfg)))


def test_frontier_keeps_its_order():
    import numpy as np

    rng, f, waiting = random.Random(2), initial.packed.Frontier(2), []
    for k in range(0, 6000, 20):
        new = [(rng.randrange(50), k + i) for i in range(rng.choice((0, 3, 20)))]
        f.push(np.array([i for _, i in new], np.int64), np.array([d for d, _ in new], np.int64))
        waiting = sorted(waiting + new)
        assert f.pop().tolist() == [i for _, i in waiting[:2]] and len(f) == len(waiting[2:])
        waiting = waiting[2:]


def test_many_rounds_are_few_jobs(spark):
    n = 200
    graph = make(spark, [(i, i + 1) for i in range(n - 2)], n).kept()  # a path, and one vertex alone
    spark.sparkContext.setJobGroup("rounds", "")
    labels = {r.id: r.label for r in initial.expansion(graph, PartitionConfig(parts=2, mode="expand", theta=1), seeds=[0, n - 2]).collect()}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [labels[i] for i in range(n)] == [0] * 100 + [1] * 99 + [1]


def test_leftovers_after_many_rounds_are_few_jobs(spark):
    graph = make(spark, [(i, i + 1) for i in range(98)], 102).kept()
    spark.sparkContext.setJobGroup("leftovers", "")
    rest = initial.expansion(graph, PartitionConfig(parts=2, mode="expand", theta=1), seeds=[0, 98], leave=True).collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("leftovers")) < 20
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(tuple, rest)) == [(99, 1), (100, 1), (101, 1)]


def test_leftovers_write_no_edges(spark):
    assert _tables_of(spark, "leftover_assign")[1] == ["labels", "lists"]


def test_leftovers_are_written_alone(spark):
    graph = make(spark, [(i, i + 1) for i in range(8)], 12)
    rest = initial.packed.expansion(graph, 2, 1, [0, 8], None, leave=True)
    assert sorted(r.id for r in rest.collect()) == [9, 10, 11]


def test_distinct_keys_take_about_a_sort():
    import time

    import numpy as np

    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 24, 1 << 20) << 32 | rng.integers(0, 1 << 24, 1 << 20)
    least = {f: math.inf for f in (np.sort, initial.packed.distinct)}
    for f in 3 * list(least):
        began = time.process_time()
        f(keys)
        least[f] = min(least[f], time.process_time() - began)
    assert least[initial.packed.distinct] < 8 * least[np.sort]
    for some in (keys[:0], keys[:1], np.array([3, 1, 3, 1, 2])):
        assert initial.packed.distinct(some).tolist() == sorted(set(some.tolist()))


def test_refinement_needs_labels(spark, tiny, capsys):
    for bad in (initial.modulo_labels(tiny, 2).filter("id > 0"), initial.modulo_labels(tiny, 2).selectExpr("id", "IF(id = 3, null, label) AS label")):
        with pytest.raises(ValueError):
            refine.refine(tiny, bad, PartitionConfig(parts=2))
    refine.refine(tiny, initial.modulo_labels(tiny, 2), PartitionConfig(parts=2, verbose=True))
    assert "iteration 1: " in capsys.readouterr().out


def test_equal_values_are_worsened(spark, tiny):
    same = initial.modulo_labels(tiny, 2)
    rows = metrics.comparison_report(tiny, same, same, 2, (5.0, 4.0)).collect()
    assert [r.verdict for r in rows] == ["worsened"] * 3 + ["improved"]


def test_tables_are_dropped(spark, tiny, tmp_path):
    from evencut.functions import loop

    kept = dict(loop._made)
    loop._made.clear()
    df = loop.materialize(spark.range(3))
    files, at = next(iter(loop._made.values()))
    out = loop.settle(lambda: loop.materialize(df).filter("id > 0"), "out")
    assert len(loop._made) == 2 and out.count() == 2
    loop.drop_tables()
    assert not loop._made and not files.exists(at)
    loop._made.update(kept)


def test_cleaning(spark):
    graph = make(spark, [(0, 0), (0, 1), (1, 0), (0, 1), (1, 7), (-1, 0), (None, 1)], 3)
    assert [tuple(r) for r in graph.edges.collect()] == [(0, 1)]


@pytest.mark.parametrize("edges,n,parts", [([], 0, 2), ([], 1, 2), ([], 4, 2), ([(0, 1)], 2, 5), ([(0, i) for i in range(1, 8)], 8, 1), ([(0, 1), (2, 3)], 4, 2)])
def test_odd_graphs(spark, edges, n, parts):
    graph = make(spark, edges, n).kept()
    for cfg in (PartitionConfig(parts=parts), PartitionConfig(parts=parts, mode="expand", theta=2)):
        first = initial.initial_partition(graph, cfg)
        assert first.count() == n
        last, _ = refine.refine(graph, first, cfg)
        m = metrics.measure(graph, last, parts)
        assert m["total_vertices"] == n and m["edge_cut"] + m["total_edges"] == len(edges)


def test_strict_seeds(spark):
    star = make(spark, [(0, i) for i in range(1, 6)], 6)
    with pytest.raises(ValueError):
        traverse.find_seeds(star, g.degrees(star), 3, strict=True)
    assert traverse.find_seeds(star, g.degrees(star), 3) == [0, 1, 2]


@pytest.mark.parametrize("bad", [{"parts": 0}, {"mode": "x"}, {"mode": "expand", "theta": 0}, {"patience": 0}])
def test_config(bad):
    with pytest.raises(ValueError):
        PartitionConfig(**bad)


def test_penalties_balance():
    pen, re = refine.penalties({0: 3, 1: 5, 2: 1}, {0: 2, 1: 9, 2: 4}, 3, 2)
    assert abs(sum(pen)) < 1e-9 and abs(sum(re) / 3 - 1) < 1e-12


def test_random_graph_against_plain_python(spark, monkeypatch):
    rng = random.Random(5)
    n, edges = 60, list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
    graph = make(spark, edges, n).kept()
    labels = {i: i % 3 for i in range(n)}
    near = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    pen = [0.1, -0.2, 0.1]
    want = {}
    for u in range(n):
        count = {l: sum(labels[v] == l for v in near[u]) for l in range(3)}
        best = max((l for l in range(3) if count[l]), key=lambda l: (count[l] * (1 + pen[l]), -l), default=None)
        if best is not None and any(labels[v] != labels[u] for v in near[u]) and best != labels[u] and count[best] * (1 + pen[best]) > count[labels[u]]:
            want[u] = best
    df = initial.modulo_labels(graph, 3)
    for wide in (64, 1):  # labels counted as columns, and as rows
        monkeypatch.setattr(refine, "WIDE", wide)
        scores = refine.vertex_scores(graph, df, 3)
        assert {r.id: r.label for r in refine.lp_moves(refine.boundary(scores), pen).collect()} == want


def test_smallest_per_group(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), rng.randrange(4), i * 40_000) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, id long")
    wanted = spark.createDataFrame([(0, 7), (1, 0), (2, 500)], "g int, k long")
    got = sorted(tuple(r) for r in smallest_per_group(df, "g", "o", wanted).collect())
    want = sorted(x for p, k in ((0, 7), (2, 500)) for x in sorted(r for r in rows if r[0] == p)[:k])
    assert got == want
    for share in (0.0, 0.3, 1.0):
        got = sorted(tuple(r) for r in smallest_per_group(df, "g", "o", share).collect())
        sizes = [[r for r in rows if r[0] == k] for k in range(3)]
        assert got == sorted(x for r in sizes for x in sorted(r)[: math.ceil(share * len(r))])


def test_text_round_trip(spark, tiny, tmp_path):
    text.write_adjacency(tiny, str(tmp_path / "a"))
    back = text.read_adjacency(spark, str(tmp_path / "a"), strict=True)
    assert back.n == 10 and sorted(map(tuple, back.edges.collect())) == sorted(TINY)
    (tmp_path / "b.txt").write_bytes(b"3\r\n 1  2 9\r\n\r\n0 2")
    b = text.read_adjacency(spark, str(tmp_path / "b.txt"))
    assert b.n == 3 and sorted(map(tuple, b.edges.collect())) == [(0, 1), (0, 2)]
    (tmp_path / "c.txt").write_text("x\n")
    with pytest.raises(ValueError):
        text.read_adjacency(spark, str(tmp_path / "c.txt"))


def test_properties(spark, tmp_path):
    (tmp_path / "p").write_text("#c\nnodes=5\narcs = 7\n")
    assert sorted(map(tuple, text.read_properties(spark, str(tmp_path / "p")).collect())) == [("arcs", "7"), ("nodes", "5")]


def test_sweep(spark, tiny):
    from evencut.plans.sweep import sweep

    assert sweep(spark, {"tiny": tiny}, parts=(2,), thetas=(1,)).count() == 2

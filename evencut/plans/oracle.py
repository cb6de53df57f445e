"""DuckDB SQL for each query of the graph engine, written from the rules of the survey; loops are unrolled."""

from __future__ import annotations

P, THETA, ROUNDS, ITERS = 4, 1000, 14, 16

SIZES = """no AS MATERIALIZED (SELECT count(*)::BIGINT AS n FROM orders), np AS MATERIALIZED (SELECT count(*)::BIGINT AS n FROM part),
nc AS MATERIALIZED (SELECT count(*)::BIGINT AS n FROM customer), ns AS MATERIALIZED (SELECT count(*)::BIGINT AS n FROM supplier)"""
RAW = {
    "op": ("SELECT l_orderkey AS a, l_partkey + (SELECT n FROM no) AS b FROM lineitem", "(SELECT n FROM no) + (SELECT n FROM np)"),
    "cs": ("SELECT o_custkey AS a, l_suppkey + (SELECT n FROM nc) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "(SELECT n FROM nc) + (SELECT n FROM ns)"),
    "cp": ("SELECT o_custkey AS a, l_partkey + (SELECT n FROM nc) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "(SELECT n FROM nc) + (SELECT n FROM np)"),
    "pp": ("SELECT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey", "(SELECT n FROM np)"),
}


def base(kind: str = "op") -> list[str]:
    raw, n = RAW[kind]
    return [
        SIZES,
        f"nv AS MATERIALIZED (SELECT ({n})::BIGINT AS n)",
        f"raw AS ({raw})",
        "e AS MATERIALIZED (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM raw WHERE a <> b AND a BETWEEN 0 AND (SELECT n FROM nv) - 1 AND b BETWEEN 0 AND (SELECT n FROM nv) - 1)",
        "arc AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)",
        "v AS MATERIALIZED (SELECT range AS id FROM range((SELECT n FROM nv)))",
        "deg AS MATERIALIZED (SELECT v.id, coalesce(c, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT src, count(*) AS c FROM arc GROUP BY 1) x ON x.src = v.id)",
    ]


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


HUBS = "hub AS MATERIALIZED (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT (SELECT CASE WHEN coalesce(max(degree), 0) = 0 OR count(*) < 2 THEN 0 ELSE (sum(degree) + max(degree) - 1) // max(degree) END::BIGINT FROM deg))"
FIRST = "s0 AS MATERIALIZED (SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 1)"
MOD = f"l0 AS MATERIALIZED (SELECT id, (id % {P})::INTEGER AS label FROM v)"


def ball(name: str, seed: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT id FROM {seed} UNION SELECT dst FROM arc JOIN {seed} ON src = id UNION SELECT b.dst FROM arc a JOIN {seed} ON a.src = id JOIN arc b ON b.src = a.dst)"


def seeds(parts: int = P) -> list[str]:
    """seeds(position, id): uncovered hubs first, then uncovered vertices, then any."""
    out = [HUBS, FIRST, ball("b0", "s0")]
    for k in range(1, parts):
        used = " UNION ALL ".join(f"SELECT id FROM s{j}" for j in range(k))
        cov = " UNION ".join(f"SELECT id FROM b{j}" for j in range(k))
        out.append(
            f"s{k} AS MATERIALIZED (SELECT id, degree FROM (SELECT deg.*, CASE WHEN id IN ({cov}) THEN 2 WHEN id IN (SELECT id FROM hub) THEN 0 ELSE 1 END AS step FROM deg "
            f"WHERE id NOT IN ({used})) ORDER BY step, degree DESC, id LIMIT 1)"
        )
        out.append(ball(f"b{k}", f"s{k}"))
    out.append("seeds AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS position, id FROM s{k}" for k in range(parts)) + ")")
    return out


def stats(i: int, labels: str) -> list[str]:
    """pe(lu, lv, n), st(label, vertices, edges) and cut of a labelling."""
    return [
        f"pe{i} AS MATERIALIZED (SELECT x.label AS lu, y.label AS lv, count(*)::BIGINT AS n FROM e JOIN {labels} x ON x.id = src JOIN {labels} y ON y.id = dst GROUP BY 1, 2)",
        f"st{i} AS MATERIALIZED (SELECT r.range::INTEGER AS label, coalesce(a.c, 0)::BIGINT AS vertices, coalesce(b.n, 0)::BIGINT AS edges FROM range({P}) r LEFT JOIN (SELECT label, count(*) AS c FROM {labels} GROUP BY 1) a ON a.label = r.range LEFT JOIN pe{i} b ON b.lu = r.range AND b.lv = r.range)",
        f"cut{i} AS MATERIALIZED (SELECT coalesce(sum(n) FILTER (lu <> lv), 0)::BIGINT AS cut FROM pe{i})",
    ]


def penalty(i: int, name: str, it: int) -> list[str]:
    return [
        f"rr{name} AS MATERIALIZED (SELECT label, CASE WHEN sum(vertices) OVER () > 0 THEN vertices / (sum(vertices) OVER () / {P}.0::DOUBLE) ELSE 0 END::DOUBLE AS rv, CASE WHEN sum(edges) OVER () > 0 THEN edges / (sum(edges) OVER () / {P}.0::DOUBLE) ELSE 0 END::DOUBLE AS re FROM st{i})",
        f"pn{name} AS MATERIALIZED (SELECT label, re, round((CASE WHEN vv + ve > 0 THEN vv / (vv + ve) * (1 - rv) + ve / (vv + ve) * (1 - re) ELSE 0 END) * (1 + ln({it}::DOUBLE)), 12) AS pen FROM rr{name}, (SELECT var_pop(rv) AS vv, var_pop(re) AS ve FROM rr{name}))",
    ]


def iteration(i: int, labels: str, it: int, chained: bool) -> list[str]:
    """One refinement step from labelling l{i}, giving l{i+1}, mv{i} and the stop flag; it counts from 1."""
    cand = "(SELECT id FROM v)" if not chained else f"(SELECT id FROM sel{i - 1} UNION SELECT dst FROM arc WHERE src IN (SELECT id FROM sel{i - 1}))"
    go = "" if not chained else f" AND (SELECT go FROM fl{i})"
    return [
        *stats(i, labels),
        *penalty(i, str(i), it),
        f"sc{i} AS MATERIALIZED (SELECT a.src AS id, y.label AS lv, count(*)::BIGINT AS c FROM arc a JOIN {labels} y ON y.id = a.dst WHERE a.src IN {cand}{go} GROUP BY 1, 2)",
        f"bd{i} AS MATERIALIZED (SELECT DISTINCT s.id, x.label FROM sc{i} s JOIN {labels} x USING (id) WHERE s.lv <> x.label)",
        f"sel{i} AS MATERIALIZED (SELECT id, label FROM (SELECT b.id, b.label, row_number() OVER (PARTITION BY b.label ORDER BY CASE WHEN p.re > 1 THEN -degree ELSE degree END, b.id) AS rn, ceil(exp(-{it} / 5.0::DOUBLE) * count(*) OVER (PARTITION BY b.label)) AS k FROM bd{i} b JOIN deg USING (id) JOIN pn{i} p ON p.label = b.label) WHERE rn <= k)",
        f"cs{i} AS MATERIALIZED (SELECT s.id, s.lv, s.c, s.c * (1 + p.pen) AS score, x.label AS own FROM sc{i} s JOIN sel{i} x USING (id) JOIN pn{i} p ON p.label = s.lv)",
        f"mv{i} AS MATERIALIZED (SELECT id, lv::INTEGER AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, lv) AS rn, coalesce(max(c) FILTER (lv = own) OVER (PARTITION BY id), 0) AS mine FROM cs{i}) WHERE rn = 1 AND score > mine AND lv <> own)",
        f"l{i + 1} AS MATERIALIZED (SELECT x.id, coalesce(m.label, x.label) AS label FROM {labels} x LEFT JOIN mv{i} m USING (id))",
    ]


def refinement(n: int) -> list[str]:
    """n iterations from l0. fl{i}: whether iteration i runs, and the calm streak before it."""
    out = [MOD, "fl0 AS MATERIALIZED (SELECT true AS go, 0 AS calm)"]
    for i in range(n):
        out += iteration(i, f"l{i}", i + 1, i > 0)
        out += [f"nc{i} AS MATERIALIZED (SELECT count(*) FILTER (x.label <> y.label)::BIGINT AS cut FROM (SELECT src, dst, a.label FROM e JOIN l{i + 1} a ON a.id = src) x JOIN l{i + 1} y ON y.id = x.dst)"]
        out += [
            f"fl{i + 1} AS MATERIALIZED (SELECT go AND (SELECT count(*) FROM mv{i}) > 0 AND c < 10 AS go, c AS calm FROM (SELECT go, CASE WHEN CASE WHEN (SELECT cut FROM cut{i}) = 0 THEN 1 ELSE abs((SELECT cut FROM nc{i}) - (SELECT cut FROM cut{i})) / (SELECT cut FROM cut{i})::DOUBLE END < 0.03 THEN calm + 1 ELSE 0 END AS c FROM fl{i}))"
        ]
    return out


def expansion(rounds: int) -> list[str]:
    """xl{k}: labels after k rounds; the leftover rule fires in the round whose frontier is empty."""
    out = [*seeds(), "xl0 AS MATERIALIZED (SELECT id, position::INTEGER AS label FROM seeds)", "xf0 AS MATERIALIZED (SELECT label AS part, id, degree FROM xl0 JOIN deg USING (id))"]
    for k in range(rounds):
        out += [
            f"sz{k} AS MATERIALIZED (SELECT r.range::INTEGER AS part, coalesce(c, 0) AS size FROM range({P}) r LEFT JOIN (SELECT label, count(*) AS c FROM xl{k} GROUP BY 1) x ON x.label = r.range)",
            f"pk{k} AS MATERIALIZED (SELECT part, id, degree FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY degree, id) AS rn FROM xf{k}) WHERE rn <= {THETA})",
            f"cl{k} AS MATERIALIZED (SELECT DISTINCT a.dst AS id, p.part FROM arc a JOIN pk{k} p ON p.id = a.src WHERE a.dst NOT IN (SELECT id FROM xl{k}))",
            f"nw{k} AS MATERIALIZED (SELECT id, part AS label FROM (SELECT c.id, c.part, row_number() OVER (PARTITION BY c.id ORDER BY size, c.part) AS rn FROM cl{k} c JOIN sz{k} USING (part)) WHERE rn = 1)",
            f"lo{k} AS MATERIALIZED (SELECT id, (SELECT part FROM sz{k} ORDER BY size, part LIMIT 1) AS label FROM v WHERE (SELECT count(*) FROM xf{k}) = 0 AND id NOT IN (SELECT id FROM xl{k}))",
            f"xl{k + 1} AS MATERIALIZED (SELECT id, label FROM xl{k} UNION ALL SELECT id, label FROM nw{k} UNION ALL SELECT id, label FROM lo{k})",
            f"xf{k + 1} AS MATERIALIZED (SELECT part, id, degree FROM xf{k} WHERE id NOT IN (SELECT id FROM pk{k}) UNION ALL SELECT label, id, degree FROM nw{k} JOIN deg USING (id))",
        ]
    return out


def summary(kind: str) -> str:
    return query(base(kind), "SELECT count(*)::BIGINT AS vertices, (sum(degree) // 2)::BIGINT AS edges, max(degree)::BIGINT AS max_degree, count(*) FILTER (degree = 0) AS dangling, round(2.0::DOUBLE * (sum(degree) // 2)::BIGINT / count(*), 3) AS avg_degree, round(100.0::DOUBLE * (count(*) FILTER (degree = 0)) / count(*), 2) AS dangling_pct FROM deg")


def sqls() -> dict[str, str]:
    b, one = base(), [*base(), MOD]
    it1 = [*one, *iteration(0, "l0", 1, False)]
    gh = "gh AS MATERIALIZED (SELECT DISTINCT (src % 3)::INTEGER AS rank, dst AS gid FROM arc WHERE src % 3 <> dst % 3)"
    ptr = "ptr AS MATERIALIZED (SELECT (id % 3)::INTEGER AS rank, (id // 3)::BIGINT AS local_idx, id AS gid, label, (sum(degree) OVER w - degree)::BIGINT AS row_start, (sum(degree) OVER w)::BIGINT AS row_end FROM deg JOIN l0 USING (id) WINDOW w AS (PARTITION BY id % 3 ORDER BY id))"
    full = [*base(), *refinement(ITERS)]
    still = lambda i: f"(SELECT count(*) FROM mv{i}) = 0"
    calm = lambda i: f"CASE WHEN {still(i)} THEN (SELECT calm FROM fl{i}) ELSE (SELECT calm FROM fl{i + 1}) END"
    trace = " UNION ALL ".join(
        f"SELECT {i + 1}::INTEGER AS iter, (SELECT count(*) FROM mv{i})::BIGINT AS moves, cut AS edge_cut, "
        f"round(CASE WHEN {still(i)} THEN 0 WHEN (SELECT cut FROM cut{i}) = 0 THEN 1 ELSE abs(cut - (SELECT cut FROM cut{i})) / (SELECT cut FROM cut{i})::DOUBLE END, 6) AS rel_change, "
        f"({calm(i)})::INTEGER AS streak, "
        f"CASE WHEN {still(i)} THEN CASE WHEN (SELECT count(*) FROM sel{i}) = 0 THEN 'empty boundary' ELSE 'no change' END WHEN {calm(i)} >= 10 THEN 'patience' ELSE '' END AS stop "
        f"FROM nc{i} WHERE (SELECT go FROM fl{i})"
        for i in range(ITERS)
    )
    pen = lambda it: query([*one, *stats(0, "l0"), *penalty(0, "x", it)], "SELECT label, round(pen, 6) AS penalty, round(re, 6) AS re FROM pnx")
    last = f"l{ITERS}"
    both = [*full, *stats(900, "l0"), *stats(901, last)]
    bal = lambda i, c: f"(SELECT max({c}) * {P}.0::DOUBLE / sum({c}) FROM st{i})"
    cmp_rows = [("edge_cut", "(SELECT cut FROM cut900)::DOUBLE", "(SELECT cut FROM cut901)::DOUBLE")] + [(f"{n}_balance", bal(900, c), bal(901, c)) for n, c in (("vertex", "vertices"), ("edge", "edges"))]
    ex = [*base(), *expansion(ROUNDS)]
    return {
        "edges_normalized": query(b, "SELECT src, dst FROM e"),
        "arcs_per_vertex": query(b, "SELECT src AS id, count(*) AS arcs FROM arc GROUP BY 1"),
        "adjacency_lists": query(b, "SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM arc GROUP BY 1"),
        "adjacency_lists_cleaned": query(b, "SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS nbrs FROM e GROUP BY 1"),
        "vertex_degrees": query(b, "SELECT id, degree FROM deg"),
        "graph_summary": summary("op"),
        "graph_summary_dense": summary("pp"),
        "graph_summary_cust_supp": summary("cs"),
        "graph_summary_cust_part": summary("cp"),
        "conversion_stats": query(b, "SELECT (SELECT count(*) FROM e) AS unique_edges, count(*) FILTER (degree > 0) AS non_empty, count(*) FILTER (degree = 0) AS empty, ((SELECT sum(length(dst::VARCHAR) + 1) FROM arc) + count(*) FILTER (degree = 0) + length(count(*)::VARCHAR) + 1)::BIGINT AS text_bytes FROM deg"),
        "lorenz_curve": query(b, "SELECT id, degree, row_number() OVER w AS pos, (sum(degree) OVER w)::BIGINT AS cum, round(row_number() OVER w / (count(*) OVER ())::DOUBLE, 6) AS x, round((sum(degree) OVER w)::BIGINT / (sum(degree) OVER ())::DOUBLE, 6) AS y FROM deg WINDOW w AS (ORDER BY degree, id ROWS UNBOUNDED PRECEDING)"),
        "hub_nodes": query([*b, HUBS], "SELECT id, degree FROM hub"),
        "first_seed": query([*b, FIRST], "SELECT id, degree FROM s0"),
        "bfs_levels": query([*b, FIRST], "SELECT id, min(level)::INTEGER AS level FROM (SELECT id, 0 AS level FROM s0 UNION ALL SELECT dst, 1 FROM arc JOIN s0 ON src = id UNION ALL SELECT b.dst, 2 FROM arc a JOIN s0 ON a.src = id JOIN arc b ON b.src = a.dst UNION ALL SELECT c.dst, 3 FROM arc a JOIN s0 ON a.src = id JOIN arc b ON b.src = a.dst JOIN arc c ON c.src = b.dst) GROUP BY 1"),
        "coverage_ball": query([*b, FIRST, ball("b0", "s0")], "SELECT id FROM b0"),
        "next_seed": query([*b, *seeds(2)], "SELECT id, degree FROM s1"),
        "seeds_p4": query([*b, *seeds()], "SELECT position, id FROM seeds"),
        "seeds_topup_dense": query([*base("cs"), *seeds()], "SELECT position, id FROM seeds"),
        "modulo_labels": query(one, "SELECT id, label FROM l0"),
        "rank_ownership": query(b, "SELECT (id % 4)::INTEGER AS owner, count(*) AS vertices FROM v GROUP BY 1"),
        "edge_cut": query([*one, *stats(0, "l0")], "SELECT cut AS edge_cut FROM cut0"),
        "part_vertex_counts": query([*one, *stats(0, "l0")], "SELECT label, vertices FROM st0"),
        "part_edge_counts": query([*one, *stats(0, "l0")], "SELECT label, edges FROM st0"),
        "part_balance": query([*one, *stats(0, "l0")], f"SELECT round({bal(0, 'vertices')}, 6) AS vertex_balance, round({bal(0, 'edges')}, 6) AS edge_balance"),
        "label_ratios": query([*one, *stats(0, "l0"), *penalty(0, "x", 1)], "SELECT label, vertices, edges, round(rv, 6) AS rv, round(re, 6) AS re FROM st0 JOIN rrx USING (label)"),
        "partition_summary": query([*one, *stats(0, "l0")], f"SELECT sum(vertices)::BIGINT AS total, min(vertices) AS min_size, max(vertices) AS max_size, round(avg(vertices), 6) AS avg_size, round(stddev_pop(vertices), 6) AS stddev, round(max(vertices) * {P}.0::DOUBLE / sum(vertices), 6) AS imbalance, round(100.0::DOUBLE * sum(vertices)::BIGINT / (SELECT n FROM nv), 6) AS coverage_pct FROM st0"),
        "penalties_iter1": pen(1),
        "penalties_iter5": pen(5),
        "boundary_vertices": query(it1, "SELECT id, label FROM bd0"),
        "boundary_selected_iter1": query(it1, "SELECT id, label FROM sel0"),
        "boundary_candidates": query(it1, "SELECT id FROM sel0 UNION SELECT dst FROM arc WHERE src IN (SELECT id FROM sel0)"),
        "boundary_subgraph": query(it1, "SELECT src, dst, x.label, y.label AS dst_label, dst IN (SELECT id FROM sel0) AS dst_selected FROM arc JOIN l0 x ON x.id = src JOIN l0 y ON y.id = dst WHERE src IN (SELECT id FROM sel0)"),
        "neighbor_label_scores": query(it1, "SELECT id, lv, c, label FROM sc0 JOIN l0 USING (id)"),
        "lp_step": query(it1, "SELECT id, label FROM mv0"),
        "lp_apply_deltas": query(it1, "SELECT id, label FROM l1"),
        "lp_3_iters": query([*base(), *refinement(3)], "SELECT id, label FROM l3"),
        "refine_full": query(full, f"SELECT id, label FROM {last}"),
        "refine_trace": query(full, trace),
        "comparison_report": query(both, " UNION ALL ".join(f"SELECT '{n}' AS metric, round(a, 6) AS phase1, round(b, 6) AS phase2, round(CASE WHEN a <> 0 THEN (a - b) / a * 100 ELSE 0 END, 4) AS improvement_pct, CASE WHEN a > b THEN 'improved' ELSE 'worsened' END AS verdict FROM (SELECT {x} AS a, {y} AS b)" for n, x, y in cmp_rows)),
        "frontier_topk": query(one, "SELECT part, id, degree FROM (SELECT label AS part, id, degree, row_number() OVER (PARTITION BY label ORDER BY degree, id) AS rn FROM deg JOIN l0 USING (id)) WHERE rn <= 5"),
        "expansion_claims": query([*b, *expansion(1)], "SELECT id, part FROM cl0"),
        "expansion_round1": query([*b, *expansion(1)], "SELECT id, label FROM nw0"),
        "expansion_full": query(ex, f"SELECT id, label FROM xl{ROUNDS}"),
        "expansion_report": query([*ex, *stats(0, f"xl{ROUNDS}")], "SELECT (SELECT cut FROM cut0) AS edge_cut, sum(vertices)::BIGINT AS total_vertices, (SELECT count(*) FROM e) AS total_edges, "
            f"round({bal(0, 'vertices')}, 6) AS vertex_balance, round({bal(0, 'edges')}, 6) AS edge_balance, "
            "string_agg(vertices::VARCHAR, ' ' ORDER BY label) AS part_vertices, string_agg(edges::VARCHAR, ' ' ORDER BY label) AS part_edges FROM st0"),
        "leftover_assign": query(ex, " UNION ALL ".join(f"SELECT id, label FROM lo{k}" for k in range(ROUNDS))),
        "ghosts_r3": query([*one, gh], "SELECT rank, gid, (gid % 3)::INTEGER AS owner, label FROM gh JOIN l0 ON id = gid"),
        "csr_row_ptr_r3": query([*one, ptr], "SELECT rank, local_idx, gid, label, row_start, row_end FROM ptr"),
        "csr_col_idx_r3": query([*one, gh, ptr, "nl AS (SELECT rank, count(*) AS n FROM ptr GROUP BY 1)", "gi AS (SELECT rank, gid, n + row_number() OVER (PARTITION BY rank ORDER BY gid) - 1 AS ix FROM gh JOIN nl USING (rank))"], "SELECT p.rank, row_start + row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, coalesce(ix, dst // 3)::BIGINT AS col_index FROM arc JOIN ptr p ON p.gid = src LEFT JOIN gi ON gi.rank = p.rank AND gi.gid = dst"),
        "adjacency_text_roundtrip": query(b, "SELECT src, dst FROM e"),
        "directed_text_roundtrip": query(b, "SELECT src, dst FROM e"),
        "properties_roundtrip": query(b, "SELECT 'nodes' AS key, n::VARCHAR AS value FROM nv UNION ALL SELECT 'arcs', count(*)::VARCHAR FROM arc"),
        "labels_roundtrip": query(one, "SELECT id, label FROM l0"),
        "merged_levels": query(
            [*b, *seeds(2)],
            "SELECT id, min(level)::INTEGER AS level FROM (SELECT id, 0 AS level FROM seeds UNION ALL SELECT dst, 1 FROM arc JOIN seeds ON src = id "
            "UNION ALL SELECT b.dst, 2 FROM arc a JOIN seeds ON a.src = id JOIN arc b ON b.src = a.dst) GROUP BY 1",
        ),
        "sweep_rows": query(
            both,
            f"SELECT 'order_part' AS graph, 'modulo' AS mode, {P} AS parts, {THETA} AS theta, (SELECT cut FROM cut900) AS cut1, (SELECT cut FROM cut901) AS cut2, "
            f"round({bal(901, 'vertices')}, 6) AS vertex_balance, round({bal(901, 'edges')}, 6) AS edge_balance, "
            f"(SELECT count(*) FROM ({trace})) AS iterations",
        ),
    }

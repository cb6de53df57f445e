"""SimHash near-duplicates with pivot distance tables.

A text's fingerprint has a bit for each bit that is set in over half the XXH64 values (seed 42) of its
shingles. Each distinct fingerprint has a row of Hamming distances to PIVOTS reference fingerprints; by the
triangle inequality a pair whose distances to some pivot differ by over DISTANCE is discarded, and the
survivors are verified bit by bit. Distances of 64-bit fingerprints to any pivot lie mostly within 32 +- 8, so
tables alone leave a constant share of all pairs; they are kept for fingerprints that agree on enough bit
blocks: two that differ in at most DISTANCE of 64 bits agree on at least b - DISTANCE of any b blocks, so
those sets of blocks are keys that miss no pair, for any b. More blocks make more keys of more bits; their
number follows from the number of distinct fingerprints, so that a key holds some CROWD of them (6 blocks make
15 keys of 21 bits; 8 make 70 of 32). In a key fingerprints stand in the order of their first pivot distance,
and only those within DISTANCE of each other there are looked at. A key's links are returned as a forest,
never as all pairs, and a key of over LARGE fingerprints is dealt out as pairs of parts. Components follow by
alternating large-star and small-star steps on tables in the shared folder. Joins on fingerprints or
components that many rows share are dealt to SALTS tasks.

Null and word-less texts have fingerprint 0 and are linked like any other; a text of fewer words than a
shingle is one shingle; a text of any length counts whole; repeated rows share a fingerprint; a null doc_id takes part but is never the
smallest id unless all ids of its component are null; an empty table gives an empty result. Only doc_id
and text are read, so other columns can't clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.functions.loop import Loop
from evencut.llm.common import free_name, lean, materialize, slices

SHINGLE, DISTANCE, PIVOTS, LARGE, CROWD, SALTS = 4, 4, 16, 4096, 8, 16


def fingerprint_batch(texts, shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints of texts; None is empty."""
    hashed, counts, xx = [], [], xxhash.xxh64_intdigest
    for t in texts:
        words = t.encode().lower().split() if t else []
        if not words:
            counts.append(0)
            continue
        joined, n = b" ".join(words), len(words)
        if n <= shingle:
            hashed.append(xx(joined, 42))
            counts.append(1)
            continue
        size = np.fromiter(map(len, words), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = end - size
        hashed.extend([xx(joined[a:b], 42) for a, b in zip(start[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)])
        counts.append(n - shingle + 1)
    n = np.array(counts, dtype=np.int64)
    out = np.zeros(len(n), np.uint64)
    h, at = np.array(hashed, dtype=np.uint64), np.concatenate([[0], np.cumsum(n)])
    some = np.flatnonzero(n)
    if len(some):
        ones = np.zeros((len(some), 64), np.int64)
        lo = 0
        while lo < len(some):  # some 2 million shingles at once
            hi = max(lo + 1, int(np.searchsorted(at[some], at[some[lo]] + (1 << 21))))
            part = h[at[some[lo]] : at[some[hi - 1] + 1]]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[lo:hi] = np.add.reduceat(bits, at[some[lo:hi]] - at[some[lo]], axis=0, dtype=np.int64)
            lo = hi
        over = (2 * ones > n[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed 64-bit number."""
    d = docs.select("doc_id", "text")

    def run(batches):
        for b in slices(batches, 500):
            fp = fingerprint_batch(b.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def blocks_for(count: int, distance: int = DISTANCE) -> int:
    """The fewest blocks whose keys of so many random fingerprints hold CROWD or fewer."""
    b = distance + 2
    while b < 4 * distance and count > CROWD << 64 * (b - distance) // b:
        b += 1
    return b


def key_masks(distance: int, blocks: int) -> list[int]:
    """Bit masks such that any two fingerprints within distance agree on all bits of one."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(part, blocks - distance)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, count, dtype=np.uint64)


def _link(fp: np.ndarray, group: np.ndarray, side: np.ndarray, distance: int, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within groups, as positions; rows are sorted by group. In a group with sides 0 and 1, only pairs across sides are compared; side 2 compares with all."""
    first = np.bitwise_count(fp ^ reference[0]).astype(np.int16)
    order = np.lexsort((first, group))
    fp, group, side, first = fp[order], group[order], side[order], first[order]
    table = np.bitwise_count(fp[:, None] ^ reference[None, 1:]).astype(np.int8)
    n, root = len(fp), np.arange(len(fp))
    left, right = [], []
    end = np.searchsorted(group, group, "right")
    live = np.arange(n)
    step = 1
    while len(live := live[live + step < end[live]]):
        live = live[first[live + step] - first[live] <= distance]  # those behind are farther still
        a, b = live, live + step
        ok = (side[a] == 2) | (side[a] != side[b])
        a, b = a[ok], b[ok]
        near = np.ones(len(a), bool)
        for p in range(0, table.shape[1], 4):  # pairs that a few pivots discard never see the others
            at = np.flatnonzero(near)
            if not len(at):
                break
            near[at] = np.abs(table[a[at], p : p + 4] - table[b[at], p : p + 4]).max(axis=1) <= distance
        a, b = a[near], b[near]
        sure = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = a[sure], b[sure]
        new = root[a] != root[b]
        a, b = a[new], b[new]
        while len(a):  # each round hooks larger roots under smaller ones and keeps one link for each hooked root
            hi, lo = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            _, one = np.unique(hi, return_index=True)
            left.append(a[one])
            right.append(b[one])
            root[hi[one]] = lo[one]
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            rest = root[a] != root[b]
            a, b = a[rest], b[rest]
        step += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """(a, b): fingerprints of distinct (column fp) that connect all pairs within distance."""
    masks = key_masks(distance, blocks or blocks_for(distinct.count(), distance))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    crowd = rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(crowd, ["t", "key"])
    parts = F.ceil(F.col("n") / LARGE).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).cast("int").alias("x"), F.greatest(own, j).cast("int").alias("y")))
    dealt = rows.select("t", "key", "fp", own.alias("own"), F.explode(pairs).alias("p")).select("t", "key", "p.x", "p.y", "fp", F.when(F.col("p.x") == F.col("p.y"), 2).when(F.col("own") == F.col("p.x"), 0).otherwise(1).alias("side"))
    group = ["t", "key", "x", "y"]
    laid = dealt.repartition(*group).sortWithinPartitions(*group, "fp")
    reference = pivots()

    def run(batches):
        held: list[np.ndarray] = []

        def work(rows):
            g = np.zeros(len(rows[0]), np.int64)
            if len(g) > 1:
                g[1:] = np.cumsum(np.any([c[1:] != c[:-1] for c in rows[:4]], axis=0))
            fp = rows[4].view(np.uint64)
            a, b = _link(fp, g, rows[5], distance, reference)
            return pa.RecordBatch.from_arrays([pa.array(rows[4][a]), pa.array(rows[4][b])], names=["a", "b"])

        for batch in batches:
            now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
            if not len(now[0]):
                continue
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            same = np.all([c == c[-1] for c in held[:4]], axis=0)  # the last group may go on in the next batch
            cut = len(same) - int(same.sum())
            if cut:
                yield work([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held:
            yield work(held)

    return laid.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of an edge table (a, b) that has another."""
    loop = Loop(edges.sparkSession)
    now = loop.put("edges", edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = _salted_join(both, least, "u", F.xxhash64("v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        big = loop.put("large", big)
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = loop.put("edges", small.filter("u <> v").distinct())
        new = mark(now)
        if new == seen:
            break
        seen = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(docs: DataFrame, distance: int = DISTANCE, order=lambda c: c) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; order maps an id to what the smallest id is smallest by."""
    prints = materialize(fingerprints(docs), "prints")
    smallest = lambda c: F.min_by(c, order(F.col(c)))
    distinct = materialize(prints.groupBy("fp").agg(smallest("doc_id").alias("rep")), "distinct")
    found = components(links(distinct.select("fp"), distance))
    linked = distinct.join(found, F.col("fp") == F.col("node")).select("fp", "rep", "root")
    named = linked.groupBy("root").agg(smallest("rep").alias("component_id"))
    linked = _salted_join(linked.drop("rep"), named, "root", F.xxhash64("fp")).select("fp", "component_id")
    alone = distinct.join(found.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("rep").alias("component_id"))
    return _salted_join(prints, linked.unionByName(alone), "fp", F.monotonically_increasing_id()).select("doc_id", "fp", "component_id")


def _salted_join(rows: DataFrame, told: DataFrame, key: str, spread) -> DataFrame:
    """rows with the columns of told, which has one row a key; a key of many rows is dealt to SALTS tasks."""
    many = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(many, [key, "salt"]).drop("salt")


def hexed(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each component: of the rows with its smallest doc_id, one of those whose text has the smallest hash; that row's repeats count as one."""
    rows = docs.select("doc_id", "text")
    of = groups(rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text"), order=lambda c: F.struct(c["doc_id"].isNull(), c))
    kept = of.select("component_id.doc_id", "component_id.h").distinct()
    keys = (free_name(docs.columns, "first_doc"), free_name(docs.columns, "first_text"))
    kept = kept.select(*[F.col(c).alias(k) for c, k in zip(kept.columns, keys, strict=True)])
    same = docs["doc_id"].eqNullSafe(kept[keys[0]]) & (F.xxhash64(docs["text"]) == kept[keys[1]])
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return docs.join(kept, same, "left_semi").withColumn(keys[1], F.xxhash64("text")).dropDuplicates(["doc_id", keys[1]]).select(*cols)

"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources get shares of all words by weight; what a share exceeds `most` times its source is shared again.
Each source's documents are shuffled by hash, laid end to end and cut into equal-token blocks. The slots
of the schedule are golden-ratio points mapped through the cumulative slot counts of the sources; the
r-th slot of a source takes its block r mod n, and the last slot is cut so that the target is met to a
word. Positions come from per-bucket sums, so that no source is ever ordered in one task; a block of
thousands of tiny documents is dealt to SALTS tasks.

Null texts have size 0; a null source is a source of its own, last; a source without words has target 0 and no slots; identical rows count as rows of
their own; a text longer than a block lies in several; empty tables give empty results. Only doc_id, source and text are read, so other columns
can't clash. At most MAX_SOURCES sources (their totals are held by the driver); more raise ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evencut.llm.common import WORD, free_name, materialize

WEIGHTS, MOST, BLOCK, MAX_SOURCES = (5, 2, 1), 3, 4096, 1_000_000
GOLDEN = 0x9E3779B97F4A7C15  # 2**64 over the golden ratio
ROWS_PER_BUCKET = 20_000
CHUNK_SLOTS = 1 << 16
SALTS = 16


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of a row's id and text, which any SQL engine can compute."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the number of words and the shuffle key of each row."""
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        shuffle_key(F.col("doc_id"), F.col("text")).alias("h"),
    )


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size; the excess is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


class Mix:
    """A mix of docs: sources (a DataFrame of totals and targets), schedule and rows."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK) -> None:
        spark = docs.sparkSession
        self.sized = materialize(sized(docs), "sized")
        found = self.sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        size = [int(r["size"]) for r in found]
        goal = targets(size, [weights[i % len(weights)] for i in range(len(found))], most)
        rows = []
        for i, (r, s, t) in enumerate(zip(found, size, goal, strict=True)):
            take = min(math.floor(t + 0.5), most * s)
            blocks = max(1, -(-s // block))
            full, rest = divmod(take, s) if s else (0, 0)
            part = next_block(rest, s, blocks)
            rows.append((i, r.source, s, t, take, blocks, full * blocks + part, rest))
        self.n_rows = sum(r.n for r in found)
        self.table = rows
        self.sources = spark.createDataFrame(rows, "si int, source string, source_size long, target double, take long, blocks long, slots long, rest long")

    def schedule(self) -> DataFrame:
        """(slot, si, rank): slot order and which of its source's slots each is; each source has exactly its number of slots."""
        spark, some = self.sources.sparkSession, [(r[0], r[6]) for r in self.table if r[6]]  # a source without slots has no part of the range
        total, upto, edges = sum(n for _, n in some), 0, []
        for _, n in some[:-1]:
            upto += n
            edges.append(upto * (1 << 64) // total)
        edges, which = np.array(edges, dtype=np.uint64), np.array([i for i, _ in some] or [0], dtype=np.int32)

        def place(batches):
            for b in batches:
                t = b.column(0).to_numpy().astype(np.uint64)
                with np.errstate(over="ignore"):
                    u = (t + np.uint64(1)) * np.uint64(GOLDEN)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(which[np.searchsorted(edges, u, "right")])], names=["slot", "si"])

        dealt = spark.range(total).mapInArrow(place, "slot long, si int").withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
        before = Window.partitionBy("si").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        seen = dealt.groupBy("si", "chunk").agg(F.count("*").alias("n")).withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("si", "chunk").orderBy("slot"))
        ranked = dealt.withColumn("rn", rank).join(seen.select("si", "chunk", "off"), ["si", "chunk"]).select("slot", "si", (F.col("off") + F.col("rn") - 1).alias("rank"))
        want = F.broadcast(self.sources.select("si", "slots"))  # MAX_SOURCES rows at most
        kept = ranked.join(want, "si").filter("rank < slots").select("slot", "si", "rank")
        short = want.join(seen.groupBy("si").agg(F.sum("n").alias("got")), "si", "left").filter("slots > coalesce(got, 0)")
        late = short.select((F.lit(total) + F.col("si")).alias("slot"), "si", F.explode(F.expr("sequence(coalesce(got, 0), slots - 1)")).alias("rank"))
        return kept.unionByName(late)

    def uses(self) -> DataFrame:
        """(si, block, full, part): how often each block is taken whole, and the words of its cut use."""
        s = self.schedule().join(F.broadcast(self.sources.select("si", "source_size", "blocks", "slots", "take")), "si")
        at = s.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
        lo, hi = F.expr("block * source_size div blocks"), F.expr("(block + 1) * source_size div blocks")
        words = F.greatest(F.lit(0), F.least(hi - lo, F.col("take") - F.col("epoch") * F.col("source_size") - lo))
        at = at.withColumn("len", hi - lo).withColumn("words", words)
        return at.groupBy("si", "block").agg(F.count_if(F.col("words") == F.col("len")).alias("full"), F.coalesce(F.max(F.when(F.col("words") < F.col("len"), F.col("words"))), F.lit(0)).alias("part"))

    def laid(self) -> DataFrame:
        """sized rows with si and start, the place of their first word in their source's shuffled order."""
        buckets = max(1, -(-self.n_rows // ROWS_PER_BUCKET))
        d = self.sized.join(F.broadcast(self.sources), self.sized.source.eqNullSafe(self.sources.source)).drop(self.sources.source)
        d = d.withColumn("bucket", F.pmod("h", F.lit(buckets)))
        before = Window.partitionBy("si").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        off = d.groupBy("si", "bucket").agg(F.sum("size").alias("s")).select("si", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
        inner = Window.partitionBy("si", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        return d.withColumn("end", F.sum("size").over(inner)).join(off, ["si", "bucket"]).withColumn("start", F.col("off") + F.col("end") - F.col("size")).drop("off", "end", "bucket")

    def rows(self) -> DataFrame:
        """(doc_id, source, h, size, source_size, target, taken) for every row of docs."""
        d = self.laid().select("doc_id", "source", "h", "size", "source_size", "target", "si", "start", "blocks")
        some = d.filter("size > 0")
        # a word x lies in the last block that starts at or before it
        block = lambda x: F.expr(f"(({x}) * blocks + blocks - 1) div source_size")
        first, last = block("start"), block("start + size - 1")
        guess = F.sequence(F.greatest(F.lit(0), first - 1), F.least(F.col("blocks") - 1, last + 1))
        pieces = some.withColumn("block", F.explode(guess)).withColumn("lo", F.expr("block * source_size div blocks")).withColumn("hi", F.expr("(block + 1) * source_size div blocks"))
        pieces = pieces.filter("lo < start + size and hi > start")
        uses = self.uses().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = pieces.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(uses, ["si", "block", "salt"], "left")
        over = lambda end: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), end) - F.greatest(F.col("start"), F.col("lo")))
        got = F.coalesce(F.col("full") * over(F.col("hi")) + over(F.col("lo") + F.col("part")), F.lit(0))
        keys = ["doc_id", "source", "h", "size", "source_size", "target", "si", "start"]
        taken = both.groupBy(*keys).agg(F.sum(got).cast("long").alias("taken"))
        none = d.filter("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
        return taken.unionByName(none).drop("si", "start")


def next_block(rest: int, size: int, blocks: int) -> int:
    """How many blocks the first rest words of a source touch."""
    if not rest:
        return 0
    j = (rest * blocks) // size
    while (j * size) // blocks < rest:
        j += 1
    while j and ((j - 1) * size) // blocks >= rest:
        j -= 1
    return j


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of a Mix."""
    return Mix(docs, **settings).rows()


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """docs with each row as often as the mix takes it: words taken over words, rounded by a hash so that source totals hold. Rows without words go."""
    m = mix(docs, **settings).filter("taken > 0").select("doc_id", "h", (F.col("taken") / F.col("size")).alias("rate"))
    coin = F.pmod(F.xxhash64(F.lit("copy"), "doc_id", "h"), F.lit(1 << 30)) / float(1 << 30)
    times = m.groupBy("doc_id", "h").agg(F.max("rate").alias("rate")).select("doc_id", "h", F.floor(F.col("rate") + coin).cast("int").alias("times")).filter("times > 0")
    names = [free_name(docs.columns, x) for x in ("mix_doc", "mix_key", "mix_times", "mix_copy")]
    doc, key, n, copy = names
    t = times.select(F.col("doc_id").alias(doc), F.col("h").alias(key), F.col("times").alias(n))
    out = docs.join(t, (shuffle_key(docs["doc_id"], docs["text"]) == t[key]) & docs["doc_id"].eqNullSafe(t[doc]))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(*names)

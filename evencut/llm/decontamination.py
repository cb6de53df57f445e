"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a run of whole texts of about SHARD bytes; a longer text is a shard of its own. Its index holds
all words of those texts, in order, each text closed by an end mark of its own; it is built once and does not
depend on the benchmark. Phrases (WINDOW consecutive words of an item; a shorter item is one phrase) are
searched backward, all at once, through ranks of a wavelet matrix over the Burrows-Wheeler transform;
occurrences are located by walking to suffix positions, of which every SAMPLE-th is kept. Hit words merge
into spans.

Benchmark items are taken in blocks of about BLOCK bytes of text. One block is one broadcast of bounded size
(about 20 bytes for a word); a benchmark of several blocks is searched for in as many passes over the
documents, and what each finds joins what those before found, text by text.

Null or word-less texts and items have no windows; windows that several items share count for each;
repeated rows are searched alike; very long texts are searched whole; empty tables give no hits. A result column never takes the name of an
input column. Words are compared by 64-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evencut.llm.common import ALNUM, LOWER, Hashes, chunks, free_name, lean, materialize, owner, slices, spans, with_column

WINDOW, SHARD, BLOCK, SAMPLE = 10, 4 << 20, 16 << 20, 8

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("words", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("bytes", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(data: np.ndarray, off: np.ndarray):
    """(starts, ends, hashes) of the words of lower-cased texts."""
    low = LOWER[data]
    starts, ends = spans(ALNUM[low], off)
    return starts, ends, Hashes(low).of(starts, ends)


class Phrases:
    """The phrases of some items as runs of their words: words by hash, where each phrase starts and how long it is, and whose it is."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.items = [i for i, _ in items]
        words, start, length, whose, base = [], [], [], [], 0
        for lo, data, off in chunks(pa.array([t for _, t in items], pa.large_string())):
            starts, _, h = words_of(data, off)
            n = np.bincount(owner(off, starts), minlength=len(off) - 1)
            many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)  # phrases of each item
            first = base + np.cumsum(n) - n
            start.append(np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
            length.append(np.repeat(np.minimum(n, window), many))
            whose.append(np.repeat(np.arange(lo, lo + len(n)), many))
            words.append(h)
            base += len(h)
        joined = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.words, self.start, self.length, self.whose = joined(words, np.uint64), joined(start, np.int64), joined(length, np.int32), joined(whose, np.int32)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """The suffixes of seq in order, by doubling; seq ends with a symbol that occurs nowhere else. Only suffixes that are not yet told apart are sorted again."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.concatenate([[True], seq[order[1:]] != seq[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of the first of its group
    h = 1
    alone = new & np.concatenate([new[1:], [True]])
    open_ = np.flatnonzero(~alone)  # places in order whose group has others
    while len(open_):
        some = order[open_]
        key, group = rank[some + h], rank[some]  # a suffix near the end is alone, as the last symbol is
        by = np.lexsort((key, group))
        some, key, group = some[by], key[by], group[by]
        order[open_] = some
        new = np.ones(len(some), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        rank[some] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        h *= 2
    return order


class Bits:
    """A bit vector with ranks: words of 64 bits and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros((len(bits) >> 6) * 8 + 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols: level by level from the highest bit, zeros before ones."""

    def __init__(self, seq: np.ndarray) -> None:
        self.bits = max(1, int(seq.max()).bit_length()) if len(seq) else 1
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1 > 0
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = self.levels[level].rank(lo), self.levels[level].rank(hi)
            lo = np.where(one, self.zeros[level] + a, lo - a)
            hi = np.where(one, self.zeros[level] + b, hi - b)
        return hi - lo


class FMIndex:
    """Backward search and location in the words of some texts, given by hash; edge holds where each text's words begin and end."""

    def __init__(self, h: np.ndarray, edge: np.ndarray) -> None:
        texts, self.n = len(edge) - 1, len(h) + len(edge) - 1
        self.vocabulary, code = np.unique(h, return_inverse=True)
        which = np.repeat(np.arange(texts), np.diff(edge))
        seq = np.empty(self.n, np.int64)
        seq[np.arange(len(h)) + which] = code + texts
        seq[edge[1:] + np.arange(texts)] = np.arange(texts)[::-1]  # end marks are symbols of their own, the last one the smallest
        self.texts = texts
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.tree = WaveletMatrix(self.bwt)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=texts + len(self.vocabulary)))])
        since = np.arange(self.n) - np.repeat(edge[:-1] + np.arange(texts), np.diff(edge) + 1)
        kept = (since % SAMPLE == 0)[sa]  # counted from the start of each text, so that no walk leaves it
        self.marked, self.sample = Bits(kept), sa[kept].astype(np.int32)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """The symbol of each word; -1 if no text has it."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + self.texts, -1)

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase."""
        symbols = self.symbols(words)
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        on, back = np.flatnonzero(length > 0), 0
        while len(on):
            c = symbols[start[on] + length[on] - 1 - back]
            hi[on[c < 0]] = lo[on[c < 0]]
            on, c = on[c >= 0], c[c >= 0]
            lo[on] = self.first[c] + self.tree.rank(c, lo[on])
            hi[on] = self.first[c] + self.tree.rank(c, hi[on])
            back += 1
            on = on[(hi[on] > lo[on]) & (length[on] > back)]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each suffix, as a place among words and end marks."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.first[c] + self.tree.rank(c, at[open_])
            walked[open_] += 1
            open_ = open_[~self.marked[at[open_]]]
        return self.sample[self.marked.rank(at)] + walked


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def search_shard(phrases: Phrases, data: np.ndarray, off: np.ndarray) -> list[dict]:
    """What FOUND holds, for each text of a shard."""
    starts, ends, h = words_of(data, off)
    who = owner(off, starts)
    edge = np.searchsorted(who, np.arange(len(off)))
    out = [{"n_words": int(n), "words": [], "bytes": [], "items": []} for n in np.diff(edge)]
    if not len(h) or not len(phrases.start):
        return out
    index = FMIndex(h, edge)
    lo, hi = index.search(phrases.words, phrases.start, phrases.length)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return out
    many = (hi - lo)[some]
    which = np.repeat(some, many)
    rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[some], many)
    place = index.locate(rows)
    doc = np.searchsorted(edge + np.arange(len(edge)), place, "right") - 1  # a place counts the end marks before it
    first = place - doc
    last = first + phrases.length[which]
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for part in np.split(order, cuts):
        d = int(doc[part[0]])
        base = int(edge[d])
        merged = _merged(first[part] - base, last[part] - base)
        found = out[d]
        found["words"] = [{"start": a, "end": b} for a, b in merged]
        found["bytes"] = [{"start": int(starts[base + a] - off[d]), "end": int(ends[base + b - 1] - off[d])} for a, b in merged]
        found["items"] = sorted({phrases.items[i] for i in np.unique(phrases.whose[which[part]]).tolist()})
    return out


def _joined(a: dict, b: dict) -> dict:
    """What two blocks found in one text; rows of earlier passes come as dictionaries too."""
    both = lambda k: [{"start": x, "end": y} for x, y in _merged(*(np.array([s[e] for s in [*a[k], *b[k]]], dtype=np.int64) for e in ("start", "end")))]
    return {"n_words": b["n_words"], "words": both("words"), "bytes": both("bytes"), "items": sorted({*a["items"], *b["items"]})}


def _blocks(bench: DataFrame, window: int, block: int):
    """The phrases of one block of items after the other, as broadcast variables."""
    spark = bench.sparkSession
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-int(total) // block))
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield spark.sparkContext.broadcast(Phrases([tuple(r) for r in part.collect()], window)), b == blocks - 1


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> tuple[DataFrame, str]:
    """(docs with a column of FOUND structs, that column's name)."""
    name, at, names, before = free_name(docs.columns, "found"), docs.columns.index("text"), docs.columns, False
    for phrases, last in _blocks(bench, window, block):

        def search(batch, phrases=phrases, before=before):
            made = [x for _, data, off in chunks(batch.column(at), shard) for x in search_shard(phrases.value, data, off)]
            if before:
                made = [_joined(x, y) for x, y in zip(batch.column(len(names)).to_pylist(), made, strict=True)]
            return made

        docs = with_column(docs, name, FOUND, search, replace=before)
        if not last:  # one block at a time: its broadcast goes when its pass is done
            docs = materialize(docs, "found")
            phrases.destroy()
        before = True
    return docs, name


def sha256_ids(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def cleaned_documents(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """docs without the merged spans of benchmark passages; texts without any stay as they are. n_chars, if there, follows the text."""
    names, schema = docs.columns, docs.schema
    found, _ = find(docs, bench, window, shard, block)

    def cut(batches):
        for b in slices(batches, 2500):
            spots = b.column(len(names)).to_pylist()
            hit = [i for i, s in enumerate(spots) if s["bytes"]]
            cols = dict(zip(names, b.columns, strict=False))
            if hit:
                new, col = cols["text"].to_pylist(), cols["text"]
                size = cols["n_chars"].to_pylist() if "n_chars" in cols else None
                for i in hit:
                    raw, at, kept = new[i].encode(), 0, []
                    for x in spots[i]["bytes"]:
                        kept.append(raw[at : x["start"]])
                        at = x["end"]
                    new[i] = b"".join([*kept, raw[at:]]).decode()
                    if size:
                        size[i] = len(new[i])
                cols["text"] = pa.array(new, col.type)
                if size:
                    cols["n_chars"] = pa.array(size, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return found.mapInArrow(lean(cut), schema)

"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: at a smaller key, or in the
same text at an earlier place. Positions are ranked by ever longer prefixes and leave as soon as they are
unique; what is left at LENGTH bytes is repeated.

The first round need not hold every position: of the prefixes of FIRST bytes inside any LENGTH bytes, the one of
smallest hash (the leftmost, if several) is that string's anchor, so equal strings have
equal anchors at equal places, and only anchors are ranked. With an anchor goes a hash of all bytes that
its strings cover. Spark deals and sorts the pairs (prefix, covered bytes) by ranges of ranks: in a class of equal
pairs, 128 bits together, all strings of all but the earliest anchor are repeats, whatever the size of the class,
and that anchor alone goes on, if its prefix occurs elsewhere with other bytes around it.

What goes on is sent with its bytes, again dealt and sorted by the ranks of prefixes. There, ranks of positions double:
from words of 8 bytes, pairs of ranks (at a position, and at growing offsets 8, 16, 32 and 36 behind it) are
sorted and ranked anew, until a string is unique or LENGTH bytes are ranked. These ranks are exact, so no
string is taken for another by a hash. In a class all but the earliest string are repeats.

Classes are dealt out by ranges of ranks, as many as the bytes of text ask for. Before that,
a task settles what it can tell by itself: of equal pairs among HELD of its anchors, all but the
earliest are repeats wherever else they occur, so a passage that a third of all texts share sends one
position for each HELD to its range. A prefix with over HOT different surroundings is dealt out by its whole strings in
the second round.

Null texts are empty; texts shorter than LENGTH repeat nothing; texts of any length are searched whole; rows that share doc_id and text are the
same place, so none of them is earlier, and rows that share only doc_id are told apart and ordered by 40 bits of a hash of the text;
a null doc_id comes first; ids are integers or cast to them, and an id that is none raises. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.llm.common import Hashes, chunks, lean, materialize, mix, owner, slices

LENGTH, FIRST = 100, 40
RANGES, RANGE_BYTES, TASKS = 96, 8 << 20, 20_000  # ranges at least, bytes of text for each beyond, tasks at most
CHUNK, ROWS = 1 << 19, 500  # bytes of text, and rows of results, that a task works on at once
HELD, HOT = 200_000, 4096  # positions that a task settles by itself at once; surroundings of a prefix that are settled together


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each width values, by doubling."""
    op, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= width:
        x = op(x[:-done], x[done:])
        done *= 2
    return op(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, first: int = FIRST):
    """(place, rank, first start, last start) of the anchors of whole texts, and the buffer's hashes. Every string of length bytes inside a text belongs to exactly one."""
    width = length - first + 1
    z = np.zeros(0, np.int64)
    hashes = Hashes(data)
    if len(data) < length:
        return z, np.zeros(0, np.uint64), z, z, hashes
    rank = hashes.every(first)
    least = _slide(rank, width, True)  # by start
    fits = np.zeros(len(least), bool)
    size = np.diff(off)
    for lo, n in zip(off[:-1][size >= length].tolist(), size[size >= length].tolist(), strict=True):
        fits[lo : lo + n - length + 1] = True
    least = np.where(fits, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    best = _slide(padded, width, False)  # the largest of the minima of the strings around a prefix
    at = np.flatnonzero(rank == best[: len(rank)])
    who = owner(off, at)
    at, who = at[size[who] >= length], who[size[who] >= length]
    if not len(at):
        return z, np.zeros(0, np.uint64), z, z, hashes
    r = rank[at]
    lo = off[who].copy()
    same = who[1:] == who[:-1]
    # the next anchor takes over when its smaller rank comes into reach, or when the last one is passed
    lo[1:] = np.where(same, np.where(r[1:] < r[:-1], at[1:] - width + 1, at[:-1] + 1), lo[1:])
    lo = np.minimum.accumulate(np.maximum(lo, off[who])[::-1])[::-1]  # one that a later anchor overtakes has none
    hi = off[who + 1] - length
    hi[:-1] = np.where(same, np.minimum(lo[1:] - 1, hi[:-1]), hi[:-1])
    ok = lo <= hi
    return at[ok], r[ok], lo[ok], hi[ok], hashes


def _keys(batch) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, text hash) of the rows of a batch; a null id is the smallest number."""
    ids = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    return ids, batch.column(1).to_numpy(zero_copy_only=False)


def ranges_of(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(RANGES, -(-int(total) // RANGE_BYTES))


def _planes(v: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: high bytes of ids and places compress to almost nothing."""
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _numbers(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _deal(g: dict[str, np.ndarray | None], ranges: int) -> pa.RecordBatch:
    """A row of byte strings for each range of ranks; a column that is None is empty."""
    part = (mix(g["rank"]) >> np.uint64(32)).astype(np.int64) * ranges >> 32  # mixed, as anchors have small ranks
    order = np.argsort(part, kind="stable")
    kept, edges = np.unique(part[order], return_index=True)
    edges = [*edges.tolist(), len(part)]
    cols = [pa.array(kept, pa.int32())]
    for v in g.values():
        v = v[order] if v is not None else np.zeros(0, np.uint8)
        cols.append(pa.array([_planes(v[x:y]) for x, y in zip(edges, edges[1:], strict=False)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=["part", *g])


def _later(g: dict[str, np.ndarray], head: np.ndarray) -> np.ndarray:
    """Which rows, sorted in their groups by place, lie elsewhere than their group's first; repeated rows are one place."""
    if not len(head):
        return head
    f = np.flatnonzero(head)[np.cumsum(head) - 1]
    return ~((g["doc"] == g["doc"][f]) & (g["hash"] == g["hash"][f]) & (g["place"] == g["place"][f]))


def _dealt(held: list[dict[str, np.ndarray]], names: list[str], keys: tuple[str, ...], reach, ranges: int):
    """What a task sends of the positions it holds: the earliest of each class, and in a part of its own the spans (place to body) of the others."""
    every = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
    order = np.lexsort((every["place"], every["hash"], every["doc"], *[every[k] for k in reversed(keys)]))
    g = {k: v[order] for k, v in every.items()}
    head = _groups(*[g[k] for k in keys])
    dup = _later(g, head)
    if dup.any():
        start, end = reach({k: v[dup] for k, v in g.items()})
        doc, hash_, start, end = _merged(g["doc"][dup], g["hash"][dup], start, end)
        sure = {"rank": hash_[:0], "body": end, "doc": doc, "hash": hash_, "place": start}
        cells = [pa.array([_planes(sure[k]) if k in sure else b""], pa.binary()) for k in names]
        yield pa.RecordBatch.from_arrays([pa.array([ranges + int(hash_[0]) % ranges], pa.int32()), *cells], names=["part", *names])
    first = np.sort(order[head])  # in the order of the texts
    yield _deal({k: every[k][first] if k in every else None for k in names}, ranges)


def _laid(sent: DataFrame, ranges: int) -> DataFrame:
    """Ranges dealt to tasks in turn: by a hash of their numbers some task would get several."""
    tasks = min(ranges, TASKS)
    return sent.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part")


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts, in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


COLUMNS = {"rank": np.uint64, "body": np.uint64, "doc": np.int64, "hash": np.int64, "place": np.int64, "lo": np.uint8, "hi": np.uint8}


def _gathered(batches, names: list[str]):
    """(range, its rows) for each range of ranks; a task gets whole ranges, in order."""
    now, held = None, []

    def joined(rows):
        return {n: np.concatenate([_numbers(r[i], COLUMNS[n]) for r in rows]) for i, n in enumerate(names)}

    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for k, part in enumerate(cols[0]):
            if part != now and held:
                yield now, joined(held)
                held = []
            now = part
            held.append([c[k] for c in cols[1:]])
    if held:
        yield now, joined(held)


def _merged(doc, hash_, start, end):
    """The spans sorted by text, those of a text merged."""
    order = np.lexsort((start, hash_, doc))
    doc, hash_, start, end = doc[order], hash_[order], start[order], end[order]
    if not len(doc):
        return doc, hash_, start, end
    new = _groups(doc, hash_)
    group = np.cumsum(new) - 1
    big = np.int64(1) << 40  # spans of the next text never touch those before
    reach = np.maximum.accumulate(end + group * big) - group * big
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], hash_[at], start[at], reach[np.append(at[1:], len(doc)) - 1]


def _by_text(doc, hash_, **of: np.ndarray) -> pa.RecordBatch:
    """(doc, hash and a list for each of the others): one row for each text of rows that are sorted by text."""
    edge = np.append(np.flatnonzero(_groups(doc, hash_)), len(doc)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x.astype(np.int64))) for x in of.values()]
    return pa.RecordBatch.from_arrays([pa.array(doc[edge[:-1]]), pa.array(hash_[edge[:-1]]), *lists], names=["doc", "hash", *of])


def _spans_of(doc, hash_, start, end) -> pa.RecordBatch:
    doc, hash_, start, end = _merged(doc, hash_, start, end)
    return _by_text(doc, hash_, starts=start, ends=end)


SPANS = "doc long, hash long, starts array<long>, ends array<long>"
MORE = ("ranks", "inner")  # of what goes on: its prefix's rank, and how far its anchor lies behind its first start (-1: by whole strings)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 40) - 1)).alias("hash"), "text")


def _reach(g: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that an anchor's strings cover."""
    return g["place"] - g["lo"], g["place"] - g["hi"].astype(np.int64) + (LENGTH - FIRST) + LENGTH


def _round1(docs: DataFrame, ranges: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(spans that are settled, anchors that go on)."""
    names = ["rank", "body", "doc", "hash", "place", "lo", "hi"]

    def local(batches):
        held, n = [], 0
        for b in slices(batches, 4 * ROWS):
            ids, hash_ = _keys(b)
            for row, data, off in chunks(b.column(2), CHUNK):
                at, rank, lo, hi, hashes = anchors(data, off)
                if not len(at):
                    continue
                who = owner(off, at)
                body = mix(hashes.of(lo, hi + LENGTH) ^ ((at - lo).astype(np.uint64) << np.uint64(48)) ^ ((hi - lo).astype(np.uint64) << np.uint64(40)))
                made = (rank, body, ids[row + who], hash_[row + who], at - off[who], (at - lo).astype(np.uint8), (at - hi + LENGTH - FIRST).astype(np.uint8))
                held.append(dict(zip(names, made, strict=True)))
                n += len(at)
                if n >= HELD:
                    yield from _dealt(held, names, ("rank", "body"), _reach, ranges)
                    held, n = [], 0
        if held:
            yield from _dealt(held, names, ("rank", "body"), _reach, ranges)

    sent = _keyed(docs).mapInArrow(lean(local), "part int, " + ", ".join(f"{n} binary" for n in names))

    def settle(batches):
        def rows(spans, kind):
            none = pa.array([None] * spans.num_rows, pa.list_(pa.int64()))
            lists = [spans.column(c) if c in spans.schema.names else none for c in ("doc", "hash", "starts", "ends", *MORE)]
            return pa.RecordBatch.from_arrays([*lists, pa.array(np.full(spans.num_rows, kind, np.int8))], names=["doc", "hash", "starts", "ends", *MORE, "kind"])

        for part, g in _gathered(batches, names):
            if part >= ranges:
                yield rows(_spans_of(g["doc"], g["hash"], g["place"], g["body"].view(np.int64)), 0)
                continue
            order = np.argsort(g["rank"], kind="stable")
            size = np.diff(np.append(np.flatnonzero(_groups(g["rank"][order])), len(order)))
            order = order[np.repeat(size > 1, size)]  # a unique prefix is done
            g = {k: v[order] for k, v in g.items()}
            order = np.lexsort((g["place"], g["hash"], g["doc"], g["body"], g["rank"]))
            g = {k: v[order] for k, v in g.items()}
            head = _groups(g["rank"], g["body"])
            dup = _later(g, head)
            start, end = _reach(g)
            yield rows(_spans_of(g["doc"][dup], g["hash"][dup], start[dup], end[dup]), 0)
            # the earliest of each body goes on if its prefix has other bodies
            reps = np.flatnonzero(head)
            n = np.diff(np.append(np.flatnonzero(_groups(g["rank"][reps])), len(reps)))
            some = np.repeat(n > 1, n)
            on, hot = reps[some], np.repeat(n > crowd, n)[some]
            order = np.lexsort((start[on], g["hash"][on], g["doc"][on]))
            on, hot = on[order], hot[order]
            inner = np.where(hot, -1, g["place"][on] - start[on])
            yield rows(_by_text(g["doc"][on], g["hash"][on], starts=start[on], ends=end[on] - LENGTH, ranks=g["rank"][on].view(np.int64), inner=inner), 1)

    lists = "".join(f", {c} array<long>" for c in MORE)
    out = materialize(_laid(sent, ranges).mapInArrow(lean(settle), SPANS + lists + ", kind tinyint"), "round1")
    return out.filter("kind = 0").drop("kind", *MORE), out.filter("kind = 1").drop("kind")


def _with_spans(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """(doc_id, hash, text and the list columns of spans): texts with all their lists."""
    names = [c for c in spans.columns if c not in ("doc", "hash")]
    one = F.collect_list(F.struct(*names)).alias("one")  # lists that belong together stay so
    lists = spans.groupBy("doc", "hash").agg(one).select("doc", "hash", *[F.flatten(f"one.{c}").alias(c) for c in names])
    keyed = _keyed(docs).withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumnRenamed("hash", "h")
    return keyed.join(lists, (keyed.doc == lists.doc) & (keyed.h == lists.hash), how).select("doc_id", F.col("h").alias("hash"), "text", *names)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls inside."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(col).to_pylist()], dtype=np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Regions:
    """What the second round sends of a prefix's surroundings: rank, place (doc, hash, first start), number of starts, distance of the anchor, and bytes."""

    KINDS = {"rank": np.uint64, "doc": np.int64, "hash": np.int64, "start": np.int64, "count": np.uint8, "inner": np.uint8}

    def __init__(self, of: dict[str, np.ndarray], data: np.ndarray) -> None:
        self.of, self.data = of, data

    def cells(self, ranges: int) -> pa.RecordBatch:
        """A row for each range of ranks."""
        part = (mix(self.of["rank"]) >> np.uint64(32)).astype(np.int64) * ranges >> 32
        size = self.of["count"].astype(np.int64) + LENGTH - 1
        at = np.cumsum(size) - size
        order = np.argsort(part, kind="stable")
        kept, edges = np.unique(part[order], return_index=True)
        edges = [*edges.tolist(), len(part)]
        n = size[order]
        laid = self.data[np.repeat(at[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        upto = np.concatenate([[0], np.cumsum(n)])
        cols = [pa.array(kept, pa.int32())]
        for v in self.of.values():
            cols.append(pa.array([_planes(v[order][x:y]) for x, y in zip(edges, edges[1:], strict=False)], pa.binary()))
        cols.append(pa.array([laid[upto[x] : upto[y]].tobytes() for x, y in zip(edges, edges[1:], strict=False)], pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=["part", *self.of, "data"])

    def repeats(self) -> tuple[np.ndarray, ...]:
        """(doc, hash, start, end) of the strings that also start earlier, by prefix doubling over the strings of equal prefixes."""
        count = self.of["count"].astype(np.int64)
        size = count + LENGTH - 1
        at = np.cumsum(size) - size
        _, group = np.unique(self.of["rank"], return_inverse=True)
        region = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(region)) - np.repeat(np.cumsum(count) - count, count)
        place = at[region] + nth  # of each string in data
        # equal strings have equal anchors at equal distances
        label = ranked(group[region] * 256 + (self.of["inner"].astype(np.int64)[region] - nth))
        padded = np.concatenate([self.data, np.zeros(LENGTH, np.uint8)])
        rank, done = ranked(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(self.data)].copy().view(np.uint64).ravel()), 8
        live = np.arange(len(region))
        while len(live):
            live = live[shared(label[live], rank[place[live]])]  # unique strings leave
            if done == LENGTH or not len(live):
                break
            step = min(done, LENGTH - done)
            ahead = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
            rank, done = ranked(rank * (len(rank) + 1) + ahead), done + step
        doc, hash_, start = (self.of[k][region[live]] for k in ("doc", "hash", "start"))
        start = start + nth[live]
        order = np.lexsort((start, hash_, doc, rank[place[live]], label[live]))
        g = {"doc": doc[order], "hash": hash_[order], "place": start[order]}
        dup = _later(g, _groups(label[live][order], rank[place[live]][order]))
        return g["doc"][dup], g["hash"][dup], g["place"][dup], g["place"][dup] + LENGTH


def ranked(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def shared(*keys: np.ndarray) -> np.ndarray:
    """Which rows have their keys in common with another row."""
    order = np.lexsort(keys)
    new = _groups(*[k[order] for k in keys])
    many = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(many, np.diff(np.append(np.flatnonzero(new), len(order))))
    return out


def _round2(docs: DataFrame, on: DataFrame, ranges: int) -> DataFrame:
    """Spans of the strings that the remaining anchors share."""
    names = [*Regions.KINDS, "data"]

    def local(batches):
        for b in slices(batches, 4 * ROWS):
            ids, hash_ = _keys(b)
            lists = [_lists(b.column(3 + k)) for k in range(4)]
            so = lists[0][1]
            for row, data, off in chunks(b.column(2), CHUNK):
                n = len(off) - 1
                s, e, rank, inner = (x[so[row] : so[row + n]] for x, _ in lists)
                who = np.repeat(np.arange(n), np.diff(so[row : row + n + 1]))
                rank, hot, count = rank.view(np.uint64).copy(), inner < 0, e - s + 1
                if hot.any():  # one region for each string
                    many = np.where(hot, count, 1)
                    of = np.repeat(np.arange(len(s)), many)
                    nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                    s, who, rank, count, hot, inner = s[of] + nth, who[of], rank[of], np.where(hot, 1, count)[of], hot[of], np.where(hot, 0, inner)[of]
                    p = off[who[hot]] + s[hot]
                    rank[hot] = Hashes(data).of(p, p + LENGTH)
                size, p = count + LENGTH - 1, off[who] + s
                laid = data[np.repeat(p - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                of = {"rank": rank, "doc": ids[row + who], "hash": hash_[row + who], "start": s, "count": count.astype(np.uint8), "inner": inner.astype(np.uint8)}
                if len(s):
                    yield Regions(of, laid).cells(ranges)

    def settle(batches):
        def ended(rows):
            of = {n: np.concatenate([_numbers(r[i], kind) for r in rows]) for i, (n, kind) in enumerate(Regions.KINDS.items())}
            return _spans_of(*Regions(of, np.frombuffer(b"".join(r[-1] for r in rows), np.uint8)).repeats())

        now, held = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k, part in enumerate(cols[0]):
                if part != now and held:
                    yield ended(held)
                    held = []
                now = part
                held.append([c[k] for c in cols[1:]])
        if held:
            yield ended(held)

    sent = _with_spans(docs, on, "inner").mapInArrow(lean(local), "part int, " + ", ".join(f"{n} binary" for n in names))
    return materialize(_laid(sent, ranges).mapInArrow(lean(settle), SPANS), "round2")


def repeated_spans(docs: DataFrame, crowd: int = HOT) -> DataFrame:
    """(doc_id, hash, text, starts, ends) of each row of docs: byte spans to remove, not yet merged (null if none)."""
    ranges = ranges_of(docs)
    sure, on = _round1(docs, ranges, crowd)
    rest = _round2(docs, on, ranges)
    return _with_spans(docs, sure.unionByName(rest), "left")


def removed(docs: DataFrame, keep_text: bool = False, crowd: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) and, if asked for, the kept bytes of each row of docs."""
    found = repeated_spans(docs, crowd)
    kind = found.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", kept binary" * keep_text

    def cut(batches):
        for b in slices(batches, ROWS):
            rows = []
            for text, starts, ends in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                merged: list[list[int]] = []
                for s, e in sorted(zip(starts or [], ends or [], strict=True)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at, kept = 0, []
                for s, e in merged:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                row = (len(raw), len(raw) - len(left), len(merged), hashlib.sha256(left).hexdigest(), [{"start": s, "end": e} for s, e in merged])
                rows.append((*row, left) if keep_text else row)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
            made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[: 5 + keep_text], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 6 + keep_text])

    return found.mapInArrow(lean(cut), schema)

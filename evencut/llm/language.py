"""Language identification by segmentation-marginalised unigrams.

The pieces are the lower-case letter pieces of a fixed public byte-level vocabulary (VOCABULARY, never
trained here); each language has a probability for each piece. A forward pass sums the probabilities of
all segmentations of a word into pieces, for all languages at once, and a text's score is the product
over its words. Piece probabilities are fitted by expectation maximisation over all segmentations (forward
and backward) on some TRAIN_ROWS rows, dealt over all languages of the table: each keeps all of its rows up to
a bound that the languages share, which is LEAST or more, and above it those of smallest hash, one at least.
Words of a batch are scored once each.

A text that is null or has no letter is `und` with score 0, as is every text if no language was learned.
Rows of null lang teach nothing; repeated rows are predicted alike; ties go to the first language by code
point; an empty table gives an empty result. Only doc_id, text and lang are read. A word of any length, as
in writing without spaces, is one word: long ones are summed in logarithms.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.llm.common import LOWER, Hashes, buffer, chunks, held_out, lean, owner, slices, spans

TRAIN_ROWS, LEAST, ROUNDS, SMOOTH = 8000, 200, 2, 0.05
USUAL, PART = 12, 1 << 19  # longer pieces are few and looked up only behind their first USUAL bytes; bytes of words that are summed at once
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """Piece numbers by hash; 0 is none. Every single byte is a piece, so each word has a segmentation."""

    def __init__(self, path: str | None = None) -> None:
        found = {bytes([b]) for b in (32, *np.flatnonzero(LETTER).tolist())}
        with open(path or vocabulary_path(), "rb") as lines:
            for line in lines:
                piece = base64.b64decode(line.split()[0]) if line.strip() else b""
                if re.fullmatch(rb" ?[a-z\x80-\xff]+", piece):
                    found.add(piece)
        self._index(sorted(found))

    def __getstate__(self):  # tables are made again where they are used: a broadcast holds the pieces only
        return self.pieces

    def __setstate__(self, pieces: list[bytes]) -> None:
        self._index(pieces)

    def _index(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        data = np.frombuffer(b"".join(self.pieces), np.uint8)
        size = np.array([len(p) for p in self.pieces])
        ends = np.cumsum(size)
        hashes = Hashes(data)
        keys = hashes.of(ends - size, ends)
        self.lengths = np.unique(size).tolist()
        long = size > USUAL
        self.fronts = np.unique(hashes.of((ends - size)[long], (ends - size)[long] + USUAL))
        self.keys = np.concatenate([np.zeros(1, np.uint64), keys])
        slot = (keys >> np.uint64(43)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        nth = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order])
        self.tables = [np.zeros(1 << 21, np.int32) for _ in range(int(nth.max()) + 1)]
        for k, table in enumerate(self.tables):
            table[slot[order[nth == k]]] = order[nth == k] + 1

    def number(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> np.uint64(43)).astype(np.int64)
        out = np.zeros(len(h), np.int32)
        for table in self.tables:
            at = table[slot]
            out = np.where(self.keys[at] == h, at, out)
        return out


def words(texts: pa.Array):
    """(hashes, units, size, row, index): the distinct words as units (a space, then the word) laid end to end, and each word's text and distinct word."""
    keys, rows, units, sizes = [], [], [], []
    for lo, data, off in chunks(texts):
        low = LOWER[data]
        s, e = spans(LETTER[low], off)
        h = Hashes(low).of(s, e)
        one, first, back = np.unique(h, return_index=True, return_inverse=True)
        size = (e - s)[first]
        end = np.cumsum(size + 1)
        unit = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
        at = np.repeat(s[first] - (end - size), size) + (np.arange(int(size.sum())) + np.repeat(np.arange(len(size)) + 1, size))
        body = np.ones(len(unit), bool)
        body[end - size - 1] = False
        unit[body] = low[at]
        keys.append((one, back))
        rows.append(owner(off, s) + lo)
        units.append(unit)
        sizes.append(size + 1)
    if not keys:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), z, z, z
    every = np.concatenate([k for k, _ in keys])
    size = np.concatenate(sizes)
    start = np.cumsum(size) - size
    flat = np.concatenate(units)
    _, first, back = np.unique(every, return_index=True, return_inverse=True)
    base = np.cumsum([0, *[len(k) for k, _ in keys]])
    index = np.concatenate([back[base[i] + b] for i, (_, b) in enumerate(keys)])
    keep = size[first]
    end = np.cumsum(keep)
    flat = flat[np.repeat(start[first] - (end - keep), keep) + np.arange(int(keep.sum()))]
    return flat, keep, np.concatenate(rows), index


class Lattice:
    """The pieces that match in some words, as edges between the places of each word; a word of m bytes has places 0 to m."""

    def __init__(self, pieces: Pieces, flat: np.ndarray, size: np.ndarray) -> None:
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        left = end[word] - np.arange(len(flat))  # bytes from here to the end of the word
        hashes, found = Hashes(flat), []
        some, sparse = np.arange(len(flat)), False
        for k in pieces.lengths:
            some = some[left[some] >= k]
            if k > USUAL and not sparse:
                front = hashes.of(some, some + USUAL)
                at = np.minimum(np.searchsorted(pieces.fronts, front), len(pieces.fronts) - 1)
                some, sparse = some[pieces.fronts[at] == front], True
            number = pieces.number(hashes.of(some, some + k))
            hit = np.flatnonzero(number)
            found.append((k, some[hit], number[hit]))
        start = np.concatenate([p for _, p, _ in found])
        length = np.concatenate([np.full(len(p), k) for k, p, _ in found])
        self.piece = np.concatenate([x for _, _, x in found])
        self.word = word[start]
        self.source, self.target = start + self.word, start + length + self.word  # places are numbered through all words
        self.first = end - size + np.arange(len(size))
        self.last = end + np.arange(len(size))
        self.places = len(flat) + len(size)

    def steps(self, forward: bool):
        """(edges, where each place begins among them, those places) for each distance from the start (or the end) of a word."""
        to = self.target if forward else self.source
        away = to - self.first[self.word] if forward else self.last[self.word] - to
        away = away.astype(np.uint16) if len(away) and away.max() < 1 << 16 else away
        order = np.argsort(to, kind="stable")
        order = order[np.argsort(away[order], kind="stable")]  # by distance, then place
        edges = np.concatenate([[0], np.flatnonzero(np.diff(away[order].astype(np.int64))) + 1, [len(order)]])
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                some = order[lo:hi]
                new = np.flatnonzero(np.concatenate([[True], to[some[1:]] != to[some[:-1]]]))
                yield some, new, to[some[new]]


def parts(size: np.ndarray, most: int = PART):
    """Runs of words of about most bytes."""
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


class Model:
    """Piece probabilities: prob[piece number, language], row 0 being 0."""

    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray) -> None:
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def _sums(self, lattice: Lattice, forward: bool, logs: bool) -> np.ndarray:
        """[language, place]: the sum over all segmentations of what lies before (or behind) each place, or its logarithm."""
        out = np.full((len(self.langs), lattice.places), -np.inf if logs else 0.0)
        out[:, lattice.first if forward else lattice.last] = 0.0 if logs else 1.0
        with np.errstate(divide="ignore"):
            weight = np.ascontiguousarray((np.log(self.prob) if logs else self.prob).T)
        for some, new, places in lattice.steps(forward):
            x, w = out[:, (lattice.source if forward else lattice.target)[some]], weight[:, lattice.piece[some]]
            if not logs:
                out[:, places] = np.add.reduceat(x * w, new, axis=1)
                continue
            x = x + w
            top = np.maximum.reduceat(x, new, axis=1)
            x = np.exp(x - np.repeat(top, np.diff(np.append(new, x.shape[1])), axis=1))
            out[:, places] = top + np.log(np.add.reduceat(x, new, axis=1))
        return out

    def log_likelihood(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        out, place = np.zeros((len(size), len(self.langs))), np.cumsum(size) - size
        letters = np.unique(flat)
        single = self.pieces.number(Hashes(letters).of(np.arange(len(letters)), np.arange(len(letters)) + 1))
        safe = 600 / -np.log(max(self.prob[single].min(), 1e-300)) if len(letters) else 0  # sums of shorter words stay above the smallest number
        for logs in (False, True):
            which = np.flatnonzero((size > safe) == logs)
            for lo, hi in parts(size[which]):
                w = which[lo:hi]
                n = size[w]
                local = flat[np.repeat(place[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                lattice = Lattice(self.pieces, local, n)
                got = self._sums(lattice, True, logs)[:, lattice.last]
                out[w] = (got if logs else np.log(got)).T
        return out

    def expected(self, flat: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that occur weight[word, language] times."""
        out, place = np.zeros_like(self.prob), np.cumsum(size) - size
        with np.errstate(divide="ignore"):
            log = np.log(self.prob)
        for lo, hi in parts(size):
            at = place[lo]
            lattice = Lattice(self.pieces, flat[at : at + int(size[lo:hi].sum())], size[lo:hi])
            before, behind = self._sums(lattice, True, True), self._sums(lattice, False, True)
            for c in range(len(self.langs)):
                share = np.exp(before[c, lattice.source] + log[lattice.piece, c] + behind[c, lattice.target] - before[c, lattice.last][lattice.word])
                out[:, c] += np.bincount(lattice.piece, share * weight[lo:hi][lattice.word, c], minlength=len(out))
        out[0] = 0
        return out


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities with a little of the pieces' counts over all languages, and of one for every piece."""
    shared = counts.sum(axis=1, keepdims=True)
    shared = (shared + 0.1) / (shared + 0.1).sum()
    p = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-12)
    p = (1 - SMOOTH) * p + SMOOTH * shared
    p[0] = 0
    return p / p.sum(axis=0, keepdims=True)


def shared_bound(counts: list[int], most: int) -> int:
    """The largest bound on the rows of each language with which all keep at most most rows together; LEAST at least."""
    left, bound = most, 0
    for i, n in enumerate(sorted(counts)):
        bound = left // (len(counts) - i)
        if n > bound:
            return max(bound, LEAST)
        left -= n
    return max(*counts, LEAST) if counts else LEAST


def fit(docs: DataFrame, path: str | None = None, most: int = TRAIN_ROWS) -> Model:
    """The model of the rows of docs that are not held out and have a lang."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out("doc_id", 4, 2), F.lit(True))).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    at = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(at).alias("first")).collect()  # a row for each language
    langs = sorted(r.lang for r in found)
    bound = shared_bound([r.n for r in found], most)
    if any(r.n > bound for r in found):
        under = [(r.lang, max(r.first + 1, int((1 << 30) * min(1.0, bound / r.n)))) for r in found]
        rows = rows.join(F.broadcast(spark.createDataFrame(under, "lang string, under long")), "lang").filter(at < F.col("under")).select("doc_id", "text", "lang")
    pieces = Pieces(path)
    size = len(pieces.pieces) + 1
    model = Model(pieces, langs, np.full((size, max(1, len(langs))), 1.0 / size))
    model.prob[0] = 0
    if not langs:
        return model
    code = {x: i for i, x in enumerate(langs)}
    spread = rows.select("text", "lang").repartition(12)
    # short pieces first: the start weighs a piece by its length, so that longer ones count from the first round
    long = np.array([0.0, *[4.0 ** min(len(p), 10) for p in pieces.pieces]])
    model.prob = np.repeat((long / long.sum())[:, None], len(langs), axis=1)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            total = None
            for b in slices(batches, 2500):
                flat, sizes, row, index = words(b.column(0))
                of = np.array([code[x] for x in b.column(1).to_pylist()])
                k = len(code)
                weight = np.bincount(index * k + of[row], minlength=len(sizes) * k).reshape(-1, k).astype(float)
                new = shared.value.expected(flat, sizes, weight)
                total = new if total is None else total + new
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["counts"])

        counts = np.zeros_like(model.prob)
        for r in spread.mapInArrow(lean(run), "counts binary").toLocalIterator():  # 12 rows at most
            counts += np.frombuffer(r.counts).reshape(counts.shape)
        model = Model(pieces, langs, _normalised(counts))
    return model


def _has_letter(texts: pa.Array) -> np.ndarray:
    data, off = buffer(texts)
    ascii_ = LETTER.copy()
    ascii_[128:] = False
    any_ = np.diff(np.concatenate([[0], np.cumsum(ascii_[LOWER[data[off[0] : off[-1]]]], dtype=np.int64)])[off - off[0]]) > 0
    for i in np.flatnonzero(~any_).tolist():
        t = texts[i].as_py()
        any_[i] = bool(t) and any(c.isalpha() for c in t)
    return any_


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    k, n = len(model.langs), len(texts)
    if not k:
        return ["und"] * n, np.zeros(n)
    flat, size, row, index = words(texts)
    each = model.log_likelihood(flat, size)
    total = np.stack([np.bincount(row, each[index, c], minlength=n) for c in range(k)], axis=1) if len(row) else np.zeros((n, k))
    best = total.argmax(axis=1)
    rate = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    known = _has_letter(texts)
    return [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, rate, 0.0)


def predict(docs: DataFrame, path: str | None = None, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, path, most))
    d = docs.select("doc_id", "text")

    def run(batches):
        for b in slices(batches, 2500):
            lang, score = predict_batch(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score")

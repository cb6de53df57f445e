"""Quality by regularised quadratic discriminants over transformed document statistics.

Each class has a mean and a covariance that shrinks to the pooled one and to its own average variance;
the score is the logistic function of the difference of Mahalanobis log-densities, computed with cached
Cholesky factors. Moments are sums over every labelled training row (at most TRAIN_ROWS, those of
smallest hash). Statistics come from whole texts and from nothing else.

Null and empty texts have statistics of their own (no words) and are scored like others; duplicated
labels count once; with labels of one class only, every score is 1 or 0 for that class, and 0.5 without
labels. Repeated rows score alike; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.llm.common import SPACE, Hashes, chunks, held_out, lean, materialize, mix, owner, spans, training

TRAIN_ROWS, POOL, RIDGE = 200_000, 0.15, 0.05
NAMES = ("words", "word_len", "symbols", "digits", "capitals", "points", "distinct", "dup_lines", "repeats", "line_words", "other_bytes", "top_word")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOL, DIGIT, POINT = _class("#*$%&|<>{}[]=_~^\\@+"), _class("0123456789"), _class(".,;:!?")
UPPER, NEWLINE = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("\n")
HIGH = np.arange(256) >= 128


def _repeated(who: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many of its hashes differ, and how often the most frequent occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.argsort(h, kind="stable")  # stable, and who ascends: equal hashes of a text stand together
    w, k = who[order], h[order]
    start = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
    at = np.flatnonzero(start)
    run = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, w[at], run)
    return np.bincount(w[at], minlength=n).astype(float), top


def features(texts: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for lo, data, off in chunks(texts):
        n = len(off) - 1
        starts, ends = spans(~SPACE[data], off)
        who = owner(off, starts)
        words = np.bincount(who, minlength=n).astype(float)
        size = np.bincount(who, ends - starts, minlength=n)
        per = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])[off]).astype(float)
        w, b = np.maximum(words, 1), np.maximum(size, 1)
        hashes = Hashes(data)
        h = hashes.of(starts, ends)
        distinct, top = _repeated(who, h, n)
        tri = mix(h[:-2] + h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7)) if len(h) > 2 else h[:0]
        inside = who[2:] == who[:-2] if len(h) > 2 else np.zeros(0, bool)
        many = np.bincount(who[:-2][inside], minlength=n) if len(h) > 2 else np.zeros(n)
        kinds, _ = _repeated(who[:-2][inside], tri[inside], n) if len(h) > 2 else (np.zeros(n), None)
        ls, le = spans(~NEWLINE[data], off)
        lw = owner(off, ls)
        lines = np.bincount(lw, minlength=n).astype(float)
        line_kinds, _ = _repeated(lw, hashes.of(ls, le), n)
        arc = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
        out[lo : lo + n] = np.stack([
            np.log1p(words), np.log(b / w), np.log1p(10 * per(SYMBOL) / w), arc(per(DIGIT) / b), arc(per(UPPER) / b), arc(per(POINT) / b), arc(distinct / w),
            arc((lines - line_kinds) / np.maximum(lines, 1)), arc((many - kinds) / np.maximum(many, 1)), np.log1p(words / np.maximum(lines, 1)), arc(per(HIGH) / b), arc(top / w),
        ], axis=1)
    return out


class Discriminant:
    """Means and inverse Cholesky factors of both classes."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> None:
        p = sums.shape[1]
        self.prior = float(np.log(max(n[1], 1e-9)) - np.log(max(n[0], 1e-9)))
        self.known = n > 1
        mean = sums / np.maximum(n, 1)[:, None]
        cov = squares / np.maximum(n, 1)[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(axis=0) / max(n.sum(), 1)
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-4))
        self.mean, self.inverse, self.half = mean / self.scale, [], []
        for c in (0, 1):
            s = ((1 - POOL) * cov[c] + POOL * pooled) / np.outer(self.scale, self.scale)
            s = (1 - RIDGE) * s + RIDGE * max(np.trace(s) / p, 1e-3) * np.eye(p)
            low = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(low))
            self.half.append(float(np.log(np.diag(low)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known.all():
            return np.full(len(x), 0.5 if not self.known.any() else float(self.known[1]))
        z = x / self.scale
        log = [-0.5 * (((z - self.mean[c]) @ self.inverse[c].T) ** 2).sum(axis=1) - self.half[c] for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -700, 700)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    d = docs.select("doc_id", "text")

    def run(batches):
        for b in batches:
            x = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))], names=["doc_id", "x"])

    return d.mapInArrow(lean(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, x array<double>")


def fit(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Discriminant:
    p = len(NAMES)
    rows = stats.join(training(labels, "quality", most, held_out("doc_id", 3, 1)), "doc_id")
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    got = rows.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(p)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]).collect()
    n, sums, squares = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for r in got:
        c = int(r.y > 0)
        n[c] += r.n
        sums[c] += [r[f"s{i}"] for i in range(p)]
        for i, j in pairs:
            squares[c, i, j] += r[f"q{i}_{j}"]
            squares[c, j, i] = squares[c, i, j]
    return Discriminant(n, sums, squares)


def scores(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    stats = materialize(measured(docs), "quality")
    model = fit(stats, labels, most)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = stats.mapInArrow(lean(run), f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "score", "predicted")

"""The stages over the smallest tables, and each against a plain version of it."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evencut.llm import mixing, quality_rules
from evencut.llm.common import materialize

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test")
        out.append(docs)
    return [(d.columns, d.collect()) for d in out]


def texts(rows):
    return collections.Counter((r.doc_id, r.text) for r in rows)


def test_stages(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for columns, rows in stages[:-1]:
        assert columns == stages[0][0] and rows
    assert len(stages[-1][1]) == len(stages[-2][1]) and "shard_id" in stages[-1][0]


def vector(text):
    """(words, fails the base rules, transformed statistics) of a text."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for k in range(len(words) - 2):
        at[tuple(words[k : k + 3])].append(k)
    repeated = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
    n, m = max(len(words), 1), max(len(lines), 1)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    x = [math.log(max(sum(map(len, words)), 1) / n), math.log1p(10 * symbols / n), math.asin(math.sqrt((len(lines) - len(set(lines))) / m)), math.asin(math.sqrt(min(1, repeated / n)))]
    return len(words) < 50 or 100 * repeated > 50 * len(words), np.array(x)


def lowest(v, q):
    return np.sort(v, axis=0)[max(0, math.ceil(q * len(v)) - 1)]


def distances(x, mean, cov):
    z = x - mean
    return np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)


def robust(groups):
    """(mean, scatter without floors) of each group: concentration from two starts, the smallest determinant, reweighting."""
    floors, q = np.diag(np.square(quality_rules.FLOORS)), quality_rules
    now = {}
    for k, x in groups.items():
        mid = lowest(x, 0.5)
        now[k, 0], now[k, 1] = (mid, floors), (mid, floors + np.diag(np.square(1.4826 * lowest(np.abs(x - mid), 0.5))))
    best = None
    for _ in range(q.STEPS):
        for (k, start), (mean, cov) in now.items():
            d = distances(groups[k], mean, cov)
            half = groups[k][d <= lowest(d, q.HALF) * (1 + 1e-12)]
            now[k, start] = (half.mean(axis=0), q.consistent(0.5, 4) * np.cov(half.T, bias=True) + floors)
        det = {k: np.linalg.slogdet(c)[1] for k, (_, c) in now.items()}
        if best is None:
            best = {k: (det[k], *now[k]) for k in now}
            continue
        fell = max(best[k][0] - det[k] for k in now)
        best = {k: min(best[k], (det[k], *now[k]), key=lambda t: t[0]) for k in now}
        if fell <= q.TOLERANCE:
            break
    out = {}
    for k, x in groups.items():
        _, mean, cov = min(best[k, 0], best[k, 1], key=lambda t: t[0])
        near = x[distances(x, mean, cov) <= q.INNER]
        out[k] = (len(near), near.mean(axis=0), q.consistent(0.975, 4) * np.cov(near.T, bias=True))
    return out


def drawn(own, other):
    w = own[0] / (own[0] + quality_rules.PRIOR)
    return own[0], w * own[1] + (1 - w) * other[1], w * own[2] + (1 - w) * other[2]


def test_quality_stage(stages):
    judged = [(r, *vector(r.text)) for r in stages[0][1]]
    groups = collections.defaultdict(list)
    for r, failed, x in judged:
        if not failed:
            for level in ((r.lang, r.source), (r.lang,), ()):
                groups[level].append(x)
    fits = robust({k: np.array(v) for k, v in groups.items()})
    floors = np.diag(np.square(quality_rules.FLOORS))
    keep = []
    for r, failed, x in judged:
        if failed:
            continue
        _, mean, cov = drawn(fits[r.lang, r.source], drawn(fits[(r.lang,)], fits[()]))
        if distances(x[None], mean, cov + floors)[0] <= quality_rules.CUTOFF:
            keep.append(r)
    assert texts(stages[1][1]) == texts(keep) and 0 < len(keep) < len(judged)


def test_near_dedup_stage(stages):
    rows, prints = stages[1][1], []
    for r in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = top(i), top(j)
                a, b = (a, b) if rows[a].doc_id < rows[b].doc_id else (b, a)
                root[b] = a
    assert texts(stages[2][1]) == texts(rows[i] for i in range(len(rows)) if top(i) == i)
    assert len(stages[2][1]) < len(rows)


def test_decontamination_stage(spark, stages):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t)
    told = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = word.findall(lower(r.text or ""))
        told |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    want, cut = collections.Counter(), 0
    for r in stages[2][1]:
        spans = [m.span() for m in word.finditer(lower(r.text or ""))]
        w = [lower(r.text)[a:b] for a, b in spans]
        hit = [False] * len(w)
        for n in {len(x) for x in told}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in told:
                    hit[k : k + n] = [True] * n
        gone = set()
        for k, (a, b) in enumerate(spans):
            if hit[k]:
                # what lies between two words goes if one occurrence, or two that touch, cover both
                gone |= set(range(a, b)) | (set(range(b, spans[k + 1][0])) if k + 1 < len(w) and hit[k + 1] else set())
        cut += bool(gone)
        want[r.doc_id, "".join(c for i, c in enumerate(r.text) if i not in gone) if gone else r.text] += 1
    assert texts(stages[3][1]) == want and cut > 0


def test_source_mix_stage(spark, stages):
    rows = spark.createDataFrame(stages[3][1], ", ".join(f"`{c}` {t}" for c, t in spark.read.parquet(f"{DATA}/documents.parquet").dtypes))
    coin = F.pmod(F.xxhash64(F.lit("copy"), "doc_id", "h"), F.lit(1 << 30)) / float(1 << 30)
    seen = rows.select("doc_id", "text", "source", mixing.shuffle_key(F.col("doc_id"), F.col("text")).alias("h")).select("*", coin.alias("coin")).collect()
    by = collections.defaultdict(list)
    for r in seen:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    size = {(r.doc_id, r.h): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in seen}
    total = {s: sum(size[r.doc_id, r.h] for r in by[s]) for s in names}
    weight, left, goal = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(total.values()), {}
    while len(goal) < len(names):  # settle the sources above their limit, then share the rest
        free = [s for s in names if s not in goal]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        goal |= {s: 3 * total[s] for s in over} if over else share
        left -= sum(3 * total[s] for s in over)
    want = collections.Counter()
    for s in names:
        assert all(r.h == int(hashlib.md5(f"{r.doc_id}|{r.text or ''}".encode()).hexdigest()[:15], 16) for r in by[s])
        words = [r for r in sorted(by[s], key=lambda r: (r.h, r.doc_id)) for _ in range(size[r.doc_id, r.h])]
        bucket = max(1, -(-len(seen) // mixing.ROWS_PER_BUCKET))
        assert bucket == 1  # one bucket: the shuffled order is that of h
        take = min(math.floor(goal[s] + 0.5), 3 * total[s])
        taken = collections.Counter((words[k % total[s]].doc_id, words[k % total[s]].h) for k in range(take)) if total[s] else {}
        for r in by[s]:
            n = size[r.doc_id, r.h]
            if n:
                want[r.doc_id, r.text] += math.floor(taken.get((r.doc_id, r.h), 0) / n + r.coin)
    assert texts(stages[4][1]) == +want


def test_sharding_stage(stages):
    assert collections.Counter(r.doc_id for r in stages[5][1]) == collections.Counter(r.doc_id for r in stages[4][1])
    inside = collections.Counter(r.shard_id for r in stages[5][1])
    assert all(r.shard_rows == inside[r.shard_id] for r in stages[5][1]) and len({r.version for r in stages[5][1]}) == 1

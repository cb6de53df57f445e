"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary labelled texts, smoothed by absolute discounts. With
n_c(h, w) the count of word w after word h in class c, and D_c the class's discount,

    p_c(w | h) = (max(n_c(h, w) - D_c, 0) + r_c(h) u_c(w)) / n_c(h),    r_c(h) = sum over w of min(n_c(h, w), D_c)
    u_c(w) = (max(m_c(w) - U_c, 0) + R_c s(w)) / M_c,                   R_c = sum over w of min(m_c(w), U_c)
    s(w) = (min(m_0(w), U_0) + min(m_1(w), U_1) + 1/2) / (R_0 + R_1 + (V + 1) / 2)

where m_c(w), the continuation count, is what the bigrams that end in w gave up: the sum over h of
min(n_c(h, w), D_c). s holds the backoff counts that both classes share, with V distinct words and one
that was never seen, so an expression that is rare in both classes weighs the same in both. Each model
sums to one (an unseen context has u_c). Discounts are in proportion to the classes' sizes (U = d for the
smaller class, D = BIGRAM * d), else every rare word would look likelier in the larger class.

A text of either class is mostly ordinary prose, so both models give 1 - OWN of each word's probability to
their common mixture. A text's evidence is the difference of its two log-likelihoods, each word's measured
from the text's median word (a language that is a little rarer in one class shifts all of its words alike),
over its words and PRIOR_WORDS more. There is one evidence of the bigrams p_c(w | h) and one of the continuation
counts u_c(w) alone: the score is logistic in both, so that the calibrating rows say how much either order is worth,
and bigrams keep what their discounts leave even where the labels are too few to trust them as much as words.
d comes from DISCOUNTS by the log-loss of the calibrating rows.

Counts cover every training row and are exact: distinct bigrams, by the 64-bit hashes of their words, are
grouped and joined as tables that grow with the corpus. What differs from the backoff reaches the scoring
tasks by broadcast up to TABLE rows, and by joins with the words of the texts beyond that.

Of the labelled rows that are not held out four in five give the counts, the fifth chooses d and calibrates
the score (at most CALIBRATE of them, those of smallest hash). OWN, PRIOR_WORDS and BIGRAM were chosen by
folds of rows that are not held out. Null and empty texts have the score of no evidence; a text of any length
is scored whole; duplicated labels of a document count once, as toxic if any says so; without labels of both
classes every score is the share of toxic labels (0 if there are none). Repeated rows score alike; an empty
table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evencut.llm.common import ALNUM, LOWER, Hashes, chunks, held_out, lean, materialize, mix, owner, slices, spans, training

CALIBRATE, TABLE, LABELS = 200_000, 8_000_000, 2_000_000
DISCOUNTS, BIGRAM, OWN, PRIOR_WORDS = (1, 2, 4, 8, 16, 32), 1, 0.01, 20.0
PART = (1 << 19) - 1  # bytes of text that a task takes at once
PAIR = np.uint64(0x9FB21C651E98DF25)


def tokens(data: np.ndarray, off: np.ndarray):
    """(text, context, word) of each word, by hash; a text's first word has context 0."""
    low = LOWER[data]
    starts, ends = spans(ALNUM[low], off)
    h = Hashes(low).of(starts, ends)
    who = owner(off, starts)
    before = np.zeros(len(h), np.uint64)
    before[1:] = np.where(who[1:] == who[:-1], h[:-1], np.uint64(0))
    return who, before, h


def paired(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context * PAIR + word)


def counted(train: DataFrame) -> DataFrame:
    """(context, word, n0, n1): how often each distinct bigram of (text, y) stands in each class."""

    def local(batches):
        for b in slices(batches, 2500):
            y = b.column(1).to_numpy(zero_copy_only=False)
            for lo, data, off in chunks(b.column(0), PART):
                who, before, word = tokens(data, off)
                toxic = y[lo : lo + len(off) - 1][who] == 1
                _, first, back = np.unique(paired(before, word), return_index=True, return_inverse=True)
                n = [np.bincount(back[some], minlength=len(first)).astype(np.int64) for some in (~toxic, toxic)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in (before, word)), *map(pa.array, n)], names=["context", "word", "n0", "n1"])

    rows = train.select("text", "y").mapInArrow(lean(local), "context long, word long, n0 long, n1 long")
    return rows.groupBy("context", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Counts:
    """The bigram counts of both classes and, for each d, the continuation counts and sums of the models."""

    def __init__(self, train: DataFrame, discounts=DISCOUNTS) -> None:
        self.discounts = discounts
        self.bigrams = materialize(counted(train).sortWithinPartitions("word"), "bigrams")  # sorted: a fraction of the bytes
        total = self.bigrams.agg(F.sum("n0"), F.sum("n1")).first()
        self.total = [float(max(1, x or 0)) for x in total]
        self.big = {d: [BIGRAM * d * x / min(self.total) for x in self.total] for d in discounts}
        given = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(self.big[d][c]))).alias(f"m{c}_{d}") for d in discounts for c in (0, 1)]
        self.words = materialize(self.bigrams.groupBy("word").agg(*given), "words")
        names = [f"m{c}_{d}" for d in discounts for c in (0, 1)]
        m = self.words.agg(*[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in names], F.count("*").alias("v")).first()
        self.types = m.v
        self.mass = {d: [max(m[f"m{c}_{d}"], 1e-9) for c in (0, 1)] for d in discounts}
        self.small = {d: [d * x / min(self.mass[d]) for x in self.mass[d]] for d in discounts}
        back = self.words.agg(*[F.coalesce(F.sum(F.least(F.col(f"m{c}_{d}"), F.lit(self.small[d][c]))), F.lit(0.0)).alias(f"m{c}_{d}") for d in discounts for c in (0, 1)]).first()
        self.back = {d: [max(back[f"m{c}_{d}"], 1e-9) for c in (0, 1)] for d in discounts}

        # what stands out at the smallest d does for all: bigrams, their contexts, and the words above their discounts
        d = min(discounts)
        self.large = materialize(self.bigrams.filter((F.col("n0") > self.big[d][0]) | (F.col("n1") > self.big[d][1])), "large")
        n = self.large.count()
        few = (lambda x: F.broadcast(x)) if n <= LABELS else (lambda x: x)  # so that neither all bigrams nor all words are exchanged
        inside = self.bigrams.join(few(self.large.select("context").distinct()), "context", "left_semi")
        given = [F.sum(F.least(F.col(f"n{c}").cast("double"), F.lit(self.big[d][c]))).alias(f"r{c}_{d}") for d in discounts for c in (0, 1)]
        self.contexts = materialize(inside.groupBy("context").agg(*[F.sum(f"n{c}").cast("double").alias(f"h{c}") for c in (0, 1)], *given), "contexts")
        above = reduce(lambda x, y: x | y, [F.col(f"m{c}_{d}") > self.small[d][c] for d in discounts for c in (0, 1)])
        needed = self.large.select("word").distinct().withColumn("needed", F.lit(True))
        self.telling_words = materialize(self.words.join(few(needed), "word", "left").filter(above | F.col("needed")).drop("needed"), "telling")
        self.size = n + self.contexts.count() + self.telling_words.count()

    def unseen(self, d: int) -> float:
        """log u_1 / u_0 of a word whose counts are all given to the backoff."""
        return float(np.log(self.back[d][1] / self.mass[d][1]) - np.log(self.back[d][0] / self.mass[d][0]))

    def unigrams(self, d: int) -> DataFrame:
        """(word, u0, u1, more) of the telling words; more is whether the word has counts above its discounts."""
        both = [F.least(F.col(f"m{c}_{d}"), F.lit(self.small[d][c])) for c in (0, 1)]
        s = (both[0] + both[1] + 0.5) / (sum(self.back[d]) + 0.5 * (self.types + 1))
        u = [((F.col(f"m{c}_{d}") - both[c] + self.back[d][c] * s) / self.mass[d][c]).alias(f"u{c}") for c in (0, 1)]
        return self.telling_words.select("word", *u, ((F.col(f"m0_{d}") > both[0]) | (F.col(f"m1_{d}") > both[1])).alias("more"))

    def telling(self, d: int) -> DataFrame:
        """(level, a, b, r): log-ratios of words (0, a the word), contexts (1, a the context) and bigrams (2, a and b), where they are not those of the level below."""
        level = lambda df, k, a, b, r: df.select(F.lit(k).alias("level"), a.alias("a"), b.alias("b"), r.alias("r"))
        none, words = F.lit(0).cast("long"), self.unigrams(d)
        share = [F.when(F.col(f"h{c}") > 0, F.col(f"r{c}_{d}") / F.col(f"h{c}")).otherwise(1.0) for c in (0, 1)]  # an unseen context backs off whole
        left = self.contexts.select("context", "h0", "h1", *[share[c].alias(f"s{c}") for c in (0, 1)]).filter("s0 < 1 or s1 < 1")
        own = [F.when(F.col(f"h{c}") > 0, F.greatest(F.col(f"n{c}") - self.big[d][c], F.lit(0.0)) / F.col(f"h{c}")).otherwise(0.0) for c in (0, 1)]
        p = [own[c] + F.col(f"s{c}") * F.col(f"u{c}") for c in (0, 1)]
        pairs = self.large.filter((F.col("n0") > self.big[d][0]) | (F.col("n1") > self.big[d][1])).join(left, "context").join(words, "word")
        one = level(words.filter("more"), 0, F.col("word"), none, F.log(F.col("u1") / F.col("u0")))
        two = level(left, 1, F.col("context"), none, F.log(F.col("s1") / F.col("s0")))
        return one.unionByName(two).unionByName(level(pairs, 2, F.col("context"), F.col("word"), F.log(p[1] / p[0])))

    def weigh(self, r: np.ndarray) -> np.ndarray:
        """log-ratios after both models give 1 - OWN to their mixture."""
        share = self.total[1] / sum(self.total)
        e = np.exp(np.clip(r, -50, 50))
        common = (1 - OWN) * (1 - share + share * e)
        return np.log((OWN * e + common) / (OWN + common))

    def __getstate__(self):  # what the scoring tasks need
        return {"total": self.total}


class Model:
    """Both evidences of texts from tables of log-ratios held in memory."""

    def __init__(self, counts: Counts, unseen: float, rows: pa.Table) -> None:
        self.counts, self.unseen = counts, unseen
        level, a, b, r = (rows.column(k).to_numpy() for k in ("level", "a", "b", "r"))
        self.tables = []
        for k in range(3):
            keys = a[level == k].view(np.uint64)
            keys = paired(keys, b[level == k].view(np.uint64)) if k == 2 else keys
            order = np.argsort(keys)
            self.tables.append((np.append(keys[order], np.uint64(0)), np.append(r[level == k][order], 0.0)))  # a last entry for what is not found

    def _find(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, r = self.tables[k]
        at = np.searchsorted(known[:-1], keys)
        return r[at], (known[at] == keys) & (at < len(known) - 1)

    def ratios(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log p_1(w | h) / p_0(w | h) of each word in its context, and log u_1(w) / u_0(w)."""
        own, hit = self._find(0, word)
        alone = np.where(hit, own, self.unseen)
        left, hit = self._find(1, context)
        out = alone + np.where(hit, left, 0.0)
        some = np.flatnonzero(hit)  # only these contexts have bigrams of their own
        pair, hit = self._find(2, paired(context[some], word[some]))
        out[some[hit]] = pair[hit]
        return out, alone

    def evidence(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((2, len(texts)))
        for lo, data, off in chunks(texts, PART):
            who, context, word = tokens(data, off)
            for k, r in enumerate(self.ratios(context, word)):
                out[k, lo : lo + len(off) - 1] = centred(who, self.counts.weigh(r), len(off) - 1)
        return out


def centred(who: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts, the sum of its words' r from their (lower) median, over its words and PRIOR_WORDS."""
    size = np.bincount(who, minlength=n)
    middle = np.zeros(n)
    some = np.flatnonzero(size)
    ordered = r[np.lexsort((r, who))]
    middle[some] = ordered[(np.cumsum(size) - size + (size - 1) // 2)[some]]
    return (np.bincount(who, r, minlength=n) - size * middle) / (size + PRIOR_WORDS)


def joined_evidence(docs: DataFrame, counts: Counts, d: int, found: DataFrame) -> DataFrame:
    """docs with their evidences as columns x and u, by joins of their words with found: for tables too large for a task."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def words(batches):
        for b in batches:
            for lo, data, off in chunks(b.column(1), PART):
                who, context, word = tokens(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who + lo)), *(pa.array(x.view(np.int64)) for x in (context, word))], names=["_row", "context", "word"])

    each = rows.select("_row", "text").mapInArrow(lean(words), "_row long, context long, word long")
    level = lambda k, *names: found.filter(F.col("level") == k).select(*[F.col(x).alias(y) for x, y in zip("ab", names, strict=False)], F.col("r").alias(f"r{k}"))
    each = each.join(level(0, "word"), "word", "left").join(level(1, "context"), "context", "left").join(level(2, "context", "word"), ["context", "word"], "left")
    alone = F.coalesce("r0", F.lit(counts.unseen(d)))
    each = each.select("_row", F.coalesce("r2", alone + F.coalesce("r1", F.lit(0.0))).alias("x"), alone.alias("u"))

    def weighed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts.weigh(b.column(k).to_numpy())) for k in (1, 2))], names=["_row", "x", "u"])

    each = each.mapInArrow(weighed, "_row long, x double, u double")
    middle = [F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {r})").alias(f"m{r}") for r in "xu"]
    sums = each.groupBy(F.col("_row").alias("_of")).agg(F.count("*").alias("n"), *[F.sum(r).alias(f"s{r}") for r in "xu"], *middle)
    both = [F.coalesce((F.col(f"s{r}") - F.col("n") * F.col(f"m{r}")) / (F.col("n") + PRIOR_WORDS), F.lit(0.0)).alias(r) for r in "xu"]
    return rows.join(sums, F.col("_row") == F.col("_of"), "left").select(*docs.columns, *both)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes of the columns of x and offset, by damped Newton steps with a small ridge."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    a = np.zeros(z.shape[1])
    cost = lambda a: _loss(z, y, a) + 5e-4 * float(a @ a)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(len(a)), z.T @ (y - p) - 1e-3 * a)
        now = cost(a)
        while cost(a + step) > now and np.abs(step).max() >= 1e-8:
            step = step / 2
        a = a + step
        if np.abs(step).max() < 1e-8:
            break
    return a[:-1] / scale, float(a[-1])


def _loss(x: np.ndarray, y: np.ndarray, slopes: np.ndarray, offset: float = 0.0) -> float:
    z = np.clip(x @ slopes + offset, -700, 700)
    return float(np.logaddexp(0, -z)[y > 0].sum() + np.logaddexp(0, z)[y == 0].sum())


class Fitted:
    """What gives docs columns x and u, the evidences of bigrams and of words, and the slopes and offset of the score."""

    def __init__(self, docs: DataFrame, labels: DataFrame, discounts=DISCOUNTS, table: int = TABLE) -> None:
        rows = materialize(training(labels, "toxic", None, held_out("doc_id", 5, 0)), "labels")
        fold = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0
        seen = rows.groupBy(fold.alias("f")).agg(F.count("*").alias("n")).collect()
        n = {r.f: r.n for r in seen}
        few = (lambda x: F.broadcast(x)) if sum(n.values()) <= LABELS else (lambda x: x)  # 12 bytes a row, so that no text is exchanged
        texts = docs.select("doc_id", "text")
        some = rows.filter(fold)
        if n.get(True, 0) > CALIBRATE:
            some = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * CALIBRATE / n[True]))
        self.slopes, self.models, self.table = np.zeros(2), {}, table
        self.counts = Counts(texts.join(few(rows.filter(~fold)), "doc_id"), discounts)
        held = materialize(texts.join(few(some), "doc_id").select("doc_id", "text", "y"), "calibrate")
        share = rows.agg(F.avg("y")).first()[0] or 0.0
        self.d, self.offset, best = discounts[-1], float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), None
        for d in discounts:
            found = self.evidence(held, d).select("x", "u", "y").toArrow()  # CALIBRATE rows at most, three numbers each
            x, y = np.column_stack([found.column(k).to_numpy() for k in "xu"]), found.column("y").to_numpy().astype(np.float64)
            if not len(y) or y.min() == y.max():
                break
            line = logistic(x, y)
            loss = _loss(x, y, *line)
            if best is None or loss < best:
                best, self.d, (self.slopes, self.offset) = loss, d, line

    def evidence(self, docs: DataFrame, d: int | None = None) -> DataFrame:
        """docs with columns x and u."""
        d = self.d if d is None else d
        if d not in self.models:
            found = self.counts.telling(d)
            if self.counts.size > self.table:  # at the smallest d, which others may fall below
                found = materialize(found, "table")
            if self.counts.size > self.table and found.count() > self.table:
                self.models[d] = found
            else:
                self.models[d] = docs.sparkSession.sparkContext.broadcast(Model(self.counts, self.counts.unseen(d), found.toArrow()))
        if isinstance(self.models[d], DataFrame):
            return joined_evidence(docs, self.counts, d, self.models[d])
        shared, at = self.models[d], docs.columns.index("text")

        def run(batches):
            for b in slices(batches, 2500):
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, shared.value.evidence(b.column(at)))], names=[*b.schema.names, "x", "u"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(lean(run), f"{kinds}, x double, u double")


def scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, word_evidence) for each row of docs."""
    fitted = Fitted(docs, labels, **settings)
    score = 1 / (1 + F.exp(-(F.lit(float(fitted.slopes[0])) * F.col("x") + F.lit(float(fitted.slopes[1])) * F.col("u") + F.lit(fitted.offset))))
    out = fitted.evidence(docs.select("doc_id", "text")).select("doc_id", score.alias("score"), F.col("x").alias("evidence"), F.col("u").alias("word_evidence"))
    return out.select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "word_evidence")

"""Quality rules with robust multivariate outliers; DataFrame functions only.

Base rules reject texts of under MIN_WORDS words, or whose repeated three-word windows hold over half of
their words. The others are judged by a minimum-covariance-determinant estimate of location and scatter of
transformed statistics in their group of language and source. It is found by concentration steps from two
starts, medians with FLOORS as scatter and medians with median deviations: a step keeps the HALF of a group with
the smallest distances and estimates anew, and steps go on until no group's determinant falls by over
TOLERANCE (STEPS at most). The smallest determinant of a group, over both starts and all steps, holds; one
step of reweighting follows, over the rows within the INNER quantile. Scatters of parts are scaled to be
consistent for normal data. Just under half of a group may be junk before that moves the estimate.

Each group's location and scatter are drawn to its language's with the weight of PRIOR rows, and a language's
to all rows', so a small group needs no rule of its own. Variances have FLOORS, as most texts have no symbols
or repeats at all and an exact half would have no scatter: each is about what one event makes of a
statistic (words 8 % longer; one symbol in 100 words; one line of 25 repeated; six words of 400
repeated). A squared Mahalanobis distance beyond CUTOFF, the quantile that one ordinary text in a
million exceeds, rejects.

Null text has no words and fails the base rules; null lang or source are values of their own; a text of any
length is measured whole; repeated rows are judged alike, rows that share an id each by their own values; an empty
table gives an empty result. Only doc_id, text, lang and source are read.
Group statistics are sums and approximate quantiles with partial aggregation: a hot group is no task.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evencut.llm.common import WORD, free_name, materialize


def chi_square(x: float, k: int) -> float:
    """The share of a chi-square of k degrees, k even, at or below x."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < share else (lo, mid)
    return hi


def consistent(share: float, k: int) -> float:
    """The scatter of k normal values over that of the given share of smallest distance."""
    return share / chi_square(quantile(share, k), k + 2)


MIN_WORDS, HALF, STEPS, TOLERANCE, PRIOR = 50, 0.5, 12, 1e-3, 50
NAMES = ("word_len", "symbols", "dup_lines", "repeats")
FLOORS = (0.08, 0.10, 0.20, 0.12)
INNER, CUTOFF = quantile(0.975, len(NAMES)), quantile(1 - 1e-6, len(NAMES))
SYMBOLS = "#*$%&|<>"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more. Windows are compared by 64-bit hash: sorted hashes show which repeat, sorted positions how many words those cover."""
    n = F.size(words)
    windows = F.transform(F.slice(words, 1, n - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h):
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(p):
            same = lambda k, d: F.get(p, k + d)["h"] == F.get(p, k)["h"]
            twice = F.filter(F.transform(p, lambda x, k: F.when(F.coalesce(same(k, -1), F.lit(False)) | F.coalesce(same(k, 1), F.lit(False)), x["i"])), lambda x: x.isNotNull())
            return _let(F.array_sort(twice), lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(q, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

        return _let(pairs, count)

    return F.when(n < 4, F.lit(0)).otherwise(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words, all long."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\r\v\f", "")) > 0)
    out = _let(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        out["n_words"].alias("n_words"), F.length(F.translate(t, " \t\n\v\f\r", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        dup["n_lines"].alias("n_lines"), dup["n_dup_lines"].alias("n_dup_lines"), out["n_repeat_words"].alias("n_repeat_words"),
    )


def base_failed(s) -> Column:
    return (s("n_words") < MIN_WORDS) | (100 * s("n_repeat_words") > 50 * s("n_words"))


def vector(s) -> list[Column]:
    """The transformed statistics, in the order of NAMES."""
    n, lines = F.greatest(s("n_words"), F.lit(1)), F.greatest(s("n_lines"), F.lit(1))
    return [F.log(F.greatest(s("word_chars"), F.lit(1)) / n), F.log1p(10.0 * s("n_symbols") / n), F.asin(F.sqrt(F.least(F.lit(1.0), s("n_dup_lines") / lines))), F.asin(F.sqrt(F.least(F.lit(1.0), s("n_repeat_words") / n)))]


def _cholesky(m) -> list[list[Column]]:
    """Lower factor of the covariance columns m(i, j), as column expressions."""
    p, low = len(NAMES), []
    for i in range(p):
        low.append([])
        for j in range(i + 1):
            rest = m(i, j) - reduce(lambda a, k: a + low[i][k] * low[j][k], range(j), F.lit(0.0))
            low[i].append(F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j][j])
    return low


P = range(len(NAMES))
LOWER = [(i, j) for i in P for j in range(i + 1)]
KEYS = ["level", "lang", "source", "start"]
MOMENTS = [*[f"m{i}" for i in P], *[f"c{i}{j}" for i, j in LOWER]]
FACTORS = [*[f"m{i}" for i in P], *[f"l{i}{j}" for i, j in LOWER]]


def _distance() -> Column:
    """The squared Mahalanobis distance from x0.. with mean m0.. and factor l00.., by forward substitution."""
    z: list[Column] = []
    for i in P:
        rest = F.col(f"x{i}") - F.col(f"m{i}") - reduce(lambda a, k: a + F.col(f"l{i}{k}") * z[k], range(i), F.lit(0.0))
        z.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, v: a + v * v, z, F.lit(0.0))


def _factors(moments: DataFrame) -> DataFrame:
    """Means, Cholesky factors of the covariances with their floors, and the logarithm of the determinant."""
    low = _cholesky(lambda i, j: F.col(f"c{i}{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0))
    others = [c for c in moments.columns if c not in MOMENTS]
    out = moments.select(*others, *[f"m{i}" for i in P], *[low[i][j].alias(f"l{i}{j}") for i, j in LOWER])
    return out.withColumn("det", reduce(lambda a, i: a + 2 * F.log(f"l{i}{i}"), P, F.lit(0.0)))


def _averages(scale: float) -> list[Column]:
    """n, means and covariances, the latter scaled, of the rows of a group."""
    x = lambda i: F.col(f"x{i}")
    return [F.count("*").alias("n"), *[F.avg(x(i)).alias(f"m{i}") for i in P], *[(F.lit(scale) * (F.avg(x(i) * x(j)) - F.avg(x(i)) * F.avg(x(j)))).alias(f"c{i}{j}") for i, j in LOWER]]


def _with(rows: DataFrame, found: DataFrame) -> DataFrame:
    keys = [k for k in KEYS if k in found.columns and k in rows.columns]
    same = reduce(lambda x, y: x & y, [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys])
    return rows.alias("r").join(found.alias("e"), same).select("r.*", *[f"e.{c}" for c in found.columns if c not in keys])


def _starts(rows: DataFrame) -> DataFrame:
    """Both starts of each group."""
    keys = KEYS[:3]
    middle = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(1000))
    mid = materialize(rows.groupBy(*keys).agg(*[middle(f"x{i}").alias(f"m{i}") for i in P]), "medians")
    away = _with(rows, mid).groupBy(*keys).agg(*[middle(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in P])
    both = _with(mid, away).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    spread = lambda i: F.when(F.col("start") == 1, F.pow(1.4826 * F.col(f"d{i}"), 2)).otherwise(0.0)
    return both.select(*KEYS, *[f"m{i}" for i in P], *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in LOWER])


def estimates(stats: DataFrame) -> DataFrame:
    """(lang, source) with robust means and Cholesky factors of the groups that have rows which pass the base rules; a small table by group."""
    none = F.lit(None).cast("string")
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")), F.struct(F.lit(0).alias("level"), none.alias("lang"), none.alias("source")),
    )
    rows = stats.filter(~base_failed(F.col)).select(F.explode(levels).alias("g"), *[x.alias(f"x{i}") for i, x in enumerate(vector(F.col))]).select("g.*", *[f"x{i}" for i in P])
    found = materialize(_factors(_starts(rows)), "mcd")
    best = None
    for _ in range(STEPS):
        near = _with(rows, found).withColumn("d", _distance()).select(*KEYS, "d", *[f"x{i}" for i in P])
        cut = near.groupBy(*KEYS).agg(F.percentile_approx("d", F.lit(HALF), F.lit(1000)).alias("cut"))
        half = _with(near, cut).filter("d <= cut").groupBy(*KEYS).agg(*_averages(consistent(HALF, len(NAMES)))).drop("n")
        found = materialize(_factors(half), "mcd")
        if best is None:
            best = found
            continue
        # of each group and start, what has the smaller determinant
        both = best.unionByName(found).groupBy(*KEYS).agg(F.min_by(F.struct(*FACTORS, "det"), "det").alias("e"), F.max("det").alias("worst"))
        new = materialize(both.select(*KEYS, "e.*", "worst"), "mcd")
        fell = _with(found, best.select(*KEYS, F.col("det").alias("old"))).agg(F.max(F.col("old") - F.col("det"))).first()[0]
        best = new.drop("worst")
        if fell is None or fell <= TOLERANCE:
            break
    best = best.groupBy(*KEYS[:3]).agg(F.min_by(F.struct(*FACTORS), F.struct("det", "start")).alias("e")).select(*KEYS[:3], "e.*")
    inner = _with(rows, best).withColumn("d", _distance()).filter(F.col("d") <= INNER)
    moments = materialize(inner.groupBy(*KEYS[:3]).agg(*_averages(consistent(0.975, len(NAMES)))), "moments")
    return _factors(_drawn(moments)).drop("det")


def _drawn(moments: DataFrame) -> DataFrame:
    """(lang, source) with moments drawn to the language's, and those to all rows', by numbers of rows."""
    level = lambda k: moments.filter(F.col("level") == k)
    tagged = lambda df, t: df.select(*[F.col(c).alias(f"{t}{c}") for c in ("lang", *MOMENTS)])
    weight = F.col("n") / (F.col("n") + PRIOR)
    mixed = lambda t: [(weight * F.col(c) + (1 - weight) * F.col(f"{t}{c}")).alias(c) for c in MOMENTS]
    whole = F.broadcast(tagged(level(0), "a_"))  # one row
    langs = level(1).join(whole, F.lit(True)).select("lang", *mixed("a_"))
    up = tagged(langs, "b_")
    return level(2).join(up, F.col("lang").eqNullSafe(F.col("b_lang"))).select("lang", "source", *mixed("b_"))


def _measured(docs: DataFrame, lang: str, source: str, text: str) -> list[Column]:
    return [F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), statistics(F.col(text)).alias("s")]


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """docs' doc_id, lang, source with statistics, base_failed, distance (null if base_failed) and kept."""
    stats = materialize(docs.select("doc_id", *_measured(docs, "lang", "source", "text")).select("doc_id", "lang", "source", "s.*"), "stats")
    return judged(stats, cutoff)


def judged(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The columns of stats (lang, source, statistics and any others) with base_failed, distance and kept; each row has its own verdict."""
    found = estimates(stats).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.struct(*FACTORS).alias("e"))
    rows = stats.select("*", base_failed(F.col).alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(vector(F.col))])
    rows = rows.join(found, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    rows = rows.select(*[f"`{c}`" for c in stats.columns], "base_failed", *[f"x{i}" for i in P], "e.*")
    rows = rows.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return rows.withColumn("kept", kept).select(*[f"`{c}`" for c in stats.columns], "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""
    row = free_name(["lang", "source", "s"], "row")
    whole = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *_measured(docs, "lang", "source", "text")).select(row, "lang", "source", "s.*"), "measured")
    return judged(whole).filter("kept").select(f"{row}.*")

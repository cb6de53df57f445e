"""Small fixtures with nulls, empty and repeated rows, clashing columns and empty tables, against brute force."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from evencut.llm import decontamination, html_text, language, mixing, quality_classifier, quality_rules, sharding, simhash, suffix_dedup, toxicity
from evencut.llm.common import buffer, held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, found string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows():
    rng = random.Random(7)
    out = [(i, prose(rng, rng.choice([1, 30, 80, 200])), rng.choice(["en", "fr"]), rng.choice(["s0", "s0", "s1", None]), 0, "x", "y") for i in range(60)]
    out += [(100, None, None, None, None, None, None), (101, "", "en", "s1", 0, "", ""), (102, " \n\t ", "en", "s2", 0, "", ""), (103, out[3][1], "en", "s1", 0, "", ""), (104, out[3][1] + " one1", "en", "s1", 0, "", "")]
    return out + [out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def bench(spark):
    t = [r[1] for r in rows()]
    return spark.createDataFrame([(1, " ".join(t[2].split()[:14])), (2, "ALPHA1, beta2"), (3, None), (4, "--"), (5, " ".join(t[3].split()[5:17]))], "item_id long, text string")


def test_decontamination(docs, bench, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    told = collections.defaultdict(set)
    for r in bench.collect():
        w = word.findall((r.text or "").lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            told[tuple(w[k : k + 10])].add(str(r.item_id))
    for block in (1 << 25, 40):
        found, name = decontamination.find(docs, bench, block=block)
        assert name == "_found"
        for r in found.collect():
            w, hit, items = word.findall((r.text or "").lower()), set(), set()
            for n in {len(k) for k in told}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in told:
                        hit |= set(range(k, k + n))
                        items |= told[tuple(w[k : k + n])]
            assert (r[name].n_words, sum(x.end - x.start for x in r[name].words), r[name]["items"]) == (len(w), len(hit), sorted(items))
    clean = decontamination.cleaned_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    again, name = decontamination.find(clean.filter("doc_id in (2, 3)"), bench.filter("item_id <> 2"))
    assert all(not r[name]["items"] for r in again.collect())
    assert decontamination.find(empty, bench)[0].count() == 0 and decontamination.find(docs, bench.limit(0))[0].count() == docs.count()


def test_fm_index_against_plain_search():
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 7, 40, 300, 5000)]
    col = pa.array([*texts, None, texts[3]], pa.large_string())
    ((_, data, off),) = decontamination.chunks(col, 1 << 20)
    starts, _, h = decontamination.words_of(data, off)
    edge = np.searchsorted(decontamination.owner(off, starts), np.arange(len(off)))
    index = decontamination.FMIndex(h, edge)
    assert len(index.sample) < len(h) / 4  # positions are kept sparsely
    words = [w for t in [*texts, "", texts[3]] for w in [*t.split(), None]]  # None is an end mark
    queries = [q.split() for q in ("a", "a b", "c c c a", "b a b a c", "d", "a d")]
    _, _, qh = decontamination.words_of(*buffer(pa.array([" ".join(w for q in queries for w in q)])))
    length = np.array([len(q) for q in queries])
    lo, hi = index.search(qh, np.cumsum(length) - length, length)
    for q, a, b in zip(queries, lo.tolist(), hi.tolist(), strict=True):
        want = [k for k in range(len(words)) if words[k : k + len(q)] == q]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_of_a_very_long_text(spark):
    rng = random.Random(14)
    w = [f"w{rng.randrange(10**5)}" for _ in range(200_000)]
    d = spark.createDataFrame([(1, " ".join(w)), (2, "short")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(w[199_000:199_020])), (2, " ".join(w[-3:]))], "item_id int, text string")
    found, name = decontamination.find(d, b)
    r = found.filter("doc_id = 1").first()[name]
    assert [tuple(x) for x in r.words] == [(199_000, 199_020), (199_997, 200_000)] and r["items"] == ["1", "2"]


def test_simhash(docs, empty):
    prints = []
    for r in rows():
        w = (r[1] or "").lower().split()
        s = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        n = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in s) for b in range(64)]
        prints.append((r[0], sum(1 << b for b in range(64) if 2 * n[b] > len(s))))
    root = {i: i for i, _ in prints}
    for _ in prints:
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.groups(docs).collect()}
    assert got == {(i, f, root[i]) for i, f in prints}
    kept = simhash.first_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert simhash.groups(empty).count() == 0


def test_first_documents_with_null_and_shared_ids(spark):
    rng = random.Random(3)
    a, b, c, e = (prose(rng, 80) for _ in range(4))
    data = [(None, a, 1), (None, b, 2), (None, b, 3), (4, c, 4), (4, e, 5), (9, c, 6), (None, c, 7)]
    d = spark.createDataFrame(data, "doc_id long, text string, first_text int")
    kept = simhash.first_documents(d)
    assert kept.columns == d.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (4, c), (4, e)], key=repr)


def test_names_of_own_columns_may_be_taken(spark, docs, tmp_path):
    own = ("times", "h", "_mix_key", "mix_key", "MIX_COPY", "first_doc", "_first", "rules_key", "rules_stats", "n_words", "__path", "path", "rows", "fp")
    wide = docs.selectExpr("*", *[f"{i} AS `{n}`" for i, n in enumerate(own)])
    assert mixing.mixed_documents(wide).columns == wide.columns
    assert sorted(r.doc_id or 0 for r in mixing.mixed_documents(wide).collect()) == sorted(r.doc_id or 0 for r in mixing.mixed_documents(docs).collect())
    assert simhash.first_documents(wide).columns == quality_rules.kept_documents(wide).columns == wide.columns
    assert simhash.first_documents(wide).count() == simhash.first_documents(docs).count()
    assert quality_rules.kept_documents(wide).count() == quality_rules.kept_documents(docs).count()
    assert sharding.store_and_locate(spark, wide, str(tmp_path / "w")).count() == wide.count()


def test_key_masks_miss_no_pair():
    rng = random.Random(1)
    for blocks in (5, 6, 8):
        masks = simhash.key_masks(4, blocks)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_blocks_follow_the_count():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 16_777_216, 16_777_217, 10**10, 10**12)] == [6, 6, 6, 7, 8, 10]


def test_fingerprint_of_a_very_long_text():
    w = [f"w{i % 9973}" for i in range(60_000)]
    n = [0] * 64
    for k in range(len(w) - 3):
        h = xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    want = sum(1 << b for b in range(64) if 2 * n[b] > len(w) - 3)
    assert simhash.fingerprint_batch([" ".join(w), None])[0] == want


def test_links_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(9)]]))
    a, b = simhash._link(fp, np.zeros(len(fp), np.int64), np.full(len(fp), 2), 4, simhash.pivots())
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    assert near[a, b].all()
    root = np.arange(len(fp))
    for _ in range(len(fp)):
        root = np.where(near, root[None, :], len(fp)).min(axis=1)
    got = np.arange(len(fp))
    for _ in range(len(fp)):
        got[a] = got[b] = np.minimum(got[a], got[b])
        for x, y in zip(a, b, strict=True):
            got[x] = got[y] = min(got[x], got[y])
    assert (got == root).all()


def test_links_connect_a_hot_key():
    rng = np.random.default_rng(2)
    fp = np.unique(np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))  # each two differ in two bits
    a, b = simhash._link(fp, np.zeros(len(fp), np.int64), np.full(len(fp), 2), 4, simhash.pivots())
    assert len(a) == len(fp) - 1 == len({*a.tolist(), *b.tolist()}) - 1


def test_suffix_dedup(spark, empty):
    rng = random.Random(4)
    base = [prose(rng, 60) for _ in range(4)]
    texts = [base[0], base[1] + base[0][50:250], "ab" * 200, base[0], None, "", base[2] + "é" + base[1][:150], "x" * 99, "x" * 100, "x" * 101]
    texts += [f"{prose(rng, 5)} {base[3][:180]} {prose(rng, 5)}" for _ in range(40)]  # a passage that most texts share
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                mark[s : s + 100] = b"\x01" * 100
            seen.add(b[s : s + 100])
        want[i] = (len(b), sum(mark), hashlib.sha256(bytes(c for c, m in zip(b, mark, strict=True) if not m)).hexdigest())
    # repeats found after the exchange, and by the task that reads them; surroundings settled together, and string by string
    for rows_, crowd in ((d, suffix_dedup.HOT), (d.coalesce(1), suffix_dedup.HOT), (d, 1)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.removed(rows_, crowd=crowd).collect()}
        assert got == want
    assert suffix_dedup.removed(empty).count() == 0


def test_doubling_against_plain_search():
    rng = random.Random(15)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    regions, flat = [], b""
    for k in range(40):  # pieces of one text and some noise, in two classes of prefixes
        n, at = rng.randrange(1, 40), rng.randrange(150)
        data = base[at : at + n + 99] if k % 4 else bytes(rng.choice(b"ab") for _ in range(n + 99))
        regions.append((k % 2, k // 3, 0, 1000 * (k % 3), n, 60 - at % 8, data))
        flat += data
    of = {c: np.array([r[i] for r in regions], kind) for i, (c, kind) in enumerate(suffix_dedup.Regions.KINDS.items())}
    got = sorted(zip(*(x.tolist() for x in suffix_dedup.Regions(of, np.frombuffer(flat, np.uint8)).repeats()), strict=True))
    places = collections.defaultdict(list)
    for rank, doc, hash_, start, n, inner, data in regions:
        for j in range(n):
            places[rank, inner - j, data[j : j + 100]].append((doc, hash_, start + j))
    want = sorted((d, h, p, p + 100) for v in places.values() for d, h, p in v if (d, h, p) != min(v))
    assert got == want and want


def test_suffix_dedup_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(16)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    d = spark.createDataFrame([(1, long), (2, "x" + long[200_000:200_300]), (2, "x" + long[200_000:200_300]), (None, long[:150])], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(d).collect()))
    assert got == [(0, 150, 0, 0), (1, 400_000, 150, 1), (2, 301, 300, 1), (2, 301, 300, 1)]
    ids = spark.createDataFrame([("7", "t" * 250), ("8", "t" * 250)], "doc_id string, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.removed(ids).collect()) == [("7", 249), ("8", 250)]


def test_mixing(docs, empty):
    m = mixing.Mix(docs, block=64)
    got = m.rows().collect()
    assert len(got) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len((r[1] or "").split())
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    goal = {r.source: r.target for r in got}
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs, block=64).collect()), key=repr)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns


@pytest.mark.parametrize("silent", [["z"], [None], ["a", "b", "z", None], ["a"]])
def test_mix_of_sources_without_words(spark, silent):
    rng = random.Random(1)
    data = [(i, None if s in silent and i % 2 else " " if s in silent else prose(rng, 40), s) for i, s in enumerate(["a", "b", "z", None] * 6)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(d, block=16).collect()
    assert len(got) == len(data) and all(r.taken <= 3 * r["size"] for r in got)
    for s in {r[2] for r in data}:
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert s not in silent or mine[0].target == 0
    assert mixing.mixed_documents(d).filter("text is null or trim(text) = ''").count() == 0


def test_mix_of_very_long_and_repeated_texts(spark):
    data = [(1, "word " * 60_000, "a"), (2, "tiny", "b"), (2, "tiny", "b"), (3, "one two", "b"), (4, "", "b")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = sorted((r.doc_id, r["size"], r.taken) for r in mixing.mix(d, block=64).collect())
    assert got == [(1, 60_000, 59_992), (2, 1, 3), (2, 1, 3), (3, 2, 6), (4, 0, 0)]


def test_queries_match_sql(spark):
    from evencut.llm.queries import ORACLE, QUERIES
    from tests.compare import same

    for name, sql in ORACLE.items():
        same(spark, name, QUERIES[name], sql)


def test_targets():
    assert mixing.targets([10, 1000], [5, 2]) == [30.0, 980.0]
    assert mixing.targets([0, 7], [5, 2]) == [0.0, 7.0]


def test_schedule_spreads_sources(docs):
    s = mixing.Mix(docs, block=16).schedule().toPandas()
    assert s.groupby("si")["rank"].apply(lambda x: sorted(x) == list(range(len(x)))).all()


def test_sharding(spark, docs, empty, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    for part in range(3):
        store.append(docs.filter(f"doc_id % 3 = {part}").repartition(3))
    before = store.manifest().count()
    assert store.versions() == [1, 2, 3] and before >= 4
    version = store.compact(docs.schema)
    assert version == 4 and store.manifest().count() < before
    assert sorted(map(repr, store.read(docs.schema).collect())) == sorted(map(repr, docs.collect()))
    assert store.read(docs.schema, 3).count() == docs.count()
    with pytest.raises(sharding.VersionTaken):
        store._commit(store.manifest(), 4)
    store.vacuum()
    assert store.versions() == [4] and store.located(docs.schema).count() == docs.count()
    assert sharding.store_and_locate(spark, empty, str(tmp_path / "e")).count() == 0
    assert not store._claims() and sharding.store_and_locate(spark, docs, str(tmp_path / "f")).count() == docs.count()


def test_tiers_merge_as_a_plain_version_does(spark, tmp_path):
    """Arrivals of growing size: after each, the shards of every tier with enough of them become files of about the target."""
    target = 16 << 10
    monkey = sharding.BASE
    sharding.BASE = 1 << 10
    try:
        store = sharding.ShardStore(spark, str(tmp_path / "t"))
        rng = random.Random(3)
        rows_, schema = [], "doc_id long, text string"
        for n in (4, 4, 40, 4, 160, 4):
            new = [(len(rows_) + i, "".join(rng.choice("abcdefghij") for _ in range(600))) for i in range(n)]
            rows_ += new
            store.append(spark.createDataFrame(new, schema).repartition(3))
            sizes = collections.defaultdict(list)
            for r in store.manifest().collect():
                if r.bytes < target // 2:
                    sizes[int(np.floor(np.log(max(1.0, r.bytes / 1024)) / np.log(4.0)))].append(r)
            due = [x for x in sizes.values() if len(x) >= sharding.MIN_RUNS]
            left = {r.path for r in store.manifest().collect()} - {r.path for x in due for r in x}
            store.compact(spark.createDataFrame([], schema).schema, target)
            now = store.manifest().collect()
            assert left <= {r.path for r in now}
            assert len(now) - len(left) <= sum(max(1, round(sum(r.bytes for r in x) / target)) for x in due)
            assert sum(r.rows for r in now) == len(rows_)
        assert sorted(map(tuple, store.read(spark.createDataFrame([], schema).schema).collect())) == sorted(rows_)
    finally:
        sharding.BASE = monkey


def test_vacuum_and_other_writers_between_write_and_commit(spark, docs, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "v")) for _ in range(2))
    store.append(docs.limit(0))
    write = store._write

    def interrupted(df, folder, born):
        new = write(df, folder, born)
        other.append(docs.filter("doc_id < 3"))  # takes the version that this writer had in mind
        other.vacuum()
        return new

    monkeypatch.setattr(store, "_write", interrupted)
    store.append(docs)
    assert store.read(docs.schema).count() == docs.count() + docs.filter("doc_id < 3").count()
    monkeypatch.setattr(store, "_write", write)
    left = store._claim("arrival")
    write(docs, left, 9)
    store.vacuum()
    assert store._fs.exists(store._at(f"{store.root}/data/{left}"))
    store._let_go(left)
    store.vacuum()
    assert not store._fs.exists(store._at(f"{store.root}/data/{left}"))


def test_two_compactions_at_once(spark, docs, tmp_path, monkeypatch):
    store, other = (sharding.ShardStore(spark, str(tmp_path / "c")) for _ in range(2))
    for k in range(4):
        store.append(docs.filter(f"doc_id % 4 = {k}").coalesce(1))
    write = store._write

    def interrupted(df, folder, born):
        other.compact(docs.schema)
        return write(df, folder, born)

    monkeypatch.setattr(store, "_write", interrupted)
    with pytest.raises(sharding.VersionTaken):
        store.compact(docs.schema)
    assert store.read(docs.schema).count() == docs.filter("doc_id is not null").count()


def test_quality_rules(docs, empty):
    got = {}
    for r in quality_rules.judge(docs).collect():
        got.setdefault(r.doc_id, r)
    for i, text, *_ in rows():
        t, r = text or "", got[i]
        w = t.split()
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.kept_documents(docs).columns == docs.columns


def test_repeat_words_and_lines(spark):
    t = "a b c x a b c\nq\n \nq\n#1 $"
    d = spark.createDataFrame([(1, t, "l", "s")], "doc_id long, text string, lang string, source string")
    r = quality_rules.judge(d).first()
    assert (r.n_words, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (11, 2, 1, 6)


def test_quality_rules_with_much_junk_in_a_group(spark):
    rng = random.Random(5)
    data = []
    for source, share in (("none", 0), ("third", 30), ("more", 40)):
        for i in range(300):
            junk = i % 100 < share
            data.append((len(data), "en", source, 200, rng.randrange(900, 1100), rng.randrange(150, 170) if junk else rng.choice([0, 0, 0, 1]), 9, 0, rng.randrange(3), junk))
    columns = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, junk boolean"
    got = quality_rules.judged(spark.createDataFrame(data, columns)).collect()
    assert len(got) == len(data) and all(r.kept != r.junk for r in got)


def test_twins_have_their_own_verdicts(spark):
    """Rows of one id and text in two languages: one is ordinary there, the other an outlier."""
    rng = random.Random(6)
    marked = lambda n: " ".join(f"word{rng.randrange(900)}" + ("#" if k < n else "") for k in range(80))
    data = [(i, marked(0), "a", "s") for i in range(200)] + [(1000 + i, marked(rng.randrange(60, 70)), "b", "s") for i in range(200)]
    twin = marked(65)
    data += [(7, twin, "a", "s"), (7, twin, "b", "s"), (None, twin, "a", "s"), (None, twin, "b", "s")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    kept = [(r.doc_id, r.lang) for r in quality_rules.kept_documents(d).filter(F.col("text") == twin).collect()]
    assert sorted(kept, key=repr) == [(7, "b"), (None, "b")]


def test_quality_rules_of_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000)) + "\n" + "same line of words here\n" * 3
    r = quality_rules.judge(spark.createDataFrame([(1, long, None, None)], "doc_id long, text string, lang string, source string")).first()
    assert (r.n_words, r.n_dup_lines) == (120_015, 2) and r.word_chars == len("".join(long.split())) and r.kept


def _labels(spark, docs, column, rule):
    return spark.createDataFrame([(r.doc_id, rule(r)) for r in docs.collect()] + [(None, 1), (7, None)], f"doc_id long, {column} int")


def test_toxicity_and_quality_learn(spark, empty):
    rng = random.Random(9)
    data = [(i, prose(rng, 80) + (" nasty vile nasty" if i % 3 == 0 else "") + (" ### $$$" * 20 if i % 4 == 0 else "")) for i in range(300)] + [(1000, None), (1001, "")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    toxic = _labels(spark, d, "toxic", lambda r: int("nasty" in (r.text or "")))
    got = toxicity.scores(d, toxic).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.9
    good = _labels(spark, d, "quality", lambda r: int("#" not in (r.text or "")))
    got = quality_classifier.scores(d, good).collect()
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.9
    for scores, labels in ((toxicity.scores, toxic), (quality_classifier.scores, good)):
        assert scores(d, labels.limit(0)).count() == len(data) and scores(empty, labels).count() == 0


def _plain_kneser_ney(texts, classes, d):
    """log p_1(w | h) / p_0(w | h) as a function, and both models' p(w | h), from counters and the formulas alone."""
    big = [collections.Counter(), collections.Counter()]
    for t, y in zip(texts, classes, strict=True):
        big[y].update(zip(["", *t], t, strict=False))
    total = [sum(x.values()) for x in big]
    large = [toxicity.BIGRAM * d * n / min(total) for n in total]
    m = [collections.Counter(), collections.Counter()]
    for c in (0, 1):
        for (_, w), n in big[c].items():
            m[c][w] += min(n, large[c])
    mass = [sum(x.values()) for x in m]
    small = [d * x / min(mass) for x in mass]
    back = [sum(min(n, small[c]) for n in m[c].values()) for c in (0, 1)]
    vocabulary = sorted({*m[0], *m[1]})

    def p(c, h, w):
        s = (min(m[0][w], small[0]) + min(m[1][w], small[1]) + 0.5) / (sum(back) + 0.5 * (len(vocabulary) + 1))
        u = (max(m[c][w] - small[c], 0) + back[c] * s) / mass[c]
        after = {x: n for (g, x), n in big[c].items() if g == h}
        if not after:
            return u
        return (max(after.get(w, 0) - large[c], 0) + sum(min(n, large[c]) for n in after.values()) * u) / sum(after.values())

    return p, vocabulary, total


def _insulting(rng, n):
    """Texts of shared words, a third of them with one of two insults and a fixed word behind it."""
    out = []
    for i in range(n):
        words = [f"{rng.choice(WORDS)}{rng.randrange(12)}" for _ in range(30)]
        for _ in range(3 if i % 3 == 0 else 0):
            k = rng.randrange(len(words) - 1)
            words[k : k + 2] = [rng.choice(["nasty", "vile"]), "fool"]
        out.append((i, " ".join(words), int(i % 3 == 0)))
    return out


def test_toxicity_is_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BIGRAM", 2)  # so that the small table has bigrams above their discount
    data = _insulting(random.Random(11), 240)
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    docs, labels = d.select("doc_id", "text"), d.select("doc_id", "toxic")
    fold = F.expr("pmod(xxhash64('calibrate', doc_id), 5L) = 0")
    used = {r.doc_id for r in d.filter(~fold & ~held_out("doc_id", 5, 0)).collect()}
    fitted = toxicity.Fitted(docs, labels, discounts=(1, 3))
    p, vocabulary, total = _plain_kneser_ney([t.split() for i, t, _ in data if i in used], [y for i, _, y in data if i in used], fitted.d)
    for c in (0, 1):
        for h in ("", vocabulary[0], "nasty", "neverseen"):
            assert np.isclose(sum(p(c, h, w) for w in [*vocabulary, "neverseen"]), 1)
    assert any(r.level == 2 for r in fitted.counts.telling(fitted.d).collect())
    share = total[1] / sum(total)
    some = {r.doc_id: r for r in toxicity.scores(docs, labels, discounts=(1, 3)).collect()}
    joined = {r.doc_id: r for r in toxicity.scores(docs, labels, discounts=(1, 3), table=0).collect()}  # tables too large for a task
    for i, t, y in data[:60]:
        w = t.split()
        r = []
        for h, x in zip(["", *w], w, strict=False):
            e = p(1, h, x) / p(0, h, x)
            common = (1 - toxicity.OWN) * (1 - share + share * e)
            r.append(np.log((toxicity.OWN * e + common) / (toxicity.OWN + common)))
        want = sum(x - sorted(r)[(len(r) - 1) // 2] for x in r) / (len(w) + toxicity.PRIOR_WORDS)
        assert np.isclose(some[i].evidence, want, atol=1e-9) and np.isclose(joined[i].evidence, want, atol=1e-9)
        assert some[i].predicted == joined[i].predicted == y


def test_toxicity_learns_from_bigrams(spark):
    rng, data = random.Random(13), []
    for i in range(300):  # the same words in both classes, two of them in another order
        words = [f"{rng.choice(WORDS)}{rng.randrange(12)}" for _ in range(30)]
        for k in (5, 12, 20):
            words[k : k + 2] = ["red", "fox"] if i % 3 == 0 else ["fox", "red"]
        data.append((i, " ".join(words), int(i % 3 == 0)))
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    got = toxicity.scores(d.select("doc_id", "text"), d.select("doc_id", "toxic")).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.9
    fitted = toxicity.Fitted(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert fitted.counts.large.count() > 0.02 * fitted.counts.bigrams.count()


def test_toxicity_weighs_words_too(spark):
    x = np.random.default_rng(4).normal(size=(400, 2))
    y = (x[:, 1] + 0.3 * x[:, 0] > 0.4).astype(float)  # separable: steps stay damped
    slopes, offset = toxicity.logistic(x, y)
    assert np.mean((x @ slopes + offset >= 0) == (y > 0)) > 0.99 and slopes[1] > 2 * slopes[0] > 0
    data = _insulting(random.Random(14), 120)
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    some, joined = ({r.doc_id: r for r in toxicity.scores(d.select("doc_id", "text"), d.select("doc_id", "toxic"), discounts=(1,), **more).collect()} for more in ({}, {"table": 0}))
    assert all(np.isclose(some[i].word_evidence, joined[i].word_evidence) and np.isclose(some[i].score, joined[i].score) for i in some)
    assert any(not np.isclose(r.evidence, r.word_evidence) for r in some.values())


def test_toxicity_of_repeated_and_long_rows(spark):
    data = _insulting(random.Random(12), 150)
    long = (5000, " ".join(t for _, t, _ in data) * 40 + " nasty" * 30_000, 1)
    rows_ = [*data, *data[:20], long, (5001, None, None), (5002, "", 0), (5003, "?!", None)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    got = toxicity.scores(d.select("doc_id", "text"), d.select("doc_id", "toxic").union(d.select("doc_id", F.lit(0)).limit(30))).collect()
    assert len(got) == len(rows_) and {r.doc_id: r for r in got}[5000].predicted == 1
    assert len({(r.doc_id, r.score) for r in got}) == len({r[0] for r in rows_})
    assert len({r.score for r in got if r.doc_id in (5001, 5002, 5003)}) == 1


def _vocabulary(tmp_path):
    import base64

    path = tmp_path / "pieces"
    path.write_bytes(b"".join(base64.b64encode(p) + b" 1\n" for p in (b" th", b"the", b" le", b"en", b"er")))
    return str(path)


def test_language(spark, empty, tmp_path):
    path = _vocabulary(tmp_path)
    data = [(i, "the then they other the" if i % 2 else "le les elle la le", "en" if i % 2 else "fr") for i in range(60)] + [(200, "123 --", "en"), (201, None, None), (202, "", "fr"), (203, "THE", None)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame(data, "doc_id long, text string, lang string"), path).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(60)) and got[203].lang_pred == "en"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (200, 201, 202))
    assert language.predict(empty, path).count() == 0


def test_pieces_of_any_length_count(tmp_path):
    import base64

    path = tmp_path / "long"
    path.write_bytes(b"".join(base64.b64encode(x) + b" 1\n" for x in (b" internationalisation", b"nationalisations", b"nationalisation", b"ab")))
    p = language.Pieces(str(path))
    flat, size, *_ = language.words(pa.array(["internationalisation nationalisations"]))
    lattice = language.Lattice(p, flat, size)
    found = {p.pieces[x - 1] for x in lattice.piece.tolist()}
    assert {b" internationalisation", b"nationalisation", b"nationalisations"} <= found and b"ab" not in found


def test_rare_languages_are_learned(spark, tmp_path):
    path = _vocabulary(tmp_path)
    texts = {"en": "the then they other the", "fr": "le les elle la le", "xx": "zq qz zzq qqz", "yy": "wv vw wwv vvw"}
    langs = ["en"] * 3000 + ["fr"] * 900 + ["xx"] * 8 + ["yy"] * 300
    data = [(i if x != "yy" else 7001, texts[x], x) for i, x in enumerate(langs)]  # all rows of yy share an id
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    assert d.filter(~held_out("doc_id", 4, 2) & (F.col("doc_id") == 7001)).count() == 300
    assert language.fit(d, path, 40).langs == ["en", "fr", "xx", "yy"]
    got = language.predict(d, path, 40).select("doc_id", "lang_pred").distinct().collect()
    assert all(r.lang_pred == ("yy" if r.doc_id == 7001 else langs[r.doc_id]) for r in got)
    assert language.shared_bound([5000, 10, 6000], 8000) == 3995 and language.shared_bound([5, 7], 8000) >= 7


def test_forward_sums_all_segmentations(tmp_path):
    p = language.Pieces(_vocabulary(tmp_path))
    prob = np.zeros((len(p.pieces) + 1, 1))
    prob[1:, 0] = np.random.default_rng(0).random(len(p.pieces))
    m = language.Model(p, ["x"], prob)
    of = {b: prob[i + 1, 0] for i, b in enumerate(p.pieces)}

    def total(w):
        return 1.0 if not w else sum(of[w[:k]] * total(w[k:]) for k in range(1, len(w) + 1) if w[:k] in of)

    def log_total(w):  # in logarithms, by place
        best = [0.0]
        for j in range(1, len(w) + 1):
            best.append(np.logaddexp.reduce([best[j - k] + np.log(of[w[j - k : j]]) for k in range(1, j + 1) if w[j - k : j] in of]))
        return best[-1]

    long = ["запротоколировавшиеся", "因为他们没有空格所以这是一个很长的词语而且还要继续写下去直到超过界限为止", "the" * 3000]
    flat, size, row, index = language.words(pa.array([" ".join(long), "then"]))
    assert sorted(size.tolist()) == sorted([5, *[len(w.encode()) + 1 for w in long]])  # no word is cut
    got = m.log_likelihood(flat, size)[index, 0]
    assert np.allclose(got, [log_total(b" " + w.encode()) for w in [*long, "then"]])
    weight = np.ones((len(size), 1))
    counts = m.expected(flat, size, weight)[:, 0]
    assert np.isclose(sum(c * len(of_piece) for c, of_piece in zip(counts[1:], p.pieces, strict=True)), size.sum())  # pieces cover each byte once

    flat, size, row, index = language.words(pa.array(["then other", None, "the"]))
    assert row.tolist() == [0, 0, 2]
    got = np.exp(m.log_likelihood(flat, size))[index, 0]
    assert np.allclose(got, [total(b" then"), total(b" other"), total(b" the")])


def test_html(spark):
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies on this page.</div><article><h1>A &amp; B</h1><p>One  two\n three <b>four</b>.<p>Short.</p></article><div id=comments><p>I like this article very much indeed.</p></div><footer>&copy; us</footer>"
    assert html_text.main_text(page) == "A & B\n\nOne two three four.\n\nShort."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    d = spark.createDataFrame([(1, "u", page, "z"), (1, "u", page, "z"), (2, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.n_chars) for r in html_text.extract(d).collect()) == [(1, 34), (1, 34), (2, 0)]


PROSE = "<p>one two three four five six seven eight nine ten eleven twelve thirteen fourteen</p>"


@pytest.mark.parametrize(("page", "paragraphs"), [
    ("<datalist><option value=a>{0}{0}", 2), ("<button>Buy{0}{0}", 2), ("<object data=x>{0}{0}", 2), ("<select><option>a<option>b</select>{0}", 1),
    ("<section id='social-history'>{0}</section><section class=legal-background>{0}</section>", 2), ("<div class='share-buttons'>{0}</div>{0}", 1),
    ("<script>var x = 1;{0}", 1), ("<!-- open {0}{0}", 2), ("<a href='x'>{0}{0}", 2), ("<p title='it is>{0}<a href=\"x>{0}", 2), ("<svg><text>no</text></svg>{0}", 1),
    ("<aside>{0}", 1), ("<aside>{0}</aside>{0}", 1), ("<p title='a hidden b'>{0}</p>", 1), ("<div hidden>{0}</div>{0}", 1),
])
def test_bad_markup_costs_no_text(page, paragraphs):
    text = html_text.main_text("<article>" + PROSE + page.format(PROSE) + "</article>")
    assert text.count("one two three") == paragraphs + 1


@pytest.mark.parametrize("unit", ['<a href="', "<a ='>' ", '<a x=">" ', "<!--", "<script>", "<div>", "<button>", "</div", "<x ="])
def test_reading_is_linear(unit):
    import time

    began = time.process_time()
    html_text.main_text("<article>" + PROSE + unit * 100_000 + PROSE)
    assert time.process_time() - began < 20


def test_html_against_a_plain_reader(spark):
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            if tag in ("h1", "h2", "h3", "p", "li", "ul", "ol", "article", "blockquote", "div"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            if tag in ("h1", "h2", "h3", "p", "li", "ul", "ol", "article", "blockquote", "div"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.depth:
                self.blocks[-1] += data

    rows_ = html_text.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows_) == len(pages)
    for r in rows_:
        plain = Article()
        plain.feed(pages[r.page_id].html or "")
        plain.close()
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
        assert r.text == want and r.n_chars == len(want)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

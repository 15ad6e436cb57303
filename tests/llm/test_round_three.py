"""Importance resampling, embedding whitening and SimHash against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import resampling, simhash, topk_search, whitening
from tests.llm import brute

ROW = "doc_id long, text string, rank string, score string, component_id string, print string, n string, x string"
ODD = [None, "", " \t\n ", "one", "Ä ö ß — 日本語   x", "A\x0bb\x0cc\x1cd e f", "don't  stop\n\n  now   ", "1 2 3 4", "x" * 5000, "Long words " * 30_000]


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "r", "s", "c", "p", "n", "x") for i, t in zip(ids, texts)], ROW).repartition(3)


def some_texts(seed, n, words=400, longest=60):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdeFGé1") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [" ".join(rng.choice(known) for _ in range(rng.randint(0, longest))) for _ in range(n)]


# ---- importance resampling ------------------------------------------------------------


@pytest.mark.parametrize("ngrams, buckets, min_words, percent", [(1, 10_000, 20, 10), (2, 500, 5, 33), (3, 50, 0, 100)])
def test_resampling(spark, ngrams, buckets, min_words, percent):
    texts = some_texts(1, 120) + ODD
    ids = [*range(len(texts) - 3), 7, 7, None]  # repeated and null ids
    target = some_texts(2, 10, words=60) + [None, ""]
    docs, wanted = table(spark, texts, ids), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, wanted, ngrams=ngrams, buckets=buckets, min_words=min_words, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute.resample(list(zip(ids, texts)), target, ngrams, buckets, min_words, percent)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_resampling_of_nothing(spark):
    docs, empty = table(spark, ["a b c"] * 3), table(spark, [])
    assert resampling.resample(empty, docs).collect() == []
    out = resampling.resample(docs, empty, min_words=1, percent=50).collect()
    assert sorted(r["rank"] or 0 for r in out) == [0, 0, 1]
    assert len({r["weight"] for r in out}) == 1


def test_features_of_repeated_and_split_words():
    found = resampling.Features([b"a b a b", b"", "é,A".encode()], 2, 1 << 31)
    assert found.n_features.tolist() == [7, 0, 3]
    assert found.n_words.tolist() == [4, 0, 2]
    assert len(set(found.bucket[:7].tolist())) == 4  # a, b, "a b", "b a"


def test_draw_prefers_the_target(spark):
    """Documents in the target's words are drawn more often than their share."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("mno" if i % 10 == 0 else "xyz") + rng.choice("abc") for _ in range(30)) for i in range(500)]
    target = spark.createDataFrame([(" ".join(rng.choice("mno") + rng.choice("abc") for _ in range(300)),)], "text string")
    drawn = resampling.resample(table(spark, texts), target).filter("rank is not null").collect()
    assert len(drawn) == 50 and sum(r["doc_id"] % 10 == 0 for r in drawn) >= 45
    assert sorted(r["rank"] for r in drawn) == list(range(1, 51))


# ---- whitening ------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "n", "w", "x") for i, v in rows], "vec_id long, embedding array<double>, n string, whitened string, x string").repartition(3)


def check_whitening(spark, rows, k=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, (*v, *[0] * (width - len(v)))) for i, v in kept]
    x = np.array(sorted({v for _, v in kept}), dtype=np.int64)
    n, total = len(x), x.sum(0)
    values, basis = np.linalg.eigh(np.cov(x.T.astype(float), bias=True).reshape(width, width))
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    m = int((values > 1e-12 * values[0]).sum())
    got = whitening.whiten(vectors(spark, rows), "vec_id", "embedding", k).collect()
    assert len(got) == m * len(kept)
    by = defaultdict(list)
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-10
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / x.var(0).sum(), rel=1e-9)
        by[r["component"]].append((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]))
    for c in range(1, m + 1):
        want = sorted((i if i is not None else -1, int(((n * np.array(v, dtype=object) - total) ** 2).sum()), float((np.array(v) - total / n) @ basis[:, c - 1] / math.sqrt(values[c - 1]))) for i, v in kept)
        have = sorted(by[c])
        assert [w[:2] for w in want] == [h[:2] for h in have]
        w, h = np.array([w[2] for w in want]), np.array([h[2] for h in have])
        assert min(np.abs(w - h).max(), np.abs(w + h).max()) < 1e-8
    return got


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[2][1])] + [(1000 + i, rows[0][1]) for i in range(200)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 10), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [4.0, 5.0]), (2005, [])]
    check_whitening(spark, rows)


def test_whitening_of_low_rank(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-3, 4, (60, 2)) @ np.array([[1, 2, 0, 0, 1, 3], [0, 1, 1, 5, 0, 0]]).astype(float))]
    assert {r["component"] for r in check_whitening(spark, rows)} == {1, 2}


def test_whitening_of_equal_eigenvalues(spark):
    """A cross-polytope: all directions have the same variance; any orthonormal components will do."""
    rows = [(2 * i + s, [float(4 * (1 - 2 * s)) if j == i else 0.0 for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect()
    assert len(got) == 48 and all(r["explained"] == pytest.approx(1 / 6) and r["identity_error"] < 1e-10 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect() == []


def test_whitening_of_huge_entries(spark):
    """Deviations beyond a long are null, entries beyond a long take no part."""
    rows = [(i, [float(i) * 2**40, 0.0, 1.0]) for i in range(5)] + [(9, [1e300, 0.0, 0.0])]
    got = whitening.whiten(vectors(spark, rows), "vec_id", "embedding").collect()
    assert {r["vec_id"] for r in got} == set(range(5))
    assert all((r["deviation"] is None) == (r["vec_id"] != 2) for r in got)


def test_bidiagonal_is_orthogonal(spark):
    rng = np.random.default_rng(8)
    rows = vectors(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 10)))])
    fit = whitening.Fit(whitening.whole(rows, "vec_id", "embedding"))
    steps = whitening.Bidiagonal(fit)
    for _ in range(10):
        steps.step()
    x = np.concatenate([whitening.matrix([r["x"] for r in fit.rows.collect()], fit.width)]) - fit.mean()
    u = x @ steps.y
    assert np.abs(steps.v.T @ steps.v - np.eye(10)).max() < 1e-13
    assert np.abs(u.T @ u - np.eye(10)).max() < 1e-12
    b = np.diag(steps.alpha) + np.diag(steps.beta[:-1], 1)
    assert np.abs(u.T @ x @ steps.v - b).max() < 1e-10 * steps.alpha[0]


# ---- simhash --------------------------------------------------------------------------


def near(rng, x, most):
    for b in rng.sample(range(64), rng.randint(1, most)):
        x ^= 1 << b
    return x


def some_prints(seed=1):
    """Random prints, near ones, chains, and a cluster around one print."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(500)]
    out += [near(rng, x, 6) for x in out[:300]] + [near(rng, out[0], 5) for _ in range(400)] + [0, 2**64 - 1, 1]
    for _ in range(60):
        out.append(near(rng, out[-1], 4))
    return np.unique(np.array(out, np.uint64))


def test_gray_order():
    x = np.arange(4096, dtype=np.uint64)
    order = x[np.argsort(simhash.gray_rank(x))]
    assert set(np.bitwise_count(order[1:] ^ order[:-1]).tolist()) == {1}


@pytest.mark.parametrize("bits, unit, part", [(4, 65_536, 524_288), (4, 20, 10), (4, 400, 50), (2, 100, 1000)])
def test_simhash_links(spark, bits, unit, part):
    x = some_prints()
    frame = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "print long").repartition(3)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, bits, unit, part).collect()]
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    want = brute.reachable(x.tolist(), [(int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(np.triu(close, 1)))])
    assert brute.reachable(x.tolist(), found) == want
    assert len(found) <= 4 * len(x) * (1 if unit > 10_000 else 20)


def test_simhash_search_prunes():
    """Groups are dropped at their masked patterns: few of the pairs reach the leaves, and every pair within the bound does."""
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    x = np.unique(np.concatenate((x, x[:100] ^ np.uint64(0b1011))))
    index, alone = simhash.Index(x), np.arange(len(x))
    asked = index.leaves[:200]
    pairs = {(int(a), int(b)) for q, leaf in index.search(asked, -np.arange(2, 202), alone, 4, 4, 16) for a, b in zip(asked[q], index.leaves[leaf])}
    close = np.bitwise_count(asked[:, None] ^ x[None, :]) <= 4
    assert pairs == {(int(asked[i]), int(x[j])) for i, j in zip(*np.nonzero(close))}
    for level, own in enumerate(index.own[:-1]):
        up = np.repeat(index.own[level + 1], 2)[: len(own)]
        assert not (own & up).any()  # what a parent has is factored out


def test_simhash(spark):
    texts = some_texts(7, 60, longest=90)
    rng = random.Random(8)
    for t in texts[:30]:
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = "changed"
        texts.append("\t ".join(w) if rng.random() < 0.5 else " ".join(w))
    texts += [texts[3]] * 20 + ODD + [texts[4].upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    texts, ids = texts + [texts[1], texts[1], "only here and without an id"], [*ids, ids[0], None, None]
    out = simhash.simhash(table(spark, texts, ids))
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute.simhash(list(zip(ids, texts))), key=key)


def test_simhash_of_nothing(spark):
    assert simhash.simhash(table(spark, [])).collect() == []
    out = {tuple(r) for r in simhash.simhash(table(spark, [None, "", "a"])).collect()}
    assert out == {(0, "0" * 16, 0), (1, "0" * 16, 0), (2, f"{xxhash.xxh64_intdigest(b'a', 42):016x}", 2)}


def test_fingerprint_is_over_half_of_repeated_shingles():
    t = "a b c d a b c d a b c d x"
    assert simhash.fingerprint([t.encode()])[0] == int(brute.simhash([(1, t)])[0][1], 16)


# ---- top-k search: shards ------------------------------------------------------------


def clusters(seed=6, n=600, d=8):
    """Vectors around a few far apart centres, as (id, vector) rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d)) * 20
    return [(i, (centres[i % 6] + rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("partitions", [None, 37, 211])
def test_top_k_searches_all_shards_however_the_split_falls(spark, monkeypatch, partitions):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    monkeypatch.setattr(topk_search, "SHARD", 100)
    monkeypatch.setattr(topk_search, "SHARDS_ROUTED", 10)
    monkeypatch.setattr(topk_search, "QUERIES_ROUTED", 16)
    if partitions:
        split = Classic.repartitionByRange
        monkeypatch.setattr(Classic, "repartitionByRange", lambda self, n, *by: split(self, max(n, partitions), *by))
    rows = clusters()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk_search.top_k(frame, "vec_id", "embedding", lambda i: i % 20 == 0)
    assert {tuple(r) for r in got.collect()} == brute.top_k(rows)


def test_top_k_sends_a_query_only_where_its_bound_reaches(spark):
    rows = clusters(n=1200)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    packed = topk_search.quantised(frame, "vec_id", "embedding").withColumn("asked", F.col("id") % 20 == 0)
    pivots = np.array([v for _, v in rows[:6]])
    blocks, queries = topk_search.shards_and_queries(packed, 8, 12, pivots / np.linalg.norm(pivots, axis=1, keepdims=True), 20)
    pairs = topk_search.routed(blocks, queries, 8)
    shards = blocks.select("shard").distinct().count()
    assert queries.count() == 60 and shards >= 10
    assert 60 <= pairs.count() <= 60 * shards // 2  # of all pairs of a query and a shard


def test_top_k_leaves_out_what_a_long_cannot_hold(spark):
    rows = [(i, [float(i), 1.0]) for i in range(25)] + [(40, [1e18, 0.0]), (60, [1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk_search.top_k(frame, "vec_id", "embedding", lambda i: i % 20 == 0).collect()}
    assert got == brute.top_k(rows[:25])

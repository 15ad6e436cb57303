"""What a Python worker holds at once, in tasks of texts."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import jaccard_join, language_id
from quarry.llm.frames import ARROW_BYTES, in_small_batches

ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def some_texts(n, words, seed=1):
    rng = np.random.default_rng(seed)
    return [" ".join(map(str, rng.integers(0, 10**6, words))) for _ in range(n)]


def batches(texts, rows):
    return iter(pa.table({"text": texts}).combine_chunks().to_batches(max_chunksize=rows))


def peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_packing_holds_one_block():
    texts = some_texts(2000, 1500)

    def run():
        for _ in jaccard_join._pack(16)(batches(texts, 300)):
            pass

    run()  # what a worker keeps for all tasks
    assert peak_mb(run) < 60


def test_a_task_signs_copies_once(monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SIGNATURES", 10_000)
    texts = some_texts(400, 100)
    packed = pa.Table.from_batches(jaccard_join._pack(4)(batches(texts * 3, 200)))
    assert packed.num_rows > 4  # several blocks
    for bucket in range(4):
        classes = np.concatenate([np.frombuffer(c, np.int64) for b, c in zip(packed["bucket"].to_pylist(), packed["classes"].to_pylist()) if b == bucket])
        assert len(classes) == len(set(classes.tolist()))


@pytest.mark.parametrize("sorted_", [1, 50, 10**6])
def test_groups_of_a_bucket_do_not_depend_on_its_parts(monkeypatch, sorted_):
    monkeypatch.setattr(jaccard_join, "SORTED", sorted_)
    text = some_texts(1, 60)[0].split()
    texts = [" ".join(text[:k]) for k in range(40, 61)] + some_texts(5, 50, seed=2)
    packed = list(jaccard_join._pack(1)(batches(texts, 4))) + list(jaccard_join._pack(1)(batches(texts[::2], 4)))
    got = pa.Table.from_batches(jaccard_join._shared(iter(packed))).to_pylist()
    by = {}
    for s in jaccard_join.shingle_sets([t.encode() for t in texts]):
        for x in set(jaccard_join.signatures(s)[0].tolist()):
            by.setdefault(x, set()).add(int(jaccard_join.class_id(s)))
    groups = {}
    for members in map(frozenset, by.values()):
        if len(members) > 1:
            groups[members] = groups.get(members, 0) + 1
    found = {}
    for r in got:
        found.setdefault(r["grp"], []).append((r["class"], r["times"]))
    assert {frozenset(c for c, _ in g): {t for _, t in g} for g in found.values()} == {m: {n} for m, n in groups.items()}
    assert len(found) == len(groups) and sum(map(len, found.values())) == sum(map(len, groups))


def test_a_bucket_without_shared_signatures():
    packed = list(jaccard_join._pack(1)(batches(some_texts(1, 30), 1)))
    assert list(jaccard_join._shared(iter(packed))) == []


def test_emissions_are_summed_in_slices():
    words = [f"{chr(97 + i % 26)}wort{i}".encode() for i in range(60_000)]
    model = language_id.Model(["a", "b", "c", "d"], {words[5]: [0, 2]})
    model.weight = np.random.default_rng(1).standard_normal(model.weight.shape)
    own, feature = language_id._features(words, model.lexicon)
    whole = language_id._sums(own, model.weight[feature], len(words))
    assert (model.emissions(words) == whole).all()
    assert peak_mb(lambda: model.emissions(words)) < 30


def largest_batch(df):
    def rows(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max((b.num_rows for b in batches), default=0)])], names=["n"])

    return max(r["n"] for r in df.mapInArrow(rows, "n long").collect())


def test_batches_of_texts_are_small(spark):
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('abcdefghi ', 300) AS text", "'de' AS lang")
    before = spark.conf.get(ARROW)
    assert largest_batch(docs) == 3000
    with in_small_batches(spark):
        assert largest_batch(docs) <= 2 * ARROW_BYTES // 3000
    assert spark.conf.get(ARROW) == before
    try:
        corpus_pipeline.language_id(spark, docs, "")
        assert largest_batch(docs) <= 2 * ARROW_BYTES // 3000
    finally:
        spark.conf.set(ARROW, before)

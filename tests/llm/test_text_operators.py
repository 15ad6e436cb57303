"""Substring dedup, decontamination, Jaccard join, packing and token counts against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import decontaminate as dec
from quarry.llm import jaccard_join as jac
from quarry.llm import packing, queries, substring_dedup, token_counts
from quarry.llm.frames import drop_staged, staging_folder
from quarry.llm.words import ALNUM, Block, Runs
from tests.conftest import SF0001
from tests.llm import brute

ROW = "doc_id long, text string, lang string, n_words string, hits string, score string, kept_text string"
ODD = [None, "", " \t\n ", "one", "Ä ö ß — 日本語   x", "a\x0bb\x0cc\x1cd", "<|endoftext|> and <|startoftext|>", "don't  stop\n\n  now   ", "x" * 5000]


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results, a repeated row and a null id."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None, "n", "h", "s", "k") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, ROW).repartition(3)


@pytest.fixture(scope="module")
def passages():
    """Texts of a small vocabulary with shared passages, near copies, copies and odd texts; the ids repeat and one is null."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (7, 12, 30, 60, 90)]
    out = []
    for k in range(70):
        w = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            w += s[a : rng.randint(a, len(s))] + text(rng.randint(0, 3))
        out.append(" ".join(w))
    for base in range(0, 60, 6):
        for _ in range(3):
            w = out[base].split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
            out.append("\n".join(w) if rng.random() < 0.3 else " ".join(w))
    out += [out[3]] * 15 + ODD + ODD
    ids = list(range(len(out)))
    rng.shuffle(ids)
    return out + [out[5], out[5], out[8]], [*ids, ids[5], ids[5], None]


@pytest.mark.parametrize("length, seed", [(6, 3), (10, 4), (50, 20)])
def test_substring_dedup(spark, passages, length, seed):
    docs = table(spark, *passages)
    out = substring_dedup.substring_dedup(docs, length=length, seed=seed)
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    want = brute.substring_dedup(list(zip(passages[1], passages[0])), length)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert length == 50 or sum(r[2] for r in want) > 100
    assert [c for c in out.columns if c in docs.columns][:3] == ["doc_id", "text", "lang"]


def test_substring_dedup_reports_maximal_ranges(spark):
    w = [f"w{i}" for i in range(40)]
    docs = table(spark, [" ".join(w[5:30]), " ".join(["x", *w, "y"])])
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, length=10, seed=4).collect()}
    assert [(r["start"], r["end"]) for r in got[1]["removed"]] == [(6, 31)]
    assert got[0]["removed"] == [] and got[1]["kept_text"] == " ".join(["x", *w[:5], *w[30:], "y"])


@pytest.mark.parametrize("max_windows", [1_000_000, 20])
def test_decontaminate(spark, passages, max_windows):
    texts, ids = passages
    items = [(k, " ".join(t.upper().split()[4:30])) for k, t in enumerate(texts[:12]) if t] + [(90, "abc"), (91, ""), (92, None), (93, "— ?"), (93, texts[20])]
    docs = table(spark, texts, ids)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dec.scan(docs.select("doc_id", "text"), bench, "text", "item_id", "text", max_windows=max_windows)
    n = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    which = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    got = found.select("doc_id", "n_words", F.size(n), F.size(which), F.sha2(F.concat_ws(",", which), 256), F.size("hits") > 0).collect()
    want = brute.decontaminate(list(zip(ids, texts)), items)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert 10 < sum(r[5] for r in want) < len(want)


def test_sketches_never_exceed_the_difference(spark):
    """A pair that links passes its sketches; one that is far from it mostly doesn't."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows, pairs, linked = [], [], set()
    for k in range(60):
        n = int(rng.integers(1, 800))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, max(1, n // 8)).astype(np.uint64))))
        bits = sum(int(x ^ y).bit_count() for x, y in zip(jac.sketch(a).view(np.uint64).tolist(), jac.sketch(b).view(np.uint64).tolist()))
        both = len(np.intersect1d(a, b))
        assert bits <= len(a) + len(b) - 2 * both
        rows += [(2 * k, len(a), jac.sketch(a).tolist()), (2 * k + 1, len(b), jac.sketch(b).tolist())]
        pairs.append((2 * k, 2 * k + 1))
        linked |= {2 * k} if 100 * both >= 75 * (len(a) + len(b) - both) else set()
    sets = spark.createDataFrame(rows, "class long, n long, sketch array<long>")
    got = {r["hub"] for r in jac.possible(spark.createDataFrame(pairs, "hub long, class long"), sets, 75).collect()}
    assert linked <= got and 5 < len(linked) and len(got) < 40


def test_decontaminate_moves_only_texts_with_hits(spark):
    """Whatever the number of groups, no Python worker reads the documents again, and texts without a hit are in no shuffle."""
    item = "one two three four five six seven eight nine ten"
    docs = table(spark, [item, *(f"clean text number {i}" for i in range(50))])
    bench = spark.createDataFrame([(k, f"{item} {k} and more {k + 1} words {k} after it") for k in range(20)], "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = dec.scan(docs.select("doc_id", "text"), bench, "text", "item_id", "text", max_windows=10)
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "MapInArrow" not in plan and "SortMergeJoin" in plan
    hits = {r["doc_id"]: r["hits"] for r in found.collect()}
    assert [(h["start"], h["length"], sorted(h["items"], key=int)) for h in hits.pop(0)] == [(0, 10, [str(k) for k in range(20)])]
    assert not any(hits.values()) and len(hits) == 50


def test_decontaminate_removes_documents_or_spans(spark):
    item = "one two three four five six seven eight nine ten"
    docs = table(spark, [f"Ah! {item.upper()}; äh.", "clean text", None])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    cut = {r["doc_id"]: r["text"] for r in dec.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {0: "Ah! ; äh.", 1: "clean text", 2: None}
    assert dec.decontaminate(docs, bench.limit(0)).count() == 3
    with pytest.raises(ValueError):
        dec.decontaminate(docs, bench, remove="words")


def test_jaccard_join(spark, passages):
    texts, ids = passages
    got = [tuple(r)[:3] for r in jac.jaccard_join(table(spark, texts, ids)).collect()]
    want = brute.jaccard(list(zip(ids, texts)))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(c != i for i, _, c in want) > 20


def test_jaccard_join_of_hub_and_chain(spark):
    """Copies that link only through the text they were made of, and small sets at the bound."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(0, 120, 6), 3):
            w[at] = f"x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base), *(" ".join(base[a : a + n]) for a in range(4) for n in (4, 5, 6, 7, 8, 9, 11, 12))]
    got = [tuple(r)[:3] for r in jac.jaccard_join(table(spark, texts)).collect()]
    assert sorted(got) == sorted(brute.jaccard(list(enumerate(texts))))


def test_jaccard_components_of_cliques_and_bridges(spark, passages, monkeypatch):
    """A clique, copies, a text without an id as the only bridge; with parts of many sets and of few."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    clique = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 100, 5)]
    texts, ids = passages
    texts = texts + clique + clique[:3] + [" ".join(base[:90]), " ".join(base[15:95] + [f"y{k}" for k in range(14)])]
    ids = ids + list(range(1000, 1000 + len(clique) + 3)) + [None, 2000]
    rng.shuffle(ids)
    want = sorted(map(str, brute.jaccard(list(zip(ids, texts)))))
    for part in (jac.PART_SETS, 4):
        monkeypatch.setattr(jac, "PART_SETS", part)
        assert sorted(str(tuple(r)) for r in jac.jaccard_join(table(spark, texts, ids)).collect()) == want


def test_jaccard_of_a_cluster_compares_few_pairs(spark, monkeypatch):
    """Near copies of one text, most of them too different from each other to link: pairs grow with the cluster, not with its square."""
    compared = []
    verified = jac.verified
    monkeypatch.setattr(jac, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    counts = []
    for size in (150, 300):
        rng = random.Random(size)
        base = [f"w{k}" for k in range(300)]
        texts = [" ".join(base)]
        for i in range(size):
            at = set(rng.sample(range(300), 8))
            texts.append(" ".join(f"x{i}y{k}" if k in at else w for k, w in enumerate(base)))
        compared.clear()
        out = jac.jaccard_join(table(spark, texts)).collect()
        assert sorted(tuple(r) for r in out) == sorted(brute.jaccard(list(enumerate(texts))))
        counts.append(sum(compared))
    assert counts[1] < 3 * counts[0] and counts[1] < 300 * 40


def apart(size):
    """Near copies of a text that is not there, any two of them too different to link."""
    rng = random.Random(size)
    texts = []
    for i in range(size):
        at = set(rng.sample(range(300), 8))
        texts.append(" ".join(f"x{i}y{k}" if k in at else f"w{k}" for k in range(300)))
    return texts


def test_jaccard_of_copies_that_do_not_link_makes_few_rows(spark, monkeypatch):
    """Rows of pairs grow with the members of a group, also of one without links."""
    made = []
    staged = jac.staged

    def counted(df, *path):
        out = staged(df, *path)
        if "hub" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(jac, "staged", counted)
    for size in (100, 200):
        made.clear()
        out = jac.jaccard_join(table(spark, apart(size))).collect()
        assert sorted(tuple(r) for r in out) == sorted(brute.jaccard(list(enumerate(apart(size)))))
        assert 0 < sum(made) <= 4 * size


@pytest.mark.parametrize("single", [0, 1])
def test_jaccard_cells_of_parts_and_rounds_lose_no_link(spark, passages, monkeypatch, single):
    """Groups dealt over many parts, members with more partners than a round gives, slabs of a few pairs."""
    for name, value in (("SINGLE", single), ("CELL_SETS", 6), ("CELL_PAIRS", 20), ("NEAREST", 1), ("GROWTH", 3)):
        monkeypatch.setattr(jac, name, value)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    chain = [" ".join(base[:k] + [f"z{i}" for i in range(k, 120)]) for k in range(90, 120, 3)]  # each near the next
    spread = []
    for i in range(24):
        at = set(rng.sample(range(120), 2))
        spread.append(" ".join(f"x{i}" if k in at else w for k, w in enumerate(base)))
    texts, ids = passages
    texts, ids = texts + chain + spread + apart(12), ids + list(range(3000, 3000 + len(chain) + len(spread) + 12))
    want = sorted(map(str, brute.jaccard(list(zip(ids, texts)))))
    assert sorted(str(tuple(r)) for r in jac.jaccard_join(table(spark, texts, ids)).collect()) == want


def test_near_pairs_of_a_cell_are_all_of_two_components():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 180, replace=False), rng.integers(0, 2**63, 4).astype(np.uint64)))) for _ in range(40)]
    n, sketches = np.array([len(s) for s in sets]), np.array([jac.sketch(s) for s in sets])
    for component in (np.arange(40), np.arange(40) % 3, np.arange(40) // 20, np.zeros(40, np.int64)):
        got = [p for p in jac._near(np.arange(40), n, np.arange(40), component, sketches, 75, 40)]
        got = {(h, c) for hub, klass, more in got for h, c, m in zip(hub.tolist(), klass.tolist(), more.tolist()) if not m}
        bits = lambda i, j: int(np.bitwise_count((sketches[i] ^ sketches[j]).view(np.uint64)).sum())
        assert got == {(i, j) for i in range(40) for j in range(i) if component[i] != component[j] and 7 * bits(i, j) <= n[i] + n[j]}


def test_signatures_lose_no_link():
    """Linked sets of any size share at least as many signatures as both their bounds say."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 20, 28, 29, 40, 60, 150, 400, 1100):
        for _ in range(60 if size < 100 else 12):
            big = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            for drop, add in ((size // 4, 0), (size // 7, size // 7), (size // 8, size // 9), (0, size // 3)):
                other = np.union1d(rng.permutation(big)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64))
                both = len(np.intersect1d(big, other))
                if 100 * both >= 75 * (len(big) + len(other) - both) and len(other) > 2 and len(big) + len(other) > 2 * both:
                    (one, a), (two, b) = jac.signatures(big), jac.signatures(other)
                    assert len(np.intersect1d(one, two)) >= max(a, b) >= jac.SHARED


def test_packing(spark, passages):
    texts, ids = passages
    texts = [*texts, " ".join(f"token{i}" for i in range(9000))]
    ids = [*ids, 10**12]
    path = packing.tokenizer_path("word_bpe_49k.json")
    got = packing.pack(table(spark, texts, ids), "doc_id", "text", path).collect()
    want = brute.pieces(list(zip(ids, texts)), Tokenizer.from_file(path))
    assert brute.Counter(tuple(r)[:5] for r in got) == want
    n = brute.sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got])
    assert n <= -(-sum(k[3] * v for k, v in want.items()) // 4096) + 1


def test_best_fit_equals_best_fit_decreasing():
    import numpy as np

    rng = random.Random(2)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(0, 20))}
        rows = []
        runs = packing.best_fit(counts, 100)
        for length, n in counts.items():
            own = runs[runs[:, 0] == length]
            for rank in range(n):
                _, first, sequence, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                rows.append((int(sequence + rank - first), int(offset), length))
        room: list[int] = []  # best-fit decreasing, one piece at a time
        for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
            if fits := [g for g in room if g >= length]:
                room.remove(min(fits))
                room.append(min(fits) - length)
            else:
                room.append(100 - length)
        assert brute.sequences(rows, 100) == len(room)


def test_word_encoder_equals_tokenizer():
    coder = packing.encoder(packing.tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(3)
    odd = ["don't we'll A.B. C,,,d e.'s", "<|EndOfText|> y", "İstanbul ΑΣ Σ ς ǅ", "é ́x", "a\x1cb\x85c\xa0d", "12a3 ½ ² ٣", "a.̸b ≠", "ﬁ Å Å K"]
    odd += ["".join(rng.choice("aAbzé'.,!#$ \n\t|*&-_<>1 ²İΣσß́‍\x85") for _ in range(50)) for _ in range(500)]
    assert all(coder.encode(t.encode()) == coder._ids(t) for t in odd)


def test_pre_tokens_equal_library():
    own = token_counts.pre_tokens(token_counts.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice("abZé²ªµ'.,_$|1 \n\t\x85\xa0ß日<\u0301") for _ in range(rng.randint(1, 30)))
        spaced, others, _ = own.stretches(t)
        cut = [p for s in (*others, *(" " + x for x in spaced)) for p in own.cut(s)]
        assert sorted(cut) == sorted(own._by_library(t))


@pytest.mark.parametrize("head", [200_000, 30])
def test_token_counts(spark, passages, head):
    texts, ids = passages
    rng = random.Random(3)
    texts = [*texts, *("".join(rng.choice("ab1.'é \n\t\x85\xa0") for _ in range(40)) for _ in range(80))]
    ids = [*ids, *range(1000, 1080)]
    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    got = token_counts.token_counts(table(spark, texts, ids), "doc_id", "text", path, head=head).collect()
    model = Tokenizer.from_file(path)
    want = [(i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(ids, texts)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_word_hashes_depend_on_words_alone():
    a, b = Block(["x Uno  dos".encode(), b"", b"tres"], ALNUM, lower=True), Block([b"uno", b"dos tres"], ALNUM)
    assert list(a.hash[1:]) == list(b.hash) and a.words(0) == [b"x", b"uno", b"dos"] and a.words(1) == []
    import numpy as np

    at = np.array([0, 1])
    assert Runs(a.hash).get(at + 1, at + 3).tolist() == Runs(b.hash).get(at, at + 2).tolist() != Runs(b.hash).get(at, at + 1).tolist()


def test_empty_tables(spark):
    docs, bench = table(spark, []), spark.createDataFrame([], "item_id long, text string")
    path = packing.tokenizer_path("word_bpe_49k.json")
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert dec.decontaminate(docs, bench).count() == 0
    assert jac.jaccard_join(docs).count() == 0
    assert packing.pack(docs, "doc_id", "text", path).count() == 0
    assert token_counts.token_counts(docs, "doc_id", "text", token_counts.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_queries_on_given_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]

    def got(name, *columns):
        return sorted(tuple(r) for r in queries.QUERIES[name](spark, SF0001).select(*columns).collect())

    assert got("op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(docs))
    assert got("op3_decontaminate", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.decontaminate(docs, items))
    assert got("op9_jaccard_join", "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs))


def test_staged_tables_can_be_dropped(spark):
    jac.jaccard_join(table(spark, ["a b c d e f g h", "a b c d e f g h i"])).collect()
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    where = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert where.exists(fs)
    drop_staged(spark)
    assert not where.exists(fs)

"""Search and extraction against brute force; classifiers by held-out accuracy; the pipeline stage by stage."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import html_extract as html
from quarry.llm import language_id as lid
from quarry.llm import packing, quality, queries, topk_search, toxicity
from tests.conftest import SF001, SF0001
from tests.llm import brute
from tests.llm.test_text_operators import ODD, table


# search


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 5)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)]  # ties
    rows += [(420, None), (421, [1.0, None]), (440, [math.inf] * 5), (441, [math.nan] * 5), (460, []), (461, [0.5]), (None, [1.0] * 5), (40, rows[40][1])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = topk_search.top_k(vectors, "vec_id", "embedding", lambda i: i % 20 == 0)
    assert {tuple(r) for r in got.collect()} == brute.top_k(rows)
    assert topk_search.top_k(vectors.limit(0), "vec_id", "embedding", lambda i: i % 20 == 0).count() == 0
    assert got.filter("rank = 20").count() > 15 and topk_search.top_k(vectors.filter("vec_id < 3"), "vec_id", "embedding", lambda i: i == 0).count() == 2


def test_shard_search_prunes_and_is_exact(monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 8)
    rng = np.random.default_rng(3)
    centre = rng.integers(-200, 200, (10, 6))
    vectors = np.sort(rng.integers(0, 10, 400))
    vectors = centre[vectors] + rng.integers(-3, 3, (400, 6))
    ids = rng.permutation(400)
    queries_ = vectors[::40]
    shard, scored = topk_search.Shard(ids, vectors), []
    product = topk_search.product
    monkeypatch.setattr(topk_search, "product", lambda a, b: scored.append(len(a) * len(b)) or product(a, b))
    place, found, score = shard.search(ids[::40], queries_, np.full(10, topk_search.NONE), 5)
    for q in range(10):
        best = sorted((-int(vectors[j] @ queries_[q]), int(ids[j])) for j in range(400) if ids[j] != ids[::40][q])[:5]
        assert sorted(zip((-score[place == q]).tolist(), found[place == q].tolist())) == best
    assert sum(scored[2:]) < 0.7 * 10 * 400


# extraction


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li><a href=/x>menu one</a></li></ul></nav><!-- <p>no</p> -->
<div class="col sidebar">side words here</div><{mark}><header><h1>Ti&amp;tle</h1></header><p>Hello <a href="x>y">wor</a>ld &amp; all.
<p>Second<br>line&nbsp;end<div class='ad'>buy <div>now</div></div><p>&lt;third&gt;   text &#233;</p>
<form>mail <input></form></{mark}><section id="comments"><p>a reader says this</p></section><footer>&copy; us</footer></body></html>"""
TEXT = "Ti&tle Hello world & all. Second line end <third> text é"


def test_extractor_without_labels():
    own = html.Extractor({})
    assert own.text(PAGE.replace("{mark}", "article")) == TEXT == own.text(PAGE.replace("{mark}", "main"))
    assert own.text("") == own.text("<p>") == own.text("<nav>a</nav>") == ""
    assert own.text("just < text") == "just < text"
    assert own.text("<article><p>a b c d<div class=ad>x") == "a b c d"
    assert own.text("<p>" + "long " * 50000 + "</p>").count("long") == 50000


def test_extract_with_end_tags_left_out():
    own = html.Extractor({})
    assert own.text("<article><p>Text<p class='notice'>Ad <b>x</b><p>More text<p>and more</article>") == "Text More text and more"
    assert own.text("<article><p>Text here now<div><p class=notice>Ad</div>More text</article>") == "Text here now More text"
    assert own.text("<article><ul><li>a b<li class=ad>x<ul><li>y<li>z</ul><li>c d</ul><dl><dt class=ad>x<dd>e f</dl></article>") == "a b c d e f"
    assert own.text("<article><div>a b<ul><li>c d<li class=ad>x</ul>e f</div></article>") == "a b c d e f"
    assert own.text("<article><table><tr><td>a b g h<td class=ad>x<table><tr><td>y<td>z</table>w<tr><td>c d i j</table></article>") == "a b g h c d i j"
    assert own.text("<head><title>t</title><p>a b") == "a b"
    assert own.text("<article><div class=ad>x<p>y<div>z</div></span>w</div>a b</article>") == "a b"
    for name in ("video-js", "svg-icon", "select-menu", "template-x"):
        assert own.text(f"<article><p>a b</p><{name} x='1'>c</{name}><p>d e</p></article>") == "a b c d e"
    assert own.text("<article><p>a b</p><video src=x>no</video><svg\n>t</svg><p>d e</p></article>") == "a b d e"


def test_best_region_is_the_maximum():
    rng = random.Random(1)
    for _ in range(200):
        scores = [rng.choice((1.0, 2.0, -1.0, -3.0)) for _ in range(rng.randint(0, 15))]
        a, b = html.best_region(scores)
        assert sum(scores[a:b]) == max((sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)), default=0) or (a, b) == (0, 0)


def test_extract_learns_class_words(spark):
    page = "<body><div class='zzbox'>noise words {i}</div><article><p>text {i}</p></article></body>"
    rows = [(i, f"u{i}", page.format(i=i), "old") for i in range(30)] + [(90, "u", None, "old"), (91, "u", "", "old"), (91, "u", "", "old"), (92, None, page.replace("article", "div").format(i=92), "old")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(2)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    assert got[:30] == [(i, f"text {i}", len(f"text {i}")) for i in range(30)]
    assert got[30:] == [(90, "", 0), (91, "", 0), (91, "", 0), (92, "text 92", 7)]
    assert html.extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def test_extract_weights_of_wrappers_and_of_many_class_words(spark):
    """What the marks stand in is content; a class word is learned however many others are more frequent."""
    letters = "abcdefghij"
    many = " ".join("q" + "".join(letters[int(d)] for d in str(k)) for k in range(5200))
    page = "<body><p class='lead'>skip this<div class='wrapper'><div class='zzbox'>noise words</div><article><p class='{c}'>text {i}</p><p class='{c}'></p></article></div></body>"
    rows = [(i, page.format(i=i, c=many)) for i in range(25)]
    rows += [(50, "<body><div class='wrapper'><p>plain text here</p><div class='zzbox'>noise words</div></div></body>")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, html string").repartition(2)).collect()}
    assert got == {**{i: f"text {i}" for i in range(25)}, 50: "plain text here"}


LONG = " ".join(f"word{k}" for k in range(60))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class='layout has-sidebar'><p>{LONG}</p><div class=sidebar>side</div></div>", LONG),
        (f"<div class='search-page'><p>{LONG}</p></div>", LONG),
        (f"<body class=ads><div class='content social'><h1>Head</h1><p>{LONG}</p><div class='cookie-banner'>ok</div></div></body>", f"Head {LONG}"),
        (f"<article><p>{LONG}</p><p class='market-share'>a third</p><p class='ad-free'>none</p><p class='ad-slot'>buy</p></article>", f"{LONG} a third none"),
        (f"<body><header>Site</header><div class=post><header><h1>Head</h1></header><p>{LONG}</p></div></body>", f"Head {LONG}"),
        (f"<head><title>Head &amp; tail | Site</title></head><body><header><h1>Head &amp; <i>tail</i></h1></header><p>{LONG}</p></body>", f"Head & tail {LONG}"),
        (f"<head><title>Head | Site</title></head><body><header><h1>Site</h1></header><p>{LONG}</p></body>", LONG),
        (f"<article><p>Lead</p><hr><hr><div><img></div><p>{LONG}</p><hr><hr><hr><hr><p>end</p></article>", f"Lead {LONG} end"),
        (f"<body><nav>a b</nav><p>Lead</p><hr><hr><hr><hr><p>{LONG}</p><hr><hr><hr><hr><p>end</p><p><a href=x>more</a></p></body>", f"Lead {LONG} end"),
        (f"<form id=all><h1>Head</h1><p>{LONG}</p></form>", f"Head {LONG}"),
        (f"<p>Short text</p><div id=comments><p>{LONG}</p></div>", "Short text"),
        (f"<main><p>Short text</p></main><div class=sidebar><p>{LONG}</p></div>", "Short text"),
        (f"<main><p>Short text</p><article><p>{LONG}</p></article></main>", f"Short text {LONG}"),
        ("<form>name <input></form>", ""),
    ],
)
def test_extract_pages_without_labels(page, want):
    """Hand-made answers: pages without a mark, and classes that only look like those of no content."""
    assert html.Extractor({}).text(page) == want


def test_extract_given_pages(spark):
    """The articles of the given pages are the marked ones; a plain cut at the marks is the other way to get them."""
    import html as codec
    import re

    want = {}
    for r in spark.read.parquet(f"{SF0001}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        want[r["page_id"]] = " ".join(codec.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", inner))).split())
    assert {r["page_id"]: r["text"] for r in queries.QUERIES["op10_html_extract"](spark, SF0001).collect()} == want


# classifiers


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    emission, start, move = rng.normal(size=(2, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    valid = np.array([[True] * 4, [True, True, False, False]])
    expected, moves = lid.forward_backward(emission, valid, start, move)
    all_moves = np.zeros((3, 3))
    for c, n in ((0, 4), (1, 2)):
        total, counts, pairs = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = math.exp(start[path[0]] + sum(emission[c, i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                counts[i, y] += w
            for a, b in zip(path, path[1:]):
                pairs[a, b] += w
        assert np.allclose(expected[c], counts / total)
        all_moves += pairs / total
    assert np.allclose(moves, all_moves)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    return lid.learn(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"), "doc_id", "text", "lang")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    out = queries.QUERIES["op5_language_id"](spark, SF001).join(docs, "doc_id")
    r = out.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    assert sum(x["n"] for x in r) == 1000 and min(x["right"] for x in r) > 0.97
    assert min(x["lo"] for x in r) >= 0 and max(x["hi"] for x in r) <= 1


def test_language_of_switched_and_odd_texts(spark, model):
    by = {r["lang"]: r["text"].split()[:60] for r in spark.read.parquet(f"{SF001}/documents.parquet").filter("doc_id < 100 and n_chars > 1000").collect()}
    texts = [*ODD, " ".join(by["en"] + by["es"][:20]), " ".join(by["es"]), "…", "12 34", "9²"]
    out = {r["doc_id"]: r for r in lid.identify(table(spark, texts), model).collect()}
    n = len(ODD)
    assert out[n]["lang_pred"] == "en" and 0.15 < out[n]["shares"]["es"] < 0.35 and out[n + 1]["lang_pred"] == "es"
    assert all(out[i]["lang_pred"] == "und" and out[i]["_score"] == 0 for i in (0, 1, 2, n + 2, n + 3, n + 4))
    assert out[3]["lang_pred"] != "und" and out[3]["score"] == "s" and len(out) == len(texts)
    nothing = lid.learn(table(spark, []), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in lid.identify(table(spark, ["text"]), nothing).collect()} == {"und"}


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n - 1) / 2) / (n * (len(labels) - n))


@pytest.mark.parametrize("name, label, least", [("op6_toxicity", "toxic", 0.75), ("op7_quality", "quality", 0.97)])
def test_classifiers_held_out(spark, name, label, least):
    out = queries.QUERIES[name](spark, SF001).join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id", "left").collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r[label] is not None]
    assert auc(np.array([r["score"] for r in held]), np.array([r[label] for r in held])) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_odd_rows(spark, module):
    bad, good = "you are a stupid idiot ### $$$", "a calm and friendly text"
    texts = [bad, good] * 20 + ODD
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None), (None, 1), (3, 1)], "doc_id long, y int")
    model = module.learn(docs, labels, "doc_id", "text", "y")
    got = {r["doc_id"]: r["_score"] for r in module.score(docs, model).collect()}
    assert len(got) == len(texts) and got[1] > 0.5 > got[0] and all(0 <= s <= 1 for s in got.values())
    assert got[40] == got[41]  # null and empty texts
    for kept, score in (("y = 1", 1.0), ("y = 0", 0.0), ("y = 5", 0.0)):
        one = module.learn(docs, labels.filter(kept).filter("doc_id <> 3"), "doc_id", "text", "y")
        assert {r["_score"] for r in module.score(docs, one).collect()} == {score}
    assert module.score(docs.limit(0), model).count() == 0


def test_toxicity_shares_n_grams_of_misspellings():
    rng = random.Random(8)
    calm = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    text = lambda extra: " ".join(rng.sample(calm, 12) + extra).encode()
    texts = [text(["worthless"] if i % 3 == 0 else []) for i in range(300)]
    m = toxicity.Model().fit(texts, np.array([int(i % 3 == 0) for i in range(300)]), np.ones(300))
    unseen, clean = m.scores([text(["worthlesss"]) for _ in range(40)]), m.scores([text([]) for _ in range(40)])
    assert auc(np.concatenate([unseen, clean]), np.repeat([1, 0], 40)) > 0.8


def test_toxicity_learns_from_two_thousand_texts_of_a_label(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Model, "fit", lambda self, texts, label, weight: seen.append(np.bincount(label).tolist()) or self)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    toxicity.learn(docs, docs.select("doc_id", (F.col("doc_id") < 2200).cast("int").alias("y")), "doc_id", "text", "y")
    assert seen == [[2000, 2000]]


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on all that the one before kept."""
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    first = stage["language_id"](spark, docs.unionByName(docs.limit(2).withColumn("doc_id", -F.col("doc_id") - 1).withColumn("text", F.lit("12 ."))), SF0001)
    assert first.columns == docs.columns and rows(first) == rows(docs)
    second = stage["near_duplicates"](spark, first, SF0001)
    assert rows(second) == [(i, t) for (i, t), (_, _, c) in zip(rows(first), brute.jaccard(rows(first))) if c == i] and second.columns == docs.columns
    third = stage["substring_dedup"](spark, second, SF0001)
    want = {i: (n, k, h) for i, n, k, h in brute.substring_dedup(rows(second))}
    assert third.columns == docs.columns
    assert {i for i, _ in rows(third)} == {i for i, (n, k, _) in want.items() if k < n or not n}
    assert all(t == dict(rows(second))[i] if not want[i][1] else brute.sha(t) == want[i][2] for i, t in rows(third))
    fourth = stage["decontaminate"](spark, third, SF0001)
    assert rows(fourth) == [(i, t) for (i, t), x in zip(rows(third), brute.decontaminate(rows(third), items)) if not x[5]]
    last = stage["pack"](spark, fourth, SF0001).collect()
    assert brute.Counter(tuple(r)[:5] for r in last) == brute.pieces(rows(fourth), Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json")))
    brute.sequences([(r["sequence_id"], r["offset"], r["length"]) for r in last])


def test_near_duplicates_keep_a_row_of_each_component_whatever_its_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = text(1).replace("w1x0 ", "aa ", 1)  # sorts before every other text
    rows = [(1, text(1)), (5, near), (5, text(2)), (5, text(3)), (5, text(3)), (7, text(4)), (None, text(4)), (None, text(6)), (None, text(6)), (None, text(7)), (8, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    want = [(1, text(1)), (5, text(2)), (5, text(3)), (7, text(4)), (None, text(6)), (None, text(7)), (8, ""), (None, None)]
    assert got.columns == docs.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_duplicates_make_few_rows_of_copies_that_do_not_link(spark, monkeypatch):
    """Variants of one text, any two too different to link, all stay, and pairs of them are no rows."""
    from quarry.llm import jaccard_join

    made = []
    staged = jaccard_join.staged

    def counted(df, *path):
        out = staged(df, *path)
        if "hub" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    rng = random.Random(8)
    changed = [set(rng.sample(range(300), 8)) for _ in range(100)]
    rows = [(i, " ".join(f"x{i}y{k}" if k in at else f"w{k}" for k in range(300))) for i, at in enumerate(changed)]
    docs = spark.createDataFrame([*rows, (200, rows[0][1])], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, corpus_pipeline.near_duplicates(spark, docs, "").collect())) == rows
    assert 0 < sum(made) <= 4 * len(rows)


def test_near_duplicates_filter_texts_before_they_are_joined(spark):
    """The exact join that follows the broadcast filter stays above it, so that other texts aren't shuffled."""
    docs = spark.createDataFrame([(i, f"a b c d e f {i // 2}") for i in range(20)], "doc_id long, text string")
    plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    top = next(i for i, line in enumerate(plan) if "partner_id" in line and ("Join LeftAnti" in line or "Join LeftOuter" in line))
    depth = [line.find("Join") if "Join" in line else len(line) - len(line.lstrip(" :+-")) for line in plan]
    below = [line for line in plan[top + 1 : next((i for i in range(top + 1, len(plan)) if depth[i] <= depth[top]), len(plan))]]
    assert any("Join Inner" in line and "_filter_word" in line for line in below)


def test_pipeline_takes_odd_rows(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(60).withColumn("runs", F.lit("r")).withColumn("n_words", F.lit("n"))
    odd = docs.limit(6).withColumn("text", F.element_at(F.array(*(F.lit(t).cast("string") for t in ODD)), (F.col("doc_id") % len(ODD) + 1).cast("int")))
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF0001)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF0001).count() == 0, name
        docs = kept


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {"pipeline", *(f"op{i}" for i in range(1, 14))}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontaminate", "pack"]

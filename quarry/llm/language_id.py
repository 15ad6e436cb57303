"""Language identification by a linear-chain conditional random field over words.

The labels of the chain are languages, so a text that switches between them is labelled
word by word. A word's features are its affixes and inner n-grams (hashed) and the
lexicons it is in: the `LEXICON` most frequent words of each language, counted over
all training documents. Transitions are learned along with the feature weights, by the
gradient of forward-backward in numpy, from sequences made of stretches of different
documents, so that the chain sees switches.

The fit uses at most `SAMPLE` documents of a language (and at most `EXCERPT` words of
each); scoring reads every word. A chain is at most `CHAIN` words long; a document's
language is that of the largest expected share of its words, which is its score.

Defined results: `und` with score 0 for null texts, texts without a letter, and where
nothing could be learned; repeated rows each have their row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import free_name, read
from quarry.llm.subwords import LETTERS, Distinct, bucket_of, grams, lowered, sample_ids
from quarry.llm.words import Block, as_bytes, blocks

SAMPLE, EXCERPT, LEXICON = 400, 120, 1000
#: Languages learned: the most frequent ones.
LANGUAGES = 200
CHAIN = 128
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
STEPS, RATE, SWITCH = 60, 0.3, 1 / 24
#: Words whose features are summed at once; different words that a task counts before it passes them on.
WORDS, COUNTED = 4096, 100_000

def _features(words: list[bytes], lexicon: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature); the features past BUCKETS are the lexicons of the languages."""
    own, feature = grams(words, SIZES, BUCKETS)
    extra = [(i, BUCKETS + l) for i, w in enumerate(words) for l in lexicon.get(w, ())]
    if extra:
        x = np.array(extra)
        own, feature = np.concatenate([own, x[:, 0]]), np.concatenate([feature, x[:, 1]])
    return own, feature


def _sums(own: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(own, v, n) for v in values.T], 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(emission: np.ndarray, valid: np.ndarray, start: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels (chains, places, labels), and expected transitions summed over all chains.

    emission: (chains, places, labels); valid: flags, set from the left.
    """
    s, t, l = emission.shape
    alpha, beta = np.empty_like(emission), np.zeros_like(emission)
    alpha[:, 0] = start + emission[:, 0]
    for i in range(1, t):
        new = _lse(alpha[:, i - 1, :, None] + transition, 1) + emission[:, i]
        alpha[:, i] = np.where(valid[:, i, None], new, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        new = _lse(transition + (emission[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where(valid[:, i + 1, None], new, 0)
    total = _lse(alpha[:, -1], 1)
    expected = np.exp(alpha + beta - total[:, None, None]) * valid[:, :, None]
    moves = np.zeros((l, l))
    for i in range(t - 1):
        both = alpha[:, i, :, None] + transition + (emission[:, i + 1] + beta[:, i + 1])[:, None, :] - total[:, None, None]
        moves += (np.exp(both) * valid[:, i + 1, None, None]).sum(0)
    return expected, moves


class Model:
    def __init__(self, labels: list[str], lexicon: dict[bytes, list[int]]):
        l = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weight, self.start, self.transition = np.zeros((BUCKETS + l, l)), np.zeros(l), np.zeros((l, l))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        for i in range(0, len(words), WORDS):  # a word has dozens of features, each with a weight for every label
            some = words[i : i + WORDS]
            own, feature = _features(some, self.lexicon)
            out[i : i + WORDS] = _sums(own, self.weight[feature], len(some))
        return out

    def fit(self, excerpts: list[tuple[int, list[bytes]]], seed: int = 7) -> "Model":
        """excerpts: (label, words of a document)."""
        rng, places = np.random.default_rng(seed), 48
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in excerpts for w in ws}))}
        pool = [(l, [vocabulary[w] for w in ws]) for l, ws in excerpts if ws]
        by_label = [[p for p in pool if p[0] == l] for l in range(len(self.labels))]
        by_label = [p for p in by_label if p]
        chains = min(1500, 1 + sum(len(p[1]) for p in pool) // places)
        word, label = np.zeros((chains, places), np.int64), np.zeros((chains, places), np.int64)
        for c in range(chains):
            at = 0
            while at < places:
                own = by_label[rng.integers(len(by_label))]
                l, ws = own[rng.integers(len(own))]
                n = min(places - at, len(ws), int(rng.geometric(SWITCH)))
                begin = rng.integers(len(ws) - n + 1)
                word[c, at : at + n], label[c, at : at + n] = ws[begin : begin + n], l
                at += n
        own, feature = _features(list(vocabulary), self.lexicon)
        valid = np.ones((chains, places), bool)
        k = len(self.labels)
        truth = np.eye(k)[label]
        moved = np.zeros((k, k))
        np.add.at(moved, (label[:, :-1], label[:, 1:]), 1)
        seen = [np.full_like(x, 1e-6) for x in (self.weight, self.start, self.transition)]
        for _ in range(STEPS):
            emission = _sums(own, self.weight[feature], len(vocabulary))[word]
            expected, moves = forward_backward(emission, valid, self.start, self.transition)
            by_word = _sums(word.ravel(), (truth - expected).reshape(-1, k), len(vocabulary))
            slopes = (_sums(feature, by_word[own], BUCKETS + k) / chains, (truth[:, 0] - expected[:, 0]).sum(0) / chains, (moved - moves) / chains)
            for x, g, s in zip((self.weight, self.start, self.transition), slopes, seen):
                g = g - 1e-5 * x
                s += g * g
                x += RATE * g / np.sqrt(s)
        return self

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Expected share of each label among the words of each text; zeros without words."""
        block = Block(lowered(texts), LETTERS)
        k, n = len(self.labels), len(block.hash)
        if not n or not k:
            return np.zeros((len(texts), k))
        distinct = Distinct(block)
        emission = self.emissions(distinct.words)[distinct.place]
        within = np.arange(n) - block.first[block.doc]
        chain = np.cumsum(within % CHAIN == 0) - 1
        place = within % CHAIN
        out = np.zeros((len(texts), k))
        length = np.bincount(chain)
        order = np.argsort(length, kind="stable")  # chains of like length together
        for part in np.array_split(order, max(1, len(order) // 1024)):
            t = int(length[part].max())
            row = np.full(len(length), -1)
            row[part] = np.arange(len(part))
            mine = np.flatnonzero(row[chain] >= 0)
            r, p = row[chain[mine]], place[mine]
            e, valid = np.zeros((len(part), t, k)), np.zeros((len(part), t), bool)
            e[r, p], valid[r, p] = emission[mine], True
            expected, _ = forward_backward(e, valid, self.start, self.transition)
            out += _sums(block.doc[mine], expected[r, p], len(texts))
        return out / np.maximum(np.diff(block.first), 1)[:, None]


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """A model of the rows of `docs` whose text and language are not null."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    labels = sorted(r["lang"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    if not labels:
        return Model([], {})
    index = {l: i for i, l in enumerate(labels)}

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, word, n) of a task's documents, passed on when they become many."""

        def found(seen: dict) -> pa.RecordBatch:
            lang = pa.array([l for l, c in seen.items() for _ in c], pa.string())
            word = pa.array([w.decode(errors="ignore") for c in seen.values() for w in c], pa.string())
            return pa.RecordBatch.from_arrays([lang, word, pa.array([n for c in seen.values() for n in c.values()], pa.int64())], names=["lang", "word", "n"])

        seen: dict[str, Counter] = {}
        for batch, texts in blocks(batches, "text"):
            block = Block(lowered(texts), LETTERS)
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                seen.setdefault(lang, Counter()).update(block.words(i))
            if sum(map(len, seen.values())) > COUNTED:
                yield found(seen)
                seen = {}
        yield found(seen)

    words = rows.select("text", "lang").mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = words.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LEXICON)
    lexicon: dict[bytes, list[int]] = {}
    for r in words.collect():  # LEXICON rows of each language
        if r["lang"] in index:
            lexicon.setdefault(r["word"].encode(), []).append(index[r["lang"]])

    def excerpt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column("text")):
                ws = Block(lowered([text]), LETTERS).words(0)
                step = max(1, len(ws) // EXCERPT)  # three stretches from all over the text
                ws = ws if step == 1 else [w for a in (0, len(ws) // 3, 2 * len(ws) // 3) for w in ws[a : a + EXCERPT // 3]]
                out.append(b" ".join(ws[:EXCERPT]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.string())], names=["lang", "words"])

    picked = sample_ids(rows, "id", "lang", SAMPLE).select("id")
    sample = rows.join(F.broadcast(picked.distinct()), "id").select("lang", "text").mapInArrow(excerpt, "lang string, words string").limit(SAMPLE * len(labels))
    excerpts = sorted((index[r["lang"]], r["words"].encode().split()) for r in sample.collect() if r["lang"] in index)
    return Model(labels, {w: sorted(set(l)) for w, l in lexicon.items()}).fit(excerpts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score and shares (map of language and expected share of the words)."""
    own = [free_name(docs, n) for n in ("lang_pred", "score", "shares")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias(own[0]), F.lit(0.0).alias(own[1]), F.create_map(F.lit(""), F.lit(0.0)).alias(own[2])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value.labels
        for batch, texts in blocks(batches, text_col):
            share = shared.value.shares(texts)
            known = np.array([bool(labels) and any(map(str.isalpha, t.decode())) for t in texts], bool)
            best = share.argmax(1) if labels else np.zeros(len(texts), int)
            pred = [labels[b] if k else "und" for b, k in zip(best, known)]
            score = [min(1.0, float(s[b])) if k else 0.0 for s, b, k in zip(share, best, known)]
            maps = [[(l, float(x)) for l, x in zip(labels, s)] if k else [] for s, k in zip(share, known)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=[*batch.schema.names, *own],
            )

    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", bucket_of("doc_id", 3) == 1)
    model = learn(docs.filter(~F.col("held_out")), "doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "shares")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_language_id": op5_language_id}

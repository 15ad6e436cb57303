"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the average of the embeddings of its character n-grams and of itself, a text
the average of its words; a linear layer and a softmax over the two labels follow. The
embeddings and the layer are trained together in numpy (small batches, a rate for
each weight), so misspellings never seen share the n-grams of what they misspell.
Since all of it is linear up to the softmax, scoring needs one number for each n-gram.

The fit uses at most `SAMPLE` labelled texts of either label, weighted back to the
labels' shares; scoring reads every word of every text.

Defined results: a text without words, and a null text, has the score of an empty
average (the learned bias); without labels of both kinds every score is the share of
label 1, or 0 without labels; repeated rows each have their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import free_name, read
from quarry.llm.subwords import LETTERS, Distinct, bucket_of, grams, lowered, sample_ids
from quarry.llm.words import Block, as_bytes, blocks

SAMPLE = 2000
SIZES = (3, 4, 5, 6, 7)
BUCKETS = 1 << 17
WIDTH, PASSES, BATCH, RATE, DECAY = 4, 8, 64, 0.5, 1e-7
#: Texts of the sample that an n-gram must be in.
RARE = 3


def document_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share) of the averages: each text's shares sum to 1, or to 0 without words."""
    block = Block(lowered(texts), LETTERS)
    if not len(block.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    distinct = Distinct(block)
    own, bucket = grams(distinct.words, SIZES, BUCKETS)
    first = np.searchsorted(own, np.arange(len(distinct.words) + 1))
    of = np.diff(first)
    key, times = np.unique(block.doc * len(distinct.words) + distinct.place, return_counts=True)
    doc, word = key // len(distinct.words), key % len(distinct.words)
    n = np.diff(block.first)
    step = np.arange(of[word].sum()) - np.repeat(np.cumsum(of[word]) - of[word], of[word])
    feature = bucket[np.repeat(first[word], of[word]) + step]
    share = np.repeat(times / n[doc] / of[word], of[word])
    key, place = np.unique(np.repeat(doc, of[word]) * BUCKETS + feature, return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(place, share)


class Model:
    def __init__(self, constant: float | None = None):
        self.constant, self.weight, self.bias = constant, np.zeros(BUCKETS, np.float32), 0.0

    def fit(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray, seed: int = 11) -> "Model":
        """weight: of each text, mean 1."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(texts))
        texts, label, weight = [texts[i] for i in order], label[order], weight[order]
        parts, seen_in = [], np.zeros(BUCKETS, np.int64)
        for i in range(0, len(texts), BATCH):
            d, f, x = document_features(texts[i : i + BATCH])
            seen_in += np.bincount(f, minlength=BUCKETS)
            parts.append((d.astype(np.uint8), f.astype(np.int32), x.astype(np.float32)))  # BATCH texts: the place of one fits a byte
        used = np.flatnonzero(seen_in >= RARE)  # n-grams of a few texts would be learned by heart
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        for k, (d, f, x) in enumerate(parts):
            kept = place[f] >= 0
            parts[k] = d[kept], place[f[kept]], x[kept]
        embedding = rng.uniform(-0.5, 0.5, (WIDTH, len(used))).astype(np.float32)
        layer, bias = rng.uniform(-0.5, 0.5, (WIDTH, 2)), np.zeros(2)
        truth = np.eye(2)[label]
        seen = [np.full_like(x, 1e-12) for x in (embedding, layer, bias)]
        for _ in range(PASSES):
            for k in rng.permutation(len(parts)):
                lo, hi = k * BATCH, min(len(texts), (k + 1) * BATCH)
                d, f, s = parts[k]
                hidden = np.stack([np.bincount(d, e[f] * s, hi - lo) for e in embedding], 1)
                logit = hidden @ layer + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                error = (p / p.sum(1, keepdims=True) - truth[lo:hi]) * weight[lo:hi, None] / (hi - lo)
                back = (error @ layer.T).T.astype(np.float32)
                slope = np.stack([np.bincount(f, b[d] * s, len(used)) for b in back])
                for x, g, t in zip((embedding, layer, bias), (slope, hidden.T @ error, error.sum(0)), seen):
                    g = g + DECAY * x
                    t += g * g
                    x -= RATE * g / np.sqrt(t)
        self.weight[used] = (layer[:, 1] - layer[:, 0]) @ embedding
        self.bias = float(bias[1] - bias[0])
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        block = Block(lowered(texts), LETTERS)
        total = np.zeros(len(texts))
        if len(block.hash):
            distinct = Distinct(block)
            own, bucket = grams(distinct.words, SIZES, BUCKETS)
            word = np.bincount(own, self.weight[bucket], len(distinct.words)) / np.bincount(own, minlength=len(distinct.words))
            total = np.bincount(block.doc, word[distinct.place], len(texts)) / np.maximum(np.diff(block.first), 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, each: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of at most `each` rows of label 0 and of label 1; weights restore the labels' shares."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    # an id with both labels says nothing
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picked = sample_ids(rows, "id", "label", each)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(picked), "id").limit(4 * each)  # bounded even if ids repeat
    sample = sorted((r["id"], r["text"], r["label"]) for r in found.collect())
    label = np.array([l for _, _, l in sample], np.int64)
    have = np.bincount(label, minlength=2)
    weight = np.array([counts.get(l, 0) / max(1, have[l]) for l in label], float)
    return [t.encode() for _, t, _ in sample], label, weight / max(weight.mean(), 1e-9) if len(weight) else weight


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    texts, label, weight = labelled_sample(docs, labels, id_col, text_col, label_col, SAMPLE)
    if len(set(label)) < 2:
        return Model(float(label[0]) if len(label) else 0.0)
    return Model().fit(texts, label, weight)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with a column score (under a free name if taken)."""
    name = free_name(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    labels = read(spark, sf_dir, "labels").filter(bucket_of("doc_id", 5) != 0)
    model = learn(docs.filter("not held_out"), labels, "doc_id", "text", "toxic")
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_toxicity": op6_toxicity}

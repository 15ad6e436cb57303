"""Quality by hashed word n-gram logistic regression, trained with follow the regularised leader.

Words are runs of letters and digits, and runs of other signs; a text is the vector of
its words, pairs of neighbouring words and, as one more word, repeats of a word, hashed into a fixed number of weights, with
the square roots of their shares as values (a vector of length 1). The weights are
learned one text at a time by FTRL-proximal updates, whose first-order penalty keeps
most of them at zero; a score is the logistic of one sparse dot product.

The fit uses at most `SAMPLE` labelled texts of either label, weighted back to the
labels' shares; scoring reads every word of every text.

Defined results: null texts and texts without words have the score of the bias alone;
without labels of both kinds every score is that label, or 0 without labels; repeated
rows each have their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import free_name, read
from quarry.llm.subwords import bucket_of
from quarry.llm.toxicity import labelled_sample
from quarry.llm.words import Block, Runs, U, blocks, byte_table

SAMPLE, PASSES = 2000, 3
BUCKETS = 1 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
THRESHOLD = 0.3

_SIGNS = ~byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value), ordered by text and bucket; the squares of a text's values sum to 1."""
    words, signs = Block(texts, _ALNUM), Block(texts, _SIGNS)
    order = np.argsort(np.concatenate([words.start, signs.start]), kind="stable")
    doc = np.concatenate([words.doc, signs.doc])[order]
    h = np.concatenate([words.hash, signs.hash])[order]
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.arange(len(h) - 1)
    at = at[doc[at] == doc[at + 1]]
    again = at[h[at] == h[at + 1]]
    bucket = (np.concatenate([h, Runs(h).get(at, at + 2), np.full(len(again), 1, U)]) % U(BUCKETS)).astype(np.int64)
    key, times = np.unique(np.concatenate([doc, doc[at], doc[again]]) * BUCKETS + bucket, return_counts=True)
    doc = key // BUCKETS
    return doc, key % BUCKETS, np.sqrt(times / np.bincount(doc, times)[doc])


class Model:
    """Weights by FTRL-proximal; the bias is the last."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        self.weight = np.zeros(BUCKETS + 1, np.float32)

    def _weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.where(i == BUCKETS, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))  # no penalty on the bias
        return -shrunk / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)

    def update(self, i: np.ndarray, x: np.ndarray, label: int, weight: float) -> None:
        w = self._weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -50, 50))) - label) * weight * x
        rate = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - rate * w
        self.n[i] += g * g

    def fit(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray, seed: int = 5) -> "Model":
        rows = []
        for i in range(0, len(texts), 200):
            doc, bucket, value = features(texts[i : i + 200])
            edge = np.searchsorted(doc, np.arange(len(texts[i : i + 200]) + 1))
            rows += [(np.append(bucket[a:b], BUCKETS), np.append(value[a:b], 1.0)) for a, b in zip(edge[:-1], edge[1:])]
        rng = np.random.default_rng(seed)
        for _ in range(PASSES):
            for r in rng.permutation(len(rows)):
                self.update(*rows[r], int(label[r]), float(weight[r]))
        self.weight = self._weights(np.arange(BUCKETS + 1)).astype(np.float32)
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        doc, bucket, value = features(texts)
        total = np.bincount(doc, self.weight[bucket] * value, len(texts)) if len(doc) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.weight[BUCKETS], -500, 500)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    texts, label, weight = labelled_sample(docs, labels, id_col, text_col, label_col, SAMPLE)
    if len(set(label)) < 2:
        return Model(float(label[0]) if len(label) else 0.0)
    model = Model().fit(texts, label, weight)
    model.z = model.n = np.zeros(0)  # only the weights go to the tasks
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with a column score (under a free name if taken)."""
    name = free_name(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(texts))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    labels = read(spark, sf_dir, "labels").filter(bucket_of("doc_id", 5) != 0)
    model = learn(docs.filter("not held_out"), labels, "doc_id", "text", "quality")
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_quality": op7_quality}

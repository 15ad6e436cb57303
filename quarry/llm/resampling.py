"""Target-distribution importance resampling: draw the documents that look like a target corpus.

Every text becomes a bag of hashed n-grams. A bucket's gain is the smoothed log ratio of
its share in the target and in the documents; a document weighs the mean gain of its
features. Gumbel noise from a hash of the id added to the weights and a cut at the
highest scores draw without replacement in proportion to the weights.

Features, inside Arrow tasks, a block of texts at a time: `ascii_lower`,
`split_pattern_regex`, `list_flatten` and `dictionary_encode` give dictionary indices of
the words; shifted by one, two, ... places they form n-grams, whose distinct index pairs
alone are spelt out and hashed by CRC-32. A document's gains are then taken by index and
reduced by its segment.

1. Counts per bucket of both corpora: one row per bucket and task, summed by Spark. What
   the driver sees has at most `buckets` rows, whatever the input.
2. Weights and scores of all documents, from the gains (`buckets` numbers in the task's closure).
3. The drawn documents are ranked by a range split of (score, id) and the number of rows
   in the ranges before: no task orders more than its range.

Defined results: a null, empty or wordless text has no features, weight 0 and a score, but
is never drawn unless `min_words` is 0; a null id scores as the text `2024:`; repeated rows and
ids are drawn each on its own, and of equal scores and ids the one whose text's hash is
smaller comes first. An empty target or an empty table of documents leaves its counts at 0.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged
from quarry.llm.words import blocks, text_key

NGRAMS, BUCKETS, MIN_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Everything but digits, letters after lower-casing A-Z, and what lies beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Features:
    """The features of a list of texts: `bucket` of each occurrence, ordered by text, and the number of each text's features and words."""

    def __init__(self, texts: list[bytes], ngrams: int = NGRAMS, buckets: int = BUCKETS):
        lowered = pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.large_string()))
        lists = pc.split_pattern_regex(lowered, BETWEEN)
        words, doc = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists))
        some = pc.not_equal(words, "")  # a text may begin or end between words
        words, doc = words.filter(some), doc[np.asarray(some)]
        encoded = words.dictionary_encode()
        index, spelt = np.asarray(encoded.indices).astype(np.int64), [w.encode() for w in encoded.dictionary.to_pylist()]
        self.n_words = np.bincount(doc, minlength=len(texts))
        width = max(1, len(spelt))
        buckets_of, docs = [], []
        runs, names = index, spelt
        for n in range(1, ngrams + 1):
            if n > 1:  # the run of n - 1 words at i and the word at i + n - 1
                inside = doc[n - 1 :] == doc[: len(doc) - n + 1] if len(doc) >= n else np.zeros(0, bool)
                at = np.flatnonzero(inside)
                place = np.full(len(doc), -1)
                place[here] = np.arange(len(here))  # noqa: F821 - places of the runs of n - 1 words
                pair = runs[place[at]] * width + index[at + n - 1]
                distinct, runs = np.unique(pair, return_inverse=True)
                names = [names[p // width] + b" " + spelt[p % width] for p in distinct.tolist()]
            else:
                at = np.arange(len(doc))
            here = at
            hashed = np.fromiter((zlib.crc32(x) % buckets for x in names), np.int64, len(names))
            buckets_of.append(hashed.take(runs) if len(at) else np.zeros(0, np.int64))
            docs.append(doc[at])
        all_docs = np.concatenate(docs)
        order = np.argsort(all_docs, kind="stable")
        self.bucket = np.concatenate(buckets_of)[order]
        self.n_features = np.bincount(all_docs, minlength=len(texts))

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Of each text: the sum of its features' gains."""
        total = np.concatenate(([0], np.cumsum(gains.take(self.bucket))))
        end = np.cumsum(self.n_features)
        return total[end] - total[end - self.n_features]


def bucket_counts(texts: DataFrame, text_col: str = "text", ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of the features of all texts, for buckets that have any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for _, block in blocks(batches, "text"):
            seen += np.bincount(Features(block, ngrams, buckets).bucket, minlength=buckets)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[used])], names=["bucket", "n"])

    return texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed shares' ratio) of each bucket."""
    a, b = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log(float(target.get(k, 0) + 1) * a / (float(source.get(k, 0) + 1) * b))) for k in range(buckets)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """floor(1000 * standard Gumbel noise), from 32 bits of a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, key) of every document; key is a hash of the text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            found = Features(texts, ngrams, len(gain))
            weight = found.sums(gain) // np.maximum(found.n_features, 1)
            score = weight + np.fromiter((noise(i, seed) for i in batch.column("id").to_pylist()), np.int64, len(texts))
            columns = [found.n_words, found.n_features, weight, score, text_key(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_words", "n_features", "weight", "score", "key"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long, score long, key long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    ngrams: int = NGRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: id, n_features, weight, score, and the rank (from 1) of the drawn ones, null for the others.

    Of the documents with at least `min_words` words, `percent` in a hundred are drawn.
    """
    of = [{r["bucket"]: r["n"] for r in bucket_counts(t, c, ngrams, buckets).collect()} for t, c in ((docs, text_col), (target, target_col))]
    scored = staged(weights(docs, gains(*of, buckets), id_col, text_col, ngrams, seed))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("key")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scored.filter(F.col("n_words") >= min_words).repartitionByRange(parts, *order)
    ranged = staged(ranged.withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = F.floor(F.lit(percent) * F.lit(sum(r["n"] for r in sizes.collect())) / 100) if percent else F.lit(0)
    ranked = ranged.join(F.broadcast(before), "range").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    names = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(short.select(*names))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = {
    "op11_importance_resampling": r"""
        WITH code AS (
            SELECT list(c ORDER BY i) AS codes FROM (
                SELECT i, list_reduce(list_concat([i], range(8)), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
                FROM (SELECT unnest(range(256)) AS i)
            )
        ), doc_words AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), doc_word AS (
            SELECT row, unnest(words) AS word FROM doc_words
        ), target_word AS (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ), known AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM doc_word UNION SELECT word FROM target_word)
        ), hashed AS (
            SELECT word, xor(4294967295, list_reduce(
                       list_concat([4294967295], list_transform(range(length(h) // 2), lambda i:
                           (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
                       lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM known, code
        ), s AS (
            SELECT bucket, count(*) AS n FROM doc_word JOIN hashed USING (word) GROUP BY bucket
        ), t AS (
            SELECT bucket, count(*) AS n FROM target_word JOIN hashed USING (word) GROUP BY bucket
        ), gain AS (
            SELECT b.bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE)
                   / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
        ), summed AS (
            SELECT row, count(*) AS n, sum(gain) AS total FROM doc_word JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row
        ), weighed AS (
            SELECT doc_id, coalesce(n, 0) AS n_features,
                   CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
                   list_reduce(list_transform(range(8), lambda i: instr('0123456789abcdef', sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[i + 1]) - 1), lambda a, d: a * 16 + d) AS h
            FROM doc_words LEFT JOIN summed USING (row)
        ), scored AS (
            SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM weighed
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER (PARTITION BY n_features >= 20) AS eligible
            FROM scored
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
               CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN CAST(place AS BIGINT) END AS rank
        FROM ranked
    """
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_importance_resampling": op11_importance_resampling}

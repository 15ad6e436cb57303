"""Exact top-k search by inner product, a block of documents at a time.

A vector is a document whose terms are its dimensions. Vectors are put in an order in
which alike ones are neighbours and cut into ranges (shards) of blocks; a block keeps a
forward index (its vectors) and, for each term, the largest and smallest weight. For a
query, the summed term maxima bound every score in the block. Blocks are scored in
falling order of that bound, until it lies below the k-th score found so far.

1. Every query searches the shard it lies in; its k-th score there is a floor that
   the final k-th score cannot fall below.
2. Queries meet the term maxima of the shards, a few hundred of both at a time. A query goes
   on only to shards whose bound reaches its floor.
3. There the queries, in groups of bounded size, meet the shard's blocks with that floor; each
   pair of a shard and a group keeps its k best, and the best of all pairs are the result.

The order is fitted on `PIVOTS` vectors; it decides how much is pruned, never the
result. Weights are whole numbers, so sums in doubles are exact up to 2**53.

Defined results: vectors that are null or hold null or non-finite components take no
part, nor do those with a scaled component beyond a long; shorter vectors count as padded with zeros; rows of one id and one vector are
one candidate, and no row with the query's id is a candidate of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged

K, EVERY, SCALE = 20, 20, 64
PIVOTS = 64
#: Vectors of a block and of a shard, queries of a group.
BLOCK, SHARD, QUERIES_AT_ONCE = 256, 4096, 8192
#: Shards and queries whose bounds are looked at together.
SHARDS_ROUTED, QUERIES_ROUTED = 256, 512
#: Below every score.
NONE = -(2**62)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): whole components as packed longs; only the vectors that take part."""

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist()):
                if i is None or x is None or any(c is None for c in x):
                    continue
                x = np.floor(scale * np.asarray(x, np.float64))
                if (np.abs(x) < 2.0**63).all():  # NaN and the infinities are not
                    ids.append(i)
                    out.append(x.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["id", "v"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
    return chosen.mapInArrow(floor, "id long, v binary").distinct()


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """One row per vector, padded with zeros to the width."""
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), width)
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r) // 8] = np.frombuffer(r, np.int64)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.blocks = [(ids[i : i + BLOCK], vectors[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
        self.high = np.array([v.max(0) for _, v in self.blocks])
        self.low = np.array([v.min(0) for _, v in self.blocks])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, score) of each query's k best that reach its floor."""
        bound = product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        kth = floor.copy()
        best_score = np.full((len(queries), k), NONE)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        alive = np.arange(len(queries))
        for step in range(len(self.blocks)):
            which = order[alive, step]
            open_ = bound[alive, which] >= kth[alive]  # bounds only fall from here on
            alive, which = alive[open_], which[open_]
            if not len(alive):
                break
            for b in np.unique(which):
                q = alive[which == b]
                ids, vectors = self.blocks[b]
                score = product(queries[q], vectors)
                score[query_ids[q][:, None] == ids[None, :]] = NONE
                hit = (score >= kth[q][:, None]).any(1)
                q, score = q[hit], score[hit]
                if not len(q):
                    continue
                scores = np.concatenate([best_score[q], score], 1)
                all_ids = np.concatenate([best_id[q], np.broadcast_to(ids, score.shape)], 1)
                top = np.lexsort((all_ids, -scores), axis=1)[:, :k]
                best_score[q] = np.take_along_axis(scores, top, 1)
                best_id[q] = np.take_along_axis(all_ids, top, 1)
                kth[q] = np.maximum(kth[q], best_score[q, -1])
        found = (best_score > NONE) & (best_score >= floor[:, None])
        place, column = np.nonzero(found)
        return place, best_id[place, column], best_score[place, column]


def _shard(blocks: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, query flags, vectors) of a shard in its order."""
    blocks = blocks.sort_values("number")
    parts = [(np.frombuffer(i, np.int64), np.frombuffer(a, bool), np.frombuffer(v, np.int64).reshape(-1, width)) for i, a, v in zip(blocks["ids"], blocks["asked"], blocks["vectors"])]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _near(pivots: np.ndarray, width: int) -> Callable:
    """Adds the nearest and the second nearest pivot, by which the vectors are ordered."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = matrix(batch.column("v").to_pylist(), width) @ pivots.T
            first = like.argmax(1)
            like[np.arange(len(like)), first] = -np.inf
            columns = [batch.column(c) for c in ("id", "v", "asked")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first.astype(np.int32)), pa.array(like.argmax(1).astype(np.int32))], names=["id", "v", "asked", "p1", "p2"])

    return near


def _cut(width: int) -> Callable:
    """Blocks (number, ids, asked, vectors) of a partition's vectors, in their order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            ids, asked, v = zip(*rows)
            packed = np.array(ids, np.int64).tobytes(), np.array(asked, bool).tobytes(), matrix(v, width).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["number", "ids", "asked", "vectors"])

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("id", "asked", "v")))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, number = held[BLOCK:], number + 1
        if held:
            yield block(held)

    return cut


def _maxima(part: pd.DataFrame, width: int) -> pd.DataFrame:
    """(shard, high, low): a shard's largest and smallest weight of each term."""
    vectors = [np.frombuffer(v, np.int64).reshape(-1, width) for v in part["vectors"]]
    high, low = np.max([v.max(0) for v in vectors], axis=0), np.min([v.min(0) for v in vectors], axis=0)
    return pd.DataFrame({"shard": part["shard"].iloc[:1], "high": [high.tobytes()], "low": [low.tobytes()]})


def shards_and_queries(rows: DataFrame, width: int, shards: int, pivots: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks (shard, number, ids, asked, vectors) of all vectors, and the queries (id, v, floor)."""
    ordered = rows.mapInArrow(_near(pivots, width), "id long, v binary, asked boolean, p1 int, p2 int").repartitionByRange(shards, "p1", "p2", "id").sortWithinPartitions("p1", "p2", "id", "v")
    blocks = staged(ordered.mapInArrow(_cut(width), "number int, ids binary, asked binary, vectors binary").withColumn("shard", F.spark_partition_id()))

    def home(part: pd.DataFrame) -> pd.DataFrame:
        """The queries of a shard, with the k-th score they have in it."""
        ids, asked, all_vectors = _shard(part, width)
        query_ids, queries = ids[asked], all_vectors[asked]
        none = np.full(len(query_ids), NONE)
        place, _, score = Shard(ids, all_vectors).search(query_ids, queries, none, k)
        worst = np.full(len(query_ids), np.iinfo(np.int64).max)
        np.minimum.at(worst, place, score)
        return pd.DataFrame({"id": query_ids, "v": [q.tobytes() for q in queries], "floor": np.where(np.bincount(place, minlength=len(query_ids)) >= k, worst, none)})

    return blocks, staged(blocks.groupBy("shard").applyInPandas(home, "id long, v binary, floor long"))


def routed(blocks: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """(shard, id, v, floor): each query with every shard whose bound reaches its floor.

    The shards are those that the blocks have, however the range split fell.
    """

    def route(_, shards: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if shards.empty or asking.empty:
            return pd.DataFrame({"shard": [], "id": [], "v": [], "floor": []}).astype({"shard": np.int32, "id": np.int64, "v": object, "floor": np.int64})
        high, low, q = (matrix(list(x), width) for x in (shards["high"], shards["low"], asking["v"]))
        floor = asking["floor"].to_numpy(np.int64)
        a, b = np.nonzero(product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low) >= floor[:, None])
        return pd.DataFrame({"shard": shards["shard"].to_numpy()[b], "id": asking["id"].to_numpy()[a], "v": asking["v"].to_numpy()[a], "floor": floor[a]})

    maxima = blocks.groupBy("shard").applyInPandas(lambda part: _maxima(part, width), "shard int, high binary, low binary")
    maxima = staged(maxima.withColumn("some", F.floor(F.col("shard") / SHARDS_ROUTED).cast("int")))
    somes = [r["some"] for r in maxima.select("some").distinct().collect()]  # one for SHARDS_ROUTED shards
    groups = max(1, math.ceil(queries.count() / QUERIES_ROUTED))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")
    every_some = F.explode(F.array(*[F.lit(x) for x in somes]) if somes else F.array().cast("array<int>")).alias("some")
    asking = queries.withColumn("grp", F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int"))
    met = maxima.select("*", every_group).groupBy("some", "grp").cogroup(asking.select("*", every_some).groupBy("some", "grp"))
    return met.applyInPandas(route, "shard int, id long, v binary, floor long")


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Callable[[Column], Column], k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query; is_query takes the id column."""
    rows = staged(quantised(vectors, id_col, vector_col, scale).withColumn("asked", F.coalesce(is_query(F.col("id")), F.lit(False))))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("v")), F.lit(8)).alias("bytes"), F.coalesce(F.sum(F.col("asked").cast("int")), F.lit(0)).alias("queries")).first()
    width, shards, groups = max(1, size["bytes"] // 8), max(1, math.ceil(size["n"] / SHARD)), max(1, math.ceil(size["queries"] / QUERIES_AT_ONCE))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).collect()]
    pivots = matrix(sample, width).astype(np.float64) if sample else np.zeros((1, width))
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
    blocks, queries = shards_and_queries(rows, width, shards, pivots, k)
    asking = staged(routed(blocks, queries, width).withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")))

    def meet(_, part: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """A shard's k best for each query of a group."""
        if part.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        ids, _, own = _shard(part, width)
        query_ids = asking["id"].to_numpy(np.int64)
        place, found, score = Shard(ids, own).search(query_ids, matrix(list(asking["v"]), width), asking["floor"].to_numpy(np.int64), k)
        return pd.DataFrame({"query_id": query_ids[place], "vec_id": found, "score": score})

    wanted = asking.select(F.col("shard").alias("to_shard"), F.col("grp").alias("to_grp")).distinct()
    sent = blocks.join(wanted, F.col("shard") == F.col("to_shard")).select("number", "ids", "asked", "vectors", F.col("to_shard").alias("shard"), F.col("to_grp").alias("grp"))
    met = sent.groupBy("shard", "grp").cogroup(asking.groupBy("shard", "grp"))
    best = met.applyInPandas(meet, "query_id long, vec_id long, score long")
    # repeated queries (one id, several vectors) keep the best of a candidate
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % EVERY == 0)


SQL = {
    "op4_topk_search": """
        WITH w AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM w q JOIN w c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 20
    """
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_topk_search": op4_topk_search}

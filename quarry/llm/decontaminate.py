"""Benchmark decontamination: broadcast n-grams of test items, scan training windows.

The items' windows of n words are a table that Spark makes. Their 64-bit hashes, sorted, are
broadcast, and nothing else of them: about `max_windows` of 8 bytes at a time. A benchmark with more
is dealt into groups by hash, and each group is a scan of its own, written before
the next, so a task has one Python worker and one group, however large the benchmark is.

A window of a text whose hash is in the set goes on with its words, as a narrow row under 128 bits
of its text, and is verified by a join of the words with the table of windows. Copies of a text are one. What
is found comes back to the documents by a broadcast filter of the hit texts' keys (8 MB at most):
rows without a hit never move, the others meet their hits in an exact join. Hit words become spans,
which can be cut, or the document dropped.

Defined results: a null text or one without words has no hits; a null item or one
without words has no windows; repeated rows and ids are scanned each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import free_name, read, staged
from quarry.llm.words import ALNUM, Block, Runs, U, blocks, signed
from quarry.operators import prefilter

N = 10
MAX_WINDOWS = 1_000_000
#: Parts that a window's hits are dealt over when they are verified.
SALTS = 16
_BITS = 22
# Fixed value: a word, A-Z or a-z, digits and all beyond ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def windows(items: DataFrame, item_id: str, text_col: str, n: int = N) -> DataFrame:
    """(item, length, hash, gram), distinct: the windows of the items and their words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            block = Block(texts, ALNUM, lower=True)
            runs, found = Runs(block.hash), []
            for item, first, last in zip(batch.column("item").to_pylist(), block.first[:-1], block.first[1:]):
                size = min(n, int(last - first))
                at = np.arange(first, last - size + 1) if size else np.zeros(0, int)
                h = signed(runs.get(at, at + size)).tolist()
                words = [w.decode(errors="replace") for w in map(block.word, range(first, last))] if size else []
                found += {(item, size, x, " ".join(words[i : i + size])) for i, x in enumerate(h)}
            yield _batch(found, (pa.string(), pa.int32(), pa.int64(), pa.string()), ("item", "length", "hash", "gram"))

    chosen = items.select(F.col(item_id).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    return chosen.mapInArrow(cut, "item string, length int, hash long, gram string").distinct()


def _batch(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


class Hashes:
    """The hashes of a group of windows: by their length in words, sorted, with flags of the leading bits."""

    def __init__(self, length: np.ndarray, hashes: np.ndarray):
        self.by_size = {}
        for size in np.unique(length):
            keys = np.sort(hashes[length == size].view(U))
            flags = np.zeros(1 << _BITS, bool)
            flags[(keys >> U(64 - _BITS)).astype(np.int64)] = True
            self.by_size[int(size)] = (keys, flags)

    def near(self, block: Block) -> Iterator[tuple[int, int, int, str]]:
        """(document of the block, first word, number of words, words) of every window whose hash is here."""
        runs = Runs(block.hash)
        for size, (keys, flags) in self.by_size.items():
            at = np.arange(max(0, len(block.hash) - size + 1))
            at = at[block.doc[at] == block.doc[at + size - 1]] if len(at) else at
            h = runs.get(at, at + size)
            maybe = np.flatnonzero(flags[(h >> U(64 - _BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            for i in at[maybe[keys[place] == h[maybe]]].tolist():
                gram = b" ".join(map(block.word, range(i, i + size))).decode(errors="replace")
                yield int(block.doc[i]), int(i - block.first[block.doc[i]]), size, gram


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits of a text; two seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def hits_of_texts(texts: DataFrame, items: DataFrame, item_id: str, item_text: str, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(key, key2, hits), staged: of every different text with a hit, from rows (key, key2, text)."""
    spark = texts.sparkSession
    known = staged(windows(items, item_id, item_text, n))
    total = known.select(F.count_distinct("length", "hash").alias("n")).first()["n"]
    groups = max(1, math.ceil(total / max_windows))
    found = None
    for g in range(groups):
        group = known.filter(F.pmod(F.xxhash64("hash"), F.lit(groups)) == g).select("length", "hash").distinct().toArrow()
        shared = spark.sparkContext.broadcast(Hashes(group["length"].to_numpy(), group["hash"].to_numpy()))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches, "text"):
                key, key2 = batch.column("key").to_pylist(), batch.column("key2").to_pylist()
                rows = {(key[d], key2[d], *w) for d, *w in shared.value.near(Block(texts, ALNUM, lower=True))}
                yield _batch(list(rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()), ("key", "key2", "start", "length", "gram"))

        part = staged(texts.select("key", "key2", "text").mapInArrow(find, "key long, key2 long, start int, length int, gram string").distinct())
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    # only windows of the very same words count; a window that very many texts hold is a salted key
    lists = known.join(found.select("gram").distinct(), "gram").groupBy("gram").agg(F.sort_array(F.collect_list("item")).alias("items"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = found.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(lists, ["gram", "salt"])
    return staged(hits.groupBy("key", "key2").agg(F.sort_array(F.collect_list(F.struct("start", "length", "items"))).alias("hits")))


def scan(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """`docs` with column `hits`, an array of (start, length, items) in words of the normalised text, and `n_words`.

    The columns of `docs` must have other names than these two.
    """
    text = F.col(text_col)
    a, b = (free_name(docs, name) for name in ("text_key", "text_key2"))
    keyed = docs.withColumns(dict(zip((a, b), _text_key(text))))
    hits = hits_of_texts(keyed.select(F.col(a).alias("key"), F.col(b).alias("key2"), text.alias("text")), items, item_id, item_text, n, max_windows)
    known = hits.select(F.col("key").alias(f"{a}_of"), F.col("key2").alias(f"{b}_of"), "hits")
    kind = known.schema["hits"].dataType
    # rows whose text has no hit are told apart in their scan; only the others meet their hits
    far = prefilter.cannot_match(keyed, a, known, f"{a}_of").withColumn("hits", F.lit(None).cast(kind))
    near = prefilter.may_match(keyed, a, known, f"{a}_of").join(known, (F.col(a) == F.col(f"{a}_of")) & (F.col(b) == F.col(f"{b}_of")), "left")
    out = far.select(*docs.columns, "hits").unionByName(near.select(*docs.columns, "hits"))
    n_words = F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))
    return out.select(*docs.columns, F.coalesce("hits", F.array().cast(kind)).alias("hits"), n_words.alias("n_words"))


def merged(hits: list[dict]) -> list[tuple[int, int]]:
    """Disjoint spans (first word, word after the last) of all hits."""
    out: list[list[int]] = []
    for start, end in sorted((h["start"], h["start"] + h["length"]) for h in hits):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, remove: str = "documents") -> DataFrame:
    """`docs` without what the items also hold.

    remove="documents": documents with a hit go. remove="spans": hit words are cut
    out of the text, from the first word's first to the last word's last character.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    rest = [c for c in docs.columns if c != text_col]  # as one column, whatever their names
    packed = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"))
    restored = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    found = scan(packed, items, "text", item_id, item_text, n)
    if remove == "documents":
        return found.filter(F.size("hits") == 0).select(*restored)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            block = Block(texts, ALNUM, lower=True)
            out = batch.column("text").to_pylist()
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                parts, at, base = [], 0, sum(len(t) + 1 for t in texts[:i]) if hits else 0
                for a, b in merged(hits or ()):
                    lo, hi = block.start[block.first[i] + a] - base, block.end[block.first[i] + b - 1] - base
                    parts.append(texts[i][at:lo])
                    at = hi
                if hits:
                    out[i] = b"".join([*parts, texts[i][at:]]).decode()
            columns = [pa.array(out, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return found.mapInArrow(cut, found.schema).select(*restored)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, read(spark, sf_dir, "benchmark"), "text", "item_id", "text").drop("text")
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.select(
        "doc_id",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_decontaminate": op3_decontaminate}

SQL = {
    "op3_decontaminate": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
            FROM documents
        ), item AS (
            SELECT item, words, least(10, len(words)) AS n
            FROM (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
            WHERE len(words) > 0 AND item IS NOT NULL
        ), item_window AS (
            SELECT DISTINCT item, n, array_to_string(words[i:i + n - 1], ' ') AS gram
            FROM (SELECT item, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM item)
        ), place AS (
            SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i
            FROM doc JOIN (SELECT DISTINCT n FROM item) AS size ON len(words) >= n
        ), hit AS (
            SELECT row, i, n, item FROM (SELECT row, i, n, array_to_string(words[i:i + n - 1], ' ') AS gram FROM place) JOIN item_window USING (n, gram)
        ), covered AS (
            SELECT row, count(DISTINCT i) AS n FROM (SELECT row, unnest(range(i, i + n)) AS i FROM hit) GROUP BY row
        ), items AS (
            SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
               sha256(coalesce(items.ids, '')) AS items_sha256, items.n IS NOT NULL AS contaminated
        FROM doc LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
    """
}

"""Substring dedup: seed and extend from winnowed anchors, remove repeats over a length.

Removes every word of a document that lies in a window of `length` words which
also starts in a document with a smaller id.

1. Seeds. Of the hashes of all runs of `seed` words, every window keeps the
   rightmost smallest: its anchor. The choice depends on the window's words alone,
   so equal windows of any two documents have the same anchor at the same place.
   The windows of one anchor occurrence are consecutive; together with the words
   they span they are one row: (anchor, hash of the span, document, place).
2. Join on anchors. Spans are reduced to the smallest id that holds them, so an
   anchor shared by thousands of copies becomes one row for each different span;
   anchors of a single document drop out.
3. Extend both ways. A document whose whole span is held by a smaller id has all
   its windows matched, to the left and the right of the anchor. Where the spans
   around an anchor differ, the first holder of each span is matched window by
   window: a window reaches as far left and right as some smaller id agrees.
4. Matched windows of a document are united into maximal repeats, and their words cut.

Nothing pairs the members of a group: work grows with the number of windows. Spans
and windows are compared by 128 bits of hashes over their words.

Defined results: null and empty texts have no words; a row with a null id is kept
as it is and is no earlier copy for others; equal ids don't match each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged
from quarry.llm.words import Block, Runs, as_bytes, blocks, signed, text_key

LENGTH = 50
SEED = 20


def anchors(block: Block, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place, first window and number of windows of every run of windows with one anchor."""
    total = len(block.hash)
    if total < length:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(total - seed + 1)
    low = Runs(block.hash).get(at, at + seed)
    place = at
    width, span = 1, length - seed + 1

    def smaller(shift: int) -> None:
        nonlocal low, place
        left, right = low[:-shift], low[shift:]
        take = right <= left  # of equal ones the rightmost
        low, place = np.where(take, right, left), np.where(take, place[shift:], place[:-shift])

    while 2 * width <= span:
        smaller(width)
        width *= 2
    if width < span:
        smaller(span - width)
    window = np.arange(total - length + 1)
    whole = block.doc[window] == block.doc[window + length - 1]
    window, place = window[whole], place[whole]
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    return place[first], window[first], np.diff(first, append=len(window))


def _find_runs(id_col: str, text_col: str, length: int, seed: int) -> Callable:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            block = Block(texts)
            place, window, n = anchors(block, length, seed)
            end = window + n - 1 + length
            doc = block.doc[window]
            ids = batch.column(id_col).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(Runs(block.hash).get(place, place + seed))),
                    pa.array(signed(Runs(block.hash, second=True).get(window, end))),
                    pa.array(ids[doc].astype(np.int64)),
                    pa.array(text_key(texts)[doc]),
                    pa.array((window - block.first[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                names=["anchor", "span", "doc", "key", "start", "n"],
            )

    return find


def _find_windows(text_col: str, length: int) -> Callable:
    """Rows (h1, h2, doc, key, start) for the windows of the runs in column `runs`."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            block = Block(texts)
            runs = batch.column("runs")
            doc = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
            flat = runs.flatten()
            start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, own = np.repeat(doc, n), np.repeat(start, n) + step
            window = block.first[doc] + own
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(Runs(block.hash).get(window, window + length))),
                    pa.array(signed(Runs(block.hash, second=True).get(window, window + length))),
                    batch.column("doc").take(pa.array(doc)),
                    batch.column("key").take(pa.array(doc)),
                    pa.array(own.astype(np.int32)),
                ],
                names=["h1", "h2", "doc", "key", "start"],
            )

    return find


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) of rows that can match, under names of our own."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and text is not null")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc, key, runs): for each document with repeats, the matched runs of windows (start, n).

    key is the hash of its text, see `text_key`.
    """
    source = keyed(docs, id_col, text_col)
    runs = staged(source.mapInArrow(_find_runs("doc", "text", length, seed), "anchor long, span long, doc long, key long, start int, n int"))
    spans = runs.groupBy("anchor", "span").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    shared = spans.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("owner").alias("lo"), F.max("last").alias("hi")).filter("lo < hi").select("anchor", "kinds")
    spans = staged(spans.join(shared, "anchor").filter("kinds > 1 or owner < last").select("anchor", "span", "owner", "kinds"))
    marks = runs.join(spans, ["anchor", "span"]).filter("doc > owner or kinds > 1")
    marks = staged(
        marks.groupBy("doc", "key").agg(
            F.collect_set(F.when(F.col("doc") > F.col("owner"), F.struct("start", "n"))).alias("matched"),
            F.collect_set(F.when(F.col("doc") == F.col("owner"), F.struct("start", "n"))).alias("open"),
        )
    )
    asked = source.mapInArrow(_with_key, "doc long, key long, text string").join(marks.filter(F.size("open") > 0).select("doc", "key", F.col("open").alias("runs")), ["doc", "key"])
    windows = staged(asked.mapInArrow(_find_windows("text", length), "h1 long, h2 long, doc long, key long, start int"))
    owners = windows.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last").select("h1", "h2", "owner")
    extended = windows.join(owners, ["h1", "h2"]).filter("doc > owner").groupBy("doc", "key").agg(F.collect_list(F.struct("start", F.lit(1).alias("n"))).alias("runs"))
    whole = marks.filter(F.size("matched") > 0).select("doc", "key", F.col("matched").alias("runs"))
    return whole.unionByName(extended).groupBy("doc", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(text_key(as_bytes(batch.column("text")))), batch.column("text")], names=["doc", "key", "text"])


def _covered(runs: list[dict] | None, n_words: int, length: int) -> np.ndarray:
    """Flag for each word: it lies in a matched window."""
    change = np.zeros(n_words + 1, np.int32)
    for r in runs or ():
        change[r["start"]] += 1
        change[r["start"] + r["n"] - 1 + length] -= 1
    return np.cumsum(change[:-1]) > 0


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """`docs` and the columns kept_text, n_words, n_removed, removed.

    kept_text: the words that stay, joined by one space; removed: the repeats as
    maximal ranges (start, end) of words. An input column of such a name gives way.
    """
    own = ["kept_text", "n_words", "n_removed", "removed"]
    rest = [c for c in docs.columns if c.lower() not in own and c != text_col]
    found = repeats(docs, id_col, text_col, length, seed)
    row = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.struct(*rest).alias("row"))
    row = row.mapInArrow(_row_key, "doc long, key long, text string, row " + row.schema["row"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            kept, total, removed = [], [], []
            for text, runs in zip(texts, batch.column("runs").to_pylist()):
                words = text.split()  # bytes: exactly the ASCII white space
                gone = _covered(runs, len(words), length)
                edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                ranges = list(zip(edge[0::2], edge[1::2]))
                for a, b in reversed(ranges):
                    del words[a:b]
                kept.append(b" ".join(words))
                total.append(len(gone))
                removed.append([{"start": a, "end": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("text"),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array(total, pa.int64()),
                    pa.array([sum(r["end"] - r["start"] for r in x) for x in removed], pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["row", "text", *own],
            )

    schema = f"row {row.schema['row'].dataType.simpleString()}, text string, kept_text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>"
    joined = row.join(found, ["doc", "key"], "left").select("row", "text", "runs")
    out = joined.mapInArrow(cut, schema)
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in own]
    return out.select(*columns, *own)


def _row_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(text_key(as_bytes(batch.column("text")))), batch.column("text"), batch.column("row")], names=["doc", "key", "text", "row"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": op1_substring_dedup}

SQL = {
    "op1_substring_dedup": r"""
        WITH doc AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
        ), place AS (
            SELECT row, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM doc WHERE len(words) >= 50
        ), windows AS (
            SELECT row, doc_id, i, array_to_string(words[i:i + 49], ' ') AS passage FROM place
        ), repeated AS (
            SELECT row, i FROM (SELECT row, doc_id, i, min(doc_id) OVER (PARTITION BY passage) AS holder FROM windows) WHERE holder < doc_id
        ), removed AS (
            SELECT DISTINCT row, unnest(range(i, i + 50)) AS i FROM repeated
        ), word AS (
            SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM doc
        ), kept AS (
            SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN removed USING (row, i) GROUP BY row
        ), n AS (
            SELECT row, count(*) AS n FROM removed GROUP BY row
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM doc LEFT JOIN kept USING (row) LEFT JOIN n USING (row)
    """
}

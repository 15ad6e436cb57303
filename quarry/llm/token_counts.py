"""Token counts: pieces once per distinct pre-token, joined to per-document frequencies.

1. Every task counts the pre-tokens of its documents; the counts are summed, and the
   pieces of each distinct pre-token are counted once, with the tokenizer's own model.
2. A second scan has each document's pre-token frequencies. The most frequent
   pre-tokens (at most `HEAD`) are broadcast, so their sums are made in the scan; the
   others are joined on the pre-token and summed by document.

Ids are never made. Text between spaces is cut into pre-tokens by the tokenizer
itself, or like it where it is only Latin letters and ASCII signs.

Defined results: null and empty texts have no bytes and no tokens; repeated rows each
have their row.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged
from quarry.llm.packing import byte_alphabet, tokenizer_path
from quarry.llm.words import blocks, text_key

LIMIT = 1024
HEAD = 150_000
#: Distinct stretches that a worker remembers, and that a task counts before it passes them on.
CACHE, FLUSH = 400_000, 300_000


#: A space before white space or the end of the text.
_LOOSE = re.compile(r" (?:\s|\Z)")
_PLAIN = re.compile(r"( ?)([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")


class PreTokens:
    """Pre-tokens of a byte-level tokenizer, by remembered stretches of text.

    A space before a character that is no white space always begins a pre-token, so
    texts are cut there. Special strings of the tokenizer are one token each and are
    cut out first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if self.tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError(f"{path}: a tokenizer without normalizer and with plain special strings is needed")
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) or "(?!)")
        self.alphabet = byte_alphabet()
        probe = ["the", " word", " \u00e9t\u00e9,", "a&&&", " ...", " \u00f1|"]
        self.plain = True
        self.plain = all(self.cut(p) == self._by_library(p) for p in probe)

    def _by_library(self, stretch: str) -> tuple[str, ...]:
        return tuple(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(stretch))

    def cut(self, stretch: str) -> tuple[str, ...]:
        """The pre-tokens of a stretch; Latin letters and ASCII signs after them are cut here, anything else by the library."""
        m = _PLAIN.fullmatch(stretch) if self.plain else None
        if m is None or not stretch or max(stretch) >= "\u0250":
            return self._by_library(stretch)
        space, letters, signs = m.groups()
        if letters and not letters.isalpha():
            return self._by_library(stretch)
        parts = (space + letters, signs) if letters and signs else (stretch,)
        return tuple(p.encode().decode("latin-1").translate(self.alphabet) for p in parts)

    def pieces(self, pre_token: str) -> int:
        return len(self.tokenizer.model.tokenize(pre_token))

    def stretches(self, text: str) -> tuple[list[str], list[str], int]:
        """Stretches that pre-tokenize independently: those that follow a space, without
        it, and the others; and the number of special strings."""
        parts = self.special.split(text) if "<" in text else [text]
        spaced, others = [], []
        for part in parts:
            if _LOOSE.search(part):
                others += re.split(r"(?= \S)", part)
            elif part:
                first, *rest = part.split(" ")
                spaced += rest
                others.append(first)
        return spaced, [o for o in others if o], len(parts) - 1


_WORKERS: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    if path not in _WORKERS:
        _WORKERS[path] = PreTokens(path)
    return _WORKERS[path]


def _count(path: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spaced, others = pre_tokens(path), Counter(), Counter()

        def rows() -> pa.RecordBatch:
            out: Counter = Counter()
            for seen, before in ((spaced, " "), (others, "")):
                for stretch, n in seen.items():
                    for p in own.cut(before + stretch):
                        out[p] += n
                seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], names=["pre_token", "n"])

        for _, texts in blocks(batches, "text"):
            for t in texts:
                after, rest, _ = own.stretches(t.decode())
                spaced.update(after)
                others.update(rest)
            if len(spaced) + len(others) > FLUSH:
                yield rows()
        yield rows()

    return count


def vocabulary(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """(pre_token, n, pieces) of every distinct pre-token of the texts."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pre_tokens(path)
        for batch in batches:
            counts = [own.pieces(p) for p in batch.column("pre_token").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pre_token"), batch.column("n"), pa.array(counts, pa.int64())], names=["pre_token", "n", "pieces"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(path), "pre_token string, n long")
    return counts.groupBy("pre_token").agg(F.sum("n").alias("n")).mapInArrow(pieces, "pre_token string, n long, pieces long")


def token_counts(docs: DataFrame, id_col: str, text_col: str, path: str, head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    vocab = staged(vocabulary(docs, text_col, path))
    # as many powers of two of the frequency, from above, as hold at most `head` pre-tokens
    sizes = vocab.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("n")).collect()
    least, taken = 64, 0
    for r in sorted(sizes, key=lambda r: -r["power"]):
        taken += r["n"]
        if taken > head:
            break
        least = r["power"]
    top = vocab.filter(F.floor(F.log2("n")) >= least).select("pre_token", "pieces").toArrow()
    frequent = docs.sparkSession.sparkContext.broadcast(dict(zip(top["pre_token"].to_pylist(), top["pieces"].to_pylist())))
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the document with the sum of its frequent pre-tokens, and one for each other pre-token."""
        own, pieces, after, plain = pre_tokens(path), frequent.value, {}, {}

        def resolved(before: str, stretch: str, sums: dict) -> tuple[int, tuple[str, ...]]:
            if len(sums) >= CACHE:
                sums.clear()
            cut = own.cut(before + stretch)
            sums[stretch] = found = sum(pieces.get(p, 0) for p in cut), tuple(p for p in cut if p not in pieces)
            return found

        for batch, texts in blocks(batches, "text"):
            row, token, n, known = [], [], [], []
            for i, t in enumerate(texts):
                spaced, others, total = own.stretches(t.decode())
                rest: Counter = Counter()
                for seen, before, sums in ((Counter(spaced), " ", after), (Counter(others), "", plain)):
                    for stretch, times in seen.items():
                        found = sums.get(stretch) or resolved(before, stretch, sums)
                        total += found[0] * times
                        for p in found[1]:
                            rest[p] += times
                row += [i] * (len(rest) + 1)
                token += [f"\n{i}", *rest]  # no pre-token holds a line break, so the document's own row joins nothing
                n += [0, *rest.values()]
                known += [total, *[0] * len(rest)]
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(row),
                    pa.array(text_key(texts)).take(row),
                    pa.array([len(t) for t in texts], pa.int64()).take(row),
                    pa.array(token, pa.string()),
                    pa.array(n, pa.int64()),
                    pa.array(known, pa.int64()),
                ],
                names=["id", "key", "n_bytes", "pre_token", "n", "known"],
            )

    rows = chosen.mapInArrow(frequencies, f"id {chosen.schema['id'].dataType.simpleString()}, key long, n_bytes long, pre_token string, n long, known long")
    joined = rows.join(vocab.select("pre_token", "pieces"), "pre_token", "left")
    sums = joined.groupBy("id", "key", "n_bytes").agg(
        F.sum(F.col("known") + F.col("n") * F.coalesce("pieces", F.lit(0))).alias("all"),
        F.sum((F.col("n") == 0).cast("long")).alias("rows"),
    )
    # equal rows were summed together
    return sums.select(F.col("id").alias(id_col), "n_bytes", F.expr("all div rows").alias("n_tokens"), F.explode(F.expr("sequence(1, rows)")).alias("row")).drop("row")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_token_counts": op8_token_counts}

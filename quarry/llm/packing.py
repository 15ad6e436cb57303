"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are encoded, cut where longer than a sequence, and every piece gets its
rank among the pieces of its length (one sort of small rows; a length that a third
of all pieces has is dealt over many tasks).

Matching is bulk-synchronous. Lengths and gaps are whole numbers up to the limit, so
range-sorted pieces are at most `limit` runs (length, count), and range-sorted gaps
are runs (gap, first sequence, count): only these counts reach the driver, however
many documents there are. A round takes all pieces of a length, longest first, and
sweeps the gaps upwards from the first that is large enough; pieces that want the
same gaps get them by rank, the gaps become smaller, and the round repeats for what
is left, opening sequences when no gap fits. The tasks then look up every piece's
place by (length, rank). This is the packing of best-fit decreasing.

Defined results: null and empty texts are one piece of the closing id alone; repeated
rows are packed each on its own.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.frames import read, staged
from quarry.llm.words import blocks

LIMIT = 4096
END_ID = 1
#: Encoded words that a Python worker keeps; more are forgotten and encoded again.
CACHE_WORDS = 400_000


#: A small ASCII letter before one of these signs always ends a pre-token.
_BEFORE, _AFTER = np.zeros(256, bool), np.zeros(256, bool)
_BEFORE[ord("a") : ord("z") + 1] = True
_AFTER[list(b".,!?;:#$%&*|")] = True


def _parted(text: bytes) -> bytes:
    """The text with a space between small letters and signs, so that fewer words are distinct."""
    buf = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_BEFORE[buf[:-1]] & _AFTER[buf[1:]])
    out = np.full(len(buf) + len(at), 0x20, np.uint8)
    kept = np.ones(len(out), bool)
    kept[at + 1 + np.arange(len(at))] = False
    out[kept] = buf
    return out.tobytes()


def byte_alphabet() -> dict[int, str]:
    """The character that byte-level tokenizers show for each byte: printable Latin-1 as it is, the others from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of a tokenizer that never joins text across white space, by remembered words.

    Such a tokenizer's ids of a text are those of its words in order. Where it lowers
    capitals and parts letters from signs, so do we first; a word of Latin letters is
    then one pre-token, and goes straight to the tokenizer's model. All this is tried
    out when the tokenizer is loaded. A text with one of its special strings is encoded
    as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        one = [self._ids(x) for x in ("Ab c\t\nD", "Ab", "c", "D")]
        if one[0] != one[1] + one[2] + one[3]:
            raise ValueError(f"{path} joins text across white space")
        self.lower = self._ids("AZ\u00c9") == self._ids("az\u00e9")
        self.parted = all(self._ids("ab" + chr(c) * 2) == self._ids("ab " + chr(c) * 2) for c in np.flatnonzero(_AFTER))
        self.alphabet = byte_alphabet()
        probe = ["the", "tokenization", "\u00e9t\u00e9r\u00e8\u00df", "\u00f1\u00fc\u00e4\u0101"]
        self.direct = all(self._by_model(w) == self._ids(w) for w in probe)
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _by_model(self, word: str) -> bytes:
        shown = word.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # below U+0250 letters are composed, and lowered alike everywhere but the dotted I
        if self.direct and self.lower and word.isalpha() and max(word) < "\u0250" and "\u0130" not in word:
            return self._by_model(word.lower())
        return self._ids(word)

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        low = text.lower()
        if any(s.lower() in low for s in self.special):
            return self._ids(text.decode())
        if self.lower:
            text = low
        words = (_parted(text) if self.parted else text).split()
        missing = set(words).difference(self.known)
        if missing and len(self.known) + len(missing) > CACHE_WORDS:
            self.known, missing = {}, set(words)
        for w in missing:
            self.known[w] = self._word(w.decode())
        return b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces."""
    closing = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch, texts in blocks(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts):
                ids = coder.encode(text) + closing
                for p, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, f"id {chosen.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], limit: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset): pieces of a length from that rank on
    go to consecutive sequences from that one on, at the offset; sorted by length and rank."""
    runs: list[tuple[int, int, int, int]] = []
    gaps: list[int] = []  # sorted
    free: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, count)
    sequences = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in free:
                insort(gaps, gap)
            free.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # as many as fit into each new sequence, the rest into one more
                for opened, each in ((left // (limit // length), limit // length), (1, left % (limit // length))):
                    if opened and each:
                        runs += [(length, rank + i * opened, sequences, i * length) for i in range(each)]
                        leave(limit - each * length, sequences, opened)
                        rank += opened * each
                        sequences += opened
                break
            gap = gaps[at]
            first, n = free[gap].pop()
            take = min(n, left)
            if take < n:
                free[gap].append((first + take, n - take))
            if not free[gap]:
                del free[gap]
                gaps.pop(at)
            leave(gap - length, first, take)
            runs.append((length, rank, first, limit - gap))
            rank += take
            left -= take
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def ranked(parts: DataFrame) -> DataFrame:
    """`parts` with rank: the place from 0 among pieces of the same length.

    A length is dealt over slots, each numbered by itself, so that a length of very
    many pieces is not one group; the slots' counts give the numbers where they begin.
    """
    slots = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.withColumn("slot", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    counts = parts.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "slot").orderBy("id", "piece", "ids_crc32")
    return parts.withColumn("within", F.row_number().over(within) - 1).join(counts, ["length", "slot"]).withColumn("rank", F.col("before") + F.col("within")).drop("slot", "before", "within")


def pack(docs: DataFrame, id_col: str, text_col: str, path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = staged(pieces(docs, id_col, text_col, path, limit, end_id))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    runs = docs.sparkSession.sparkContext.broadcast(best_fit(counts, limit))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, sequence, offset = runs.value.T
        key = (length << 44) + rank
        for batch in batches:
            r = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + r, "right") - 1
            columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])],
                names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"],
            )

    schema = f"id {parts.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    rows = ranked(parts).select("id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(place, schema + ", sequence_id long, offset long").withColumnRenamed("id", id_col)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_best_fit_packing": op2_best_fit_packing}

"""Character n-grams of words, hashed, for many words at once; and samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.words import Block, U, byte_table, mix

#: Runs of ASCII letters and of bytes beyond ASCII.
LETTERS = byte_table((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def lowered(texts: list[bytes]) -> list[bytes]:
    return [t.decode().lower().encode() for t in texts]


def grams(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all byte n-grams of `<word>`, and of the whole, ordered by word.

    With the marks, an n-gram at an end of a word is another feature than the same within.
    """
    data = b"<" + b"><".join(words) + b">"
    buf = np.frombuffer(data, np.uint8).astype(U)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(buf))  # bytes to the word's end
    owners, hashes = [], []
    code = np.zeros(len(buf), U)
    for n in range(1, max(sizes) + 1):
        code[: len(buf) - n + 1] = code[: len(buf) - n + 1] * U(0x100000001B3) + buf[n - 1 :] + U(1)
        if n in sizes:
            at = np.flatnonzero(left >= n)
            owners.append(owner[at])
            hashes.append(mix(code[at] ^ U(n << 56)))
    whole = Block(words).hash if words else np.zeros(0, U)
    if len(whole) == len(words):
        owners.append(np.arange(len(words)))
        hashes.append(mix(whole))
    own, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(own, kind="stable")
    return own[order], (h[order] % U(buckets)).astype(np.int64)


class Distinct:
    """The distinct words of a block: their texts, and the word each place of the block has."""

    def __init__(self, block: Block):
        _, first, self.place = np.unique(block.hash, return_index=True, return_inverse=True)
        self.words = [block.word(i) for i in first]


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def sample_ids(rows: DataFrame, id_col: str, label_col: str, each: int) -> DataFrame:
    """At most `each` ids of every label, by the order of a hash of the id; reads no other column."""
    order = Window.partitionBy(label_col).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    picked = rows.select(id_col, label_col).filter(f"`{id_col}` is not null and `{label_col}` is not null")
    return picked.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= each).drop("_place")

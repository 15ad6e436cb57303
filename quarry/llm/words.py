"""Word boundaries and word hashes of whole documents, a block of documents at a time.

Helpers for the operators that scan words inside Arrow tasks. A block is a list of
UTF-8 texts joined by a space; words are maximal runs of the bytes that a table
marks. Memory follows the block (about `BLOCK_BYTES`, or the one document that is
longer), and the hash arithmetic runs over slices of `SLICE_BYTES`.

Hashes are polynomials modulo 2**64 over random byte values, then mixed, so that
equal words (or equal runs of words) have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
SLICE_BYTES = 1_000_000

U = np.uint64
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95 | 1


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 flags, set for the bytes outside the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`: everything but the ASCII white space.
SPACED = byte_table((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, small letters, everything beyond ASCII.
ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """base**i and its inverse modulo 2**64, grown as needed and kept by the worker."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_P_POWERS, _Q_POWERS, _R_POWERS = _Powers(_P), _Powers(_Q), _Powers(0xA24BAED4963EE407 | 1)


class Block:
    """Words of a list of texts.

    start, end: byte places of each word in `data`; first: index of each
    document's first word, with the number of words at the end; hash: one number per word.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray = SPACED, lower: bool = False):
        self.data = b" ".join(texts) + b" "
        if lower:
            self.data = self.data.lower()  # bytes: A-Z only
        buf = np.frombuffer(self.data, np.uint8)
        flag = np.frombuffer(self.data.translate(table.tobytes()), np.bool_)
        edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
        if flag[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]  # the closing space ends the last word
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.first = np.searchsorted(self.start, at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes(buf)

    def _hashes(self, buf: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), U)
        i = 0
        while i < len(out):
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, "right")))
            hi = self.end[j - 1]
            up, down = _P_POWERS.get(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, U)
            np.cumsum(_BYTE[buf[lo:hi]] * up[:-1], out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            i = j
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def words(self, doc: int) -> list[bytes]:
        return [self.data[s:e] for s, e in zip(*(x[self.first[doc] : self.first[doc + 1]] for x in (self.start, self.end)))]


class Runs:
    """Hashes of runs of consecutive items, from prefix sums over their hashes."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        self.up, self.down = (_R_POWERS if second else _Q_POWERS).get(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(hashes * self.up[:-1], out=self.sums[1:])

    def get(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)


def text_key(texts: list[bytes]) -> np.ndarray:
    """A hash of each whole text; with the id it names a row even if ids repeat."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in texts], U).view(np.int64)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as the empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `limit` bytes of text each, never cutting a document."""
    for batch in batches:
        texts = as_bytes(batch.column(text))
        i = size = 0
        for j, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(i, j - i), texts[i:j]
                i, size = j, 0
            size += len(t)
        if i < len(texts):
            yield batch.slice(i), texts[i:]

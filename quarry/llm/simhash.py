"""SimHash near-duplicates from a Gray-order hierarchical index.

Fingerprints: XXH64 (seed 42) of every 4-word shingle, repeats included; a bit is set if it
is set in over half of them. Documents link when their fingerprints differ in at most four bits.

Index. Distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits,
and form the leaves of a binary tree. A node holds a mask of the bits that all below it
agree on and their pattern; bits that the parent has already are factored out of its
children. A search adds up the differences in masked bits on its way down and drops a whole
group as soon as the sum is over the bound.

Distribution. At most four differing bits leave at most one in some quarter of the 64 bits.
So each of four rotations brings one quarter to the front, and two linked
fingerprints are within one bit there in one of them. A unit holds the fingerprints
of one rotation with the same first `p` bits (p grows with the number of fingerprints, so units
do not). A fingerprint is in the tree of its own unit and asks there and, for each set bit of the
first p, in the unit with that bit unset: p/2 + 1 copies on average, and each pair of units meets once.
The search in a unit allows one difference in the front quarter and four in all.
A unit with more than `PART` fingerprints (a cluster of near copies) is dealt over parts by
a hash, and tree parts and question parts meet in cells of bounded size.

Clusters. A cell keeps the components of what it has found; nodes that lie whole in the
component of the asking fingerprint are dropped, so a cluster whose members all
link is not compared pair by pair. It returns its components as stars, at most
one row for each fingerprint; Spark joins the stars into components.

Defined results: null and empty texts and those without words have fingerprint zero and
link like any other; fewer than four words are one shingle; copies are one
fingerprint from the start; repeated ids and rows each have their row; a null id names a
component only if no other is in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.frames import read, staged
from quarry.llm.words import Block, U, blocks, signed

SHINGLE, BITS, SEED = 4, 4, 42
ROTATIONS, QUARTER = 4, 16
#: Fingerprints of a unit on average, and of a part at most on average.
UNIT, PART = 65_536, 524_288
#: Least and most leading bits that name a unit.
LEAST_BITS, MOST_BITS = 4, QUARTER
#: Shingles hashed at once; pairs of a question and a node held at once; questions of the first and of a later batch.
SLICE, PAIRS, FIRST, BATCH = 262_144, 1_000_000, 256, 8192
_ALL = U(2**64 - 1)


def fingerprint(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    block = Block(texts, lower=True)
    out = np.zeros(len(texts), U)
    for d, (lo, hi) in enumerate(zip(block.first[:-1].tolist(), block.first[1:].tolist())):
        if lo == hi:
            continue
        start, end = block.start[lo:hi], block.end[lo:hi]
        joined = block.data[start[0] : end[-1]]
        if len(joined) != (end - start).sum() + hi - lo - 1 or joined.count(b" ") != hi - lo - 1:
            joined = b" ".join(block.words(d))  # other white space than single spaces
        edge = np.cumsum(end - start + 1)
        first = np.concatenate(([0], edge[: hi - lo - shingle])) if hi - lo > shingle else np.zeros(1, np.int64)
        last = edge[min(shingle, hi - lo) - 1 :] - 1
        bits = np.zeros(64, np.int64)
        for i in range(0, len(first), SLICE):
            h = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[i : i + SLICE].tolist(), last[i : i + SLICE].tolist())]
            bits += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[d] = int("".join("1" if 2 * b > len(first) else "0" for b in bits.tolist()), 2)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(shift))
    return x


class Index:
    """The tree over distinct fingerprints; leaves are in Gray order, node i of a level has the children 2i and 2i + 1 below."""

    def __init__(self, leaves: np.ndarray, top: int = 32):
        self.leaves = leaves[np.argsort(gray_rank(leaves))]
        masks, self.patterns = [np.full(len(leaves), _ALL)], [self.leaves]
        while len(masks[-1]) > top:
            m, p = masks[-1], self.patterns[-1]
            if len(m) % 2:
                m, p = np.append(m, m[-1]), np.append(p, p[-1])
            mask = m[::2] & m[1::2] & ~(p[::2] ^ p[1::2])
            masks.append(mask)
            self.patterns.append(p[::2] & mask)
        # bits of each node that are not in its parent
        self.own = [m & ~np.repeat(up, 2)[: len(m)] for m, up in zip(masks, masks[1:])] + masks[-1:]

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Per level: the label that all leaves below a node have, or -1."""
        out = [labels]
        for p in self.patterns[1:]:
            x = out[-1]
            x = np.append(x, x[-1]) if len(x) % 2 else x
            out.append(np.where(x[::2] == x[1::2], x[::2], -1))
        return out

    def search(self, asking: np.ndarray, label: np.ndarray, labels: np.ndarray, bits: int, front: int, front_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, leaf) of the pairs within `bits`, and `front` of the first front_bits, whose labels differ, in slices."""
        same, shift = self.uniform(labels), U(64 - front_bits)
        level = len(self.patterns) - 1
        tops = len(self.patterns[level])
        stack = [(level, np.repeat(np.arange(len(asking)), tops), np.tile(np.arange(tops), len(asking)), None, None)]
        while stack:
            level, q, node, far, near = stack.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                cut = lambda x, a, b: None if x is None else x[a:b]
                stack += [(level, q[a:b], node[a:b], cut(far, a, b), cut(near, a, b)) for a, b in ((0, half), (half, len(q)))]
                continue
            other = (asking[q] ^ self.patterns[level][node]) & self.own[level][node]
            total, ahead = np.bitwise_count(other), np.bitwise_count(other >> shift)
            if far is not None:
                total, ahead = total + far, ahead + near
            keep = np.flatnonzero((total <= bits) & (ahead <= front) & (same[level][node] != label[q]))
            q, node, total, ahead = q[keep], node[keep], total[keep], ahead[keep]
            if not len(q):
                continue
            if not level:
                yield q, node
                continue
            node = np.concatenate((2 * node, 2 * node + 1))
            q, total, ahead = (np.concatenate((x, x)) for x in (q, total, ahead))
            real = node < len(self.patterns[level - 1])
            stack.append((level - 1, *((q, node, total, ahead) if real.all() else (q[real], node[real], total[real], ahead[real]))))


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (the smallest place of each) after the places a and b are linked."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def cell_stars(tree: np.ndarray, guests: np.ndarray, bits: int = BITS, front: int = 1, front_bits: int = QUARTER) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, centre) of what links connect: the tree's leaves with each other and the guests with the leaves."""
    tree, guests = np.unique(tree), np.unique(guests)
    if not len(tree):
        return tree, tree
    index = Index(tree)
    guests = guests[np.argsort(gray_rank(guests))]
    every, n = np.concatenate((index.leaves, guests)), len(tree)
    beside = np.flatnonzero(np.bitwise_count(index.leaves[1:] ^ index.leaves[:-1]) <= bits)
    root = _merge(np.arange(len(every)), beside, beside + 1)
    i, size = 0, FIRST
    while i < len(every):
        part = slice(i, i + size)
        for q, leaf in index.search(every[part], root[part], root[:n], bits, front, front_bits):
            root = _merge(root, q + i, leaf)
        i, size = i + size, min(2 * size, BATCH)
    linked = np.flatnonzero(root != np.arange(len(root)))
    return every[linked], every[root[linked]]


def rotated(x: np.ndarray, rotation: int) -> np.ndarray:
    return x if not rotation else (x << U(QUARTER * rotation)) | (x >> U(64 - QUARTER * rotation))


def _units(p: int) -> Callable:
    """(unit, x, home) of each fingerprint: its own unit and those that it asks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("print").to_numpy(zero_copy_only=False).view(U)
            for r in range(ROTATIONS):
                turned = rotated(x, r)
                own = (turned >> U(64 - p)).astype(np.int64)
                for bit in [None, *range(p)]:
                    take = slice(None) if bit is None else (own >> bit) & 1 == 1
                    unit = own[take] if bit is None else own[take] ^ (1 << bit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((r << p) + unit, pa.int64()), pa.array(signed(turned[take])), pa.array(np.full(len(unit), bit is None))], names=["unit", "x", "home"]
                    )

    return deal


def _search(bits: int) -> Callable:
    """Stars of each cell, from rows ordered by cell; a cell's rows are held as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            x, leaf = (np.concatenate(c) for c in zip(*held))
            a, b = cell_stars(x[leaf], x[~leaf], bits)
            back = (ROTATIONS - key[0]) % ROTATIONS
            return pa.RecordBatch.from_arrays([pa.array(signed(rotated(a, back))), pa.array(signed(rotated(b, back)))], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("rotation", "unit", "tree", "ask")])
            edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            x, leaf = batch.column("x").to_numpy().view(U), batch.column("leaf").to_numpy(zero_copy_only=False)
            for i, j in zip(edge[:-1], edge[1:]):
                if i == j:
                    continue
                if (now := tuple(keys[:, i].tolist())) != key:
                    if held:
                        yield close()
                    key, held = now, []
                held.append((x[i:j], leaf[i:j]))
        if held:
            yield close()

    return run


def links(prints: DataFrame, bits: int = BITS, unit: int = UNIT, part: int = PART) -> DataFrame:
    """(a, b): stars that connect the distinct fingerprints (column print) that links connect."""
    if not 0 <= bits <= ROTATIONS:
        raise ValueError(f"{ROTATIONS} rotations find differences of at most {ROTATIONS} bits")
    n = prints.count()
    p = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n / unit)))))
    dealt = staged(prints.mapInArrow(_units(p), "unit long, x long, home boolean"))
    parts = dealt.groupBy("unit").agg(F.ceil(F.greatest(F.count_if("home"), F.count_if(~F.col("home"))) / part).cast("int").alias("parts"))
    dealt = dealt.join(parts.filter("parts > 1"), "unit", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # a leaf is in the tree part's cells with all asking parts; it and a guest ask the other tree parts, a leaf each pair of parts once
    as_leaf = F.transform(others, lambda j: F.struct(F.col("own").alias("tree"), j.alias("ask"), F.lit(True).alias("leaf")))
    as_guest = F.transform(F.filter(others, lambda i: ~F.col("home") | (i < F.col("own"))), lambda i: F.struct(i.alias("tree"), F.col("own").alias("ask"), F.lit(False).alias("leaf")))
    cells = F.when(F.col("home"), F.concat(as_leaf, as_guest)).otherwise(as_guest)
    cells = dealt.select("unit", "x", F.explode(cells).alias("cell")).select(F.shiftright("unit", p).cast("long").alias("rotation"), "unit", "x", "cell.*")
    cells = cells.repartition("unit", "tree", "ask").sortWithinPartitions("unit", "tree", "ask")
    return cells.select("rotation", "unit", "tree", "ask", "x", "leaf").mapInArrow(_search(bits), "a long, b long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, the smallest id that links reach."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(signed(fingerprint(texts, shingle)))], names=["doc", "print"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = staged(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(find, f"doc {id_type}, print long"))
    distinct = staged(rows.groupBy("print").agg(F.min("doc").alias("doc")))
    found = staged(components(staged(links(distinct.select("print"), bits)), "a", "b"))
    least = found.join(distinct, F.col("node") == F.col("print")).groupBy("component").agg(F.min("doc").alias("component_id"))
    moved = staged(found.join(least, "component").select(F.col("node").alias("print"), "component_id"))
    named = distinct.join(moved, "print", "left").select("print", F.coalesce("component_id", "doc").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("print")), 16, "0")
    return rows.join(named, "print").select(F.col("doc").alias(id_col), hexed.alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_simhash": op13_simhash}

"""N-gram Jaccard join with PartEnum signatures.

A document's set: its distinct shingles of five words. Two sets link when
100 * |intersection| >= 75 * |union|. For sizes a <= b that means a >= 0.75 b and a
symmetric difference of at most (a + b) / 7.

Signatures. Sizes fall into bands; the sets of a band, and those of the band below
that are large enough to link into it, form an instance with one bound k on the
difference. The feature domain is cut into n1 partitions of two second-level
partitions each, and the subsets of one second-level partition of each pair are
enumerated: a difference in one of the two leaves the other subset equal. With
2 * n1 = N second-level partitions, two linked sets agree on at least N - k of them.
A signature is the hash of the shingles that fall into the partition; empty ones
say nothing and are left out. A set with p partitions that are not empty so shares at
least p - k signatures with any set it links to (k by its own size): that is its
bound. A set whose bound is under `SHARED` also signs another table, dealt by another
hash, and after `TABLES` of them each of its shingles; its bound is then `SHARED`.

Candidates. Signatures are compared in buckets by packed blocks, and only those of two
or more different sets go on. A set with fewer shared signatures than its bound drops
out. Of the others, the rarest go on that leave fewer than the bound: of all that two
linked sets share, the rarest is among them on both sides, and what very many sets
share (a common line) is not. Sets that have a signature of the same members in common are a
group, one narrow row for each set and group.

Sketches. Before sets are moved, a pair is tried on sketches of `SKETCH` bits: bit i is the parity of the
shingles that hash to i. Equal shingles cancel out and each different one turns one bit, so two sketches
differ in no more bits than the sets in shingles; a pair whose sketches differ in more than a link allows
has none. Only the other pairs are compared exactly, and only their sets leave the scan.

Hubs. What links connect is found in rounds, whose links are merged into components; groups whose members
lie all in one are finished. The first member of a group is its hub, the one that shares the most signatures:
the centre of a cluster of near copies. In the first `SINGLE` rounds a set meets only the one hub, of all its
groups, that shares most, so these rounds finish nearly all of a cluster that links: one pair for each set.
A hub's members are dealt over parts of bounded size, each with the hub's set.

Cells. In the rounds after, all members of a group that lie in different components are tried on their sketches
inside a task, which gets a row for each member and makes one only of pairs that may link, of each set
the `NEAREST` first. Groups of more than `CELL_SETS` members are dealt over parts, and each two parts are a cell.
Cells that left a pair out are tried again, each round with `GROWTH` times as many for a set, until there are none:
no pair of a group in two components is left untried.

Equal sets are one class from the start, so copies cost nothing. Shingles and classes are
64-bit hashes.

Defined results: null and empty texts have the empty set and link with nothing;
fewer than five words are one shingle; repeated rows and ids each have their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.frames import in_small_batches, read, staged
from quarry.llm.words import Block, Runs, U, blocks, mix, signed
from quarry.operators import prefilter

SHINGLE = 5
#: Tables that a set with too many empty partitions signs before its single shingles.
TABLES = 2
#: Signatures that linked sets share at least; sets of three shingles have no more.
SHARED = 3
#: Members that a hub meets in one part on average.
PART_SETS = 4096
#: First rounds, in which each set meets one hub.
SINGLE = 2
#: Members of a part of a group; pairs that a set gives in a cell in the first round of cells, and their growth.
CELL_SETS, NEAREST, GROWTH = 2**15, 16, 16
#: Pairs whose sketches a cell compares at once.
CELL_PAIRS = 2**18
#: Bits of a set's sketch.
SKETCH = 1024
#: Signatures that a packed block holds, and that a bucket holds on average; those that are sorted at once.
BLOCK_SIGNATURES, BUCKET_SIGNATURES, SORTED = 500_000, 1_500_000, 250_000
#: Classes that a task that packs keeps in mind, so as to sign copies once.
SEEN = 2**18


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    block = Block(texts, lower=True)
    runs = Runs(block.hash)
    start = np.arange(len(block.hash))
    h = runs.get(start, np.minimum(start + shingle, block.first[block.doc + 1]) if len(start) else start)
    out = []
    for i, j in zip(block.first[:-1], block.first[1:]):
        out.append(np.unique(h[i : max(i + 1, j - shingle + 1)] if j > i else h[:0]))
    return out


def class_id(s: np.ndarray) -> np.int64:
    """The hash of a set."""
    return signed(mix(np.array([mix(s).sum(dtype=U) + U(len(s))], U)))[0]


@lru_cache
def bands() -> np.ndarray:
    """Upper sizes of the bands; each is about 16/9 of the one before."""
    out = [4]
    while out[-1] < 2**40:
        out.append(out[-1] * 16 // 9)
    return np.array(out)


def instances(n: int) -> list[int]:
    """The instances that a set of n shingles signs: its band and the next, if it can link into that."""
    i = int(np.searchsorted(bands(), n))
    return [i, i + 1] if 4 * n >= 3 * (int(bands()[i]) + 1) else [i]


def partitions(instance: int) -> int:
    """N: over 2/7 of twice the largest size, with room for empty partitions."""
    k = 2 * int(bands()[instance]) // 7
    return 2 * ((k + SHARED + 3 + k // 4) // 2 + 1)


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """All signatures of one set, and its bound; sets of one or two shingles link with no other set."""
    if len(s) < 3:
        return np.zeros(0, U), SHARED
    out, bound = [], len(s)
    for instance in instances(len(s)):
        n = partitions(instance)
        k = (len(s) + min(int(bands()[instance]), len(s) * 4 // 3)) // 7
        for table in range(TABLES + 1):
            salt = mix(np.array([(instance << 8) + table], U))
            if table == TABLES:
                out.append(mix(s ^ salt))
                break
            h = s if not table else np.sort(mix(s ^ salt))
            part = ((h >> U(32)) * U(n)) >> U(32)
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            out.append(mix(np.add.reduceat(mix(h), first) + mix(part[first] + salt)))
            if len(first) >= k + SHARED:
                break
        bound = min(bound, len(first) - k if not table else SHARED)
    return np.concatenate(out), bound


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, class, bound) of every row; class is null for the empty set."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, "text"):
            sets = shingle_sets(texts)
            n = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array([class_id(s) for s in sets], pa.int64(), mask=n == 0), pa.array([signatures(s)[1] for s in sets], pa.int64())],
                names=["doc", "n", "class", "bound"],
            )

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(find, f"doc {docs.schema[id_col].dataType.simpleString()}, n long, class long, bound long")


def _pack(buckets: int) -> Callable:
    """Rows (bucket, sigs, owners, classes): the signatures of a block of documents that fall into the bucket."""

    def rows(sigs: list[np.ndarray], ids: list[np.int64]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(s) for s in sigs])
        sig, of = np.concatenate(sigs), np.array(ids)
        bucket = ((sig >> U(32)) * U(buckets)) >> U(32)
        order = np.argsort(bucket, kind="stable")
        sig, owner, bucket = sig[order], owner[order], bucket[order]
        edge = [*np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist(), len(sig)]
        out: list[list] = [[], [], [], []]
        for a, b in zip(edge[:-1], edge[1:]):
            used, index = np.unique(owner[a:b], return_inverse=True)
            for column, value in zip(out, (int(bucket[a]), sig[a:b].tobytes(), index.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes(), of[used].tobytes())):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "sigs", "owners", "classes"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, ids, seen, size = [], [], set(), 0
        for _, texts in blocks(batches, "text"):
            for s in shingle_sets(texts):
                if len(s) > 2 and (c := class_id(s)) not in seen:
                    seen.add(c)
                    ids.append(c)
                    sigs.append(signatures(s)[0])
                    size += len(sigs[-1])
                if size > BLOCK_SIGNATURES:
                    yield rows(sigs, ids)
                    sigs, ids, size = [], [], 0
            if len(seen) > SEEN:  # classes that the task has signed, in this block or one before
                seen = set()
        if size:
            yield rows(sigs, ids)

    return pack


def _several(sig: np.ndarray, owner: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each signature that several different classes have: how many, and all these classes in order."""
    order = np.argsort(sig, kind="stable")
    sig, owner = sig[order], owner[order]
    same = sig[1:] == sig[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
    sig, of = sig[keep], of[owner[keep]]
    order = np.lexsort((of, sig))
    sig, of = sig[order], of[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
    sig, of = sig[new], of[new]  # each class once: copies of other blocks
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(first, append=len(sig))
    return size[size > 1], of[np.repeat(size > 1, size)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, class, times): the different sets of classes that share signatures of the bucket, and how many.

    Signatures are sorted about `SORTED` at a time, those with equal remainders together."""
    columns: list[list[np.ndarray]] = [[], [], []]
    n = 0
    for batch in batches:
        for s, o, c in zip(*(batch.column(x) for x in ("sigs", "owners", "classes"))):
            c = np.frombuffer(c.as_buffer(), np.int64).copy()
            o = np.frombuffer(o.as_buffer(), np.uint32 if len(c) > 65535 else np.uint16)
            for column, x in zip(columns, (np.frombuffer(s.as_buffer(), U).copy(), o + np.uint32(n), c)):
                column.append(x)
            n += len(c)
    sig, owner, of = (np.concatenate(columns.pop(0)) for _ in range(3))
    parts = min(64, 1 + len(sig) // SORTED)
    part = (sig % U(parts)).astype(np.uint8)
    found = [_several(sig[at], owner[at], of) for at in (np.flatnonzero(part == i) for i in range(parts)) if len(at)]
    del sig, owner, of, part
    size, of = (np.concatenate(x) for x in zip(*found))
    if not len(size):
        return
    group = mix(np.add.reduceat(mix(of.view(U)), np.cumsum(size) - size) + size.astype(U))  # equal members, equal group
    _, once, times = np.unique(group, return_index=True, return_counts=True)
    count = np.zeros(len(size), np.int64)
    count[once] = times
    count = np.repeat(count, size)
    take = count > 0
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(group, size)[take].view(np.int64)), pa.array(of[take]), pa.array(count[take])], names=["grp", "class", "times"])


def sketch(s: np.ndarray) -> np.ndarray:
    """Of each of `SKETCH` bits the parity of the shingles that hash to it, as signed words."""
    odd = np.bincount((mix(s) % U(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, n, sketch, set) of the texts, where a class is given only of those that have it: a repeated id may carry another text."""
    for batch, texts in blocks(batches, "text"):
        sets = shingle_sets(texts)
        own = [class_id(s) if len(s) else None for s in sets]
        known = batch.column("class").to_pylist() if "class" in batch.schema.names else own
        same = [c is not None and c == k for c, k in zip(own, known)]
        columns = [pa.array(own, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "n", "sketch", "set"]).filter(pa.array(same, pa.bool_()))


def _compare(percent: int) -> Callable:
    """Links (a, b) of each hub, from rows (hub, salt, kind, class, set) with the hub's own set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            a, b = [], []
            for of, kind, member, packed in zip(*(batch.column(c) for c in ("hub", "kind", "class", "set"))):
                s = np.frombuffer(packed.as_buffer(), U)
                if kind.as_py() == 0:
                    hub, own = of.as_py(), s.copy()
                    continue
                small, large = (s, own) if len(s) < len(own) else (own, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(s) + len(own) - both):
                    a.append(hub)
                    b.append(member.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(pairs: DataFrame) -> DataFrame:
    """(hub, class, salt): the pairs, each hub's in parts of about `PART_SETS`."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART_SETS).alias("parts"))
    return pairs.join(parts, "hub").select("hub", "class", F.pmod(F.xxhash64("class"), F.col("parts")).alias("salt"))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (hub, class) whose sketches differ in no more bits than a link allows shingles: all that link, and few others."""
    dealt = _dealt(pairs)
    small = sets.select("class", "n", "sketch")
    own = small.select(F.col("class").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    own = dealt.select("hub", "salt").distinct().join(own, "hub")
    both = dealt.join(small, "class").join(own, ["hub", "salt"])
    bits = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("hub_sketch")[i])) for i in range(SKETCH // 64)), F.lit(0))
    return both.filter((100 + percent) * bits <= (100 - percent) * (F.col("n") + F.col("hub_n"))).select("hub", "class")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (hub, class) whose sets link. A set is sent once for each of its hubs, a hub's once for each part."""
    dealt = _dealt(pairs)
    some = prefilter.may_match(sets.select("class", "set"), "class", pairs, "class")
    member = dealt.join(some, "class").select("hub", "salt", F.lit(1).alias("kind"), "class", "set")
    hubs = prefilter.may_match(sets.select("class", "set"), "class", pairs, "hub")
    own = hubs.select(F.col("class").alias("hub"), "set")
    head = dealt.select("hub", "salt").distinct().join(own, "hub").select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("class"), "set")
    rows = head.unionByName(member).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind")
    return rows.mapInArrow(_compare(percent), "a long, b long")


def _near(klass: np.ndarray, n: np.ndarray, degree: np.ndarray, component: np.ndarray, sketches: np.ndarray, percent: int, nearest: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(hub, class, more) of a cell's pairs in different components that may link: of each member the nearest with the components after its own."""
    _, index, sizes = np.unique(component, return_inverse=True, return_counts=True)
    order = np.lexsort((index, sizes[index]))  # the largest component last: its members are never paired with each other
    klass, n, degree, index, words = klass[order], n[order], degree[order], index[order], np.ascontiguousarray(sketches[order].view(U).T)
    ends = np.append(np.flatnonzero(index[1:] != index[:-1]) + 1, len(index))
    after = np.repeat(ends, np.diff(ends, prepend=0))  # where the components after each member's own begin
    i = 0
    while i < len(klass) and after[i] < len(klass):
        start = after[i]
        j = min(i + max(1, CELL_PAIRS // (len(klass) - start)), int(np.searchsorted(after, len(klass))))
        bits = np.zeros((j - i, len(klass) - start), np.uint16)
        for w in words:
            bits += np.bitwise_count(w[i:j, None] ^ w[start:])
        a, b = n[i:j, None], n[start:]
        may = ((100 + percent) * bits.astype(np.int64) <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if after[j - 1] > start:  # members of several components: each with what comes after its own
            may &= np.arange(start, len(klass)) >= after[i:j, None]
        x, y = np.nonzero(may)
        if len(x):
            close = np.lexsort((bits[x, y], x))
            x, y = x[close], y[close]
            first = np.searchsorted(x, x)
            more = np.bincount(x, minlength=j - i)[x] > nearest
            take = np.arange(len(x)) - first < nearest
            x, y, more = x[take] + i, y[take] + start, more[take]
            swap = (degree[x] > degree[y]) | ((degree[x] == degree[y]) & (klass[x] < klass[y]))
            yield np.where(swap, klass[x], klass[y]), np.where(swap, klass[y], klass[x]), more
        i = j


def _cells(percent: int, nearest: int) -> Callable:
    """The pairs that `_near` gives of each cell, from rows (cell, class, n, degree, component, sketch) in the order of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(columns: list[np.ndarray], edge: list[int]) -> Iterator[pa.RecordBatch]:
            found = [(*p, np.full(len(p[0]), columns[0][a])) for a, b in zip(edge[:-1], edge[1:]) for p in _near(*(c[a:b] for c in columns[1:]), percent, nearest)]
            if found:
                hub, klass, more, cell = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(hub), pa.array(klass), pa.array(cell, mask=~more)], names=["hub", "class", "cell"])

        held: list[np.ndarray] = []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "class", "n", "degree", "component")]
            columns.append(batch.column("sketch").flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH // 64))
            held = [np.concatenate(c) for c in zip(held, columns)] if held else columns
            edge = [0, *(np.flatnonzero(held[0][1:] != held[0][:-1]) + 1).tolist()]
            yield from pairs(held, edge)
            held = [c[edge[-1] :] for c in held]  # the last cell may go on
        if held:
            yield from pairs(held, [0, len(held[0])])

    return run


def near_pairs(alive: DataFrame, sets: DataFrame, percent: int, nearest: int, again: DataFrame | None = None) -> DataFrame:
    """(hub, class, cell): the pairs of a group's members in different components whose sketches allow a link, of a member in a
    cell the `nearest`; the cell is named where the member has others. Of the cells of `again`, if given. A member has a row for each cell."""
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    rows = alive.withColumn("parts", F.ceil(F.col("members") / CELL_SETS))
    rows = rows.select("grp", "class", "n", "degree", "component", "parts", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    rows = rows.filter((F.col("parts") == 1) | (F.col("part") != F.col("other")))
    cell = F.xxhash64("grp", F.least("part", "other"), F.greatest("part", "other"))
    rows = rows.select(cell.alias("cell"), "class", "n", "degree", "component")
    rows = rows if again is None else rows.join(again, "cell", "left_semi")
    rows = rows.join(sets.select("class", "sketch"), "class").select("cell", "class", "n", "degree", "component", "sketch")
    dealt = rows.repartition(int(alive.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_cells(percent, nearest), "hub long, class long, cell long").distinct()


def hub_pairs(alive: DataFrame, percent: int) -> DataFrame:
    """(hub, class): each set with the one hub, of all its groups, that shares most."""
    # the partial cut to a group's first row comes before the shuffle
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("degree"), "class"))
    hubs = alive.withColumn("place", place).filter(F.col("place") == 1)
    hubs = hubs.select("grp", *[F.col(c).alias(f"hub_{c}") for c in ("class", "n", "degree", "component")])
    fits = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = alive.join(hubs, "grp").filter(fits & (F.col("component") != F.col("hub_component")))
    return pairs.select(F.col("hub_class").alias("hub"), "class", "hub_degree")


def connected(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the classes that links connect, from groups (grp, class, n, degree) of candidates; None without links."""
    members = groups.groupBy("grp").agg(F.count("*").alias("members"))
    groups = staged(groups.join(members, "grp"))
    alive = groups.withColumn("component", F.col("class"))
    links = done = found = again = None
    single, nearest = SINGLE, NEAREST
    while True:
        if single:
            pairs = hub_pairs(alive, percent)
            pairs = pairs if done is None else pairs.join(done, ["hub", "class"], "left_anti")
            best = pairs.groupBy("class").agg(F.max(F.struct("hub_degree", "hub")).alias("best"))
            pairs = staged(best.select("best.hub", "class"))
            near = staged(possible(pairs, sets, percent))
        else:
            tried = staged(near_pairs(alive, sets, percent, nearest, again))
            again = tried.filter("cell is not null").select("cell").distinct()
            pairs = tried.select("hub", "class").distinct()
            near = pairs = staged(pairs if done is None else pairs.join(done, ["hub", "class"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        new = staged(verified(near, sets, percent)) if near.limit(1).count() else near
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            found = staged(components(links, "a", "b"))
        if again is not None and not again.limit(1).count():
            return found
        left = groups
        if found is not None:
            left = groups.join(found.withColumnRenamed("node", "class"), "class", "left")
        left = staged(left.withColumn("component", F.coalesce("component", "class") if found is not None else F.col("class")))
        open_ = left.groupBy("grp").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        alive = staged(left.join(open_.filter(F.col("least") < F.col("most")).select("grp"), "grp"))
        if not alive.limit(1).count():
            return found
        if single:
            single -= 1
        else:
            nearest *= GROWTH


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, n, class, bound), and the classes (class, doc, copies, component).

    doc is the smallest id of the class, component the class that names what links reach.
    Only percent=75 has its bands here.
    """
    if percent != 75:
        raise ValueError("the size bands are those of 75 per cent")
    with in_small_batches(docs.sparkSession):
        return _members(docs, id_col, text_col, percent)


def _members(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    known = staged(classes(docs, id_col, text_col))
    total = known.agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_SIGNATURES))
    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(_pack(buckets), "bucket int, sigs binary, owners binary, classes binary")
    groups = packed.groupBy("bucket").applyInArrow(_shared, "grp long, class long, times long")
    groups = staged(groups.groupBy("grp", "class").agg(F.sum("times").alias("times")))
    one = known.filter("class is not null").groupBy("class")
    one = staged(one.agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("bound").alias("bound"), F.count("*").alias("copies")))
    degrees = groups.groupBy("class").agg(F.sum("times").alias("degree")).join(one, "class").filter("degree >= bound")
    groups = groups.join(staged(degrees), "class")
    sizes = staged(groups.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1"))
    groups = staged(groups.join(sizes, "grp"))
    # of each class the rarest signatures: those that leave fewer than its bound behind them
    before = Window.partitionBy("class").orderBy("size", "grp").rowsBetween(Window.unboundedPreceding, -1)
    rare = groups.withColumn("left", F.sum("times").over(Window.partitionBy("class")) - F.coalesce(F.sum("times").over(before), F.lit(0)))
    groups = staged(rare.filter(F.col("left") >= F.col("bound")).select("grp", "class", "doc", "n", "degree"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1").select("grp")
    groups = staged(groups.join(sizes, "grp"))
    lists = staged(groups.select("class", "doc").distinct())
    text = F.col(text_col).alias("text")
    # one text of each candidate set: texts of other documents are dropped in their scan
    ids = known.agg(F.count("*").alias("rows"), F.count("doc").alias("with_id"), F.count_distinct("doc").alias("ids")).first()
    some = prefilter.may_match(docs.select(F.col(id_col).alias("doc"), text), "doc", lists, "doc")
    sets = some.join(lists, "doc").select("class", "text").mapInArrow(_sets, "class long, n long, sketch array<long>, set binary")
    if ids["rows"] > ids["with_id"]:  # classes of rows without an id
        bare = docs.filter(F.col(id_col).isNull()).select(text).mapInArrow(_sets, "class long, n long, sketch array<long>, set binary")
        sets = sets.unionByName(bare.join(lists.filter("doc is null").select("class"), "class", "left_semi"))
    sets = staged(sets if ids["rows"] == ids["ids"] else sets.dropDuplicates(["class"]))
    found = connected(groups.select("grp", "class", "n", "degree"), sets, percent)
    if found is None:
        return known, staged(one.select("class", "doc", "copies", F.col("class").alias("component")))
    named = one.join(found.withColumnRenamed("node", "class"), "class", "left")
    return known, staged(named.select("class", "doc", "copies", F.coalesce("component", "class").alias("component")))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the smallest id reachable by links."""
    known, named = members(docs, id_col, text_col, percent)
    least = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = staged(named.join(least, "component").select("class", "component_id"))
    return known.join(named, "class", "left").select(
        F.col("doc").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc").alias("component_id"),
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_jaccard_join": op9_jaccard_join}

SQL = {
    "op9_jaccard_join": r"""
        WITH RECURSIVE doc AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
            FROM documents
        ), shingle AS (
            SELECT DISTINCT row, array_to_string(words[i:i + 4], ' ') AS shingle
            FROM (SELECT row, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM doc WHERE len(words) > 0)
        ), doc_set AS (
            SELECT row, count(*) AS n, string_agg(shingle, chr(10) ORDER BY shingle) AS content FROM shingle GROUP BY row
        ), class AS (
            SELECT min(row) AS class, n, content FROM doc_set GROUP BY n, content
        ), member AS (
            SELECT row, class, n FROM doc_set JOIN class USING (n, content)
        ), of_class AS (
            SELECT class, n, shingle FROM class JOIN shingle ON class = row
        ), link AS (
            SELECT a.class AS a, b.class AS b FROM of_class AS a JOIN of_class AS b ON a.shingle = b.shingle AND a.class <> b.class
            GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), reach AS (
            SELECT class AS a, class AS b FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
        ), least AS (
            SELECT reach.a AS class, min(doc_id) AS doc_id FROM reach JOIN member ON reach.b = member.class JOIN doc USING (row) GROUP BY reach.a
        )
        SELECT doc.doc_id, coalesce(member.n, 0)::BIGINT AS n_shingles, coalesce(least.doc_id, doc.doc_id) AS component_id
        FROM doc LEFT JOIN member USING (row) LEFT JOIN least USING (class)
    """
}

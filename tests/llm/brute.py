"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOW = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(docs: list[tuple], length: int = 50) -> list[tuple]:
    """(id, n_words, n_removed, sha of the kept words) of rows (id, text)."""
    words = [SPACED.findall(t or "") for _, t in docs]
    first: dict[tuple, int] = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - length + 1 if i is not None else 0):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words):
        gone: set[int] = set()
        for k in range(len(w) - length + 1 if i is not None else 0):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def decontaminate(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOW))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    out = []
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if items_ := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= items_
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text: str | None) -> frozenset:
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(docs: list[tuple]) -> list[tuple]:
    """(id, n_shingles, component_id) of rows (id, text)."""
    sets = []
    for _, t in docs:
        w = SPACED.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(docs)]


def pieces(docs: list[tuple], tokenizer, limit: int = 4096) -> Counter:
    out: Counter = Counter()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p, k in enumerate(range(0, len(ids), limit)):
            part = ids[k : k + limit]
            out[i, p, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def sequences(rows: list[tuple], limit: int = 4096) -> int:
    """Number of sequences of rows (sequence_id, offset, length), each checked to be gapless."""
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= limit
    return len(by)


def top_k(rows: list[tuple], k: int = 20, every: int = 20, scale: int = 64) -> set[tuple]:
    ok = {(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for i, q in ok:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


def resample(docs: list[tuple], target: list, ngrams: int, buckets: int, min_words: int, percent: int) -> list[tuple]:
    """(id, n_features, weight, score, rank) of rows (id, text)."""

    def features(text):
        w = ALNUM.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        n_words, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, None, n_words, xxhash.xxh3_64_intdigest((text or "").encode())])
    drawn = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[6] - (r[6] >> 63 << 64)))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


def reachable(nodes: list, links: list[tuple]) -> dict:
    """The smallest node that links reach, of each node."""
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def simhash(docs: list[tuple], bits: int = 4) -> list[tuple]:
    """(id, fingerprint, component_id) of rows (id, text)."""
    prints = []
    for _, text in docs:
        w = SPACED.findall((text or "").translate(LOW))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    known = sorted(set(prints))
    component = reachable(known, [(a, b) for k, a in enumerate(known) for b in known[k + 1 :] if (a ^ b).bit_count() <= bits])
    least: dict[int, int] = {}
    for (i, _), p in zip(docs, prints):
        if i is not None:
            least[component[p]] = min(least.get(component[p], i), i)
    return [(i, f"{p:016x}", least.get(component[p])) for (i, _), p in zip(docs, prints)]

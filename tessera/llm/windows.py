"""Near-duplicate passages by compact windows.

For each of several hash functions, a document's five-word shingles form a Cartesian tree by hash. A node of it, at c,
whose subtree spans [l, r] says that c is the min-hash of every subsequence that begins in [l, c] and ends in [c, r];
nodes of at least `width` shingles stand for all subsequences that long. They are found as the minima of sliding windows,
their spans by doubling range minima, which gives the same tree without a loop over words.

1. Nodes are grouped by min-hash; those of one document alone go, and so do copies of a whole document, but one.
2. In each document the intervals of nodes of two functions are joined: where both cover one passage, the pair of
   min-hashes is a signature that all passages there share.
3. Signatures are grouped. Equal surroundings link at once, each document to the smallest of them.
4. Where documents not yet connected share a signature, the passages around it are compared and verified. Within a
   signature a spanning forest is built: each passage reached is compared with all those not yet reached, so none is left out."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, suffixes

SHINGLE, WORDS, FUNCTIONS, SIMILARITY = 5, 50, 4, 0.8
#: Passages of one signature that a task compares by itself; a larger group is dealt out in pairs of blocks.
BLOCK = 16_384
#: Passages whose shingles are counted at once.
CHUNK = 4096
#: Rows of a signature, if so many, are sifted after so many turns of a component, or twice, four times ... as many if that left most.
SIFT = 16
ODD = np.uint64(0x9E3779B97F4A7C15)

def spans(v: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each position of `at` is the smallest (leftmost if equal), within [low, high): the spans of its Cartesian tree node, inclusive."""
    tables = [v]
    longest = int((high - low).max(initial=1))
    while 2 << (len(tables) - 1) <= longest:
        s = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-s], tables[-1][s:]))
    l, r, own = at.copy(), at.copy(), v[at]
    for k in range(len(tables) - 1, -1, -1):
        t, s = tables[k], 1 << k
        may = l - s >= low
        may[may] = t[l[may] - s] > own[may]
        l[may] -= s
        may = r + s < high
        may[may] = t[r[may] + 1] >= own[may]
        r[may] += s
    return l, r


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _nodes(width: int, functions: int):
    """Documents to nodes. Of a function's nodes in one document whose passages (of width shingles, by
    their text) are the same, as in periodic text, the first stays.

    No passage is lost: its text tells its nodes. If one was dropped, the passage stands further in front too; where it
    stands first, all its nodes are kept.

    key, doc_id, whole (hash of all shingles), around (hash of those within width - 1), c, and shape: function, c - l, r - c, up to 255, and if it's the first."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for b in batches:
            for own, h, begin in suffixes.word_groups(b, words):
                g = common.grams(h, SHINGLE)
                if not len(g):
                    continue
                size = np.diff(begin)
                doc = np.repeat(np.arange(len(own)), size)[: len(g)]
                low, high = begin[:-1][doc], np.maximum(begin[1:][doc] - SHINGLE + 1, begin[:-1][doc])
                valid = (np.arange(len(g)) < high) & (high - low >= width)
                sums = np.zeros(len(g) + 1, np.uint64)
                np.cumsum(g * _powers(ODD, len(g)), out=sums[1:])
                back = _powers(inverse, len(g) + 1)
                told = lambda a, e: common.mix((sums[e] - sums[a]) * back[a] + (e - a).astype(np.uint64))  # noqa: B023,E731
                found = []
                for f in range(functions):
                    v = common.mix(g + np.uint64((f + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
                    at = suffixes.minimisers(v, valid, width)
                    l, r = spans(v, at, low[at], high[at])
                    ok = r - l + 1 >= width
                    at, l, r = at[ok], l[ok], r[ok]
                    start = np.maximum(l, at - width + 1)
                    own_text = told(start, np.minimum(r, at + width - 1) + 1) ^ common.mix((doc[at] << 8) + at - start + 1)
                    ok = np.sort(np.unique(own_text, return_index=True)[1])
                    at, l, r = at[ok], l[ok], r[ok]
                    found.append((v[at], at, f | np.minimum(at - l, 255) << 8 | np.minimum(r - at, 255) << 16))
                key, at, shape = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(at):
                    continue
                lo, hi = low[at], high[at]
                first = np.unique(doc[at], return_index=True)[1]
                shape[first] |= 1 << 24
                around = told(np.maximum(lo, at - width + 1), np.minimum(hi, at + width))
                around ^= common.mix((at - np.maximum(lo, at - width + 1)).astype(np.uint64))
                whole = told(lo, hi)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, whole, around)), pa.array(np.array(own, np.int64)[doc[at]]), pa.array((at - lo).astype(np.int32)), pa.array(shape.astype(np.int32))], ["key", "whole", "around", "doc_id", "c", "shape"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, int]]:
    """(columns, begins of runs of the first column, rows in front that were seen before). A run goes on into the next
    batch: its first row and its last `keep` rows are shown there again."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        x = [b.column(i).to_numpy() for i in range(b.num_columns)]
        seen = 0
        if held is not None:
            seen = len(held[0])
            x = [np.concatenate([h, c]) for h, c in zip(held, x, strict=True)]
        new = np.r_[True, x[0][1:] != x[0][:-1]]
        yield x, np.flatnonzero(new), seen
        at = int(np.flatnonzero(new)[-1])
        rows = np.unique(np.r_[at, np.arange(max(at, len(new) - keep), len(new))])
        held = [c[rows] for c in x]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes in order of key, whole, c and document to those whose key several texts have, one document of each text; and rows (doc_id, copy_of)."""
    wait: list[np.ndarray] | None = None  # the nodes of a key's first text, until there is a second
    for x, begin, seen in _runs(batches, 1):
        key, whole, c, doc, around, shape = x
        i = np.arange(len(key))
        run = np.searchsorted(begin, i, "right") - 1
        same = np.r_[False, (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])]
        lead = np.maximum.accumulate(np.where(~(same & np.r_[False, c[1:] == c[:-1]]), i, 0))
        fresh = i >= seen
        copy = fresh & (lead < i) & (doc != doc[lead])
        text = np.maximum.accumulate(np.where(~same, i, 0))
        mixed = np.zeros(len(begin), bool)
        np.logical_or.at(mixed, run, text != begin[run])
        nodes = fresh & (lead == i)
        out = nodes & mixed[run]
        parts = [[k[out] for k in (doc, key, c, shape, around)]]
        if wait is not None and len(wait[0]):
            if key[0] != wait[1][0]:
                wait = None
            elif mixed[0]:
                parts.append(wait)
                wait = None
        if not mixed[-1]:
            tail = nodes & (run == len(begin) - 1)
            more = [k[tail] for k in (doc, key, c, shape, around)]
            wait = [np.concatenate(y) for y in zip(wait, more, strict=True)] if wait is not None and len(begin) == 1 else more
        else:
            wait = None
        doc_id, k, at, sh, ar = (np.concatenate(y) for y in zip(*parts, strict=True))
        n = int((copy & (shape >> 24 == 1)).sum())
        told = copy & (shape >> 24 == 1)
        null = pa.nulls(n, pa.int64())
        cat = lambda a, b: pa.concat_arrays([pa.array(a), b])
        yield pa.RecordBatch.from_arrays([
            cat(doc_id, pa.array(doc[told])), cat(k, null), cat(at, pa.nulls(n, pa.int32())), cat(sh, pa.nulls(n, pa.int32())), cat(ar, null), pa.concat_arrays([pa.nulls(len(doc_id), pa.int64()), pa.array(doc[lead[told]])]),
        ], ["doc_id", "key", "c", "shape", "around", "copy_of"])


def _signatures(width: int):
    """Nodes in order of document and c to (key, around, doc_id, c) for each two of different functions that cover one passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _, seen in _runs(batches, 8 * width):
            doc, c, key, shape, around = x
            f, l, r = shape & 0xFF, shape >> 8 & 0xFF, shape >> 16 & 0xFF
            found = []
            for lag in range(1, len(doc)):
                i = np.arange(max(0, seen - lag), len(doc) - lag)
                j = i + lag
                near = (doc[i] == doc[j]) & (c[j] - c[i] < width)
                if not near.any():
                    break
                i, j = i[near], j[near]
                span = np.minimum(r[i], r[j] + c[j] - c[i]) + np.minimum(l[j] - c[j] + c[i], l[i]) + 1
                ok = (f[i] != f[j]) & (span >= width) & (j >= seen)
                i, j = i[ok], j[ok]
                swap = f[i] > f[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                found.append((common.mix(key[i].view(np.uint64) * ODD + key[j].view(np.uint64)).view(np.int64), around[i], doc[i], c[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in zip(*found, strict=True)], ["key", "around", "doc_id", "c"])

    return run


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in order of key, surroundings and document to links (a, b, null, null) of equal surroundings and, where
    a key has several surroundings, one passage (document, null, key, c) of each."""
    wait: tuple | None = None  # a key's first passage, until there is a second
    for (key, around, doc, c), begin, seen in _runs(batches, 1):
        i = np.arange(len(key))
        run = np.searchsorted(begin, i, "right") - 1
        lead = np.maximum.accumulate(np.where(np.r_[True, (key[1:] != key[:-1]) | (around[1:] != around[:-1])], i, 0))
        fresh = i >= seen
        # The rows shown again are the key's first and its last, and the last may not be the first of its surroundings: links then chain.
        link = fresh & (doc != doc[lead])
        pairs = np.unique(np.stack([doc[lead[link]], doc[link]], 1), axis=0)
        mixed = np.zeros(len(begin), bool)
        np.logical_or.at(mixed, run, lead != begin[run])
        ask = fresh & (lead == i) & mixed[run]
        asked = [(doc[ask], key[ask], c[ask])]
        if wait is not None and key[0] == wait[1][0] and mixed[0]:
            asked.append(wait)
            wait = None
        if wait is not None and (len(begin) > 1 or key[0] != wait[1][0]):
            wait = None
        if not mixed[-1] and begin[-1] >= seen:
            wait = tuple(y[begin[-1] : begin[-1] + 1] for y in (doc, key, c))
        d, k, at = (np.concatenate(y) for y in zip(*asked, strict=True))
        n = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(d)]), pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(d), pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(k)]), pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(at)])], ["a", "b", "key", "c"])


def _excerpts(width: int):
    """Documents with what is asked of them to the shingles within width - 1 of each place; missing ones are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for b in batches:
            at = 0
            asked = b.column("asked")
            for own, h, begin in suffixes.word_groups(b, words):
                g = (common.grams(h, SHINGLE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                part = asked.slice(at, len(own))
                at += len(own)
                flat = part.flatten()
                roots = b.column("root").to_numpy()[at - len(own) : at]
                key, c = flat.field("key").to_numpy(zero_copy_only=False), flat.field("c").to_numpy(zero_copy_only=False).astype(np.int64)
                d = np.repeat(np.arange(len(own)), np.diff(part.offsets.to_numpy()))
                for i in range(0, len(c), 10_000):
                    k, e = c[i : i + 10_000] + begin[:-1][d[i : i + 10_000]], d[i : i + 10_000]
                    where = k[:, None] + np.arange(1 - width, width)
                    inside = (where >= begin[:-1][e][:, None]) & (where <= begin[1:][e][:, None] - SHINGLE)
                    rows = np.where(inside, g[np.clip(where, 0, max(0, len(g) - 1))] if len(g) else np.uint32(0), np.uint32(0))
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 10_000]), pa.array(np.array(own, np.int64)[e]), pa.array(roots[e]), suffixes.binary(rows)], ["key", "doc_id", "root", "g"])

    return run


def similar(x: np.ndarray, y: np.ndarray, width: int, least: float, places: list[int] | None = None) -> float:
    """The Jaccard similarity, if `least` or more, of two passages of `width` shingles that hold the middle one at one
    of the places (all, if not given); the highest if there is no such pair. x and y are shingles around it, 0 where there are none."""
    best = 0.0
    for o in range(width) if places is None else places:
        p, q = set(x[o : o + width].tolist()), set(y[o : o + width].tolist())
        if 0 in p or 0 in q:
            continue
        n = len(p & q)
        best = max(best, n / (len(p) + len(q) - n))
        if best >= least:
            break
    return best


class Joined:
    """What links of this task have joined so far, to spare the same pair in other signatures. Forgets beyond `most` entries."""

    def __init__(self, most: int = 500_000):
        self.most, self.up = most, {}

    def find(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        if len(self.up) > self.most:
            self.up.clear()
        self.up[self.find(x)] = self.find(y)


def _begins(g: np.ndarray, width: int) -> np.ndarray:
    """A shingle counts, as its first in the passage, at the places from here to its own position."""
    order = np.argsort(g, axis=1, kind="stable")
    ranked = np.take_along_axis(g, order, 1)
    before = np.where(ranked[:, 1:] == ranked[:, :-1], order[:, :-1], -1)
    last = np.full(g.shape, -1, np.int64)
    np.put_along_axis(last, order[:, 1:], before, 1)
    return np.maximum(last + 1, np.arange(g.shape[1]) - width + 1).astype(np.int16)


def _pair(g: np.ndarray, width: int, least: float) -> float | None:
    """similar() of two rows; None if a row repeats a shingle, so that passages may have fewer than `width` different ones."""
    x, y = g.tolist()
    p, q = set(x) - {0}, set(y) - {0}
    if len(p) + x.count(0) < len(x) or len(q) + y.count(0) < len(y):
        return None
    common = 2 * width * least / (1 + least) - 1e-9
    if len(p & q) < common:
        return 0.0
    upto = [0, *accumulate(k in p for k in y)]
    places = [o for o in range(len(y) - width + 1) if upto[o + width] - upto[o] >= common]
    return similar(g[0], g[1], width, least, places)


def forest(doc: np.ndarray, root: np.ndarray, g: np.ndarray, width: int, least: float, joined: Joined) -> list[tuple[int, int, float]]:
    """Links (a, b, similarity) that join what similar passages join and neither roots nor earlier links do.

    A row is compared with all rows of other components, and then done with. Two similar passages have at least
    least / (1 + least) times as many different shingles in common as they have together; a bitmap of the shingles of one
    row, or first of all rows of a component, tells for all others at once where that may be, and those places are compared exactly.
    Of a passage, a similar one lacks at most a share of 1 - least, and less if there is no shorter one. So a row that
    has, at each place, more shingles than that which no other component has is done with unseen, and no longer counts for
    the others. What is left is sifted so again and again, as components grow."""
    comp = np.array([joined.find(x) for x in root.tolist()])
    if (comp == comp[0]).all():
        return []
    n, wide = g.shape
    places, share = wide - width + 1, least / (1 + least)
    if n == 2 and (alike := _pair(g, width, least)) is not None:
        if alike < least:
            return []
        joined.join(int(root[0]), int(root[1]))
        return [(int(doc.min()), int(doc.max()), alike)]
    begin = np.concatenate([_begins(g[k : k + CHUNK], width) for k in range(0, n, CHUNK)])
    end = np.minimum(np.arange(wide), places - 1) + 1

    def distinct(rows: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """How many different shingles of those hit each passage of the rows has."""
        if len(rows) > CHUNK:
            return np.concatenate([distinct(rows[k : k + CHUNK], hit[k : k + CHUNK]) for k in range(0, len(rows), CHUNK)])
        r, p = np.nonzero(hit & (begin[rows] < end))
        at = r * (places + 1)
        steps = np.bincount(at + begin[rows[r], p], minlength=len(rows) * (places + 1)) - np.bincount(at + end[p], minlength=len(rows) * (places + 1))
        return np.cumsum(steps.reshape(len(rows), places + 1), axis=1)[:, :-1].astype(np.int16)

    there = np.zeros((n, wide + 1), np.int16)
    np.cumsum(g == 0, axis=1, out=there[:, 1:])
    size = np.where(there[:, width:] == there[:, :-width], distinct(np.arange(n), g > 0), 0)
    least_size = np.where(size > 0, size, wide).min(axis=1)
    low = (g & np.uint32(0xFFFF)).astype(np.uint16)
    known, out = np.zeros(1 << 16, bool), []
    members: dict[int, np.ndarray] = {}
    by = np.argsort(comp, kind="stable")
    first = np.flatnonzero(np.r_[True, comp[by][1:] != comp[by][:-1]])
    for k, rows in zip(comp[by][first].tolist(), np.split(by, first[1:]), strict=True):
        members[k] = rows

    def sift(left: np.ndarray) -> np.ndarray:
        """The rows that may still be similar to one of another component, those of the largest component first."""
        while len(left):
            x, own = g[left], comp[left]
            flat = np.argsort(x, axis=None)
            token = x.ravel()[flat]
            run = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            whose = own[flat // wide]
            alone = np.empty(x.shape, bool)
            one = np.minimum.reduceat(whose, run) == np.maximum.reduceat(whose, run)
            alone.ravel()[flat] = np.repeat(one, np.diff(np.r_[run, len(flat)]))
            here = size[left]
            lacks = here - np.maximum(least * here, share * (here + np.where(here > 0, here, wide).min(axis=0)))
            may = ((here > 0) & (distinct(left, alone & (x > 0)) <= lacks + 1e-9)).any(axis=1)
            few = may.sum() > 0.9 * len(left)
            left = left[may]
            if few:
                break
        return left

    def smallest_first(left: np.ndarray) -> np.ndarray:
        _, kind, count = np.unique(comp[left], return_inverse=True, return_counts=True)
        return left[np.lexsort((kind, count[kind]))]

    def fits(rows: np.ndarray, those: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that may be similar to one of those, and at which places."""
        sizes = size[those]
        seen = low[those]
        known[seen] = True
        hit = known[low[rows]] & (g[rows] > 0)
        known[seen] = False
        some = np.flatnonzero(hit.sum(axis=1) >= share * (least_size[rows] + least_size[those].min()) - 1e-9)
        if not len(some):
            return rows[:0], np.empty((0, places), bool)
        rows = rows[some]
        at = (size[rows] > 0) & (sizes > 0).any(axis=0) & (distinct(rows, hit[some]) >= share * (size[rows] + np.where(sizes > 0, sizes, wide).min(axis=0)) - 1e-9)
        may = at.any(axis=1)
        return rows[may], at[may]

    left = np.flatnonzero((size > 0).any(axis=1))
    turns, wait, fresh = 0, SIFT, True
    if n < SIFT:
        wait = n + 1
    else:
        left = smallest_first(sift(left))
    while len(left):
        if turns >= wait:
            kept = sift(left)
            turns, wait = 0, SIFT if len(kept) < 0.9 * len(left) else 2 * wait
            left, fresh = smallest_first(kept), True
            continue
        turns += 1
        # One row of the largest component joins most of what is similar; then the small components have their turns.
        mine = np.arange(len(left)) == len(left) - 1 if fresh else comp[left] == comp[left[0]]
        rows, left = left[mine], left[~mine]
        fresh = False
        others = left[comp[left] != comp[rows[0]]]
        if not len(others):
            break
        others, at = fits(others, rows)
        if len(rows) > 1 and len(others):
            rows = fits(rows, others)[0]
        links = len(out)
        for i in rows.tolist() if len(others) else ():
            near = others[comp[others] != comp[i]]
            if not len(near):
                break
            if len(rows) > 1:
                near, at = fits(near, np.array([i]))
            else:
                at = at[comp[others] != comp[i]]
            for j, where in zip(near.tolist(), at, strict=True):
                if comp[j] == comp[i]:
                    continue
                s = similar(g[i], g[j], width, least, np.flatnonzero(where).tolist())
                if s >= least:
                    joined.join(int(root[i]), int(root[j]))
                    out.append((int(min(doc[i], doc[j])), int(max(doc[i], doc[j])), s))
                    a, b = sorted((int(comp[i]), int(comp[j])), key=lambda c: len(members[c]))
                    comp[members[a]] = b
                    members[b] = np.concatenate([members[b], members.pop(a)])
        if len(out) > links and n >= SIFT:
            left = smallest_first(left)
    return out


def _compare(width: int, least: float, block: int):
    """Passages (key, document, root, shingles) in order of key to links (a, b, similarity) and, of a key with over `block`, the passages with their block's number."""
    names = ["a", "b", "similarity", "part", "root", "g"]

    def links(doc: np.ndarray, root: np.ndarray, g: np.ndarray, joined: Joined) -> pa.RecordBatch | None:
        found = forest(doc, root, g, width, least, joined)
        if not found:
            return None
        a, b, s = zip(*found, strict=True)
        null = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), null, null, pa.nulls(len(a), pa.binary())], names)

    def over(key: int, doc: np.ndarray, root: np.ndarray, g: np.ndarray, part: int) -> pa.RecordBatch:
        n = len(doc)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(doc), pa.nulls(n, pa.float64()), pa.array(np.full(n, part, np.int64)), pa.array(root), suffixes.binary(g)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n, part, joined = None, [], 0, 0, Joined()

        def end() -> Iterator[pa.RecordBatch]:
            nonlocal held, n, part
            if n:
                own = [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else held[0]
                if part:
                    yield over(now, *own, part)
                elif n > 1 and (x := links(*own, joined)):
                    yield x
            held, n, part = [], 0, 0

        for b in batches:
            if not b.num_rows:
                continue
            key, doc, root, w = b.column("key").to_numpy(), b.column("doc_id").to_numpy(), b.column("root").to_numpy(), 2 * width - 1
            col = b.column("g").cast(pa.binary())
            g = np.frombuffer(col.buffers()[2], np.uint8)[col.offset * 4 * w :][: b.num_rows * 4 * w].view(np.uint32).reshape(-1, w)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist(), strict=True):
                if key[s] != now:
                    yield from end()
                    now = key[s]
                held.append((doc[s:e], root[s:e], g[s:e]))
                n += e - s
                while n > block:
                    own = [np.concatenate(x) for x in zip(*held, strict=True)]
                    yield over(now, *(x[:block] for x in own), part)
                    held, n, part = [tuple(x[block:] for x in own)], n - block, part + 1
        yield from end()

    return run


def near_passages(docs: DataFrame, words: int = WORDS, functions: int = FUNCTIONS, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(links, classes): links (a, b, similarity), and one row (doc_id, class_id, n_docs) for each document with a link.

    Two documents link if both hold a passage of `words` words, the two passages have the same min-hash under two
    functions, and, laid on each other at the first of these, have five-word shingles of a Jaccard similarity of `least`
    or more. class_id is the smallest document reachable, n_docs how many documents have it. The links returned connect
    all that link: copies link to the smallest of them, and within a signature a spanning forest stands for all pairs.
    Under f functions, two passages of similarity s have two in common with a chance of 1 - (1-s)^f - f s (1-s)^(f-1).
    Shorter, empty and null texts have no passage. Rows of one doc_id are one document, of which the excerpt verified is
    one row's; null ids are left out. Other columns are ignored; an empty table gives empty ones. Nodes and signatures are
    streamed in order, so a task's memory doesn't grow with a group; a signature of over `block` different passages of
    unconnected documents is compared by several tasks, each of which holds two blocks."""
    width = words - SHINGLE + 1
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nodes = rows.mapInArrow(_nodes(width, functions), "key long, whole long, around long, doc_id long, c int, shape int")
    order = ["key", "whole", "c", "doc_id"]
    shared = nodes.select(*order, "around", "shape").repartition("key").sortWithinPartitions(*order).mapInArrow(_shared, "doc_id long, key long, c int, shape int, around long, copy_of long")
    shared = common.stash(shared)
    common.release(docs.sparkSession)
    copies = shared.df.where("copy_of is not null").select(F.col("copy_of").alias("a"), F.col("doc_id").alias("b")).distinct()
    own = shared.df.where("copy_of is null").select("doc_id", "c", "key", "shape", "around").repartition("doc_id").sortWithinPartitions("doc_id", "c", "shape")
    signatures = own.mapInArrow(_signatures(width), "key long, around long, doc_id long, c int")
    found = common.stash(signatures.repartition("key").sortWithinPartitions("key", "around", "doc_id").mapInArrow(_equal, "a long, b long, key long, c int")).df
    common.release(docs.sparkSession)
    equal = common.stash(found.where("key is null").select("a", "b").union(copies).distinct()).df
    roots = common.stash(common.components(equal)).df
    asked = found.where("key is not null").select(F.col("a").alias("doc_id"), "key", "c").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    asked = common.stash(asked.select("doc_id", "key", "c", F.coalesce("root", "doc_id").alias("root"))).df
    apart = asked.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    by_doc = asked.join(apart, "key").groupBy("doc_id", "root").agg(F.collect_list(F.struct("key", "c")).alias("asked"))
    by_doc = common.stash(by_doc).df
    texts = rows.join(common.small(by_doc.select("doc_id")), "doc_id", "left_semi").join(by_doc, "doc_id")
    passages = texts.select("doc_id", "root", "text", "asked").mapInArrow(_excerpts(width), "key long, doc_id long, root long, g binary")
    schema = "a long, b long, similarity double, part long, root long, g binary"
    compared = common.stash(passages.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(width, least, block), schema)).df
    near = compared.where("part is null").select("a", "b", "similarity")
    large = compared.where("part is not null").select(F.col("a").alias("key"), F.col("b").alias("doc_id"), "root", "part", "g")
    if large.limit(1).count():
        parts = large.groupBy("key").agg((F.max("part") + 1).alias("n"))
        pairs = large.join(parts, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        # Each block meets itself as it meets another.
        job = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        dealt = pairs.where("part != other").select(job.alias("key"), "doc_id", "root", "g").repartition("key").sortWithinPartitions("key")
        near = near.union(dealt.mapInArrow(_compare(width, least, 1 << 62), schema).select("a", "b", "similarity"))
    near = common.stash(near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))).df
    links = equal.withColumn("similarity", F.lit(1.0)).unionByName(near).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    classes = common.components(links.select("a", "b")).select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"))
    return links, classes.join(classes.groupBy("class_id").agg(F.count("*").alias("n_docs")), "class_id").select("doc_id", "class_id", "n_docs")

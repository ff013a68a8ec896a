"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are four blocks of 16. Of two fingerprints with at most three differing bits, some block is
equal, and of the other 48 bits one half of 24 differs in one bit at most. 23 bits of each half are decoded with the
perfect binary Golay code: every 23-bit word lies within distance 3 of one codeword, and a word at distance 3 also
lies at distance 4 from five more. Those one or six codeword indices are the half's keys; words with at most two
differing bits have a key in common. Each fingerprint so gets (block, half, block value, codeword index) keys, 43 on
average; those who share a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, suffixes

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: Fingerprints of one key that a task compares by itself; a larger group is dealt out in pairs of blocks.
BLOCK = 131_072
#: Shingles unpacked to bits at once.
CHUNK = 100_000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, each syndrome's leader, and for leaders of weight 3 the five patterns of weight 4."""

    def rest(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - 11)
        return w

    bit = [rest(1 << i) for i in range(23)]
    low, high = np.zeros(4096, np.int32), np.zeros(2048, np.int32)
    for table, at, n in ((low, 0, 12), (high, 12, 11)):
        for w in range(1 << n):
            for i in range(n):
                if w >> i & 1:
                    table[w] ^= bit[at + i]
    leader, more = np.zeros(2048, np.int32), [[] for _ in range(2048)]
    for n in (1, 2, 3, 4):
        for where in combinations(range(23), n):
            s, e = 0, 0
            for i in where:
                s, e = s ^ bit[i], e | 1 << i
            if n < 4:
                leader[s] = e
            elif bin(leader[s]).count("1") == 3:
                more[s].append(e)
    extra = np.full((2048, 5), -1, np.int32)
    for s, found in enumerate(more):
        if found:
            extra[s] = found
    return low, high, leader, extra


LOW, HIGH, LEADER, EXTRA = _tables()


def golay_keys(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) for all the keys of 23-bit words."""
    w = w.astype(np.int32)
    s = LOW[w & 4095] ^ HIGH[w >> 12]
    far = np.flatnonzero(EXTRA[s, 0] >= 0)
    rows = np.concatenate([np.arange(len(w)), np.repeat(far, 5)])
    return rows, np.concatenate([(w ^ LEADER[s]) >> 11, ((w[far, None] ^ EXTRA[s[far]]) >> 11).ravel()])


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all the keys of 64-bit fingerprints."""
    fp = fp.view(np.uint64)
    blocks = [(fp >> np.uint64(16 * i)).astype(np.int64) & 0xFFFF for i in range(4)]
    rows, out = [], []
    for b in range(4):
        x, y, z = (blocks[i] for i in range(4) if i != b)
        for half, word in enumerate(((x << 8 | y >> 8) & 0x7FFFFF, ((y & 0xFF) << 16 | z) & 0x7FFFFF)):
            r, g = golay_keys(word)
            rows.append(r)
            out.append(((b * 2 + half) << 28 | blocks[b][r] << 12 | g).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """The 64-bit fingerprint of the words; 0 if there are none."""
    return int(fingerprints([words], shingle)[0])


def fingerprints(docs: list[list[bytes]], shingle: int = 3) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' XXH64 with seed 42."""
    h, out = xxhash.xxh64_digest, np.zeros(len(docs), np.uint64)
    digests, at, n = [], [], 0

    def flush() -> None:
        nonlocal digests, at, n
        if not n:
            return
        bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
        where = np.array([a for _, a in at])
        count = np.add.reduceat(bits, where, axis=0, dtype=np.int32)
        size = np.diff(np.append(where, n))[:, None]
        out[[d for d, _ in at]] = np.packbits(2 * count > size, axis=1).view(">u8").ravel()
        digests, at, n = [], [], 0

    for i, words in enumerate(docs):
        if not words:
            continue
        text = b" ".join(words)
        if len(words) < shingle:
            own = [h(text, 42)]
        else:
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            own = [h(text[a:b], 42) for a, b in zip((end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        if len(own) > CHUNK:
            count = sum(np.unpackbits(np.frombuffer(b"".join(own[k : k + CHUNK]), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(own), CHUNK))
            out[i] = np.packbits(2 * count > len(own)).view(">u8")[0]
            continue
        at.append((i, n))
        digests += own
        n += len(own)
        if n > CHUNK:
            flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row: A-Z in lower case, words split at ASCII white space, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.zeros(b.num_rows, np.uint64)
            part, size, first = [], 0, 0
            for i, t in enumerate(common.texts(b)):
                part.append(t.lower().split())
                size += len(t)
                if size > 4_000_000 or i == b.num_rows - 1:
                    fp[first : i + 1] = fingerprints(part, shingle)
                    part, size, first = [], 0, i + 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _tree(fp: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of fp's near pairs. Each fingerprint reached is compared with those not yet reached."""
    a, b, left = [], [], fp
    while len(left):
        todo, left = [left[:1]], left[1:]
        while todo and len(left):
            one = todo.pop()
            hit = np.bitwise_count(left ^ one) <= near
            if hit.any():
                found = left[hit]
                left = left[~hit]
                a.append(np.repeat(one, len(found)))
                b.append(found)
                todo.extend(found[i : i + 1] for i in range(len(found)))
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(key: np.ndarray, fp: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is near within each run of equal keys."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    a, b = [fp[:0]], [fp[:0]]
    few = np.repeat(size <= 16, size)
    for lag in range(1, min(16, int(size.max(initial=1)))):
        i = np.flatnonzero((key[lag:] == key[:-lag]) & few[lag:])
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= near]
        a.append(fp[i])
        b.append(fp[i + lag])
    for s, n in zip(start[size > 16], size[size > 16], strict=True):
        x, y = _tree(fp[s : s + n], near)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _compare(near: int, block: int):
    """Batches (key, fp), equal keys together, to edges (a, b, null) and, from groups over block, rows (key, fp, block number)."""

    def edges(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        a, b = links(k, f.view(np.uint64), near)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.uint64).view(np.int64)), pa.array(pairs[:, 1].astype(np.uint64).view(np.int64)), pa.nulls(len(pairs), pa.int64())], ["a", "b", "part"])

    def over(k: np.ndarray, f: np.ndarray, part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(f), pa.array(np.full(len(k), part, np.int64))], ["a", "b", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, f, part = np.empty(0, np.int64), np.empty(0, np.int64), 0  # the last key's rows so far; its blocks passed on
        for batch in batches:
            k = np.concatenate([k, batch.column(0).to_numpy()])
            f = np.concatenate([f, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut and part:
                own = int(np.searchsorted(k, k[0], "right"))
                yield over(k[:own], f[:own], part)
                k, f, cut, part = k[own:], f[own:], cut - own, 0
            if cut:
                yield edges(k[:cut], f[:cut])
                k, f = k[cut:], f[cut:]
            while len(k) > block:
                yield over(k[:block], f[:block], part)
                k, f, part = k[block:], f[block:], part + 1
        if part:
            yield over(k, f, part)
        elif len(k):
            yield edges(k, f)

    return run


def near_pairs(fps: DataFrame, near: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all those linked at near bits or fewer, near at most 3.

    Per key a spanning forest is returned, not all pairs. A key's group over `block` fingerprints is cut into blocks,
    and each pair of blocks is compared in a task of its own, so no task holds more than twice that many."""
    if near > 3:
        raise ValueError("the keys hold for at most 3 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for i in range(0, len(fp), 20_000):
                part = np.ascontiguousarray(fp[i : i + 20_000])
                r, k = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], ["key", "fp"])

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = common.stash(keyed.mapInArrow(_compare(near, block), "a long, b long, part long"))
    out = found.df.where("part is null").select("a", "b")
    large = found.df.where("part is not null").select(F.col("a").alias("key"), F.col("b").alias("fp"), "part")
    if large.limit(1).count():
        parts = large.groupBy("key").agg((F.max("part") + 1).alias("n"))
        pairs = large.join(parts, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        job = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        dealt = pairs.select(job.alias("key"), "fp").repartition("key").sortWithinPartitions("key")
        out = out.union(dealt.mapInArrow(_compare(near, 1 << 62), "a long, b long, part long").select("a", "b"))
    return out.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, near: int = 3) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per row of docs.

    fingerprint: 16 hexadecimal digits. Fingerprints link at `near` or fewer differing bits; component_id is the
    smallest doc_id reachable. Texts that are null, empty or white space have fingerprint zero, linked like any other.
    Rows of one doc_id each give a row. A null doc_id stays null and doesn't count as smallest; a group of only such
    rows has a null component_id. Other columns are ignored; an empty table gives an empty one."""
    own = common.stash(with_fingerprints(docs, id_col, text_col, shingle)).df
    fps = common.stash(own.groupBy("fp").agg(F.min("doc_id").alias("first"))).df
    roots = common.stash(common.components(near_pairs(fps, near))).df
    least = roots.join(fps, roots.node == fps.fp).groupBy("root").agg(F.min("first").alias("least"))
    joined = roots.join(least, "root").select(F.col("node").alias("fp"), "least")
    found = fps.join(joined, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return own.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _codewords() -> np.ndarray:
    """Half of the extended Golay code's words as signs, 24 by 2048: the others are these with all signs turned."""
    words = []
    for m in range(2048):
        w = m << 11
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - 11)
        w = (m << 11 | w) << 1
        words.append([1 - 2 * (b >> i & 1) for b in (w | bin(w).count("1") & 1,) for i in range(24)])
    return np.array(words, np.float32).T


CODE = _codewords()
#: Fingerprints of the near-duplicate stage: segments of 24 bits, and codewords each is decoded to. Two segments make a table's key.
SEGMENTS, LIST = 8, 3
#: Two shingle sets of similarity 0.8 differ in 29 of 192 bits, give or take 5; pairs of more than 44 aren't looked at.
WIDE_NEAR = 44
WIDTH = 5
#: Shingles whose 192 bits are unpacked at once.
WIDE_CHUNK = 10_000
#: Fingerprints decoded at once; a worker holds several numbers for each one's 2,048 codewords a segment.
DECODED = 16


def shingle_sets(docs: list[np.ndarray], shingle: int = WIDTH) -> list[np.ndarray]:
    """The different shingles' hashes of each sequence of word hashes, in order; of fewer words, the whole sequence's."""
    return [np.unique(common.grams(h, min(shingle, len(h)))) if len(h) else np.empty(0, np.uint64) for h in docs]


def wide_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints of three 64-bit words, keys) of non-empty sets of shingles.

    A segment is decoded softly: from how far each of its bits is from a tie come the LIST likeliest codewords. Keys of a
    table are all pairs of its two segments' codewords."""
    n = len(sets)
    balance = np.zeros((n, 24 * SEGMENTS), np.float32)
    size = np.array([len(x) for x in sets], np.int64)
    i = 0
    while i < n:
        e = max(i + 1, int(np.searchsorted(np.cumsum(size[i:]), WIDE_CHUNK, "right")) + i)
        flat = np.concatenate(sets[i:e]) if e > i + 1 else sets[i]
        total = np.zeros((e - i, 24 * SEGMENTS), np.int64)
        for k in range(0, len(flat), WIDE_CHUNK):  # a long text's shingles take several turns
            part = flat[k : k + WIDE_CHUNK]
            bits = np.unpackbits(np.stack([common.mix(part + np.uint64(0xA0761D6478BD642F * (j + 1) & 0xFFFFFFFFFFFFFFFF)) for j in range(3)], 1).view(np.uint8), axis=1)
            if e == i + 1:
                total[0] += bits.sum(axis=0, dtype=np.int64)
            else:
                total[:] = np.add.reduceat(bits, np.cumsum(size[i:e]) - size[i:e], axis=0, dtype=np.int32)
        balance[i:e] = 2 * total - size[i:e, None]
        i = e
    fp = np.packbits(balance > 0, axis=1).view(np.uint64)
    own = np.empty((n, SEGMENTS, LIST), np.int64)
    for i in range(0, n, DECODED):
        part = balance[i : i + DECODED].reshape(-1, 24) @ CODE
        top = np.argpartition(-np.abs(part), LIST, axis=1)[:, :LIST]
        turned = np.take_along_axis(part, top, 1) < 0
        own[i : i + DECODED] = (top + 2048 * turned).reshape(-1, SEGMENTS, LIST)
    x, y = own[:, ::2, :, None], own[:, 1::2, None, :]
    table = np.arange(SEGMENTS // 2)[None, :, None, None]
    return fp, (table << 24 | x << 12 | y).reshape(n, -1)


def _within(fp: np.ndarray, one: np.ndarray, near: int) -> np.ndarray:
    return np.bitwise_count(fp ^ one).sum(axis=-1, dtype=np.int16) <= near


def _forest(n: int, fits) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of 0..n-1, where fits(i, rest) tells which of rest link to i. Each one reached is asked for all not yet reached."""
    out, left = [], np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = fits(i, left)
            if hit.any():
                found, left = left[hit], left[~hit]
                out.append((np.full(len(found), i), found))
                todo += found.tolist()
    return out


def _candidates(near: int):
    """Edges of rows (key, node, fp) in order of key: forests of those within `near` bits."""

    def solve(key: np.ndarray, node: np.ndarray, fp: np.ndarray, sets) -> np.ndarray:
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.append(start, len(key)))
        few, found = np.repeat(size <= 16, size), []
        for lag in range(1, min(16, int(size.max(initial=1)))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & few[lag:])
            i = i[_within(fp[i], fp[i + lag], near)]
            found.append((node[i], node[i + lag]))
        for s, n in zip(start[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            f = fp[s : s + n]
            found += [(node[s + a], node[s + b]) for a, b in _forest(n, lambda i, rest: _within(f[rest], f[i], near))]  # noqa: B023
        return np.concatenate([np.stack(x, 1) for x in found]) if found else np.empty((0, 2), np.int64)

    return solve


def _verified(near: int, least: float):
    """Edges of rows (key, node, fp, shingles) in order of key: forests of those of a Jaccard similarity of `least` or more."""

    def solve(key: np.ndarray, node: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        own = np.sort(np.unique(np.stack([key, node], 1), axis=0, return_index=True)[1])  # repeated rows say the same
        key, node, fp, sets = key[own], node[own], fp[own], [sets[i] for i in own]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count, found = np.array([len(x) for x in sets]), []
        for s, e in zip(start.tolist(), np.append(start[1:], len(key)).tolist(), strict=True):

            def fits(i: int, rest: np.ndarray) -> np.ndarray:
                one, other = sets[s + i], count[s + rest]  # noqa: B023
                may = _within(fp[s + rest], fp[s + i], near) & (np.minimum(other, len(one)) >= least * np.maximum(other, len(one)))  # noqa: B023
                may = np.flatnonzero(may)
                out = np.zeros(len(rest), bool)
                for k in range(0, len(may), 500):
                    own = may[k : k + 500]
                    flat = np.concatenate([sets[s + j] for j in rest[own]])  # noqa: B023
                    same = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
                    shared = np.add.reduceat(same, np.cumsum(other[own]) - other[own], dtype=np.int64)
                    out[own] = shared >= least * (len(one) + other[own] - shared) - 1e-9
                return out

            found += [(node[s + a], node[s + b]) for a, b in _forest(e - s, fits)]
        return np.concatenate([np.stack(x, 1) for x in found]) if found else np.empty((0, 2), np.int64)

    return solve


def _runs(solve, rows: int, size: int):
    """Rows (key, node, fp, shingles) in order of key to edges (a, b) by solve; a key with more than so many rows or bytes of
    shingles goes out again in blocks, with their number."""
    names = ["a", "b", "part", "fp", "shingles"]

    def edges(t: pa.Table) -> pa.RecordBatch:
        data = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()] if len(t) and t.column("shingles")[0].is_valid else None
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(-1, 3)
        x = solve(t.column("key").to_numpy(), t.column("node").to_numpy(), fp, data)
        x = np.unique(np.sort(x, axis=1), axis=0)
        null = pa.nulls(len(x), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.nulls(len(x), pa.int64()), null, null], names)

    def over(t: pa.Table, part: int) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("node"), pa.array(np.full(b.num_rows, part, np.int64)), b.column("fp"), b.column("shingles")], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone, part = None, None, 0  # rows not yet worked on; the key whose blocks have gone out, and how many
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            held = pa.concat_tables([held, t]) if held is not None else t
            if part:
                own = int(np.searchsorted(held.column("key").to_numpy(), gone, "right"))
                if own < held.num_rows:
                    yield from over(held.slice(0, own), part)
                    held, part = held.slice(own), 0
            key, large = held.column("key").to_numpy(), held.num_rows > rows or held.nbytes > size
            cut = int(np.searchsorted(key, key[-1]))
            if cut and (cut > 2000 or large):
                yield edges(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
            elif large:
                yield from over(held, part)
                held, gone, part = None, key[0], part + 1
        if held is not None and held.num_rows:
            if part:
                yield from over(held, part)
            else:
                yield edges(held)

    return run


EDGES = "a long, b long, part long, fp binary, shingles binary"


def _links(rows: DataFrame, solve, block: int, size: int) -> DataFrame:
    """Distinct edges (a, b) of rows (key, node, fp, shingles). Each pair of blocks of a large key is a task of its own."""
    found = common.stash(rows.repartition("key").sortWithinPartitions("key").mapInArrow(common.frugal(_runs(solve, block, size)), EDGES)).df
    out = found.where("part is null").select("a", "b")
    large = found.where("part is not null").select(F.col("a").alias("key"), F.col("b").alias("node"), "part", "fp", "shingles")
    if large.limit(1).count():
        parts = large.groupBy("key").agg((F.max("part") + 1).alias("n"))
        pairs = large.join(parts, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        job = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
        dealt = pairs.select(job.alias("key"), "node", "fp", "shingles").repartition("key").sortWithinPartitions("key")
        out = out.union(dealt.mapInArrow(_runs(solve, 1 << 62, 1 << 62), EDGES).select("a", "b"))
    return out.where("a != b").distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, block: int = 20_000, size: int = 64_000_000) -> DataFrame:
    """docs with one document of each group: that with the smallest id, null last.

    Two texts link if their sets of five-word shingles (A-Z in lower case, words split at ASCII white space; of fewer words,
    the whole text) have a Jaccard similarity of `least` or more; a group is what links connect. Texts of the same words
    are one class, whatever white space and case they have, and so are texts without words. Classes whose 192-bit
    fingerprints share a key and differ in at most WIDE_NEAR bits are candidates; of what candidates connect, each
    text's shingles go to one task, where a forest of links is verified by exact similarity, so no text is removed
    by its fingerprint alone. The chance to find a pair of similarity 0.8 by a key is about 0.96, and grows with it.

    Rows are told apart by id and text: rows of one id with different texts are documents of their own, those of the
    same id and text are copies. Rows with a null id are documents too; null texts are empty. Other columns come along
    unchanged; an empty table gives an empty one. Groups of over `block` texts or `size` bytes of shingles are compared
    by pairs of blocks, each a task. Narrow rows decide; texts are read twice, but moved only where there are too many
    candidates, or removals, for a broadcast (common.small)."""
    spark = docs.sparkSession
    raw = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for b in batches:
            at = 0
            for own, h, begin in suffixes.word_groups(b, words, "id"):
                sets = shingle_sets([h[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)])
                some = [i for i, x in enumerate(sets) if len(x)]
                fp, keys = np.zeros((len(sets), 3), np.uint64), [[] for _ in sets]
                if some:
                    fp[some], k = wide_fingerprints([sets[i] for i in some])
                    for i, x in zip(some, k.tolist(), strict=True):
                        keys[i] = x
                told = [xxhash.xxh3_128_digest(h[x:y].tobytes()) for x, y in zip(begin[:-1], begin[1:], strict=True)]
                same = np.frombuffer(b"".join(told), np.int64).reshape(-1, 2)
                part = b.slice(at, len(own))
                at += len(own)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("raw"), pa.array(same[:, 0]), pa.array(same[:, 1]), suffixes.binary(fp), pa.array(keys, pa.list_(pa.int64()))], ["id", "raw", "h1", "h2", "fp", "keys"])

    with common.batches(spark):
        own = common.stash(rows.select("id", raw.alias("raw"), "text").mapInArrow(common.frugal(narrow), "id long, raw long, h1 long, h2 long, fp binary, keys array<bigint>"))
    first = F.min(F.struct(F.col("id").isNull().alias("x"), "id", "raw")).alias("first")
    classes = own.df.groupBy("h1", "h2").agg(first, F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("rows"))
    classes = common.stash(classes.select("h1", "h2", "first", "fp", "keys", "rows", F.monotonically_increasing_id().alias("node")))
    keyed = classes.df.select(F.explode("keys").alias("key"), "node", "fp", F.lit(None).cast("binary").alias("shingles"))
    near = common.stash(common.components(_links(keyed, _candidates(WIDE_NEAR), 131_072, 1 << 40)))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for b in batches:
            at = 0
            for found, h, begin in suffixes.word_groups(b, words, "id"):
                sets = shingle_sets([h[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)])
                part = b.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("node"), part.column("fp"), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "node", "fp", "shingles"])

    asked = near.df.join(classes.df.select("node", "first", "fp"), "node").select(F.col("root").alias("key"), "node", "fp", F.col("first.id").alias("f_id"), F.col("first.raw").alias("f_raw"))
    asked = common.stash(asked)
    texts = rows.select("id", raw.alias("raw"), "text").join(common.small(asked.df), F.col("id").eqNullSafe(F.col("f_id")) & (F.col("raw") == F.col("f_raw")))
    texts = texts.select("id", "text", "key", "node", "fp").mapInArrow(common.frugal(sets_of), "key long, node long, fp binary, shingles binary")
    with common.batches(spark):
        linked = common.stash(common.components(_links(texts, _verified(WIDE_NEAR, least), block, size)))
    led = linked.df.join(classes.df.select("node", "first"), "node")
    gone = led.join(led.groupBy("root").agg(F.min("first").alias("least")), "root").where("first != least").select("node", F.lit(True).alias("gone"))
    marked = common.stash(classes.df.join(gone, "node", "left").where("gone or rows > 1").select("h1", "h2", "first", F.coalesce("gone", F.lit(False)).alias("gone")))
    # Of these classes all rows of those that go, and of the others all but the first, are removed.
    out_id, out_raw = common.fresh(docs, "out_id", "out_raw")
    stays = F.max(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("raw") == F.col("first.raw")) & ~F.col("gone")).alias("stays")
    told = own.df.join(common.small(marked.df), ["h1", "h2"]).groupBy("id", "raw").agg(stays, F.count("*").alias("n")).where("not stays or n > 1")
    told = common.stash(told.select(F.col("id").alias(out_id), F.col("raw").alias(out_raw), "stays"))
    this = F.col(id_col).cast("long").eqNullSafe(F.col(out_id)) & (raw == F.col(out_raw))
    single = docs.join(common.small(told.df.select(out_id, out_raw)), this, "left_anti")
    twice = told.df.where("stays").select(out_id, out_raw)  # of rows that are the same in id and text, one stays
    if twice.limit(1).count():
        one = docs.join(common.small(twice), this).dropDuplicates([out_id, out_raw])
        single = single.unionByName(one.select(*docs.columns))
    common.drop(spark, own, classes, near, asked, linked, marked)
    return single

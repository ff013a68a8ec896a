"""Repeated passages by sparse suffix arrays.

Of each document's suffixes those at minimiser positions are kept: a position whose k-word hash is the smallest of some
`window` successive ones. A passage of k + window - 1 = 50 words has one such position of its own, the same wherever the
passage stands. A kept suffix carries its k-word hash and, for the match's extension left and right, a 64-bit hash of
each passage whose position it is, over the full 64-bit hashes of all its words. Suffixes are sorted by k-word hash;
within a run of equal ones the passages of all suffixes are compared. Each passage is sent and compared once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

K = 10
#: Suffixes of one hash that a task compares by itself; the passages of a larger run are aggregated by Spark.
RUN = 60_000


def minimisers(values: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the smallest value, the leftmost if equal, of some `window` successive ones."""
    last = np.uint64(0xFFFFFFFFFFFFFFFF)
    u = np.where(valid, values >> np.uint64(32) << np.uint64(32) | np.arange(len(values), dtype=np.uint64), last)
    if len(u) < window:
        u = np.append(u, np.full(window - len(u), last))
    size = 1
    while 2 * size <= window:
        u = np.minimum(u[:-size], u[size:])
        size *= 2
    if size < window:
        u = np.minimum(u[: len(u) - (window - size)], u[window - size :])
    u = u[np.r_[True, u[1:] != u[:-1]]]
    return np.unique((u[u != last] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def word_groups(batch: pa.RecordBatch, words: common.Words, ids: str = "doc_id") -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes of several documents one after the other, where each begins and the last ends), A-Z in lower case."""
    own, parts, begin = [], [], [0]
    for i, (d, t) in enumerate(zip(batch.column(ids).to_pylist(), common.texts(batch), strict=True)):
        h = words.hashes(t.lower().split())
        own.append(d)
        parts.append(h)
        begin.append(begin[-1] + len(h))
        if begin[-1] > 300_000 or i == batch.num_rows - 1:
            yield own, np.concatenate(parts), np.array(begin)
            own, parts, begin = [], [], [0]


def binary(rows: np.ndarray) -> pa.Array:
    """A row's bytes each."""
    rows = np.ascontiguousarray(rows)
    n = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * n).astype(np.int32)), pa.py_buffer(rows)])


def smallest(values: np.ndarray, window: int) -> np.ndarray:
    """For each `window` successive values where the smallest stands, the leftmost if their high halves are equal."""
    u = values >> np.uint64(32) << np.uint64(32) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        u = np.minimum(u[:-size], u[size:])
        size *= 2
    if size < window:
        u = np.minimum(u[: len(u) - (window - size)], u[window - size :])
    return (u & np.uint64(0xFFFFFFFF)).astype(np.int64)


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each `length` successive words' hashes."""
    base = 0x9E3779B97F4A7C15
    power, back = np.full(len(h), base, np.uint64), np.full(len(h) - length + 1, pow(base, -1, 1 << 64), np.uint64)
    power[:1] = back[:1] = 1
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(common.mix(h.view(np.uint64)) * np.multiply.accumulate(power), out=sums[1:])
    return common.mix((sums[length:] - sums[:-length]) * np.multiply.accumulate(back))


def _suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.Words()
        for b in batches:
            for own, h, begin in word_groups(b, words):
                if len(h) < length:
                    continue
                doc = np.repeat(np.arange(len(own)), np.diff(begin))
                g = common.grams(h, K)
                i = np.arange(len(h) - length + 1)
                i = i[i + length <= begin[1:][doc[: len(i)]]]  # passages within one document
                if not len(i):
                    continue
                at, passage = smallest(g, length - K + 1)[i], rolling(h, length)[i]
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                size = np.diff(np.append(first, len(i)))
                key, d, first, last, size, passage = _chains(g[at[first]], doc[i[first]], i[first], size, passage, length)
                upto = np.append(0, np.cumsum(size))
                ids = np.array(own, np.int64)
                for k in range(0, len(key), 20_000):
                    s = slice(k, k + 20_000)
                    offsets = upto[k : k + 20_001]
                    flat = passage[offsets[0] : offsets[-1]]
                    data = pa.Array.from_buffers(pa.binary(), len(key[s]), [None, pa.py_buffer(((offsets - offsets[0]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                    start, end = ((x[s] - begin[d[s]]).astype(np.int32) for x in (first, last))
                    yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), pa.array(ids[d[s]]), pa.array(start), pa.array(end), data], ["key", "doc_id", "first", "last", "passages"])

    return run


def _chains(key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, passage: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, document, first start, last start, number of passages, passages) of chains: suffixes of one document with the
    same passages, each at most `length` after the one before. Equal passages of a chain join, so periodic text makes one row."""
    begin = np.cumsum(size) - size
    within = np.arange(len(passage)) - np.repeat(begin, size)
    seen = common.mix(np.add.reduceat(common.mix(passage + within.astype(np.uint64)), begin) ^ key)
    order = np.lexsort((start, seen, doc))
    p, s, d = start[order], seen[order], doc[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (np.diff(p) > length)]
    first = np.flatnonzero(new)
    lead, last = order[first], p[np.append(first[1:], len(p)) - 1]
    return key[lead], doc[lead], start[lead], last, size[lead], passage[common.ranges(begin[lead], size[lead])]


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, source: np.ndarray) -> pa.RecordBatch:
    """Passages, joined where they follow on each other."""
    earlier = (source < doc).astype(np.int64)
    order = np.lexsort((start, earlier, doc))
    doc, start, end, source, earlier = (x[order] for x in (doc, start, end, source, earlier))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (earlier[1:] != earlier[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(source, first) if len(doc) else source
    high = np.maximum.reduceat(end, first) if len(doc) else end
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(start[first].astype(np.int64)), pa.array(high.astype(np.int64)), pa.array(low), pa.nulls(len(first), pa.int64())], ["doc_id", "start", "end", "source", "hash"])


class Rows(NamedTuple):
    key: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    upto: np.ndarray  # where each row's passages begin, and the last one's end
    passage: np.ndarray

    @staticmethod
    def of(b: pa.RecordBatch) -> Rows:
        data = b.column("passages").cast(pa.binary())
        upto = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 8
        flat = np.frombuffer(data.buffers()[2] or b"", np.uint64, int(upto[-1])) if upto[-1] else np.empty(0, np.uint64)
        return Rows(*(b.column(c).to_numpy() for c in ("key", "doc_id", "first", "last")), upto - upto[0], flat[upto[0] :])

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        size = np.concatenate([np.diff(x.upto) for x in parts])
        return Rows(*(np.concatenate([x[i] for x in parts]) for i in range(4)), np.append(0, np.cumsum(size)), np.concatenate([x.passage for x in parts]))

    def cut(self, a: int, e: int) -> Rows:
        u = self.upto[a : e + 1]
        return Rows(*(x[a:e] for x in self[:4]), u - u[0], self.passage[u[0] : u[-1]])

    def spread(self, length: int) -> tuple[np.ndarray, ...]:
        """(document, start, end, hash) of each passage."""
        size = np.diff(self.upto)
        row = np.repeat(np.arange(len(size)), size)
        o = np.arange(len(row)) - self.upto[row]
        return self.doc[row], self.first[row] + o, self.last[row] + o + length, self.passage


def _neighbours(length: int, most: int):
    """Suffixes in order of key to spans (doc_id, start, end, source, null); of runs over `most`, all passages with their hash."""

    def resolved(x: Rows) -> pa.RecordBatch | None:
        eq = x.key[1:] == x.key[:-1]
        same = np.flatnonzero(np.r_[False, eq] | np.r_[eq, False])
        size = np.diff(x.upto)[same]
        x = Rows(*(c[same] for c in x[:4]), np.append(0, np.cumsum(size)), x.passage[common.ranges(x.upto[same], size)])
        doc, start, end, h = x.spread(length)
        if not len(h):
            return None
        order = np.argsort(h)
        doc, start, end, h = doc[order], start[order], end[order], h[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        size = np.diff(np.append(first, len(h)))
        hit = np.repeat(low < high, size)
        return _spans(doc[hit], start[hit], end[hit], np.repeat(low, size)[hit])

    def raw(x: Rows) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(x.key), 10_000):
            doc, start, end, h = x.cut(i, min(i + 10_000, len(x.key))).spread(length)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64)), pa.nulls(len(h), pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "start", "end", "source", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        count, over = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            own = Rows.of(b)
            if over is not None:
                cut = int(np.searchsorted(own.key, over, "right"))
                yield from raw(own.cut(0, cut))
                own = own.cut(cut, len(own.key))
                if not len(own.key):
                    continue
                over = None
            held.append(own)
            count += len(own.key)
            if count >= 30_000:
                rows = Rows.joined(held)
                cut = int(np.searchsorted(rows.key, rows.key[-1]))
                if cut and (x := resolved(rows.cut(0, cut))):
                    yield x
                rest = rows.cut(cut, len(rows.key))
                if len(rest.key) > most:
                    over = rest.key[0]
                    yield from raw(rest)
                    held, count = [], 0
                else:
                    held, count = [Rows(*(c.copy() for c in rest))], len(rest.key)
        if held and (x := resolved(Rows.joined(held))):
            yield x

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order of doc_id to a row for each document."""

    def rows(t: pa.Table) -> pa.RecordBatch:
        out: list[tuple] = []
        docs = t.column("doc_id").to_numpy()
        cols = [t.column(c).to_numpy() for c in ("start", "end", "source")]
        first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        for a, e in zip(first, np.append(first[1:], len(docs)), strict=True):
            own, d = sorted(zip(*(c[a:e].tolist() for c in cols), strict=True)), int(docs[a])
            both: list[list[list[int]]] = [[], []]
            for start, end, source in own:
                for kind in (0, 1) if source < d else (0,):
                    x = both[kind]
                    if x and start <= x[-1][1]:
                        x[-1][1] = max(x[-1][1], end)
                    else:
                        x.append([start, end])
            out.append((d, *(sum(y - x for x, y in k) for k in both), *(",".join(f"{x}:{y}" for x, y in k) for k in both), min(s for *_, s in own)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "repeated_words", "later_words", "repeated", "later", "source"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
            t = pa.Table.from_batches(held)
            d = t.column("doc_id").to_numpy()
            cut = int(np.searchsorted(d, d[-1]))
            if cut:
                yield rows(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield rows(pa.Table.from_batches(held))


def repeated_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """A row for each document that has a passage of `length` words or more which another document has too.

    repeated: its spans, start:end in words (A-Z in lower case, split at ASCII white space), end exclusive, joined where they meet or overlap;
    later: those parts of which a smaller doc_id has a copy, which a deduplication would take out; repeated_words and
    later_words: how many words these are; source: the smallest doc_id that shares one. A passage that only its own document repeats
    doesn't count. Null, empty and shorter texts have none. Rows of one doc_id are one document; null ids are left out,
    as nothing can name them. Other columns are ignored; an empty table gives an empty one.
    Passages are equal if 64-bit hashes of their words' hashes are: two different ones are taken for equal with a chance of
    one in 2^64 a pair. Documents send one row per 21 words or so, with 8 bytes a word. A task compares runs of at most `run` suffixes of one hash; the passages
    of longer runs are counted by a grouped aggregation, so a passage that a third of all documents share fits too."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kept = rows.mapInArrow(_suffixes(length), "key long, doc_id long, first int, last int, passages binary")
    found = kept.repartition("key").sortWithinPartitions("key").mapInArrow(_neighbours(length, run), "doc_id long, start long, end long, source long, hash long")
    found = common.stash(found).df
    spans = found.where("hash is null").drop("hash")
    large = found.where("hash is not null").drop("source")
    if large.limit(1).count():
        shared = large.groupBy("hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("high")).where("source < high")
        spans = spans.union(large.join(shared, "hash").select("doc_id", "start", "end", "source"))
    return spans.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_merge, "doc_id long, repeated_words long, later_words long, repeated string, later string, source long")


def cut(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of their later spans; a text that changes has single spaces. Documents without such a span stay as they are."""
    own, later = common.fresh(docs, "own_id", "later")
    found = passages.where("later != ''").select(F.col("doc_id").alias(own), F.col("later").alias(later))
    word = F.split(F.trim(F.regexp_replace(text_col, r"[ \t-\r]+", " ")), " ")
    spans = F.transform(F.split(later, ","), lambda s: F.transform(F.split(s, ":"), lambda x: x.cast("int")))
    outside = F.filter(F.sequence(F.lit(0), F.size(word) - 1), lambda i: ~F.exists(spans, lambda s: (s[0] <= i) & (i < s[1])))
    text = F.when(F.col(later).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(outside, lambda i: word[i]), " "))
    return docs.join(found, F.col(id_col) == F.col(own), "left").withColumn(text_col, text).select(*docs.columns)

"""What the operators share: tables in the shared folder, size-checked broadcasts, components, words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import storage

#: Rows with texts that go to a Python worker at once.
BATCH_ROWS = 1000
#: At most this many narrow rows (ids, hashes) are broadcast: about 64 MB in an executor. More take a shuffle join.
BROADCAST_ROWS = 1_000_000


Stash = storage.Table
shared_dir = storage.shared_dir
stash = storage.save


def drop(spark: SparkSession, *stashes: Stash) -> None:
    """Delete tables that nothing reads any more."""
    for s in stashes:
        storage.delete(spark, s)


def frugal(run):
    """run(batches), after which a Python worker, which lives on, gives back what it no longer uses."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs inside sends its Python workers at most so many rows at once: the executor and the worker hold a batch each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    now = int(before)
    spark.conf.set(key, str(min(rows, now) if now > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df has it."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        out.append(name)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is written and read no more: it does so as the driver collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, which are counted; else df, for a shuffle join.

    df must be cheap to compute twice, such as a stash."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, root), root being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge changes: rounds grow with the
    logarithm of the longest path, each moves at most as many rows as there are edges, and minima are pre-aggregated.
    Null ends and loops are ignored; no edges give an empty table. Each round is written to the shared folder."""
    spark = edges.sparkSession
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stash(edges.where("a != b").select(u, v).distinct())

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(now.df)
    while seen[0]:
        e = now.df
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        step = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        then = stash(step)
        drop(spark, now)
        now, before, seen = then, seen, digest(then.df)
        if seen == before:
            break
    e = now.df
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


class Words:
    """64-bit hashes of words (bytes), kept for the words met lately: at most `most` of them."""

    def __init__(self, most: int = 250_000):
        self.most, self.known = most, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            h = xxhash.xxh64_intdigest
            for w in set(words).difference(known):
                known[w] = h(w) - (1 << 63)
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The texts as UTF-8; null is empty. One at a time, from the batch's own buffer."""
    for x in batch.column(column).cast(pa.large_binary()):
        yield x.as_py() or b""


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers, wrapping."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of word hashes: as many as len(h) - n + 1, or none."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    x = h.view(np.uint64) if h.dtype == np.int64 else h
    m = len(x) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[i : i + m]
    return mix(out)


def row_hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of unsigned integers of up to 32 bits."""
    weight = np.random.default_rng(5).integers(0, 1 << 63, x.shape[1], np.uint64) | np.uint64(1)
    return mix((mix(x.astype(np.uint64) + np.arange(x.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)) * weight).sum(axis=1, dtype=np.uint64))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., start[0] + size[0] - 1, start[1], ..."""
    upto = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)

"""Best-fit packing of documents into sequences of fixed length, with conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, piece long, start long, length long, bin long, offset long"


def best_fit(length: list[int], source: list[int], cluster: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece. source and cluster are small numbers, or -1 for none.

    Longest first. Open bins are ordered by residual; each carries a bitmap of the sources and one of the clusters it
    holds. From the successor of the piece's length on, the first bin without its source and cluster is the tightest
    that may take it; if there is none, a new bin opens."""
    bins, offsets = [0] * len(length), [0] * len(length)
    order: list[int] = []  # residual << 32 | bin
    held: list[tuple[int, int]] = []
    for i in sorted(range(len(length)), key=lambda i: (-length[i], i)):
        n = length[i]
        s = 1 << source[i] if source[i] >= 0 else 0
        c = 1 << cluster[i] if cluster[i] >= 0 else 0
        for at in range(bisect_left(order, n << 32), len(order)):
            b = order[at] & 0xFFFFFFFF
            if not (held[b][0] & s or held[b][1] & c):
                left = order.pop(at) >> 32
                break
        else:
            b, left = len(held), capacity
            held.append((0, 0))
        held[b] = held[b][0] | s, held[b][1] | c
        bins[i], offsets[i] = b, capacity - left
        if left > n:
            insort(order, (left - n) << 32 | b)
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 8192, shard_rows: int = 8192, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None, cluster_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and length in the document, bin, offset in the bin.

    Lengths are those of length_col, else UTF-8 bytes (the tokens of a byte-level model). A document longer than the
    capacity is cut into pieces of it and a rest. No bin holds two pieces of one source or of one cluster (cluster_col,
    else equal texts), nor more than the capacity. Pieces are dealt by hash of id and number to shards of about shard_rows, which are
    packed apart, so no task holds more, whatever a source or cluster has; each shard leaves at most its last bins
    looser than one packing of everything would.
    A null or empty text is one piece of length 0 without a cluster; a null source doesn't conflict; null and repeated
    ids are packed like others; other columns are ignored; an empty table gives an empty one."""
    length = F.col(length_col).cast("long") if length_col else F.octet_length(text_col).cast("long")
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.when(F.octet_length(text_col) > 0, F.xxhash64(text_col))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).alias("n"), F.xxhash64(F.col(source_col)).alias("h"), F.col(source_col).isNotNull().alias("has"), F.xxhash64(cluster).alias("c"), cluster.isNotNull().alias("dup"))
    count = F.greatest(F.ceil(F.col("n") / capacity), F.lit(1)).cast("long")
    total = own.agg(F.sum(count)).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    # By hash, so that input splits don't matter; rows without an id by chance, as all of them may be the same.
    shard = F.when(F.col("doc_id").isNull(), F.floor(F.rand(7) * shards).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    pieces = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("length"),
        F.when(F.col("has"), F.col("h")).alias("source"), F.when(F.col("dup"), F.col("c")).alias("cluster"), shard.alias("shard"))

    def run(t: pa.Table) -> pa.Table:
        def numbers(name: str) -> list[int]:
            codes = t.column(name).combine_chunks().dictionary_encode()
            return (codes if isinstance(codes, pa.DictionaryArray) else codes.combine_chunks()).indices.fill_null(-1).to_pylist()

        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "cluster")])
        bins, offsets = best_fit(t.column("length").to_pylist(), numbers("source"), numbers("cluster"), capacity)
        base = t.column("shard")[0].as_py() << 32
        return t.select(["doc_id", "piece", "start", "length"]).append_column("bin", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(np.array(offsets, np.int64)))

    return pieces.groupBy("shard").applyInArrow(run, SCHEMA)


def sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences of pack() by bytes: (bin, data, pieces), data being the bytes of the bin's pieces in order.

    doc_id must tell rows apart; rows without one are left out, as are pieces of length 0. A bin has its capacity at most,
    so no task holds a large group. An empty table gives an empty one."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    piece = F.expr("substring(data, cast(start + 1 as int), cast(length as int))").alias("data")
    parts = placed.where("length > 0").join(own, "doc_id").select("bin", "offset", "doc_id", piece)
    in_order = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "data"))).alias("x")
    return parts.groupBy("bin").agg(in_order).select("bin", F.expr("aggregate(x, cast('' as binary), (a, y) -> concat(a, y.data))").alias("data"), F.col("x.doc_id").alias("pieces"))


def fill(placed: DataFrame, capacity: int = 8192) -> DataFrame:
    """(bins, filled): how many bins there are, and the share of their room that pieces take."""
    n = F.count_distinct("bin")
    return placed.agg(n.alias("bins"), (F.sum("length") / (n * capacity)).alias("filled"))

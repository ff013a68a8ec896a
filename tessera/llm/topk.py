"""Exact top-k inner products by three-phase uniform threshold.

Rows and queries are dealt to blocks; within each pair of blocks, a slice of the dimensions is a list of partial scores.
1. Each pair of blocks gathers the k best entries of each slice's list and scores them whole; a query's k-th best such
   score over all blocks, t, is a lower bound of its k-th best score.
2. A row that scores t or more has, in one of m slices, a partial score of t / m or more. With that uniform cutoff sent
   to all blocks, each collects the entries that reach it in some slice.
3. Their scores are resolved whole; those of t or more are ranked."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

ROWS, QUERIES, AT_ONCE = 65_536, 8_192, 128
SLICES = 4


def _matrix(t: pa.Table) -> np.ndarray:
    """Vectors of unequal length are filled with zeros."""
    col = t.column("v").combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    width = int(n.max(initial=1))
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * 256)


def _blocks(k: int, cutoff: bool):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        c_id, q_id, found = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy(), []
        if len(c_id) and len(q_id):
            order = np.argsort(c_id, kind="stable")
            c_id, c, q = c_id[order], _matrix(rows)[order], _matrix(queries)
            d = max(c.shape[1], q.shape[1])
            c, q = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (c, q))
            cuts = np.array_split(np.arange(d), min(SLICES, d))
            bar = queries.column("bar").to_numpy(zero_copy_only=False).astype(float) if cutoff else np.full(len(q_id), np.nan)
            bar = np.where(np.isnan(bar), -np.inf, bar)
            for i in range(0, len(q_id), AT_ONCE):
                own = slice(i, i + AT_ONCE)
                part = [q[own][:, s] @ c[:, s].T for s in cuts]
                if cutoff:
                    mask = np.zeros(part[0].shape, bool)
                    for p in part:
                        mask |= p * len(cuts) >= bar[own, None]
                else:
                    mask = np.zeros(part[0].shape, bool)
                    n = min(k + 1, len(c_id))  # the query's own row may be one
                    for p in part:
                        np.put_along_axis(mask, np.argpartition(-p, n - 1, axis=1)[:, :n], True, axis=1)
                mask &= c_id != q_id[own, None]
                r, at = np.nonzero(mask)
                score = sum(p[r, at] for p in part)
                keep = score >= bar[own][r]
                r, at, score = r[keep], at[keep], score[keep]
                best = np.lexsort((c_id[at], -score, r))
                r, at, score = r[best], at[best], score[best]
                first = np.searchsorted(r, r)
                top = np.arange(len(r)) - first < k
                found.append((q_id[own][r[top]], c_id[at[top]], score[top]))
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0),) * 3
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(s.astype(np.int64))})

    return run


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(256 * x), for each row whose id is divisible by `every`.

    All if fewer; ties go to the smaller id. A vector that is null or holds null or non-finite components, and one
    without an id take no part; an empty vector scores 0. Of vectors of unequal length the missing components count as 0. A row is its query's own if it has its
    id; rows of one id other than the query's are candidates each; queries of one id are one, that which sorts first. Scores are exact while they stay below 2^53.
    Other columns are ignored; an empty table gives an empty one. A task gets a block of about `rows` rows and `queries`
    queries at most, dealt at random, and keeps k rows a query."""
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    own = common.stash(vectors.where(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))).df
    asked = own.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = own.count(), asked.count()
    spread = own.sparkSession.sparkContext.defaultParallelism
    nr, nq = max(1, -(-n // rows), min(spread, -(-n // 4096))), max(1, -(-m // queries))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    c = own.withColumn("cb", F.floor(F.rand(3) * nr).cast("int")).withColumn("qb", each(nq))
    q = common.stash(asked.withColumn("qb", F.floor(F.rand(5) * nq).cast("int"))).df

    def phase(q: DataFrame, cutoff: bool) -> DataFrame:
        return c.groupBy("cb", "qb").cogroup(q.withColumn("cb", each(nr)).groupBy("cb", "qb")).applyInArrow(_blocks(k, cutoff), "query_id long, vec_id long, score long")

    local = common.stash(phase(q, False)).df
    rank = f"row_number() over (partition by query_id order by score desc, vec_id)"
    bars = local.withColumn("rank", F.expr(rank)).where(f"rank = {k}").select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
    final = phase(q.join(bars, "vec_id", "left"), True)
    return final.withColumn("rank", F.expr(rank)).where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(CASE WHEN least(len(q.v), len(c.v)) = 0 THEN 0 ELSE list_dot_product(q.v, c.v) END AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

import numpy as np

from tests.compare import DATA, oracle, rows
from tessera.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score int, v string, cb int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, every=50, k=5):
    width = max(len(v or ()) for _, v in vectors)
    filled = lambda v: np.pad(np.floor(np.array(v, np.float32).astype(float) * 256), (0, width - len(v)))
    ok = [(i, filled(v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.integers(-3, 4, 8) / 4).tolist()) for i in range(400)]
    vectors += [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (1200, []), (1201, []), (1250, [1.5, -2.0])]
    for n, m in ((topk.ROWS, topk.QUERIES), (30, 3)):
        got = topk.search(frame(spark, vectors), rows=n, queries=m).collect()
        assert sorted(map(tuple, got)) == brute(vectors)


def test_few_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])]
    assert sorted(map(tuple, topk.search(frame(spark, few)).collect())) == brute(few)
    assert topk.search(frame(spark, [(0, [1.0])])).count() == 0
    assert topk.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql(spark):
    got = topk.search(spark.read.parquet(f"{DATA}/embeddings.parquet")).toPandas()
    assert rows(got) == rows(oracle(topk.SQL))

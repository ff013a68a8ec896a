import pytest

from tessera.operators.vector import Vector, coordinates, linear
from tessera.types import Rect
from tests.compare import DATA, oracle, rows
from tessera.plans.oracles import SQL
from tessera.plans.registry import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = oracle(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


SHAPES = ((100,), (10, 10), (4, 5, 5))


@pytest.mark.parametrize("dtype", ["float", "double"])
@pytest.mark.parametrize("shape", SHAPES)
def test_vectors_of_more_dimensions(spark, dtype, shape):
    """u - (v - u) / 2 - (u + v) / 2 is 0."""
    rect = Rect.of(*shape)
    points = coordinates(spark.range(rect.volume).withColumnRenamed("id", "i"), rect).select(linear(rect).alias("i"))
    assert sorted(r.i for r in points.collect()) == list(range(100))
    u = Vector(points.selectExpr("i", "1.5 as v"), dtype=dtype, check=True)
    v = Vector(points.selectExpr("i", "2.7 as v"), dtype=dtype, check=True)
    w = u.copy().axpy(1.0, v)
    v = v.xpay(-1.0, u)
    u = u.axpy(-0.5, v).axpy(-0.5, w)
    assert abs(float(u.dot(u))) < (1e-12 if dtype == "float" else 1e-28)


def test_different_index_spaces_are_refused(spark):
    u, v = (Vector.of_size(spark, n, 1.0, check=True) for n in (5, 6))
    with pytest.raises(ValueError):
        u.axpy(1.0, v)


def test_partition_predicates(spark):
    from tessera.operators import partition

    space = spark.range(20).withColumnRenamed("id", "i")
    parts = partition.equal(spark, 20, 4)
    assert [(r.color, r.i) for r in partition.lines(parts).collect()] == [(k // 5, k) for k in range(20)]
    assert partition.is_disjoint(parts) and partition.is_complete(parts, space)
    more = parts.union(parts.where("i = 5").selectExpr("0", "i"))
    assert not partition.is_disjoint(more) and partition.is_complete(more, space)
    assert not partition.is_complete(parts.where("i <> 7"), space)


def test_results_over_different_indices_are_errors(spark):
    u, v = (Vector.of_size(spark, n, 1.0) for n in (5, 6))
    assert [r.v for r in u.axpy(1.0, u).df.collect()] == [2.0] * 5
    for df in (u.axpy(1.0, v).df, v.xpay(1.0, u).df, u.dot_df(v)):
        with pytest.raises(Exception, match="index spaces differ"):
            df.collect()


def test_bucketed_systems_exchange_sums_only(spark):
    from tessera.plans.planner import SquarePlanner
    from tessera.plans.solvers import CG
    from tessera.sources.generators import laplacian_coo

    p, b = SquarePlanner(spark, bucket_rows=1), Vector.of_size(spark, 100, 1.0)
    p.add_sol_vector(b.zero_fill())
    p.add_rhs_vector(b)
    p.add_row_partitioned_matrix(laplacian_coo(spark, 100), 0, 0)
    solver = CG(p).run(3)
    assert [r.rr for r in solver.history().collect()] == [100.0, 4900.0, 4704.0, 4512.0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = p._product((3, 2))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1
    name = p.table.name
    p.close()
    assert not spark.catalog.tableExists(name)


def _supplier_tables(folder):
    """Parts that share many of 150 suppliers, with repeated lines, nulls, a supplier that the table lacks and one without lines."""
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(3)
    lines = [(p, s) for p in range(30) for s in r.sample(range(150), r.randint(20, 60))]
    lines += lines[:50] + [(0, 7000), (1, 7000), (None, 1), (None, 2), (2, None)]
    table = pa.table({"l_partkey": pa.array([p for p, _ in lines], pa.int64()), "l_suppkey": pa.array([s for _, s in lines], pa.int64())})
    pq.write_table(table, folder / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(range(151), pa.int64())}), folder / "supplier.parquet")
    return len(lines), 151


def test_supplier_graph_grows_as_its_lines(spark, tmp_path, monkeypatch):
    """The weights of all pairs of suppliers would be over 20,000 rows; no table of the query has more than the input."""
    from tessera.functions import storage

    lines, suppliers = _supplier_tables(tmp_path)
    saved, deleted, save, delete = {}, [], storage.save, storage.delete

    def counted(*a):
        t = save(*a)
        saved[t.path] = t.df.count()
        return t

    monkeypatch.setattr(storage, "save", counted)
    monkeypatch.setattr(storage, "delete", lambda s, t: (deleted.append(t.path), delete(s, t)))
    got = QUERIES["cg_supplier_graph"](spark, str(tmp_path)).toPandas()
    assert rows(got) == rows(oracle(SQL["cg_supplier_graph"], str(tmp_path)))
    assert max(saved.values()) <= lines + suppliers
    assert sorted(deleted) == sorted(saved)


def test_gram_operator_in_buckets(spark, tmp_path):
    """Its products are those of the matrix multiplied out, and only sums by column are exchanged."""
    from tessera.functions import storage
    from tessera.operators.matrix import COOMatrix, Gram
    from tessera.plans.planner import RHS, SquarePlanner
    from tessera.plans.registry import supplier_graph

    _supplier_tables(tmp_path)
    diagonal, gram, saved = supplier_graph(spark, str(tmp_path), bucket_rows=1)
    assert saved.name
    pairs = saved.df.toPandas().astype(float)
    s = {(p, t) for p, t in zip(pairs["p"], pairs["s"], strict=True)}
    of = {p: [t for q, t in s if q == p] for p, _ in s}
    b = Vector.of_column(spark.read.parquet(f"{tmp_path}/supplier.parquet"), "s_suppkey", "s_suppkey")
    want = [float(i) + sum(i - (t if t <= 150 else 0.0) for p, u in s if u == i for t in of[p] if t != i) for i in range(151)]
    for one in ([diagonal, gram], [gram, diagonal]):
        p = SquarePlanner(spark)
        for k in range(2):
            p.add_sol_vector(b.zero_fill())
            p.add_rhs_vector(b if k else b.scal(2.0))
            for a in one:
                p.add_row_partitioned_matrix(a, k, 1 - k)
        p.allocate_workspace(1)
        p.matvec(2, RHS)
        got = {(r.space, r.i): r.v for r in p.state.selectExpr("space", "i", "w0 as v").collect()}
        assert got == {(k, i): (1 if k == 0 else 2) * v for k in range(2) for i, v in enumerate(want)}
        p.close()
    plan = gram.sums(b.df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    storage.delete(spark, saved)
    p = SquarePlanner(spark)
    p.add_sol_vector(b)
    p.add_rhs_vector(b)
    p.add_row_partitioned_matrix(Gram(COOMatrix(spark.sql("select 0 as k, 5 as row, 3 as col, 2.0D as entry")), 0.5), 0, 0)
    p.allocate_workspace(1)
    p.matvec(2, RHS)
    assert [(r.i, r.w0) for r in p.state.where("w0 <> 0").collect()] == [(3, 6.0)]
    p.close()

"""Queries of the solver library by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import storage
from tessera.functions.scalar import Scalar, alpha
from tessera.operators import partition as P
from tessera.operators.matrix import COOMatrix, Gram
from tessera.operators.vector import Vector, coordinates, linear
from tessera.plans.planner import BUCKET_ROWS, RHS, SOL, SquarePlanner
from tessera.plans.solvers import CG, GMRES, BiCGStab, DoubleCG
from tessera.sources import generators as G
from tessera.types import IndexOrder, Rect

QUERIES = {}
N, COLORS = 1000, 8


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Scalars: x is the lines' total quantity, y the number of suppliers.


def _xy(spark: SparkSession, d: str) -> tuple[Scalar, Scalar]:
    return Scalar.of(table(spark, d, "lineitem").agg(F.sum("l_quantity"))), Scalar.of(table(spark, d, "supplier").agg(F.count("*")))


SCALAR = {
    "pos": lambda x, y: +x, "neg": lambda x, y: -x, "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y,
    "div": lambda x, y: x / y, "sqrt": lambda x, y: x.sqrt(), "rsqrt": lambda x, y: y.rsqrt(), "div_zero": lambda x, y: x / (y - y),
}
for _name, _f in SCALAR.items():
    QUERIES[f"scalar_{_name}"] = lambda spark, d, f=_f: f(*_xy(spark, d)).to_df(spark)
for _n in range(5):
    QUERIES[f"alpha_{_n}"] = lambda spark, d, n=_n: (lambda x, y: alpha(*(x, y, y + 1.0, x + 3.0)[:n]).to_df(spark))(*_xy(spark, d))


# Vectors over the parts: u is the size, w the retail price.


def _uw(spark: SparkSession, d: str) -> tuple[Vector, Vector]:
    part = table(spark, d, "part")
    return Vector.of_column(part, "p_partkey", "p_size"), Vector.of_column(part, "p_partkey", "p_retailprice")


VECTOR = {
    "fill": lambda u, w: u.fill(2.5), "zero_fill": lambda u, w: u.zero_fill(), "copy": lambda u, w: u.copy(), "scal": lambda u, w: w.scal(0.5),
    "axpy": lambda u, w: u.axpy(0.5, w), "axpy_ratio": lambda u, w: u.axpy(3.0, 4.0, w), "axpy_ratio3": lambda u, w: u.axpy(3.0, 5.0, 8.0, w),
    "xpay": lambda u, w: u.xpay(-2.0, w), "xpay_ratio": lambda u, w: u.xpay(1.0, 8.0, w),
}
for _name, _f in VECTOR.items():
    QUERIES[f"vec_{_name}"] = lambda spark, d, f=_f: f(*_uw(spark, d)).df


@query
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    u, _ = _uw(spark, d)
    return u.dot_df(u.axpy(1.0, u))


@query
def vec_norm2(spark: SparkSession, d: str) -> DataFrame:
    return _uw(spark, d)[0].norm2().to_df(spark)


def _float(spark: SparkSession, d: str) -> Vector:
    return Vector.of_column(table(spark, d, "part"), "p_partkey", "p_size", dtype="float")


@query
def vec_dot_float(spark: SparkSession, d: str) -> DataFrame:
    """Entries, products and the result are floats."""
    u = _float(spark, d)
    return u.scal(0.5).dot_df(u)


@query
def vec_scal_float(spark: SparkSession, d: str) -> DataFrame:
    return _float(spark, d).scal(0.5).df


@query
def vec_fill_scalar(spark: SparkSession, d: str) -> DataFrame:
    return _uw(spark, d)[0].fill(_xy(spark, d)[1]).df


@query
def vec_random_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many entries there are, and how many lie in [0, 1)."""
    return _uw(spark, d)[0].random_fill(7).df.agg(F.count("*").alias("n"), F.count_if((F.col("v") >= 0) & (F.col("v") < 1)).alias("inside"))


#: The parts laid out in two and three dimensions; the first one's size follows from their number.
LAYOUTS = {"2d": (20,), "3d": (4, 5)}


def _laid_out(spark: SparkSession, d: str, rest: tuple[int, ...], dtype: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("at", F.col("p_partkey") - 1)
    rect = Rect.of(-(-part.count() // 20), *rest)
    points = coordinates(part, rect, index="at").withColumn("i", linear(rect))
    u, w = (Vector.of_column(points, "i", c, dtype=dtype) for c in ("p_size", "p_retailprice"))
    return coordinates(u.axpy(0.5, w).df, rect).select(*(f"c{k}" for k in range(len(rest) + 1)), "v")


for _name, _rest in LAYOUTS.items():
    for _dtype in ("double", "float"):
        QUERIES[f"vec_axpy_{_name}_{_dtype}"] = lambda spark, d, r=_rest, t=_dtype: _laid_out(spark, d, r, t)


# Matrices from the lines: part by supplier.


def _lines(spark: SparkSession, d: str) -> COOMatrix:
    """One entry per line; entries at one place add up."""
    return COOMatrix.of_columns(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


def _summed(spark: SparkSession, d: str) -> COOMatrix:
    df = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("entry"))
    supp = table(spark, d, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    return COOMatrix(df.select((F.col("row") * supp + F.col("col")).alias("k"), "row", "col", "entry"))


def _supp(spark: SparkSession, d: str) -> Vector:
    return Vector.of_column(table(spark, d, "supplier"), "s_suppkey", 1 + F.col("s_suppkey") % 7)


@query
def coo_matvec(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).matvec(_supp(spark, d), _uw(spark, d)[0]).df


@query
def coo_matvec_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).matvec(_supp(spark, d), _uw(spark, d)[0]).df


@query
def coo_rmatvec(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).rmatvec(_uw(spark, d)[0], _supp(spark, d)).df


@query
def coo_print(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).lines()


@query
def coo_kernel_space(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).kernel_space()


@query
def csr_auxiliary(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).to_csr(_uw(spark, d)[0].df).auxiliary()["rowptr"]


@query
def csr_rowptr(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).to_csr(_uw(spark, d)[0].df).rowptr


@query
def csr_print(spark: SparkSession, d: str) -> DataFrame:
    return _summed(spark, d).to_csr(_uw(spark, d)[0].df).lines()


@query
def csr_matvec(spark: SparkSession, d: str) -> DataFrame:
    u = _uw(spark, d)[0]
    return _summed(spark, d).to_csr(u.df).matvec(_supp(spark, d), u).df


@query
def csr_rmatvec(spark: SparkSession, d: str) -> DataFrame:
    u = _uw(spark, d)[0]
    return _summed(spark, d).to_csr(u.df).rmatvec(u, _supp(spark, d)).df


# Partitions of the Laplacian's spaces.


@query
def part_equal(spark: SparkSession, d: str) -> DataFrame:
    return P.equal(spark, N, COLORS)


def _chain(of: str, *steps: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        a = (G.laplacian_coo if of == "coo" else G.laplacian_csr)(spark, N)
        part = P.equal(spark, N, COLORS)
        for s in steps:
            part = getattr(a, s)(part)
        return part

    return run


for _of in ("coo", "csr"):
    QUERIES |= {
        f"{_of}_k_from_r": _chain(_of, "kernel_from_range"), f"{_of}_k_from_d": _chain(_of, "kernel_from_domain"),
        f"{_of}_d_from_k": _chain(_of, "kernel_from_range", "domain_from_kernel"), f"{_of}_r_from_k": _chain(_of, "kernel_from_domain", "range_from_kernel"),
        f"{_of}_d_from_r": _chain(_of, "domain_from_range"), f"{_of}_r_from_d": _chain(_of, "range_from_domain"),
    }


@query
def part_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return P.overlaps(_chain("coo", "domain_from_range")(spark, d))


@query
def part_missing(spark: SparkSession, d: str) -> DataFrame:
    return P.missing(P.equal(spark, N, COLORS).where("color <> 3"), spark.range(N).withColumnRenamed("id", "i"))


@query
def part_print(spark: SparkSession, d: str) -> DataFrame:
    return P.lines(P.equal(spark, N, COLORS))


@query
def part_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Of the equal partition, its image with ghosts and that without one color."""
    space, equal = spark.range(N).withColumnRenamed("id", "i"), P.equal(spark, N, COLORS)
    parts = {"equal": equal, "ghosts": _chain("coo", "domain_from_range")(spark, d), "gap": equal.where("color <> 3")}
    return spark.createDataFrame([(n, P.is_disjoint(p), P.is_complete(p, space)) for n, p in parts.items()], "part string, is_disjoint boolean, is_complete boolean")


@query
def csr_local_pointers(spark: SparkSession, d: str) -> DataFrame:
    return G.laplacian_csr(spark, N).local_pointers(P.equal(spark, N, COLORS))


# Generators.


@query
def laplacian_1d_coo(spark: SparkSession, d: str) -> DataFrame:
    return G.laplacian_coo(spark, N).entries


@query
def laplacian_1d_csr(spark: SparkSession, d: str) -> DataFrame:
    return G.laplacian_csr(spark, N).entries


@query
def laplacian_1d_rowptr(spark: SparkSession, d: str) -> DataFrame:
    return G.laplacian_rowptr(spark, N)


SHAPES = {"1d3": (64,), "2d5": (16, 12), "3d7": (8, 6, 5), "3d27": (6, 5, 7)}
for _name, _shape in SHAPES.items():
    for _order in IndexOrder:
        QUERIES[f"stencil_{_name}_{_order.value}_major"] = lambda spark, d, n=_name, s=_shape, o=_order: G.stencil_entries(spark, G.STENCILS[n], Rect.of(*s), o)
    QUERIES[f"stencil_{_name}_rowptr"] = lambda spark, d, n=_name, s=_shape: G.stencil_csr(spark, G.STENCILS[n], Rect.of(*s)).rowptr


#: Bounds that don't start at zero.
RECTS = {"1d3": Rect((5,), (40,)), "2d5": Rect((2, 3), (9, 14)), "3d7": Rect((1, 0, 2), (6, 4, 7)), "3d27": Rect((0, 2, 1), (4, 5, 6))}
for _name, _rect in RECTS.items():
    QUERIES[f"stencil_{_name}_points"] = lambda spark, d, n=_name, r=_rect: G.stencil_points(spark, G.STENCILS[n], r)
    for _k, _of in enumerate(("kernel", "rowptr")):
        QUERIES[f"stencil_{_name}_csr_points_{_of}"] = lambda spark, d, n=_name, r=_rect, k=_k: G.stencil_csr_points(spark, G.STENCILS[n], r)[k]
for _order in IndexOrder:
    QUERIES[f"linearize_{_order.value}_major"] = lambda spark, d, o=_order: (lambda r: coordinates(spark.range(r.volume), r, o, "id").select("c0", "c1", "c2", linear(r, o).alias("i")))(RECTS["3d7"])


@query
def laplacian_2d_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(G.laplacian_2d_size(*SHAPES["2d5"]),)], "nnz long")


@query
def stencil_size(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, G.stencil_size(G.STENCILS[n], Rect.of(*s))) for n, s in SHAPES.items()], "stencil string, nnz long")


# Systems.


def _system(spark: SparkSession, a, n: int, copies: int = 1, b: Vector | None = None) -> SquarePlanner:
    p = SquarePlanner(spark)
    for k in range(copies):
        rhs = b or Vector.of_size(spark, n, 1.0)
        p.add_sol_vector(rhs.zero_fill())
        p.add_rhs_vector(rhs)
        p.add_row_partitioned_matrix(a, k, k)
    return p


@query
def block_matvec(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers in one system: the lines' matrix and its transpose off the diagonal."""
    a, p = _summed(spark, d), SquarePlanner(spark)
    for v in (_uw(spark, d)[0], _supp(spark, d)):
        p.add_sol_vector(v)
        p.add_rhs_vector(v)
    p.add_row_partitioned_matrix(a, 1, 0)
    p.add_row_partitioned_matrix(a.transpose(), 0, 1)
    p.allocate_workspace(1)
    p.matvec(2, RHS)
    return p.state.select("space", "i", F.col("w0").alias("v"))


@query
def multi_space_dot(spark: SparkSession, d: str) -> DataFrame:
    p = SquarePlanner(spark)
    for v in (_uw(spark, d)[0], _supp(spark, d)):
        p.add_sol_vector(v)
        p.add_rhs_vector(v.scal(2.0))
    p.allocate_workspace(0)
    return p.dot(0, 1).to_df(spark)


@query
def planner_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Copies, sums with one to three factors and a zero fill, over parts and suppliers."""
    p = SquarePlanner(spark)
    for v in (_uw(spark, d)[0], _supp(spark, d)):
        p.add_sol_vector(v)
        p.add_rhs_vector(v.scal(2.0))
    p.allocate_workspace(4)
    p.copy(2, SOL)
    p.axpy(2, 3.0, 5.0, 8.0, RHS)
    p.copy(3, 2)
    p.xpay(3, 1.0, 4.0, RHS)
    p.copy(4, RHS)
    p.scal(4, 0.25)
    p.copy(5, 2)
    p.zero_fill(5)
    return p.state.select("space", "i", "w0", "w1", "w2", "w3")


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select("it", (F.round("rr", digits) + 0.0).alias("rr"))


@query
def cg_laplacian_1d(spark: SparkSession, d: str) -> DataFrame:
    return CG(_system(spark, G.laplacian_coo(spark, 100), 100)).run(10).history()


@query
def cg_laplacian_1d_csr(spark: SparkSession, d: str) -> DataFrame:
    return CG(_system(spark, G.laplacian_csr(spark, 100), 100)).run(10).history()


@query
def double_cg_laplacian_1d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(DoubleCG(_system(spark, G.laplacian_coo(spark, 100), 100)).run(5).history(), 6)


def _stencil(spark: SparkSession, name: str, *shape: int, copies: int = 1) -> SquarePlanner:
    rect = Rect.of(*shape)
    return _system(spark, G.stencil_csr(spark, G.STENCILS[name], rect), rect.volume, copies)


@query
def cg_stencil_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(CG(_stencil(spark, "2d5", 16, 16)).run(5).history())


@query
def cg_two_copies_3d27(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(CG(_stencil(spark, "3d27", 8, 8, 8, copies=2)).run(4).history())


@query
def cg_iterates(spark: SparkSession, d: str) -> DataFrame:
    """The solutions of three steps from a guess of ones."""
    p, b = SquarePlanner(spark), Vector.of_column(spark.range(100), "id", 1.0 + F.col("id") % 7)
    p.add_sol_vector(b.fill(1.0))
    p.add_rhs_vector(b)
    p.add_row_partitioned_matrix(G.laplacian_coo(spark, 100), 0, 0)
    return CG(p, use_initial_guess=True).iterates(3).select("it", "i", F.round("v", 6).alias("v"))


@query
def bicgstab_two_copies_3d27(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(BiCGStab(_stencil(spark, "3d27", 8, 8, 8, copies=2)).run(3).history())


@query
def bicgstab_stencil_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(BiCGStab(_stencil(spark, "2d5", 16, 16)).run(4).history())


@query
def gmres_ls_stencil_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(GMRES(_stencil(spark, "2d5", 16, 16), 6).run(2).history())


@query
def gmres_unit_stencil_2d(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(GMRES(_stencil(spark, "2d5", 16, 16), 6, "unit").run(2).history(), 3)


def supplier_graph(spark: SparkSession, d: str, bucket_rows: int = BUCKET_ROWS) -> tuple[COOMatrix, Gram, storage.Table]:
    """I + the Laplacian of suppliers weighted by the parts they share. The weights are W = S^T S off the diagonal, for the distinct
    pairs S of part and supplier. They grow with the square of a part's suppliers, so they aren't made: the sum is a diagonal, 1
    and the suppliers of all of a supplier's parts (itself too), less S^T S. Both read S's table, which is the caller's to delete."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"))
    pairs = lines.dropna().distinct()
    saved = storage.save_bucketed(pairs, int(spark.conf.get("spark.sql.shuffle.partitions")), "p") if lines.count() >= bucket_rows else storage.save(pairs)
    per = saved.df.join(saved.df.groupBy("p").agg(F.count("*").alias("n")), "p").groupBy(F.col("s").alias("s_suppkey")).agg(F.sum("n").alias("n"))
    s, n = F.col("s_suppkey"), F.coalesce("n", F.lit(0)).cast("double")
    diagonal = table(spark, d, "supplier").join(per, "s_suppkey", "left").select(s.alias("k"), s.alias("row"), s.alias("col"), (1.0 + n).alias("entry"))
    return COOMatrix(diagonal), Gram(COOMatrix.of_columns(saved.df.withColumn("one", F.lit(1.0)), "p", "s", "one"), -1.0), saved


@query
def cg_supplier_graph(spark: SparkSession, d: str) -> DataFrame:
    b = _supp(spark, d)
    diagonal, gram, saved = supplier_graph(spark, d)
    p = _system(spark, diagonal, 0, b=b)
    p.add_row_partitioned_matrix(gram, 0, 0)
    h = CG(p).run(3).history()
    p.close()
    storage.delete(spark, saved)
    first = h.where("it = 0").select(F.col("rr").alias("r0"))
    return h.crossJoin(F.broadcast(first)).select("it", F.round(F.col("rr") / F.col("r0"), 4).alias("rr"))  # four rows by one

"""DuckDB SQL by query name."""

from __future__ import annotations

from math import prod

from tessera.plans.registry import COLORS, LAYOUTS, RECTS, SHAPES, N
from tessera.sources.generators import STENCILS

SQL: dict[str, str] = {}

XY = "(SELECT (SELECT sum(l_quantity) FROM lineitem)::DOUBLE AS x, (SELECT count(*) FROM supplier)::DOUBLE AS y)"
for name, value in {"pos": "x", "neg": "-x", "add": "x + y", "sub": "x - y", "mul": "x * y", "div": "x / y", "sqrt": "sqrt(x)", "rsqrt": "1::DOUBLE / sqrt(y)", "div_zero": "'inf'::DOUBLE"}.items():
    SQL[f"scalar_{name}"] = f"SELECT {value} AS value FROM {XY}"
for n, value in enumerate(("1::DOUBLE", "x", "x / y", "x * y / (y + 1)", "x * y / ((y + 1) * (x + 3))")):
    SQL[f"alpha_{n}"] = f"SELECT {value} AS value FROM {XY}"

for name, value in {
    "fill": "2.5::DOUBLE", "zero_fill": "0::DOUBLE", "copy": "u", "scal": "w * 0.5::DOUBLE", "axpy": "u + 0.5::DOUBLE * w", "axpy_ratio": "u + 0.75::DOUBLE * w",
    "axpy_ratio3": "u + 1.875::DOUBLE * w", "xpay": "-2::DOUBLE * u + w", "xpay_ratio": "0.125::DOUBLE * u + w",
}.items():
    SQL[f"vec_{name}"] = f"SELECT p_partkey AS i, {value} AS v FROM (SELECT p_partkey, p_size::DOUBLE AS u, p_retailprice::DOUBLE AS w FROM part)"
SQL["vec_dot"] = "SELECT sum(p_size * 2 * p_size)::DOUBLE AS value FROM part"
SQL["vec_norm2"] = "SELECT sqrt(sum(p_size * p_size)::DOUBLE) AS value FROM part"
SQL["vec_dot_float"] = "SELECT sum(p_size * 0.5::FLOAT * p_size)::FLOAT AS value FROM part"
SQL["vec_scal_float"] = "SELECT p_partkey AS i, (0.5 * p_size)::FLOAT AS v FROM part"
SQL["vec_fill_scalar"] = "SELECT p_partkey AS i, (SELECT count(*) FROM supplier)::DOUBLE AS v FROM part"
SQL["vec_random_fill"] = "SELECT count(*) AS n, count(*) AS inside FROM part"
for name, rest in LAYOUTS.items():
    at, points = "(p_partkey - 1)", []
    for d, size in reversed(list(enumerate(rest, 1))):
        points.append(f"({at} % {size})::BIGINT AS c{d}")
        at = f"({at} // {size})"
    points.append(f"{at}::BIGINT AS c0")
    for dtype in ("double", "float"):
        SQL[f"vec_axpy_{name}_{dtype}"] = f"SELECT {', '.join(points)}, (p_size::{dtype} + 0.5::{dtype} * p_retailprice::{dtype})::{dtype} AS v FROM part"

A = "(SELECT l_partkey AS row, l_suppkey AS col, sum(l_quantity)::DOUBLE AS entry FROM lineitem GROUP BY ALL)"
S = "(SELECT s_suppkey AS i, (1 + s_suppkey % 7)::DOUBLE AS v FROM supplier)"
U = "(SELECT p_partkey AS i, p_size::DOUBLE AS v FROM part)"
MATVEC = f"SELECT u.i AS i, coalesce(s.v, 0)::DOUBLE AS v FROM {U} u LEFT JOIN (SELECT row, sum(entry * x.v) AS v FROM {A} a JOIN {S} x ON a.col = x.i GROUP BY row) s ON u.i = s.row"
RMATVEC = f"SELECT u.i AS i, coalesce(s.v, 0)::DOUBLE AS v FROM {S} u LEFT JOIN (SELECT col, sum(entry * x.v) AS v FROM {A} a JOIN {U} x ON a.row = x.i GROUP BY col) s ON u.i = s.col"
SQL |= {"coo_matvec": MATVEC, "coo_matvec_duplicates": MATVEC, "csr_matvec": MATVEC, "coo_rmatvec": RMATVEC, "csr_rmatvec": RMATVEC}
SQL["coo_print"] = f"SELECT (row * (SELECT max(s_suppkey) + 1 FROM supplier) + col)::BIGINT AS k, entry, row, col FROM {A}"
SQL["csr_print"] = f"SELECT (row_number() OVER (ORDER BY row, col) - 1)::BIGINT AS k, entry, row, col FROM {A}"
SQL["coo_kernel_space"] = f"SELECT (row * (SELECT max(s_suppkey) + 1 FROM supplier) + col)::BIGINT AS k FROM {A}"
SQL["csr_rowptr"] = SQL["csr_auxiliary"] = f"SELECT i AS row, (h - n)::BIGINT AS lo, (h - 1)::BIGINT AS hi FROM (SELECT i, n, sum(n) OVER (ORDER BY i) AS h FROM (SELECT i, count(row) AS n FROM {U} LEFT JOIN {A} ON row = i GROUP BY i))"
SQL["block_matvec"] = f"SELECT 0::INTEGER AS space, i, v FROM ({MATVEC}) UNION ALL SELECT 1::INTEGER, i, v FROM ({RMATVEC})"
SQL["planner_vectors"] = f"SELECT space, i, v * 4.75 AS w0, v * 3.1875 AS w1, v * 0.5 AS w2, 0::DOUBLE AS w3 FROM (SELECT 0::INTEGER AS space, * FROM {U} UNION ALL SELECT 1::INTEGER, * FROM {S})"
SQL["multi_space_dot"] = f"SELECT (SELECT sum(2 * v * v) FROM {U}) + (SELECT sum(2 * v * v) FROM {S}) AS value"

ENTRIES = f"(SELECT k, (k + 1) // 3 AS row, k - 2 * ((k + 1) // 3) AS col, CASE WHEN k % 3 = 0 THEN 2.0 ELSE -1.0 END::DOUBLE AS entry FROM (SELECT range AS k FROM range({3 * N - 2})))"
PART = f"(SELECT (range * {COLORS} // {N})::INTEGER AS color, range AS i FROM range({N}))"
SQL["laplacian_1d_coo"] = SQL["laplacian_1d_csr"] = f"SELECT * FROM {ENTRIES}"
ROWPTR = f"SELECT range AS row, greatest(3 * range - 1, 0)::BIGINT AS lo, least(3 * range + 1, {3 * N - 3})::BIGINT AS hi FROM range({N})"
SQL["laplacian_1d_rowptr"] = ROWPTR
SQL["part_equal"] = SQL["part_print"] = f"SELECT * FROM {PART}"
_step = lambda part, key, to: f"(SELECT DISTINCT color, {to} AS i FROM {ENTRIES} e JOIN {part} p ON e.{key} = p.i)"
_kr, _kd = _step(PART, "row", "k"), _step(PART, "col", "k")
_dr, _rd = _step(_kr, "k", "col"), _step(_kd, "k", "row")
for of in ("coo", "csr"):
    for name, q in {"k_from_r": _kr, "k_from_d": _kd, "d_from_k": _dr, "r_from_k": _rd, "d_from_r": _dr, "r_from_d": _rd}.items():
        SQL[f"{of}_{name}"] = f"SELECT * FROM {q}"
SQL["part_overlaps"] = f"SELECT i FROM {_dr} GROUP BY i HAVING count(*) > 1"
SQL["part_missing"] = f"SELECT i FROM {PART} WHERE color = 3"
SQL["part_predicates"] = " UNION ALL ".join(
    f"SELECT '{n}' AS part, NOT EXISTS (SELECT i FROM {q} GROUP BY i HAVING count(*) > 1) AS is_disjoint, (SELECT count(DISTINCT i) FROM {q}) = {N} AS is_complete"
    for n, q in {"equal": PART, "ghosts": _dr, "gap": f"(SELECT * FROM {PART} WHERE color <> 3)"}.items()
)
SQL["csr_local_pointers"] = f"SELECT color, row, lo - min(lo) OVER (PARTITION BY color) AS begin FROM ({ROWPTR}) JOIN {PART} ON row = i"


def stencil(name: str, shape: tuple[int, ...], column: bool = False) -> str:
    """Entries in order of row, then of offset, by a join of all points with the offsets."""
    dims = range(len(shape))
    major = list(reversed(dims)) if column else list(dims)
    step = {}
    s = 1
    for d in reversed(major):
        step[d], s = s, s * shape[d]
    values = ", ".join(f"({', '.join(map(str, o))}, {v!r}::DOUBLE)" for o, v in STENCILS[name])
    offsets = f"(VALUES {values}) o({', '.join(f'o{d}' for d in dims)}, entry)"
    points = ", ".join(f"range({n}) r{d}(c{d})" for d, n in enumerate(shape))
    row = " + ".join(f"c{d} * {step[d]}" for d in dims)
    col = " + ".join(f"(c{d} + o{d}) * {step[d]}" for d in dims)
    inside = " AND ".join(f"c{d} + o{d} BETWEEN 0 AND {n - 1}" for d, n in enumerate(shape))
    order = ", ".join(f"o{d}" for d in major)
    return f"SELECT (row_number() OVER (ORDER BY {row}, {order}, entry) - 1)::BIGINT AS k, ({row})::BIGINT AS row, ({col})::BIGINT AS col, entry FROM {points}, {offsets} WHERE {inside}"


for name, shape in SHAPES.items():
    SQL[f"stencil_{name}_row_major"] = stencil(name, shape)
    SQL[f"stencil_{name}_column_major"] = stencil(name, shape, True)
    SQL[f"stencil_{name}_rowptr"] = f"SELECT row, min(k) AS lo, max(k) AS hi FROM ({stencil(name, shape)}) GROUP BY row"
for name, rect in RECTS.items():
    at = lambda of, out, shape=rect.shape, lo=rect.lo: ", ".join(f"({of} // {prod(shape[d + 1:])} % {shape[d]} + {lo[d]})::BIGINT AS {out}{d}" for d in range(len(shape)))
    all_of = f"({stencil(name, rect.shape)})"
    SQL[f"stencil_{name}_points"] = f"SELECT k, {at('row', 'r')}, {at('col', 'd')}, entry FROM {all_of}"
    SQL[f"stencil_{name}_csr_points_kernel"] = f"SELECT k, {at('col', 'd')}, entry FROM {all_of}"
    SQL[f"stencil_{name}_csr_points_rowptr"] = f"SELECT {at('row', 'r')}, min(k) AS lo, max(k) AS hi FROM {all_of} GROUP BY row"
_lo, _n = RECTS["3d7"].lo, RECTS["3d7"].shape
_points = ", ".join(f"(c{d} + {_lo[d]})::BIGINT AS c{d}" for d in range(3))
for name, i in {"row": f"(c0 * {_n[1]} + c1) * {_n[2]} + c2", "column": f"(c2 * {_n[1]} + c1) * {_n[0]} + c0"}.items():
    SQL[f"linearize_{name}_major"] = f"SELECT {_points}, ({i})::BIGINT AS i FROM range({_n[0]}) x(c0), range({_n[1]}) y(c1), range({_n[2]}) z(c2)"
SQL["laplacian_2d_size"] = f"SELECT count(*) AS nnz FROM ({stencil('2d5', SHAPES['2d5'])})"
SQL["stencil_size"] = " UNION ALL ".join(f"SELECT '{n}' AS stencil, count(*) AS nnz FROM ({stencil(n, s)})" for n, s in SHAPES.items())


def cg(a: str, b: str, steps: int, out: str = "rr") -> str:
    """A chain of tables, one set per iteration. a: (row, col, entry); b: (i, v)."""
    t = [f"a AS MATERIALIZED ({a})", f"b AS MATERIALIZED ({b})", "s0 AS MATERIALIZED (SELECT i, v AS r, v AS p FROM b)", "h0 AS MATERIALIZED (SELECT sum(r * r) AS rr FROM s0)"]
    for k in range(steps):
        t += [
            f"q{k} AS MATERIALIZED (SELECT row AS i, sum(entry * p) AS q FROM a JOIN s{k} ON col = i GROUP BY row)",
            f"f{k} AS MATERIALIZED (SELECT s.i, p, q, r FROM s{k} s JOIN q{k} ON s.i = q{k}.i)",
            f"l{k} AS MATERIALIZED (SELECT (SELECT rr FROM h{k}) / sum(p * q) AS x FROM f{k})",
            f"g{k} AS MATERIALIZED (SELECT i, p, r - x * q AS r FROM f{k}, l{k})",
            f"h{k + 1} AS MATERIALIZED (SELECT sum(r * r) AS rr FROM g{k})",
            f"s{k + 1} AS MATERIALIZED (SELECT i, r, r + (SELECT rr FROM h{k + 1}) / (SELECT rr FROM h{k}) * p AS p FROM g{k})",
        ]
    rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS it, rr FROM h{k}" for k in range(steps + 1))
    return f"WITH {', '.join(t)} SELECT it, {out} AS rr FROM ({rows})"


def ones(n: int) -> str:
    return f"SELECT range AS i, 1::DOUBLE AS v FROM range({n})"


LAPLACE = "SELECT (k + 1) // 3 AS row, k - 2 * ((k + 1) // 3) AS col, CASE WHEN k % 3 = 0 THEN 2.0 ELSE -1.0 END::DOUBLE AS entry FROM (SELECT range AS k FROM range(298))"
SQL["cg_laplacian_1d"] = SQL["cg_laplacian_1d_csr"] = cg(LAPLACE, ones(100), 10)
SQL["double_cg_laplacian_1d"] = cg(LAPLACE, ones(100), 10, "round(rr, 6)")
SQL["cg_stencil_2d"] = cg(stencil("2d5", (16, 16)), ones(256), 5, "round(rr, 4)")
SQL["cg_two_copies_3d27"] = cg(stencil("3d27", (8, 8, 8)), ones(512), 4, "round(2 * rr, 4)")
PAIRS = "(SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem)"
W = f"(SELECT a.s AS s, b.s AS t, count(*)::DOUBLE AS w FROM {PAIRS} a JOIN {PAIRS} b ON a.p = b.p AND a.s <> b.s GROUP BY ALL)"
GRAPH = f"SELECT s AS row, t AS col, -w AS entry FROM {W} UNION ALL SELECT s_suppkey, s_suppkey, 1 + coalesce(w, 0) FROM supplier LEFT JOIN (SELECT s, sum(w) AS w FROM {W} GROUP BY s) ON s = s_suppkey"
SQL["cg_supplier_graph"] = cg(GRAPH, f"SELECT * FROM {S}", 3, "round(rr / (SELECT rr FROM h0), 4)")


def iterates(a: str, b: str, x: str, steps: int, digits: int) -> str:
    """The solutions of conjugate gradients from the guess x (i, v): each from the last by its own chain of tables."""
    t = [
        f"a AS MATERIALIZED ({a})",
        f"x AS MATERIALIZED ({x})",
        f"m AS MATERIALIZED (SELECT row AS i, sum(entry * v) AS y FROM a JOIN x ON col = i GROUP BY row)",
        f"s0 AS MATERIALIZED (SELECT b.i, x.v AS x, b.v - y AS r, b.v - y AS p FROM ({b}) b JOIN x ON b.i = x.i JOIN m ON b.i = m.i)",
    ]
    for k in range(steps):
        t += [
            f"q{k} AS MATERIALIZED (SELECT i, x, r, p, q FROM s{k} JOIN (SELECT row, sum(entry * p) AS q FROM a JOIN s{k} ON col = i GROUP BY row) ON i = row)",
            f"l{k} AS MATERIALIZED (SELECT sum(r * r) AS rr, sum(r * r) / sum(p * q) AS y FROM q{k})",
            f"g{k} AS MATERIALIZED (SELECT i, x + y * p AS x, r - y * q AS r, p FROM q{k}, l{k})",
            f"s{k + 1} AS MATERIALIZED (SELECT i, x, r, r + (SELECT sum(r * r) FROM g{k}) / rr * p AS p FROM g{k}, l{k})",
        ]
    rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS it, i, x FROM s{k}" for k in range(steps + 1))
    return f"WITH {', '.join(t)} SELECT it, i, round(x, {digits}) AS v FROM ({rows})"


SQL["cg_iterates"] = iterates(LAPLACE, "SELECT range AS i, (1 + range % 7)::DOUBLE AS v FROM range(100)", ones(100), 3, 6)


def bicgstab(a: str, b: str, steps: int, out: str) -> str:
    product = lambda name, of, x: f"{name} AS MATERIALIZED (SELECT row AS i, sum(entry * {x}) AS y FROM a JOIN {of} ON col = i GROUP BY row)"
    t = [f"a AS MATERIALIZED ({a})", f"b AS MATERIALIZED ({b})", "s0 AS MATERIALIZED (SELECT i, v AS z, v AS r, 0::DOUBLE AS p, 0::DOUBLE AS v FROM b)", "c0 AS MATERIALIZED (SELECT 1::DOUBLE AS rho, 0::DOUBLE AS al, 1::DOUBLE AS om)", "h0 AS MATERIALIZED (SELECT sum(z * r) AS zr, sum(r * r) AS rr FROM s0)"]
    for k in range(steps):
        t += [
            f"p{k} AS MATERIALIZED (SELECT i, z, r, ((SELECT zr FROM h{k}) / rho) * (al / om) * (p - om * v) + r AS p FROM s{k}, c{k})",
            product(f"v{k}", f"p{k}", "p"),
            f"w{k} AS MATERIALIZED (SELECT x.i, z, r, p, y AS v FROM p{k} x JOIN v{k} y ON x.i = y.i)",
            f"l{k} AS MATERIALIZED (SELECT (SELECT zr FROM h{k}) / sum(z * v) AS al FROM w{k})",
            f"x{k} AS MATERIALIZED (SELECT i, z, p, v, r - al * v AS s FROM w{k}, l{k})",
            product(f"u{k}", f"x{k}", "s"),
            f"y{k} AS MATERIALIZED (SELECT x.i, z, p, v, s, y AS u FROM x{k} x JOIN u{k} y ON x.i = y.i)",
            f"c{k + 1} AS MATERIALIZED (SELECT (SELECT zr FROM h{k}) AS rho, (SELECT al FROM l{k}) AS al, sum(s * u) / sum(u * u) AS om FROM y{k})",
            f"s{k + 1} AS MATERIALIZED (SELECT i, z, s - om * u AS r, p, v FROM y{k}, c{k + 1})",
            f"h{k + 1} AS MATERIALIZED (SELECT sum(z * r) AS zr, sum(r * r) AS rr FROM s{k + 1})",
        ]
    rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS it, rr FROM h{k}" for k in range(steps + 1))
    return f"WITH {', '.join(t)} SELECT it, {out} AS rr FROM ({rows})"


SQL["bicgstab_two_copies_3d27"] = bicgstab(stencil("3d27", (8, 8, 8)), ones(512), 3, "round(2 * rr, 4)")
SQL["bicgstab_stencil_2d"] = bicgstab(stencil("2d5", (16, 16)), ones(256), 4, "round(rr, 4)")


def gmres(a: str, b: str, restart: int, cycles: int, out: str, unit: bool = False) -> str:
    """Residuals by projection, without a least squares problem: a cycle leaves of r what is orthogonal to A times its
    Krylov space, whose orthonormal basis is built by two passes of Gram-Schmidt. unit: r less A times the sum of the
    orthonormal Krylov vectors."""
    t = [f"a AS MATERIALIZED ({a})", f"r0 AS MATERIALIZED ({b})"]
    for c in range(cycles):
        name = lambda kind, j: f"{kind}{c}_{j}"  # noqa: B023,E731
        t.append(f"{name('v', 0)} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM r{c})) AS v FROM r{c})")
        basis = [name("v", 0)] if unit else []
        last, images = name("v", 0), []
        for j in range(restart):
            w = name("w", j)
            t.append(f"{w} AS MATERIALIZED (SELECT row AS i, sum(entry * v) AS v FROM a JOIN {last} ON col = i GROUP BY row)")
            images.append(w)
            if unit and j == restart - 1:
                break
            for turn in range(2 if basis else 0):
                all_of = " UNION ALL ".join(f"SELECT {k} AS j, i, v FROM {x}" for k, x in enumerate(basis))
                t.append(f"{w}d{turn} AS MATERIALIZED (SELECT j, sum(w.v * q.v) AS x FROM {w} w JOIN ({all_of}) q ON w.i = q.i GROUP BY j)")
                t.append(f"{w}s{turn} AS MATERIALIZED (SELECT w.i, any_value(w.v) - sum(d.x * q.v) AS v FROM {w} w JOIN ({all_of}) q ON w.i = q.i JOIN {w}d{turn} d ON d.j = q.j GROUP BY w.i)")
                w = f"{w}s{turn}"
            last = name("q", j + 1)
            t.append(f"{last} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM {w})) AS v FROM {w})")
            basis.append(last)
        if unit:
            taken = " UNION ALL ".join(f"SELECT i, v FROM {x}" for x in images)
        else:
            taken = " UNION ALL ".join(f"SELECT i, v * (SELECT sum(x.v * r.v) FROM {x} x JOIN r{c} r ON x.i = r.i) AS v FROM {x}" for x in basis)
        t.append(f"r{c + 1} AS MATERIALIZED (SELECT r.i, any_value(r.v) - sum(x.v) AS v FROM r{c} r JOIN ({taken}) x ON r.i = x.i GROUP BY r.i)")
    rows = " UNION ALL ".join(f"SELECT {k}::INTEGER AS it, sum(v * v) AS rr FROM r{k}" for k in range(cycles + 1))
    return f"WITH {', '.join(t)} SELECT it, {out} AS rr FROM ({rows})"


SQL["gmres_ls_stencil_2d"] = gmres(stencil("2d5", (16, 16)), ones(256), 6, 2, "round(rr, 4)")
SQL["gmres_unit_stencil_2d"] = gmres(stencil("2d5", (16, 16)), ones(256), 6, 2, "round(rr, 3)", unit=True)

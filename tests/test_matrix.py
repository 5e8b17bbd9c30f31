"""Kernels and sparse operators against numpy; sources by round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.functions import shapes
from gridloom.operators import elementwise as el
from gridloom.operators import fronts, graph, kernels, mesh, product, reduce, spatial
from gridloom.sources import generate, matrix_market, obj

D5 = np.array([[1.0, 2, 3], [0, 2, 1], [2, 1, 3]])
CN = np.array([[3.0, 1, 1], [1, 4, 2], [2, 1, 5]])


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("name", list(kernels.SOLVERS))
def test_solvers(name):
    a = CN if name == "gauss_seidel" else D5
    b = np.array([[12.0, 5], [24, 6], [36, 7]])
    assert np.allclose(kernels.SOLVERS[name](np.hstack([a, b])), np.linalg.solve(a, b), atol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 8), st.integers(0, 10_000))
def test_factorisations(n, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) + n * np.eye(n)
    low, u, order, sign = kernels.lu(a)
    assert np.allclose(low @ u, a[order]) and np.allclose(np.tril(low, -1) + np.eye(n), low) and np.allclose(np.triu(u), u)
    assert np.isclose(np.prod(np.diag(u)) * sign, np.linalg.det(a)) and np.isclose(kernels.laplace(a), np.linalg.det(a))
    q = kernels.gram_schmidt(a)
    assert np.allclose(q.T @ q, np.eye(n))
    s = a @ a.T
    r = kernels.cholesky(s)
    assert np.allclose(r.T @ r, s) and np.allclose(np.triu(r), r)
    assert np.allclose(kernels.eigen_symmetric(s), np.sort(np.linalg.eigvalsh(s))[::-1])
    h = kernels.hessenberg(a)
    assert np.allclose(np.tril(h, -2), 0) and np.allclose(np.sort(np.linalg.eigvals(h)), np.sort(np.linalg.eigvals(a)), atol=1e-6)
    assert np.allclose(kernels.inverse(a) @ a, np.eye(n))
    sparse = np.where(rng.random((n, n)) < 0.4, a, 0) + n * 2 * np.eye(n)
    b = rng.normal(size=(n, 2))
    for f in (kernels.markowitz, kernels.multifrontal, kernels.banded):
        assert np.allclose(sparse @ f(np.hstack([sparse, b])), b)


def test_singular_and_diagonal():
    assert kernels.gauss(np.array([[1.0, 2, 1], [2, 4, 1]])) is None
    assert kernels.cholesky(np.array([[0.0]])) is None and kernels.gram_schmidt(np.ones((2, 2))) is None
    assert np.allclose(kernels.banded(np.array([[2.0, 0, 4], [0, 4, 4]])), [[2], [1]])


def test_sparse_algebra(spark):
    rng = np.random.default_rng(1)
    a, b = (np.where(rng.random((7, 5)) < 0.4, rng.integers(-3, 4, (7, 5)), 0) for _ in range(2))
    da, db = coo(spark, a), coo(spark, b)
    assert np.array_equal(dense(el.combine(da, db, 1, -1), (7, 5)), a - b)
    assert np.array_equal(dense(product.multiply(da, el.transpose(db)), (7, 7)), a @ b.T)
    assert np.array_equal(dense(product.block_multiply(da, el.transpose(db), 2), (7, 7)), a @ b.T)
    assert np.array_equal(dense(product.gram(da), (7, 7)), a @ a.T)
    assert np.array_equal(dense(el.window(da, 1, 1, 5, 4), (4, 3)), a[1:5, 1:4])
    assert np.array_equal(dense(el.drop_row_column(da, 2, 3), (6, 4)), np.delete(np.delete(a, 2, 0), 3, 1))
    assert np.array_equal(dense(el.add_scalar(da, 2.0, 7, 5), (7, 5)), a + 2)
    assert el.difference(da, da).first()["equal"] and not el.difference(da, db).first()["equal"]


def test_near_zero_is_inclusive(spark):
    m = spark.createDataFrame([(0, 0, 1e-8), (0, 1, -1e-8), (0, 2, 1.0000001e-8), (0, 3, 0.0)], "i long, j long, v double")
    assert [r["j"] for r in el.drop_zeros(m).collect()] == [2]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1.5, 2, 3, 4, -1, 5)], "v double")
    got = {r["bin"]: r["n"] for r in reduce.histogram(df, df["v"], 0.0, 4.0, 4).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 3: 1, -1: 1, 4: 1}


def test_numbered_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as x")
    got = [r["gl_n"] for r in reduce.numbered(df, ["x"]).orderBy("x").collect()]
    assert got == list(range(1000))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.integers(0, 40, (60, 3)), [[500, 500, 500]], [[0, 0, 0]], [[0, 0, 0]]]).astype(float)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "n long, x double, y double, z double")
    for r in spatial.nearest(df, 3.0).collect():
        d = ((p - p[r["n"]]) ** 2).sum(axis=1)
        d[d == 0] = np.inf
        assert r["d2"] == d.min() and r["near"] == int(d.argmin())
    assert spatial.nearest(df, 3.0).count() == len(p)


def test_unique_nodes_keep_order(spark):
    xs = [0.0, 0.8, 1.6, 2.4, 10.0]
    df = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(xs)], "n long, x double, y double, z double")
    assert {r["n"]: r["rep"] for r in spatial.unique_nodes(df, 1.0).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_matching_and_parts(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        edges = [(int(r), int(c)) for r in range(6) for c in range(6) if rng.random() < 0.25]
        got = graph.hopcroft_karp(edges)
        assert all((r, c) in edges for r, c in got.items()) and len(set(got.values())) == len(got)

        def best(rows, used):
            return 0 if not rows else max([best(rows[1:], used)] + [1 + best(rows[1:], used | {c}) for r, c in edges if r == rows[0] and c not in used])

        assert len(got) == best(list(range(6)), frozenset())
    e = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 2), (0, 2, 2)], "g long, r long, c long")
    parts = {(r["side"], r["n"]): r["part"] for r in graph.dulmage_mendelsohn(e.select("r", "c"), graph.matching(e).select("r", "c")).collect()}
    assert parts[("r", 0)] == "H" and parts[("c", 0)] == "H" and parts[("r", 1)] == "V" and parts[("c", 2)] == "V"


def test_graph_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4), (7, 8)], "src long, dst long")
    assert sorted(map(tuple, graph.transitive_reduction(e).collect())) == [(1, 2), (2, 3), (3, 4), (7, 8)]
    assert {r["n"]: r["root"] for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}
    hops = {(r["s"], r["n"]): r["hops"] for r in graph.reach(e, spark.createDataFrame([(1,)], "n long")).collect()}
    assert hops == {(1, 1): 0, (1, 2): 1, (1, 3): 1, (1, 4): 1}


def test_lattice_fills_space(spark):
    t = mesh.bcc_lattice(4, 4, 4, spark)
    rows = [tuple(r) for r in t.collect()]
    assert len(rows) == 3 * 3 * 4 * 4 * 4 and len(set(rows)) == len(rows)
    assert mesh.internal_nodes(t.selectExpr("monotonically_increasing_id() e", "*")).count() > 0


@pytest.mark.parametrize("banner,cells", [("real general", {(0, 0): 1.0, (1, 0): 2.0}), ("real symmetric", {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 2.0}), ("real skew-symmetric", {(0, 0): 1.0, (1, 0): 2.0, (0, 1): -2.0})])
def test_matrix_market(spark, tmp_path, banner, cells):
    p = tmp_path / "a.mtx"
    p.write_text(f"%%MatrixMarket matrix coordinate {banner}\n% note\n\n2 2 3\n1 1 1.0\n2 1 2.0\n2 2 1e-9\n")
    m, shape = matrix_market.read(spark, str(p))
    assert {(r["i"], r["j"]): r["v"] for r in m.collect()} == cells and shape == (2, 2, False)


def test_matrix_market_kinds(spark, tmp_path):
    p = tmp_path / "b.mtx"
    p.write_text("%%MatrixMarket matrix coordinate complex hermitian\n2 2 1\n2 1 3 4\n")
    assert sorted((r["i"], r["j"], r["v"], r["iv"]) for r in matrix_market.read(spark, str(p))[0].collect()) == [(0, 1, 3, -4), (1, 0, 3, 4)]
    p.write_text("%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n")
    assert [(r["i"], r["j"], r["v"]) for r in matrix_market.read(spark, str(p))[0].collect()] == [(1, 0, 1.0)]
    p.write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert dense(matrix_market.read(spark, str(p))[0], (2, 2)).tolist() == [[1, 3], [2, 4]]


def test_obj_patches(spark, tmp_path):
    p = tmp_path / "m.obj"
    p.write_text("g box\nv  0 0 0\nv  1 0 0\nv  0 1 0\nv 0 0 1\nusemtl x\nf 1 2 3\ns 5\nf 1//9 2//9 4//9\nf 1/3/9 2/3/9 3/2/1 4/1/1\n")
    v, c = obj.read(spark, str(p))
    assert v.count() == 4
    got = {}
    for r in c.orderBy("p", "k").collect():
        got.setdefault((r["p"], r["patch"]), []).append(r["n"])
    assert got == {(0, None): [0, 1, 2], (1, "5"): [0, 1, 3], (2, "5"): [0, 1, 2, 3]}


def test_sample_and_material(spark):
    assert generate.sample(spark, 0, 10, 50, 1).count() == 10
    with pytest.raises(ValueError):
        generate.material(spark, "wood")


def test_segments_and_tetrahedra(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import geometry as geo

    row = {"x0": 0.0, "y0": 0.0, "z0": 0.0, "x1": 1.0, "y1": 0.0, "z1": 0.0, "x2": 0.0, "y2": 1.0, "z2": 0.0, "x3": 0.0, "y3": 0.0, "z3": 1.0}
    df = spark.createDataFrame([row])
    ps = tuple(geo.point(k) for k in range(4))
    at = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = df.select(geo.segment_tetra(at(0.1, 0.1, 0.1), at(0.1, 0.1, -5), ps).alias("a"), geo.segment_tetra(at(5, 5, 5), at(6, 6, 6), ps).alias("b"), *[c.alias(f"c{k}") for k, c in enumerate(geo.facet_circum_center(*ps[:3]))]).first()
    assert got["a"] == (True, False, 8) and got["b"] == (False, False, 0)
    assert np.allclose([got["c0"], got["c1"], got["c2"]], [0.5, 0.5, 0])
    m = [[F.lit(float(v)) for v in r] for r in D5]
    inv = df.select(*[v.alias(f"m{i}{j}") for i, r in enumerate(geo.inverse3(m)) for j, v in enumerate(r)]).first()
    assert np.allclose(np.array(inv).reshape(3, 3), np.linalg.inv(D5))


def test_tree_balance(spark):
    leaves = spark.createDataFrame([(p,) for p in [str(k) for k in range(1, 8)] + ["0" + str(k) for k in range(7)] + ["07" + str(k) for k in range(7)] + ["077" + str(k) for k in range(8)]], "path string")
    out = spatial.balance(spatial.as_grid(leaves))
    cells = {tuple(r) for r in out.select("level", "ix", "iy", "iz").collect()}
    assert sum(8.0**-c[0] for c in cells) == 1.0
    assert spatial.neighbours(out).where("level - level2 > 1").count() == 0


def test_levels_and_edges(spark):
    assert spatial.level_for(8.0, 1.0) == 3 and spatial.level_for(8.0, 1.4) == 3 and spatial.level_for(8.0, 1.9) == 2 and spatial.granularity_at(8.0, 3) == 1.0
    e = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 2.5, 0.5, 0.5)], "id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert sorted(r["cx"] for r in spatial.edges_in_cells(e, 1.0).collect()) == [0, 1, 2]


def test_lattice_inside_a_box(spark):
    c = [(x, y, z) for x in (0.0, 4.0) for y in (0.0, 4.0) for z in (0.0, 4.0)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    tris = [t for a, b, d, e in quads for t in ((a, b, d), (a, d, e))]
    df = spark.createDataFrame([(n, *c[a], *c[b], *c[d]) for n, (a, b, d) in enumerate(tris)], "f long, " + ", ".join(f"{x}{k} double" for k in range(3) for x in "xyz"))
    got = spatial.lattice_inside(df, (-0.7, -0.9, -0.8), 1.0, (6, 6, 6), 2.0).collect()
    assert len(got) == 4**3 and all(0 < r[k] < 4 for r in got for k in "xyz")


def test_qr_and_events(spark):
    a = np.array([[4.0, 1, 2], [1, 3, 0], [2, 0, 5]])
    q = kernels.gram_schmidt(a)
    r = dense(product.qr_upper(coo(spark, q), coo(spark, a)), (3, 3))
    assert np.allclose(q @ r, a)


@pytest.mark.parametrize("kind", ["tet4", "tet10", "hex8", "hex20"])
def test_shapes_and_quadrature(kind):
    from gridloom.functions import shapes

    rng = np.random.default_rng(2)
    for _ in range(5):
        p = rng.random(3) / 4
        v, d = shapes.shape(kind, p)
        assert len(v) == shapes.NODES[kind] and np.isclose(v.sum(), 1) and np.allclose(d.sum(axis=0), 0)
        for k in range(3):
            e = np.eye(3)[k] * 1e-6
            assert np.allclose((shapes.shape(kind, p + e)[0] - shapes.shape(kind, p - e)[0]) / 2e-6, d[:, k], atol=1e-6)
    x, w = shapes.quadrature(kind, 4)
    want = (8.0, 8 / 9) if kind[0] == "h" else (1 / 6, 2 * 2 / 5040)
    assert np.isclose(w.sum(), want[0]) and np.isclose((w * x[:, 0] ** 2 * x[:, 1] ** 2).sum(), want[1])


def test_element_matrices(spark):
    from gridloom.functions import shapes

    tet = np.array([[0.0, 0, 0], [2, 0, 0], [0, 3, 0], [0, 0, 4]])
    k = shapes.element_stiffness("tet4", tet, 1.0, 2.0)
    assert np.allclose(k, k.T) and np.allclose(k.reshape(4, 3, 4, 3).sum(axis=2), 0)
    assert np.allclose(shapes.element_mass("tet4", tet, 5.0), 5 * 4 / 20 * (np.ones((4, 4)) + np.eye(4)))
    rows = spark.createDataFrame([(0, i, i, *map(float, x)) for i, x in enumerate(tet)], "e long, k int, n long, x double, y double, z double")
    assert np.allclose(dense(shapes.assemble(rows, "tet4", 1.0, 2.0), (12, 12)), k)
    flat = spark.createDataFrame([(0, 0, 1, 2, 3, *map(float, tet.ravel()))], "e long, n0 long, n1 long, n2 long, n3 long, " + ", ".join(f"{c}{i} double" for i in range(4) for c in "xyz"))
    assert np.allclose(dense(mesh.assemble_elastic(flat, 1.0, 2.0), (12, 12)), k)
    h = shapes.element_stiffness("hex8", shapes.HEX * [1, 2, 3], 1.0, 1.0)
    assert np.allclose(h, h.T) and np.linalg.matrix_rank(h, tol=1e-8) == 18


def test_text_sinks(spark):
    from gridloom.sources import text

    m = spark.createDataFrame([(0, 0, 1.0), (0, 2, -123.0), (1, 1, 2.5)], "i long, j long, v double")
    assert [r["value"] for r in text.grid_lines(m, 3).orderBy("i").collect()] == ["   1      -     -123 ", "   -     2.50    -   "]
    assert text.sparse_lines(m).orderBy("i").first()["value"] == "row(0): [(0, 0, 1.000), (0, 2, -123.000)]"
    e = spark.createDataFrame([(1, 2, "L")], "src long, dst long, kind string")
    assert [r["value"] for r in text.dot_lines(e).orderBy("ord").collect()] == ["digraph g {", '  1 -> 2 [label="L"];', "}"]
    c = spark.createDataFrame([(1, 0, 1, 0)], "level int, ix long, iy long, iz long")
    lines = [r["value"] for r in text.cell_lines(c, (0.0, 0.0, 0.0), 4.0).orderBy("k").collect()]
    assert len(lines) == 14 and lines[0] == "v  0.0 2.0 0.0" and lines[7] == "v  2.0 4.0 2.0"


def test_fronts_of_sparse_systems(spark):
    rng, rows, want = np.random.default_rng(40), [], {}
    for mat in range(8):
        n = int(rng.integers(1, 30))
        while True:
            a = np.where(rng.random((n, n)) < min(1, 2.5 / n), rng.integers(-5, 6, (n, n)), 0).astype(float)
            a[np.arange(n), rng.permutation(n)] = rng.integers(1, 6, n)
            if abs(np.linalg.det(a)) > 0.5:
                break
        x = rng.integers(-4, 5, (n, 2)).astype(float)
        b = a @ x
        rows += [(mat, i, j, a[i, j]) for i in range(n) for j in range(n) if a[i, j]] + [(mat, i, n + k, b[i, k]) for i in range(n) for k in range(2)]
        want |= {(mat, i, k): x[i, k] for i in range(n) for k in range(2)}
    systems = spark.createDataFrame([(m, i, j, float(v)) for m, i, j, v in rows], "mat long, i long, j long, v double")
    tree = fronts.supernodes(systems)
    upper, levels = fronts.factorise(systems, tree)
    node = {(r["mat"], r["c"]): r["node"] for r in tree.collect()}
    left = [r for r in upper.select("mat", "node", "col").distinct().collect() if node[r["mat"], r["col"]] != r["node"]]
    assert left and levels > 1  # some pivots were left to parents
    got = {(r["mat"], r["i"], r["k"]): r["x"] for r in fronts.solve(systems).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


@pytest.mark.parametrize("kind", ["tri3", "tri6", "quad4", "quad8"])
def test_face_loads_add_up_to_the_area(kind):
    rng = np.random.default_rng(41)
    p = rng.normal(size=(3, 3))
    corners = p if kind.startswith("tri") else np.stack([p[0], p[1], p[1] + p[2] - p[0], p[2]])
    nodes = np.concatenate([corners, [(corners[a] + corners[b]) / 2 for a, b in shapes.EDGES.get(kind, ())]]) if kind in shapes.EDGES else corners
    area = np.linalg.norm(np.cross(p[1] - p[0], p[2] - p[0])) / (2 if kind.startswith("tri") else 1)
    share = shapes.face_load(kind, nodes)
    assert len(share) == shapes.NODES[kind] and np.isclose(share.sum(), area)
    assert np.allclose(share @ nodes, area * corners.mean(axis=0))
    for at in rng.random((5, 2)) / 2:
        values, grads = shapes.shape(kind, at)
        step = np.array([shapes.shape(kind, at + h)[0] - shapes.shape(kind, at - h)[0] for h in np.eye(2) * 1e-6]).T / 2e-6
        assert np.isclose(values.sum(), 1) and np.allclose(step, grads, atol=1e-6)


def test_running_sums_and_last_values(spark, monkeypatch):
    monkeypatch.setattr(reduce, "RUN", 7)
    rows = [(i, i % 5, "s%d" % i if i % 11 == 3 else None) for i in range(100)]
    got = reduce.running(spark.createDataFrame(rows, "i long, v long, s string").repartition(3), ["i"], sums=("v",), lasts=("s",)).collect()
    total, last = 0, None
    for r in sorted(got, key=lambda r: r["i"]):
        total, last = total + r["v"], r["s"] or last
        assert (r["gl_n"], r["sum_v"], r["last_s"]) == (r["i"], total, last)
    assert len(got) == 100 and reduce.running(spark.createDataFrame([], "i long, v long"), ["i"], sums=("v",)).count() == 0


def test_obj_indices_that_count_back(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v  0 0 0\nv  1 0 0\nv  0 1 0\ns 1\nf -3 -2 -1\nv  0 0 1\ns off\nf 1//1 2//2 -1\n")
    nodes, corners = obj.read(spark, str(tmp_path / "a.obj"))
    assert sorted(r["n"] for r in nodes.collect()) == [0, 1, 2, 3]
    assert sorted(map(tuple, corners.select("p", "k", "n", "patch").collect())) == [(0, 0, 0, "1"), (0, 1, 1, "1"), (0, 2, 2, "1"), (1, 0, 0, "off"), (1, 1, 1, "off"), (1, 2, 3, "off")]


def test_obj_first_object(spark, tmp_path):
    """The first object ends at the first vertex after a face; later objects count their vertices on."""
    (tmp_path / "two.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\nf -1 -2 -3\nv 5 5 5\nv 6 5 5\nv 5 6 5\nf 4 5 6\n")
    (tmp_path / "one.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\n")
    shape = lambda name, first: tuple(t.count() for t in obj.read(spark, str(tmp_path / name), first))
    assert shape("two.obj", True) == (3, 6)
    assert shape("two.obj", False) == (6, 9)
    assert shape("one.obj", True) == (3, 3)


def test_obj_loose_faces_leave_out_what_is_no_tetrahedron(spark):
    faces = [(9, (4, 5, 6)), (2, (0, 1, 2)), (7, (0, 2, 3)), (1, (0, 1, 3)), (5, (1, 2, 3))]
    c = spark.createDataFrame([(p, k, n) for p, ns in faces for k, n in enumerate(ns)], "p long, k int, n long")
    assert [tuple(r) for r in obj.tetrahedra_of_faces(c).collect()] == [(0, 0, 1, 2, 3)]
    assert obj.tetrahedra_of_faces(c.limit(0)).count() == 0


def test_supernode_edges_follow_the_tree(spark):
    from gridloom.operators import fronts

    cells = [(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 0), (3, 1), (2, 3), (0, 4)]
    m = spark.createDataFrame([(5, i, j, 1.0) for i, j in cells], "mat long, i long, j long, v double")
    tree = spark.createDataFrame([(5, 0, 0), (5, 1, 0), (5, 2, 2), (5, 3, 3)], "mat long, c long, node long")
    assert sorted(tuple(r) for r in fronts.supernode_edges(m, tree).collect()) == [(5, 3, 0, "L"), (5, 3, 2, "U")]
    own = fronts.supernode_edges(m, fronts.supernodes(m)).collect()
    assert all(r["src"] > r["dst"] for r in own)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("axis", ["x", "y", "z"])
def test_ray_counts_against_each_pair(spark, axis, monkeypatch):
    from gridloom.operators import crossings

    monkeypatch.setattr(spatial, "RAYS", 60)
    monkeypatch.setattr(crossings, "LEAF", 8)
    rng = np.random.default_rng(5)
    rays, tris = rng.integers(-50, 50, (150, 3)).astype(float), rng.integers(-60, 60, (90, 3, 3)).astype(float)
    tris[0, :, "xyz".index(axis)] = 9000.0  # far up is a crossing too
    u, v, w = (("xyz".index(axis) + k) % 3 for k in (1, 2, 3))
    want = {}
    for n, q in enumerate(rays):
        for f, t in enumerate(tris):
            s = [(t[b][u] - t[a][u]) * (q[v] - t[a][v]) - (t[b][v] - t[a][v]) * (q[u] - t[a][u]) for a, b in ((0, 1), (1, 2), (2, 0))]
            if min(s) > 0 or max(s) < 0:
                h = (t[0][w] * s[1] + t[1][w] * s[2] + t[2][w] * s[0]) / sum(s)
                if h > q[w]:
                    want.setdefault(n, []).append((h, f))
    r = spark.createDataFrame([(n, *map(float, q)) for n, q in enumerate(rays)], "ray long, x double, y double, z double")
    t = spark.createDataFrame([(f, *map(float, t.ravel())) for f, t in enumerate(tris)], "f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    counted = spatial.ray_counts(r, t, axis)
    assert {x["ray"]: x["hits"] for x in counted.collect()} == {n: len(h) for n, h in want.items()}
    assert "Window" not in _plan(counted)
    hits = [(x["ray"], x["f"], x["t"], x["k"]) for x in spatial.ray_hits(r, t, axis).collect()]
    assert sorted(hits) == sorted((n, f, h, k) for n, l in want.items() for k, (h, f) in enumerate(sorted(l), 1))
    assert spatial.ray_counts(r, t.limit(0), axis).count() == 0 and spatial.ray_counts(r.limit(0), t, axis).count() == 0


def test_rays_on_an_edge_or_the_plane_do_not_cross(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 4.0, 0.0, 1.0, 0.0, 4.0, 1.0)], "f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    r = spark.createDataFrame([(0, 2.0, 0.0, 0.0), (1, 1.0, 1.0, 1.0), (2, 1.0, 1.0, 0.0)], "ray long, x double, y double, z double")
    assert [tuple(x) for x in spatial.ray_counts(r, t).collect()] == [(2, 1)]


def test_biased_centroid_weighs_as_written(spark):
    from pyspark.sql import functions as F

    from gridloom.functions import geometry as geo

    ps = tuple((F.lit(100.0 if k == 0 else 0.0),) * 3 for k in range(4))
    flags = lambda n: tuple(F.lit(k < n) for k in range(4))
    got = spark.range(1).select(geo.biased_centroid(ps, flags(1))[0].alias("a"), geo.biased_centroid(ps, flags(2))[0].alias("b")).first()
    assert (got["a"], got["b"]) == (100 * 0.07, 100 * 0.1)


def test_segment_hits_stay_where_they_are_found(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS", 1500)  # blocks of 25 segments
    rng = np.random.default_rng(6)
    ends, tris = rng.integers(-9, 9, (90, 2, 3)).astype(float), rng.integers(-9, 9, (60, 3, 3)).astype(float)
    six = lambda a, b, c, d: float(np.dot(b - a, np.cross(c - a, d - a)))
    want = []
    for n, (p, q) in enumerate(ends):
        own = []
        for f, (a, b, c) in enumerate(tris):
            vp, vq = six(a, b, c, p), six(a, b, c, q)
            s = [six(p, q, a, b), six(p, q, b, c), six(p, q, c, a)]
            if vp != vq and vp * vq <= 0 and (min(s) >= 0 or max(s) <= 0):
                own.append((vp / (vp - vq), f, 2 if vq > vp else -2))
        want += [(n, f, t, status, k) for k, (t, f, status) in enumerate(sorted(own), 1)]
    seg = spark.createDataFrame([(n, *map(float, e.ravel())) for n, e in enumerate(ends)], "id long, px double, py double, pz double, qx double, qy double, qz double")
    t = spark.createDataFrame([(f, *map(float, t.ravel())) for f, t in enumerate(tris)], "f long, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    got = spatial.segment_hits(seg, t)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 100
    assert "Window" not in _plan(got)


def test_unique_nodes_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(spatial, "stored", lambda df, keep=spatial.stored: rounds.append(1) or keep(df))
    # a chain of close nodes all near the first, copies of a place, and nodes without a place
    at = [(float(k) / 40, 0.0, 0.0) for k in range(40)] + [(0.5, 0.0, 0.0), (1.75, 0.0, 0.0), (1.75, 0.0, 0.0), (None, 0.0, 0.0), (None, 0.0, 0.0), (float("nan"), 0.0, 0.0), (float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(at)], "n long, x double, y double, z double")
    got = {r["n"]: r["rep"] for r in spatial.unique_nodes(df, 1.0).collect()}
    assert got == {k: 0 for k in range(41)} | {41: 41, 42: 41} | {k: k for k in range(43, 47)}
    assert len(rounds) < 20

"""Meshes: incidence, adjacency, edges, refinement lattices and finite-element assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import cross, distance, dot, normal, point, six_volume, sub
from gridloom.operators.graph import components
from gridloom.operators.reduce import histogram, numbered
from gridloom.plans.loops import stored


def corners(tets: DataFrame) -> DataFrame:
    """(e, k, n): each tetrahedron's corners."""
    return tets.select("e", F.posexplode(F.array(*[F.col(f"n{k}") for k in range(4)])).alias("k", "n"))


def support(corner: DataFrame) -> DataFrame:
    """The sorted elements at each node."""
    return corner.groupBy("n").agg(F.sort_array(F.collect_list("e")).alias("es"))


def facet_neighbours(tets: DataFrame) -> DataFrame:
    """Pairs of elements with a facet in common: grouped by the facet's sorted nodes, no self-join."""
    ns = [F.col(f"n{k}") for k in range(4)]
    facets = tets.select("e", F.posexplode(F.array(*[F.array_sort(F.array(*[n for i, n in enumerate(ns) if i != k])) for k in range(4)])).alias("k", "f"))
    pairs = facets.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("e", "k"))).alias("s")).where(F.size("s") == 2)
    return pairs.select(F.col("s")[0]["e"].alias("a"), F.col("s")[1]["e"].alias("b"), F.col("s")[0]["k"].alias("ka"), F.col("s")[1]["k"].alias("kb"))


def polygon_neighbours(facets: DataFrame) -> DataFrame:
    """(f, g, shared, edge, same_patch): the neighbours g of each facet f, of triangles (f, n0..n2, patch).

    ``shared`` is the number of nodes in common: 2 at an edge, 1 at a corner.
    ``edge`` is f's edge (0: n0 n1, 1: n1 n2, 2: n2 n0; -1 at a corner). Of
    facets over the same three nodes only the one of the least id takes part.
    """
    row = F.struct("f", "n0", "n1", "n2", "patch")
    once = facets.groupBy(F.array_sort(F.array("n0", "n1", "n2")).alias("key")).agg(F.min(row).alias("t")).select("t.*")
    at = once.select("f", "patch", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(1 << k).alias("m")) for k in range(3)])).alias("c")).select("f", "patch", "c.n", "c.m")
    other = at.select(F.col("f").alias("g"), F.col("patch").alias("q"), "n")
    pairs = at.join(other, "n").where("f <> g").groupBy("f", "g").agg(F.count("*").alias("shared"), F.bit_or("m").alias("m"), F.first(F.col("patch").eqNullSafe(F.col("q"))).alias("same_patch"))
    return pairs.select("f", "g", "shared", F.when(F.col("m") == 3, 0).when(F.col("m") == 6, 1).when(F.col("m") == 5, 2).otherwise(-1).alias("edge"), "same_patch")


def border_polygons(neighbours: DataFrame) -> DataFrame:
    """Facets (f, edges) of :func:`polygon_neighbours` at the border of their patch, and how many neighbours they have over it by an edge."""
    return neighbours.where("shared = 2 and not same_patch").groupBy("f").agg(F.count("*").alias("edges"))


def shared_nodes(corner: DataFrame) -> DataFrame:
    """How many nodes each pair of elements a < b has in common (1 corner, 2 edge, 3 facet), counted by node."""
    c = corner.groupBy("n").agg(F.sort_array(F.collect_set("e")).alias("es")).where(F.size("es") > 1)
    pairs = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return c.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))


#: Flags of a tetrahedron's facets and edges by the corners that they hold.
INTERFACES = {(0, 1, 2): 1, (0, 2, 3): 2, (0, 1, 3): 4, (1, 2, 3): 8, (0, 1): 16, (0, 2): 32, (0, 3): 64, (1, 2): 128, (1, 3): 256, (2, 3): 512}


def interfaces(tets: DataFrame) -> DataFrame:
    """Pairs (a, b, flags) of elements a < b that share an edge or a facet; flags: a's INTERFACES flag, and b's sixteen bits higher.

    Elements meet at shared edges, not at shared nodes: few elements have an edge in common.
    """
    ns = [F.col(f"n{k}") for k in range(4)]
    edges = F.array(*[F.struct(F.least(ns[p], ns[q]).alias("a"), F.greatest(ns[p], ns[q]).alias("b"), F.lit(1 << p | 1 << q).alias("m")) for p in range(4) for q in range(p + 1, 4)])
    at = tets.select("e", F.explode(edges).alias("p")).groupBy("p.a", "p.b").agg(F.sort_array(F.collect_list(F.struct("e", "p.m"))).alias("es")).where(F.size("es") > 1).select("es")
    pairs = at.select(F.posexplode("es").alias("i", "p"), "es").select("p", F.explode(F.expr("slice(es, i + 2, size(es))")).alias("q"))
    met = pairs.groupBy(F.col("p.e").alias("a"), F.col("q.e").alias("b")).agg(F.bit_or("p.m").alias("ma"), F.bit_or("q.m").alias("mb"))
    table = F.create_map(*[F.lit(x) for corners, flag in INTERFACES.items() for x in (sum(1 << c for c in corners), flag)])
    return met.select("a", "b", (table[F.col("ma")] + F.call_function("shiftleft", table[F.col("mb")], F.lit(16))).alias("flags"))


def boundary_nodes(tets: DataFrame) -> DataFrame:
    """Nodes of facets that only one element has."""
    ns = [F.col(f"n{k}") for k in range(4)]
    facets = tets.select(F.explode(F.array(*[F.array_sort(F.array(*[n for i, n in enumerate(ns) if i != k])) for k in range(4)])).alias("f"))
    return facets.groupBy("f").agg(F.count("*").alias("k")).where("k = 1").select(F.explode("f").alias("n")).distinct()


def internal_nodes(tets: DataFrame) -> DataFrame:
    return corners(tets).select("n").distinct().join(boundary_nodes(tets), "n", "left_anti")


def unique_edges(tets: DataFrame) -> DataFrame:
    """Distinct edges (a < b) with the elements at each."""
    ns = [F.col(f"n{k}") for k in range(4)]
    pairs = F.array(*[F.struct(F.least(ns[p], ns[q]).alias("a"), F.greatest(ns[p], ns[q]).alias("b")) for p in range(4) for q in range(p + 1, 4)])
    return tets.select("e", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("elements"))


def edge_spread(tets: DataFrame, bins: int = 8, border: bool = False) -> DataFrame:
    """One row on the distinct edges' lengths: edges, least, mean, greatest, spread (counts in right-closed bins of equal width); ``border``: only edges of facets that one element has.

    Takes tetrahedra with their corners (e, n0..n3, x0..z3).
    """
    node = [F.struct(F.col(f"n{k}").alias("n"), *[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(4)]
    facets = tets.select("e", F.explode(F.array(*[F.array_sort(F.array(*[p for i, p in enumerate(node) if i != k])) for k in range(4)])).alias("f"))
    if border:
        facets = facets.groupBy("f").agg(F.count("*").alias("k")).where("k = 1")
    pairs = facets.select(F.explode(F.array(*[F.struct(F.col("f")[a].alias("a"), F.col("f")[b].alias("b")) for a, b in ((0, 1), (0, 2), (1, 2))])).alias("p"))
    ends = pairs.groupBy(F.col("p.a.n").alias("a"), F.col("p.b.n").alias("b")).agg(F.min("p").alias("p"))
    lengths = stored(ends.select("a", "b", distance(*[tuple(F.col(f"p.{e}.{c}") for c in "xyz") for e in "ab"]).alias("length")))
    whole = lengths.agg(F.count("*").alias("edges"), F.min("length").alias("least"), F.avg("length").alias("mean"), F.max("length").alias("greatest"))
    seen = whole.first()
    if not seen["edges"]:
        return whole.withColumn("spread", F.array(*[F.lit(0).cast("bigint")] * bins))
    counts = histogram(lengths, F.col("length"), seen["least"], seen["greatest"], bins).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")) if seen["greatest"] > seen["least"] else lengths.agg(F.create_map(F.lit(0), F.count("*")).alias("m"))
    return whole.join(counts).select("edges", "least", "mean", "greatest", F.array(*[F.coalesce(F.col("m")[k], F.lit(0).cast("bigint")) for k in range(bins)]).alias("spread"))


def patch_labels(facets: DataFrame, angle: float) -> DataFrame:
    """(f, patch): the least facet of each facet's patch, of facets (f, n0..n2, x0..z2).

    Facets that share an edge are of one patch where their normals are
    ``angle`` degrees apart or less. Detached parts are patches of their own;
    a degenerate facet has no normal and is one too.
    """
    n = normal(*[point(k) for k in range(3)])
    own = facets.select("f", F.struct(*[c.alias(x) for c, x in zip(n, "xyz", strict=True)]).alias("n"), F.explode(F.array(*[F.struct(F.least(f"n{a}", f"n{b}").alias("a"), F.greatest(f"n{a}", f"n{b}").alias("b")) for a, b in ((0, 1), (1, 2), (0, 2))])).alias("edge"))
    at = own.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("f", "n"))).alias("fs")).where(F.size("fs") > 1).select("fs")
    pairs = at.select(F.posexplode("fs").alias("i", "p"), "fs").select("p", F.explode(F.expr("slice(fs, i + 2, size(fs))")).alias("q"))
    cosine = sum((F.col(f"p.n.{c}") * F.col(f"q.n.{c}") for c in "yz"), F.col("p.n.x") * F.col("q.n.x"))
    smooth = pairs.where(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) <= angle)
    found = components(smooth.select(F.col("p.f").alias("src"), F.col("q.f").alias("dst"))).withColumnRenamed("n", "f")
    return facets.select("f").join(found, "f", "left").select("f", F.coalesce("root", "f").alias("patch"))


def surface(nodes: DataFrame, corners: DataFrame, angle: float = 24.0) -> DataFrame:
    """Triangles (f, n0..n2, x0..z2, patch) of nodes and polygon corners as an OBJ file gives them, labelled anew by ``patch_labels``.

    Polygons with more or fewer corners than three are left out.
    """
    at = corners.select("p", "k", "n").join(nodes, "n").groupBy(F.col("p").alias("f")).agg(F.sort_array(F.collect_list(F.struct("k", "n", "x", "y", "z"))).alias("s")).where(F.size("s") == 3)
    facets = at.select("f", *[F.get("s", F.lit(k))[c].alias(f"{c}{k}") for k in range(3) for c in ("n", "x", "y", "z")])
    return facets.join(patch_labels(facets, angle), "f")


def worst(elements: DataFrame, quality: str, good: float, k: int) -> DataFrame:
    """The ``k`` elements of least quality below ``good``, ties by id."""
    return elements.where(F.col(quality) < good).orderBy(quality, "e").limit(k)


def _gradients() -> list[tuple[Column, Column, Column]]:
    """Six volumes times the gradient of each corner's shape function."""
    p = [point(k) for k in range(4)]
    order = ((1, 3, 2), (0, 2, 3), (0, 3, 1), (0, 1, 2))
    return [cross(sub(p[b], p[a]), sub(p[c], p[a])) for a, b, c in order]


def assemble_laplace(tets: DataFrame) -> DataFrame:
    """The stiffness matrix of the Laplace operator: g_a . g_b / (36 V) over each element's corners, summed by cell before the shuffle."""
    v6, g = F.abs(six_volume(*[point(k) for k in range(4)])), _gradients()
    cells = F.array(*[F.struct(F.col(f"n{a}").alias("i"), F.col(f"n{b}").alias("j"), (dot(g[a], g[b]) / (6 * v6)).alias("v")) for a in range(4) for b in range(4)])
    return tets.where(v6 > 0).select(F.explode(cells).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v").alias("v"))


def assemble_mass(tets: DataFrame, density: float, lumped: bool = False) -> DataFrame:
    """The mass matrix of linear elements: density V / 20, doubled on the diagonal; lumped: density V / 4 there."""
    v = F.abs(six_volume(*[point(k) for k in range(4)])) / 6 * density
    if lumped:
        cells = F.array(*[F.struct(F.col(f"n{a}").alias("i"), F.col(f"n{a}").alias("j"), (v / 4).alias("v")) for a in range(4)])
    else:
        cells = F.array(*[F.struct(F.col(f"n{a}").alias("i"), F.col(f"n{b}").alias("j"), (v / (10 if a == b else 20)).alias("v")) for a in range(4) for b in range(4)])
    return tets.select(F.explode(cells).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v").alias("v"))


def assemble_elastic(tets: DataFrame, lam: float, mu: float) -> DataFrame:
    """The stiffness matrix of linear elasticity, three unknowns a node: V (lam d_i N_a d_j N_b + mu d_j N_a d_i N_b + mu delta_ij grad N_a . grad N_b)."""
    v6 = F.abs(six_volume(*[point(k) for k in range(4)]))
    own = F.array(*[F.struct(F.col(f"n{k}").alias("n"), *[c.alias(x) for c, x in zip(g, "xyz", strict=True)]) for k, g in enumerate(_gradients())])
    # corner by corner, so that the expressions stay small enough to compile
    pairs = tets.select(v6.alias("v6"), own.alias("g")).where("v6 > 0").select("v6", "g", F.explode("g").alias("a")).select("v6", "a", F.explode("g").alias("b"))
    g = {k: tuple(F.col(f"{k}.{x}") for x in "xyz") for k in "ab"}
    cells = []
    for p in range(3):
        for q in range(3):
            k = lam * g["a"][p] * g["b"][q] + mu * g["a"][q] * g["b"][p] + (mu * dot(g["a"], g["b"]) if p == q else F.lit(0.0))
            cells.append(F.struct((F.col("a.n") * 3 + p).alias("i"), (F.col("b.n") * 3 + q).alias("j"), (k / (6 * F.col("v6"))).alias("v")))
    return pairs.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.i", "c.j").agg(F.sum("c.v").alias("v"))


def ring_optimum(tets: DataFrame) -> DataFrame:
    """Each node's best place: the volume-weighted mean of its elements' centroids."""
    v6 = F.abs(six_volume(*[point(k) for k in range(4)]))
    mid = [sum((F.col(f"{c}{k}") for k in range(1, 4)), F.col(f"{c}0")) / 4 for c in "xyz"]
    each = tets.select(F.explode(F.array(*[F.col(f"n{k}") for k in range(4)])).alias("n"), v6.alias("w"), *[m.alias(c) for c, m in zip("xyz", mid, strict=True)])
    return each.groupBy("n").agg(*[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in "xyz"])


def ring_circumcentre(tets: DataFrame) -> DataFrame:
    """Each node's best place by circumcentres: the volume-weighted mean of its elements' circumscribed spheres' centres; flat elements don't count.

    Volume times centre is taken without a division, so thin elements do no harm.
    """
    ps = [point(k) for k in range(4)]
    u, v, w = (sub(p, ps[0]) for p in ps[1:])
    d = dot(u, cross(v, w))
    offset = [dot(u, u) * a + dot(v, v) * b + dot(w, w) * c for a, b, c in zip(cross(v, w), cross(w, u), cross(u, v), strict=True)]
    moment = [F.abs(d) * ps[0][k] + F.signum(d) * offset[k] / 2 for k in range(3)]
    each = tets.where(d != 0).select(F.explode(F.array(*[F.col(f"n{k}") for k in range(4)])).alias("n"), F.abs(d).alias("w"), *[m.alias(c) for c, m in zip("xyz", moment, strict=True)])
    return each.groupBy("n").agg(*[(F.sum(c) / F.sum("w")).alias(c) for c in "xyz"])


def elasticity(lam: float, mu: float, strain: DataFrame) -> DataFrame:
    """Stress of isotropic material from strain rows (e, i, j, v): lam trace delta + 2 mu strain."""
    trace = strain.where("i = j").groupBy("e").agg(F.sum("v").alias("t"))
    return strain.join(trace, "e", "left").select("e", "i", "j", (F.when(F.col("i") == F.col("j"), lam * F.coalesce("t", F.lit(0.0))).otherwise(F.lit(0.0)) + 2 * mu * F.col("v")).alias("v"))


def bcc_lattice(nx: int, ny: int, nz: int, spark) -> DataFrame:
    """Tetrahedra of a body-centred lattice: for each inner facet between two cubes and each of its edges, the edge and both centres.

    Cube corners have id 2 (x + (nx + 1) (y + (ny + 1) z)), centres odd ids.
    """
    corner = lambda x, y, z: ((z * (ny + 1) + y) * (nx + 1) + x) * 2
    centre = lambda x, y, z: ((z * ny + y) * nx + x) * 2 + 1
    cubes = spark.range(nx * ny * nz).select((F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    out = []
    for axis, (ux, uy, uz) in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1))):
        p, q = [((0, 1, 0), (0, 0, 1)), ((1, 0, 0), (0, 0, 1)), ((1, 0, 0), (0, 1, 0))][axis]
        ring = [(0, 0, 0), p, tuple(a + b for a, b in zip(p, q, strict=True)), q]
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ends = [corner(x + ux + r[0], y + uy + r[1], z + uz + r[2]) for r in (a, b)]
            out.append((x + ux < nx if ux else y + uy < ny if uy else z + uz < nz, F.struct(ends[0].alias("n0"), ends[1].alias("n1"), centre(x, y, z).alias("n2"), centre(x + ux, y + uy, z + uz).alias("n3"))))
    tets = F.filter(F.array(*[F.when(ok, t) for ok, t in out]), lambda t: t.isNotNull())
    return cubes.select(F.explode(tets).alias("t")).select(*[F.col(f"t.n{k}").cast("bigint").alias(f"n{k}") for k in range(4)])


def without_elements(pairs: DataFrame, gone: DataFrame) -> DataFrame:
    """Neighbour pairs (a, b, ...) once the elements ``gone`` (e) are deleted: none of their referrals stays."""
    ids = gone.select(F.col("e").alias("gl_e")).distinct()
    return pairs.join(ids, F.col("a") == F.col("gl_e"), "left_anti").join(ids, F.col("b") == F.col("gl_e"), "left_anti")


def with_neighbours(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``more`` ones inserted, in either order; a pair that is there already stays as it is."""
    ordered = more.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select("a", "b").unionByName(ordered.join(pairs, ["a", "b"], "left_anti"))


def delete_nodes(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The node store (n, ...) without ``gone`` (n); other nodes keep their ids."""
    return store.join(gone.select("n"), "n", "left_anti")


def add_nodes(store: DataFrame, freed: DataFrame, more: DataFrame, order: list[str]) -> DataFrame:
    """The node store (n, x, y, z) with ``more`` (x, y, z and columns of ``order``) added in that order.

    New nodes take the ids of ``freed`` (n, step: when it was deleted), the
    last deleted first, then ids beyond all that were ever given.
    """
    given = store.select("n", F.lit(0).alias("f")).unionAll(freed.select("n", F.lit(1))).agg(F.max("n").alias("top"), F.sum("f").alias("free")).first()
    beyond = (-1 if given["top"] is None else given["top"]) + 1 - (given["free"] or 0)
    slots = numbered(freed.select("n", (-F.col("step")).alias("gl_s")), ["gl_s"]).select("gl_n", "n")
    placed = numbered(more, order).join(slots, "gl_n", "left")
    return store.select("n", "x", "y", "z").unionByName(placed.select(F.coalesce("n", F.col("gl_n") + beyond).alias("n"), "x", "y", "z"))


def traction(tets: DataFrame, loads: DataFrame) -> DataFrame:
    """The load vector (i, v), three unknowns a node, of loads (e, k, tx, ty, tz) by area on the facets opposite to corners k.

    A linear facet's corners take a third of its load each; loads on one facet add up.
    """
    met = tets.join(loads, "e")
    out = []
    for k in range(4):
        own = [c for c in range(4) if c != k]
        a, b, c = (point(q) for q in own)
        n = cross(sub(b, a), sub(c, a))
        third = F.sqrt(dot(n, n)) / 6
        out.append(F.when(F.col("k") == k, F.array(*[F.struct((F.col(f"n{q}") * 3 + x).alias("i"), (F.col(f"t{axis}") * third).alias("v")) for q in own for x, axis in enumerate("xyz")])))
    return met.select(F.explode(F.coalesce(*out)).alias("c")).groupBy("c.i").agg(F.sum("c.v").alias("v"))

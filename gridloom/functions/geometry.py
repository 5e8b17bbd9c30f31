"""Vectors, triangles and tetrahedra as column expressions. A point is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]
#: Quotients are null, not an error, where a degenerate shape makes the divisor 0.
over = F.try_divide


def point(suffix: object) -> Point:
    return tuple(F.col(f"{c}{suffix}") for c in "xyz")


def sub(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def distance(a: Point, b: Point) -> Column:
    d = sub(a, b)
    return F.sqrt(dot(d, d))


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    n = cross(sub(b, a), sub(c, a))
    return F.sqrt(dot(n, n)) / 2


def heron_area(a: Point, b: Point, c: Point) -> Column:
    p, q, r = distance(a, b), distance(b, c), distance(c, a)
    s = (p + q + r) / 2
    return F.sqrt(s * (s - p) * (s - q) * (s - r))


def normal(a: Point, b: Point, c: Point) -> Point:
    """Unit normal; null for a degenerate triangle."""
    n = cross(sub(b, a), sub(c, a))
    length = F.sqrt(dot(n, n))
    return tuple(over(k, length) for k in n)


def det3(a: Point, b: Point, c: Point) -> Column:
    return dot(a, cross(b, c))


def six_volume(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Six times the signed volume."""
    return det3(sub(b, a), sub(c, a), sub(d, a))


def facets(ps: tuple[Point, Point, Point, Point]) -> list[tuple[Point, Point, Point]]:
    """The four facets; facet k is across from corner k."""
    return [tuple(p for i, p in enumerate(ps) if i != k) for k in range(4)]


def inscribed_radius(ps: tuple[Point, Point, Point, Point]) -> Column:
    area = sum((triangle_area(*f) for f in facets(ps)[1:]), triangle_area(*facets(ps)[0]))
    return over(F.abs(six_volume(*ps)), 2 * area)


def circum_center(ps: tuple[Point, Point, Point, Point]) -> Point:
    """The point as far from each corner; null for a flat tetrahedron."""
    u, v, w = (sub(p, ps[0]) for p in ps[1:])
    d = 2 * det3(u, v, w)
    uv, vw, wu = cross(u, v), cross(v, w), cross(w, u)
    return tuple(ps[0][k] + over(dot(u, u) * vw[k] + dot(v, v) * wu[k] + dot(w, w) * uv[k], d) for k in range(3))


def edges(ps: tuple[Point, Point, Point, Point]) -> list[Column]:
    return [distance(ps[a], ps[b]) for a in range(4) for b in range(a + 1, 4)]


def quality(ps: tuple[Point, Point, Point, Point]) -> Column:
    """2 sqrt(6) inscribed radius over the longest edge: 1 for the regular tetrahedron."""
    return over(inscribed_radius(ps) * (2 * 6**0.5), F.greatest(*edges(ps)))


def radius_ratio(ps: tuple[Point, Point, Point, Point]) -> Column:
    """3 inscribed radius over circumscribed radius: 1 for the regular tetrahedron."""
    return over(3 * inscribed_radius(ps), distance(circum_center(ps), ps[0]))


def dihedrals(ps: tuple[Point, Point, Point, Point]) -> list[Column]:
    """Six inner angles between facets, in degrees, by the opposite corners' facets."""
    ns = []
    for k, f in enumerate(facets(ps)):
        n = cross(sub(f[1], f[0]), sub(f[2], f[0]))
        out = dot(n, sub(ps[k], f[0])) > 0
        ns.append(tuple(F.when(out, -c).otherwise(c) for c in n))
    angle = lambda a, b: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), over(-dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))))))
    return [angle(ns[a], ns[b]) for a in range(4) for b in range(a + 1, 4)]


def closest_on_segment(p: Point, a: Point, b: Point) -> Point:
    d = sub(b, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(over(dot(sub(p, a), d), dot(d, d)), F.lit(0.0))))
    return tuple(a[k] + t * d[k] for k in range(3))


def plane_distance(p: Point, a: Point, b: Point, c: Point) -> Column:
    """Signed distance of a point to a triangle's plane."""
    n = cross(sub(b, a), sub(c, a))
    return over(dot(sub(p, a), n), F.sqrt(dot(n, n)))


def apex(a: Point, b: Point, c: Point, edge: Column | None = None) -> Point:
    """The fourth corner on a triangle: off the centroid by sqrt(6) / 3 of ``edge`` (1), against the normal of (b - a) x (c - a)."""
    n = normal(a, b, c)
    h = (6**0.5 / 3) * (F.lit(1.0) if edge is None else edge)
    return tuple((a[k] + b[k] + c[k]) / 3 - n[k] * h for k in range(3))


def radius_edge(ps: tuple[Point, Point, Point, Point]) -> Column:
    """Circumscribed radius over the shortest edge."""
    return over(distance(circum_center(ps), ps[0]), F.least(*edges(ps)))


def volume_gradients(ps: tuple[Point, Point, Point, Point]) -> list[Point]:
    """The gradient of the signed volume by each corner."""
    order = ((1, 3, 2), (0, 2, 3), (0, 3, 1), (0, 1, 2))
    return [tuple(v / 6 for v in cross(sub(ps[b], ps[a]), sub(ps[c], ps[a]))) for a, b, c in order]


def barycentric(p: Point, ps: tuple[Point, Point, Point, Point]) -> list[Column]:
    """Barycentric coordinates; null in a flat tetrahedron."""
    whole = six_volume(*ps)
    return [over(six_volume(*[p if i == k else q for i, q in enumerate(ps)]), whole) for k in range(4)]


def facet_circum_center(a: Point, b: Point, c: Point) -> Point:
    """The point of a triangle's plane as far from each corner."""
    u, v = sub(b, a), sub(c, a)
    n = cross(u, v)
    first, second = cross(v, n), cross(n, u)
    return tuple(a[k] + over(dot(u, u) * first[k] + dot(v, v) * second[k], 2 * dot(n, n)) for k in range(3))


def segment_tetra(p: Point, q: Point, ps: tuple[Point, Point, Point, Point]) -> Column:
    """struct(p_inside, q_inside, facets): which ends are inside, and a bit for each facet that the segment crosses."""
    bits = sum((F.when(crosses(p, q, *f).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(facets(ps))), F.lit(0))
    return F.struct(encloses(p, ps).alias("p_inside"), encloses(q, ps).alias("q_inside"), bits.alias("facets"))


def inverse3(m: list[list[Column]]) -> list[list[Column]]:
    """Inverse of a 3 x 3 matrix of columns; null if its determinant is 0."""
    rows = [tuple(r) for r in m]
    d = det3(*rows)
    cof = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    return [[over(cof[c][r], d) for c in range(3)] for r in range(3)]


def encloses(p: Point, ps: tuple[Point, Point, Point, Point]) -> Column:
    """Whether a point is in a tetrahedron, its facets included."""
    whole = six_volume(*ps)
    signs = [six_volume(*[p if i == k else q for i, q in enumerate(ps)]) * F.signum(whole) for k in range(4)]
    return (F.least(*signs) >= 0) & (whole != 0)


def crosses(p: Point, q: Point, a: Point, b: Point, c: Point) -> Column:
    """Where (0 to 1) the segment p-q meets the triangle; null where it doesn't or runs along its plane."""
    d, e1, e2 = sub(q, p), sub(b, a), sub(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = sub(p, a)
    u = over(dot(s, h), det)
    k = cross(s, e1)
    v, t = over(dot(d, k), det), over(dot(e2, k), det)
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0) & (t <= 1), t)


#: The share of each corner that is not free in the centroid of a tetrahedron with one free corner, and with two; and the share of a free one
#: (written out: 1 - 3 * 0.31 is not 0.07 in doubles, and a centroid may lie on a facet's plane).
BIAS_ONE, BIAS_TWO, FREE_ONE, FREE_TWO = 0.31, 0.40, 0.07, 0.1


def biased_centroid(ps: tuple[Point, Point, Point, Point], free: tuple[Column, Column, Column, Column]) -> Point:
    """The centroid, drawn towards the corners on the surface: one or two ``free`` corners share what the others leave; else all weigh alike."""
    n = sum((f.cast("int") for f in free[1:]), free[0].cast("int"))
    weights = [F.when(n == 1, F.when(f, FREE_ONE).otherwise(BIAS_ONE)).when(n == 2, F.when(f, FREE_TWO).otherwise(BIAS_TWO)).otherwise(0.25) for f in free]
    return tuple(sum((p[c] * w for p, w in zip(ps[1:], weights[1:], strict=True)), ps[0][c] * weights[0]) for c in range(3))

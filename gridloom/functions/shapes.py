"""Shape functions, quadrature and element matrices of tetrahedra and hexahedra.

Tetrahedra live on r, s, t >= 0, r + s + t <= 1, hexahedra on [-1, 1]^3.
Mid-side nodes follow the corners, in the order of EDGES. Their faces are
triangles and quadrilaterals (tri3, tri6, quad4, quad8) on the same domains in
two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges whose middles are the further nodes, and the corners of the hexahedron.
EDGES = {
    "tet10": ((0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)),
    "hex20": ((0, 1), (1, 2), (2, 3), (3, 0), (4, 5), (5, 6), (6, 7), (7, 4), (0, 4), (1, 5), (2, 6), (3, 7)),
    "tri6": ((0, 1), (1, 2), (2, 0)),
    "quad8": ((0, 1), (1, 2), (2, 3), (3, 0)),
}
QUAD = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float)
HEX = np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float)
NODES = {"tet4": 4, "tet10": 10, "hex8": 8, "hex20": 20, "tri3": 3, "tri6": 6, "quad4": 4, "quad8": 8}


def shape(kind: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (n) and derivatives (n x 3, faces n x 2) of an element's shape functions at a point."""
    if kind[:3] in ("tet", "tri"):
        lam = np.array([1 - p.sum(), *p])
        grad = np.vstack([-np.ones(len(p)), np.eye(len(p))])
        if kind not in EDGES:
            return lam, grad
        a, b = np.array(EDGES[kind]).T
        mid, dmid = 4 * lam[a] * lam[b], 4 * (lam[a, None] * grad[b] + lam[b, None] * grad[a])
        return np.concatenate([lam * (2 * lam - 1), mid]), np.vstack([(4 * lam - 1)[:, None] * grad, dmid])
    box, d = (HEX, 3) if kind.startswith("hex") else (QUAD, 2)
    u = 1 + box * p
    corner = u.prod(axis=1) / 2**d
    dcorner = np.stack([box[:, k] * np.delete(u, k, axis=1).prod(axis=1) for k in range(d)], axis=1) / 2**d
    if kind not in EDGES:
        return corner, dcorner
    pull = (box * p).sum(axis=1) - (d - 1)
    values, grads = corner * pull, dcorner * pull[:, None] + corner[:, None] * box
    for a, b in EDGES[kind]:
        m = (box[a] + box[b]) / 2
        f = np.where(m == 0, 1 - p**2, 1 + m * p)
        df = np.where(m == 0, -2 * p, m)
        values = np.append(values, f.prod() / 2 ** (d - 1))
        grads = np.vstack([grads, [df[k] * np.delete(f, k).prod() / 2 ** (d - 1) for k in range(d)]])
    return values, grads


def quadrature(kind: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that are exact up to a total degree of ``order`` (tetrahedra and triangles: by collapsing a cube or square)."""
    n = order // 2 + 1
    x, w = np.polynomial.legendre.leggauss(n)
    if kind.startswith("hex"):
        return np.stack(np.meshgrid(x, x, x, indexing="ij"), axis=-1).reshape(-1, 3), np.einsum("i,j,k->ijk", w, w, w).ravel()
    if kind.startswith("quad"):
        return np.stack(np.meshgrid(x, x, indexing="ij"), axis=-1).reshape(-1, 2), np.outer(w, w).ravel()
    x, w = np.polynomial.legendre.leggauss(n + 1)
    x, w = (x + 1) / 2, w / 2
    if kind.startswith("tri"):
        u, v = (g.ravel() for g in np.meshgrid(x, x, indexing="ij"))
        return np.stack([u, v * (1 - u)], axis=1), np.outer(w, w).ravel() * (1 - u)
    u, v, t = (g.ravel() for g in np.meshgrid(x, x, x, indexing="ij"))
    ww = np.einsum("i,j,k->ijk", w, w, w).ravel()
    return np.stack([u, v * (1 - u), t * (1 - u) * (1 - v)], axis=1), ww * (1 - u) ** 2 * (1 - v)


def face_load(kind: str, nodes: np.ndarray, order: int = 6) -> np.ndarray:
    """Each node's share of a unit load by area on a face, curved or not, with ``nodes`` (n x 3): the integral of its shape function."""
    out = np.zeros(len(nodes))
    for p, w in zip(*quadrature(kind, order), strict=True):
        v, d = shape(kind, p)
        r, s = d.T @ nodes
        out += w * np.linalg.norm(np.cross(r, s)) * v
    return out


def face_loads(corners: DataFrame, kind: str) -> DataFrame:
    """The load vector (i, v), three unknowns a node, of loads by area on faces (f, k, n, x, y, z, tx, ty, tz): a kernel for each batch of faces, then sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ns, xyz, t in zip(b["n"], b["xyz"], b["t"], strict=True):
                share = face_load(kind, np.array([list(p) for p in xyz], float))
                rows += [(n * 3 + a, f * t[a]) for n, f in zip(ns, share, strict=True) for a in range(3)]
            yield pd.DataFrame(rows, columns=["i", "v"])

    by = corners.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", "n", F.array("x", "y", "z").alias("p")))).alias("c"), F.first(F.array("tx", "ty", "tz")).alias("t")).where(F.size("c") == NODES[kind])
    faces = by.select(F.col("c.n").alias("n"), F.col("c.p").alias("xyz"), "t")
    return faces.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))


def element_stiffness(kind: str, nodes: np.ndarray, lam: float, mu: float) -> np.ndarray:
    """The elastic stiffness matrix (three unknowns a node) of an element with ``nodes`` (n x 3)."""
    n = len(nodes)
    k = np.zeros((n, 3, n, 3))
    for p, w in zip(*quadrature(kind, 4 if n > 8 else 2), strict=True):
        _, d = shape(kind, p)
        jac = d.T @ nodes
        g = d @ np.linalg.inv(jac).T
        dv = abs(np.linalg.det(jac)) * w
        k += dv * (lam * np.einsum("ap,bq->apbq", g, g) + mu * np.einsum("aq,bp->apbq", g, g) + mu * np.einsum("ac,bc,pq->apbq", g, g, np.eye(3)))
    return k.reshape(3 * n, 3 * n)


def element_mass(kind: str, nodes: np.ndarray, density: float, lumped: bool = False) -> np.ndarray:
    """The consistent mass matrix of an element, or the sums of its rows on the diagonal."""
    m = np.zeros((len(nodes), len(nodes)))
    for p, w in zip(*quadrature(kind, 4 if len(nodes) > 8 else 3), strict=True):
        v, d = shape(kind, p)
        m += density * w * abs(np.linalg.det(d.T @ nodes)) * np.outer(v, v)
    return np.diag(m.sum(axis=1)) if lumped else m


def assemble(corners: DataFrame, kind: str, lam: float, mu: float) -> DataFrame:
    """The global stiffness matrix (i, j, v) from element corners (e, k, n, x, y, z): a kernel for each element, then sums by cell."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("k")
        m = element_stiffness(kind, g[["x", "y", "z"]].to_numpy(float), lam, mu)
        dof = (g["n"].to_numpy()[:, None] * 3 + np.arange(3)).ravel()
        i, j = np.meshgrid(dof, dof, indexing="ij")
        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    cells = corners.groupBy("e").applyInPandas(run, "i long, j long, v double")
    return cells.groupBy("i", "j").agg(F.sum("v").alias("v"))

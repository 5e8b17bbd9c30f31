"""Dense kernels for many independent systems: one Arrow group, and so one task's memory, for each matrix.

A group holds one matrix as rows (mat, i, j, v); right-hand sides are columns
j >= n. One huge dense factorisation is no goal; sparse ones go front by front.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TINY = 1e-8


def to_array(g: pd.DataFrame) -> np.ndarray:
    n = int(g["i"].max()) + 1
    a = np.zeros((n, max(n, int(g["j"].max()) + 1)))
    a[g["i"].to_numpy(), g["j"].to_numpy()] = g["v"].to_numpy()
    return a


def gauss(ab: np.ndarray) -> np.ndarray | None:
    """Elimination with partial pivoting and back substitution; None if singular."""
    ab, n = ab.copy(), len(ab)
    for k in range(n):
        p = k + int(np.abs(ab[k:, k]).argmax())
        if abs(ab[p, k]) <= TINY:
            return None
        ab[[k, p]] = ab[[p, k]]
        ab[k + 1 :, k:] -= np.outer(ab[k + 1 :, k] / ab[k, k], ab[k, k:])
    x = np.zeros((n, ab.shape[1] - n))
    for k in range(n - 1, -1, -1):
        x[k] = (ab[k, n:] - ab[k, k + 1 : n] @ x[k + 1 :]) / ab[k, k]
    return x


def gauss_jordan_full(ab: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan with the pivot sought in all of the rest; columns are put back at the end."""
    ab, n = ab.copy(), len(ab)
    where = np.arange(n)
    for k in range(n):
        r, c = np.unravel_index(np.abs(ab[k:, k:n]).argmax(), (n - k, n - k))
        r, c = r + k, c + k
        if abs(ab[r, c]) <= TINY:
            return None
        ab[[k, r]] = ab[[r, k]]
        ab[:, [k, c]] = ab[:, [c, k]]
        where[[k, c]] = where[[c, k]]
        ab[k] /= ab[k, k]
        rest = np.arange(n) != k
        ab[rest] -= np.outer(ab[rest, k], ab[k])
    x = np.empty((n, ab.shape[1] - n))
    x[where] = ab[:, n:]
    return x


def gauss_jordan(ab: np.ndarray) -> np.ndarray | None:
    """Gauss-Jordan with partial pivoting."""
    ab, n = ab.copy(), len(ab)
    for k in range(n):
        p = k + int(np.abs(ab[k:, k]).argmax())
        if abs(ab[p, k]) <= TINY:
            return None
        ab[[k, p]] = ab[[p, k]]
        ab[k] /= ab[k, k]
        rest = np.arange(n) != k
        ab[rest] -= np.outer(ab[rest, k], ab[k])
    return ab[:, n:]


def banded(ab: np.ndarray) -> np.ndarray | None:
    """Elimination that stays in the band; pivoting widens the upper one to twice the half bandwidth."""
    ab, n = ab.copy(), len(ab)
    i, j = np.nonzero(np.abs(ab[:, :n]) > TINY)
    w = int(np.abs(i - j).max(initial=0))
    for k in range(n):
        low, right = min(n, k + w + 1), min(n, k + 2 * w + 1)
        p = k + int(np.abs(ab[k:low, k]).argmax())
        if abs(ab[p, k]) <= TINY:
            return None
        ab[[k, p]] = ab[[p, k]]
        f = ab[k + 1 : low, k] / ab[k, k]
        ab[k + 1 : low, k:right] -= np.outer(f, ab[k, k:right])
        ab[k + 1 : low, n:] -= np.outer(f, ab[k, n:])
    x = np.zeros((n, ab.shape[1] - n))
    for k in range(n - 1, -1, -1):
        right = min(n, k + 2 * w + 1)
        x[k] = (ab[k, n:] - ab[k, k + 1 : right] @ x[k + 1 : right]) / ab[k, k]
    return x


def gauss_seidel(ab: np.ndarray, rounds: int = 10_000, bound: float = 1e-13) -> np.ndarray | None:
    """Sweeps until the change is within ``bound``; None if that doesn't come about."""
    n = len(ab)
    if (np.abs(np.diag(ab)) <= TINY).any():
        return None
    x = np.zeros((n, ab.shape[1] - n))
    for _ in range(rounds):
        before = x.copy()
        for k in range(n):
            x[k] = (ab[k, n:] - ab[k, :k] @ x[:k] - ab[k, k + 1 : n] @ x[k + 1 :]) / ab[k, k]
        if np.linalg.norm(x - before) <= bound * max(1.0, np.linalg.norm(x)):
            return x
    return None


def lu(a: np.ndarray, pivot: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """L (unit), U, the rows' order and its sign. Pivots are weighed by their row's greatest value; one near zero becomes TINY times the 1-norm."""
    u, n = a.astype(float).copy(), len(a)
    low, order, sign = np.eye(n), np.arange(n), 1
    weight = 1 / np.maximum(np.abs(a).max(axis=1), 1e-300)
    floor = TINY * max(np.abs(a).sum(axis=0).max(), 1e-300)
    for k in range(n):
        p = k + int((np.abs(u[k:, k]) * weight[order[k:]]).argmax()) if pivot else k
        if p != k:
            u[[k, p]], order[[k, p]], sign = u[[p, k]], order[[p, k]], -sign
            low[[k, p], :k] = low[[p, k], :k]
        if abs(u[k, k]) <= TINY:
            u[k, k] = floor
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :, k:] -= np.outer(low[k + 1 :, k], u[k, k:])
        u[k + 1 :, k] = 0
    return low, u, order, sign


def solve_lu(ab: np.ndarray, pivot: bool = True) -> np.ndarray:
    n = len(ab)
    low, u, order, _ = lu(ab[:, :n], pivot)
    y = ab[order, n:].copy()
    for k in range(n):
        y[k] -= low[k, :k] @ y[:k]
    for k in range(n - 1, -1, -1):
        y[k] = (y[k] - u[k, k + 1 :] @ y[k + 1 :]) / u[k, k]
    return y


def markowitz(ab: np.ndarray, threshold: float = 0.1) -> np.ndarray | None:
    """Sparse elimination: of the pivots within ``threshold`` of their column's greatest, the one of least fill, (r - 1)(c - 1)."""
    n = len(ab)
    rows = [{j: v for j, v in enumerate(r) if abs(v) > TINY} for r in ab]
    left, cols, steps = set(range(n)), set(range(n)), []
    for _ in range(n):
        best = None
        for c in cols:
            own = [(r, rows[r][c]) for r in left if c in rows[r]]
            most = max((abs(v) for _, v in own), default=0.0)
            for r, v in own:
                if abs(v) >= threshold * most:
                    key = ((sum(1 for j in rows[r] if j in cols) - 1) * (len(own) - 1), -abs(v), r, c)
                    best = key if best is None or key < best else best
        if best is None or -best[1] <= TINY:
            return None
        _, _, r, c = best
        for o in left - {r}:
            if c in rows[o]:
                f = rows[o].pop(c) / rows[r][c]
                for j, v in rows[r].items():
                    if j != c:
                        rows[o][j] = rows[o].get(j, 0.0) - f * v
        left.remove(r)
        cols.remove(c)
        steps.append((r, c))
    x = np.zeros((n, ab.shape[1] - n))
    for r, c in reversed(steps):
        rhs = np.array([rows[r].get(j, 0.0) for j in range(n, ab.shape[1])])
        x[c] = (rhs - sum(v * x[j] for j, v in rows[r].items() if j < n and j != c)) / rows[r][c]
    return x


def cholesky(a: np.ndarray) -> np.ndarray | None:
    """Upper R with R'R = A; None if a pivot is near zero or negative."""
    n, r = len(a), np.zeros_like(a, dtype=float)
    for k in range(n):
        d = a[k, k] - r[:k, k] @ r[:k, k]
        if d <= TINY:
            return None
        r[k, k] = np.sqrt(d)
        r[k, k + 1 :] = (a[k, k + 1 :] - r[:k, k] @ r[:k, k + 1 :]) / r[k, k]
    return r


def gram_schmidt(a: np.ndarray) -> np.ndarray | None:
    """Orthonormal columns; None if they depend on each other."""
    q = a.astype(float).copy()
    for k in range(q.shape[1]):
        for _ in range(2):  # once more, against rounding
            q[:, k] -= q[:, :k] @ (q[:, :k].T @ q[:, k])
        length = np.linalg.norm(q[:, k])
        if length <= TINY:
            return None
        q[:, k] /= length
    return q


def hessenberg(a: np.ndarray) -> np.ndarray:
    """Householder similarity to upper Hessenberg form (tridiagonal for a symmetric matrix)."""
    h, n = a.astype(float).copy(), len(a)
    for k in range(n - 2):
        v = h[k + 1 :, k].copy()
        s = np.linalg.norm(v)
        if s <= TINY:
            continue
        v[0] += s if v[0] >= 0 else -s
        v /= np.linalg.norm(v)
        h[k + 1 :] -= 2 * np.outer(v, v @ h[k + 1 :])
        h[:, k + 1 :] -= 2 * np.outer(h[:, k + 1 :] @ v, v)
    return h


def eigen_symmetric(a: np.ndarray, rounds: int = 10_000, bound: float = 1e-13) -> np.ndarray:
    """Eigenvalues, greatest first: Householder, then A <- Q'AQ with the corner as shift until the diagonal rests."""
    h, n = hessenberg(a), len(a)
    out = []
    while n > 1:
        for _ in range(rounds):
            if abs(h[n - 1, n - 2]) <= bound * (abs(h[n - 1, n - 1]) + abs(h[n - 2, n - 2])):
                break
            d = (h[n - 2, n - 2] - h[n - 1, n - 1]) / 2
            e = h[n - 1, n - 2]
            shift = h[n - 1, n - 1] - (np.sign(d) or 1.0) * e * e / (abs(d) + np.hypot(d, e))
            q, r = np.linalg.qr(h[:n, :n] - shift * np.eye(n))
            h[:n, :n] = r @ q + shift * np.eye(n)
        out.append(h[n - 1, n - 1])
        n -= 1
    return np.sort(np.array([*out, h[0, 0]]))[::-1]


def eigenvectors(a: np.ndarray, steps: int = 4) -> np.ndarray:
    """Unit eigenvectors of a symmetric matrix as columns, greatest eigenvalue first, by ``steps`` inverse iterations each from a seeded start.

    What earlier vectors hold is taken out at each step, so that equal
    eigenvalues get vectors at right angles.
    """
    n, out, rng = len(a), [], np.random.default_rng(1)
    scale = max(np.abs(a).sum(axis=0).max(initial=0), 1.0)
    for value in eigen_symmetric(a):
        low, u, order, _ = lu(a - (value + 1e-10 * scale) * np.eye(n))
        x = rng.normal(size=n)
        for _ in range(steps):
            y = x[order]
            for k in range(n):
                y[k] -= low[k, :k] @ y[:k]
            for k in range(n - 1, -1, -1):
                y[k] = (y[k] - u[k, k + 1 :] @ y[k + 1 :]) / u[k, k]
            for v in out:
                y -= (v @ y) * v
            x = y / np.linalg.norm(y)
        out.append(x)
    return np.stack(out, axis=1)


def power(a: np.ndarray, rounds: int = 100_000, bound: float = 1e-14) -> float:
    """The eigenvalue of greatest magnitude, signed, by its Rayleigh quotient."""
    y, last = np.arange(1, len(a) + 1, dtype=float), np.inf
    for _ in range(rounds):
        y /= np.linalg.norm(y)
        z = a @ y
        value = float(y @ z)
        if abs(value - last) <= bound * max(1.0, abs(value)):
            break
        y, last = z, value
    return value


def laplace(a: np.ndarray) -> float:
    """Determinant by expansion along the row with most zeros."""
    n = len(a)
    if n == 1:
        return float(a[0, 0])
    r = int((np.abs(a) <= TINY).sum(axis=1).argmax())
    rest = np.delete(a, r, axis=0)
    return sum((-1) ** (r + c) * a[r, c] * laplace(np.delete(rest, c, axis=1)) for c in range(n) if abs(a[r, c]) > TINY)


def multifrontal(ab: np.ndarray) -> np.ndarray:
    """Solve by fronts over the elimination tree of the symmetrised pattern.

    A pivot's front holds its row and column and what its children pass on;
    after elimination the rest (the contribution) goes to the parent, the
    least index in it. Pivots stay in order; one near zero becomes TINY times
    the 1-norm.
    """
    n = len(ab)
    a = ab[:, :n]
    floor = TINY * max(np.abs(a).sum(axis=0).max(), 1e-300)
    passed: dict[int, list[tuple[list[int], np.ndarray]]] = {}
    fronts = []
    for k in range(n):
        own = {k} | {j for j in range(k + 1, n) if abs(a[k, j]) > TINY or abs(a[j, k]) > TINY}
        for idx, _ in passed.get(k, []):
            own |= set(idx)
        idx = sorted(own)
        at = {g: p for p, g in enumerate(idx)}
        f = np.zeros((len(idx), len(idx)))
        f[0, :], f[:, 0] = a[k, idx], a[idx, k]
        for child, block in passed.pop(k, []):
            where = [at[g] for g in child]
            f[np.ix_(where, where)] += block
        if abs(f[0, 0]) <= TINY:
            f[0, 0] = floor
        low = f[1:, 0] / f[0, 0]
        fronts.append((k, idx[1:], f[0, 0], f[0, 1:].copy(), low))
        if len(idx) > 1:
            passed.setdefault(idx[1], []).append((idx[1:], f[1:, 1:] - np.outer(low, f[0, 1:])))
    y = ab[:, n:].astype(float).copy()
    for k, idx, _, _, low in fronts:
        y[idx] -= np.outer(low, y[k])
    for k, idx, d, up, _ in reversed(fronts):
        y[k] = (y[k] - up @ y[idx]) / d
    return y


SOLVERS: dict[str, Callable[[np.ndarray], np.ndarray | None]] = {
    "gauss": gauss, "gauss_jordan_full": gauss_jordan_full, "gauss_jordan": gauss_jordan, "banded": banded, "gauss_seidel": gauss_seidel,
    "lu": solve_lu, "lu_plain": lambda ab: solve_lu(ab, False), "markowitz": markowitz, "multifrontal": multifrontal,
}


def solve(systems: DataFrame, method: str) -> DataFrame:
    """Solve each system; rows (mat, i, k, x) for unknown i and right-hand side k. A singular system gives no row."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ab = to_array(g)
        x = SOLVERS[method](ab)
        if x is None:
            return pd.DataFrame({"mat": [], "i": [], "k": [], "x": []})
        i, k = np.indices(x.shape)
        return pd.DataFrame({"mat": g["mat"].iloc[0], "i": i.ravel(), "k": k.ravel(), "x": x.ravel()})

    return systems.groupBy("mat").applyInPandas(run, "mat long, i long, k long, x double")


def per_matrix(matrices: DataFrame, f: Callable[[np.ndarray], np.ndarray | float | None]) -> DataFrame:
    """Apply ``f`` to each matrix; rows (mat, i, j, v) of what it returns, a number as cell (0, 0)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = f(to_array(g))
        if out is None:
            return pd.DataFrame({"mat": [], "i": [], "j": [], "v": []})
        out = np.atleast_2d(np.asarray(out, float))
        i, j = np.indices(out.shape)
        return pd.DataFrame({"mat": g["mat"].iloc[0], "i": i.ravel(), "j": j.ravel(), "v": out.ravel()})

    return matrices.groupBy("mat").applyInPandas(run, "mat long, i long, j long, v double")


def determinant_lu(a: np.ndarray) -> float:
    _, u, _, sign = lu(a)
    return float(np.prod(np.diag(u)) * sign)


def inverse(a: np.ndarray) -> np.ndarray | None:
    return gauss_jordan(np.concatenate([a, np.eye(len(a))], axis=1))

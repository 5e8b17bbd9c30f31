"""Arrow kernels for rays and segments against triangles, a block at a time: pairs are many and their rows would be few numbers each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Rays that are tried one by one; pairs tried at once; crossings of a batch, at least.
LEAF, AT_ONCE, BATCH = 128, 1 << 15, 1 << 17


def _corners(t: pa.Table, axes: tuple[str, ...]) -> np.ndarray:
    """Triangles as an array [corner, axis, triangle], in the order of f; those with a null left out."""
    return np.array([[t[f"{c}{k}"].to_numpy() for c in axes] for k in range(3)])


def _whole(t: pa.Table) -> pa.Table:
    return t.combine_chunks().drop_null()


def _sides(t: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """On which side of the edges 0-1, 1-2, 2-0 the place (u, v) lies; rows are triangles, columns places."""
    (u0, v0), (u1, v1), (u2, v2) = ((c[0][:, None], c[1][:, None]) for c in t)
    return [(bu - au) * (v - av) - (bv - av) * (u - au) for au, av, bu, bv in ((u0, v0, u1, v1), (u1, v1, u2, v2), (u2, v2, u0, v0))]


def _height(w: tuple[np.ndarray, ...], s: list[np.ndarray]) -> np.ndarray:
    return (w[0] * s[1] + w[1] * s[2] + w[2] * s[0]) / (s[0] + s[1] + s[2])


def _pairs(q: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(triangles, rays, heights) of the crossings: strictly inside all edges and beyond the ray's start."""
    step = max(1, AT_ONCE // max(1, q.shape[1]))
    for at in range(0, t.shape[2], step):
        part = t[:, :, at : at + step]
        s = _sides(part, q[0], q[1])
        ups, downs = [k > 0 for k in s], [k < 0 for k in s]
        f, r = np.nonzero((ups[0] & ups[1] & ups[2]) | (downs[0] & downs[1] & downs[2]))
        h = _height(tuple(part[k, 2][f] for k in range(3)), [k[f, r] for k in s])
        beyond = h > q[2][r]
        yield f[beyond] + at, r[beyond], h[beyond]


def _kinds(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triangles that all rays cross, and those that some may cross.

    Sides and heights are linear, so the corners of the rays' box bound them;
    what is within rounding of a bound is tried ray by ray.
    """
    low, high = q.min(axis=1), q.max(axis=1)
    s = _sides(t, np.array([low[0], low[0], high[0], high[0]]), np.array([low[1], high[1], low[1], high[1]]))
    reach = [np.maximum(np.abs(low[c] - t[:, c]), np.abs(high[c] - t[:, c])).max(axis=0) for c in (0, 1)]
    slack = (1e-9 * reach[0] * reach[1])[:, None]
    ups, downs = [(k > slack).all(axis=1) for k in s], [(k < -slack).all(axis=1) for k in s]
    across = (ups[0] & ups[1] & ups[2]) | (downs[0] & downs[1] & downs[2])
    h = _height(tuple(t[k, 2][:, None] for k in range(3)), s)
    room = 1e-5 * np.abs(t[:, 2]).sum(axis=0)
    every = across & (h.min(axis=1) > high[2] + room)
    none = ((ups[0] | ups[1] | ups[2]) & (downs[0] | downs[1] | downs[2])) | (t[:, 2].max(axis=0) + room < low[2]) | (across & (h.max(axis=1) < low[2] - room))
    return every, ~every & ~none


def _tally(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many triangles each ray crosses: halves of the rays go on with the triangles that are not settled for all of them."""
    n = q.shape[1]
    every, some = _kinds(q, t)
    out, rest = np.full(n, every.sum()), t[:, :, some]
    if not rest.shape[2]:
        return out
    if n <= LEAF:
        for _, r, _ in _pairs(q, rest):
            out += np.bincount(r, minlength=n)
        return out
    order = np.argpartition(q[np.argmax(q.max(axis=1) - q.min(axis=1))], n // 2)
    for half in (order[: n // 2], order[n // 2 :]):
        out[half] += _tally(q[:, half], rest)
    return out


def ray_counts(axes: tuple[str, str, str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Kernel: a block's rays (ray, px, py, pz) along the last of ``axes`` and its triangles to (ray, hits)."""

    def kernel(rays: pa.Table, triangles: pa.Table) -> pa.Table:
        rays, triangles = _whole(rays), _whole(triangles)
        hits = np.zeros(rays.num_rows, dtype=np.int64)
        if rays.num_rows and triangles.num_rows:
            with np.errstate(all="ignore"):
                hits = _tally(np.array([rays[f"p{c}"].to_numpy() for c in axes]), _corners(triangles, axes)).astype(np.int64)
        met = hits > 0
        return pa.table({"ray": rays["ray"].to_numpy()[met], "hits": hits[met]})

    return kernel


def _ordered(schema: pa.Schema, found: Iterator[tuple]) -> pa.Table:
    """Crossings of one ray or segment after the other, each (id, f, t, more) numbered from 1 by t, ties by f, which rises."""
    batches, held, rows = [], [], 0
    for one, f, t, more in found:
        order = np.argsort(t, kind="stable")
        held.append((np.full(len(f), one), f[order], t[order], *[m[order] for m in more], np.arange(1, len(f) + 1)))
        rows += len(f)
        if rows >= BATCH:
            batches.append(pa.record_batch([pa.array(np.concatenate(c), type=k.type) for c, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
            held, rows = [], 0
    if held:
        batches.append(pa.record_batch([pa.array(np.concatenate(c), type=k.type) for c, k in zip(zip(*held, strict=True), schema, strict=True)], schema=schema))
    return pa.Table.from_batches(batches, schema)


def ray_hits(axes: tuple[str, str, str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Kernel: as :func:`ray_counts`, but to each crossing (ray, f, t, k)."""
    schema = pa.schema([("ray", pa.int64()), ("f", pa.int64()), ("t", pa.float64()), ("k", pa.int64())])

    def kernel(rays: pa.Table, triangles: pa.Table) -> pa.Table:
        rays, triangles = _whole(rays), _whole(triangles).sort_by("f")

        def found() -> Iterator[tuple]:
            q, t, f = np.array([rays[f"p{c}"].to_numpy() for c in axes]), _corners(triangles, axes), triangles["f"].to_numpy()
            for k, ray in enumerate(rays["ray"].to_numpy()):
                got = list(_pairs(q[:, k : k + 1], t))
                if got:
                    yield ray, f[np.concatenate([g[0] for g in got])], np.concatenate([g[2] for g in got]), ()

        with np.errstate(all="ignore"):
            return _ordered(schema, found())

    return kernel


def _six(u: tuple, v: tuple, w: tuple) -> np.ndarray:
    return u[0] * (v[1] * w[2] - v[2] * w[1]) + u[1] * (v[2] * w[0] - v[0] * w[2]) + u[2] * (v[0] * w[1] - v[1] * w[0])


def segment_hits() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Kernel: a block's segments (id, px..qz) and its triangles to each crossing (id, f, t, status, k)."""
    schema = pa.schema([("id", pa.int64()), ("f", pa.int64()), ("t", pa.float64()), ("status", pa.int32()), ("k", pa.int64())])

    def kernel(segments: pa.Table, triangles: pa.Table) -> pa.Table:
        segments, triangles = _whole(segments), _whole(triangles).sort_by("f")

        def found() -> Iterator[tuple]:
            a, b, c = _corners(triangles, ("x", "y", "z"))
            f, ids = triangles["f"].to_numpy(), segments["id"].to_numpy()
            ends = [np.array([segments[f"{e}{x}"].to_numpy() for x in "xyz"]).T for e in "pq"]
            u, v = b - a, c - a
            for k, one in enumerate(ids):
                p, q = ends[0][k], ends[1][k]
                vp, vq = _six(u, v, p[:, None] - a), _six(u, v, q[:, None] - a)
                on = np.flatnonzero((vp * vq <= 0) & (vp != vq))
                d, (pa_, pb, pc) = q - p, (x[:, on] - p[:, None] for x in (a, b, c))
                s = [_six(d, pa_, pb), _six(d, pb, pc), _six(d, pc, pa_)]
                through = ((s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)) | ((s[0] <= 0) & (s[1] <= 0) & (s[2] <= 0))
                on = on[through]
                if on.size:
                    yield one, f[on], vp[on] / (vp[on] - vq[on]), (np.where(vq[on] > vp[on], 2, -2),)

        return _ordered(schema, found()) if triangles.num_rows else schema.empty_table()

    return kernel

"""Sparse systems by fronts: a stage of small dense eliminations for each level of the elimination tree.

A system is rows (mat, i, j, v); right-hand sides are columns j >= n, as in
:mod:`gridloom.operators.kernels`. Many matrices go through the levels at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.loops import stored

#: A pivot is at least this part of the greatest value of its column in the front; smaller ones than TINY are none.
THRESHOLD, TINY = 0.5, 1e-6
#: Columns of a supernode, at most, and what a column's length may be off its neighbour's: SLACK and a fourth of the supernode's width.
WIDTH, SLACK = 32, 2
_ENTRY = "mat long, node long, i long, j long, v double, own_i boolean, own_j boolean"


def _sizes(systems: DataFrame) -> DataFrame:
    return systems.groupBy("mat").agg((F.max("i") + 1).alias("n"))


def supernodes(systems: DataFrame) -> DataFrame:
    """The task graph: (mat, c, node, parent, level) for each column c.

    node: the first column of its supernode, a run of columns of about the
    same structure; parent: the node that takes what is left of its front
    (null: none, the end of a subproblem of its own); level: 0 without
    children, else one above the highest of these. Only the pattern of a
    matrix, made symmetric, comes into one task.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = int(g["n"].iloc[0])
        below: list[set[int]] = [set() for _ in range(n)]
        for i, j in zip(g["i"].tolist(), g["j"].tolist(), strict=True):
            if i != j and j < n:
                below[min(i, j)].add(max(i, j))
        up = [-1] * n
        for c in range(n):
            if below[c]:
                up[c] = min(below[c])
                below[up[c]] |= below[c] - {up[c]}
        node, first = [], 0
        for c in range(n):
            near = c and up[c - 1] == c and c - first < WIDTH and abs(len(below[c - 1]) - 1 - len(below[c])) <= SLACK + (c - first) / 4
            first = first if near else c
            node.append(first)
        parent, level = {}, {}
        for c in range(n):
            level.setdefault(node[c], 0)
            if up[c] >= 0 and node[up[c]] != node[c]:
                # a column within a run may lead on earlier than the run's last: the least leads to all others
                parent[node[c]] = min(parent.get(node[c], n), node[up[c]])
        for f in sorted(level):
            if f in parent:
                level[parent[f]] = max(level[parent[f]], level[f] + 1)
        return pd.DataFrame({"mat": g["mat"].iloc[0], "c": range(n), "node": node, "parent": pd.array([parent.get(f) for f in node], "Int64"), "level": [level[f] for f in node]})

    pattern = systems.where(F.abs("v") > 0).join(_sizes(systems), "mat").select("mat", "i", "j", "n")
    return pattern.groupBy("mat").applyInPandas(run, "mat long, c long, node long, parent long, level int")


def supernode_edges(systems: DataFrame, tree: DataFrame) -> DataFrame:
    """The task graph's edges (mat, src, dst, kind) between the supernodes of ``tree`` (mat, c, node).

    src needs dst, which is before it: for a row of its own that has a cell
    there (L), a column (U), or both (LU). Cells of the matrix count, fill does
    not; an edge is formed where cells are, by two joins and one sum.
    """
    of = lambda c: tree.select("mat", F.col("c").alias(c), F.col("node").alias(f"n{c}"))
    met = systems.where(F.abs("v") > 0).select("mat", "i", "j").join(of("i"), ["mat", "i"]).join(of("j"), ["mat", "j"]).where("ni <> nj")
    bits = met.groupBy("mat", F.greatest("ni", "nj").alias("src"), F.least("ni", "nj").alias("dst")).agg(F.bit_or(F.when(F.col("ni") > F.col("nj"), 1).otherwise(2)).alias("b"))
    return bits.select("mat", "src", "dst", F.element_at(F.array(F.lit("L"), F.lit("U"), F.lit("LU")), F.col("b")).alias("kind"))


def eliminate(rows: np.ndarray, cols: np.ndarray, f: np.ndarray, own_r: np.ndarray, own_c: np.ndarray, last: bool, floor: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pivots (places of row and column, in order) of a front, and the front once they are eliminated.

    Each column is tried with the greatest of the rows that are complete; it
    must reach THRESHOLD of the column's greatest value in the whole front. What
    fails is tried again after the others, and then left to the parent. The
    last front leaves nothing: a pivot near zero becomes ``floor``.
    """
    f, pivots = f.copy(), []
    free_r, free_c = list(np.flatnonzero(own_r)), list(np.flatnonzero(own_c))
    rest = np.ones(len(rows), bool)
    while free_c:
        done = None
        for c in free_c:
            r = max(free_r, key=lambda k: abs(f[k, c]))
            most = np.abs(f[rest, c]).max()
            if abs(f[r, c]) > TINY and abs(f[r, c]) >= THRESHOLD * most:
                done = r, c
                break
        if done is None:
            if not last:
                break
            r, c = max(((r, c) for r in free_r for c in free_c), key=lambda p: abs(f[p]))
            if abs(f[r, c]) <= 1e-8:
                f[r, c] = floor
            done = r, c
        r, c = done
        free_r.remove(r)
        free_c.remove(c)
        rest[r] = False
        pivots.append((r, c))
        factor = f[rest, c] / f[r, c]
        f[rest] -= np.outer(factor, f[r])
        f[rest, c] = 0.0
    return pivots, f


def factorise(systems: DataFrame, tree: DataFrame) -> tuple[DataFrame, int]:
    """The rows of U by front: (mat, node, level, k, row, col, j, v), and the number of levels.

    The k-th pivot of a front is (row, col); j are the columns right of it and
    the right-hand sides, eliminated with it. Rows and columns that find no
    pivot go to the parent front with what is left, and are complete there.
    """
    tree = stored(tree.join(_sizes(systems), "mat"))
    floors = systems.join(_sizes(systems), "mat").where("j < n").groupBy("mat", "j").agg(F.sum(F.abs("v")).alias("s")).groupBy("mat").agg((F.max("s") * 1e-8).alias("floor"))
    nodes = stored(tree.select("mat", "node", "parent", "level", "n").distinct().join(floors, "mat"))
    place = tree.select("mat", F.col("c").alias("at"), "node")
    lead = F.when(F.col("j") < F.col("n"), F.least("i", "j")).otherwise(F.col("i"))
    entries = systems.join(_sizes(systems), "mat").select("mat", "i", "j", "v", lead.alias("at")).join(place, ["mat", "at"]).select("mat", "node", "i", "j", F.col("v").cast("double").alias("v"), F.lit(False).alias("own_i"), F.lit(False).alias("own_j"))
    diagonal = tree.select("mat", "node", F.col("c").alias("i"), F.col("c").alias("j"), F.lit(0.0).alias("v"), F.lit(True).alias("own_i"), F.lit(True).alias("own_j"))
    waiting = stored(entries.unionByName(diagonal))
    levels = nodes.agg(F.max("level")).first()[0]
    out = None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        head = g.iloc[0]
        n, last = int(head["n"]), bool(pd.isna(head["parent"]))
        rows, ri = np.unique(g["i"].to_numpy(), return_inverse=True)
        cols, ci = np.unique(g["j"].to_numpy(), return_inverse=True)
        f, own_r, own_c = np.zeros((len(rows), len(cols))), np.zeros(len(rows), bool), np.zeros(len(cols), bool)
        np.add.at(f, (ri, ci), g["v"].to_numpy())
        np.logical_or.at(own_r, ri, g["own_i"].to_numpy(bool))
        np.logical_or.at(own_c, ci, g["own_j"].to_numpy(bool))
        pivots, f = eliminate(rows, cols, f, own_r, own_c, last, float(head["floor"]))
        gone_r, gone_c = [r for r, _ in pivots], [c for _, c in pivots]
        made = []
        for k, (r, c) in enumerate(pivots):
            left = np.setdiff1d(np.arange(len(cols)), gone_c[:k])
            left = left[(f[r, left] != 0) | (left == c)]
            made.append(pd.DataFrame({"k": k, "row": rows[r], "col": cols[c], "i": rows[r], "j": cols[left], "v": f[r, left], "own_i": False, "own_j": False}))
        if not last:
            keep_r, keep_c = np.setdiff1d(np.arange(len(rows)), gone_r), np.setdiff1d(np.arange(len(cols)), gone_c)
            a, b = (x.ravel() for x in np.meshgrid(keep_r, keep_c, indexing="ij"))
            use = (f[a, b] != 0) | own_r[a] | own_c[b]
            a, b = a[use], b[use]
            made.append(pd.DataFrame({"k": -1, "row": -1, "col": -1, "i": rows[a], "j": cols[b], "v": f[a, b], "own_i": own_r[a], "own_j": own_c[b] & (cols[b] < n)}))
        got = pd.concat(made) if made else pd.DataFrame({c: [] for c in ("k", "row", "col", "i", "j", "v", "own_i", "own_j")})
        return got.assign(mat=head["mat"], node=head["node"], parent=head["parent"] if not last else -1, level=head["level"])

    kind = "mat long, node long, parent long, level int, k int, row long, col long, i long, j long, v double, own_i boolean, own_j boolean"
    for level in range(levels + 1):
        now = nodes.where(F.col("level") == level)
        done = stored(waiting.join(now, ["mat", "node"]).groupBy("mat", "node").applyInPandas(run, kind))
        out = done.where("k >= 0") if out is None else out.unionByName(done.where("k >= 0"))
        passed = done.where("k < 0").select("mat", F.col("parent").alias("node"), "i", "j", "v", "own_i", "own_j")
        waiting = stored(waiting.join(now.select("mat", "node"), ["mat", "node"], "left_anti").unionByName(passed))
    return stored(out.select("mat", "node", "level", "k", "row", "col", "j", "v")), levels + 1


def solve(systems: DataFrame) -> DataFrame:
    """Solutions (mat, i, k, x) of sparse systems for unknown i and right-hand side k, from the last level of fronts back to the first."""
    sizes = stored(_sizes(systems))
    upper, levels = factorise(systems, supernodes(systems))
    upper = upper.join(sizes, "mat")
    sides = systems.join(sizes, "mat").where("j >= n").select("mat", (F.col("j") - F.col("n")).alias("side")).distinct()
    upper = stored(upper.join(sides, "mat").where("j < n or j = n + side"))
    known = None

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, x = int(g["n"].iloc[0]), {}
        for k in sorted(g["k"].unique(), reverse=True):
            own = g[g["k"] == k]
            col, total, pivot = int(own["col"].iloc[0]), 0.0, 0.0
            for j, v, have in zip(own["j"].tolist(), own["v"].tolist(), own["x"].tolist(), strict=True):
                if j >= n:
                    total += v
                elif j == col:
                    pivot = v
                else:
                    total -= v * (x[j] if j in x else have)
            x[col] = total / pivot
        return pd.DataFrame({"mat": g["mat"].iloc[0], "side": g["side"].iloc[0], "j": list(x), "x": list(x.values())})

    for level in range(levels - 1, -1, -1):
        now = upper.where(F.col("level") == level)
        now = now.withColumn("x", F.lit(None).cast("double")) if known is None else now.join(known, ["mat", "side", "j"], "left")
        found = now.groupBy("mat", "node", "side").applyInPandas(run, "mat long, side long, j long, x double")
        known = stored(found if known is None else known.unionByName(found))
    return known.select("mat", F.col("j").alias("i"), F.col("side").alias("k"), "x")

"""Graphs: reachability, components, matchings, and the dependency structure of a factorisation."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.loops import fixed_point, stored


def reach(edges: DataFrame, starts: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Nodes (s, n, hops) reachable from each start along edges (src, dst), with the least number of hops."""
    seen = stored(starts.select(F.col("n").alias("s"), "n", F.lit(0).cast("bigint").alias("hops")))
    front = seen
    for k in range(1, max_rounds + 1):
        fresh = front.join(edges, front["n"] == edges["src"]).select("s", F.col("dst").alias("n")).distinct().join(seen.select("s", "n"), ["s", "n"], "left_anti").withColumn("hops", F.lit(k).cast("bigint"))
        front = stored(fresh)
        if front.isEmpty():
            return seen
        seen = stored(seen.unionByName(front))
    raise RuntimeError("paths longer than max_rounds")


def closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) with a path, by doubling: rounds grow with the logarithm of the longest path."""
    step = lambda t: t.unionByName(t.alias("a").join(t.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")).distinct()
    return fixed_point(edges.select("src", "dst").distinct(), step)


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of an acyclic graph that no longer path between their ends makes needless."""
    e = stored(edges.select("src", "dst").distinct())
    paths = closure(e)
    longer = e.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")).distinct()
    return e.join(longer, ["src", "dst"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(n, root): the least node of each node's component, by passing least labels on and jumping to labels' labels."""
    both = stored(edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.groupBy(F.col("src").alias("n")).agg(F.min("dst").alias("m")).select("n", F.least("n", "m").alias("root"))

    def step(t: DataFrame) -> DataFrame:
        near = both.join(t, both["dst"] == t["n"]).groupBy(both["src"].alias("n")).agg(F.min("root").alias("m"))
        low = t.join(near, "n").select("n", F.least("root", "m").alias("root"))
        up = low.select(F.col("n").alias("r"), F.col("root").alias("up"))
        return low.join(up, F.col("root") == F.col("r")).select("n", "up").withColumnRenamed("up", "root")

    return fixed_point(labels, step)


def unite_kinds(edges: DataFrame) -> DataFrame:
    """Edges of L and U graphs as one: an edge in both is of kind LU."""
    bits = edges.groupBy("src", "dst").agg(F.bit_or(F.when(F.col("kind") == "L", 1).when(F.col("kind") == "U", 2).otherwise(3)).alias("b"))
    return bits.select("src", "dst", F.element_at(F.array(F.lit("L"), F.lit("U"), F.lit("LU")), F.col("b")).alias("kind"))


def hopcroft_karp(edges: list[tuple[int, int]]) -> dict[int, int]:
    """A maximum matching, row to column: shortest augmenting paths, all of one length at a time."""
    near: dict[int, list[int]] = {}
    for r, c in sorted(edges):
        near.setdefault(r, []).append(c)
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    while True:
        level = {r: 0 for r in near if r not in col_of}
        queue, found = deque(level), False
        while queue:
            r = queue.popleft()
            for c in near[r]:
                if c not in row_of:
                    found = True
                elif row_of[c] not in level:
                    level[row_of[c]] = level[r] + 1
                    queue.append(row_of[c])
        if not found:
            return col_of
        for start in [r for r in near if r not in col_of]:
            stack, came = [(start, iter(near[start]))], {}
            while stack:
                r, it = stack[-1]
                for c in it:
                    o = row_of.get(c)
                    if o is None:
                        while True:
                            row_of[c], col_of[r], c2 = r, c, col_of.get(r)
                            if r == start:
                                break
                            r, c = came[r], c2
                        stack = []
                        break
                    if level.get(o) == level[r] + 1 and o not in came:
                        came[o] = r
                        stack.append((o, iter(near[o])))
                        break
                else:
                    level[r] = -1
                    stack.pop()


def matching(edges: DataFrame) -> DataFrame:
    """A maximum matching (g, r, c) of each graph g's edges (g, r, c); one group for each graph."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = hopcroft_karp(list(zip(p["r"].tolist(), p["c"].tolist(), strict=True)))
        return pd.DataFrame({"g": p["g"].iloc[0], "r": list(m), "c": list(m.values())})

    return edges.groupBy("g").applyInPandas(run, "g long, r long, c long")


def matching_of(edges: DataFrame) -> DataFrame:
    """A maximum matching (r, c) of edges (r, c), each connected part apart, so that a graph of many parts is no single group."""
    sides = edges.select((F.col("r") * 2).alias("src"), (F.col("c") * 2 + 1).alias("dst"), "r", "c").distinct()
    found = components(sides.select("src", "dst"))
    return matching(sides.join(found, sides["src"] == found["n"]).select(F.col("root").alias("g"), "r", "c")).select("r", "c")


def reach_along(edges: DataFrame, starts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """As :func:`reach`, over edges (src, dst, kind) of the given kinds alone."""
    return reach(edges.where(F.col("kind").isin(*kinds)).select("src", "dst"), starts)


def cut_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) without those between the pairs ``gone`` (src, dst), of whatever kind."""
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def dulmage_mendelsohn(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Part of each node (side, n, part): H if an alternating path from an unmatched column reaches it, V from an unmatched row, else S.

    Directed edges: free steps from one side, matched ones back.
    """
    key = lambda side, c: F.concat(F.lit(side), F.col(c).cast("string"))
    e, m = edges.select(key("r", "r").alias("r"), key("c", "c").alias("c")).distinct(), matched.select(key("r", "r").alias("r"), key("c", "c").alias("c"))
    e, m = stored(e), stored(m)
    nodes = e.select(F.col("r").alias("n")).distinct().unionAll(e.select(F.col("c").alias("n")).distinct())
    out = []
    for a, b, part in (("c", "r", "H"), ("r", "c", "V")):
        steps = e.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionAll(m.select(F.col(b).alias("src"), F.col(a).alias("dst")))
        free = e.select(F.col(a).alias("n")).distinct().join(m.select(F.col(a).alias("n")), "n", "left_anti")
        out.append(reach_any(steps, free).select("n", F.lit(part).alias("part")))
    found = out[0].unionAll(out[1])
    return nodes.join(found, "n", "left").select(F.substring("n", 1, 1).alias("side"), F.expr("substring(n, 2)").cast("bigint").alias("n"), F.coalesce("part", F.lit("S")).alias("part"))


def reach_any(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that some start reaches, the starts included."""
    e, seen = stored(edges.distinct()), stored(starts.select("n").distinct())
    front = seen
    while True:
        front = stored(front.join(e, front["n"] == e["src"]).select(F.col("dst").alias("n")).distinct().join(seen, "n", "left_anti"))
        if front.isEmpty():
            return seen
        seen = stored(seen.unionAll(front))


def task_edges(m: DataFrame) -> DataFrame:
    """The dependency edges of eliminating a matrix: pivot i needs column j < i of its row (L) and row j < i of its column (U)."""
    low = m.where("j < i").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit("L").alias("kind"))
    up = m.where("i < j").select(F.col("j").alias("src"), F.col("i").alias("dst"), F.lit("U").alias("kind"))
    return low.unionAll(up)


def permute_to_diagonal(m: DataFrame, matched: DataFrame) -> DataFrame:
    """Columns moved so that matched cells lie on the diagonal."""
    return m.join(matched.select(F.col("c").alias("j"), F.col("r").alias("to")), "j").select("i", F.col("to").alias("j"), "v")


def edge_chains(edges: DataFrame, corners: DataFrame) -> DataFrame:
    """(e, chain): the least edge that each edge (e, a, b) is linked to over shared nodes, none of them a corner (n).

    Edges at a node link to the least edge there, so a node of many edges costs no pairs.
    """
    ends = edges.select("e", F.explode(F.array("a", "b")).alias("n")).join(corners.select("n").distinct(), "n", "left_anti")
    hubs = ends.groupBy("n").agg(F.min("e").alias("dst"))
    found = components(ends.join(hubs, "n").select(F.col("e").alias("src"), "dst")).withColumnRenamed("n", "e")
    return edges.select("e").distinct().join(found, "e", "left").select("e", F.coalesce("root", "e").alias("chain"))

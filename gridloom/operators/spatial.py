"""Spatial joins over grids, and octrees as rows of cell paths."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import encloses, point
from gridloom.operators import crossings
from gridloom.operators.reduce import bounding_box, numbered
from gridloom.plans.loops import stored

AXES = "xyz"


def cell_of(size: float, suffix: str = "") -> list[Column]:
    return [F.floor(F.col(f"{c}{suffix}") / size).cast("bigint").alias(f"c{c}") for c in AXES]


def cell_for(nodes: DataFrame, each: float = 4.0) -> float:
    """The side of a cell that would hold ``each`` nodes if these lay evenly in their box."""
    box = nodes.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in AXES]).first()
    sides = [box[c] for c in AXES if box[c]]
    return math.prod(s * (each / box["n"]) ** (1 / len(sides)) for s in sides) ** (1 / len(sides)) if sides else 1.0


def box_cell(boxes: DataFrame) -> float:
    """Twice the mean side of boxes (xm..zp): a box touches few such cells, and a cell few boxes."""
    side = boxes.select(F.avg(sum((F.col(f"{c}p") - F.col(f"{c}m") for c in "yz"), F.col("xp") - F.col("xm")) / 3).alias("s")).first()["s"]
    return 2 * side if side else 1.0


def nearest(nodes: DataFrame, cell: float | None = None) -> DataFrame:
    """The nearest other node at a distance above zero, (n, near, d2); ties go to the lesser id.

    Rounds over a grid: a node meets the cells within r of its own; whoever
    finds a neighbour within r cells' width is done, for no other can be
    nearer. The rest go on with r doubled; past the greatest extent of all
    nodes everyone has met all. The first r follows the nodes' density if no
    ``cell`` is given.
    """
    cell = cell or cell_for(nodes)
    box = bounding_box(nodes).first()
    if box is None or box["xm"] is None:
        return nodes.select("n", F.lit(None).cast("bigint").alias("near"), F.lit(None).cast("double").alias("d2")).limit(0)
    extent = max(box[f"{c}p"] - box[f"{c}m"] for c in AXES)
    left, done, reach = stored(nodes.select("n", *AXES)), None, cell
    while True:
        grid = nodes.select(F.col("n").alias("near"), *[F.col(c).alias(f"{c}2") for c in AXES]).select("*", *cell_of(reach, "2"))
        around = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
        asked = left.select("*", *[F.floor(F.col(c) / reach).cast("bigint").alias(f"c{c}") for c in AXES])
        for c in AXES:
            asked = asked.withColumn("gl_k", around).withColumn(f"c{c}", F.col(f"c{c}") + F.col("gl_k")).drop("gl_k")
        d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in AXES), F.lit(0.0))
        met = asked.join(grid, [f"c{c}" for c in AXES]).withColumn("d2", d2).where("d2 > 0").groupBy("n").agg(F.min(F.struct("d2", "near")).alias("m"))
        found = stored(met.select("n", F.col("m.near").alias("near"), F.col("m.d2").alias("d2")))
        sure = found if reach > extent else found.where(F.col("d2") <= reach * reach)
        done = sure if done is None else done.unionByName(sure)
        left = stored(left.join(sure.select("n"), "n", "left_anti"))
        if reach > extent or left.isEmpty():
            return done
        reach *= 2


def closest_pairs(near: DataFrame) -> DataFrame:
    """Each node with its nearest, a mutual pair once (from the lesser id)."""
    back = near.select(F.col("n").alias("near"), F.col("near").alias("n"), F.lit(True).alias("mutual"))
    return near.join(back, ["n", "near"], "left").where("mutual is null or n < near").select("n", "near", "d2")


def medians(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The middle of each closest pair."""
    a, b = (nodes.select(F.col("n").alias(k), *[F.col(c).alias(f"{c}{k}") for c in AXES]) for k in ("n", "near"))
    return pairs.select("n", "near").join(a, "n").join(b, "near").select("n", "near", *[((F.col(f"{c}n") + F.col(f"{c}near")) / 2).alias(c) for c in AXES])


def same_place(nodes: DataFrame) -> DataFrame:
    """Exact spatial hashing: the id (from the least node) and the count of each place."""
    return nodes.groupBy(*AXES).agg(F.min("n").alias("first"), F.count("*").alias("n_at"))


def within(nodes: DataFrame, precision: float) -> DataFrame:
    """Pairs a < b of nodes within ``precision`` along each axis, by cells of that size."""
    grid = nodes.select("n", *AXES, *cell_of(precision))
    asked = grid.select(F.col("n").alias("b"), *[F.col(c).alias(f"{c}b") for c in AXES], *[F.col(f"c{c}") for c in AXES])
    for c in AXES:
        asked = asked.withColumn("gl_k", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"c{c}", F.col(f"c{c}") + F.col("gl_k")).drop("gl_k")
    close = F.lit(True)
    for c in AXES:
        close &= F.abs(F.col(c) - F.col(f"{c}b")) <= precision
    return grid.withColumnRenamed("n", "a").join(asked, [f"c{c}" for c in AXES]).where("a < b").where(close).select("a", "b")


def unique_nodes(nodes: DataFrame, precision: float) -> DataFrame:
    """Each node's representative (n, rep): the least earlier node within ``precision`` that is its own, else itself.

    Nodes of one place share what the first of them has, so only first ones
    are paired. In each round, whoever has no open earlier neighbour is its
    own, and its later neighbours are closed at once: none can be its own.
    The rounds are the longest chain of such decisions, few unless ids follow
    places along a line.
    """
    known = F.lit(True)
    for c in AXES:
        known &= F.col(c).isNotNull() & ~F.isnan(c)
    first = stored(nodes.where(known).groupBy(*AXES).agg(F.min("n").alias("n")))
    pairs = stored(within(first, precision))
    left, live, own = first.select("n"), pairs, None
    while True:
        free = stored(left.join(live.select(F.col("b").alias("n")).distinct(), "n", "left_anti"))
        own = free if own is None else stored(own.unionByName(free))
        met = live.join(free.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        left = stored(left.join(free, "n", "left_anti").join(met, "n", "left_anti"))
        if left.isEmpty():
            break
        live = stored(live.join(left.select(F.col("n").alias("a")), "a", "left_semi").join(left.select(F.col("n").alias("b")), "b", "left_semi").select("a", "b"))
    near = pairs.join(own.select(F.col("n").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("n")).agg(F.min("a").alias("rep"))
    reps = first.join(near, "n", "left").select(*AXES, F.coalesce("rep", "n").alias("rep"))
    return nodes.where(known).join(reps, [*AXES]).select("n", "rep").unionByName(nodes.where(~known).select("n", F.col("n").alias("rep")))


def octree(nodes: DataFrame, cap: int, max_level: int, low: tuple[float, float, float], side: float) -> DataFrame:
    """Leaves (n, path) of an octree: a cell of more than ``cap`` nodes is split, down to ``max_level``.

    A path is a digit for each level: 1 for x, 2 for y, 4 for z beyond the
    cell's middle; the middle itself goes to the lower side. All levels' digits
    are arithmetic; each round only counts the nodes of cells that still split.
    """
    bounds = list(low)
    live = nodes.select("n", *AXES, F.lit("").alias("path"), *[F.lit(b).alias(f"m{c}") for c, b in zip(AXES, bounds, strict=True)])
    out, half = None, side / 2
    for level in range(max_level + 1):
        live = stored(live)
        sizes = live.groupBy("path").agg(F.count("*").alias("k"))
        full = sizes.where(F.col("k") > cap).select("path") if level < max_level else sizes.limit(0).select("path")
        leaf = live.join(full, "path", "left_anti").select("n", "path")
        out = leaf if out is None else out.unionByName(leaf)
        rest = live.join(full, "path", "left_semi")
        upper = [(F.col(c) > F.col(f"m{c}") + half) for c in AXES]
        digit = sum((u.cast("int") * (1 << k) for k, u in enumerate(upper)), F.lit(0))
        live = rest.select("n", *AXES, F.concat("path", digit.cast("string")).alias("path"), *[(F.col(f"m{c}") + F.when(u, F.lit(half)).otherwise(F.lit(0.0))).alias(f"m{c}") for c, u in zip(AXES, upper, strict=True)])
        half /= 2
    return out


def octants(leaves: DataFrame) -> DataFrame:
    """Every cell of a tree: path, level, nodes, leaf."""
    each = leaves.groupBy("path").agg(F.count("*").alias("k"))
    up = each.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("p"), "path", "k")
    return up.groupBy("p").agg(F.sum("k").alias("nodes"), F.max((F.col("p") == F.col("path")).cast("int")).alias("leaf")).select(F.col("p").alias("path"), F.length("p").cast("bigint").alias("level"), "nodes", (F.col("leaf") == 1).alias("leaf"))


def _full_path(low: tuple[float, float, float], side: float, max_level: int) -> Column:
    m, half, path = [F.lit(b) for b in low], side / 2, F.lit("")
    for _ in range(max_level):
        up = [F.col(c) > m[k] + half for k, c in enumerate(AXES)]
        path = F.concat(path, sum((u.cast("int") * (1 << k) for k, u in enumerate(up)), F.lit(0)).cast("string"))
        m = [m[k] + F.when(u, F.lit(half)).otherwise(F.lit(0.0)) for k, u in enumerate(up)]
        half /= 2
    return path


def locate(probes: DataFrame, tree: DataFrame, low: tuple[float, float, float], side: float, max_level: int) -> DataFrame:
    """The deepest cell of a tree (path) that holds each probe (p, x, y, z): its path to full depth, joined on every prefix."""
    prefixes = probes.select("p", _full_path(low, side, max_level).alias("gl_full")).select("p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_level)), lambda n: F.substring(F.col("gl_full"), F.lit(1), n))).alias("path"))
    return prefixes.join(tree.select("path"), "path").groupBy("p").agg(F.max_by("path", F.length("path")).alias("path"))


def boxes_overlapping(a: DataFrame, b: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs (a, b) of ids whose closed boxes (id, xm..zp) overlap.

    Both sides are dealt to the cells that they touch; a pair is reported by
    the cell of its overlap's lower corner alone, so no distinct is needed.
    The cells follow the boxes' sizes if none is given.
    """
    cell = cell or max(box_cell(a), box_cell(b))

    def dealt(t: DataFrame, s: str) -> DataFrame:
        t = t.select(F.col("id").alias(f"id{s}"), *[F.col(f"{c}{e}").alias(f"{c}{e}{s}") for c in AXES for e in "mp"])
        for c in AXES:
            t = t.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}m{s}") / cell), F.floor(F.col(f"{c}p{s}") / cell))))
        return t

    met = dealt(a, "1").join(dealt(b, "2"), [f"c{c}" for c in AXES])
    for c in AXES:
        met = met.where((F.col(f"{c}m1") <= F.col(f"{c}p2")) & (F.col(f"{c}m2") <= F.col(f"{c}p1"))).where(F.floor(F.greatest(f"{c}m1", f"{c}m2") / cell) == F.col(f"c{c}"))
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def box_distance2(boxes: DataFrame) -> Column:
    """Squared distance of a point (x, y, z) to a box; 0 inside."""
    gap = [F.greatest(F.col(f"{c}m") - F.col(c), F.lit(0.0), F.col(c) - F.col(f"{c}p")) for c in AXES]
    return sum((g * g for g in gap), F.lit(0.0))


def points_in_tetrahedra(probes: DataFrame, tets: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs (p, e): probes in a tetrahedron's closed box, by cells, then by the exact test."""
    box = tets.select("*", *[F.least(*[F.col(f"{c}{k}") for k in range(4)]).alias(f"{c}lo") for c in AXES], *[F.greatest(*[F.col(f"{c}{k}") for k in range(4)]).alias(f"{c}hi") for c in AXES])
    cell = cell or box_cell(box.select(*[F.col(f"{c}{a}").alias(f"{c}{b}") for c in AXES for a, b in (("lo", "m"), ("hi", "p"))]))
    for c in AXES:
        box = box.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}lo") / cell), F.floor(F.col(f"{c}hi") / cell))))
    met = probes.select("p", *AXES, *cell_of(cell)).join(box, [f"c{c}" for c in AXES])
    return met.where(encloses((F.col("x"), F.col("y"), F.col("z")), tuple(point(k) for k in range(4)))).select("p", "e")


#: Rays of a block; pairs of a segment and a triangle that a block of segments meets, and segments of a block at most.
RAYS, PAIRS, SEGMENTS = 2_048, 1 << 24, 1_024
#: Blocks are dealt to so many tasks at most.
TASKS = 4_096


def _in_blocks(items: DataFrame, each: int) -> DataFrame:
    """``items`` with ``gl_b``: blocks of ``each`` rows that lie together, by the places of their middles (gl_x, gl_y, gl_z) on a Z-order curve."""
    box = items.agg(*[f(f"gl_{c}").alias(f"{c}{s}") for c in AXES for f, s in ((F.min, "m"), (F.max, "p"))]).first()
    z = F.lit(0).cast("bigint")
    for k, c in enumerate(AXES):
        low, side = box[f"{c}m"], (box[f"{c}p"] or 0) - (box[f"{c}m"] or 0)
        at = F.floor((F.col(f"gl_{c}") - low) / side * 1023).cast("bigint") if side > 0 else F.lit(0).cast("bigint")
        for bit in range(10):
            z += F.call_function("shiftright", at, F.lit(bit)).bitwiseAND(1) * (1 << (3 * bit + k))
    placed = numbered(items.withColumn("gl_z", z).drop("gl_x", "gl_y"), ["gl_z"])
    return placed.withColumn("gl_b", F.floor(F.col("gl_n") / each).cast("bigint")).drop("gl_n", "gl_z")


def _dealt(triangles: DataFrame, blocks: DataFrame, axes: str) -> DataFrame:
    """Triangles with each block (gl_b, xm..zp) whose box theirs overlaps along ``axes``.

    Both are dealt to cells, about as many as there are blocks, over the room
    that the blocks take; a pair is reported by the cell of its overlap's lower
    corner.
    """
    room = blocks.agg(F.count("*").alias("n"), *[F.min(f"{c}m").alias(f"{c}m") for c in axes], *[F.max(f"{c}p").alias(f"{c}p") for c in axes]).first()
    per = math.ceil(room["n"] ** (1 / len(axes)))
    own = {c: ([F.col(f"{c}{k}") for k in range(3)]) for c in axes}
    t = triangles.withColumns({f"gl_{c}m": F.least(*own[c]) for c in axes} | {f"gl_{c}p": F.greatest(*own[c]) for c in axes})
    for c in axes:
        low, high = room[f"{c}m"], room[f"{c}p"]
        cell = lambda v, low=low, high=high: F.greatest(F.lit(0), F.least(F.lit(per - 1), F.floor((v - low) / (high - low) * per))) if low is not None and high > low else F.lit(0)
        t = t.where((F.col(f"gl_{c}p") >= F.lit(low)) & (F.col(f"gl_{c}m") <= F.lit(high))).withColumn(f"gl_c{c}", F.explode(F.sequence(cell(F.col(f"gl_{c}m")), cell(F.col(f"gl_{c}p")))))
        blocks = blocks.withColumn(f"gl_c{c}", F.explode(F.sequence(cell(F.col(f"{c}m")), cell(F.col(f"{c}p"))))).withColumn(f"gl_f{c}", cell(F.col(f"{c}m")))
        t = t.withColumn(f"gl_g{c}", cell(F.col(f"gl_{c}m")))
    met = t.join(blocks, [f"gl_c{c}" for c in axes])
    for c in axes:
        met = met.where((F.col(f"gl_{c}m") <= F.col(f"{c}p")) & (F.col(f"{c}m") <= F.col(f"gl_{c}p"))).where(F.greatest(f"gl_f{c}", f"gl_g{c}") == F.col(f"gl_c{c}"))
    return met.drop(*[f"gl_{k}{c}" for c in axes for k in "cfg"], *[f"gl_{c}{k}" for c in axes for k in "mp"])


def _met(items: DataFrame, triangles: DataFrame, bounds: list[tuple[Column, Column]], axes: str, kernel: Callable, schema: str) -> DataFrame:
    """What ``kernel`` makes of each block of ``items`` with the triangles (f, x0..z2) that its box overlaps along ``axes``; ``bounds`` are an item's."""
    n = items.agg(F.max("gl_b")).first()[0]
    if n is None:
        return items.sparkSession.createDataFrame([], schema)
    tasks = min(TASKS, n + 1)
    blocks = items.groupBy("gl_b").agg(*[g(v).alias(f"{c}{s}") for c, b in zip(AXES, bounds, strict=True) for g, s, v in ((F.min, "m", b[0]), (F.max, "p", b[1]))])
    dealt = _dealt(triangles.select(F.col("f").cast("bigint").alias("f"), *[F.col(f"{c}{k}").cast("double").alias(f"{c}{k}") for k in range(3) for c in AXES]), blocks, axes)
    dealt = dealt.select(F.col("gl_b").alias("gl_at"), "f", *[f"{c}{k}" for k in range(3) for c in AXES])
    return items.repartition(tasks, "gl_b").groupBy("gl_b").cogroup(dealt.repartition(tasks, "gl_at").groupBy("gl_at")).applyInArrow(kernel, schema)


def _ray_blocks(rays: DataFrame, triangles: DataFrame, axis: str, kernel: Callable, schema: str) -> DataFrame:
    k = AXES.index(axis)
    axes = AXES[(k + 1) % 3], AXES[(k + 2) % 3], axis
    at = [F.col(c).cast("double") for c in AXES]
    items = _in_blocks(rays.select(F.col("ray").cast("bigint").alias("ray"), *[v.alias(f"p{c}") for c, v in zip(AXES, at, strict=True)], *[v.alias(f"gl_{c}") for c, v in zip(AXES, at, strict=True)]), RAYS)
    return _met(items, triangles, [(F.col(f"p{c}"),) * 2 for c in AXES], "".join(axes[:2]), kernel(axes), schema)


def ray_hits(rays: DataFrame, triangles: DataFrame, axis: str = "z") -> DataFrame:
    """Crossings (ray, f, t, k) of rays (ray, x, y, z from) along +x, +y or +z with triangles (f, x0..z2), in order along each ray; t is the place along the axis.

    A ray crosses a triangle whose inside it passes through beyond its start;
    edges are no inside. Rays stay in their block, to which the triangles come.
    """
    return _ray_blocks(rays, triangles, axis, crossings.ray_hits, "ray long, f long, t double, k long")


def ray_counts(rays: DataFrame, triangles: DataFrame, axis: str = "z") -> DataFrame:
    """How many triangles each ray that meets some crosses (ray, hits), as :func:`ray_hits` has them.

    A triangle that all rays of a part of a block cross is counted for them at once.
    """
    return _ray_blocks(rays, triangles, axis, crossings.ray_counts, "ray long, hits long").groupBy("ray").agg(F.sum("hits").alias("hits"))


def segment_hits(segments: DataFrame, triangles: DataFrame) -> DataFrame:
    """Crossings (id, f, t, status, k) of segments (id, px..qz) with triangles (f, x0..z2), in order along each segment.

    Ends on the plane and edges count. status is 2 where the segment goes along
    the triangle's normal, -2 where it goes against it. Segments stay in their
    block, to which the triangles come, so crossings are put in order where
    they are found and never move.
    """
    each = max(1, min(SEGMENTS, PAIRS // max(1, triangles.count())))
    ends = [F.col(f"{e}{c}").cast("double").alias(f"{e}{c}") for e in "pq" for c in AXES]
    items = _in_blocks(segments.select(F.col("id").cast("bigint").alias("id"), *ends, *[((F.col(f"p{c}") + F.col(f"q{c}")) / 2).alias(f"gl_{c}") for c in AXES]), each)
    bounds = [(F.least(f"p{c}", f"q{c}"), F.greatest(f"p{c}", f"q{c}")) for c in AXES]
    return _met(items, triangles, bounds, AXES, crossings.segment_hits(), "id long, f long, t double, status int, k long")


def inside_by_parity(counts: DataFrame) -> DataFrame:
    """Rays (of :func:`ray_counts`) whose start is inside a closed surface: an odd number of crossings."""
    return counts.select("ray", (F.col("hits") % 2 == 1).alias("inside"))


def level_for(side: float, granularity: float) -> int:
    """The level whose cells come nearest to ``granularity`` in size."""
    level, size = 0, side
    while size > granularity:
        level, size = level + 1, size / 2
    return level if granularity - size < size * 2 - granularity else level - 1


def granularity_at(side: float, level: int) -> float:
    return side / 2**level


def imbalance(cells: DataFrame) -> DataFrame:
    """How unevenly each split cell's nodes lie in its eighths: 0 even, about 1 if all lie in one. Fixed value: 0.5773."""
    kids = cells.where("level > 0").select(F.expr("substring(path, 1, level - 1)").alias("path"), F.substring("path", -1, 1).cast("int").alias("d"), "nodes")
    pull = [F.sum(F.when(F.col("d").bitwiseAND(1 << k) != 0, F.col("nodes")).otherwise(-F.col("nodes"))) * 0.5773 / F.sum("nodes") for k in range(3)]
    return kids.groupBy("path").agg(F.sqrt(sum((p * p for p in pull), F.lit(0.0))).alias("imbalance"))


def as_grid(leaves: DataFrame) -> DataFrame:
    """Cells (level, ix, iy, iz) of paths: each axis' bits of the digits."""
    bit = lambda k: F.aggregate(F.filter(F.split("path", ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a * 2 + F.shiftright(c.cast("int"), k) % 2)
    return leaves.select(F.length("path").cast("int").alias("level"), *[bit(k).alias(f"i{c}") for k, c in enumerate(AXES)])


def _touching(cells: DataFrame, directions: list[tuple[int, int, int]]) -> DataFrame:
    """Each cell's places at its own level in the given directions, inside the root: level, i*, d, n*."""
    moves = F.explode(F.array(*[F.struct(F.lit(n).alias("d"), *[F.lit(v).alias(c) for c, v in zip(AXES, d, strict=True)]) for n, d in enumerate(directions)]))
    out = cells.withColumn("m", moves).select("level", "ix", "iy", "iz", F.col("m.d").alias("d"), *[(F.col(f"i{c}") + F.col(f"m.{c}")).alias(f"n{c}") for c in AXES])
    top = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level"))
    for c in AXES:
        out = out.where((F.col(f"n{c}") >= 0) & (F.col(f"n{c}") < top))
    return out


FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]
EDGES = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) == 2]


def neighbours(cells: DataFrame, edges: bool = False) -> DataFrame:
    """Each leaf (level, ix, iy, iz) with the leaf of its own or a coarser level beside each face (and edge): the same columns with 2."""
    near = _touching(cells, FACES + EDGES if edges else FACES)
    up = near.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("level"))))
    keys = up.select("level", "ix", "iy", "iz", "d", (F.col("level") - F.col("k")).alias("level2"), *[F.call_function("shiftright", F.col(f"n{c}"), F.col("k")).alias(f"i{c}2") for c in AXES])
    other = cells.select(F.col("level").alias("level2"), *[F.col(f"i{c}").alias(f"i{c}2") for c in AXES])
    return keys.join(other, ["level2", *[f"i{c}2" for c in AXES]])


def balance(cells: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Split leaves until no two that share a face differ by more than one level."""
    now = stored(cells.select("level", "ix", "iy", "iz"))
    for _ in range(max_rounds):
        coarse = stored(neighbours(now).where("level - level2 > 1").select(F.col("level2").alias("level"), *[F.col(f"i{c}2").alias(f"i{c}") for c in AXES]).distinct())
        if coarse.isEmpty():
            return now
        keys = ["level", "ix", "iy", "iz"]
        eighths = F.explode(F.array(*[F.struct(*[F.lit((n >> k) & 1).alias(c) for k, c in enumerate(AXES)]) for n in range(8)]))
        kids = coarse.withColumn("m", eighths).select((F.col("level") + 1).alias("level"), *[(F.col(f"i{c}") * 2 + F.col(f"m.{c}")).alias(f"i{c}") for c in AXES])
        now = stored(now.join(coarse, keys, "left_anti").unionByName(kids))
    raise RuntimeError("no balance after max_rounds")


def flags_up(cells: DataFrame) -> DataFrame:
    """Flags (path, flag) of every ancestor: the union of its leaves' bits."""
    each = cells.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"), "flag")
    return each.groupBy("path").agg(F.bit_or("flag").alias("flag"))


def grid_flags_up(cells: DataFrame) -> DataFrame:
    """Flags (path, points) of each parent's 27 points, 3 along each axis (bit x + 3 y + 9 z), from its children's corner flags (path, corners; bit x + 2 y + 4 z)."""
    digit = F.substring("path", -1, 1).cast("int")
    bits = sum((F.when(F.col("corners").bitwiseAND(1 << c) != 0, F.call_function("shiftleft", F.lit(1), _grid_bit(digit, c))).otherwise(0) for c in range(8)), F.lit(0))
    return cells.where("path <> ''").groupBy(F.expr("substring(path, 1, length(path) - 1)").alias("path")).agg(F.bit_or(bits).alias("points"))


def corner_flags_down(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Corner flags (path, corners) of ``children`` (path) as their parents' points (path, points) have them."""
    own = children.select("path", F.expr("substring(path, 1, length(path) - 1)").alias("up"), F.substring("path", -1, 1).cast("int").alias("digit")).where("path <> ''")
    met = own.join(parents.select(F.col("path").alias("up"), "points"), "up")
    corners = sum((F.call_function("shiftright", F.col("points"), _grid_bit(F.col("digit"), c)).bitwiseAND(1) * (1 << c) for c in range(8)), F.lit(0))
    return met.select("path", corners.alias("corners"))


def _grid_bit(digit: Column, corner: int) -> Column:
    """The place among the parent's 27 points of a corner of the child ``digit``."""
    return sum(((F.call_function("shiftright", digit, F.lit(k)).bitwiseAND(1) + (corner >> k & 1)) * 3**k for k in range(3)), F.lit(0))


def edges_in_cells(edges: DataFrame, cell: float) -> DataFrame:
    """Grid cells (id, cx, cy, cz) that each segment (id, x0..z1) passes through, borders included: its box's cells, then a slab test."""
    out = edges
    for c in AXES:
        out = out.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.least(f"{c}0", f"{c}1") / cell), F.floor(F.greatest(f"{c}0", f"{c}1") / cell))))
    enter, leave = [], []
    for c in AXES:
        d, lo, hi = F.col(f"{c}1") - F.col(f"{c}0"), F.col(f"c{c}") * cell - F.col(f"{c}0"), (F.col(f"c{c}") + 1) * cell - F.col(f"{c}0")
        enter.append(F.when(d != 0, F.least(lo / F.nullif(d, F.lit(0.0)), hi / F.nullif(d, F.lit(0.0)))).otherwise(F.lit(0.0)))
        leave.append(F.when(d != 0, F.greatest(lo / F.nullif(d, F.lit(0.0)), hi / F.nullif(d, F.lit(0.0)))).otherwise(F.lit(1.0)))
    return out.where(F.greatest(*enter, F.lit(0.0)) <= F.least(*leave, F.lit(1.0))).select("id", "cx", "cy", "cz")


def find_nodes(nodes: DataFrame, x: float, y: float, z: float, err: float, most: int = 16) -> DataFrame:
    """Nodes within ``err`` of a place along each axis, the first ``most`` by id."""
    near = (F.abs(F.col("x") - x) <= err) & (F.abs(F.col("y") - y) <= err) & (F.abs(F.col("z") - z) <= err)
    return nodes.where(near).orderBy("n").limit(most)


def lattice_inside(triangles: DataFrame, low: tuple[float, float, float], step: float, n: tuple[int, int, int], cell: float | None = None) -> DataFrame:
    """Points (id, x, y, z) of a lattice that are inside a closed surface, by the parity of upward rays. ``cell`` is no longer needed: blocks follow the rays."""
    nx, ny, nz = n
    i = F.col("id")
    grid = triangles.sparkSession.range(nx * ny * nz).select("id", (low[0] + step * (i % nx)).alias("x"), (low[1] + step * (F.floor(i / nx) % ny)).alias("y"), (low[2] + step * F.floor(i / (nx * ny))).alias("z"))
    inside = inside_by_parity(ray_counts(grid.withColumnRenamed("id", "ray"), triangles)).where("inside").select(F.col("ray").alias("id"))
    return grid.join(inside, "id", "left_semi")


def insert_nodes(leaves: DataFrame, nodes: DataFrame, more: DataFrame, cap: int, max_level: int, low: tuple[float, float, float], side: float) -> DataFrame:
    """Leaves (n, path) of a tree over ``nodes`` once ``more`` nodes are inserted: what a tree built over both would hold.

    A new node goes to the leaf that holds it or, under a branch without such
    a leaf, to a new one. Only nodes of leaves that now hold more than ``cap``
    are placed anew.
    """
    asked = more.select("n", _full_path(low, side, max_level).alias("gl_full"))
    probes = asked.select("n", "gl_full", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_level)), lambda k: F.substring(F.col("gl_full"), F.lit(1), k))).alias("path"))
    met = probes.join(octants(leaves).select("path", "leaf"), "path").groupBy("n").agg(F.max_by(F.struct("path", "leaf"), F.length("path")).alias("c"))
    depth = F.when(F.col("c").isNull(), 0).when(F.col("c.leaf"), F.length("c.path")).otherwise(F.length("c.path") + 1)
    placed = asked.join(met, "n", "left").select("n", F.col("gl_full").substr(F.lit(1), depth).alias("path"))
    grown = stored(leaves.select("n", "path").unionByName(placed))
    full = grown.groupBy("path").agg(F.count("*").alias("k")).where((F.col("k") > cap) & (F.length("path") < max_level)).select("path")
    again = nodes.unionByName(more, allowMissingColumns=True).join(grown.join(full, "path", "left_semi").select("n"), "n", "left_semi")
    return grown.join(full, "path", "left_anti").select("n", "path").unionByName(octree(again, cap, max_level, low, side))

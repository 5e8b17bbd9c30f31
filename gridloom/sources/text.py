"""Text sinks: grids of numbers, graph descriptions and cell boxes, as lines to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import five_chars


def grid_lines(m: DataFrame, cols: int) -> DataFrame:
    """Lines (i, value) of a matrix' rows that hold a value: numbers in five characters, a dash for each zero."""
    rows = m.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", five_chars(F.col("v")).alias("t")))).alias("cells"))
    cell = lambda c: F.coalesce(F.col("cells")[c], F.lit("   -   "))
    return rows.select("i", F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint")), cell), "").alias("value"))


def corner_lines(m: DataFrame, rows: int, cols: int, most: int = 50) -> DataFrame:
    """Lines (i, value) of a matrix as text, of its first ``most`` rows and columns: every row, those of zeros alone too."""
    shown = m.where((F.col("i") < most) & (F.col("j") < most))
    blank = F.lit("   -   " * min(cols, most))
    return m.sparkSession.range(min(rows, most)).select(F.col("id").alias("i")).join(grid_lines(shown, min(cols, most)), "i", "left").select("i", F.coalesce("value", blank).alias("value"))


def sparse_lines(m: DataFrame) -> DataFrame:
    """Lines (i, value) of a sparse dump: row(i): [(i, j, v), ...], values to three decimals."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: F.concat(F.lit("("), F.col("i").cast("string"), F.lit(", "), c["j"].cast("string"), F.lit(", "), F.format_string("%.3f", c["v"]), F.lit(")")))
    return m.groupBy("i").agg(F.concat(F.lit("row("), F.col("i").cast("string"), F.lit("): ["), F.array_join(cells, ", "), F.lit("]")).alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """Lines (ord, value) of a directed graph (src, dst, kind) for GraphViz: the head, an edge each, the foot."""
    body = edges.select(F.lit(1).alias("ord"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(' [label="'), F.col("kind"), F.lit('"];')).alias("value"))
    ends = edges.sparkSession.createDataFrame([(0, "digraph g {"), (2, "}")], "ord int, value string")
    return ends.unionByName(body)


def cell_lines(cells: DataFrame, low: tuple[float, float, float], side: float, levels: tuple[int, int] = (0, 62)) -> DataFrame:
    """OBJ lines (cell, k, value) of octree cells (level, ix, iy, iz) between two ``levels``: eight vertices, then six faces that count back from the last vertex."""
    cells = cells.where(F.col("level").between(*levels))
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    corners = []
    for n in range(8):
        at = [F.lit(b) + size * (F.col(f"i{c}") + ((n >> k) & 1)) for k, (c, b) in enumerate(zip("xyz", low, strict=True))]
        corners.append(F.concat_ws(" ", F.lit("v "), *[a.cast("string") for a in at]))
    faces = ["f -8 -6 -5 -7", "f -4 -3 -1 -2", "f -8 -7 -3 -4", "f -6 -2 -1 -5", "f -8 -4 -2 -6", "f -7 -5 -1 -3"]
    cell = F.struct("level", "ix", "iy", "iz").alias("cell")
    return cells.select(cell, F.posexplode(F.array(*corners, *[F.lit(f) for f in faces])).alias("k", "value"))

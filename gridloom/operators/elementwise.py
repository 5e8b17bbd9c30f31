"""Cell-wise operators on sparse matrices: filters, windows, sums, permutations, supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.relations import near_zero


def drop_zeros(m: DataFrame) -> DataFrame:
    """Cells that don't count as zero."""
    return m.where(~(near_zero(F.col("v"), F.col("iv")) if "iv" in m.columns else near_zero(F.col("v"))))


def purge_count(m: DataFrame) -> DataFrame:
    """How many cells a purge removes and leaves, in one pass."""
    z = near_zero(F.col("v"))
    return m.agg(F.count(F.when(z, 1)).alias("removed"), F.count(F.when(~z, 1)).alias("kept"))


def window(m: DataFrame, i0: int, j0: int, i1: int, j1: int) -> DataFrame:
    """The cells of rows [i0, i1) and columns [j0, j1), counted from the window's corner; the shape is (i1 - i0, j1 - j0)."""
    return m.where((F.col("i") >= i0) & (F.col("i") < i1) & (F.col("j") >= j0) & (F.col("j") < j1)).select((F.col("i") - i0).alias("i"), (F.col("j") - j0).alias("j"), *[c for c in m.columns if c not in "ij"])


def drop_row_column(m: DataFrame, r: int, c: int) -> DataFrame:
    """Without row ``r`` and column ``c``; those after it move up."""
    return m.where((F.col("i") != r) & (F.col("j") != c)).select((F.col("i") - (F.col("i") > r).cast("int")).alias("i"), (F.col("j") - (F.col("j") > c).cast("int")).alias("j"), "v")


def values_at(m: DataFrame, cells: DataFrame) -> DataFrame:
    """Values of the asked ``cells`` (i, j); zero where the matrix has none."""
    return cells.join(m, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def put(m: DataFrame, cells: DataFrame) -> DataFrame:
    """``m`` with the cells (i, j, v) written over it; a zero removes a cell."""
    return m.join(cells, ["i", "j"], "left_anti").unionByName(drop_zeros(cells))


def remove(m: DataFrame, cells: DataFrame) -> DataFrame:
    """``m`` without the cells (i, j)."""
    return m.join(cells, ["i", "j"], "left_anti")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in m.columns if c not in "ij"])


def swap(m: DataFrame, axis: str, a: int, b: int) -> DataFrame:
    """Exchange two rows (``axis`` i) or columns (j)."""
    k = F.col(axis)
    return m.withColumn(axis, F.when(k == a, F.lit(b)).when(k == b, F.lit(a)).otherwise(k).cast("bigint"))


def permute(m: DataFrame, perm: DataFrame, axis: str, inverse: bool = False) -> DataFrame:
    """Move rows or columns by ``perm`` (pos, src): position ``pos`` gets what was at ``src``; ``inverse`` undoes it."""
    old, new = ("pos", "src") if inverse else ("src", "pos")
    p = perm.select(F.col(old).alias(axis), F.col(new).alias("gl_to"))
    return m.join(p, axis).withColumn(axis, F.col("gl_to")).select(*m.columns)


def index_list(m: DataFrame, side: int) -> DataFrame:
    """Each row's column ids before (-2), up to (-1), anywhere about (0), from (1) or after (2) its diagonal, in order."""
    where = {-2: "j < i", -1: "j <= i", 0: "true", 1: "j >= i", 2: "j > i"}[side]
    return m.where(where).groupBy("i").agg(F.sort_array(F.collect_list("j")).alias("js"))


def combine(a: DataFrame, b: DataFrame, fa: float = 1.0, fb: float = 1.0) -> DataFrame:
    """fa * a + fb * b, by one aggregation over both (no join), without cells that cancel out."""
    both = a.select("i", "j", (F.col("v") * fa).alias("v")).unionAll(b.select("i", "j", (F.col("v") * fb).alias("v")))
    return drop_zeros(both.groupBy("i", "j").agg(F.sum("v").alias("v")))


def combine_complex(a: DataFrame, b: DataFrame, fb: float = 1.0) -> DataFrame:
    """a + fb * b of complex matrices."""
    both = a.select("i", "j", "v", "iv").unionAll(b.select("i", "j", (F.col("v") * fb).alias("v"), (F.col("iv") * fb).alias("iv")))
    return drop_zeros(both.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("iv").alias("iv")))


def add_row(m: DataFrame, to: int, row: int, factor: float) -> DataFrame:
    """Row ``to`` plus ``factor`` times row ``row``."""
    return combine(m, m.where(F.col("i") == row).withColumn("i", F.lit(to).cast("bigint")), 1.0, factor)


def scale(m: DataFrame, factor: float) -> DataFrame:
    return drop_zeros(m.select("i", "j", (F.col("v") * factor).alias("v")))


def add_scalar(m: DataFrame, value: float, rows: int, cols: int) -> DataFrame:
    """Add to every cell of the dense shape, zeros too."""
    return combine(m, dense_domain(m, rows, cols).select("i", "j", F.lit(value).alias("v")))


def dense_domain(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of a shape, made from a range without a join."""
    return m.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("bigint").alias("i"), (F.col("id") % cols).alias("j"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The greatest difference of two matrices' cells, and whether they are equal within the near-zero bound."""
    both = a.select("i", "j", "v").unionAll(b.select("i", "j", (-F.col("v")).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("d"))
    return both.agg(F.coalesce(F.max(F.abs("d")), F.lit(0.0)).alias("max_diff")).select("max_diff", near_zero(F.col("max_diff")).alias("equal"))


def support_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return drop_zeros(a).select("i", "j").unionAll(drop_zeros(b).select("i", "j")).distinct()


def support_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return drop_zeros(a).select("i", "j").intersect(drop_zeros(b).select("i", "j"))


def support_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two supports are the same, by one aggregation."""
    both = drop_zeros(a).select("i", "j", F.lit(1).alias("s")).distinct().unionAll(drop_zeros(b).select("i", "j", F.lit(-1).alias("s")).distinct())
    odd = both.groupBy("i", "j").agg(F.sum("s").alias("s")).where("s <> 0")
    return odd.agg(F.count("*").alias("unmatched")).select("unmatched", (F.col("unmatched") == 0).alias("equal"))


def set_bits(s: DataFrame, cells: DataFrame) -> DataFrame:
    """A support (i, j) with the cells (i, j) set."""
    return s.select("i", "j").unionAll(cells.select("i", "j")).distinct()


def clear_bits(s: DataFrame, cells: DataFrame) -> DataFrame:
    """A support (i, j) with the cells (i, j) cleared."""
    return remove(s.select("i", "j"), cells)


def bits_at(s: DataFrame, cells: DataFrame) -> DataFrame:
    """Whether each of the asked ``cells`` (i, j) is set, as ``bit``."""
    return cells.select("i", "j").join(s.select("i", "j").distinct().withColumn("bit", F.lit(True)), ["i", "j"], "left").select("i", "j", F.coalesce("bit", F.lit(False)).alias("bit"))


def compact(m: DataFrame, mask: DataFrame) -> DataFrame:
    """The cells under a mask (i, j), numbered along rows; each row is numbered in a task of its own."""
    return m.join(mask, ["i", "j"], "left_semi").select("i", "j", "v", F.expr("row_number() over (partition by i order by j)").cast("bigint").alias("k"))

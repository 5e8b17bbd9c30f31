"""Aggregations, order-dependent operators and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.graph import components
from gridloom.plans.loops import stored
from gridloom.plans.relations import near_zero


def norm_one(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm1"))


def norm_frobenius(m: DataFrame) -> DataFrame:
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm_f"))


def center_columns(m: DataFrame, rows: int) -> DataFrame:
    """Values less their column's mean over all ``rows``, zeros counted; given for the cells that are stored, and the mean that all others take."""
    means = m.groupBy("j").agg((F.sum("v") / rows).alias("mean"))
    return m.join(means, "j").select("i", "j", (F.col("v") - F.col("mean")).alias("v"), "mean")


def normalise_columns(m: DataFrame) -> DataFrame:
    """Values over their column's Euclidean length."""
    length = m.groupBy("j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length")).where("length > 0")
    return m.join(length, "j").select("i", "j", (F.col("v") / F.col("length")).alias("v"))


def zero_analysis(m: DataFrame, axis: str, other: int) -> DataFrame:
    """Zeros of each row or column of ``other`` cells, and its rank, most zeros first."""
    counts = m.where(~near_zero(F.col("v"))).groupBy(F.col(axis).alias("k")).agg(F.count("*").alias("stored")).select("k", (F.lit(other) - F.col("stored")).alias("zeros"))
    placed = zero_order(counts)
    first = placed.groupBy("zeros").agg((F.min("pos") + 1).alias("rank"))  # equal counts share the rank of the first of them
    return placed.join(first, "zeros").select("k", "zeros", "rank")


def zero_order(counts: DataFrame) -> DataFrame:
    """Rows or columns (k, zeros) with their place ``pos`` by falling counts of zeros, ties by index."""
    return numbered(counts.select("k", "zeros", (-F.col("zeros")).alias("gl_z")), ["gl_z", "k"]).select("k", "zeros", F.col("gl_n").alias("pos"))


def zero_summary(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: stored cells (nnz), whether some row has more zeros than any column (row_aspect), and the sign (1, -1) of the swaps that bring the aspect with most zeros in falling order.

    All ``rows`` and ``cols`` count, those without a cell too. The sign is that
    of the permutation: rows less cycles, the cycles found as components.
    """
    full, most, sign = m.where(~near_zero(F.col("v"))), {}, {}
    for axis, n, other in (("i", rows, cols), ("j", cols, rows)):
        counts = full.groupBy(F.col(axis).alias("k")).agg(F.count("*").alias("stored"))
        zeros = m.sparkSession.range(n).select(F.col("id").alias("k")).join(counts, "k", "left").select("k", (F.lit(other) - F.coalesce("stored", F.lit(0))).alias("zeros"))
        placed = stored(zero_order(zeros))
        most[axis] = placed.agg(F.max("zeros")).first()[0]
        cycles = components(placed.select(F.col("k").alias("src"), F.col("pos").alias("dst"))).agg(F.countDistinct("root")).first()[0]
        sign[axis] = 1 if (n - cycles) % 2 == 0 else -1
    by_row = most["i"] > most["j"]
    return full.agg(F.count("*").alias("nnz")).select("nnz", F.lit(by_row).alias("row_aspect"), F.lit(sign["i" if by_row else "j"]).cast("int").alias("sign"))


def half_bandwidth(m: DataFrame) -> DataFrame:
    return m.where(~near_zero(F.col("v"))).agg(F.max(F.abs(F.col("i") - F.col("j"))).alias("half_bandwidth"))


def diagonally_dominant(m: DataFrame) -> DataFrame:
    """Whether each row's other values together are less than its diagonal one; a row without a diagonal value is not dominant."""
    by = m.groupBy("i").agg(F.sum(F.when(F.col("i") != F.col("j"), F.abs("v"))).alias("off"), F.sum(F.when(F.col("i") == F.col("j"), F.abs("v"))).alias("on"))
    return by.select("i", F.coalesce(F.coalesce("off", F.lit(0.0)) < F.col("on"), F.lit(False)).alias("dominant"))


def zero_determinant_signs(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Reasons why a determinant is zero: rows or columns without a value, and pairs of equal rows."""
    whole = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("cells"))
    twins = whole.groupBy("cells").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("equal_rows"))
    empty = m.agg((F.lit(rows) - F.countDistinct("i")).alias("empty_rows"), (F.lit(cols) - F.countDistinct("j")).alias("empty_columns"))
    return empty.join(twins)  # one row each


def histogram(df: DataFrame, v: Column, low: float, high: float, bins: int) -> DataFrame:
    """Right-closed bins: bin b holds low + b * w < v <= low + (b + 1) * w, the first one low too; -1 and ``bins`` count what lies outside.

    The quotient is only a guess; the edges themselves, as computed, decide.
    """
    w = (high - low) / bins
    edge = lambda b: F.lit(low) + F.lit(w) * b
    guess = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((v - low) / w).cast("int") - 1))
    shifted = F.when((v <= edge(guess)) & (guess > 0), guess - 1).when((v > edge(guess + 1)) & (guess < bins - 1), guess + 1).otherwise(guess)
    b = F.when(v < low, F.lit(-1)).when(v > high, F.lit(bins)).otherwise(shifted)
    return df.where(v.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bounding_box(nodes: DataFrame, by: str | None = None) -> DataFrame:
    aggs = [f(c).alias(f"{c}{s}") for c in "xyz" for f, s in ((F.min, "m"), (F.max, "p"))]
    return nodes.groupBy(by).agg(*aggs) if by else nodes.agg(*aggs)


def root_cube(nodes: DataFrame, slack: float = 1e-10) -> DataFrame:
    """The cube around all nodes: the box widened by ``slack``, each side as long as the longest about its middle."""
    box = bounding_box(nodes)
    side = F.greatest(*[F.col(f"{c}p") - F.col(f"{c}m") for c in "xyz"]) + 2 * slack
    return box.select(*[((F.col(f"{c}p") + F.col(f"{c}m")) / 2 + sign * side / 2).alias(f"{c}{s}") for c in "xyz" for sign, s in ((-1, "m"), (1, "p"))])


def line_fit(df: DataFrame, by: str | None = None) -> DataFrame:
    """Least-squares line y = b0 + b1 x of columns x, y; null where all x are the same."""
    aggs = [F.regr_intercept("y", "x").alias("b0"), F.regr_slope("y", "x").alias("b1")]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def numbered(df: DataFrame, order: list[str], spark_parts: int | None = None) -> DataFrame:
    """``df`` with ``gl_n``, each row's place (from 0) in a global order, without gathering rows in one task.

    Rows are range-partitioned and sorted; partitions' counts give offsets.
    """
    parts = spark_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("gl_p", F.spark_partition_id())
    # stored: another run would draw other range bounds
    local = stored(laid.withColumn("gl_k", F.monotonically_increasing_id() - (F.col("gl_p").cast("bigint") * (1 << 33))))
    counts = sorted((r["gl_p"], r["n"]) for r in local.groupBy("gl_p").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    if not before:
        return df.withColumn("gl_n", F.lit(0).cast("bigint"))
    return local.join(F.broadcast(df.sparkSession.createDataFrame(before, "gl_p int, gl_b bigint")), "gl_p").withColumn("gl_n", F.col("gl_b") + F.col("gl_k")).drop("gl_p", "gl_k", "gl_b")


#: Rows of a run that one task adds up, at least, and runs at most.
RUN, RUNS = 100_000, 4_096


def running(df: DataFrame, order: list[str], sums: tuple[str, ...] = (), lasts: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in a global order with, for each row, ``sum_c`` (the columns ``sums`` added up to it) and ``last_c`` (the last value of ``lasts`` that is not null, up to it).

    Runs of equal length are added up apart; RUNS rows at most come to the
    driver, which carries what lies before each run. Adds gl_n, the place.
    """
    placed = numbered(df, order)
    size = max(RUN, -(-placed.count() // RUNS))
    placed = placed.withColumn("gl_run", F.floor(F.col("gl_n") / size).cast("bigint"))
    aggs = [F.sum(c).alias(f"s_{c}") for c in sums] + [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("gl_n"))).alias(f"l_{c}") for c in lasts]
    totals = placed.groupBy("gl_run").agg(*aggs)
    before, had = [], [0] * len(sums) + [None] * len(lasts)
    for r in sorted(totals.collect(), key=lambda r: r["gl_run"]):
        before.append((r["gl_run"], *had))
        had = [a + (b or 0) for a, b in zip(had, r[1 : 1 + len(sums)], strict=False)] + [b if b is not None else a for a, b in zip(had[len(sums) :], r[1 + len(sums) :], strict=True)]
    carry = F.broadcast(df.sparkSession.createDataFrame(before, totals.schema))
    w = Window.partitionBy("gl_run").orderBy("gl_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.select("*", *[F.sum(c).over(w).alias(f"sum_{c}") for c in sums], *[F.last(c, ignorenulls=True).over(w).alias(f"last_{c}") for c in lasts])
    met = own.join(carry, "gl_run").withColumns({f"sum_{c}": F.coalesce(f"sum_{c}", F.lit(0)) + F.col(f"s_{c}") for c in sums} | {f"last_{c}": F.coalesce(f"last_{c}", f"l_{c}") for c in lasts})
    return met.drop("gl_run", *[f"s_{c}" for c in sums], *[f"l_{c}" for c in lasts])


def compressed_rows(m: DataFrame) -> DataFrame:
    """(i, start, js, vs): each row that has cells, its columns in order with their values, and how many cells lie before it."""
    rows = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c")).select("i", F.size("c").cast("bigint").alias("n"), "c.j", "c.v")
    return running(rows, ["i"], sums=("n",)).select("i", (F.col("sum_n") - F.col("n")).alias("start"), F.col("j").alias("js"), F.col("v").alias("vs"))


def expanded_rows(rows: DataFrame) -> DataFrame:
    """The cells (i, j, v) of :func:`compressed_rows`."""
    return rows.select("i", F.explode(F.arrays_zip("js", "vs")).alias("c")).select("i", F.col("c.js").alias("j"), F.col("c.vs").alias("v"))


def piecewise_fit(df: DataFrame, length: int, order: list[str]) -> DataFrame:
    """Lines fitted to consecutive runs of ``length`` rows in order; the last may be shorter. center: the mean of the run's first and last x."""
    seg = numbered(df, order).withColumn("seg", F.floor(F.col("gl_n") / length).cast("bigint"))
    return seg.groupBy("seg").agg(((F.min_by("x", "gl_n") + F.max_by("x", "gl_n")) / 2).alias("center"), F.regr_intercept("y", "x").alias("b0"), F.regr_slope("y", "x").alias("b1"))


def blend(model: DataFrame, xs: DataFrame) -> DataFrame:
    """The model at ``x``: the lines of the segments around it, blended by the distance to their centers; beyond the ends, the end's line.

    An as-of join in one ordered pass: segments and places are sorted
    together, and each place takes the last segment at or before it.
    """
    held = numbered(model.select("center", "b0", "b1"), ["center"])
    after = held.select((F.col("gl_n") - 1).alias("gl_n"), F.col("center").alias("c2"), F.col("b0").alias("d0"), F.col("b1").alias("d1"))
    spans = stored(held.join(after, "gl_n", "left").select(F.struct("center", "b0", "b1", "c2", "d0", "d1").alias("s")))
    both = spans.select(F.col("s.center").cast("double").alias("at"), F.lit(0).alias("kind"), "s", F.lit(None).cast(xs.schema["x"].dataType).alias("x"))
    met = running(both.unionByName(xs.select(F.col("x").cast("double").alias("at"), F.lit(1).alias("kind"), "x"), allowMissingColumns=True), ["at", "kind"], lasts=("s",)).where("kind = 1")
    least = F.broadcast(spans.agg(F.min("s").alias("first")))  # one row
    s, x = F.coalesce("last_s", "first"), F.col("x")
    t = F.when(s["c2"].isNull() | (x < s["center"]), F.lit(0.0)).otherwise((x - s["center"]) / (s["c2"] - s["center"]))
    own, following = s["b0"] + s["b1"] * x, s["d0"] + s["d1"] * x
    return met.join(least).select("x", F.when(t == 0, own).otherwise(own * (1 - t) + following * t).alias("y"))


def argsort(df: DataFrame, value: str, key: str) -> DataFrame:
    """Each row's place in the order of ``value`` and ``key``, by :func:`numbered`."""
    return numbered(df, [value, key]).withColumnRenamed("gl_n", "pos")


def merge_indexes(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sorted union of two index lists (k, x), for each key: k, xs, at (the places in xs of a's indexes, in order), repeats (how many indexes both hold)."""
    sides = a.select("k", "x", F.lit(True).alias("first")).unionByName(b.select("k", "x", F.lit(False).alias("first"))).distinct()
    each = sides.groupBy("k", "x").agg(F.bool_or("first").alias("first"), F.count("*").alias("sides"))
    lists = each.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("x", "first"))).alias("l"), F.count(F.when(F.col("sides") == 2, 1)).alias("repeats"))
    places = F.filter(F.transform("l", lambda e, i: F.when(e["first"], i)), lambda i: i.isNotNull())
    return lists.select("k", F.col("l.x").alias("xs"), places.alias("at"), "repeats")


def append_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (k, x, y) of ``b`` put behind those of ``a`` (both with ``n``, the place in their list), as they come: k, x, y, n."""
    size = a.groupBy("k").agg(F.max("n").alias("top"))
    behind = b.join(size, "k", "left").select("k", "x", "y", (F.col("n") + F.coalesce(F.col("top") + 1, F.lit(0))).alias("n"))
    return a.select("k", "x", "y", "n").unionByName(behind)


def merge_pairs(a: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The sorted union of indexes ``a`` (k, x) and one ``side`` (x or y) of unsorted ``pairs`` (k, x, y): k, x, paired (the pair's other side, null where the index is a's alone)."""
    other = "y" if side == "x" else "x"
    taken = pairs.select("k", F.col(side).alias("x"), F.col(other).alias("paired"))
    return taken.unionByName(a.select("k", "x", F.lit(None).cast(pairs.schema[other].dataType).alias("paired"))).groupBy("k", "x").agg(F.min("paired").alias("paired"))

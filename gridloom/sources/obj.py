"""Wavefront OBJ text files: surfaces and tetrahedron soups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.reduce import running


def read(spark: SparkSession, path: str, first_object: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (n, x, y, z) and polygon corners (p, k, n, patch) of an OBJ file, zero-based.

    Faces may be ``a``, ``a//n`` or ``a/t/n``; a negative index counts back from
    the last vertex before the face. A polygon's patch is the smoothing group
    in force at its line (null: none yet). Numbers follow the file's order.
    ``first_object`` stops at the first vertex after a face, where the next
    object begins.
    """
    # the order of a folder's files is that of their names
    at = F.concat_ws("|", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    lines = spark.read.text(path).select(F.trim("value").alias("t"), at.alias("at")).where(F.col("t").rlike(r"^[vfs]\s"))
    kinds = lines.select("at", F.substring("t", 1, 1).alias("kind"), F.split("t", r"\s+").alias("p"))
    one = lambda kind: F.when(F.col("kind") == kind, 1).otherwise(0)
    laid = running(kinds.withColumns({"v": one("v"), "f": one("f"), "s": F.when(F.col("kind") == "s", F.col("p")[1])}), ["at"], sums=("v", "f"), lasts=("s",))
    if first_object:
        end = laid.where("kind = 'v' and sum_f > 0").agg(F.min("gl_n")).first()[0]
        laid = laid if end is None else laid.where(F.col("gl_n") < end)
    nodes = laid.where("kind = 'v'").select((F.col("sum_v") - 1).cast("bigint").alias("n"), *[F.col("p")[k + 1].cast("double").alias(c) for k, c in enumerate("xyz")])
    faces = laid.where("kind = 'f'").select((F.col("sum_f") - 1).cast("bigint").alias("p"), "sum_v", F.posexplode(F.expr("slice(p, 2, size(p) - 1)")).alias("k", "c"), F.col("last_s").alias("patch"))
    index = F.substring_index("c", "/", 1).cast("bigint")
    return nodes, faces.select("p", "k", F.when(index < 0, F.col("sum_v") + index).otherwise(index - 1).alias("n"), "patch")


def tetrahedra_of_soup(corners: DataFrame) -> DataFrame:
    """(e, n0..n3) of a soup whose tetrahedra are runs of four triangles over four nodes of their own."""
    runs = corners.groupBy(F.floor(F.col("p") / 4).cast("bigint").alias("e")).agg(F.array_sort(F.collect_set("n")).alias("ns")).where(F.size("ns") == 4)
    return runs.select("e", *[F.col("ns")[k].alias(f"n{k}") for k in range(4)])


def tetrahedra_of_faces(corners: DataFrame) -> DataFrame:
    """(e, n0..n3) of a soup whose faces come in any order; e: the least node.

    Tetrahedra have four nodes of their own, so every node is on a face with
    its tetrahedron's least one: two sums by key, no search. What does not
    come to four nodes is left out.
    """
    faces = corners.groupBy("p").agg(F.min("n").alias("least"), F.collect_list("n").alias("ns"))
    own = faces.select(F.explode("ns").alias("n"), "least").groupBy("n").agg(F.min("least").alias("e"))
    met = own.groupBy("e").agg(F.sort_array(F.collect_list("n")).alias("ns")).where(F.size("ns") == 4)
    return met.select("e", *[F.get("ns", F.lit(k)).alias(f"n{k}") for k in range(4)])


def write_tetrahedra(tets: DataFrame, path: str) -> None:
    """Write tetrahedra (e, x0..z3) as OBJ text: per element four vertices, then four faces that count back from the last vertex."""
    corner = lambda k: F.concat_ws(" ", F.lit("v "), *[F.col(f"{c}{k}").cast("string") for c in "xyz"])
    faces = ["f -4 -3 -2", "f -4 -1 -3", "f -4 -2 -1", "f -3 -1 -2"]
    lines = tets.select("e", F.posexplode(F.array(*[corner(k) for k in range(4)], *[F.lit(f) for f in faces])).alias("k", "value"))
    parts = int(tets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "e").sortWithinPartitions("e", "k").select("value").write.mode("overwrite").text(path)


def lines_of(nodes: DataFrame, corners: DataFrame) -> DataFrame:
    """The lines (ord, value) of a surface as OBJ text: vertices by number, then faces."""
    v = nodes.select(F.struct(F.lit(0).alias("s"), F.col("n").alias("n")).alias("ord"), F.concat_ws(" ", F.lit("v "), *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    f = corners.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("c"))
    f = f.select(F.struct(F.lit(1).alias("s"), F.col("p").alias("n")).alias("ord"), F.concat(F.lit("f "), F.array_join(F.transform("c", lambda c: (c["n"] + 1).cast("string")), " ")).alias("value"))
    return v.unionAll(f)

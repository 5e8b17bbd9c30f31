"""MatrixMarket text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.elementwise import drop_zeros


def read(spark: SparkSession, path: str, expand: bool = True, threshold: bool = True) -> tuple[DataFrame, tuple[int, int, bool]]:
    """Cells (i, j, v, iv) of a coordinate or array file, and its shape (m, n, complex).

    Lines are parsed by expressions, wherever they lie; only the banner and
    the size line come to the driver. A symmetric, skew-symmetric or hermitian
    banner adds the cells across the diagonal (``expand``); ``pattern`` cells are 1.
    ``threshold`` drops cells that count as zero. Indices are zero-based.
    """
    # the order of a folder's files is that of their names
    lines = spark.read.text(path).select(F.trim("value").alias("t"), F.concat_ws("|", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")).alias("at"))
    banner = (lines.where(F.col("t").startswith("%%MatrixMarket")).select(F.lower("t").alias("t")).first() or {"t": "%%matrixmarket matrix coordinate real general"})["t"].split()
    body = lines.where(~F.col("t").startswith("%") & (F.col("t") != ""))
    head = body.orderBy("at").first()
    if head is None:
        raise ValueError("a MatrixMarket file needs a size line")
    size = [int(x) for x in head["t"].split()]
    m, n, kind, shape = size[0], size[1], banner[3], banner[4]
    cells = body.where(F.col("at") != head["at"]).select(F.split("t", r"\s+").alias("p"), "at")
    num = lambda k: F.get("p", F.lit(k)).cast("double")
    if banner[2] == "array":
        from gridloom.operators.reduce import numbered

        own = numbered(cells, ["at"])
        if shape == "general":
            i, j = F.col("gl_n") % m, F.floor(F.col("gl_n") / m).cast("bigint")
        else:
            raise ValueError("array files are read if general")
        out = own.select(i.alias("i"), j.alias("j"), num(0).alias("v"), (num(1) if kind == "complex" else F.lit(0.0)).alias("iv"))
    else:
        v = F.lit(1.0) if kind == "pattern" else num(2)
        iv = F.coalesce(num(3), F.lit(0.0)) if kind == "complex" else F.lit(0.0)
        out = cells.select((F.get("p", F.lit(0)).cast("bigint") - 1).alias("i"), (F.get("p", F.lit(1)).cast("bigint") - 1).alias("j"), v.alias("v"), iv.alias("iv"))
    if expand and shape != "general":
        re, im = {"symmetric": (1, 1), "skew-symmetric": (-1, -1), "hermitian": (1, -1)}[shape]
        across = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("v") * re).alias("v"), (F.col("iv") * im).alias("iv"))
        here = F.struct("i", "j", "v", "iv")
        out = out.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, across))).alias("c")).select("c.*")
    return (drop_zeros(out) if threshold else out), (m, n, kind == "complex")


def write(m: DataFrame, shape: tuple[int, int], path: str) -> None:
    """Write cells (i, j, v) as a general real coordinate file: a folder of parts, of which the first holds banner and sizes."""
    count = m.count()
    spark = m.sparkSession
    head = spark.createDataFrame([(-1, 0, "%%MatrixMarket matrix coordinate real general"), (-1, 1, f"{shape[0]} {shape[1]} {count}")], "j long, i long, value string")
    body = m.select("j", "i", F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("v").cast("string")).alias("value"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head.unionAll(body).repartitionByRange(parts, "j", "i").sortWithinPartitions("j", "i").select("value").write.mode("overwrite").text(path)

"""Removal of lines that many sites share."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import columns, materialise, unused

#: A line is boilerplate when at least so many distinct sites hold it.
MIN_SITES = 3
#: log2 of the registers of a HyperLogLog sketch.
LOG_REGISTERS = 10


def line_spread(lines: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """Lines (``h1``, ``h2``) that at least ``min_sites`` sites hold, with their first place.

    ``lines``: h1, h2, site, doc_id, th, pos, one row for each line. A
    HyperLogLog sketch of the sites is merged for each line by partial and
    final aggregation, so a very frequent line costs one sketch for each task.
    Lines whose estimate is within four standard errors (one site at least)
    of the threshold get an exact distinct count.
    """
    band = max(1.0, 4 * 1.04 / math.sqrt(1 << log_registers) * min_sites)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", log_registers).alias("sketch"),
        F.min(F.struct("doc_id", "th", "pos")).alias("first"),
    )
    spread = materialise(spread.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites - band))
    sure = spread.where(F.col("estimate") > min_sites + band).select("h1", "h2", "first")
    near = spread.where(F.col("estimate") <= min_sites + band)
    exact = (
        lines.select("h1", "h2", "site").distinct().join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sure.unionAll(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, log_registers: int = LOG_REGISTERS) -> DataFrame:
    r"""Remove the lines of ``text`` that at least ``min_sites`` values of ``source`` share.

    The first of the equal lines, by doc_id (null first), text hash and
    position, stays in its document; all others go. Lines are parted by
    ``\n`` and compared byte for byte; lines of white space alone stay.

    Defined cases: a null text stays null and counts no line; an empty text
    is one blank line; a document may end with an empty text; a null source
    is a site of its own; rows that agree in doc_id and text get the same
    decision; an empty table gives an empty table; further columns pass
    through, whatever their names.

    Returns the columns of ``docs`` with the new text, and ``gl_lines`` and
    ``gl_removed``, the lines that the text had and those that went (with
    underscores after them where ``docs`` has such columns).
    """
    line = F.col("line")
    lines = materialise(
        docs.select("doc_id", F.xxhash64("text").alias("th"), F.xxhash64(F.col("source").isNull(), F.col("source")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(line.rlike(r"[^\x20\x09-\x0D]"))
        .select("doc_id", "th", "pos", "site", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))
    )
    shared = materialise(line_spread(lines, min_sites, log_registers))
    gone = (
        lines.join(shared, ["h1", "h2"]).select("doc_id", "th", "pos", "first")
        .where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))
    ).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone")
    parts, away = F.col("parts"), F.col("gone")
    count = F.size(parts)
    # the split runs below the join, once a row; array_except hashes: both stay linear for very long texts
    # a row is one column, so that no name of docs meets a working one
    rest = [c for n, c in zip(docs.columns, columns(docs), strict=True) if n.lower() != "text"]
    cut = docs.select(F.struct(*rest).alias("row"), F.xxhash64("text").alias("key"), F.split("text", "\n", -1).alias("parts"))
    joined = cut.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_th")), "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), count - 1), away), lambda i: F.get(parts, i))
    text = F.array_join(F.when(away.isNull(), parts).otherwise(kept), "\n")
    return joined.select(
        *[(text if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns],
        F.coalesce(F.when(parts.isNotNull(), count), F.lit(0)).cast("long").alias(unused(docs, "gl_lines")),
        F.coalesce(F.when(away.isNotNull(), F.size(away)), F.lit(0)).cast("long").alias(unused(docs, "gl_removed")),
    )

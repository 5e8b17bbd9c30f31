"""Driver-run loops whose rounds end as stored tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session on one machine may go without and gets its own."""
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(place)
    return place


def stored(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed_point(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 200) -> DataFrame:
    """Apply ``step`` until the rows rest, told by their count and the sum of their hashes."""
    mark = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64(*t.columns).cast("decimal(38,0)"))).first()
    now = stored(start)
    was = mark(now)
    for _ in range(max_rounds):
        now = stored(step(now))
        new = mark(now)
        if new == was:
            return now
        was = new
    raise RuntimeError(f"no rest after {max_rounds} rounds")

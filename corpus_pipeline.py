"""The corpus pipeline: documents through five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, mixing, pieces, simhash, toxicity
from gridloom.llm.common import columns, materialise
from gridloom.llm.queries import PIECE_MODEL


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.

    A null, empty or wordless text scores as the bias and stays; repeated rows
    are judged alike; no row of ``labels`` rejects nothing; an empty table stays
    empty; further columns pass through, whatever their names.
    """
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share (n_chars follows the text).

    A null text stays null, with a null n_chars; a text may become empty;
    repeated rows stay alike; an empty table stays empty; further columns pass
    through, whatever their names.
    """
    out = line_dedup.dedup_lines(docs)
    kinds = dict(docs.dtypes)
    return out.select(*[F.length("text").cast(kinds[n]).alias(n) if n == "n_chars" else c for n, c in zip(docs.columns, columns(docs), strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Null, empty and blank texts are one group; repeated rows leave one; an
    empty table stays empty; further columns pass through, whatever their names.
    """
    return simhash.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null, empty or blank text goes; a null source is a source of its own; an
    empty table stays empty; further columns pass through, whatever their names.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: doc_id, source, n_ids, ids.

    A null text has null ids, an empty one none; each row gives one; an empty
    table gives an empty table; further columns go.
    """
    return pieces.encode(docs, PIECE_MODEL, ("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialise(docs)
    return docs

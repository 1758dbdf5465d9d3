"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import common
from treeline.llm.line_dedup import deduplicated
from treeline.llm.mixing import mix
from treeline.llm.near_dedup import near_duplicates
from treeline.llm.packing import pack
from treeline.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, common.read(spark, sf_dir, "labels", "doc_id", "quality"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, rows without an id or of one id included."""
    (row,) = common.unused(docs, "row")
    rows = common.with_rows(docs, row)
    (gone,) = common.unused(rows, "gone")
    found = near_duplicates(rows, row).where("not kept").select(F.col(row).alias(gone))
    found = common.few(common.materialize(found))
    return rows.join(found, F.col(row) == F.col(gone), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole and in part, towards their sources' target weights."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def fresh(stage: Stage) -> Stage:
    """``stage``, begun without the garbage that the stages before have left on the executors."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.free_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("quality", fresh(quality)),
    ("line_dedup", fresh(lines)),
    ("near_dedup", fresh(near_dedup)),
    ("mixing", fresh(mixture)),
    ("packing", fresh(packing)),
]

#: The classifier and Karmarkar-Karp have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each stage's rows are materialised in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

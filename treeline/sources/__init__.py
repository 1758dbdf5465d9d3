"""Documents as DataFrames: JSON and YAML files, one document per file or per line, rows of tables, Python objects."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc): each file one document; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("doc"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc): each line one document, identified by a hash of its text."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("doc"))


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for b in batches:
        yield b.assign(doc=[json.dumps(yaml.safe_load(t), default=str) for t in b["doc"]])


def yaml_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, doc): each YAML file one document, as JSON text."""
    return json_files(spark, path).mapInPandas(_to_json, "doc_id string, doc string")


def objects(spark: SparkSession, documents: Iterable[tuple[object, object]]) -> DataFrame:
    """(doc_id, doc) of (id, Python object) pairs."""
    return spark.createDataFrame([(str(i), json.dumps(d)) for i, d in documents], "doc_id string, doc string")


def rows_as_documents(table: DataFrame, id_col: str, member: str) -> DataFrame:
    """(doc_id, doc): each row one document {member: {column: value}}; null columns are absent members."""
    return table.select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.struct(*table.columns).alias(member))).alias("doc"))


def shredded(docs: DataFrame, paths: dict[str, str], id_col: str = "doc_id", text_col: str = "doc") -> DataFrame:
    """Leaves of JSON texts as columns, {name: "$.path type"}, through variants: one parse, no Python."""
    parsed = docs.select(id_col, F.try_parse_json(text_col).alias("v"))
    taken = [F.try_variant_get("v", p.split()[0], p.split()[1]).alias(name) for name, p in paths.items()]
    return parsed.select(id_col, *taken)


def entries(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "doc") -> DataFrame:
    """(id, position, entry variant): a list in each document, one row per entry."""
    parsed = docs.select(F.col(id_col).alias("id"), F.try_variant_get(F.try_parse_json(text_col), path, "array<variant>").alias("list"))
    return parsed.select(F.col("id").alias(id_col), F.posexplode("list").alias("position", "entry"))

"""The rules' relational shapes: anti joins, groupings and windows. Spark picks the join strategy from sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breaking(rows: DataFrame, holds: Column) -> DataFrame:
    """Rows of which a condition is false; unknown counts as not applicable."""
    return rows.where(~holds)


def orphans(rows: DataFrame, columns: Sequence[str], target: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Rows whose reference finds no target: a left anti join. Null references refer to nothing and pass."""
    on = [rows[c] == target[t] for c, t in zip(columns, target_columns, strict=True)]
    some = rows.where(F.coalesce(*[rows[c].cast("string") for c in columns]).isNotNull())
    return some.join(target.select(*target_columns).distinct() if len(target_columns) > 1 else target, on, "left_anti")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, entries) of keys that occur more than once, nulls equal; counted within tasks first."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def first_duplicate(rows: DataFrame, scope: Sequence[str], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per scope the first pair of entries that share a key: (scope, first, second), positions from 0."""
    position = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1
    turn = F.row_number().over(Window.partitionBy(*scope, *keys).orderBy("position__"))
    # the first two entries of a key are all that is kept of it
    two = rows.withColumn("position__", position).withColumn("turn__", turn).where("turn__ <= 2")
    pairs = two.groupBy(*scope, *keys).agg(F.min("position__").alias("first"), F.max("position__").alias("second"), F.max("turn__").alias("turns"))
    return pairs.where("turns = 2").groupBy(*scope).agg(F.min(F.struct("second", "first")).alias("p")).select(*scope, "p.first", "p.second")


def childless(parents: DataFrame, keys: Sequence[str], children: DataFrame, child_keys: Sequence[str]) -> DataFrame:
    """Parents without any child, with 0 as ``entries``: an anti join."""
    there = children.select(*[F.col(c).alias(f"{c}__key") for c in child_keys])
    on = [F.col(k) == F.col(f"{c}__key") for k, c in zip(keys, child_keys, strict=True)]
    return parents.join(there, on, "left_anti").withColumn("entries", F.lit(0).cast("long"))


def counted(parents: DataFrame, keys: Sequence[str], children: DataFrame, child_keys: Sequence[str], what: Column | None = None, name: str = "entries") -> DataFrame:
    """Parents with the number of their children (of which ``what`` holds). Children are counted before the join."""
    counts = children.groupBy(*child_keys).agg(F.count(F.lit(1) if what is None else F.when(what, 1)).alias(name))
    counts = counts.select(*[F.col(c).alias(f"{c}__key") for c in child_keys], name)
    on = [F.col(k) == F.col(f"{c}__key") for k, c in zip(keys, child_keys, strict=True)]
    joined = parents.join(counts, on, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(0))).drop(*[f"{c}__key" for c in child_keys])


def nth(rows: DataFrame, scope: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n-th entry (from 1) of each scope; ``order`` must be total for a fixed result."""
    if n == 1:
        # the least entry combines within tasks; nothing is sorted
        rest = [c for c in rows.columns if c not in {*scope, *order}]
        least = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
        found = rows.groupBy(*scope).agg(F.min(F.struct(*order)).alias("order__"), least.alias("rest__"))
        taken = {**{c: F.col(f"rest__.{c}") for c in rest}, **{c: F.col(f"order__.{c}") for c in order}, **{c: F.col(c) for c in scope}}
        return found.select(*[taken[c].alias(c) for c in rows.columns])
    position = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("position__", position).where(F.col("position__") == n).drop("position__")


def referenced(rows: DataFrame, column: str, target: DataFrame, target_column: str, take: Sequence[str], prefix: str) -> DataFrame:
    """Rows with columns of the entry their reference finds (null if none), renamed with ``prefix``."""
    there = target.select(F.col(target_column).alias(f"{prefix}key__"), *[F.col(c).alias(f"{prefix}{c}") for c in take])
    return rows.join(there, F.col(column) == F.col(f"{prefix}key__"), "left").drop(f"{prefix}key__")


def more_than_one(rows: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """Rows in which several cases of a choice hold."""
    held = sum((F.coalesce(c, F.lit(False)).cast("int") for c in cases.values()), F.lit(0))
    return rows.where(held > 1)


def valid_summary(rows: DataFrame, id_columns: Sequence[str], found: DataFrame) -> DataFrame:
    """(valid, invalid): how many entries have no violation and how many have one."""
    bad = found.select(*id_columns).distinct()
    counts = rows.select(*id_columns).distinct().join(bad.withColumn("bad__", F.lit(1)), list(id_columns), "left")
    return counts.agg(F.count(F.when(F.col("bad__").isNull(), 1)).alias("valid"), F.count("bad__").alias("invalid"))

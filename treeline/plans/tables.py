"""Checks of tables: a schema's lists bound to tables, every rule a DataFrame query.

Each list of the module's top level is a table of the same name, each leaf one of
its columns. References between lists are leafrefs of the form ``/list/leaf``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.errors import SchemaError
from treeline.functions.columns import valid
from treeline.operators import rules
from treeline.schema.identities import Identities
from treeline.schema.model import Module, Node
from treeline.xpath.columns import Compiler, Relation, violating


class TablePlan:
    """A module over tables. ``children`` names lists below lists: {parent: {child: [(parent column, child column)]}}."""

    def __init__(self, module: Module, tables: dict[str, DataFrame], children: dict[str, dict[str, list[tuple[str, str]]]] | None = None):
        self.module, self.identities = module, Identities(module)
        self.lists = {c.name: c for c in module.root.children if c.kind == "list"}
        self.relations = {name: Relation(tables[name]) for name in self.lists}
        for parent, below in (children or {}).items():
            for child, keys in below.items():
                self.relations[parent].children[child] = (self.relations[child], keys)
        for name, node in self.lists.items():
            for leaf in node.children:
                if leaf.type and leaf.type.name == "leafref":
                    _, table, column = leaf.type.path.split("/")
                    self.relations[name].references[leaf.name] = (self.relations[table], column)

    def _leaf(self, table: str, leaf: str) -> Node:
        found = self.lists[table].find(leaf)
        if found is None:
            raise SchemaError(f"list {table!r} has no leaf {leaf!r}")
        return found

    def type_violations(self, table: str, leaf: str) -> DataFrame:
        """Rows whose leaf does not have its type."""
        rows, node = self.relations[table].rows, self._leaf(table, leaf)
        if node.type.name == "leafref":
            target, column = self.relations[table].references[leaf]
            return rules.orphans(rows, [leaf], target.rows, [column])
        return rules.breaking(rows, self._valid(table, node))

    def _valid(self, table: str, leaf: Node) -> Column:
        kind = dict(self.relations[table].rows.dtypes)[leaf.name]
        return valid(F.col(leaf.name), leaf.type, self.identities, kind=kind)

    def key_violations(self, table: str) -> DataFrame:
        return rules.duplicate_keys(self.relations[table].rows, self.lists[table].keys)

    def must_violations(self, table: str, leaf: str | None = None) -> DataFrame:
        """Rows of which some must of the list (or of a leaf) does not hold."""
        node = self._leaf(table, leaf) if leaf else self.lists[table]
        found = [violating(self.relations[table], m.expression, leaf) for m in node.musts]
        return reduce(DataFrame.unionAll, found) if len(found) != 1 else found[0]

    def when_violations(self, table: str, leaf: str) -> DataFrame:
        """Rows in which a leaf is present although its when does not hold."""
        node = self._leaf(table, leaf)
        gone = [violating(self.relations[table], w.expression, leaf) for w in node.whens]
        return reduce(DataFrame.unionAll, gone).where(F.col(leaf).isNotNull())

    def holding(self, table: str, expression: str) -> DataFrame:
        """Rows of which an expression holds."""
        c = Compiler(self.relations[table])
        rows, holds = c.holds(expression)
        return rows.where(holds).select(*self.relations[table].rows.columns)

    def missing_mandatory(self, table: str, leaf: str) -> DataFrame:
        return self.relations[table].rows.where(F.col(leaf).isNull())

    def element_violations(self, parent: str, child: str, least: int | None = None, most: int | None = None) -> DataFrame:
        """(parent rows, entries) with too few or too many entries of a child list."""
        below, keys = self.relations[parent].children[child]
        if least == 1 and most is None:
            # none at all: no entry has to be counted
            return rules.childless(self.relations[parent].rows, [p for p, _ in keys], below.rows, [c for _, c in keys])
        counts = rules.counted(self.relations[parent].rows, [p for p, _ in keys], below.rows, [c for _, c in keys])
        low = F.col("entries") < least if least is not None else F.lit(False)
        high = F.col("entries") > most if most is not None else F.lit(False)
        return counts.where(low | high)

    def all_types(self, table: str) -> DataFrame:
        """Every leaf's type in one pass: rows with the names of the leaves that break theirs."""
        rows = self.relations[table].rows
        checks = [
            F.when(~self._valid(table, leaf), F.lit(leaf.name))
            for leaf in self.lists[table].children
            if leaf.type and leaf.type.name not in ("leafref", "instance-identifier")
        ]
        return rows.withColumn("broken", F.array_compact(F.array(*checks))).where(F.size("broken") > 0)

    def violations(self) -> DataFrame:
        """Every rule of the module over its tables: (table, key, rule, leaf), a row for each rule that an entry breaks.

        ``key`` is the entry's key leaves as text, in the schema's order. Types and
        mandatory leaves of a list are one pass over its table; keys, references,
        musts, whens and element counts are a query each.
        """
        found = []
        for table, node in self.lists.items():
            rows = self.relations[table].rows
            columns = {c.name for c in node.children if c.name in rows.columns}
            key = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in node.keys])
            report = lambda df, rule, leaf=None, key=key, table=table: df.select(
                F.lit(table).alias("table"), key.alias("key"), F.lit(rule).alias("rule"), (F.lit(leaf) if not isinstance(leaf, Column) else leaf).cast("string").alias("leaf")
            )
            leaves = [c for c in node.children if c.name in columns]
            found.append(report(self.all_types(table).withColumn("leaf__", F.explode("broken")), "type", F.col("leaf__")))
            required = [c for c in leaves if c.mandatory or c.name in node.keys]
            absent = F.array_compact(F.array(*[F.when(F.col(c.name).isNull(), F.lit(c.name)) for c in required])) if required else None
            if absent is not None:
                found.append(report(rows.withColumn("leaf__", F.explode(absent)), "mandatory", F.col("leaf__")))
            if node.keys:
                found.append(report(self.key_violations(table), "key"))
            for leaf in leaves:
                if leaf.type and leaf.type.name == "leafref":
                    found.append(report(self.type_violations(table, leaf.name), "type", leaf.name))
                if leaf.musts:
                    found.append(report(self.must_violations(table, leaf.name).where(F.col(leaf.name).isNotNull()), "must", leaf.name))
                if leaf.whens:
                    found.append(report(self.when_violations(table, leaf.name), "when", leaf.name))
            if node.musts:
                found.append(report(self.must_violations(table), "must"))
        return reduce(DataFrame.unionAll, found)

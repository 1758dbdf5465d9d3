"""Expressions compiled to columns and joins over tables read as lists.

A relation is a table whose rows are list entries. Leaves of an entry are its
columns, lists below it are child relations joined on keys, a leafref is a
relation to look up. An expression over an entry becomes a column of the entry's
table, to which the counts of child entries and the referenced columns have been
joined: children are filtered and aggregated before the join, so every entry
stays exactly one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeline.errors import XPathError
from treeline.xpath.parser import Binary, Call, Literal, Path, Values, parse


@dataclass
class Relation:
    """A table as a list: child lists by name with (parent column, child column) pairs, references by leaf.

    ``order`` names the columns that put the entries of a parent in order; without
    it they have no positions.
    """

    rows: DataFrame
    children: dict[str, tuple[Relation, list[tuple[str, str]]]] = field(default_factory=dict)
    references: dict[str, tuple[Relation, str]] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)


@dataclass
class Value:
    """A scalar column; null is an empty node-set. ``kind`` is number, boolean, text or node (of unknown type)."""

    column: Column
    kind: str
    constant: bool = False


def _sort(kind: str) -> str:
    """How values of a column type compare."""
    if kind in ("boolean",) or kind.startswith(("timestamp", "date")):
        return "boolean" if kind == "boolean" else "time"
    return "number" if kind.startswith(("int", "bigint", "small", "tiny", "double", "float", "decimal")) else "text"


@dataclass
class Entries:
    """Child entries that pass a condition, and the leaf taken from each (None: the entries themselves)."""

    name: str
    condition: Column | None
    leaf: str | None


class Compiler:
    """Compiles expressions over a relation's entries (or one leaf of them)."""

    def __init__(self, relation: Relation, leaf: str | None = None):
        self.relation, self.leaf = relation, leaf
        self.rows = relation.rows
        self.kinds = dict(relation.rows.dtypes)
        self.made = 0

    def holds(self, expression: str) -> tuple[DataFrame, Column]:
        """(rows with what was joined, condition that is never null)."""
        condition = self.truth(self.value(parse(expression)))
        return self.rows, condition

    # values -----------------------------------------------------------------

    def _leaf(self, name: str) -> Value:
        if name not in self.kinds:
            raise XPathError(f"no leaf {name!r}")
        return Value(F.col(name), _sort(self.kinds[name]))

    def value(self, tree):
        if isinstance(tree, Literal):
            kind = "boolean" if isinstance(tree.value, bool) else "number" if isinstance(tree.value, (int, float)) else "text"
            return Value(F.lit(tree.value), kind, True)
        if isinstance(tree, Values):
            return tree
        if isinstance(tree, Path):
            return self._path(tree)
        if isinstance(tree, Call):
            return self._call(tree)
        return self._binary(tree)

    def _steps(self, path: Path) -> list:
        """The steps from the entry: ``..`` before a leaf of a leaf's context leads back to the entry."""
        steps = [s for s in path.steps if s.name != "." or s.predicate is not None]
        if self.leaf:
            if not steps:
                return [self.leaf]
            if steps[0].name != "..":
                raise XPathError("a leaf has no children")
            steps = steps[1:]
        return steps

    def _path(self, path: Path):
        if path.absolute:
            raise XPathError("absolute paths are not compiled to columns; check such rules on documents")
        steps = self._steps(path)
        if len(steps) == 1 and isinstance(steps[0], str):
            return self._leaf(steps[0])
        head = steps[0]
        if head.name in self.relation.children and len(steps) <= 2:
            child, keys = self.relation.children[head.name]
            condition = None
            if head.predicate is not None:
                inner = Compiler(child)
                found = inner.value(head.predicate)
                if isinstance(found, Value) and found.kind == "number":
                    if not child.order:
                        raise XPathError(f"entries of {head.name!r} have no order, so no positions")
                    at = Window.partitionBy(*[c for _, c in keys]).orderBy(*child.order)
                    condition = F.row_number().over(at) == F.floor(found.column)
                else:
                    condition = inner.truth(found)
                if inner.rows is not child.rows:
                    raise XPathError("a predicate over joined rows is not compiled to columns")
            return Entries(head.name, condition, steps[1].name if len(steps) == 2 else None)
        if len(steps) != 1 or head.predicate is not None or head.name == "..":
            raise XPathError(f"path {path} is not compiled to columns")
        return self._leaf(head.name)

    def _looked_up(self, call: Call, rest: Path) -> Value:
        """deref(leaf)/../other, and further derefs inside: left joins through the references."""
        chain, inner = [rest.steps[-1].name], call.args[0]
        while isinstance(inner, Binary) and inner.op == "/":
            chain.append(inner.right.steps[-1].name)
            inner = inner.left.args[0]
        start = self._steps(inner)
        leaf = start[0] if isinstance(start[0], str) else start[0].name
        relation, column = self.relation, leaf
        for take in reversed(chain):
            target, key = relation.references[leaf]
            self.made += 1
            prefix = f"ref{self.made}__"
            there = target.rows.select(F.col(key).alias(f"{prefix}key"), F.col(take).alias(f"{prefix}value"))
            self.rows = self.rows.join(there, F.col(column) == F.col(f"{prefix}key"), "left").drop(f"{prefix}key")
            relation, leaf, column = target, take, f"{prefix}value"
        kind = dict(relation.rows.dtypes)[leaf]
        return Value(F.col(column), "text" if kind == "string" else "number")

    def _count(self, e: Entries, test=None, outer: bool = False) -> Column:
        """How many entries of a child list pass; counted before the join, or after it if the test reads this entry too."""
        child, keys = self.relation.children[e.name]
        self.made += 1
        name = f"set{self.made}__"
        passing = F.lit(True)
        if e.condition is not None:
            passing = passing & e.condition
        renamed = child.rows.select(*[F.col(c).alias(f"{name}k{i}") for i, (_, c) in enumerate(keys)], passing.alias(f"{name}p"), *([F.col(e.leaf).alias(f"{name}v")] if e.leaf else []))
        on = [F.col(p) == F.col(f"{name}k{i}") for i, (p, _) in enumerate(keys)]
        key_columns = [f"{name}k{i}" for i in range(len(keys))]
        if outer:
            parents = self.rows.select(*[p for p, _ in keys], *[c for c in self.rows.columns if c not in {p for p, _ in keys}])
            joined = parents.join(renamed, on).where(F.col(f"{name}p") & test(F.col(f"{name}v")))
        else:
            joined = renamed.where(F.col(f"{name}p") & test(F.col(f"{name}v")) if test else F.col(f"{name}p"))
        counts = joined.groupBy(*key_columns).agg(F.count(F.lit(1)).alias(name))
        self.rows = self.rows.join(counts, on, "left").drop(*key_columns)
        return F.coalesce(F.col(name), F.lit(0))

    def _ends(self, e: Entries) -> dict[str, Column]:
        """The least and the greatest value of the entries that pass; null if there are none."""
        child, keys = self.relation.children[e.name]
        self.made += 1
        name = f"set{self.made}__"
        passing = child.rows.select(*[F.col(c).alias(f"{name}k{i}") for i, (_, c) in enumerate(keys)], F.col(e.leaf).alias(f"{name}v"), (F.lit(True) if e.condition is None else e.condition).alias(f"{name}p"))
        key_columns = [f"{name}k{i}" for i in range(len(keys))]
        ends = passing.where(f"{name}p").groupBy(*key_columns).agg(F.min(f"{name}v").alias(f"{name}least"), F.max(f"{name}v").alias(f"{name}most"))
        on = [F.col(p) == F.col(k) for (p, _), k in zip(keys, key_columns, strict=True)]
        self.rows = self.rows.join(ends, on, "left").drop(*key_columns)
        return {k: F.col(f"{name}{k}") for k in ("least", "most")}

    # functions and operators -----------------------------------------------

    def truth(self, v) -> Column:
        if isinstance(v, Entries):
            return self._count(v) > 0
        if v.kind == "boolean":
            return F.coalesce(v.column, F.lit(False))
        if v.kind == "number":
            return F.coalesce(v.column != 0, F.lit(False))
        return F.coalesce(v.column != "", F.lit(False))

    def _text(self, v: Value) -> Column:
        text = v.column.cast("string")
        # booleans are spelt as documents spell them
        return F.coalesce(F.initcap(text) if v.kind == "boolean" else text, F.lit(""))

    def _number(self, v: Value) -> Column:
        return F.coalesce(v.column.cast("string").try_cast("double") if v.kind == "text" else v.column.cast("double"), F.lit(float("nan")))

    def _call(self, c: Call):
        args = [a if isinstance(a, Path) and c.name == "deref" else self.value(a) for a in c.args]
        match c.name:
            case "not":
                return Value(~self.truth(args[0]), "boolean")
            case "true" | "false":
                return Value(F.lit(c.name == "true"), "boolean")
            case "boolean":
                return Value(self.truth(args[0]), "boolean")
            case "count":
                return Value(self._count(args[0]) if isinstance(args[0], Entries) else args[0].column.isNotNull().cast("int"), "number")
            case "string":
                return Value(self._text(args[0]), "text")
            case "number":
                return Value(self._number(args[0]), "number")
            case "string-length":
                return Value(F.char_length(self._text(args[0])), "number")
            case "concat":
                return Value(F.concat(*map(self._text, args)), "text")
            case "translate":
                # quotes around the characters go; of a repeated character the last place counts
                source, target = (c.args[i].value.strip("'\"") for i in (1, 2))
                last = {ch: i for i, ch in enumerate(source)}
                order = sorted(last, key=lambda ch: (last[ch] >= len(target), last[ch]))
                return Value(F.translate(self._text(args[0]), "".join(order), "".join(target[last[ch]] for ch in order if last[ch] < len(target))), "text")
            case "current" if self.leaf:
                return self._leaf(self.leaf)
            case "deref" | "derived-from" | "derived-from-or-self" | "current":
                raise XPathError(f"{c.name}() is not compiled to columns")
        return Value(F.lit(None).cast("string"), "text")  # an unknown function has no value, so it fails

    def _binary(self, b: Binary):
        if b.op in ("or", "and"):
            left, right = self.truth(self.value(b.left)), self.truth(self.value(b.right))
            return Value(left | right if b.op == "or" else left & right, "boolean")
        if b.op == "/":
            if isinstance(b.left, Call) and b.left.name == "deref":
                return self._looked_up(b.left, b.right)
            raise XPathError("only deref() may be followed by a path")
        left, right = self.value(b.left), self.value(b.right)
        if b.op in "+-*":
            x, y = self._number(left), self._number(right)
            return Value(x + y if b.op == "+" else x - y if b.op == "-" else x * y, "number")
        if b.op == "!=":
            return Value(~self._compare("=", left, right), "boolean")
        return Value(self._compare(b.op, left, right), "boolean")

    def _compare(self, op: str, left, right) -> Column:
        if isinstance(right, Entries):
            left, right, op = right, left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if isinstance(left, Entries):
            kind = dict(self.relation.children[left.name][0].rows.dtypes)[left.leaf]
            sort = _sort(kind)
            constant = isinstance(right, Values) or right.constant
            if constant:
                return self._count(left, lambda v: self._pair(op, Value(v, sort), right)) > 0
            if op != "=" and sort == right.kind and sort in ("number", "time"):
                # some entry is below a value if the least one is: one aggregation, and no entry is joined
                ends = self._ends(left)
                some = {"<": "least", "<=": "least", ">": "most", ">=": "most"}[op]
                found = F.coalesce(_OPS[op](ends[some], right.column), F.lit(False))
                empty = ends["least"].isNull()
            else:
                found = self._count(left, lambda v: self._pair(op, Value(v, sort), right), outer=True) > 0
                empty = self._ends(left)["least"].isNull() if op in ("=", "<=", ">=") else F.lit(False)
            # two empty sides are equal
            return found | (empty & right.column.isNull()) if op in ("=", "<=", ">=") else found
        if isinstance(right, Values):
            return F.coalesce(left.column.isin(list(right.items)), F.lit(False))
        both = left.column.isNull() & right.column.isNull()
        return F.coalesce(self._pair(op, left, right), both & F.lit(op in ("=", "<=", ">=")))

    def _pair(self, op: str, a, b) -> Column:
        if isinstance(b, Values):
            return a.column.isin(list(b.items))
        if "boolean" in (a.kind, b.kind):
            x, y = self.truth(a), self.truth(b)
        elif a.kind == b.kind == "number":
            x, y = a.column, b.column
        elif "time" in (a.kind, b.kind):
            x, y = a.column, b.column
        else:
            # numbers if both can be, else trimmed text
            p, q = (v.column.cast("string").try_cast("double") for v in (a, b))
            s, t = (F.trim(v.column.cast("string")) for v in (a, b))
            numeric = p.isNotNull() & q.isNotNull() & ~F.isnan(p) & ~F.isnan(q)
            return F.when(numeric, _OPS[op](p, q)).otherwise(_OPS[op](s, t))
        return _OPS[op](x, y)


_OPS = {
    "=": lambda x, y: x == y,
    "<": lambda x, y: x < y,
    ">": lambda x, y: x > y,
    "<=": lambda x, y: x <= y,
    ">=": lambda x, y: x >= y,
}


def violating(relation: Relation, expression: str, leaf: str | None = None) -> DataFrame:
    """The entries of which a must does not hold, with their own columns."""
    c = Compiler(relation, leaf)
    rows, holds = c.holds(expression)
    return rows.where(~holds).select(*relation.rows.columns)

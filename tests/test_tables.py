"""Every catalog query against its SQL in DuckDB, at the smallest scale; and the rule operators on edge cases."""

import duckdb
import pytest

from treeline.errors import XPathError
from treeline.functions.columns import valid
from treeline.operators import rules
from treeline.plans.catalog import ORACLE_SQL, QUERIES
from treeline.plans.tables import TablePlan
from treeline.schema.load import parse_string
from treeline.schema.model import Pattern, TypeSpec
from treeline.xpath.columns import Relation, violating

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


@pytest.mark.parametrize(
    "spec,good,bad",
    [
        (TypeSpec("int8"), ["1", "-128", "3.7"], ["128", "x", "-129"]),
        (TypeSpec("int32", range="1..10"), ["1", "10"], ["0", "11"]),
        (TypeSpec("decimal64", fraction_digits=2), ["1.25", "3"], ["1.255", "a"]),
        (TypeSpec("string", length="2..3", patterns=[Pattern("[a-z]+")]), ["ab"], ["a", "abcd", "AB", "ab\n"]),
        (TypeSpec("string", patterns=[Pattern("x.*", invert=True)]), ["ab"], ["xb"]),
        (TypeSpec("bits", bits={"a": 0, "b": 1}), ["a b", ""], ["a a", "c"]),
        (TypeSpec("binary", length="1..2"), ["aGk="], ["!!", "aGVsbG8="]),
        (TypeSpec("boolean"), ["true"], ["maybe"]),
        (TypeSpec("union", members=[TypeSpec("int8"), TypeSpec("enumeration", enums=["z"])]), ["5", "z"], ["q"]),
    ],
)
def test_type_columns(spark, spec, good, bad):
    rows = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = {r.v: r.ok for r in rows.select("v", valid(rows.v, spec).alias("ok")).collect()}
    assert got == {v: True for v in good} | {v: False for v in bad}


def test_nulls_ties_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "a"), (None, "a")], "k int, v string")
    assert {(r.k, r.v, r.entries) for r in rules.duplicate_keys(rows, ["k", "v"]).collect()} == {(1, None, 2)}
    target = spark.createDataFrame([("a",)], "t string")
    assert rules.orphans(rows, ["v"], target, ["t"]).count() == 0
    assert rules.orphans(rows, ["v"], target.limit(0), ["t"]).count() == 2
    counts = rules.counted(target, ["t"], rows, ["v"]).collect()
    assert [(r.t, r.entries) for r in counts] == [("a", 2)]


def test_column_compiler_keeps_every_entry(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, s string")
    below = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "p int, n int")
    r = Relation(parents, {"below": (Relation(below), [("id", "p")])})
    ids = lambda e: sorted(x.id for x in violating(r, e).collect())
    assert ids("count(below) >= 1") == [3]
    assert ids("count(below[n > 5]) = 1") == [2, 3]
    assert ids("below/n = 6") == [2, 3]
    assert ids("below/n > id") == [2, 3]
    assert ids("s = 'x' or not(below)") == [2]
    assert ids("string-length(s) = 1") == [3]
    with pytest.raises(XPathError):
        violating(r, "/a/b = 1")


@pytest.mark.parametrize(
    "kind,spec,good,bad",
    [
        ("int", TypeSpec("int8"), [1, -128, None], [128]),
        ("double", TypeSpec("int8", range="0..3"), [0.5, -0.5, 3.9, None], [4.0, -1.0, float("nan"), float("inf")]),
        ("double", TypeSpec("decimal64", fraction_digits=2), [12345000.0, 1e9, 0.25, None], [0.125]),
        ("double", TypeSpec("decimal64", range="0..max"), [0.0, 1e12, None], [-0.01]),
        ("string", TypeSpec("string", length="1..2"), ["ab", None], ["", "abc"]),
        ("string", TypeSpec("boolean"), ["true", "false", None], ["TRUE", "1", "0"]),
        ("boolean", TypeSpec("boolean"), [True, False, None], []),
        ("int", TypeSpec("boolean"), [0, 1, None], [2]),
        ("string", TypeSpec("empty"), ["", None], ["x"]),
        ("boolean", TypeSpec("empty"), [True, None], [False]),
        ("string", TypeSpec("binary", patterns=[Pattern("aG.*")]), ["aGk=", None], ["bGk="]),
        ("string", TypeSpec("enumeration"), [None], ["a"]),
    ],
)
def test_type_columns_of_a_kind(spark, kind, spec, good, bad):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(good + bad)], f"i int, v {kind}")
    broken = sorted(r.i for r in rules.breaking(rows, valid(rows.v, spec, kind=kind)).collect())
    assert broken == list(range(len(good), len(good) + len(bad)))


def test_positions_and_empty_sides(spark):
    parents = spark.createDataFrame([(1, 6), (2, None), (3, None), (4, 9)], "id int, s int")
    below = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 7), (4, 0, None)], "p int, at int, n int")
    r = Relation(parents, {"below": (Relation(below, order=["at"]), [("id", "p")])})
    ids = lambda e, r=r: sorted(x.id for x in violating(r, e).collect())
    assert ids("count(below[1]) = 1") == [3]
    assert ids("below[2]/n = 6") == [2, 3, 4]
    # two empty sides are equal, in order both ways, and not less
    assert ids("below/n = s") == [2, 4]
    assert ids("below/n >= s") == [2, 4]
    assert ids("below/n <= s") == [2, 4]
    assert ids("below/n < s") == [2, 3, 4]
    assert ids("below/n != s") == [1, 3]
    assert ids("string(true()) = 'True'") == []
    assert ids("translate('a-b', '--', 'xy') = 'ayb'") == []
    assert ids("unheard-of(s)") == [1, 2, 3, 4]
    unordered = Relation(parents, {"below": (Relation(below), [("id", "p")])})
    with pytest.raises(XPathError):
        violating(unordered, "below[1]/n = 5")


def test_first_entries_and_duplicates(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (1, 1, "a"), (2, None, "z"), (2, 5, "y")], "k int, o int, v string")
    for n in (1, 2):
        got = {(r.k, r.o, r.v) for r in rules.nth(rows, ["k"], ["o", "v"], n).collect()}
        assert got == ({(1, 1, None), (2, None, "z")} if n == 1 else {(1, 1, "a"), (2, 5, "y")})
    same = spark.createDataFrame([(1, 7, i) for i in range(5)] + [(1, 8, 9), (2, 7, 0)], "s int, k int, o int")
    assert [tuple(r) for r in rules.first_duplicate(same, ["s"], ["k"], ["o"]).collect()] == [(1, 0, 1)]
    assert rules.childless(rows.select("k").distinct(), ["k"], same, ["s"]).count() == 0


def test_all_rules_of_a_module(spark):
    module = parse_string(
        'module m { namespace "urn:m"; prefix m; list a { key id; leaf id { type int32; } leaf b { type leafref { path "/b/id"; } } leaf n { type int8; mandatory true; must ". > 1"; } }'
        " list b { key id; leaf id { type int32; } } }"
    )
    a = spark.createDataFrame([(1, 1, 5), (1, 2, 1), (2, None, None), (3, 1, 300)], "id int, b int, n int")
    found = TablePlan(module, {"a": a, "b": spark.createDataFrame([(1,)], "id int")}).violations()
    assert sorted((r.table, r.key, r.rule, r.leaf or "") for r in found.collect()) == [
        ("a", "1", "key", ""), ("a", "1", "must", "n"), ("a", "1", "type", "b"), ("a", "2", "mandatory", "n"), ("a", "3", "type", "n"),
    ]

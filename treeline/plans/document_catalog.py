"""Rule queries over documents made of rows: one for each construct, with the SQL that gives the same rows.

A document is an order with its lines as a list. Every query puts one construct
into the schema and returns the documents that break it under the rule named;
members that this schema does not name are another rule's and are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.plans.documents import Options, violations
from treeline.schema.load import parse_string

#: The documents' members beside the lines, as SQL over ``orders`` that Spark and other engines read alike.
MEMBERS = {
    "key": "o_orderkey",
    "status": "o_orderstatus",
    "total": "CAST(o_totalprice AS DOUBLE)",
    "priority": "o_orderpriority",
    "customer": "o_custkey",
    "size": "CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 10 END",
    "wanted": "o_custkey % 7 + 1",
    "bits": "CASE o_orderstatus WHEN 'F' THEN 'a b' WHEN 'O' THEN 'a a' ELSE 'c' END",
    "raw": "CASE o_orderstatus WHEN 'F' THEN 'aGVsbG8=' WHEN 'O' THEN 'aGk=' ELSE '!!' END",
    "flag": "CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'TRUE' ELSE 'false' END",
    "mark": "CASE o_orderstatus WHEN 'F' THEN '' ELSE 'x' END",
    "kind": "CASE o_orderstatus WHEN 'F' THEN 'made:closed' WHEN 'O' THEN 'made:open' ELSE 'strange' END",
    "place": "CASE o_orderstatus WHEN 'F' THEN '/order/key' ELSE '/order/none' END",
    "one": "CASE WHEN o_custkey % 2 = 0 THEN 'x' END",
    "two": "CASE WHEN o_custkey % 3 = 0 THEN 'y' END",
    "code": "substr(o_orderpriority, 1, 1)",
}
LINE = {"no": "l_linenumber", "part": "l_partkey", "supplier": "l_suppkey", "qty": "CAST(l_quantity AS BIGINT)", "returned": "l_returnflag", "status": "l_linestatus"}

TYPES = {
    "key": "int64", "status": "string", "total": "decimal64 { fraction-digits 2; }", "priority": "string", "customer": "int64",
    "size": "int32", "wanted": "int32", "code": "string", "kind": "string", "one": "string", "two": "string",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, doc): the orders as JSON; absent members are left out. An order's lines are one list, in order."""
    line = F.struct(*[F.expr(sql).alias(name) for name, sql in LINE.items()])
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("line"))
    orders = spark.read.parquet(f"{d}/orders.parquet").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = F.struct(*[F.expr(sql).alias(name) for name, sql in MEMBERS.items()], "line")
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(order.alias("order"))).alias("doc"))


def _sql(condition: str) -> str:
    """The documents' ids for which a condition over ``o`` and its lines ``l`` (l.k is the order's key) is true."""
    members = ", ".join(f'{sql} AS "{name}"' for name, sql in MEMBERS.items())
    line = ", ".join(f'{sql} AS "{name}"' for name, sql in LINE.items())
    return (
        f"WITH o AS (SELECT {members} FROM orders), u AS (SELECT l_orderkey AS k, {line} FROM lineitem), "
        f"l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {', '.join(f'u.{n}' for n in LINE)}) AS at FROM u) "
        f"SELECT o.key AS doc_id FROM o WHERE {condition}"
    )


def breaking(name: str, rule: str, parts: str, sql: str, head: str = "", options: Options | None = None, own: tuple[str, ...] = (), path: str | None = None) -> None:
    """Register a query: ``parts`` of the schema's container, with the plain leaves but ``own``, and when it is broken."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = violations(documents(spark, d), parse_string(text), options, rules=[rule])
        return (found.where(F.col("path") == path) if path else found).select("doc_id").distinct()

    leaves = " ".join(f"leaf {k} {{ type {t}{'' if t.endswith('}') else ';'} }}" for k, t in TYPES.items() if k not in own)
    line = "" if "list line" in parts else "list line { key no; leaf no { type int32; } leaf part { type int64; } leaf qty { type int64; } leaf returned { type string; } leaf status { type string; } }"
    text = f'module made {{ namespace "urn:example:made"; prefix made; {head} container order {{ {parts} {leaves} {line} }} }}'
    QUERIES[name] = run
    ORACLE_SQL[name] = _sql(sql)


def must(name: str, expression: str, holds: str, own: str = "", head: str = "", options: Options | None = None) -> None:
    """A must of the order: the documents for which ``holds`` is not true break it."""
    parts = f'must "{expression}"; {own}'
    breaking(f"must_{name}", "must", parts, f"({holds}) IS NOT TRUE", head, options, own=tuple(k for k in TYPES if f"leaf {k} " in own))


def _some(test: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM l WHERE l.k = o.key AND {test})"


_SIZE = "leaf size { type int32; default 7; }"

# paths and predicates
must("absolute_path", "/order/total > 100000", "total > 100000")
must("parent_step", "line/../total > 200000", f"{_some()} AND total > 200000")
must("self_step", "./status = 'F'", "status = 'F'")
must("default_value", "size < 5", "coalesce(size, 7) < 5", _SIZE)
must("two_predicates", "count(line[qty > 10][returned = 'R']) <= 1", "(SELECT count(*) FROM l WHERE l.k = o.key AND qty > 10 AND returned = 'R') <= 1")
must("first_line", "line[1]/qty > 10", _some("l.at = 1 AND qty > 10"))
must("second_line", "count(line[2]) = 1", _some("l.at = 2"))
must("deref_line", "deref(wanted)/../qty > 10", _some("l.no = o.wanted AND qty > 10"), "leaf wanted { type leafref { path '../line/no'; } }")
must("any_line", "line", _some())
must("nested_path", "line[returned = 'R']/qty > 45", _some("returned = 'R' AND qty > 45"))
# comparisons
must("some_at_most", "line/qty <= 5", _some("qty <= 5"))
must("some_at_least", "45 <= line/qty", _some("qty >= 45"))
must("some_equals_leaf", "line/qty = size", f"CASE WHEN NOT {_some()} THEN false ELSE {_some('qty = coalesce(o.size, 7)')} END", _SIZE)
must("none_equals", "line/status != status", f"NOT {_some('l.status = o.status')}")
must("two_sets", "line[qty > 45]/no = line[qty > 48]/no", f"NOT ({_some('qty > 45')} AND NOT {_some('qty > 48')})")
must("both_absent", "size = line[qty > 1000]/qty", "size IS NULL")
must("number_of_text", "customer < '500'", "customer < 500")
must("texts_in_order", "priority < '3'", "priority < '3'")
must("list_of_values", "status = ('F', 'P')", "status IN ('F', 'P')")
# operators and functions
must("not", "not(line[qty > 49])", f"NOT {_some('qty > 49')}")
must("or_and", "status = 'F' and total > 150000 or size = 4", "status = 'F' AND total > 150000 OR coalesce(size, 0) = 4")
must("arithmetic", "total - 2 * 1000 + 500 > 100000", "total - 2000 + 500 > 100000")
must("sign", "total > - (-100000)", "total > 100000")
must("string", "string-length(string(key)) < 5", "length(CAST(key AS VARCHAR)) < 5")
must("number", "number(translate(priority, '-ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '')) < 3", "CAST(substr(priority, 1, 1) AS INTEGER) < 3")
must("number_of_first", "number(line/qty) > 10", _some("l.at = 1 AND qty > 10"))
must("not_a_number", "number(priority) > 0", "false")
must("boolean", "boolean(line[returned = 'R'])", _some("returned = 'R'"))
must("true_false", "true() and not(false()) and status = 'O'", "status = 'O'")
must("concat", "string-length(concat(status, priority, '!')) < 9", "length(status || priority || '!') < 9")
must("unknown_function", "unheard-of(status) or status = 'F'", "status = 'F'")
must("truth_of_number", "number(size) and status", "coalesce(size, 7) <> 0", _SIZE)
must("quoted", "status != 'a\\\\'b' and status = 'F'", "status = 'F'")
must("contains", "contains(priority, 'E') and substring-after(priority, '-') != 'LOW' and substring-before(priority, '-') > 1",
     "priority LIKE '%E%' AND substr(priority, 3) <> 'LOW' AND CAST(substr(priority, 1, 1) AS INTEGER) > 1", options=Options(extended=True))
IDENTITIES = "identity state; identity done { base state; } identity closed { base done; } identity open { base state; }"
_KIND = "leaf kind { type identityref { base state; } }"
must("derived", "derived-from(kind, 'made:done')", "status = 'F'", _KIND, IDENTITIES)
must("derived_or_self", "derived-from-or-self(kind, 'made:open')", "status = 'O'", _KIND, IDENTITIES)
breaking("must_current", "must", "leaf total { type decimal64 { fraction-digits 2; } must 'current() > 100000'; }", "NOT total > 100000", own=("total",))
breaking("must_each_line", "must", "list line { must 'qty > 5'; leaf no { type int32; } leaf qty { type int64; } }", _some("qty <= 5"))

# types
breaking("doc_type_integer", "type", "leaf size { type int8 { range '2..6'; } }", "size < 2 OR size > 6", own=("size",))
breaking("doc_type_decimal", "type", "leaf total { type decimal64 { fraction-digits 2; range '1000..200000'; } }", "total < 1000 OR total > 200000", own=("total",))
breaking("doc_type_length", "type", "leaf priority { type string { length '1..8'; } }", "length(priority) > 8", own=("priority",))
breaking("doc_type_pattern", "type", "leaf priority { type string { pattern '[1-3]-.*' { error-message low; } } }", "substr(priority, 1, 1) NOT IN ('1', '2', '3')", own=("priority",))
breaking("doc_type_inverted", "type", "leaf priority { type string { pattern '1.*' { modifier invert-match; } } }", "substr(priority, 1, 1) = '1'", own=("priority",))
breaking("doc_type_enum", "type", "leaf status { type enumeration { enum F; enum O; } }", "status NOT IN ('F', 'O')", own=("status",), path="/order/status")
breaking("doc_type_bits", "type", "leaf bits { type bits { bit a; bit b; } }", "status <> 'F'")
breaking("doc_type_binary", "type", "leaf raw { type binary { length '3..9'; } }", "status <> 'F'")
breaking("doc_type_boolean", "type", "leaf flag { type boolean; }", "status = 'O'")
breaking("doc_type_empty", "type", "leaf mark { type empty; }", "status <> 'F'")
breaking("doc_type_union", "type", "leaf code { type union { type int8 { range '1..2'; } type enumeration { enum 5; } } }", "code NOT IN ('1', '2', '5')", own=("code",))
breaking("doc_type_typedef", "type", "leaf size { type small; }", "size > 4", "typedef few { type int8 { range '0..4'; } } typedef small { type few; }", own=("size",))
breaking("doc_type_identity", "type", "leaf kind { type identityref { base done; } }", "status <> 'F'", IDENTITIES, own=("kind",))
breaking("doc_leafref", "type", "leaf wanted { type leafref { path '../line/no'; } }", f"NOT {_some('l.no = o.wanted')}", own=("wanted",))
breaking("doc_leafref_absolute", "type", "leaf wanted { type leafref { path '/order/line/no'; } }", f"NOT {_some('l.no = o.wanted')}", own=("wanted",))
breaking("doc_leafref_predicate", "type", "leaf wanted { type leafref { path \"/order/line[returned = 'R']/no\"; } }", f"NOT {_some(chr(39).join(['returned = ', 'R', ' AND l.no = o.wanted']))}", own=("wanted",))
breaking("doc_leafref_optional", "type", "leaf wanted { type leafref { path '../line/no'; require-instance false; } }", "false", own=("wanted",))
breaking("doc_instance_identifier", "type", "leaf place { type instance-identifier; }", "status <> 'F'")

# presence and structure
breaking("doc_mandatory", "mandatory", "leaf size { type int32; mandatory true; }", "size IS NULL", own=("size",))
breaking("doc_choice_mandatory", "choice", "choice c { mandatory true; leaf one { type string; } leaf two { type string; } }", "(one IS NULL) = (two IS NULL)", own=("one", "two"))
breaking("doc_choice_exclusive", "choice", "choice c { case a { leaf one { type string; } } case b { leaf two { type string; } } }", "one IS NOT NULL AND two IS NOT NULL", own=("one", "two"))
breaking("doc_unknown", "unknown", "", "one IS NOT NULL", own=("one",), path="/order/one")
breaking("doc_min_elements", "min-elements", "list line { min-elements 3; leaf no { type int32; } }", f"{_some()} AND (SELECT count(*) FROM l WHERE l.k = o.key) < 3")
breaking("doc_max_elements", "max-elements", "list line { max-elements 5; leaf no { type int32; } }", "(SELECT count(*) FROM l WHERE l.k = o.key) > 5")
breaking("doc_key", "key", "", "(SELECT count(*) - count(DISTINCT no) FROM l WHERE l.k = o.key) > 0")
breaking("doc_when", "when", "leaf one { when \"../status = 'F'\"; type string; }", "one IS NOT NULL AND status <> 'F'", own=("one",))
breaking("doc_if_feature", "if-feature", "leaf one { if-feature shown; type string; }", "one IS NOT NULL", "feature shown;", Options(features={"made": set()}), own=("one",))
breaking("doc_if_feature_terms", "if-feature", "leaf one { if-feature 'a and not b'; type string; } leaf two { if-feature 'a or b'; type string; }", "one IS NOT NULL", "feature a; feature b;", Options(features={"made": {"a", "b"}}), own=("one", "two"))
breaking("doc_if_feature_several", "if-feature", "leaf one { if-feature a; if-feature b; type string; }", "one IS NOT NULL", "feature a; feature b;", Options(features={"made": {"a"}}), own=("one",))
breaking("doc_uses", "type", "uses g;", "size > 3", "grouping g { leaf size { type int8 { range '0..3'; } } }", own=("size",))
breaking("doc_refine", "mandatory", "uses g { refine size { mandatory true; } }", "size IS NULL", "grouping g { leaf size { type int8; } }", own=("size",))
breaking("doc_uses_when", "when", "uses g { when \"status = 'F'\"; }", "one IS NOT NULL AND status <> 'F'", "grouping g { leaf one { type string; } }", own=("one",))
breaking("doc_augment", "type", "", "size > 3", "augment '/order' { leaf size { type int8 { range '0..3'; } } }", own=("size",))

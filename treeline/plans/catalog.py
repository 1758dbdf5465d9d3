"""The rule queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators import rules
from treeline.plans import document_catalog
from treeline.plans.tables import TablePlan
from treeline.schema.load import parse_string
from treeline.schema.model import Module

SCHEMA = """
module sales {
  namespace "urn:example:sales"; prefix s;
  identity place;
  identity region-0 { base place; }
  identity region-1 { base place; }
  identity nation-a { base region-0; }
  identity nation-b { base region-1; }
  list region { key r_regionkey; leaf r_regionkey { type int32; } leaf r_name { type string; } }
  list nation {
    key n_nationkey;
    leaf n_nationkey { type int32; } leaf n_name { type string; }
    leaf n_regionkey { type leafref { path "/region/r_regionkey"; } }
  }
  list customer {
    key c_custkey;
    leaf c_custkey { type int64; } leaf c_name { type string; }
    leaf c_nationkey { type leafref { path "/nation/n_nationkey"; } }
    leaf c_acctbal { type decimal64 { fraction-digits 2; range "0..max"; } }
    leaf c_mktsegment { type string; }
  }
  list part {
    key p_partkey;
    must "p_size <= 10 or p_type = 'ECONOMY'";
    leaf p_partkey { type int64; } leaf p_name { type string; }
    leaf p_brand { type string { pattern "Brand#1[0-9]"; } }
    leaf p_type { type string; }
    leaf p_size { type union { type int32 { range "1..10"; } type enumeration { enum none; } } }
    leaf p_retailprice { type decimal64 { fraction-digits 2; } }
  }
  list orders {
    key o_orderkey;
    leaf o_orderkey { type int64; }
    leaf o_custkey { type leafref { path "/customer/c_custkey"; } must "deref(.)/../c_mktsegment = 'BUILDING'"; }
    leaf o_orderstatus { type string; }
    leaf o_totalprice { type decimal64 { fraction-digits 2; } }
    leaf o_orderdate { type string; }
    leaf o_orderpriority { type string; }
  }
  list lineitem {
    key "l_orderkey l_linenumber";
    must "l_discount < l_tax";
    leaf l_orderkey { type leafref { path "/orders/o_orderkey"; } }
    leaf l_partkey { type leafref { path "/part/p_partkey"; } }
    leaf l_suppkey { type int64; } leaf l_linenumber { type int32; }
    leaf l_quantity { type int32 { range "1..10"; } }
    leaf l_extendedprice { type decimal64 { fraction-digits 2; } }
    leaf l_discount { type decimal64 { fraction-digits 2; } }
    leaf l_tax { type decimal64 { fraction-digits 2; } }
    leaf l_returnflag { type string; } leaf l_linestatus { type string; } leaf l_shipdate { type string; }
  }
  list events {
    key event_id;
    leaf event_id { type int64; }
    leaf event_type { type enumeration { enum click; enum view; enum purchase; } }
    leaf props { type string; }
  }
  list documents {
    key doc_id;
    must "string-length(text) - string-length(translate(text, ' ', '')) <= 100";
    leaf doc_id { type leafref { path "/labels/doc_id"; } }
    leaf text { type string { length "0..5000"; } }
  }
  list labels { key doc_id; leaf doc_id { type leafref { path "/documents/doc_id"; } } leaf quality { type int32; } }
  list conversations {
    key "conv_id turn";
    must "turn != 0 or role = 'user'";
    leaf conv_id { type int64; } leaf turn { type int64; } leaf role { type string; }
  }
}
"""


@lru_cache(maxsize=1)
def module() -> Module:
    return parse_string(SCHEMA)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan of fewer tasks than there are cores, dealt to all of them; of a larger scan as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def plan(spark: SparkSession, sf_dir: str) -> TablePlan:
    tables = {c.name: table(spark, sf_dir, c.name) for c in module().root.children}
    return TablePlan(module(), tables, {"orders": {"lineitem": [("o_orderkey", "l_orderkey")]}})


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(document_catalog.QUERIES)
ORACLE_SQL: dict[str, str] = dict(document_catalog.ORACLE_SQL)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 10)")
def type_int_range(spark, d):
    return plan(spark, d).type_violations("lineitem", "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#1[0-9]')")
def type_pattern(spark, d):
    return plan(spark, d).type_violations("part", "p_brand").select("p_partkey", "p_brand")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def type_enum(spark, d):
    return plan(spark, d).type_violations("events", "event_type").select("event_id", "event_type")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 5000")
def type_length(spark, d):
    return plan(spark, d).type_violations("documents", "text").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 1 AND 10)")
def type_union(spark, d):
    return plan(spark, d).type_violations("part", "p_size").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size, p_type FROM part WHERE NOT (p_size <= 10 OR p_type = 'ECONOMY')")
def must_or(spark, d):
    return plan(spark, d).must_violations("part").select("p_partkey", "p_size", "p_type")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def type_decimal(spark, d):
    return plan(spark, d).type_violations("customer", "c_acctbal").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS entries FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_unique(spark, d):
    return plan(spark, d).key_violations("lineitem")


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem),
p AS (SELECT l_orderkey, list_sort(list(pos)) AS ats FROM n GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
SELECT l_orderkey, min(ats[2]) AS second, arg_min(ats[1], ats[2]) AS "first" FROM p GROUP BY 1""")  # fmt: skip
def first_duplicate(spark, d):
    rows = plan(spark, d).relations["lineitem"].rows
    found = rules.first_duplicate(rows, ["l_orderkey"], ["l_linenumber"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return found.select("l_orderkey", F.col("second").cast("long").alias("second"), F.col("first").cast("long").alias("first"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def leafref_anti(spark, d):
    return plan(spark, d).type_violations("documents", "doc_id").select("doc_id")


@query("SELECT l_orderkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)")
def leafref_valid(spark, d):
    return plan(spark, d).type_violations("lineitem", "l_orderkey").select("l_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def mandatory_child(spark, d):
    return plan(spark, d).element_violations("orders", "lineitem", least=1).select("o_orderkey")


@query("SELECT l_orderkey AS o_orderkey, count(*) AS entries FROM lineitem GROUP BY 1 HAVING count(*) > 7")
def max_elements(spark, d):
    return plan(spark, d).element_violations("orders", "lineitem", most=7).select("o_orderkey", "entries")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_discount < l_tax)")
def must_compare(spark, d):
    return plan(spark, d).must_violations("lineitem").select("l_orderkey", "l_linenumber")


def _orders(spark: SparkSession, d: str, expression: str, *columns: str) -> DataFrame:
    from treeline.xpath.columns import violating

    return violating(plan(spark, d).relations["orders"], expression).select("o_orderkey", *columns)


@query("SELECT o_orderkey FROM orders WHERE NOT ((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') <= 2)")
def must_count_pred(spark, d):
    return _orders(spark, d, "count(lineitem[l_returnflag = 'R']) <= 2")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)")
def must_exists_other(spark, d):
    return _orders(spark, d, "lineitem/l_shipdate > o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus)")
def must_neq_nodeset(spark, d):
    return _orders(spark, d, "lineitem/l_linestatus != o_orderstatus")


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def deref_parent(spark, d):
    return plan(spark, d).must_violations("orders", "o_custkey").select("o_orderkey")


@query("""SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey IS DISTINCT FROM 1""")
def deref_nested(spark, d):
    return _orders(spark, d, "deref(deref(o_custkey)/../c_nationkey)/../n_regionkey = 1")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'")
def when_gate(spark, d):
    return plan(spark, d).holding("orders", "o_totalprice > 300000 and o_orderstatus != 'F'").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_tax > 0.05")
def choice_exclusive(spark, d):
    rows = plan(spark, d).relations["lineitem"].rows
    cases = {"discount": F.col("l_discount") > 0.05, "tax": F.col("l_tax") > 0.05}
    return rules.more_than_one(rows, cases).select("l_orderkey", "l_linenumber")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS rn FROM lineitem) WHERE rn = 1""")
def positional_predicate(spark, d):
    rows = plan(spark, d).relations["lineitem"].rows
    return rules.nth(rows, ["l_orderkey"], _LINE_ORDER, 1).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey <> 1")
def identity_derived(spark, d):
    """Nations as identities based on their regions: those that do not derive from region 1."""
    nations = spark.read.parquet(f"{d}/nation.parquet")
    regions = [r[0] for r in spark.read.parquet(f"{d}/region.parquet").select("r_regionkey").collect()]  # five rows
    bases = nations.select("n_nationkey", "n_regionkey").collect()  # 25 rows: a schema, not data
    text = "".join(f"identity r{r} {{ base place; }}" for r in regions) + "".join(f"identity n{n} {{ base r{r}; }}" for n, r in bases)
    from treeline.schema.identities import Identities

    members = Identities(parse_string(f'module p {{ namespace "urn:p"; prefix p; identity place; {text} }}')).members(["r1"])
    derived = F.concat(F.lit("p:n"), F.col("n_nationkey")).isin(members)
    return nations.where(~derived).select("n_nationkey", "n_name")


@query("SELECT doc_id FROM documents WHERE length(text) - length(replace(text, ' ', '')) > 100")
def translate_len(spark, d):
    return plan(spark, d).must_violations("documents").select("doc_id")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def value_list(spark, d):
    return plan(spark, d).holding("orders", "o_orderpriority = ('1-URGENT', '2-HIGH')").select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE NOT (CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 50)")
def anydata_props(spark, d):
    from treeline.functions.columns import valid
    from treeline.schema.model import TypeSpec

    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", k.alias("k"))
    return rules.breaking(rows, valid(F.col("k"), TypeSpec("int64", range="0..50")))


@query("SELECT conv_id, role FROM conversations WHERE turn = 0 AND role <> 'user'")
def turn_role(spark, d):
    return plan(spark, d).must_violations("conversations").select("conv_id", "role")


@query("""SELECT count(*) FILTER (WHERE v.doc_id IS NULL) AS valid, count(v.doc_id) AS invalid
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE length(text) > 5000) v ON d.doc_id = v.doc_id""")
def doc_summary(spark, d):
    p = plan(spark, d)
    return rules.valid_summary(p.relations["documents"].rows, ["doc_id"], p.type_violations("documents", "text"))


ROWS_SCHEMA = """
module sales-rows {
  namespace "urn:example:rows"; prefix r;
  container order {
    leaf o_orderkey { type int64; mandatory true; }
    leaf o_orderstatus { type enumeration { enum F; enum O; } }
    leaf o_totalprice { type decimal64 { fraction-digits 2; range "0..300000"; } must ". < 250000 or ../o_orderstatus = 'F'"; }
    leaf o_orderpriority { type string { pattern "[1-5]-.*"; } }
  }
}
"""


@query("""SELECT o_orderkey AS doc_id, rule FROM (
SELECT o_orderkey, 'type' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT o_orderkey, 'must' FROM orders WHERE NOT (o_totalprice < 250000 OR o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 'type' FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT o_orderkey, 'type' FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-5]-.*'))""")
def document_rules(spark, d):
    """The document plan over JSON made of rows."""
    from treeline.plans.documents import violations

    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = spread(spark.read.parquet(f"{d}/orders.parquet").select(*columns))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.to_json(F.struct(F.struct(*columns).alias("order"))).alias("doc"))
    return violations(docs, parse_string(ROWS_SCHEMA)).select("doc_id", "rule")


@query("""SELECT "table", rule, leaf, count(*) AS entries FROM (
SELECT 'lineitem' AS "table", 'type' AS rule, 'l_quantity' AS leaf FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 10)
UNION ALL SELECT 'part', 'type', 'p_brand' FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#1[0-9]')
UNION ALL SELECT 'part', 'type', 'p_size' FROM part WHERE NOT (p_size BETWEEN 1 AND 10)
UNION ALL SELECT 'customer', 'type', 'c_acctbal' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'events', 'type', 'event_type' FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT 'documents', 'type', 'text' FROM documents WHERE length(text) > 5000
UNION ALL SELECT 'documents', 'type', 'doc_id' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'labels', 'type', 'doc_id' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orders', 'type', 'o_custkey' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem', 'type', 'l_partkey' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'lineitem', 'type', 'l_orderkey' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'lineitem', 'key', NULL FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'must', 'o_custkey' FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'
UNION ALL SELECT 'lineitem', 'must', NULL FROM lineitem WHERE NOT (l_discount < l_tax)
UNION ALL SELECT 'part', 'must', NULL FROM part WHERE NOT (p_size <= 10 OR p_type = 'ECONOMY')
UNION ALL SELECT 'documents', 'must', NULL FROM documents WHERE length(text) - length(replace(text, ' ', '')) > 100
UNION ALL SELECT 'conversations', 'must', NULL FROM conversations WHERE turn = 0 AND role <> 'user'
) GROUP BY ALL""")
def all_rules(spark, d):
    """Every rule of the module in one call: how many entries break each."""
    found = plan(spark, d).violations()
    return found.groupBy("table", "rule", "leaf").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 2")
def second_entry(spark, d):
    rows = plan(spark, d).relations["lineitem"].rows
    return rules.nth(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], 2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) l
ON l_orderkey = o_orderkey AND rn = 1 WHERE NOT coalesce(l_quantity > 10, false)""")
def must_first_entry(spark, d):
    """A position in a compiled path: the relation names the order of its entries."""
    from treeline.xpath.columns import violating

    orders = plan(spark, d).relations["orders"]
    orders.children["lineitem"][0].order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return violating(orders, "lineitem[1]/l_quantity > 10").select("o_orderkey")


def _entry_query(name: str, expression: str, holds: str) -> None:
    """Register a must over orders as a compiled column, and the entries that break it."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _orders(spark, d, expression)

    run.__name__ = f"table_{name}"
    query(f"SELECT o_orderkey FROM orders WHERE ({holds}) IS NOT TRUE")(run)


def _line(test: str = "true") -> str:
    return f"EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {test})"


_entry_query("not", "not(lineitem[l_quantity > 49])", f"NOT {_line('l_quantity > 49')}")
_entry_query("boolean", "boolean(lineitem[l_returnflag = 'R']) and lineitem", _line("l_returnflag = 'R'"))
_entry_query("true_false", "true() and not(false()) and o_orderstatus = 'O'", "o_orderstatus = 'O'")
_entry_query("string", "string-length(string(o_orderkey)) < 4", "length(CAST(o_orderkey AS VARCHAR)) < 4")
_entry_query("number", "number(translate(o_orderpriority, '-ABCDEFGHIJKLMNOPQRSTUVWXYZ ', '')) < 3", "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) < 3")
_entry_query("concat", "string-length(concat(o_orderstatus, o_orderpriority)) < 8", "length(o_orderstatus || o_orderpriority) < 8")
_entry_query("arithmetic", "o_totalprice - 2 * 1000 + 500 > - (-100000)", "o_totalprice - 2000 + 500 > 100000")
_entry_query("several_predicates", "count(lineitem[l_quantity > 10 and l_returnflag = 'R']) <= 1", "(SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10 AND l_returnflag = 'R') <= 1")
_entry_query("most", "lineitem/l_quantity >= 45", _line("l_quantity >= 45"))
_entry_query("least", "lineitem/l_extendedprice < o_totalprice", _line("l_extendedprice < o_totalprice"))
_entry_query("unknown_function", "unheard-of(o_orderstatus) or o_orderstatus = 'F'", "o_orderstatus = 'F'")
_entry_query("text_as_number", "o_custkey < '500'", "o_custkey < 500")

"""Winnowing fingerprints of whole texts, with DataFrame operations only.

A text's units are its words; a run of more than ``UNIT`` characters without white
space, as in scripts that use none, gives its code points. Each unit is hashed
once; the hash of a run of ``k`` units is a polynomial in theirs modulo a prime,
rolled from the hash of the shorter run by one multiplication and one addition.
In every window of 2 ** ``levels`` consecutive hashes the smallest is selected,
the rightmost of equal ones. Two texts that share a run of at least w + k - 1
units share a selected hash; runs of fewer than k units are never matched.
Positions (unit offsets) are kept beside the hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import common

K = 3
LEVELS = 2
UNIT = 24
#: Documents aimed at in one id range when neighbours are looked up, and bounds on the number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 2_000, 1_024, 1 << 18

_LOW = (1 << 32) - 1
#: The hashes' modulus and base; products of two residues stay far below 2**63.
PRIME, BASE = (1 << 31) - 1, 1_000_003
_SPACE = "\\x20\\x09-\\x0D"
_UNITS = f"(?<![^{_SPACE}])[^{_SPACE}]{{1,{UNIT}}}(?![^{_SPACE}])|[^{_SPACE}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def selected(text: Column, k: int = K, levels: int = LEVELS) -> Column:
    """The selected values in text order, as array<bigint>: hash * 2**32 - position.

    The least value of a window is its least hash, rightmost on ties. A text of
    fewer than k units has one hash, that of all it has; one without words none.
    With fewer than w hashes the window is what there is.
    """
    w = 1 << levels
    units = F.regexp_extract_all(text, F.lit(_UNITS), F.lit(0))
    # eight hexadecimal digits of md5, which any SQL engine has
    hashed = F.transform(units, lambda u: F.pmod(F.conv(F.substring(F.md5(u.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(PRIME)))

    def hashes(u: Column) -> Column:
        runs = u
        for step in range(1, k):
            longer = F.zip_with(
                F.slice(runs, 1, F.greatest(F.size(u) - step, F.lit(0))),
                F.slice(u, step + 1, F.greatest(F.size(u) - step, F.lit(0))),
                lambda run, unit: F.pmod(run * F.lit(BASE) + unit, F.lit(PRIME)),
            )
            runs = F.when(F.size(u) > step, longer).otherwise(runs)
        return F.transform(runs, lambda run, i: F.shiftleft(run, 32) - i)

    minima = let(hashed, hashes)

    def joined(step: int):
        # a window's minimum is the less of its halves' minima; null beyond the end
        # (no default arguments here: a second parameter of the lambda would be the element's index)
        return lambda m: F.zip_with(
            m, F.slice(m, F.lit(step + 1), F.greatest(F.size(m) - step, F.lit(0))), lambda a, b: F.least(a, b)
        )

    for level in range(levels):
        minima = let(minima, joined(1 << level))
    full = let(minima, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (w - 1), F.lit(1))))
    return F.coalesce(F.array_distinct(full), F.expr("array()").cast("array<bigint>"))


def hashes_of(values: Column) -> Column:
    """The hashes of selected values, distinct."""
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v + F.lit(_LOW), 32)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two selections' hashes; two empty ones are alike, as are equal texts without words."""

    def ratio(both: Column) -> Column:
        any_ = F.size(F.array_union(both[0], both[1]))
        return F.when(any_ == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both[0], both[1])) / any_)

    return let(F.array(hashes_of(a), hashes_of(b)), ratio)


def as_text(values: Column) -> Column:
    """A fingerprint as one string: the selected values in text order."""
    return F.array_join(values.cast("array<string>"), " ")


def _ranges(docs: DataFrame, key: Column) -> list[int]:
    """Sorted distinct ids that start about equally full ranges; the first is the least id."""
    rows, least = docs.agg(F.count(F.lit(1)), F.min(key)).first()
    if not rows:
        return []
    n = min(MOST_RANGES, max(LEAST_RANGES, rows // RANGE_ROWS))
    at = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(key, at, 20 * n)).first()[0]
    return [least, *sorted(set(found) - {least})]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, values, next_text, next_values) in ascending doc_id; the last row's next is the first.

    Rows are dealt to id ranges; the row that starts a range is also sent to the
    range before it, so that every row finds its neighbour where it is. The texts
    are shuffled once. Null ids come last; rows of one id follow each other by text.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    bounds = _ranges(docs, key)
    if not bounds:
        return docs.select(
            "doc_id", "text", selected(F.col("text")).alias("values"), F.col("text").alias("next_text"),
            selected(F.col("text")).alias("next_values"),
        )
    # two levels of bounds: which block, which range in it
    step = math.isqrt(len(bounds)) + 1
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    block = F.size(F.filter(numbers(bounds[::step]), lambda b: b <= F.col("key"))) - 1
    here = F.slice(numbers(bounds), F.col("block") * step + 1, F.lit(step))
    inner = F.size(F.filter(here, lambda b: b <= F.col("key"))) - 1
    starts = F.array_contains(here, F.col("key"))
    before = F.pmod(F.col("range") - 1, F.lit(len(bounds)))
    dealt = (
        docs.withColumn("key", key)
        .withColumn("block", block)
        .withColumn("range", F.col("block") * step + inner)
        .withColumn(
            "at",
            F.explode(
                F.when(starts, F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest"))))
                .otherwise(F.array(F.struct(F.col("range"), F.lit(0).alias("guest"))))
            ),
        )
        .select("doc_id", "text", "key", F.col("at.range").alias("in_range"), F.col("at.guest").alias("guest"))
        .repartition("in_range")
        .withColumn("values", selected(F.col("text")))
    )
    order = Window.partitionBy("in_range").orderBy("guest", "key", "text")
    return (
        dealt.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_values", F.lead("values").over(order))
        .where("guest = 0")
        .select("doc_id", "text", "values", "next_text", "next_values")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Null ids are the last; repeated rows and rows of
    one id follow each other by text; extra columns are dropped; an empty table
    gives an empty result. A single row is its own next document.
    """
    rows = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    return (
        with_next(rows)
        .withColumn("edited", edited)
        .withColumn("edited_values", selected(F.col("edited")))
        .select(
            "doc_id",
            n.cast("long").alias("n_chars"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("values")).alias("fingerprint"),
            as_text(F.col("edited_values")).alias("edited_fingerprint"),
            likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
            likeness(F.col("values"), F.col("next_values")).alias("near_next"),
        )
    )


def oracle(k: int = K, w: int = 1 << LEVELS) -> str:
    """The query in DuckDB's SQL: the windows' minima taken one by one."""
    def run(h: str, i: str) -> str:
        out = "0"
        for j in range(k):
            out = f"CASE WHEN {i} + {j} <= len({h}) THEN ({out} * {BASE} + {h}[{i} + {j}]) % {PRIME} ELSE {out} END" if j else f"{h}[{i}]"
        return out

    space = "[^\\x20\\x09-\\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id, text) AS pos, count(*) OVER () AS many FROM documents),
e AS (
  SELECT x.doc_id, x.t, x.pos, y.pos AS next_at, length(x.t) AS n,
    substring(x.t, 1, length(x.t) - length(x.t) // 2) || substring(y.t, 1, length(x.t) // 2) AS e
  FROM d x JOIN d y ON y.pos = x.pos % x.many + 1
),
s AS (SELECT pos, 0 AS edit, t FROM e UNION ALL SELECT pos, 1, e FROM e),
u AS (
  SELECT pos, edit, list_transform(flatten(list_transform(regexp_extract_all(t, '{space}'),
    lambda x: CASE WHEN length(x) <= {UNIT} THEN [x] ELSE regexp_extract_all(x, '(?s).') END)),
    lambda x: CAST('0x' || substring(md5(x), 1, 8) AS BIGINT) % {PRIME}) AS h
  FROM s
),
g AS (
  SELECT pos, edit, CASE WHEN len(h) = 0 THEN [] ELSE list_transform(range(1, greatest(len(h) - {k - 1}, 1) + 1),
    lambda i: ({run('h', 'i')}) * 4294967296 - (i - 1)) END AS v
  FROM u
),
f AS (
  SELECT pos, edit, CASE WHEN len(v) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(v) - {w - 1}, 1) + 1),
    lambda i: list_min(v[i:i + {w - 1}]))) END AS m
  FROM g
),
r AS (
  SELECT pos, edit, list_distinct(list_transform(m, lambda x: (x + 4294967295) >> 32)) AS h, m
  FROM f
)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.e) AS edited_sha256,
  array_to_string(list_transform(list_sort(list_transform(a.m, lambda x: {{'p': ((x + 4294967295) >> 32) * 4294967296 - x, 'x': x}})), lambda y: y.x), ' ') AS fingerprint,
  array_to_string(list_transform(list_sort(list_transform(b.m, lambda x: {{'p': ((x + 4294967295) >> 32) * 4294967296 - x, 'x': x}})), lambda y: y.x), ' ') AS edited_fingerprint,
  CASE WHEN len(a.h) + len(b.h) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.h, b.h)) AS DOUBLE) / (len(a.h) + len(b.h) - len(list_intersect(a.h, b.h))) END AS near_edited,
  CASE WHEN len(a.h) + len(c.h) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a.h, c.h)) AS DOUBLE) / (len(a.h) + len(c.h) - len(list_intersect(a.h, c.h))) END AS near_next
FROM e JOIN r a ON a.pos = e.pos AND a.edit = 0 JOIN r b ON b.pos = e.pos AND b.edit = 1 JOIN r c ON c.pos = e.next_at AND c.edit = 0
"""


OP3_SQL = oracle()


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents", "doc_id", "text"))

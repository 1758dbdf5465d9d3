"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Targets share the total size by weight, no source above ``epochs`` times its own
size: sources that would go above are clamped, and what they leave is shared by
weight among the others, until none is above. Every document of a source is then
taken as often as fits its target, and once more, whole, if it is drawn: documents
are drawn in the order of a seeded hash until the target is reached, where the one
that would go beyond it gives its first words only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import common
from treeline.llm.common import materialize

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: A table of sources up to this many rows is broadcast; a longer one is joined by shuffling.
BROADCAST_SOURCES = 20_000
#: A place has 63 bits; its range is narrowed by this many at each level, so that 2 ** 20 ranges share a source's rows.
PLACE_BITS, LEVEL_BITS, LEVELS = 63, 10, 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to (source, source_size), one row per source.

    Sources weigh ``weights`` in turn by code point order, null last. Clamping
    runs in rounds over the sources' table, each a sum of what is clamped and of
    the weight that is not, so that any number of sources is handled alike.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*map(F.lit, map(float, weights)))
    # one row per source, not per document, goes through this ordering
    weighted = sizes.withColumn(
        "weight", F.element_at(turn, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    weighted = materialize(weighted)
    cap = F.col("source_size") * F.lit(float(epochs))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        n, taken, weight = weighted.agg(
            F.count(F.when(above, 1)),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (total - taken) / weight
    return weighted.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def ranked(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's seeded place, 63 bits, in the order in which its source's rows take one repetition more."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 1)


def edges(sized: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Per source of (source, size, place): of_source, source_size, target, base, edge, rest, ties.

    Every row of a source is taken ``base`` times in full and once more if its
    place is below ``edge``; the ``ties`` rows at the edge share ``rest`` words.
    The edge is found by sums over ever finer ranges of places, so that no task
    orders a source's rows: only those of one range of the last level.
    """
    per_source = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, epochs)
    words = F.round("target").cast("long")
    base = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_source = materialize(per_source.select(F.col("source").alias("of_source"), "source_size", "target", base.alias("base")))
    left = F.round("target").cast("long") - F.col("base") * F.col("source_size")
    found = per_source.where("source_size > 0").select("of_source", F.lit(0).cast("long").alias("range"), left.alias("rest"))
    here = sized.where("size > 0").select("source", "place", "size")
    before = Window.partitionBy("of_source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, LEVELS + 2):
        # the last level's ranges are single places
        at = F.shiftright("place", PLACE_BITS - level * LEVEL_BITS) if level <= LEVELS else F.col("place")
        here = here.join(_sent(found), F.col("source").eqNullSafe(F.col("of_source")))
        if level > 1:
            here = here.where(F.shiftright("place", PLACE_BITS - (level - 1) * LEVEL_BITS) == F.col("range"))
        sums = here.groupBy("of_source", "rest", at.alias("range_")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("ties"))
        here = here.select("source", "place", "size")
        found = materialize(
            sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
            .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
            .select("of_source", F.col("range_").alias("range"), (F.col("rest") - F.col("before")).alias("rest"), "ties")
        )
        if level <= LEVELS:
            found = found.drop("ties")
    found = found.select(F.col("of_source").alias("of"), F.col("range").alias("edge"), "rest", "ties")
    return materialize(per_source.join(_sent(found), F.col("of_source").eqNullSafe(F.col("of")), "left").drop("of"))


def _sent(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else per_source


def _taken(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Add the columns of ``per_source`` and ``taken``, the words taken, to rows with source, size and place."""
    joined = rows.join(_sent(per_source), F.col("source").eqNullSafe(F.col("of_source")))
    more = F.when(F.col("place") < F.col("edge"), F.col("size")).otherwise(F.lit(0))
    at_edge = (F.col("size") > 0) & (F.col("place") == F.col("edge"))
    own = F.col("base") * F.col("size")
    if not per_source.where("ties > 1").limit(1).count():
        return joined.withColumn("taken", own + F.when(at_edge, F.col("rest")).otherwise(more))
    # rows equal in id and text share the edge of their source: they take what is left one after the other
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    tied = joined.where(at_edge & (F.col("ties") > 1)).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    tied = tied.withColumn("taken", own + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    others = joined.where(~F.coalesce(at_edge & (F.col("ties") > 1), F.lit(False)))
    return others.withColumn("taken", own + F.when(at_edge, F.col("rest")).otherwise(more)).unionByName(tied)


def repetitions(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED, text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, whole, part, taken.

    ``whole`` full repetitions and ``part`` further words are taken, ``taken``
    words in all, never above ``epochs`` times the size; ``part`` is 0 but for one
    row of a source at most. A null or empty text has size 0 and takes nothing; a
    null source is a source of its own; null ids and repeated rows are rows like
    any other; other columns of ``docs`` are not looked at. An empty table gives an
    empty result.
    """
    sized = docs.select(
        docs["doc_id"], docs["source"], word_count(docs[text_col]).alias("size"),
        ranked(docs["doc_id"], docs[text_col], seed).alias("place"),
    )
    with common.scratch(docs.sparkSession) as keep:
        sized = keep(sized)
        per_source = keep(edges(sized, weights, epochs))
    return (
        _taken(sized, per_source)
        .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("taken") - F.col("whole") * F.col("size"))
        .select("doc_id", "source", "size", "source_size", "target", "whole", "part", "taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes as often in full as its source's rate and the draw say, so
    that what comes is whole; only the document at the edge of its source, one of
    each, comes once with its first ``part`` words (their white space kept), which
    makes the source's words exact. A document that takes no word does not come.
    What is drawn is computed from sizes and hashes, and applied in a second pass
    over the texts, so no text is shuffled (but rows equal in id and text that share
    an edge).
    """
    columns = docs.columns
    size, place = word_count(F.col("text")), ranked(F.col("doc_id"), F.col("text"), seed)
    with common.scratch(docs.sparkSession) as keep:
        per_source = keep(edges(materialize(docs.select("source", size.alias("size"), place.alias("place"))), weights, epochs))
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    # the first n words with the white space before them
    head = F.array_join(
        F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"([\\x20\\x09-\\x0D]*{common.WORD})"), 1), 1, part), ""
    )
    texts = F.concat(
        F.array_repeat(F.col("text"), whole), F.when(part > 0, F.array(head)).otherwise(F.expr("array()").cast("array<string>"))
    )
    given = docs.select(F.struct(*columns).alias("row"), F.col("source"), F.col("text"), size.alias("size"), place.alias("place"))
    out = (
        _taken(given, per_source)
        .where("taken > 0")
        .select(*(F.col(f"row.{c}") for c in columns if c != "text"), F.explode(texts).alias("text"))
    )
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return repetitions(docs).select("doc_id", "size", "source_size", "target", "taken")

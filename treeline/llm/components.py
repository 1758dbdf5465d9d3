"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every node of (a, b) links the smallest id it reaches.

    Large-star links each node's larger neighbours to its smallest neighbour,
    small-star its smaller neighbours and itself; both keep the components, and
    when neither changes anything every node is linked to its smallest one alone.
    Hubs are joined with their one-row minima, which Spark can split or broadcast;
    no neighbourhood is ever gathered in one place. Links with a null end or from a
    node to itself are passed over; repeated links count once. Without links there
    are no rows.
    """
    links = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(
            both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        least = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(
            F.explode(
                F.array(
                    F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        )
        links = materialize(small.select("e.hi", "e.lo").where("hi != lo").distinct())
    return links.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionAll(
        links.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    )

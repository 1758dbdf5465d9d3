"""Near-duplicate documents by MinHash.

A document's set is its distinct word shingles. Many universal hash minima make
a signature; bands of it are bucketed, pairs within a bucket are verified on the
signatures and then on the full sets, and connected components of the verified
links are found by large-star and small-star.

Documents with equal sets are one class, of which only the smallest id goes on,
so copies never meet. Within the buckets pairs are made in rounds: first each
class with the smallest id it shares a bucket with; then, in buckets that hold
several components, every member of the smaller ones with a random member of the
largest, in each of its buckets; at last what remains across components. A large
group of near copies has become one component by then, but for members that are
unlike most others. Small buckets make their pairs. Large ones make none: all
their rows that share a largest component are one group, its sets are dealt in
blocks of bounded size, and the members of the other components visit each block,
where an index of the block's shingles gives their exact intersections. So the
pairs of a group are never rows, and no pair across components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import common
from treeline.llm.common import materialize
from treeline.llm.components import components

SHINGLE = 5
#: A link needs 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: A pair at the threshold misses all bands with a chance of (1 - 0.75**5)**50, about 1 in 760,000.
BANDS, ROWS = 50, 5
#: Signatures estimate likeness with a deviation under 0.03; pairs more than six of them below the threshold go.
SIGNATURE_LEAST = 0.57
#: Turns in which members of a bucket's smaller components meet a random member of its largest.
RANDOM_ROUNDS = 2
#: Rows of a bucket that makes pairs in the end.
SMALL_BUCKET = 32
#: Shingles of a block and of the visitors it gets at a time, about.
BLOCK_SHINGLES = 1 << 17

_r = np.random.RandomState(41)
_MULTIPLY = _r.randint(1, 1 << 62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _r.randint(1, 1 << 62, BANDS * ROWS).astype(np.uint64)
_WEIGHTS = _r.randint(1, 1 << 62, SHINGLE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_WEIGHTS = _r.randint(1, 1 << 62, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _r.randint(1, 1 << 62, BANDS).astype(np.uint64)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (64 bits): runs of k words, or all words if there are fewer."""
    for _, texts in common.text_chunks(column):
        words, counts = common.word_hashes(texts)
        at = 0
        for n in counts.tolist():
            own = words[at : at + n]
            at += n
            if n == 0:
                yield own
                continue
            width = min(k, n)
            total = np.zeros(n - width + 1, np.uint64)
            for i in range(width):
                total += own[i : n - width + 1 + i] * _WEIGHTS[i]
            # the width goes in, so that a short text is no shingle of a long one
            yield np.unique(common.mix64(total + np.uint64(width)))


def minima(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """The universal hash minima of a set (not empty), 32 bits each: high half of (a * x + b) modulo 2**64."""
    out = None
    for i in range(0, len(shingles), block):
        x = shingles[i : i + block]
        low = ((_MULTIPLY[:, None] * x[None, :] + _ADD[:, None]) >> np.uint64(32)).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    return common.mix64((rows * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SALT).astype(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, firsts, seconds, signatures, bands = [], [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            # two independent sums identify a set
            firsts.append(int(common.mix64(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            seconds.append(int(common.mix64(s ^ _WEIGHTS[0]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
            if len(s):
                low = minima(s)
                signatures.append(low.astype(np.uint16).tobytes())
                bands.append(band_keys(low))
            else:
                signatures.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64()),
                pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["id", "n", "set1", "set2", "signature", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _alike_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sides = [
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, -1) for c in (2, 3)
        ]
        alike = (sides[0] == sides[1]).mean(axis=1) >= SIGNATURE_LEAST
        yield batch.select(["a", "b"]).filter(pa.array(alike))


def _alike_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    one = table.select(F.col("id").alias("a"), F.col(column).alias(f"{column}_a"), F.col("n").alias("n_a"))
    two = table.select(F.col("id").alias("b"), F.col(column).alias(f"{column}_b"), F.col("n").alias("n_b"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILAR).select(
        "a", "b", f"{column}_a", f"{column}_b"
    )


def verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes, signatures and full sets are alike enough."""
    alike = _with_both(pairs, sketches, "signature").mapInArrow(common.tidy(_alike_signatures), "a bigint, b bigint")
    alike = materialize(alike)
    return materialize(_with_both(alike, sets, "shingles").mapInArrow(common.tidy(_alike_sets), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Linked documents share a component; its id is the smallest doc_id in it, and
    the document with that id is kept. Documents without words or text have 0
    shingles and are components of their own. A row with a null id takes no part
    (component_id and kept are null). Repeated rows each give a row; rows of one id
    are one node of the graph. A likeness of exactly the threshold is a link. Whole
    texts are read; a text takes memory in proportion to its own length. Extra
    columns may have any names and are dropped; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    same = [F.col(c) == F.col(f"{c}_") for c in ("n", "set1", "set2")]
    with common.scratch(spark) as keep:
        sketches = materialize(
            rows.mapInArrow(common.tidy(_sketches), "id bigint, n bigint, set1 bigint, set2 bigint, signature binary, bands array<bigint>")
        )
        known = sketches.where(F.col("id").isNotNull() & (F.col("n") > 0))
        classes = materialize(known.groupBy("n", "set1", "set2").agg(F.min("id").alias("rep")))
        roots = _roots(rows, sketches, known, classes)
        of_class = materialize(
            classes.join(roots, F.col("rep") == F.col("id"), "left")
            .select(*(F.col(c).alias(f"{c}_") for c in ("n", "set1", "set2")), F.coalesce("root", "rep").alias("root"))
        )
        component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
        return keep(
            sketches.select("id", "n", "set1", "set2").join(of_class, same, "left").select(
                F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept")
            )
        )


def _roots(rows: DataFrame, sketches: DataFrame, known: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, root) of the class representatives that are linked with another one."""
    reps = known.join(
        classes.select(F.col("n").alias("n_"), F.col("set1").alias("set1_"), F.col("set2").alias("set2_"), "rep"),
        (F.col("id") == F.col("rep")) & (F.col("n") == F.col("n_")) & (F.col("set1") == F.col("set1_")) & (F.col("set2") == F.col("set2_")),
    ).select("id", F.explode("bands").alias("key")).distinct()
    buckets = materialize(reps.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "centre"))
    rows_in = materialize(reps.join(buckets, "key"))
    wanted = rows_in.select("id").distinct()
    sets = materialize(
        rows.join(wanted, "id", "left_semi")
        .mapInArrow(common.tidy(_sets), "id bigint, shingles binary")
        .select("id", (F.octet_length("shingles") / 8).cast("long").alias("n"), "shingles")
        .where("n > 0")
    )
    signed = known.join(wanted, "id", "left_semi").select("id", "n", "signature")

    # each class with the smallest one it shares a bucket with
    tried = materialize(
        rows_in.where("id != centre").groupBy("id").agg(F.min("centre").alias("a")).select("a", F.col("id").alias("b"))
    )
    roots = materialize(components(verified(tried, signed, sets)))
    for turn in range(RANDOM_ROUNDS + 1):
        # buckets that hold more than one component
        held = materialize(rows_in.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
        mixed = materialize(
            held.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        )
        held = materialize(held.join(mixed, "key"))
        if turn < RANDOM_ROUNDS:
            # of each bucket's largest component one member, drawn anew for each bucket and turn
            drawn = F.min_by("id", F.xxhash64(F.lit(turn), "key", "id"))
            parts = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"), drawn.alias("member"))
            largest = materialize(
                parts.groupBy("key").agg(F.max(F.struct("many", "root", "member")).alias("l"))
                .select("key", F.col("l.root").alias("root_"), F.col("l.member").alias("member"))
            )
            found = held.join(largest, "key").where("root != root_")
            pairs = found.select(F.least("id", "member").alias("a"), F.greatest("id", "member").alias("b")).distinct()
        else:
            many = materialize(held.groupBy("key").agg(F.count(F.lit(1)).alias("many")))
            large = materialize(held.join(many.where(F.col("many") > SMALL_BUCKET).select("key"), "key"))
            held = held.join(many.where(F.col("many") <= SMALL_BUCKET).select("key"), "key")
            other = held.select("key", F.col("id").alias("id_"), F.col("root").alias("root_"))
            found = held.join(other, "key").where((F.col("id") < F.col("id_")) & (F.col("root") != F.col("root_")))
            pairs = found.select(F.col("id").alias("a"), F.col("id_").alias("b")).distinct()
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionAll(pairs)
        links = verified(pairs, signed, sets)
        if turn == RANDOM_ROUNDS:
            links = links.unionAll(materialize(_block_links(large, signed, sets)))
        # the new links join components, so their graph is one of roots
        root_of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        joined = (
            links.join(root_of("a"), "a", "left")
            .join(root_of("b"), "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        )
        merged = materialize(components(joined))
        above = merged.select(F.col("id").alias("root"), F.col("root").alias("top"))
        roots = materialize(
            roots.join(above, "root", "left")
            .select("id", F.coalesce("top", "root").alias("root"))
            .unionAll(merged.join(roots.select("id"), "id", "left_anti"))
        )
    return roots


def _block_links(held: DataFrame, sizes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) across the components of large buckets (key, id, root), enough to join what is linked."""
    parts = held.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"))
    largest = parts.groupBy("key").agg(F.max(F.struct("many", "root")).alias("l")).select("key", F.col("l.root").alias("group"))
    rows = materialize(held.join(largest, "key").select("group", "id", "root").distinct().join(sizes.select("id", "n"), "id"))
    visits = F.col("root") != F.col("group")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.sum(n) / F.lit(BLOCK_SHINGLES))).cast("int")
    dealt = rows.join(rows.groupBy("group").agg(blocks("n").alias("blocks"), blocks(F.when(visits, F.col("n"))).alias("turns")), "group")
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt.select("group", "id", "root", place(0, "blocks").alias("block"), all_of("turns").alias("turn"), F.lit(False).alias("visits"))
    visitors = dealt.where(visits).select("group", "id", "root", all_of("blocks").alias("block"), place(1, "turns").alias("turn"), F.lit(True).alias("visits"))
    cells = members.unionAll(visitors).join(sets.select("id", "shingles"), "id")
    return cells.groupBy("group", "block", "turn").applyInArrow(_visited, "a bigint, b bigint")


def _visited(cell: pa.Table) -> pa.Table:
    """For each visitor and each other component that one of the block's members links it with, one link."""
    id_, root, visits = (cell.column(c).to_numpy() for c in ("id", "root", "visits"))
    sets = [np.frombuffer(x, np.uint64) for x in cell.column("shingles").to_pylist()]
    own = np.flatnonzero(~visits)
    n = np.array([len(sets[i]) for i in own], np.int64)
    flat = np.concatenate([sets[i] for i in own]) if len(own) else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, holder = flat[order], np.repeat(np.arange(len(own)), n)[order]
    a, b = [], []
    for v in np.flatnonzero(visits).tolist():
        lo, hi = np.searchsorted(flat, sets[v], side="left"), np.searchsorted(flat, sets[v], side="right")
        many = hi - lo
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)
        both = np.bincount(holder[at], minlength=len(own))
        linked = own[(100 * both >= SIMILAR * (len(sets[v]) + n - both)) & (root[own] != root[v])]
        _, one = np.unique(root[linked], return_index=True)
        a += [id_[v]] * len(one)
        b += id_[linked[one]].tolist()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents", "doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d
), u AS (SELECT doc_id, unnest(g) AS h FROM s),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM n JOIN m ON m.id = doc_id
"""

"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are turned into integers and summarised by the means and deviations of
their segments, coarse to fine. A squared distance is at least
sum of L * ((mean - mean')**2 + (dev - dev')**2) over segments of length L, which
with the norms bounds an inner product from above. A candidate whose bound lies
below the k-th best score found so far is dropped at the coarsest level that
shows it; each finer level is computed for the survivors alone, and their products
exactly in the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import common

SCALE = 256
TOP = 5
EVERY = 50
SEGMENTS = (1, 4, 16)
#: Queries sent to every task at once, in bytes of vectors; more of them go in further blocks.
QUERY_BLOCK_BYTES = 16 << 20
CANDIDATES = 2048
SEED_CANDIDATES = 128
#: Pairs whose finer bounds are computed at a time.
PAIRS = 1 << 16


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Per vector the segments' means and deviations, scaled so that plain distances of them bound distances of vectors."""
    parts = []
    for piece in np.array_split(x, min(segments, x.shape[1]), axis=1):
        root = np.sqrt(piece.shape[1])
        parts += [piece.mean(axis=1) * root, piece.std(axis=1) * root]
    return np.stack(parts, axis=1)


class Searcher:
    """The best ``k`` of a stream of candidates for each of a block of queries of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.norm = (x * x).sum(axis=1)
        self.levels = [summaries(x, s) for s in SEGMENTS if s < x.shape[1]]
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)
        #: Pairs whose bound was computed at each level, and those whose product was.
        self.bounded, self.exact = [0] * len(self.levels), 0

    def add(self, ids: np.ndarray, y: np.ndarray) -> None:
        # the first few candidates set the scores to beat
        for lo, hi in ((0, SEED_CANDIDATES), (SEED_CANDIDATES, len(ids))) if np.isinf(self.least).any() else ((0, len(ids)),):
            self._add(ids[lo:hi], y[lo:hi])

    def _add(self, ids: np.ndarray, y: np.ndarray) -> None:
        if not len(ids):
            return
        norm = (y * y).sum(axis=1)
        slack = 1e-3 + 1e-9 * float(self.norm.max(initial=0) + norm.max(initial=0))  # rounding
        q, c = np.nonzero(self.ids[:, None] != ids[None, :])  # not its own row
        for k, mine in enumerate(self.levels):
            self.bounded[k] += len(q)
            some, c_of = np.unique(c, return_inverse=True)
            level = summaries(y[some], SEGMENTS[k])
            # distance of summaries <= distance of vectors, so (|q|^2 + |y|^2 - distance) / 2 >= q.y
            own = (self.norm - (mine * mine).sum(axis=1)) / 2
            other = (norm[some] - (level * level).sum(axis=1)) / 2
            if len(q) * 2 > len(mine) * len(level):  # most pairs are left
                bound = (mine @ level.T)[q, c_of]
            else:
                bound = np.concatenate([
                    np.einsum("ij,ij->i", mine[q[lo : lo + PAIRS]], level[c_of[lo : lo + PAIRS]]) for lo in range(0, len(q), PAIRS)
                ] or [np.zeros(0)])
            alive = bound + own[q] + other[c_of] >= self.least[q] - slack
            q, c = q[alive], c[alive]
        edges = np.searchsorted(q, np.arange(len(self.ids) + 1))
        for q in np.flatnonzero(np.diff(edges)):
            at = c[edges[q] : edges[q + 1]]
            scores = self._products(y[at], self.x[q])
            self.exact += len(at)
            if len(at) > self.k:  # ties with the k-th best stay
                keep = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
                at, scores = at[keep], scores[keep]
            found = self.best[q] + list(zip(scores.tolist(), ids[at].tolist(), strict=True))
            found.sort(key=lambda p: (-p[0], p[1]))
            self.best[q] = found[: self.k]
            if len(self.best[q]) == self.k:
                self.least[q] = self.best[q][-1][0]

    @staticmethod
    def _products(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        if np.abs(y).max(initial=0) * max(np.abs(x).max(initial=0), 1) * len(x) < 2**53:
            return (y @ x).astype(np.int64)
        whole = [int(v) for v in x]
        return np.array([sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in y], object)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<double> of whole numbers); rows that hold a null or a non-finite component, or no id, are left out."""
    v = vectors[vector_col].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(vectors[id_col].cast("long").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))
    )


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each dimension that occurs in a batch of (id, v)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    v = batch.column(1)
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield ids[at], flat[(starts[at][:, None] + np.arange(d)[None, :])].reshape(len(at), d)


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = TOP,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best inner products among all other rows.

    ``is_query`` is a Column over ``id``. Ties go to the smaller id. Rows whose id
    or vector is null, or whose vector holds a null or non-finite component, take
    no part; vectors of another length are not candidates of a query, nor are rows
    with the query's own id; a repeated query row counts once, a repeated candidate
    row as often as it stands. Fewer than ``k`` candidates give fewer rows, an
    empty table none. Queries are sent to the tasks in blocks of bounded size, one
    block after the other. Other columns may have any names and are dropped. Scores
    are 64-bit integers; a product beyond them is an error, never a wrong score.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, scale)
    queries = rows.where(is_query).dropDuplicates(["id"])
    count, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    per_block = max(1, QUERY_BLOCK_BYTES // (8 * max(1, width)))
    blocks = -(-count // per_block) or 1
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    out = []
    with common.scratch(spark) as keep:
        for b in range(blocks):
            # one block of bounded size is on the driver and the executors at a time
            block = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow().combine_chunks()
            sent = spark.sparkContext.broadcast([m for batch in block.to_batches() for m in _matrices(batch)])
            found = rows.mapInArrow(_search(sent, k), "query_id bigint, vec_id bigint, score bigint")
            out.append(keep(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")))
            sent.destroy()
    return functools.reduce(DataFrame.unionByName, out)


def _search(sent, k: int):
    """Each task's best ``k`` candidates of every query sent."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grouped: dict[int, list] = {}
        for ids, x in sent.value:
            grouped.setdefault(x.shape[1], []).append((ids, x))
        searchers = {d: Searcher(np.concatenate([i for i, _ in m]), np.concatenate([x for _, x in m]), k) for d, m in grouped.items()}
        for batch in batches:
            for ids, y in _matrices(batch):
                if y.shape[1] in searchers:
                    searchers[y.shape[1]].add(ids, y)
        out = [(q, i, s) for f in searchers.values() for q, best in zip(f.ids.tolist(), f.best, strict=True) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return search


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, F.col("id") % EVERY == 0)


OP8_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT DISTINCT vec_id AS query_id, e AS qe FROM v WHERE vec_id % {EVERY} = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(qe, e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON vec_id <> query_id AND len(qe) = len(e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""

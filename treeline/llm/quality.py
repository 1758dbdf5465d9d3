"""A quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover the whole document.
Learned filters run over each chunk's embedded bytes and are max-pooled; the
pooled values of all chunks are joined by their mean and maximum, and a small
dense layer turns them into one probability. The network is fitted on the driver
on a bounded sample of labelled rows and sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import common

CHUNK, HOP = 512, 448
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 4, 48, 24  # a window is two strides wide
#: The labelled sample the network is fitted on: at most this many rows, none of more than this many bytes.
FIT_ROWS, FIT_BYTES = 3_000, 50_000
EPOCHS, BATCH, RATE = 12, 16, 0.005
LEAST_STEPS = 500
HELD_OUT_MODULUS = 5
THRESHOLD = 0.3


def chunks(text: bytes) -> np.ndarray:
    """(n, CHUNK) bytes: overlapping chunks over the whole text, the last padded with zeros; at least one."""
    n = max(1, -(-(len(text) - (CHUNK - HOP)) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class Network:
    """Parameters as a dict of arrays; forward and backward passes."""

    def __init__(self, seed: int = 5):
        r = np.random.RandomState(seed)
        f4 = lambda *shape, scale: (r.randn(*shape) * scale).astype(np.float32)
        self.p = {
            "embed": f4(256, EMBED, scale=0.5),
            "filters": f4(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32),
            "dense": f4(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
            "dense_shift": np.zeros(HIDDEN, np.float32),
            "out": f4(HIDDEN, scale=HIDDEN**-0.5),
            "out_shift": np.zeros(1, np.float32),
        }

    def pooled(self, rows: np.ndarray, keep: bool = False):
        """Max-pooled filter responses of chunks; with ``keep`` also what the backward pass needs."""
        n, half = len(rows), STRIDE * EMBED
        x = np.take(self.p["embed"], rows.reshape(-1), axis=0).reshape(n, CHUNK // STRIDE, half)
        # a window's response is that of its first half plus that of its second: no windows are copied
        both = x.reshape(-1, half) @ np.concatenate([self.p["filters"][:half], self.p["filters"][half:]], axis=1)
        both = both.reshape(n, CHUNK // STRIDE, 2 * FILTERS)
        response = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
        if not keep:
            return np.maximum(response.max(axis=1) + self.p["shift"], 0)
        response = np.ascontiguousarray(response.transpose(0, 2, 1))
        at = response.argmax(axis=2)
        best = np.take_along_axis(response, at[:, :, None], axis=2)[:, :, 0] + self.p["shift"]
        return np.maximum(best, 0), (rows, x, at, best > 0)

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = features @ self.p["dense"] + self.p["dense_shift"]
        hidden = np.maximum(hidden, 0.1 * hidden)
        return hidden, hidden @ self.p["out"] + self.p["out_shift"]

    @staticmethod
    def join(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean and maximum over each document's chunks."""
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        return np.concatenate([np.add.reduceat(h, starts) / counts[:, None], np.maximum.reduceat(h, starts)], axis=1)

    def scores(self, texts: list[bytes], step: int = 128) -> np.ndarray:
        """Probabilities of label 1. Works through ``step`` chunks at a time, however long the texts are."""
        total, most, counts = [], [], []
        pending: list[np.ndarray] = []
        owners: list[int] = []

        def flush():
            if pending:
                h = self.pooled(np.concatenate(pending))
                o = np.array(owners)
                starts = np.flatnonzero(np.diff(o, prepend=-1))
                for d, s, m in zip(o[starts], np.add.reduceat(h, starts), np.maximum.reduceat(h, starts), strict=True):
                    total[d] = total[d] + s
                    most[d] = np.maximum(most[d], m)
                pending.clear()
                owners.clear()

        for d, text in enumerate(texts):
            rows = chunks(text)
            counts.append(len(rows))
            total.append(0.0)
            most.append(np.zeros(FILTERS, np.float32))
            for i in range(0, len(rows), step):
                pending.append(rows[i : i + step])
                owners += [d] * len(pending[-1])
                if len(owners) >= step:
                    flush()
        flush()
        if not texts:
            return np.zeros(0)
        features = np.concatenate([np.stack(total) / np.array(counts)[:, None], np.stack(most)], axis=1)
        z = self.head(features.astype(np.float32))[1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        parts = [chunks(t) for t in texts]
        counts = np.array([len(c) for c in parts])
        h, (rows, x, at, live) = self.pooled(np.concatenate(parts), keep=True)
        features = self.join(h, counts)
        hidden, z = self.head(features)
        dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels).astype(np.float32) / len(labels)
        g = {"out": hidden.T @ dz, "out_shift": dz.sum(keepdims=True)}
        dh = dz[:, None] * self.p["out"] * np.where(hidden > 0, 1, 0.1).astype(np.float32)
        g["dense"], g["dense_shift"] = features.T @ dh, dh.sum(axis=0)
        df = dh @ self.p["dense"].T
        owner = np.repeat(np.arange(len(counts)), counts)
        peak = (h == features[owner, FILTERS:]).astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        peak /= np.add.reduceat(peak, starts)[owner]  # chunks that share the maximum share its gradient
        dpool = df[owner, :FILTERS] / counts[owner, None] + df[owner, FILTERS:] * peak
        dpool *= live
        g["shift"] = dpool.sum(axis=0)
        # only the window that was the maximum carries a gradient
        n = np.arange(len(rows))[:, None]
        chosen = np.concatenate([x[n, at], x[n, at + 1]], axis=2)
        g["filters"] = np.einsum("nfs,nf->sf", chosen, dpool, optimize=True)
        dx = (dpool[:, :, None] * self.p["filters"].T[None]).reshape(-1, EMBED)
        seen = rows[n[:, :, None], at[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
        g["embed"] = np.stack([np.bincount(seen, dx[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
        return g


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the logistic loss. Without labels the network scores everything 0.5."""
    net = Network(seed)
    if not texts:
        net.p["out"][:] = 0
        return net
    y = np.array(labels, np.float32)
    net.p["out_shift"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    order = np.random.RandomState(seed + 1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    per_epoch = -(-len(y) // BATCH)
    epochs = max(epochs, -(-LEAST_STEPS // per_epoch))  # small samples are gone through more often
    steps = epochs * per_epoch
    t = 0
    for _ in range(epochs):
        at = order.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = at[i : i + BATCH]
            t += 1
            rate = RATE * (1 - 0.95 * t / steps)
            for k, g in net.gradients([texts[j] for j in pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled texts, drawn by a hash of the id; held-out rows never."""
    known = labels.select(labels["doc_id"].alias("label_id"), labels["quality"].cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & (common.crc_mod("label_id", HELD_OUT_MODULUS) != 0)
    )
    # ids alone are ordered; the sample is bounded, so is what is broadcast
    drawn = known.orderBy(F.xxhash64(F.lit(3), "label_id"), "label_id", "quality").limit(rows)
    texts = docs.select(docs["doc_id"], docs["text"]).where(F.octet_length("text") <= FIT_BYTES)
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality").toArrow()
    found = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))[:rows]
    return [t.encode() for _, t, _ in found], [q for _, _, q in found]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted; nothing but the text decides a score.

    A null text is scored as an empty one. A null id is not held out; repeated
    rows each give a row; extra columns are dropped; an empty table gives an empty
    result. Rows of ``labels`` with a null or other quality than 0 and 1 are not
    learned from; a repeated label counts as often as it stands.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    net = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels)).p)  # some 20 kB
    rows = docs.select(
        docs["doc_id"].alias("id"),
        F.coalesce(common.crc_mod("doc_id", HELD_OUT_MODULUS) == 0, F.lit(False)).alias("held_out"),
        docs["text"].cast("string").alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = net.value
        for batch in batches:
            s = own.scores([(t or "").encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text the classifier does not reject, with all their columns, in one pass."""
    spark = docs.sparkSession
    common.small_batches(spark)
    net = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels)).p)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = net.value
        for batch in batches:
            s = own.scores([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(common.tidy(keep), docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(
        common.read(spark, sf_dir, "documents", "doc_id", "text"),
        common.read(spark, sf_dir, "labels", "doc_id", "quality"),
    )

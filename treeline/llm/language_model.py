"""Language-model scores by deleted interpolation.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), where the weights
l2, l1, l0 depend on the bucket of the context's frequency c(v): its bit length.
The weights are learned by expectation-maximisation on held-out counts, each
training event in turn held out of all counts: (c(v w) - 1) / (c(v) - 1) and so on.

Words are counted first. The most frequent ones, all if they are few enough, are
known to every task; the others are rare, and a document that has some carries their
numbers, which follow their counts' order, so that a number tells its count. Each
word pair is two word numbers in one integer; pairs
are counted in one shuffle of compact columns (counts already summed within a
task), which also gives the events for the weights. A second shuffle carries the
pairs of each document to where their counts are and brings back partial sums of
log probabilities by document. Pairs that are very frequent are looked up in a
bounded table instead and never shuffled, so no pair gathers many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm import common
from treeline.llm.common import materialize

HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 7, 2
#: Word counts are sent to every task up to this many words (12 bytes each), the most frequent; numbers of rarer words are joined to the documents.
BROADCAST_WORDS = 10_000_000
#: Rare words of one count are numbered in so many parts.
RARE_PARTS = 1024
#: Pairs that make up more than one in this many of all are in the table of frequent pairs, so it has at most as many rows.
FREQUENT_PAIRS = 1 << 19
TOKENS_AT_ONCE = 3 << 18
ENTRIES_PER_PARTITION = 2_000_000
BUCKETS = 64
#: Ratios to the uniform probability are binned to a 40th of a power of ten for learning the weights.
BINS = 40
LEAST_UNIFORM = 1e-4
_ZERO = -(1 << 20)


class Vocabulary:
    """Word counts by number: words in order of hash, then the end, the start and the unknown word, then rare words in order of count.

    ``starts`` and ``classes`` are the places among the rare words where each count begins, and these counts.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, starts: np.ndarray, classes: np.ndarray, documents: int):
        self.words, self.starts, self.classes = words, starts, classes
        self.end, self.start, self.unknown = len(words), len(words) + 1, len(words) + 2
        self.counts = np.concatenate([counts, [documents, documents, 0]]).astype(np.int64)

    def numbers(self, hashes: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Numbers of words by their hashes; rare: hashes and places of the rare words that may be among them."""
        distinct, inverse = np.unique(hashes, return_inverse=True)  # sorted look-ups stay in cache
        found = np.full(len(distinct), self.unknown)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            found = np.where(self.words[at] == distinct, at, found)
        if rare and len(rare[0]):
            words, first = np.unique(rare[0], return_index=True)
            at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
            found = np.where(words[at] == distinct, self.unknown + 1 + rare[1][first][at], found)
        return found[inverse]

    def count(self, numbers: np.ndarray) -> np.ndarray:
        found = self.counts[np.minimum(numbers, self.unknown)]
        if len(self.starts):
            rare = np.flatnonzero(numbers > self.unknown)
            found[rare] = self.classes[np.searchsorted(self.starts, numbers[rare] - self.unknown - 1, side="right") - 1]
        return found

    def pairs(self, texts: list[bytes], rare: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, second word) of every token of the texts, the ends included."""
        hashes, counts = common.word_hashes(texts)
        text = np.repeat(np.arange(len(texts)), counts + 1)
        ends = np.cumsum(counts + 1) - 1
        second = np.full(len(text), self.end)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        second[inside] = self.numbers(hashes, rare)
        first = np.concatenate(([self.start], second[:-1]))
        first[ends[:-1] + 1] = self.start
        return text, first, second


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 32 | second.astype(np.int64)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (common.mix64(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _blobs(columns: list[np.ndarray], key: np.ndarray, parts: int):
    """Deal columns by key: yields (part, n, packed key differences, other packed columns)."""
    part = _part(key, parts)
    order = np.lexsort((key, part))
    part, key, columns = part[order], key[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    for lo, hi in zip(edge, np.append(edge[1:], len(part)), strict=True):
        yield int(part[lo]), hi - lo, common.pack(np.diff(key[lo:hi], prepend=0)), [common.pack(c[lo:hi]) for c in columns]


class Weights:
    """The interpolation of one corpus: counts' totals and the weights of each bucket."""

    def __init__(self, tokens: int, distinct: int, table: np.ndarray):
        self.tokens, self.distinct, self.table = tokens, distinct, table

    def log10(self, pair: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log probabilities from the counts of a pair, its first and its second word."""
        l2, l1, l0 = self.table[bucket(first)].T
        p = l2 * pair / np.maximum(first, 1) + l1 * second / max(1, self.tokens) + l0 / (self.distinct + 1)
        return np.log10(p)


def bucket(count: np.ndarray) -> np.ndarray:
    """Bit length of a count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def learn(cells: list[tuple[int, int, int, int]], rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights by expectation-maximisation on binned events (bucket, bin of pair ratio, bin of word ratio, number)."""
    table = np.tile(np.array([0.3, 0.5, 0.2]), (BUCKETS, 1))
    by: dict[int, list] = {}
    for b, pair, word, n in cells:
        by.setdefault(b, []).append((pair, word, n))
    for b, rows in by.items():
        a = np.array(rows, float)
        ratio = lambda x: np.where(x <= _ZERO, 0.0, 10 ** (x / BINS))
        r = np.stack([ratio(a[:, 0]), ratio(a[:, 1]), np.ones(len(a))], axis=1)
        w = table[b]
        for _ in range(rounds):
            share = r * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * a[:, 2:]).sum(axis=0) / a[:, 2].sum()
            w[2] = max(w[2], LEAST_UNIFORM)
            w /= w.sum()
        table[b] = w
    table[0, 1] += table[0, 0]  # an unseen context has no pair counts
    table[0, 0] = 0
    return table


def _batches_of(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20):
    """Yield (record batch, first row, texts) in pieces of bounded size."""
    for batch in batches:
        for first, texts in common.text_chunks(batch.column(0), limit):
            yield batch, first, texts


class Model:
    """A scorer of documents learned from training documents; ``documents`` rows are (text, training, key columns)."""

    def __init__(self, rows: DataFrame, broadcast_words: int = BROADCAST_WORDS):
        spark = self.spark = rows.sparkSession
        training = rows.where("training")
        counts = materialize(common.count_words(training))
        words, self.distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.documents = training.count()
        self.tokens = words + self.documents
        least, starts, classes, rare = 1, *np.zeros((2, 0), np.int64), None
        if self.distinct > broadcast_words:
            least, starts, classes, rare = self._rare(counts, broadcast_words)
        found = counts.where(F.col("n") >= least).toArrow()
        w, n = found.column("word").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.int32)
        del found
        order = np.argsort(w)
        self.sent = spark.sparkContext.broadcast((w[order], n[order], starts, classes))
        del w, n, order
        if rare is None:
            self.rows = rows.withColumn("known", F.lit(None).cast("array<struct<word:bigint,place:bigint>>"))
        else:
            self.rows = self._joined(rows, rare)
        self.distinct += self.documents > 0  # the end
        self.partitions = max(1, -(-self.tokens // ENTRIES_PER_PARTITION))
        self.parts = max(64, 2 * self.partitions)
        self._count_pairs()

    def _rare(self, counts: DataFrame, broadcast_words: int) -> tuple[int, np.ndarray, np.ndarray, DataFrame]:
        """The least count of words sent to every task; of the rarer ones, where each count begins, these counts, and (word, place)."""
        # the words' number is at least the sum of the different counts, so these are few
        classes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow().sort_by([("n", "descending")])
        n, words = (classes.column(c).to_numpy() for c in ("n", "words"))
        sent = int(np.searchsorted(np.cumsum(words), broadcast_words, side="right"))
        least = int(n[sent - 1]) if sent else int(n[0]) + 1
        n, words = n[sent:][::-1], words[sent:][::-1]
        starts = np.cumsum(words) - words
        rare = counts.where(F.col("n") < least).withColumn("part_", F.pmod("word", F.lit(RARE_PARTS)))
        # a row for each rare count and part, not for each word, goes through this ordering
        order = Window.orderBy("n", "part_").rowsBetween(Window.unboundedPreceding, -1)
        parts = rare.groupBy("n", "part_").agg(F.count(F.lit(1)).alias("words"))
        parts = common.few(materialize(parts.select("n", "part_", F.coalesce(F.sum("words").over(order), F.lit(0)).alias("before"))))
        place = F.col("before") + F.row_number().over(Window.partitionBy("n", "part_").orderBy("word")) - 1
        return least, starts, n, materialize(rare.join(parts, ["n", "part_"]).select("word", place.cast("long").alias("place")))

    def _joined(self, rows: DataFrame, rare: DataFrame) -> DataFrame:
        """The rows with the places of their own rare words as a list."""
        sent, documents = self.sent, self.documents

        def words(batches):
            vocabulary = Vocabulary(*sent.value, documents)
            for batch in batches:
                row = batch.column(1).to_numpy()
                for first, texts in common.text_chunks(batch.column(0)):
                    hashes, n = common.word_hashes(texts)
                    rest = vocabulary.numbers(hashes) == vocabulary.unknown
                    of, word = np.repeat(row[first : first + len(texts)], n)[rest], hashes.view(np.int64)[rest]
                    order = np.lexsort((word, of))
                    of, word = of[order], word[order]
                    new = np.ones(len(of), bool)
                    new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(of[new]), pa.array(word[new])], names=["of_row", "word"])

        known = (
            rows.select("text", "row_").mapInArrow(words, "of_row bigint, word bigint").join(rare, "word")
            .groupBy("of_row").agg(F.collect_list(F.struct("word", "place")).alias("known"))
        )
        joined = materialize(rows.join(known, F.col("row_") == F.col("of_row"), "left").drop("of_row"))
        common.release(self.spark)
        return joined

    def _chunks(self):
        """A function that yields (batch, first row, number of texts, text numbers, counts of both words, keys) for batches with ``known``."""
        sent, documents = self.sent, self.documents

        def run(batches):
            vocabulary = Vocabulary(*sent.value, documents)
            for batch, at, texts in _batches_of(batches):
                known = batch.column(batch.schema.get_field_index("known")).slice(at, len(texts)).flatten()
                word, place = (c.to_numpy(zero_copy_only=False) for c in known.flatten())
                text, first, second = vocabulary.pairs(texts, (word.view(np.uint64), place))
                yield batch, at, len(texts), text, vocabulary.count(first), vocabulary.count(second), _key(first, second)

        return run

    def _count_pairs(self) -> None:
        chunks, parts = self._chunks(), self.parts
        sent, documents, tokens, distinct = self.sent, self.documents, self.tokens, self.distinct
        least = max(2, tokens // FREQUENT_PAIRS)

        def pairs(batches):
            held: list[np.ndarray] = []

            def flush():
                key, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                rows = list(_blobs([n.astype(np.uint32)], key, parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
                     pa.array([r[3] for r in rows], pa.list_(pa.binary()))],
                    names=["part", "n", "keys", "more"],
                )

            size = 0
            for *_, key in chunks(batches):
                held.append(key)
                size += len(key)
                if size >= TOKENS_AT_ONCE:
                    yield from flush()
                    size = 0
            if held:
                yield from flush()

        def count(batches):
            vocabulary = Vocabulary(*sent.value, documents)
            total: dict[tuple[int, int, int], int] = {}
            frequent: list[tuple[int, int]] = []
            for key, n in _merged(batches):
                order = np.argsort(key, kind="stable")
                key = key[order]
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                c = np.add.reduceat(n[order].astype(np.int64), at)
                key = key[at]
                c1, c2 = vocabulary.count(key >> 32), vocabulary.count(key & 0xFFFFFFFF)
                often = c >= least
                frequent += zip(key[often].tolist(), c[often].tolist(), strict=True)
                # each event held out of all counts
                uniform = np.log10(1 / (distinct + 1))
                with np.errstate(divide="ignore"):
                    f2 = np.log10((c - 1) / np.maximum(c1 - 1, 1)) - uniform
                    f1 = np.log10((c2 - 1) / max(1, tokens - 1)) - uniform
                b2 = np.where(c > 1, np.round(np.where(c > 1, f2, 0) * BINS), _ZERO).astype(np.int64)
                b1 = np.where(c2 > 1, np.round(np.where(c2 > 1, f1, 0) * BINS), _ZERO).astype(np.int64)
                cell = np.stack([bucket(c1 - 1), b2, b1], axis=1)
                cell, inverse = np.unique(cell, axis=0, return_inverse=True)
                n = np.bincount(inverse.reshape(-1), c)
                for k, m in zip(map(tuple, cell.tolist()), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + int(m)
            out = [(0, *k, n) for k, n in total.items()] + [(1, k, 0, 0, n) for k, n in frequent]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["kind", "a", "b", "c", "n"]
            )

        dealt = self.rows.where("training").select("text", "known").mapInArrow(pairs, "part bigint, n bigint, keys binary, more array<binary>")
        found = materialize(
            dealt.repartition(self.partitions, "part").mapInArrow(count, "kind bigint, a bigint, b bigint, c bigint, n bigint")
            .groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))
        )
        cells = found.where("kind = 0").select("a", "b", "c", "n").collect()  # bounded by buckets and bins
        self.weights = Weights(self.tokens, self.distinct, learn([tuple(r) for r in cells]))
        often = found.where("kind = 1").select("a", "n").toArrow()  # at most FREQUENT_PAIRS rows
        key = often.column("a").to_numpy()
        order = np.argsort(key)
        self.frequent = self.spark.sparkContext.broadcast((key[order], often.column("n").to_numpy()[order]))

    def scores(self) -> DataFrame:
        """Per row: row, doc_id, held_out, n_tokens, n_known, base_score, part; and the rest of the score by row, as two tables."""
        chunks, parts = self._chunks(), self.parts
        sent, documents, tokens, distinct = self.sent, self.documents, self.tokens, self.distinct
        weights, frequent = self.weights, self.frequent
        doc_parts = max(64, self.documents // 5_000)
        doc_partitions = max(1, doc_parts // 16)
        rows = self.rows.select("text", "known", "row_", "doc_id", "held_out", "training")

        def looked_up(c1, c2, key):
            """The tokens' pair counts so far as they are known here, and where they are: frequent pairs, and those with an unseen word."""
            keys, counts = frequent.value
            pair = np.zeros(len(key), np.int64)
            if len(keys):
                i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                pair = np.where(keys[i] == key, counts[i], 0)
            return pair, (pair > 0) | (c1 == 0) | (c2 == 0)

        def per_row(batches):
            for batch, at, n, text, c1, c2, key in chunks(batches):
                pair, known = looked_up(c1, c2, key)
                part = np.bincount(text[known], weights.log10(pair[known], c1[known], c2[known]), n)
                base = np.bincount(text, np.log10((c2 + 1) / (tokens + distinct + 1)), n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[at : at + n] for c in (2, 3, 4)),
                        pa.array(np.bincount(text, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(text[c2 > 0], minlength=n).astype(np.int64)),
                        pa.array(base, pa.float64()), pa.array(part.astype(np.float64)),  # bincount of nothing gives integers
                    ],
                    names=["row_", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "part"],
                )

        def pairs(batches):
            """Blobs of (key, times and whether for training, row)."""
            held, size = [], 0

            def flush():
                key, row, train = (np.concatenate(c) for c in zip(*held, strict=True))
                held.clear()
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
                n = 2 * np.diff(np.append(at, len(key))) + train[order][at]
                out = list(_blobs([n.astype(np.uint32), row[at]], key[at], parts))
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())))],
                    names=["part", "n", "keys", "more"],
                )

            for batch, at, n, text, c1, c2, key in chunks(batches):
                _, known = looked_up(c1, c2, key)
                rest = ~known
                row, train = (batch.column(c)[at : at + n].to_numpy(zero_copy_only=False)[text[rest]] for c in (2, 5))
                held.append((key[rest], row, train))
                size += len(row)
                if size >= TOKENS_AT_ONCE:
                    yield flush()
                    size = 0
            if size:
                yield flush()

        def sums(batches):
            vocabulary = Vocabulary(*sent.value, documents)
            rows, values = [], []
            for key, n, row in _merged(batches, rows=True):
                order = np.argsort(key, kind="stable")
                key, n, row = key[order], n[order].astype(np.int64), row[order]
                n, train = n >> 1, n & 1
                head = np.concatenate(([True], key[1:] != key[:-1]))
                at = np.flatnonzero(head)
                pair = np.add.reduceat(n * train, at)[np.cumsum(head) - 1]
                c1, c2 = vocabulary.count(key >> 32), vocabulary.count(key & 0xFFFFFFFF)
                row, value = _summed([row], [weights.log10(pair, c1, c2) * n])
                rows.append(row)
                values.append(value)
            if not rows:
                return
            rows, values = _summed(rows, values)
            part = _part(rows, doc_parts)
            order = np.argsort(part, kind="stable")
            part, rows, values = part[order], rows[order], values[order]
            edge = np.flatnonzero(np.diff(part, prepend=-1))
            spans = list(zip(edge, np.append(edge[1:], len(part)), strict=True))
            packed = [[common.pack(np.diff(rows[lo:hi], prepend=0)), values[lo:hi].tobytes()] for lo, hi in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[edge]), pa.array([int(hi - lo) for lo, hi in spans], pa.int64()), pa.array(packed, pa.list_(pa.binary()))],
                names=["part", "n", "columns"],
            )

        def merged(batches):
            """One sum for each row from the packed partial sums of all word pairs' parts."""
            parts: dict[int, list] = {}
            for batch in batches:
                for part, n, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    parts.setdefault(part, []).append((n, columns))
            for blobs in parts.values():
                rows, values = _summed(
                    [np.cumsum(common.unpack(c[0], n, np.int64)) for n, c in blobs], [np.frombuffer(c[1]) for _, c in blobs]
                )
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(values)], names=["of_row", "rest"])

        stats = rows.mapInArrow(
            per_row, "row_ bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, part double"
        )
        rest = (
            rows.mapInArrow(pairs, "part bigint, n bigint, keys binary, more array<binary>")
            .repartition(self.partitions, "part")
            .mapInArrow(sums, "part bigint, n bigint, columns array<binary>")
            .repartition(doc_partitions, "part")
            .mapInArrow(merged, "of_row bigint, rest double")
        )
        return stats, rest


def _summed(rows: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    """Values added up by row; rows in order."""
    rows, values = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), rows[1:] != rows[:-1])))
    return rows[at], np.add.reduceat(values[order], at) if len(at) else values


def _merged(batches, rows: bool = False):
    """The blobs of each part of a partition, one part at a time: key, counts, and rows if they are there."""
    parts: dict[int, list] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.setdefault(row[0], []).append(row[1:])
    while parts:
        blobs = parts.popitem()[1]
        key = np.concatenate([np.cumsum(common.unpack(k, n, np.int64)) for n, k, _ in blobs])
        kinds = [np.uint32] + [np.int64] * rows
        yield key, *(np.concatenate([common.unpack(m[i], n, kind) for n, _, m in blobs]) for i, kind in enumerate(kinds))


def score(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty: its end alone is scored. A row with a null id is
    for training. Repeated rows each give a row, and count as often as they stand;
    so do rows that share an id or have none. Whole texts are read; a text takes
    memory in proportion to its length. Extra columns of any name are dropped; an empty table gives an empty result. Without
    training documents every token is unknown and scores as uniform.
    """
    with common.scratch(docs.sparkSession) as keep:
        numbered = common.with_rows(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
        held_out = F.coalesce(common.crc_mod("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REMAINDER, F.lit(False))
        rows = numbered.select(
            "text", F.col("doc_id").cast("long").alias("doc_id"), "row_", held_out.alias("held_out"), (~held_out).alias("training")
        )
        model = Model(rows, broadcast_words)
        stats, rest = model.scores()
        joined = stats.join(rest, F.col("row_") == F.col("of_row"), "left")
        return keep(
            joined.select(
                "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score",
                (F.col("part") + F.coalesce("rest", F.lit(0.0))).alias("score"),
            )
        )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents", "doc_id", "text"))

"""Near-duplicate lines across documents, by an exact set-similarity join.

A line is the set of its words. Its words are ordered by rarity, so that two
lines of likeness t or more share one of their rarest n - ceil(t * n) + 1 words:
the prefix. The first lines of the distinct sets are dealt by prefix words; a
pair in a bucket passes a positional filter, which takes the shared word as the
first that the two share and so holds the length filter as well, and a parity
filter. Neither drops a true pair: each has one bucket whose word is its first
shared one. Survivors are verified on the full sets. A line goes when an earlier
line (by document, then line number) matches it, whether that one stays or goes.

For each line and bucket only the earliest few passing partners are sent on, as
one match decides. A line none of whose partners is verified, but which has more,
is looked at again with many times as many, until it is decided. So a large group
of like lines makes no pairs among itself, and no line is left undecided.

Rarity is the count, over all texts, of the words that share a hash bucket; any
fixed order gives the same result, so the table's size need not grow with the
corpus. Words are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import common
from treeline.llm.common import materialize

SIMILAR = 75
#: Hash buckets of the table of counts, one byte each where it is sent to every task.
COUNTED = 1 << 23
#: Parts of that table when it is summed.
RANGES = 256
#: Partners sent on at first for a line in a bucket, and how many times as many in each further look.
PARTNERS, MORE = 1, 16
#: Words counted this often or more are dealt by word and line length.
HOT_COUNT = 1 << 15
#: Pairs compared at a time.
PAIR_BLOCK = 1 << 18
#: Lines or words sent to every task, at most; beyond, they are joined.
BROADCAST_LINES = 1 << 20
#: Prefix rows in a part, about.
ROWS_PER_PART = 250_000
#: Prefix rows a task packs together.
ROWS_AT_ONCE = 1 << 18

KINDS = {"cell": np.int64, "doc": np.int64, "line": np.int32, "key": np.int64, "n": np.int32, "at": np.int32, "even": np.int64, "odd": np.int64, "home": np.int8}
PREFIX = "cell bigint, doc bigint, line int, key bigint, n int, at int, even bigint, odd bigint, home tinyint"
#: Lengths where a size band ends: two lines of likeness SIMILAR are in the same band or in neighbours.
_BANDS = (100 / SIMILAR) ** np.arange(1, 80)
_SECOND = np.uint64(0x5851F42D4C957F2D)


def _level(counts: np.ndarray) -> np.ndarray:
    """One byte that grows with the count: itself below 100, then five steps for each doubling."""
    high = 100 + np.floor(5 * np.log2(np.maximum(counts, 100) / 100))
    return np.where(counts < 100, counts, np.minimum(high, 255)).astype(np.uint8)


HOT = int(_level(np.array([HOT_COUNT]))[0])


def _heads(values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    out = np.ones(len(values), bool)
    if len(values):
        out[1:] = values[1:] != values[:-1]
        for v in more:
            out[1:] |= v[1:] != v[:-1]
    return out


def _dense(values: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones."""
    order = np.argsort(values)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(_heads(values[order])) - 1
    return out


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)


class LineSets:
    """The word sets of some lines, each ordered by rarity. Lines without words are left out."""

    def __init__(self, lines: pa.Array, levels: np.ndarray | None = None):
        code, n, hashes = common.words_of(lines)
        self.counted = np.bincount(code, minlength=len(hashes)), hashes
        level = levels[_bucket(hashes)] if levels is not None else np.zeros(len(hashes), np.uint8)
        order = np.lexsort((hashes, level))
        rank = np.empty(len(hashes), np.int64)
        rank[order] = np.arange(len(hashes))
        # (line, rank) in one integer: sorting it orders each line's words, and equal ones meet
        bits = len(hashes).bit_length()
        both = np.repeat(np.arange(len(n), dtype=np.int64) << bits, n)
        both += rank[code]
        both.sort()
        both = both[_heads(both)]
        line, self.at = both >> bits, order[both & ((1 << bits) - 1)]
        self.hashes, self.level = hashes, level
        self.starts = np.flatnonzero(_heads(line))
        self.n = np.diff(np.append(self.starts, len(line)))
        self.line = line[self.starts]

    @classmethod
    def of_texts(cls, texts: pa.Array, levels: np.ndarray | None = None) -> LineSets:
        """Of all lines; ``text`` and ``number`` say which text each is in and its number there."""
        split = pc.split_pattern(texts, "\n")
        per_text = np.diff(split.offsets.to_numpy())
        out = cls(split.flatten(), levels)
        ends = np.cumsum(per_text)
        out.text = np.searchsorted(ends, out.line, side="right")
        out.number = (out.line - (ends - per_text)[out.text]).astype(np.int32)
        return out

    def __len__(self) -> int:
        return len(self.starts)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.int64)
        return common.mix64(np.add.reduceat(values[self.at], self.starts) + self.n.astype(np.uint64)).view(np.int64)

    def keys(self) -> np.ndarray:
        """64-bit identity of each line's set."""
        return self._sums(common.mix64(self.hashes))

    def second_keys(self) -> np.ndarray:
        """64 bits more of it."""
        return self._sums(common.mix64(self.hashes ^ _SECOND))

    def parities(self) -> list[np.ndarray]:
        """128 bits: the parity of the number of words in each of 128 groups of words."""
        bit = np.uint64(1) << (self.hashes & np.uint64(63))
        high = (self.hashes & np.uint64(64)) != 0
        return [
            np.bitwise_xor.reduceat(np.where(high == side, bit, np.uint64(0))[self.at], self.starts).view(np.int64)
            for side in (False, True)
        ]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, line, key, key2, n, again) of each line; then, by range of hash buckets, the words counted (part, size, buckets, counts).

    ``again``: an earlier line of the same text has the same set.
    """
    total = np.zeros(COUNTED, np.uint32)
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        for first, texts in common.text_slices(batch.column(1)):
            s = LineSets.of_texts(texts)
            np.add.at(total, _bucket(s.counted[1]), s.counted[0].astype(np.uint32))
            if len(s):
                key, key2 = s.keys(), s.second_keys()
                by = np.lexsort((s.number, key2, key, s.text))
                again = np.empty(len(s), bool)
                again[by] = ~_heads(s.text[by], key[by], key2[by])
                yield _rows(doc=docs[first + s.text], line=s.number, key=key, key2=key2, n=s.n.astype(np.int32), again=again)
    at = np.flatnonzero(total)
    edges = np.searchsorted(at, np.arange(RANGES + 1) * (COUNTED // RANGES))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        own = at[edges[k] : edges[k + 1]]
        yield _rows(
            part=np.array([k], np.int32), size=np.array([len(own)], np.int32),
            buckets=pa.array([common.pack(np.diff(own, prepend=0).astype(np.int32))]), counts=pa.array([common.pack(total[own])]),
        )


FIRST = {"doc": pa.int64(), "line": pa.int32(), "key": pa.int64(), "key2": pa.int64(), "n": pa.int32(), "again": pa.bool_(), "part": pa.int32(), "size": pa.int32(), "buckets": pa.binary(), "counts": pa.binary()}
FIRST_SCHEMA = "doc bigint, line int, key bigint, key2 bigint, n int, again boolean, part int, size int, buckets binary, counts binary"


def _rows(**columns) -> pa.RecordBatch:
    length = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], kind) if k in columns else pa.nulls(length, kind) for k, kind in FIRST.items()], names=list(FIRST)
    )


def _levels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, levels): the summed counts of a range, as one byte for each bucket."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, size, buckets, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(part, np.zeros(COUNTED // RANGES, np.int64))
            own[np.cumsum(common.unpack(buckets, size, np.int32).astype(np.int64)) - part * len(own)] += common.unpack(counts, size, np.uint32)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([_level(v).tobytes() for v in sums.values()], pa.binary())], names=["part", "levels"]
    )


def _levels(first: DataFrame) -> np.ndarray:
    """The table of levels: COUNTED bytes, whatever the corpus."""
    found = np.zeros((RANGES, COUNTED // RANGES), np.uint8)
    blobs = first.where("part is not null").select("part", "size", "buckets", "counts")
    for part, levels in blobs.repartition(RANGES // 4, "part").mapInArrow(common.tidy(_levels_of), "part int, levels binary").collect():
        found[part] = np.frombuffer(levels, np.uint8)
    return found.reshape(-1)


def _prefixes(levels: np.ndarray):
    """The columns KINDS of the prefix words of the distinct lines of some batches; the same set is sent on once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held, size, known = [], 0, 0
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in common.text_slices(batch.column(1)):
                s = LineSets.of_texts(texts, levels)
                if not len(s):
                    continue
                take = s.n - -(-SIMILAR * s.n // 100) + 1
                line = np.repeat(np.arange(len(s)), take)
                at = np.arange(len(line)) - np.repeat(np.cumsum(take) - take, take)
                word = s.at[s.starts[line] + at]
                keep = s.level[word] > 1  # a word that occurs once is in no other line
                line, at, word = line[keep], at[keep], word[keep]
                even, odd = s.parities()
                held.append({
                    "doc": docs[first + s.text].astype(np.int64), "line": s.number, "key": s.keys(), "n": s.n.astype(np.int32), "even": even, "odd": odd,
                    "of": line + known, "at": at.astype(np.int32), "word": s.hashes[word], "hot": s.level[word] >= HOT,
                })
                size, known = size + len(line), known + len(s)
                if size >= ROWS_AT_ONCE:
                    yield flushed(held)
                    size = known = 0
        if held:
            yield flushed(held)

    def flushed(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        t = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        held.clear()
        line, at, word, hot = (t.pop(k) for k in ("of", "at", "word", "hot"))
        lines = t
        # of equal sets the earliest line alone goes on
        by = np.lexsort((lines["line"], lines["doc"], lines["n"], lines["key"]))
        once = np.zeros(len(by), bool)
        once[by] = _heads(lines["key"][by], lines["n"][by])
        keep = once[line]
        line, at, word, hot = line[keep], at[keep], word[keep], hot[keep]
        home = np.ones(len(line), np.int8)
        if hot.any():
            # rows of hot words go to the cell of their size band and, as visitors, to the next one's
            band = np.searchsorted(_BANDS, lines["n"][line[hot]], side="right").astype(np.uint64)
            own, other = (common.mix64(word[hot] + (band + np.uint64(k)) * _SECOND) for k in (1, 2))
            word = np.concatenate((word, other))
            word[:-len(other)][hot] = own
            line, at = np.concatenate((line, line[hot])), np.concatenate((at, at[hot]))
            home = np.concatenate((home, np.zeros(len(other), np.int8)))
        return {"cell": word.view(np.int64), "at": at, "home": home} | {k: v[line] for k, v in lines.items()}

    return run


def _as_blobs(tables, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, rows, columns): prefix rows dealt by ranges of cells, packed column by column."""
    for t in tables:
        if not len(t["cell"]):
            continue
        order = np.argsort(t["cell"].view(np.uint64))
        t = {k: t[k][order] for k in KINDS}
        part = ((t["cell"].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        spans = list(zip(edge.tolist(), [*edge[1:].tolist(), len(part)], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[edge]), pa.array([hi - lo for lo, hi in spans], pa.int64()),
                pa.array([_packed({k: v[lo:hi] for k, v in t.items()}) for lo, hi in spans], pa.list_(pa.binary())),
            ],
            names=["part", "rows", "columns"],
        )


#: Columns that do not compress.
_RANDOM = ("key", "even", "odd")
_ORDERED = tuple(k for k in KINDS if k not in _RANDOM)


def _packed(t: dict[str, np.ndarray]) -> list[bytes]:
    """Two buffers: one compressed, one of hashes as they are; a blob of few rows costs little more than they do."""
    planes = [(np.diff(t[k], prepend=0) if k == "cell" else t[k]).view(np.uint8).reshape(len(t[k]), -1).T.tobytes() for k in _ORDERED]
    return [pa.compress(b"".join(planes), codec="zstd", asbytes=True), b"".join(t[k].tobytes() for k in _RANDOM)]


def _unpacked(blobs: list[tuple[int, list[bytes]]]) -> dict[str, np.ndarray]:
    out: dict[str, list] = {k: [] for k in KINDS}
    for n, (ordered, random) in blobs:
        ordered = pa.decompress(ordered, n * sum(np.dtype(KINDS[k]).itemsize for k in _ORDERED), codec="zstd", asbytes=True)
        at = 0
        for k in _ORDERED:
            size = np.dtype(KINDS[k]).itemsize
            values = np.ascontiguousarray(np.frombuffer(ordered, np.uint8, n * size, at).reshape(size, n).T).view(KINDS[k]).reshape(n)
            out[k].append(np.cumsum(values) if k == "cell" else values)
            at += n * size
        for i, k in enumerate(_RANDOM):
            out[k].append(np.frombuffer(random, KINDS[k], n, i * 8 * n))
    return {k: np.concatenate(v) for k, v in out.items()}


def _from_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The prefix rows of each part of a partition, one part at a time; packed until then."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, n, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(part, []).append((n, columns))
    while held:
        yield _unpacked(held.popitem()[1])


def _from_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of a partition."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        yield {k: table.column(k).to_numpy() for k in table.column_names}


CANDIDATE = {"cell": pa.int64(), "doc_b": pa.int64(), "line_b": pa.int32(), "doc_a": pa.int64(), "line_a": pa.int32(), "more": pa.bool_(), "rows": pa.int64(), "columns": pa.list_(pa.binary())}
CANDIDATE_SCHEMA = "cell bigint, doc_b bigint, line_b int, doc_a bigint, line_a int, more boolean, rows bigint, columns array<binary>"


def _in_order(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The rows by (cell, document, line): of equal sets in a cell the earliest, and cells of two rows or more."""
    cell, doc = _dense(c["cell"]), _dense(c["doc"])
    width = int(c["line"].max()) + 1
    if len(cell) ** 2 * width < 1 << 62:
        order = np.argsort((cell * len(cell) + doc) * width + c["line"])
    else:
        order = np.lexsort((c["line"], doc, cell))
    # a cell's rows of equal sets meet by a hash of both; it decides nothing alone
    mixed = (common.mix64(c["key"].view(np.uint64)) + c["cell"].view(np.uint64))[order]
    same = np.argsort(mixed)
    if not _heads(mixed[same]).all():
        same = np.argsort(mixed, kind="stable")
        by = order[same]
        again = np.empty(len(order), bool)
        again[same] = ~_heads(c["key"][by], c["cell"][by], c["n"][by])
        order = order[~again]
    many = np.bincount(cell[order], minlength=len(cell))[cell[order]] > 1
    return {k: v[order[many]] for k, v in c.items()}


def _partners(read, limit: int):
    """For each line (each marked one, where lines are marked) of each cell its earliest ``limit`` passing partners, and whether it has more.

    The rows of cells where a line has more follow, packed, unless lines are marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in read(batches):
            if len(c["cell"]):
                yield from compare(_in_order(c))

    def compare(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        n, at, home = c["n"], c["at"], c["home"] > 0
        even, odd = c["even"].view(np.uint64), c["odd"].view(np.uint64)
        starts = np.flatnonzero(_heads(c["cell"]))
        begin = np.repeat(starts, np.diff(np.append(starts, len(n))))
        rank = np.arange(len(n)) - begin
        if "marked" in c:
            rank = np.where(c["marked"], rank, 0)
        edges = np.concatenate(([0], np.cumsum(rank)))
        unfinished = np.zeros(len(n), bool)
        lo = 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + PAIR_BLOCK, side="right")) - 1)
            count = rank[lo:hi]
            b = np.repeat(np.arange(lo, hi), count)
            a = np.arange(edges[lo], edges[hi]) - np.repeat(edges[lo:hi] - begin[lo:hi], count)
            lo = hi
            na, nb = n[a], n[b]
            # as the first word that both have, it leaves room for the overlap that the likeness takes
            least = -(-SIMILAR * (na + nb) // (100 + SIMILAR))
            ok = np.flatnonzero((at[a] + least <= na) & (at[b] + least <= nb))
            a, b = a[ok], b[ok]
            differ = np.bitwise_count(even[a] ^ even[b]).astype(np.int32) + np.bitwise_count(odd[a] ^ odd[b])
            ok = (differ * (100 + SIMILAR) <= (100 - SIMILAR) * (n[a] + n[b])) & (home[a] | home[b])
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            heads = np.flatnonzero(_heads(b))
            sizes = np.diff(np.append(heads, len(b)))
            which = np.arange(len(b)) - np.repeat(heads, sizes)
            ok = which < limit
            more = np.repeat(sizes > limit, sizes)[ok]
            a, b = a[ok], b[ok]
            unfinished[begin[b[more]]] = True
            yield _candidates(cell=c["cell"][b], doc_b=c["doc"][b], line_b=c["line"][b], doc_a=c["doc"][a], line_a=c["line"][a], more=more)
        if "marked" not in c and unfinished.any():
            rest = {k: v[unfinished[begin]] for k, v in c.items()}
            yield _candidates(rows=[len(rest["cell"])], columns=[_packed(rest)])

    return run


def _candidates(**columns) -> pa.RecordBatch:
    length = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], kind) if k in columns else pa.nulls(length, kind) for k, kind in CANDIDATE.items()], names=list(CANDIDATE)
    )


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word sets of the wanted lines of each text."""
    for batch in batches:
        docs, wanted = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        sizes = pc.list_value_length(wanted).to_numpy()
        flat, edges = wanted.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
        for first, texts in common.text_slices(batch.column(1)):
            last = first + len(texts)
            text, number = np.repeat(np.arange(first, last), sizes[first:last]), flat[edges[first] : edges[last]]
            split = pc.split_pattern(texts, "\n")
            s = LineSets(split.flatten().take(pa.array(split.offsets.to_numpy()[text - first] + number)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[text[s.line]]), pa.array(number[s.line]),
                    pa.array([np.sort(s.hashes[s.at[i : i + n]]).tobytes() for i, n in zip(s.starts.tolist(), s.n.tolist(), strict=True)], pa.binary()),
                ],
                names=["doc", "line", "words"],
            )


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            joined = np.concatenate((x, y))
            joined.sort()
            both = int(np.count_nonzero(joined[1:] == joined[:-1]))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def removed_lines(docs: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(doc, removed array<int>, n_lines): per row its doc_id, the numbers (from 0) of the lines that go, and its lines with words.

    Lines are separated by newlines; lines without words always stay. A null text
    has no lines; rows with a null id come after all others. Every row is a document
    of its own: rows of one id, or without one, follow each other by text. Of equal
    lines (a likeness of 1) the first stays. Whole texts are read however long they
    are; a line takes memory in proportion to its own length. Other columns may have
    any names and are dropped. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with common.scratch(spark) as keep:
        rows = common.with_rows(docs.select("doc_id", "text"))
        found = _removed(rows, partners)
        return keep(rows.select("row_", F.col("doc_id").alias("doc")).join(found, "row_").select("doc", "removed", "n_lines"))


def _removed(numbered: DataFrame, partners: int = PARTNERS) -> DataFrame:
    """(row_, removed, n_lines) of the rows with lines of ``numbered``, which has row_ and text; to be used inside a scratch scope."""
    spark = numbered.sparkSession
    rows = numbered.select(F.col("row_").alias("doc"), F.col("text").cast("string").alias("text"))
    first = materialize(rows.mapInArrow(common.tidy(_first_pass), FIRST_SCHEMA))
    sent = spark.sparkContext.broadcast(_levels(first))  # COUNTED bytes
    lines = first.where("part is null").select("doc", "line", "key", "key2", "n", "again")
    words = lines.agg(F.sum("n"), F.count(F.lit(1))).first()
    parts = max(256, -(-((words[0] or 0) * (100 - SIMILAR) // 100 + words[1]) // ROWS_PER_PART))

    def blobs(batches):
        yield from _as_blobs(_prefixes(sent.value)(batches), parts)

    found = materialize(
        rows.mapInArrow(common.tidy(blobs), "part bigint, rows bigint, columns array<binary>")
        .repartition(-(-parts // 2), "part").mapInArrow(common.tidy(_partners(_from_blobs, partners)), CANDIDATE_SCHEMA)
    )
    common.release(spark)
    matched = _verified(rows, found)
    left = _undecided(found, matched)
    limit, again = partners, None
    while left.limit(1).count():
        again = _remarked(_rows_again(spark, found, left) if again is None else again, left)
        limit *= MORE
        dealt = again.repartition(max(16, -(-again.count() // ROWS_PER_PART)), "cell")
        found = materialize(dealt.mapInArrow(common.tidy(_partners(_from_rows, limit)), CANDIDATE_SCHEMA))
        matched = materialize(matched.unionAll(_verified(rows, found)))
        left = _undecided(found, matched)
    # a set's first line stays unless the set is matched by an earlier one; its other lines go
    once = lines.where("not again")
    places = once.groupBy("key", "key2").agg(F.min("doc").alias("doc_"), F.count(F.lit(1)).alias("many")).where("many > 1")
    copies = once.join(places.drop("many"), ["key", "key2"]).where("doc != doc_").select("doc", "line")
    gone = copies.unionAll(lines.where("again").select("doc", "line")).unionAll(matched.distinct())
    removed = gone.groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("removed"))
    counts = lines.groupBy("doc").agg(F.count(F.lit(1)).alias("n_lines"))
    return counts.join(removed, "doc", "left").select(
        F.col("doc").alias("row_"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "n_lines"
    )


def _undecided(found: DataFrame, matched: DataFrame) -> DataFrame:
    """(cell, doc, line): where lines without a match have more partners."""
    more = found.where("more").select("cell", F.col("doc_b").alias("doc"), F.col("line_b").alias("line"))
    return materialize(more.distinct().join(matched, ["doc", "line"], "left_anti"))


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _remarked(rows: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of the cells in ``left``, its lines marked."""
    marks = left.withColumn("marked_", F.lit(True))
    return materialize(
        rows.drop("marked").join(left.select("cell").distinct(), "cell", "left_semi")
        .join(marks, ["cell", "doc", "line"], "left").withColumn("marked", F.col("marked_").isNotNull()).drop("marked_")
    )


def _rows_again(spark: SparkSession, found: DataFrame, left: DataFrame) -> DataFrame:
    """The packed rows of ``found`` that are in the cells of ``left``."""
    cells = left.select("cell").distinct()
    many = cells.limit(BROADCAST_LINES + 1).count()
    shared = spark.sparkContext.broadcast(np.sort(cells.toArrow().column(0).to_numpy())) if many <= BROADCAST_LINES else None

    def rows(batches):
        for batch in batches:
            for blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = _unpacked([blob])
                if shared is not None:
                    keep = _member(t["cell"], shared.value)
                    t = {k: v[keep] for k, v in t.items()}
                yield pa.RecordBatch.from_arrays([pa.array(t[k]) for k in KINDS], names=list(KINDS))

    return found.where("rows is not null").select("rows", "columns").mapInArrow(common.tidy(rows), PREFIX)


def _verified(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, line) of the lines of which a partner in ``found`` is alike enough, by the full word sets of both."""
    pairs = materialize(found.where("rows is null").select("doc_b", "line_b", "doc_a", "line_a").distinct())
    places = pairs.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).unionAll(
        pairs.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line"))
    )
    wanted = places.groupBy("doc").agg(F.collect_set("line").alias("wanted"))
    small = pairs.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES  # twice as many line numbers at most
    sets = materialize(
        rows.join(F.broadcast(wanted) if small else wanted, "doc")
        .select("doc", "text", "wanted")
        .mapInArrow(common.tidy(_wanted_sets), "doc bigint, line int, words binary")
    )
    side = lambda s: sets.select(F.col("doc").alias(f"doc_{s}"), F.col("line").alias(f"line_{s}"), F.col("words").alias(f"words_{s}"))
    joined = pairs.join(side("a"), ["doc_a", "line_a"]).join(side("b"), ["doc_b", "line_b"])
    alike = joined.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line"), "words_a", "words_b")
    return materialize(alike.mapInArrow(common.tidy(_alike), "doc bigint, line int").distinct())


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the removed lines; a document that had words and has none left goes.

    All columns stay as they are but ``text`` and, where there is one, ``n_chars``
    (the code points left). Columns may have any names. Nulls, repeated ids, ties and
    long texts are as in ``removed_lines``; a row without lines stays unchanged, an
    empty table gives an empty one.
    """
    row, of, gone = common.unused(docs, "row", "of", "gone")
    rows = common.with_rows(docs, row)
    with common.scratch(docs.sparkSession) as keep:
        found = _removed(rows.select(F.col(row).alias("row_"), "text")).where(F.size("removed") > 0)
        found = common.few(keep(found.select(F.col("row_").alias(of), F.struct("removed", "n_lines").alias(gone))), f"{gone}.removed")
    removed = F.col(f"{gone}.removed")
    kept = F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(removed, i))
    new = {"text": F.array_join(kept, "\n")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return (
        rows.join(found, F.col(row) == F.col(of), "left")
        .where(removed.isNull() | (F.size(removed) < F.col(f"{gone}.n_lines")))
        .select(*(F.when(removed.isNull(), F.col(f"`{c}`")).otherwise(new[c]).alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row: doc_id, n_lines (with words), n_removed, removed (line numbers from 0)."""
    rows = common.with_rows(common.read(spark, sf_dir, "documents", "doc_id", "text"))
    with common.scratch(spark) as keep:
        found = keep(_removed(rows))
    return rows.select("doc_id", "row_").join(found, "row_", "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.expr("array()").cast("array<int>")).alias("removed"),
    )


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS t FROM d),
w AS (
  SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(
    translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS s
  FROM x
), p AS (SELECT *, row_number() OVER (ORDER BY doc_id, line) AS place FROM w WHERE len(s) > 0),
sets AS (SELECT s, min(place) AS first, len(s) AS n FROM p GROUP BY s),
u AS (SELECT first, n, unnest(s) AS word FROM sets),
gone AS (
  SELECT DISTINCT b AS first FROM (
    SELECT a.first AS a, b.first AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
    FROM u a JOIN u b ON a.word = b.word AND a.first < b.first AND 100 * least(a.n, b.n) >= {SIMILAR} * greatest(a.n, b.n)
    GROUP BY 1, 2
  ) WHERE 100 * c >= {SIMILAR} * (na + nb - c)
),
r AS (
  SELECT p.doc_id, count(*) AS n_lines, list_sort(list(p.line) FILTER (WHERE p.place > sets.first OR gone.first IS NOT NULL)) AS removed
  FROM p JOIN sets ON sets.s = p.s LEFT JOIN gone ON gone.first = sets.first GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
  CAST(coalesce(removed, []) AS INTEGER[]) AS removed
FROM documents LEFT JOIN r USING (doc_id)
"""

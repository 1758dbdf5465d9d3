"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows of ``capacity`` ids, which are
sequences of their own, and a remainder, cut again into pieces of three quarters
of what is left, down to ``least`` ids. The pieces of a block of documents are dealt to k windows by
differencing: the two partial partitions with the widest spread are merged,
large sums of one against small sums of the other, until one partition is left.
k starts at the least number that could hold the block and rises while any
window exceeds its capacity. Blocks are formed inside a task, so that packing
needs no shuffle; a task holds one block of piece lengths at a time.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from treeline.llm import common
from treeline.llm.bpe import Encoder, encoder_paths

CAPACITY = 1024
LEAST = 8
BLOCK_WINDOWS = 128
END_ID = 0


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows of near-equal sums; a window is the list of its items' indices.

    A partial partition is a list of at most k (sum, items), ascending; missing
    windows have sum 0. Ties are broken by the order in which partitions arose.
    """
    heap = [(-s, n, [(s, [n])]) for n, s in enumerate(sizes)]
    heapq.heapify(heap)
    born = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        if len(b) == 1:
            total, items = b[0]
            if len(a) == k:  # the smallest window takes it
                least, own = a.pop(0)
                total, items = total + least, own + items
            insort(a, (total, items))
        else:
            over = max(0, len(a) + len(b) - k)
            # the largest of one meet the smallest (or the missing windows) of the other
            joined = [(a[i][0] + b[over - 1 - i][0], a[i][1] + b[over - 1 - i][1]) for i in range(over)]
            a = sorted(joined + a[over:] + b[over:])
        spread = a[-1][0] - (a[0][0] if len(a) == k else 0)
        heapq.heappush(heap, (-spread, born, a))
        born += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Deal items, none above capacity, to as few near-equal windows as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k += 1


def remainder_pieces(length: int, least: int) -> list[int]:
    """Cut three quarters off again and again until at most ``least`` is left: sizes that balance well."""
    out = []
    while length > least:
        out.append((3 * length + 3) // 4)
        length -= out[-1]
    return out + [length] * (length > 0)


COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    least: int = LEAST,
    paths: tuple[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids, followed by ``end_id``, lie in exactly one piece each.
    A null or empty text is the end id alone. Null ids and repeated rows are
    packed like any other row (a repeated row gives its pieces again); extra
    columns are dropped; an empty table gives no pieces. Sequence ids are unique,
    not contiguous: the task's partition in the high bits.
    """
    common.small_batches(docs.sparkSession)
    paths = paths or encoder_paths()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    block_limit = capacity * BLOCK_WINDOWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*paths)
        sequence = TaskContext.get().partitionId() << 40
        ids, lists, waiting, held = [], [[] for _ in COLUMNS], [], 0

        def emit(doc, *values):
            ids.append(doc)
            for target, value in zip(lists, values, strict=True):
                target.append(value)

        def flush():
            nonlocal sequence, held
            for window in windows([w[2] for w in waiting], capacity):
                offset = 0
                for doc, start, length, crc, n in (waiting[i] for i in window):
                    emit(doc, start, length, crc, n, sequence, offset)
                    offset += length
                sequence += 1
            waiting.clear()
            held = 0

        def table():
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), *(pa.array(v, pa.int64()) for v in lists)], names=[id_col, *COLUMNS]
            )
            for v in (ids, *lists):
                v.clear()
            return out

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encoder.packed(text or "") + end_id.to_bytes(4, "little")
                n = len(raw) // 4
                full = n // capacity
                for start in range(0, full * capacity, capacity):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + capacity)])
                    emit(doc, start, capacity, crc, n, sequence, 0)
                    sequence += 1
                start = full * capacity
                for length in remainder_pieces(n - start, least):
                    crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                    waiting.append((doc, start, length, crc, n))
                    start, held = start + length, held + length
                if held >= block_limit - capacity:
                    flush()
            yield table()
        if waiting:
            flush()
        if ids:
            yield table()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(common.tidy(run), f"`{id_col}` {kind}, " + ", ".join(f"`{c}` bigint" for c in COLUMNS))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents", "doc_id", "text"))

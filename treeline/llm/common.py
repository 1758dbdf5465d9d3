"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a task sums up before it sends their counts on.
WORDS_AT_ONCE = 1 << 22
#: White space that separates words, as bytes: blank and 0x09-0x0D (fixed values).
SPACES = b" \t\n\x0b\x0c\r"
#: The same class as a Java regular expression for one word.
WORD = "[^\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one parquet table."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of texts that go through one numpy step.
CHUNK = 1 << 20
#: Bytes of an Arrow batch that carries whole texts.
BATCH_BYTES = 4 << 20
#: Folders written inside the open ``scratch`` scopes, the innermost last.
_scopes: list[list[str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset a local one, with a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='treeline-')}")
    return _own[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/treeline-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialised inside go at the end, but for those given to the yielded function.

    A kept table belongs to the enclosing scope, if there is one. Batches of texts
    are small inside; the session's settings are as before afterwards.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        out = materialize(df)
        kept.append(_scopes[-1].pop())
        return out

    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    _scopes.append([])
    try:
        yield keep
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
        if _scopes:
            _scopes[-1].extend(kept)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished queries now; it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free_executors(spark: SparkSession) -> None:
    """Let executors collect their garbage, by a short task for each core: what one stage's heap grew to is no longer held in the next."""
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which at its end gives freed memory back to the system: Spark keeps the process for later tasks."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError):  # glibc alone has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def few(df: DataFrame, lists: str | None = None, limit: int = 1 << 20) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows, and entries in the column ``lists``; a written table of numbers."""
    entries = F.sum(F.size(lists)) if lists else F.lit(0).cast("long")
    rows, inside = df.agg(F.count(F.lit(1)), entries).first()
    return F.broadcast(df) if rows <= limit and (inside or 0) <= limit else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds when rows carry whole texts, for plans that run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case, one for each stem."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"{stem}_"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def with_rows(docs: DataFrame, name: str = "row_") -> DataFrame:
    """Add column ``name``, an integer of each row's own in ascending (doc_id, text), null ids last.

    It is the id itself if no two rows share one (a single null id is the largest
    number). Otherwise all rows are sorted and numbered, and materialised for that.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    many = docs.select(key.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not many.limit(1).count():
        return docs.withColumn(name, key)
    # equal rows are told apart by where they stand, which leaves the result the same
    (at,) = unused(docs, "at")
    ordered = docs.withColumn(at, F.monotonically_increasing_id()).orderBy(key, "text", at).drop(at)
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()))


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


# ---------------------------------------------------------------------------
# Vectorised word hashing over a buffer of whole texts.

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
#: A random 64-bit value for each byte, the same for A-Z and a-z.
_BYTE_VALUE = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
_BYTE_VALUE[65:91] = _BYTE_VALUE[97:123]
_BYTE_VALUE[_IS_SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.ones(size, np.uint64)
            done, step = 1, base
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(step)
                done, step = 2 * done, step * step & _MASK
            _powers[k] = table
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Compress integers byte plane by byte plane."""
    v = np.ascontiguousarray(values)
    planes = v.view(np.uint8).reshape(len(v), v.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).reshape(n)


def text_slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about ``limit`` bytes each, as slices; null counts as empty; a text is never split."""
    texts = column.cast(pa.large_string()).fill_null("")
    edges = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy() + 1))) if len(texts) else [0]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + limit, side="right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """The same as lists of bytes."""
    for first, texts in text_slices(column, limit):
        yield first, texts.cast(pa.large_binary()).to_pylist()


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of large strings without white space (A-Z count as a-z)."""
    if not len(strings):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    power, inverse = _power_tables(len(data) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[data] * power[: len(data)], dtype=np.uint64)))
    starts, ends = offsets[:-1], offsets[1:]
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of large strings, A-Z lower-cased: each one's number in the distinct words, how many each text has, the distinct words' hashes."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    code, n = coded.indices.to_numpy(), np.diff(split.offsets.to_numpy())
    # leading or trailing white space gives empty strings
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        real = code != empty
        n = np.diff(np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(n)))])
        code = code[real]
    return code, n, hash_strings(coded.dictionary)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, and how many words each text has."""
    code, n, hashes = words_of(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    return hashes[code], n


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word (by its hash) occurs in all texts; summed within tasks before shuffling."""

    def summed(held):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, texts in text_chunks(batch.column(0)):
                held.append(word_hashes(texts)[0])
                size += len(held[-1])
                if size >= WORDS_AT_ONCE:
                    yield summed(held)
                    size = 0
        if held:
            yield summed(held)

    texts = docs.select(docs[text_col].cast("string"))
    return texts.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

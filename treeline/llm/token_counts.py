"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that ends a word is encoded alone by the
library; those that come back as one token form the shortcut set. At run time a
pre-token found in that set counts 1 without any merging; only the rest is
merged by the library's BPE model. Each worker keeps bounded caches of the words
and merged pre-tokens it has seen. Words with characters beyond Latin Extended-A,
whose normalisation can depend on their neighbours, go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from treeline.llm import common

#: Pre-token pattern of the word-end BPE file (fixed value, taken from the tokenizer file).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters that normalise and lower-case one by one: up to Latin Extended-A, without dotted capital I.
SIMPLE = regex.compile(r"[\x00-\u012F\u0131-\u017F]+")
CACHE_WORDS = 400_000
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """Byte-level spelling: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """The offline proof: strings (of the simple characters) that the library encodes alone as exactly one token.

    Bounded by the vocabulary.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    byte_of = {c: b for b, c in byte_characters().items()}
    words = []
    for spelled in tok.get_vocab(with_added_tokens=False):
        if spelled.endswith(WORD_END) and len(spelled) > len(WORD_END):
            raw = bytes(byte_of[c] for c in spelled.removesuffix(WORD_END))
            word = raw.decode("utf-8", "replace")
            if SIMPLE.fullmatch(word):
                words.append(word)
    encoded = tok.encode_batch(words, add_special_tokens=False)
    return frozenset(w for w, e in zip(words, encoded, strict=True) if len(e.ids) == 1)


class _Counts(dict):
    """Counts by string; what is missing is counted."""

    def __init__(self, count, limit: int):
        super().__init__()
        self.count = count
        self.limit = limit

    def __missing__(self, key: str) -> int:
        n = self.count(key)
        if len(key) < 64 and len(self) < self.limit:
            self[key] = n
        return n


class TokenCounter:
    """Counts tokens of texts exactly as the library does."""

    def __init__(self, path: str, whole: frozenset[str], cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.whole = whole
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.find = regex.compile(PRETOKEN).findall
        self.spelling = byte_characters()
        self.words = _Counts(self._word, cache_words)
        self.pretokens = _Counts(self._merge, cache_words)
        self.merged = 0

    def _library(self, text: str) -> int:
        self.merged += 1
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def _merge(self, pre: str) -> int:
        self.merged += 1
        spelled = pre if pre.isascii() else "".join(map(self.spelling.__getitem__, pre.encode()))
        return len(self.model.tokenize(spelled))

    def _word(self, word: str) -> int:
        if not SIMPLE.fullmatch(word):
            return self._library(word) if word else 0
        whole, pretokens = self.whole, self.pretokens
        return sum(1 if pre in whole else pretokens[pre] for pre in self.find(word.lower()))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.specials):
            return self._library(text)
        for cache in (self.words, self.pretokens):
            if len(cache) >= cache.limit:
                cache.clear()
        return sum(map(self.words.__getitem__, text.split(" ")))


def token_counts(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens). Null ids, repeated rows and
    extra columns are passed over: one output row per input row, in which only
    the id column is kept. An empty table gives an empty result. Texts of any
    length are counted whole; the tokenizer's special strings inside a text are
    treated as the library does by default.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary
    common.small_batches(spark)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, whole.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents", "doc_id", "text"))

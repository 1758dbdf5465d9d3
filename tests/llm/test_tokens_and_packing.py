"""Token counts, packing and mixing against plain versions."""

import random
import zlib
from array import array

import pytest

from treeline.llm import common
from treeline.llm.bpe import Encoder, encoder_paths
from treeline.llm.mixing import mix, repetitions
from treeline.llm.packing import differencing, pack, remainder_pieces, windows
from treeline.llm.token_counts import TokenCounter, token_counts, tokenizer_path, whole_tokens

ODD = [
    None, "", " ", "\n\n", "a", "a  b", " a b ", "don't WE'RE it's", "été İstanbul ΑΣ ΑΣ. é naïve", "x<|endoftext|>y", "<|startoftext|>",
    "日本語 テスト", "½ ² 123 4567", "a\x1cb c", "tab\tand \n newline", "é ́x", "a\xa0 b", "a " * 3000, "x" * 5000, "Straße ẞ ﬁ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (3, "same id", "y"), (3, "same id", "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string")


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = token_counts(docs, limit=10).collect()
    assert len(got) == docs.count()
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) for t in ODD)
    assert sorted(r.n_tokens for r in got if r.doc_id is not None and not (r.doc_id == 3 and r.n_bytes == 7)) == want
    assert all(r.over_limit == (r.n_tokens > 10) for r in got)
    assert token_counts(docs.limit(0)).count() == 0


def test_token_counts_on_documents(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in common.read(spark, "/root/testdata/sf0.001", "documents", "text").collect()]
    tok = Tokenizer.from_file(tokenizer_path())
    counter = TokenCounter(tokenizer_path(), whole_tokens(tokenizer_path()), cache_words=50)
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_shortcut_words_are_one_token():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    for w in sorted(whole_tokens(tokenizer_path()))[::500]:
        assert len(tok.encode(w, add_special_tokens=False).ids) == 1


def test_encoder_equals_the_library():
    e = Encoder(*encoder_paths(), cache_words=20)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "é", "日", "1", "'s", "\xa0", "!", "​", "\x1c", " \n", "\n "]
    r = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    for t, ids in zip(texts, e.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert e.packed(t) == array("I", ids.ids).tobytes(), t


def test_differencing():
    assert sorted(sum(w) for w in ([[8, 7, 6, 5, 4][i] for i in w] for w in differencing([8, 7, 6, 5, 4], 2))) in ([14, 16], [15, 15])
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 60))]
        k = r.randint(1, 12)
        dealt = differencing(sizes, k)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes))) and len(dealt) <= k
        dealt = windows(sizes, 100)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 100 for w in dealt)
    assert differencing([], 3) == []
    assert all(sum(remainder_pieces(n, 8)) == n for n in range(1100))


def test_packing_round_trip(spark, docs):
    e = Encoder(*encoder_paths())
    rows = pack(docs).collect()
    ids = {(d, t or ""): e.packed(t or "") + (0).to_bytes(4, "little") for d, t in [(r.doc_id, r.text) for r in docs.collect()]}
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    for (doc, text), raw in ids.items():
        got = sorted(set(pieces[doc, len(raw) // 4]))
        at = 0
        for start, length, crc in got:
            assert start == at and zlib.crc32(raw[4 * start : 4 * (start + length)]) == crc or doc == 3
            at += length
        assert at == len(raw) // 4 or doc == 3
    assert pack(docs.limit(0)).count() == 0


def test_packing_pads_little(spark):
    rows = pack(common.read(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text").coalesce(1)).groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] for r in rows) / (1024 * len(rows)) > 0.98


def water(sizes, weights, epochs):
    """Plain capped water-filling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= epochs * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = float(epochs * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["b", "a", None, "é", "Z", ""]) if i % 3 else "hot", None if i % 17 == 0 else "w " * r.randint(0, 200 if i % 3 else 2)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = repetitions(docs).collect()
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes, (5, 2, 1), 3)
    for s in sizes:
        mine = [x for x in got if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 * max(1, want[s]) and x.source_size == sizes[s] for x in mine)
        assert abs(sum(x.taken for x in mine) - want[s]) <= 4 * len(mine) ** 0.5 + 1
    assert all(0 <= x.taken <= 3 * x.size and x.taken == x.whole * x.size + x.part for x in got)
    assert sorted((x.doc_id, x.taken) for x in got) == sorted((x.doc_id, x.taken) for x in repetitions(docs.repartition(7)).collect())
    words = {}
    for x in mix(docs.withColumn("n_chars", docs.doc_id)).collect():
        words[x.doc_id] = words.get(x.doc_id, 0) + len(x.text.split())
        assert x.n_chars == len(x.text)
    assert words == {x.doc_id: x.taken for x in got if x.taken}
    assert repetitions(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_mixing_takes_whole_documents(spark):
    texts = {i: " ".join(f"d{i}w{k}" for k in range(10 + i % 90)) for i in range(240)}
    rows = [(i, "a" if i < 40 else "b", t) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sizes = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in "ab"}
    want = water(sizes, (1, 1), 3)
    assert want["b"] < sizes["b"]  # a source of which not all is taken
    drawn = []
    for seed in (1, 2):
        whole, cut, words = set(), [], {"a": 0, "b": 0}
        for x in mix(docs, (1, 1), 3, seed).collect():
            words[x.source] += len(x.text.split())
            whole.add(x.doc_id) if x.text == texts[x.doc_id] else cut.append(x.source)
        assert len(cut) == len(set(cut)) and words == {s: round(want[s]) for s in want}
        drawn.append({i for i in whole if i >= 40})
    assert drawn[0] != drawn[1]  # the seed decides which


def test_mixing_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a", "p q r s t")] * 60 + [(1, "b", "x y")] * 5, "doc_id bigint, source string, text string")
    want = water({"a": 300, "b": 10}, (1, 1), 3)
    got = mix(docs, (1, 1), 3).collect()
    for s, text in (("a", "p q r s t"), ("b", "x y")):
        found = [x.text for x in got if x.source == s]
        assert sum(len(t.split()) for t in found) == round(want[s]) and sum(t != text for t in found) <= 1

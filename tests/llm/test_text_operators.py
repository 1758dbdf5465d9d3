"""Fingerprints, near-duplicates, line dedup, language model, search, classifier and extraction against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

import treeline.llm.language_model as lm
from treeline.llm import common, html_extract, quality
from treeline.llm.components import components
from treeline.llm.line_dedup import deduplicated, removed_lines
from treeline.llm.near_dedup import near_duplicates
from treeline.llm.topk import top_k
from treeline.llm.winnowing import fingerprints
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.5:
            w = (r.choice(texts) or "").split(" ")
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocabulary).upper()
            texts.append(" ".join(w))
        else:
            texts.append(r.choice([" ", "\n"]).join(r.choice(vocabulary) for _ in range(r.randint(0, 40))))
    return texts + ["", " ", "one two", "one  two", "One Two\n", "a b c d e", "\x1f \x85 x"]


def frame(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(10_000, None, "y")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id string")


def test_word_hashes_tell_words_apart():
    texts = [t.encode() for t in corpus(1)]
    hashes, counts = common.word_hashes(texts)
    flat = [w for t in corpus(1) for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in corpus(1)]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    texts = corpus(seed)
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, texts)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} | {10_000: (0, 10_000, True)}


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_near_duplicates_in_blocks(spark, monkeypatch, block):
    """Large buckets alone, in blocks of a few sets each."""
    from treeline.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 0)
    monkeypatch.setattr(near_dedup, "RANDOM_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    test_near_duplicates(spark, 2)


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "A B C D E F")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, None), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_near_dedup_stage_keeps_one_row(spark):
    import corpus_pipeline

    t, u, v = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(None, t), (None, t), (5, u), (5, u), (7, u.upper()), (None, v), (8, v), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in got.collect()) == [(0, ""), (0, t), (5, u), (8, v), (9, "")]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(400, 420)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup(spark, seed):
    r = random.Random(seed)
    lines = corpus(seed, 120)
    texts = ["\n".join(r.choice(lines).replace("\n", " ") for _ in range(r.randint(0, 6))) for _ in range(80)]
    seen, want = [], {}
    for d, t in enumerate(texts):
        gone, n = [], 0
        for i, line in enumerate(t.split("\n")):
            s = frozenset(words(line))
            if s:
                n += 1
                if any(100 * len(s & x) >= 75 * len(s | x) for x in seen):
                    gone.append(i)
                seen.append(s)
        if n:
            want[d] = (n, gone)
    docs = frame(spark, texts)
    for partners in (1, 3):  # one partner at first leaves more lines to the second look
        assert {x.doc: (x.n_lines, list(x.removed)) for x in removed_lines(docs, partners).collect()} == want
    kept = {x.doc_id: x.text for x in deduplicated(docs).collect()}
    for d, t in enumerate(texts):
        n, gone = want.get(d, (0, []))
        if n and len(gone) == n:
            assert d not in kept
        else:
            assert kept[d] == "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone)
    assert kept[10_000] is None
    assert removed_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_line_dedup_looks_again(spark, monkeypatch, broadcast):
    from treeline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    u, c = [f"u{i}" for i in range(240)], [f"c{i}" for i in range(60)]
    first = u + [f"x{i}" for i in range(60)]  # likeness 0.67 with the last, and before its true partner in every bucket
    second = u[:207] + c + [f"y{i}" for i in range(33)]  # likeness 0.80
    fillers = [c + [f"f{k}-{i}" for i in range(200)] for k in range(5)]
    texts = [" ".join(w) for w in [first, second, *fillers, u + c]]
    found = {x.doc: list(x.removed) for x in removed_lines(frame(spark, texts), 1).collect()}
    assert found == {i: [0] if i == 7 else [] for i in range(8)}


def test_line_dedup_rows_without_own_id(spark):
    rows = [
        (1, "one two three"), (None, "one two three\nfirst own line"), (None, "other words here\nsecond text stays"),
        (7, "k l m\nn o p"), (7, "q r s\nk l m"), (7, "q r s\nk l m"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((x.doc_id or 0, x.text) for x in deduplicated(docs).collect())
    assert got == [
        (0, "first own line"), (0, "other words here\nsecond text stays"), (1, "one two three"), (7, "k l m\nn o p"), (7, "q r s")
    ]
    found = sorted((x.doc or 0, x.n_lines, list(x.removed)) for x in removed_lines(docs).collect())
    assert found == [(0, 2, []), (0, 2, [0]), (1, 1, []), (7, 2, []), (7, 2, [0, 1]), (7, 2, [1])]


def test_winnowing(spark):
    texts = corpus(6) + ["x" * 3000, "日本語" * 50]
    rows = {r.doc_id: r for r in fingerprints(frame(spark, texts)).collect()}
    by_text = defaultdict(set)
    full = texts + [""]
    for i, t in enumerate(full):
        r = rows[i if i < len(texts) else 10_000]
        after = full[(i + 1) % len(full)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[t].add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_winnowing_selects_window_minima(spark):
    from treeline.llm.winnowing import BASE, PRIME

    k, w = 3, 4
    for text in ("b a d c a b a c d b a d c e f a b", "a b", "日本語の文章です。" * 9 + " x", "a b c d"):
        values = [int(x) for x in fingerprints(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().fingerprint.split()]
        u = [c for x in text.split() for c in ([x] if len(x) <= 24 else x)]
        one = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % PRIME for x in u]
        h = {}
        for i in range(max(1, len(u) - k + 1)):
            h[i] = 0
            for x in one[i : i + k]:
                h[i] = (h[i] * BASE + x) % PRIME
        want = []
        for s in range(max(1, len(h) - w + 1)):
            at = min(range(s, min(s + w, len(h))), key=lambda i: (h[i], -i))
            if at not in want:
                want.append(at)
        assert values == [(h[i] << 32) - i for i in want]


def test_winnowing_finds_shared_runs(spark):
    """Two texts that share w + k - 1 units share a hash; without white space, wherever the run begins."""
    r = random.Random(8)
    for shared, glue in (([f"w{i}" for i in range(6)], " "), (list("日本語の文章を解析"), "")):
        texts = []
        for _ in range(8):
            around = [[r.choice("あいうえおかきくけこ") if glue == "" else f"x{r.random()}" for _ in range(r.randint(30, 60))] for _ in range(2)]
            texts.append(glue.join(around[0] + shared + around[1]))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        sets = [{(int(x) + (1 << 32) - 1) >> 32 for x in row.fingerprint.split()} for row in fingerprints(docs).collect()]
        assert all(a & b for a, b in combinations(sets, 2))


def test_winnowing_edges(spark):
    one = fingerprints(spark.createDataFrame([(None, "a b c d")], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("limit", [lm.BROADCAST_WORDS, 0])
def test_language_model(spark, limit):
    texts = corpus(7)
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in lm.score(docs, limit).collect()}
    tokens = {i: words(t) + ["\0"] for i, t in [*enumerate(texts), (10_000, "")]}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two = Counter(), Counter()
    for i, x in tokens.items():
        if not held[i]:
            one.update(x)
            two.update(zip(["\1", *x[:-1]], x, strict=True))
    n, v, d = sum(one.values()), len(one), sum(not h for h in held.values())
    context = one | Counter({"\1": d})
    uniform = math.log10(1 / (v + 1))
    cells = Counter()
    for (a, b), c in two.items():
        b2 = round((math.log10((c - 1) / max(context[a] - 1, 1)) - uniform) * lm.BINS) if c > 1 else lm._ZERO
        b1 = round((math.log10((one[b] - 1) / (n - 1)) - uniform) * lm.BINS) if one[b] > 1 else lm._ZERO
        cells[(context[a] - 1).bit_length(), b2, b1] += c
    table = lm.learn([(*k, m) for k, m in cells.items()])
    assert np.allclose(table.sum(axis=1), 1)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(one[w] > 0 for w in x), n)
        assert abs(r.base_score - sum(math.log10((one[w] + 1) / (n + v + 1)) for w in x)) < 1e-6
        want = 0.0
        for a, b in zip(["\1", *x[:-1]], x, strict=True):
            l2, l1, l0 = table[context[a].bit_length()]
            want += math.log10(l2 * two[a, b] / max(context[a], 1) + l1 * one[b] / n + l0 / (v + 1))
        assert abs(r.score - want) < 1e-6


def test_language_model_rare_words(spark):
    """Beyond the words that are sent to every task, the most frequent are still sent and rows carry numbers of their rare words alone."""
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (400, None)], "doc_id bigint, text string")
    one = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in words(t))
    want = {r.doc_id: r for r in lm.score(docs).collect()}
    for limit in (50, len(one) - 1):
        for x in lm.score(docs, limit).collect():
            assert x[:5] == want[x.doc_id][:5]
            assert np.allclose((x.base_score, x.score), (want[x.doc_id].base_score, want[x.doc_id].score), rtol=1e-12)
    rows = common.with_rows(docs.fillna("")).select("text", "doc_id", "row_", F.lit(True).alias("held_out"), (common.crc_mod("doc_id", 7) != 2).alias("training"))
    with common.scratch(spark):
        model = lm.Model(rows, 50)
        vocabulary = lm.Vocabulary(*model.sent.value, model.documents)
        sent = len(vocabulary.words)
        assert 0 < sent <= 50 and sorted(vocabulary.counts[:sent].tolist(), reverse=True) == sorted(one.values(), reverse=True)[:sent]
        places = {}
        for x in model.rows.collect():
            rare = [w for w in set(words(x.text)) if one[w] and one[w] <= min(sorted(one.values(), reverse=True)[:sent]) - 1]
            assert len(x.known or []) == len(rare)
            places |= {k.word: k.place for k in x.known or []}
        assert sorted(places.values()) == list(range(len(one) - sent))
        numbers = vocabulary.unknown + 1 + np.arange(len(one) - sent)
        assert vocabulary.count(numbers).tolist() == sorted(one.values())[: len(one) - sent]


def test_language_model_edges(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    got = lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id == 1}) == 1
    assert lm.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_top_k(spark):
    r = np.random.RandomState(1)
    rows = [(i, [float(x) for x in r.randn(16)]) for i in range(400)] + [(400, [1.0] * 8), (401, None), (402, [float("nan")] * 16), (None, [1.0] * 16), (450, [2.0] * 8)]
    rows += [(i, rows[i - 500][1]) for i in range(500, 520)]  # ties
    got = defaultdict(list)
    for x in top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    known = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and not any(map(math.isnan, v))}
    for q in [i for i in known if i % 50 == 0]:
        all_ = sorted((-sum(a * b for a, b in zip(known[q], v, strict=True)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))
        assert got[q] == [(-s, i) for s, i in all_[:5]]


def test_top_k_levels_see_survivors_alone():
    from treeline.llm import topk

    r = np.random.RandomState(2)
    centres = r.randint(-200, 200, (12, 64))
    x = (centres[r.randint(0, 12, 6000)] + r.randint(-40, 40, (6000, 64))).astype(float)
    ids = np.arange(6000)
    s = topk.Searcher(ids[::50], x[::50], 5)
    for lo in range(0, 6000, 2048):
        s.add(ids[lo : lo + 2048], x[lo : lo + 2048])
    pairs = len(s.ids) * 6000 - len(s.ids)
    assert s.bounded[0] == pairs
    assert pairs > s.bounded[1] > s.bounded[2] > s.exact
    for q, best in zip(s.ids, s.best, strict=True):
        scores = x @ x[q]
        assert best == sorted(((int(scores[i]), int(i)) for i in ids if i != q), key=lambda p: (-p[0], p[1]))[:5]


def test_top_k_in_blocks(spark, monkeypatch):
    from treeline.llm import topk

    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", 8 * 16 * 3)
    test_top_k(spark)


def test_quality_held_out(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels", "doc_id", "quality")
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.quality).mean() > 0.9) and (got.score[got.quality == 1].mean() > got.score[got.quality == 0].mean() + 0.4)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 5000), (2, "x" * 5000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0
    net = quality.Network()
    long = bytes(range(97, 123)) * 400
    assert np.allclose(net.scores([long, b"", b"abc"], step=3), [net.scores([t])[0] for t in (long, b"", b"abc")], atol=1e-5)


def test_quality_gradients():
    net = quality.Network(2)
    texts, y = [b"hello world " * 60, b"!!! $$$ ", b"abc def ghi"], np.array([1, 0, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss = lambda: -np.mean(y * np.log(net.scores(texts)) + (1 - y) * np.log(1 - net.scores(texts)))
    g = net.gradients(texts, y)
    for k, at in (("filters", (3, 5)), ("embed", (108, 2)), ("dense", (4, 3)), ("out", (2,)), ("shift", (7,))):
        old, e = net.p[k][at], 1e-4
        net.p[k][at] = old + e
        high = loss()
        net.p[k][at] = old - e
        low = loss()
        net.p[k][at] = old
        assert abs((high - low) / (2 * e) - g[k][at]) < 2e-3


def test_html_on_unseen_labelled_pages():
    model, right, blocks = html_extract.trained_model(), 0, 0
    for source, good in html_extract.training_pages(60, seed=77):
        page = html_extract.Page(source)
        p = model.marginals(page)
        right += sum((p[n] >= 0.5) == (b in good) for n, b in page.blocks)
        blocks += len(page.blocks)
    assert right / blocks > 0.97


def test_html_marginals_are_exact():
    model = html_extract.trained_model()
    page = html_extract.Page("<div class=nav><p>a</p></div><article><p>some text here.</p><ul><li>x</li></ul></article>")
    n = len(page.tags)
    base = [sum(model.node.get(f, 0.0) for f in fs) for fs in page.features()]
    total, one = 0.0, [0.0] * n
    for state in range(1 << n):
        y = [state >> i & 1 for i in range(n)]
        score = sum(b for b, v in zip(base, y, strict=True) if v)
        score += sum(model.edge[html_extract.GROUP.get(page.tags[i], 0)][y[page.parents[i]]][y[i]] for i in range(1, n))
        w = math.exp(score)
        total += w
        one = [o + w * v for o, v in zip(one, y, strict=True)]
    assert np.allclose([o / total for o in one], model.marginals(page), atol=1e-9)


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<article><h1>A &amp; B</h1><p>one\n two<p>three &copy; <b>four</b>.</article><footer>no</footer>"), (None, "u", "<p")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "A & B\none two\nthree © four." and got[3].n_chars == len(got[3].text)
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.parametrize("tag,lost", [("object", False), ("noscript", False), ("svg", False), ("script", True), ("textarea", True)])
def test_html_unclosed_elements(tag, lost):
    page = f"<article><h1>A title</h1><p>The first paragraph of this text is here.</p><{tag}><p>The second paragraph of this text is here.</p></article>"
    read = html_extract.Page(page)
    assert any("second" in b for _, b in read.blocks) != lost and any("first" in b for _, b in read.blocks)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, "/root/testdata/sf0.001"))
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        assert docs.count() > 0
        assert stage(spark, before.limit(0), "/root/testdata/sf0.001").count() == 0


def test_quality_scores_against_plain_loops():
    net = quality.Network(3)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = random.Random(4)
    texts = [b"", b"a", b"hello world", "naïve é".encode(), bytes(r.randrange(256) for _ in range(1300))]

    def score(text):
        chunks = []
        start = 0
        while True:
            chunk = text[start : start + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            responses = []
            for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
                window = np.concatenate([p["embed"][b] for b in chunk[at : at + quality.WIDTH]])
                responses.append(window @ p["filters"])
            chunks.append([max(0.0, max(one) + shift) for one, shift in zip(zip(*responses), p["shift"])])
            if start + quality.CHUNK >= len(text):
                break
            start += quality.HOP
        features = [sum(c) / len(chunks) for c in zip(*chunks)] + [max(c) for c in zip(*chunks)]
        hidden = [sum(f * w for f, w in zip(features, column)) + shift for column, shift in zip(p["dense"].T, p["dense_shift"])]
        logit = sum((h if h > 0 else 0.1 * h) * w for h, w in zip(hidden, p["out"])) + p["out_shift"][0]
        return 1 / (1 + math.exp(-logit))

    assert np.allclose(net.scores(texts), [score(t) for t in texts], atol=1e-5)


CLASHES = "row_ gone_ removed of_ size_ id word n known text_hash place taken key count at_ row".split()


def test_columns_with_clashing_names(spark):
    """Columns named like the operators' own stay as they are where rows come back, and change nothing elsewhere."""
    import corpus_pipeline
    from treeline.llm.mixing import mix
    from treeline.llm.packing import pack

    texts = corpus(9, 40) + ["same line here now\nown line " + str(i) for i in range(4)]
    plain = spark.createDataFrame([(i, t, "s" + str(i % 2), "en", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string, n_chars bigint")
    extra = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    rows = lambda df: sorted(map(str, df.select("doc_id", "text", "n_chars").collect()))
    for f in (deduplicated, lambda d: corpus_pipeline.near_dedup(spark, d, ""), mix, lambda d: quality.keep_good(d, labels)):
        out = f(extra)
        assert out.columns == extra.columns and rows(out) == rows(f(plain))
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASHES)
    for f in (fingerprints, lm.score, pack, lambda d: quality.classify(d, labels)):
        assert sorted(map(str, f(extra).collect())) == sorted(map(str, f(plain).collect()))


def test_hot_words_are_dealt_by_length(spark, monkeypatch):
    """Cells of word and size band alone: the same lines go."""
    from treeline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT", 2)
    test_line_dedup(spark, 4)


def test_intermediate_tables_go(spark):
    from pathlib import Path

    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    shared.mkdir(exist_ok=True)
    settings = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, setting = set(shared.iterdir()), spark.conf.get(settings)
    found = near_duplicates(frame(spark, corpus(3)))
    assert len(set(shared.iterdir()) - before) == 1 and found.count() > 0
    assert spark.conf.get(settings) == setting


def test_stages_begin_without_garbage(spark):
    """Every stage of the pipeline first lets the executors (here: this JVM) collect their whole heap."""
    import corpus_pipeline

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id bigint, text string, source string")
    before = full()
    dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
    assert full() > before


def test_workers_give_memory_back():
    import gc
    import os
    from pathlib import Path

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6

    last = []

    def run(batches):
        held = [np.ones(2_000, np.uint8) for _ in range(100_000)]
        last.append(held[-1])  # at the end of the heap: nothing below goes by itself
        yield from batches

    gc.collect()
    before = resident()
    assert list(common.tidy(run)([1, 2])) == [1, 2]
    assert resident() < before + 100

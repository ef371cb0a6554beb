"""Token counts, ranked search and whitening against brute force, on small tables with awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tessera.llm import ranked, tokencount, whitening

from .cases import SCHEMA, corpus, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    " ", "  ", "   a", "a ", "a  b   c", "▁", "▁▁a ▁ b", "a▁b", "\n", "\n\n a\n\n\nb \n", "\ta\t b", "<s> </s> <unk> <0x0A>", "日本語のテキスト", "한국어 텍스트", "emoji 😀😀 👩‍👩‍👧", "nul\0inside", "é ﬁ ａ",
    "http://example.com/a?b=c&d=e", "x" * 5000, "日本" * 3000, "aGVsbG8" * 900, "\n" * 700, " " * 900, "a" + " " * 333 + "b", "1234567890 3.14159", "don't  stop", "<|endoftext|> and <|endoftext|>",
]


def _fuzz(seed, n=300):
    r = random.Random(seed)
    alphabet = ["the", "ing", "a", "B", " ", " ", "  ", "▁", "\n", "\t", "é", "😀", "日", "0", "<s>", "-", "\r", " ", " "]
    return ["".join(r.choices(alphabet, k=r.randrange(0, 30))) for _ in range(n)]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_counts(spark, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [*ODD, *_fuzz(1), *(r[1] for r in corpus()), None, ""]
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in enumerate(texts)]
    docs = _docs(spark, texts).repartition(3)
    got = lambda **k: sorted(map(tuple, tokencount.count_tokens(docs, MODEL, limit=100, **k).collect()))
    assert got() == want
    # a table that holds little, caches that overflow and short stretches change nothing
    for name, value in (("TABLE_KEYS", 5), ("CACHE_KEYS", 3), ("STRETCH", 7), ("LONG_KEY", 4), ("SAMPLE_KEYS", 2)):
        monkeypatch.setattr(tokencount, name, value)
    assert got(sample_docs=20) == want
    assert tokencount.count_tokens(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted(map(str, tokencount.count_tokens(twice, MODEL).collect())) == sorted([f"Row(doc_id={i}, n_bytes=3, n_tokens=2, over_limit=False)" for i in (None, 1, 1)])


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_of_json_models(spark, file):
    path = public_tokenizers.path(file)
    t = tokenizers.Tokenizer.from_file(path)
    texts = [*ODD, *_fuzz(2), None]
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(_docs(spark, texts), path).collect()} == want


def test_a_long_text_of_pieces(spark):
    """16 MB without a blank, and 64 MB of words: cut into what pieces can't span."""
    p = tokencount.load_tokenizer(MODEL)
    lengths = tokencount.Lengths(p, {})
    unit = "日本語zqxj"
    n = (16 << 20) // len(unit.encode())
    one, two, three = (lengths.of(unit * k) for k in (1000, 1001, 1002))
    assert two - one == three - two and lengths.of(unit * n) == one + (n - 1000) * (two - one)
    assert lengths.of("word " * (13 << 20)) == 2 * lengths.of("word " * (13 << 19)) - (lengths.of("a word ") - lengths.of("a ") and 1)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _rank(docs, items, k=50):
    bags = [Counter(_terms(d[1])) for d in docs]
    n = [sum(b.values()) for b in bags]
    total, length = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * f + 1))) for t, f in df.items()}
    out = []
    for item, text in items:
        scores = []
        for (i, *_), b, own in zip(docs, bags, n):
            m = 50 + 50 * own * total // max(length, 1)
            s = sum(weight[t] * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(_terms(text)) if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _search_case(seed):
    r = random.Random(seed)
    docs = [(x[0], x[1]) for x in corpus(seed, 120, 80)] + [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7000, "W1-w2_w3.é"), *((8000 - i, "w5 w6 w5") for i in range(90))]
    items = [(i, " ".join(r.choices([f"w{j}" for j in range(90)], k=r.choice([1, 2, 5, 30])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "... !"), (103, "nowhere else"), (104, "w1 w2"), (104, "w1 w2"), (104, "w3"), (None, "w5 É é"), (105, " ".join(f"w{j} x{j}" for j in range(4000)))]
    return docs, items


@pytest.mark.parametrize("small", [None, (16, 4, 1), (7, 64, 8)])
def test_ranked_search(spark, monkeypatch, small):
    docs, items = _search_case(5)
    if small:
        for name, value in zip(("BLOCK_DOCS", "LEAF", "WIDTH", "PILOT", "SEARCH_TERMS", "ITEM_BYTES"), (*small, 2, 40, 4000)):
            monkeypatch.setattr(ranked, name, value)
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, key string").repartition(3)
    i = spark.createDataFrame([(*x, 1.0) for x in items], "item_id long, text string, score double")
    for k in (3,) if small else (50, 3):
        got = ranked.rank_documents(d, i, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == _rank(docs, items, k)


def test_ranked_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert ranked.rank_documents(none, items).count() == 0
    assert ranked.rank_documents(some, items.limit(0)).count() == 0
    assert ranked.rank_documents(spark.createDataFrame([(1, None), (2, ".")], "doc_id long, text string"), items).count() == 0


def test_ranked_search_reads_whole_texts(spark, monkeypatch):
    """A text read in stretches counts as one document."""
    from tessera.llm import textkit

    monkeypatch.setattr(textkit, "PIECE", 64)
    docs = [(1, " ".join(f"w{i % 7}" for i in range(400)) + " last"), (2, "w1 last"), (3, "w2")]
    items = [(1, "last w3"), (2, "w1 w2")]
    got = ranked.rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == _rank(docs, items)


def test_intervals_are_few(spark):
    """Where one document stands out, few intervals are looked at: the tables bound the rest away."""
    r = np.random.default_rng(3)
    size, terms = 4096, 12
    rows = [np.sort(r.choice(size, 900, replace=False)) for _ in range(terms)]
    impact = np.concatenate([r.integers(1, 100, len(x)) for x in rows])
    docs = np.concatenate(rows)
    impact[docs == docs[5]] = 100_000
    lists = ranked.Lists(np.array([len(x) for x in rows]), docs, impact, size)
    asked = []
    top = lists.top
    lists.top = lambda a, b: (asked.append(len(a)), top(a, b))[1]
    item, score, doc = ranked.search_block(lists, np.array([0, terms]), np.arange(terms), np.ones(1, np.int64), 1)
    assert doc.tolist() == [docs[5]] and score[0] == impact[docs == docs[5]].sum() and sum(asked) < 12 * 40
    for left, right in r.integers(0, 900, (200, 2)):
        a, b = min(left, right), max(left, right) + 1
        assert top(np.array([a]), np.array([b]))[0] == a + impact[a:b].argmax()


def _whitened(rows, want=8):
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(np.int64) + 100_000
    n = len(x)
    c = x - x.sum(0) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    return n, dev, e, c @ q[:, :want] / np.sqrt(e[:want])


@pytest.mark.parametrize("dim,n", [(1, 9), (3, 40), (48, 400), (90, 700)])
def test_whitening(spark, dim, n, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 20_000)
    if dim == 3:
        monkeypatch.setattr(whitening, "SUM_PARTS", 2)
    r = np.random.default_rng(dim)
    x = r.standard_normal((n, dim)) * r.uniform(0.2, 1.0, dim) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist()), (None, x[4].tolist())]
    odd = [(900, None), (901, [float("nan")] * dim), (902, [None] * dim), (903, [float("inf")] * dim), (904, [1.0] * (dim + 1)), (905, [])]
    got = whitening.whiten(spark.createDataFrame([(*x, 0) for x in rows + odd], "vec_id long, embedding array<double>, component int").repartition(5)).collect()
    total, dev, e, w = _whitened(rows)
    k = min(8, dim)
    assert len(got) == len(rows) * k and {g.component for g in got} == set(range(1, k + 1)) and all(g.n == total for g in got)
    assert got[0].identity_error < 1e-10 and got[0].residual < 1e-12
    assert sorted((str(g.vec_id), g.deviation) for g in got if g.component == 1) == sorted((str(i), d) for (i, _), d in zip(rows, dev))
    for c in range(k):
        mine = {g.vec_id: g.whitened for g in got if g.component == c + 1}
        assert all(abs(g.explained * e.sum() / e[c] - 1) < 1e-9 for g in got if g.component == c + 1)
        sign = np.sign(mine[0] * w[0, c])
        assert all(abs(sign * mine[i] - w[j, c]) < 1e-8 for j, (i, _) in enumerate(rows))


def test_whitening_without_variance(spark):
    frame_ = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame_([])).count() == 0
    assert whitening.whiten(frame_([(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame_([(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    assert whitening.whiten(frame_([(1, []), (2, None)])).count() == 0
    # rows on a plane of two dimensions among 50 have two components
    r = np.random.default_rng(1)
    plane = np.round(r.standard_normal((60, 2)) * 512) @ np.vstack([np.tile([1, 0], 25), np.tile([0, 1], 25)]) / 1024
    got = whitening.whiten(frame_([(i, v.tolist()) for i, v in enumerate(plane)])).collect()
    assert {g.component for g in got} == {1, 2} and got[0].identity_error < 1e-10


def test_whitening_of_large_entries(spark):
    """Entries are clamped, a deviation beyond 64 bits is null, and variance below double precision is none."""
    rows = [(i, [1e300 if i == 0 else -1e300 if i == 1 else float(i), float(i % 3)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {g.component for g in got} == {1} and len(got) == 20 and got[0].identity_error < 1e-6
    assert {g.vec_id for g in got if g.deviation is None} == {0, 1}

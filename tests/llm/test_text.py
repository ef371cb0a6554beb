import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard, langid, lm, quality, textkit
from tessera.llm.jaccard import divide_skip, group_links
from tessera.llm.suffix import suffix_array
from tessera.llm.textkit import Words, column_bytes, pieces

from .cases import corpus, words_of


def test_words_and_pieces():
    texts = [r[1] for r in corpus()]
    buf, off = column_bytes(pa.array(texts, pa.string()))
    seen = 0
    for i, b, o in pieces(buf, off, 700):
        w = Words(b, o)
        for k in range(len(o) - 1):
            mine = w.row == k
            got = [w.low[a:z].tobytes().decode() for a, z in zip(w.start[mine], w.end[mine])]
            assert got == words_of(texts[i + k])
            seen += 1
    assert seen == len(texts)
    assert column_bytes(pa.chunked_array([], pa.string()))[1].tolist() == [0]


def test_same_words_same_hash():
    buf, off = column_bytes(pa.array(["A b", "a  B\n", "ab", "b a"]))
    w = Words(buf, off)
    assert w.hash[:2].tolist() == w.hash[2:4].tolist()
    assert len({int(x) for x in w.hash}) == 3
    row, h, _ = w.shingles()
    assert h[row == 0] == h[row == 1] and h[row == 0] != h[row == 3]


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for _ in range(400):
        s = [r.randrange(1, r.choice([2, 3, 5, 30]) + 1) for _ in range(r.randrange(0, 50))] + [0]
        assert suffix_array(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:])


def test_divide_skip_against_counting():
    r = random.Random(2)
    for _ in range(400):
        lists = [sorted(r.sample(range(25), r.randrange(1, 15))) for _ in range(r.randrange(1, 12))]
        t = r.randrange(1, len(lists) + 1)
        count = {x: sum(x in y for y in lists) for x in range(25)}
        assert divide_skip(lists, t) == {x: c for x, c in count.items() if c >= t}


def test_group_links_connect_what_is_linked():
    r = random.Random(3)
    for size in (3, 8, 30, 60):
        base = [r.sample(range(200), 40) for _ in range(3)]
        sets = [frozenset(x if r.random() > 0.1 else r.randrange(400) for x in r.choice(base)) for _ in range(size)]
        row = np.concatenate([[i] * len(s) for i, s in enumerate(sets)])
        token = np.concatenate([sorted(s) for s in sets]).astype(np.uint64)
        links = group_links(row, token, np.array([len(s) for s in sets]), 75)
        linked = [(i, j) for i in range(size) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in linked}

        def classes(pairs):
            up = list(range(size))
            for i, j in pairs:
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
            return up

        assert classes(links) == classes(linked)


@pytest.mark.parametrize("seed", range(4))
def test_long_texts_in_stretches(seed, monkeypatch):
    """A long text read in stretches gives what it gives read at once."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcAB.9*ü", k=r.randrange(1, 30))) for _ in range(60)]
    text = "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t \n"]) for _ in range(700)) + "x" * 300 + " " + " ".join(r.choices(words[:3], k=200))
    buf, off = textkit.column_bytes(pa.array([text]))
    whole = [jaccard.shingle_sets(buf, off, 5)[1], quality.indicators(buf, off)[1], *lm.normal_form(textkit.Words(buf, off))[:1]]
    grams = sorted((int(b)) for _, bucket in langid.subwords(buf, off) for b in bucket)
    for module in (textkit, langid, lm):
        monkeypatch.setattr(module, "PIECE", 333)
    assert textkit.is_long(off)
    assert (jaccard.shingle_sets(buf, off, 5)[1] == whole[0]).all() and (quality.indicators(buf, off)[1] == whole[1]).all()
    parts = list(lm.parts_of(buf, off))
    assert len(parts) > 5 and (np.concatenate([p.runs for p in parts]) == whole[2]).all() and sum(int(p.ends.sum()) for p in parts) == 1
    assert (np.concatenate([p.hash for p in parts]) == textkit.Words(buf, off).hash).all()
    assert sorted((int(b)) for _, bucket in langid.subwords(buf, off) for b in bucket) == grams
    one, at = textkit.column_bytes(pa.array(["y" * 2000]))
    assert len(jaccard.shingle_sets(one, at, 5)[1]) == 1


def test_memory_of_a_batch():
    """What a worker takes to read a batch of texts stays a fraction of a task's memory; nulls don't make it copy the batch."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 10))) for _ in range(5000)]
    col = pa.array([None if i % 50 == 0 else " ".join(r.choices(words, k=300)) for i in range(2500)], pa.string())
    buf, off = column_bytes(col)
    assert np.shares_memory(buf, np.frombuffer(col.buffers()[2], np.uint8)) and len(buf) > 4 << 20
    assert all(off[i + 1] == off[i] for i in range(0, 2500, 50))
    model = quality.QualityModel(np.zeros(1 << quality.BITS), 0.0, 1.0, 0.0)

    def sets():
        for _, b, o in pieces(buf, off):
            row, h, n, _ = jaccard.shingle_sets(b, o, 5)
            jaccard.sketches(row, h, n)

    for work in (lambda: model.scores(buf, off), sets):
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 24 << 20, most


def test_null_texts_that_hold_bytes():
    held = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(bytes([0b101])), pa.py_buffer(np.array([0, 1, 3, 4], np.int32)), pa.py_buffer(b"axyb")])
    for col, text, ends in ((held, b"ab", [0, 1, 1, 2]), (held.slice(1), b"b", [0, 0, 1]), (pa.nulls(2, pa.string()), b"", [0, 0, 0])):
        buf, off = column_bytes(col)
        assert buf.tobytes() == text and off.tolist() == ends

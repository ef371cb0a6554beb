"""Every operator against brute force on a small corpus with awkward rows, and on an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, components, decontaminate, jaccard, langid, licenses, lm, mixing, quality, secrets, suffix, textkit
from tessera.llm.common import fold

from .cases import SCHEMA, corpus, frame, words_of


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _shingles(text, k=5):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_jaccard(docs, none, rows):
    sets = [_shingles(r[1]) for r in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    names = {}
    for i, r in enumerate(rows):
        names[up[i]] = min(names.get(up[i], 1 << 60), r[0])
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {(r[0], len(sets[i]), names[up[i]] if sets[i] else r[0]) for i, r in enumerate(rows)}
    assert jaccard.jaccard_components(none).count() == 0


def test_jaccard_blocks_and_unscreened_lists(docs, monkeypatch):
    want = {tuple(r) for r in jaccard.jaccard_components(docs).collect()}
    monkeypatch.setattr(jaccard, "GROUP_MOST", 2)
    monkeypatch.setattr(jaccard, "LIST_MOST", 2)
    monkeypatch.setattr(jaccard, "HUBS", 1)
    assert {tuple(r) for r in jaccard.jaccard_components(docs).collect()} == want


def test_jaccard_null_and_repeated_ids(spark):
    r = random.Random(9)
    names = [f"w{i}" for i in range(500)]
    base = r.choices(names, k=80)
    near, odd = " ".join([*base[:40], "zz", *base[41:]]), " ".join(r.choices(names, k=50))
    d = spark.createDataFrame([(None, near, 1), (5, " ".join(base), 2), (5, " ".join(base), 3), (7, odd, 4), (7, odd, 5), (9, None, 6), (None, "", 7), (8, near, 8), (5, odd, 9)], "doc_id long, text string, key long")
    got = sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in jaccard.jaccard_components(d).collect())
    assert got == sorted([("None", 76, "5"), ("5", 76, "5"), ("5", 76, "5"), ("8", 76, "5"), ("7", 46, "5"), ("7", 46, "5"), ("5", 46, "5"), ("9", 0, "9"), ("None", 0, "None")])
    kept = jaccard.keep_one(d)
    assert kept.columns == d.columns and sorted((str(x.doc_id), x.text) for x in kept.collect()) == sorted([("5", " ".join(base)), ("5", odd), ("9", None), ("None", "")], key=str)


def test_jaccard_of_very_long_texts(spark, tmp_path):
    """Texts of 64 MB, each of which outweighs GROUP_MOST sets: the links are those of the sets."""
    r = random.Random(17)
    words = [f"w{r.randrange(10**9)}" for _ in range(20_000)]
    body = " ".join(words)
    copies = (64 << 20) // len(body) + 1
    long_, near, half = " ".join([body] * copies), " ".join([body] * copies + ["a b c d e f"]), " ".join(words[:10_000])
    small = [" ".join(r.choices(words, k=60)) for _ in range(4)]
    texts = [half, near, long_, *small, small[0] + " end", body]
    assert len(long_) >= 64 << 20
    for i, t in enumerate(texts):
        pq.write_table(pa.table({"doc_id": pa.array([i], pa.int64()), "text": [t]}), tmp_path / f"{i}.parquet")
    d = spark.read.parquet(str(tmp_path))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in (half, " ".join([body, body, "a b c d e f"]), " ".join([body, body]), *texts[3:]))]
    want = list(enumerate(zip(map(len, sets), _linked(sets))))
    assert [x[1][1] for x in want] == [0, 1, 1, 3, 4, 5, 6, 3, 1]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(d).collect()}
    assert got == dict(want)


def _linked(sets, percent=75):
    up = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    return up


@pytest.mark.parametrize("known", [False, True])
def test_group_links(known):
    """The search with merged components gives the components of all pairs, for families, chains and strangers."""
    r = random.Random(11)
    for turn in range(12):
        sets = []
        for _ in range(r.randrange(2, 6)):
            sets.append(set(r.sample(range(400), r.randrange(8, 60))))
            for _ in range(r.randrange(30)):
                own = list(r.choice(sets[-9:]))
                for _ in range(r.randrange(6)):
                    own[r.randrange(len(own))] = r.randrange(400)
                sets.append(set(own))
        want = _linked(sets)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        token = np.concatenate([np.array(sorted(x), np.uint64) for x in sets])
        given = np.array([want[i] if i % 3 else -i - 1 for i in range(len(sets))]) if known else None
        links = jaccard.group_links(row, token, np.array([len(x) for x in sets]), 75, given)
        up = list(range(len(sets)))
        groups = [(i, j) for i in range(len(sets)) for j in range(i) if known and given[i] == given[j]]
        for i, j in links + groups:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
        assert up == want, turn


def test_components_of_chains_and_cycles(spark):
    r = random.Random(12)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)] + [(7, 7), (5000, 4999), (4999, 5000), (None, 3)]
    up = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = up.setdefault(a, a), up.setdefault(b, b)
            up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(13)).collect()
    assert len(got) == len(up) and {x.node: x.root for x in got} == up
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    named = {r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert set(ids) == named


def _repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    starts = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if starts[b[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, none, rows):
    got = collections.Counter(tuple(r) for r in suffix.cut_repeats(docs).collect())
    assert got == collections.Counter((r[0], *x) for r, x in zip(rows, _repeats([r[1] for r in rows])))
    assert suffix.cut_repeats(none).count() == 0
    r = random.Random(5)
    odd = ["ab" * 150, "ab" * 149 + "c", "a" * 260, "b" + "a" * 205, *("".join(r.choices("ab", k=30)) * 9 for _ in range(3)), "ü" * 150, "é" + "ü" * 120]
    frame_ = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:5] for r in suffix.cut_repeats(frame_, with_text=True).collect()}
    assert got == dict(enumerate(_repeats(odd)))


def test_suffix_array():
    r = random.Random(3)
    for _ in range(200):
        n, letters = r.randrange(1, 80), r.randrange(1, 5)
        s = [*(r.randrange(1, letters + 1) for _ in range(n)), 0]
        assert suffix.suffix_array(np.array(s)) == sorted(range(n + 1), key=lambda i: s[i:])


def _contexts(seed=4, m=60):
    """Contexts of one gram that leave a common text at different places on either side; and brute force over them."""
    r = random.Random(seed)
    letters = lambda k: bytes(r.choices(b"ab", k=k))
    common, gram = [letters(168) for _ in range(3)], letters(32)
    tails = [letters(168) for _ in range(3)]
    rows = []
    for _ in range(m):
        a, b = r.choice([0, 40, 90, 168]), r.choice([0, 50, 100, 168])
        rows.append((letters(r.randrange(168 - a + 1)) + r.choice(common)[168 - a:], gram + r.choice(tails)[:b] + letters(r.randrange(168 - b + 1))))
    starts = collections.Counter((-t, (x[len(x) - t:] + y)[:200]) for x, y in rows for t in range(len(x) + 1) if len(y) >= 200 - t)
    want = {(i, j) for i, (x, y) in enumerate(rows) for t in range(len(x) + 1) if len(y) >= 200 - t and starts[-t, (x[len(x) - t:] + y)[:200]] > 1 for j in range(-t, 200 - t)}
    text = np.frombuffer(b"".join(x + y for x, y in rows), np.uint8)
    return text, np.cumsum([0, *(len(x) + len(y) for x, y in rows)]), np.array([len(x) for x, _ in rows]), want


def test_repeats_are_read_off_the_suffix_order(monkeypatch):
    text, offsets, left, want = _contexts()
    covered = lambda: {(i, j) for i, a, z in suffix.repeated_offsets(text, offsets, left) for j in range(a, z)}
    assert want and covered() == want
    # an order by the first symbol alone loses repeats
    monkeypatch.setattr(suffix, "suffix_array", lambda s: np.argsort(s, kind="stable").tolist())
    assert covered() != want


@pytest.mark.parametrize("width", [suffix.WIDE, suffix.NARROW, 13])
def test_rings_of_cores_give_the_same_repeats(width, monkeypatch):
    """Bands and cores lose nothing: each core's rings, sorted by themselves, cover what whole contexts cover."""
    monkeypatch.setattr(suffix, "CHUNK", 50)
    text, offsets, left, want = _contexts(seed=8, m=90)
    context, low, ring = suffix.rings(np.zeros(len(left), np.uint64), text, offsets, left, width)
    first, back, times = suffix.distinct_rings(ring)
    covered = set()
    for x in np.flatnonzero(times[back] > 1):
        (begin, end), = suffix.ring_spans(np.zeros(1, np.int64), low[[x]], ring[[x]])
        covered |= {(context[x], j) for j in range(begin, end)}
    for i, begin, end in suffix.repeated_rings(ring[first]):
        covered |= {(context[x], j - low[x]) for x in np.flatnonzero(back == i) for j in range(begin, end)}
    assert want and covered == want


@pytest.mark.parametrize("most", [suffix.GRAM_MOST, 100])
def test_suffix_dedup_of_a_gram_in_20000_contexts(spark, most, monkeypatch):
    """A gram of more than GRAM_MOST contexts, and of more than 64 times as many."""
    monkeypatch.setattr(suffix, "GRAM_MOST", most)
    r = random.Random(21)
    letters = lambda k: "".join(r.choices("abcdefgh ", k=k))
    passage, heads, tails = letters(170), [letters(40) for _ in range(3)], [letters(40) for _ in range(3)]
    texts = []
    for _ in range(20_000):
        h, t = r.randrange(41), r.randrange(41)
        texts.append(letters(r.randrange(30)) + r.choice(heads)[40 - h:] + passage + r.choice(tails)[:t] + letters(r.randrange(30)))
    _, _, gram, context, _ = suffix.marks(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert max(collections.Counter(g for g, _ in set(zip(gram.tolist(), context.tolist()))).values()) > max(8192, 64 * 100)
    frame_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {x.doc_id: tuple(x)[1:] for x in suffix.cut_repeats(frame_).collect()}
    assert got == dict(enumerate(_repeats(texts)))


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    r = random.Random(13)
    passage = "".join(r.choices("abcdefgh ", k=700))
    texts = ["".join(r.choices("abcdefgh ", k=n)) + passage + "".join(r.choices("abcdefgh ", k=5000)) for n in (9000, 300, 40)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix, "MARKED", 600)
    assert {x.doc_id: tuple(x)[1:] for x in suffix.cut_repeats(d).collect()} == dict(enumerate(_repeats(texts)))


def test_suffix_dedup_large_grams(spark, docs, rows, monkeypatch):
    """Contexts of a gram with more than GRAM_MOST never meet, and the rows are the same."""
    sort = suffix.repeated_offsets

    def bounded(text, offsets, left):
        mark = offsets[:-1] + left
        grams = collections.Counter(text[m:m + suffix.RUN].tobytes() for m in mark)
        assert max(grams.values()) <= 3
        return sort(text, offsets, left)

    r = random.Random(6)
    odd = lambda n: "".join(r.choices("abcdefgh ", k=n))
    passage, tail = odd(420), odd(150)
    texts = [odd(r.randrange(300)) + passage + (tail[:r.randrange(150)] if i % 3 else "") + odd(r.randrange(300)) for i in range(60)]
    texts += [texts[0], "x" * 700, "xy" * 300, *(odd(250) + passage[60:250] + odd(200) for _ in range(9))]
    frame_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(suffix, "repeated_offsets", bounded)
    monkeypatch.setattr(suffix, "GRAM_MOST", 3)
    assert {x.doc_id: tuple(x)[1:] for x in suffix.cut_repeats(frame_).collect()} == dict(enumerate(_repeats(texts)))
    monkeypatch.setattr(suffix, "GRAM_MOST", 1)
    monkeypatch.setattr(suffix, "CHUNK", 5)
    assert {x.doc_id: tuple(x)[1:] for x in suffix.cut_repeats(frame_).collect()} == dict(enumerate(_repeats(texts)))
    got = collections.Counter(tuple(x) for x in suffix.cut_repeats(docs).collect())
    assert got == collections.Counter((x[0], *y) for x, y in zip(rows, _repeats([x[1] for x in rows])))


def test_decontamination(spark, docs, none, rows):
    r = random.Random(4)
    items = [(i, t) for i, t in enumerate([rows[4][1][:300], " ".join(r.choices([f"w{i}" for i in range(300)], k=30)), None, "", "one two three", rows[64 % len(rows)][1]])]
    plant = [(900, "zz " * 30 + items[1][1] + " yy" * 9, *[None] * 6), (901, "zz " * 7 + " ".join([*items[1][1].split()[:15], "odd", *items[1][1].split()[15:]]), *[None] * 6)]
    every = docs.unionByName(frame(spark, plant))
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_contamination(every, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for row in [*rows, *plant]:
        w = (row[1] or "").lower().split()
        for i, t in items:
            own = (t or "").lower().split()
            k = min(5, len(own))
            if not own:
                continue
            a = collections.Counter(tuple(own[x:x + k]) for x in range(len(own) - k + 1))
            here = [tuple(w[x:x + k]) for x in range(len(w) - k + 1)]
            span = len(own) - k + 1
            for s in range(max(1, len(here) - span + 1)):
                b = collections.Counter(here[s:s + span])
                sim = sum((a & b).values()) / max(1, sum((a | b).values()))
                want[row[0], i] = max(want.get((row[0], i), 0), sim)
    assert got.keys() == {k for k, v in want.items() if v >= 0.75}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert (900, 1) in got
    kept = decontaminate.drop_contaminated(every, spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in [*rows, *plant]} - {d for d, _ in got} and kept.columns == docs.columns
    assert decontaminate.find_contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.find_contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_repeated_and_null_ids(spark):
    r = random.Random(14)
    item, other = (" ".join(r.choices([f"w{i}" for i in range(900)], k=30)) for _ in range(2))
    half = " ".join([*item.split()[:15], "x", "y", "z", *item.split()[18:]])
    rows = [(1, half), (1, f"a {item} b"), (2, item), (2, half), (None, item), (None, "clean words"), (3, f"{other} c"), (4, "clean too"), (5, " ".join(["again and again"] * 40))]
    items = [(7, item), (7, other), (None, other), (8, " ".join(["again and again"] * 12))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {(1, 7): 1.0, (2, 7): 1.0, (None, 7): 1.0, (3, 7): 1.0, (3, None): 1.0, (5, 8): 1.0}
    kept = collections.Counter((x.doc_id, x.text) for x in decontaminate.drop_contaminated(docs, bench).collect())
    assert kept == collections.Counter([(1, half), (2, half), (None, "clean words"), (4, "clean too")])


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    assert decontaminate.BLOCKS * decontaminate.BITS == 128 and decontaminate.RADIUS < (decontaminate.FLIPS + 1) * decontaminate.BLOCKS
    r = random.Random(15)
    left, right = [], []
    for i in range(60):
        near = own = r.getrandbits(128)
        for bit in r.sample(range(128), decontaminate.RADIUS if i < 30 else r.randrange(decontaminate.RADIUS)):
            near ^= 1 << bit
        for side, x in ((left, own), (right, near)):
            side.append((i, *(h - (h >> 63 << 64) for h in (x & (1 << 64) - 1, x >> 64))))
    a, b = (spark.createDataFrame(x, "i int, f long, g long") for x in (left, right))
    pairs = a.withColumn("x", decontaminate.blocks()).alias("a").join(b.withColumn("y", decontaminate.near_blocks()).alias("b"), "i")
    assert pairs.filter(F.arrays_overlap("x", "y") & (decontaminate.distance("a", "b") <= decontaminate.RADIUS)).count() == 60
    assert pairs.filter(decontaminate.distance("a", "b") == decontaminate.RADIUS).count() >= 30


def test_fingerprint_is_the_majority_of_each_bit(spark):
    r = random.Random(16)
    hashes = [[r.getrandbits(63) for _ in range(n)] for n in (1, 2, 7, 40)]
    got = decontaminate.with_simhash(spark.createDataFrame([(x,) for x in hashes], "h array<long>"), "h").withColumn("h2", F.transform("h", lambda h: F.xxhash64(h))).collect()
    for row in got:
        for half, votes in ((row.f, row.h), (row.g, row.h2)):
            assert half & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_decontamination_moved_parts(spark):
    r = random.Random(8)
    pool = [f"w{i}" for i in range(4000)]
    item = r.sample(pool, 40)
    parts = {"swapped": item[20:] + item[:20], "turned": item[13:] + item[:13], "thirds": item[26:] + item[13:26] + item[:13], "half": item[:20]}
    texts = []
    for part in parts.values():
        for before, after in ((50, 50), (0, 30), (30, 0), (0, 0), (3, 2)):
            texts.append([*r.sample(pool, before), *part, *r.sample(pool, after)])
    texts.append([*item[20:], *item[:20]] * 3)
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    grams = lambda w: [tuple(w[x:x + 5]) for x in range(len(w) - 4)]
    own, want = collections.Counter(grams(item)), {}
    for i, t in enumerate(texts):
        here = grams(t)
        windows = [collections.Counter(here[s:s + 36]) for s in range(max(1, len(here) - 35))]
        best = max(sum((own & b).values()) / sum((own | b).values()) for b in windows)
        if best >= 0.75:
            want[i] = best
    got = {x.doc_id: x.similarity for x in decontaminate.find_contamination(docs, items).collect()}
    assert got.keys() == want.keys() and {0, 1, 2, 3, 4} <= got.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs, items).collect()} == set(range(len(texts))) - want.keys()


def test_licenses(spark, docs, none):
    assert min(licenses.collision_probability(m) for m in range(5, 200)) > 0.9999
    mit = licenses.TEMPLATES["MIT"]
    plant = [(900, f"a b c. {mit} d e", *[None] * 6), (901, mit.upper(), *[None] * 6), (902, "Released under the BSD License.", *[None] * 6), (900, mit, *[None] * 6)]
    got = {(r.doc_id, r.license, r.containment) for r in licenses.scan_licenses(docs.unionByName(frame(spark, plant)), licenses.default_templates(spark)).collect()}
    assert got == {(900, "MIT", 1.0), (901, "MIT", 1.0)}
    assert licenses.scan_licenses(none, licenses.default_templates(spark)).count() == 0
    short = spark.createDataFrame([("pd", "Public Domain"), ("none", None)], "license string, text string")
    hit = licenses.scan_licenses(frame(spark, [(1, "in the public domain now", *[None] * 6)]), short).collect()
    assert [(r.doc_id, r.license) for r in hit] == [(1, "pd")]


def test_mixing(spark, docs, none, rows):
    first = mixing.mixture_digest(mixing.mix_sources(docs, block=4)).collect()
    again = mixing.mixture_digest(mixing.mix_sources(docs.repartition(5), block=4)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    size = collections.Counter()
    for r in rows:
        size[r[0], r[3]] += len(words_of(r[1]))
    assert {(r.doc_id, r.source): r.size for r in first} == dict(size)
    totals = collections.Counter()
    for (_, s), n in size.items():
        totals[s] += n
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(totals.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * totals[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= set(over)
    taken = collections.Counter()
    for r in first:
        assert r.taken <= 2 * r.size and r.source_size == totals[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(8, 0.02 * target[s]) for s in order)
    assert mixing.mixture_digest(mixing.mix_sources(none)).count() == 0
    assert mixing.mixture_digest(mixing.mix_sources(docs.filter("text is null or text = ''"))).agg(F.sum("taken")).first()[0] == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_language(spark, none):
    r = random.Random(1)
    syllables = {"en": ["the", "ing", "ou", "th"], "de": ["sch", "ung", "ein", "ü"], "es": ["ción", "ado", "ñ", "ue"]}
    rows = [(i, " ".join("".join(r.choices(syllables[g], k=3)) for _ in range(40)), g, "s", 0, 0.0, "", "") for i, g in enumerate(r.choices(list(syllables), k=240))]
    rows += [(900, None, "en", *[None] * 5), (901, "123 --- 4", "en", *[None] * 5), (902, "", None, *[None] * 5), (903, "a", "en", *[None] * 5)]
    d = frame(spark, rows)
    out = langid.predict_language(d, langid.fit_language(d.filter(fold("doc_id", 4) != 2), 50)).collect()
    by = {x.doc_id: x for x in out}
    held = [x for x in out if x.doc_id < 900 and zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert sum(x.lang == x.lang_pred for x in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0 and all(0 <= x.score <= 1 for x in out)
    assert langid.predict_language(none, langid.fit_language(none)).count() == 0
    assert {x.lang_pred for x in langid.predict_language(d, langid.fit_language(none)).collect()} == {"und"}


def test_language_model_by_hand():
    """Scores are the softmax of the average embedding of all subwords, whichever side is summed up."""
    r = np.random.default_rng(4)
    texts = ["Ab  cd", "", "x", "Übung macht", "aaaa aaaa", None]
    buf, off = textkit.column_bytes(pa.array(texts, pa.string()))
    for k in (3, 20):
        m = langid.LanguageModel([str(i) for i in range(k)], r.normal(size=(1 << langid.BITS, langid.DIM)), r.normal(size=(langid.DIM, k)), r.normal(size=k), 0.7, 0.0)
        got = m.probabilities(buf, off)
        for text, p in zip(texts, got):
            b = [32 if c in (32, *range(9, 14)) else c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
            rows = []
            for n in langid.ORDERS:
                for i in range(len(b) - n + 1):
                    code = int.from_bytes(bytes(b[i:i + n]), "big")
                    h = (code * 2654435761 & 0xFFFFFFFF) ^ (n * 0x9E3779B1 & 0xFFFFFFFF)
                    h = (h ^ h >> 15) * 0x85EBCA77 & 0xFFFFFFFF
                    rows.append(m.embed[h >> 32 - langid.BITS])
            z = ((np.mean(rows, axis=0) if rows else np.zeros(langid.DIM)) @ m.out + m.bias) / m.temperature
            want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert np.abs(p - want).max() < 1e-9


def test_language_sample(spark):
    rows = [(i, f"text {i}", "a") for i in range(3000)] + [(i, "same", "b") for i in [7] * 2000] + [(5000 + i, f"t{i}", "c") for i in range(5)] + [(1, "x", None)]
    got = collections.Counter(x.lang for x in langid.language_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 1000).collect())
    assert 60 <= got["a"] <= 150 and got["b"] == 1 and got["c"] == 5 and len(got) == 3


def test_lm(docs, none, rows):
    got = lm.score_texts(docs.select("doc_id", "text"), fold("doc_id", 7) != 2).collect()
    count = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            count.update([*words_of(r[1]), None])
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for r in rows:
        w = [*words_of(r[1]), None]
        want[r[0], len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert all(x.train_tokens == n and x.score < 0 for x in got)
    model = _ppm([" ".join(words_of(r[1])) + "\n" for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2], lm.ORDER)
    text = {r[0]: " ".join(words_of(r[1])) + "\n" for r in rows}
    for x in got[::9]:
        assert abs(x.score - _ppm_score(model, text[x.doc_id], lm.ORDER)) < 1e-3 * max(1, abs(x.score))
    assert lm.score_texts(none.select("doc_id", "text"), F.lit(True)).count() == 0
    untrained = lm.score_texts(docs.select("doc_id", "text"), F.lit(False)).collect()
    assert all(x.n_known == 0 and abs(x.score + len(text[x.doc_id].encode()) * math.log10(256)) < 1e-2 for x in untrained)


def _ppm(texts, order):
    """Nodes by context, from the longest down: the deepest count, the others count the longer contexts."""
    levels = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for t in texts:
        b = b"\n" * order + t.encode()
        for i in range(order, len(b)):
            levels[order][b[i - order:i]][b[i]] += 1
    for k in range(order, 0, -1):
        for c, node in levels[k].items():
            for s in node:
                levels[k - 1][c[1:]][s] += 1
    return levels


def _ppm_score(levels, text, order):
    b, total = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(b)):
        gone: set = set()
        for k in range(order, -1, -1):
            node = levels[k].get(b[i - k:i])
            if node is None:
                continue
            left = {s: c for s, c in node.items() if s not in gone}
            n = sum(left.values())
            if n:
                if b[i] in left:
                    total += math.log10((left[b[i]] - lm.ESCAPE) / n)
                    break
                total += math.log10(lm.ESCAPE * len(left) / n)
            gone = set(node)
        else:
            total -= math.log10(256 - len(gone))
    return total


def test_ppm_probabilities_sum_to_one():
    levels = _ppm(["abracadabra\n", "abab cab\n"], 3)
    for context in (b"abr", b"zab", b"zzz", b"\n\n\n"):
        total = 0.0
        for s in range(256):
            runs = np.array([int.from_bytes(context + bytes([s]), "big")], np.uint64)
            built = []
            for k in range(4):
                keys = sorted((int.from_bytes(c + bytes([x]), "big"), n) for c, node in levels[k].items() for x, n in node.items())
                built.append(lm.Level(np.array([a for a, _ in keys], np.uint64), np.array([n for _, n in keys])))
            for k in range(1, 4):
                built[k].link(built[k - 1], k)
            total += 10 ** lm.code_lengths(runs, built)[0]
        assert abs(total - 1) < 1e-9


def test_neighbours(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(900, 16))
    v[700:] = v[3]
    rows = [(int(i), [float(y) for y in np.float32(x)], "clash") for i, x in enumerate(v)]
    rows += [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [1.0, None] + [1.0] * 14, ""), (2080, [1.0] * 3, "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = collections.defaultdict(list)
    for x in ann.nearest(d, F.col("vec_id") % 20 == 0).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    x = np.array([row[1] for row in rows[:900]])
    hit = 0
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hit += len({f[1] for f in found} & set(best.tolist()))
    assert hit >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:5], d.schema)
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.nearest(spark.createDataFrame([], d.schema), F.lit(True)).count() == 0


def test_large_leaves_get_trees_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPLIT_ROWS", 60)
    monkeypatch.setattr(ann, "BUCKET_ROWS", 80)
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 8)) * 3
    x = np.float32(centres[r.integers(0, 12, 2500)] + r.normal(size=(2500, 8)))
    d = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = collections.defaultdict(list)
    for row in ann.nearest(d, F.col("vec_id") % 20 == 0, sample_rows=600).collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    x, hit = x.astype(float), 0
    for q, found in got.items():
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s - score[i]) < 1e-9 for _, i, s in found)
        hit += len({f[1] for f in found} & set(np.lexsort((np.arange(2500), -score))[:20].tolist()))
    assert len(got) == 125 and hit >= 0.9 * 20 * 125
    tree = ann.fit_tree(x[:600])
    tree.below[0] = ann.fit_tree(x[600:900])
    assert tree.below[0].leaves > 1 and len({n for numbers in tree.walk(x[0]) for n in numbers}) <= tree.leaves and tree.assign(x).max() < tree.leaves


def test_hot_leaf_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 50)
    rows = [(i, [1.0, 0.0] if i < 300 else [math.cos(i), math.sin(i)]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = [r.vec_id for r in ann.nearest(d, F.col("vec_id") == 40).orderBy("rank").collect()]
    assert top == list(range(20))


def test_secrets(spark, docs, none):
    r = random.Random(7)
    hexa = "0123456789abcdef"
    body = "".join(r.choices("abcXYZ019", k=30))
    good, bad = "ghp_" + body + secrets.base62_crc(body), "ghp_" + body + "000000"
    texts = [None, "", 'password = "abc" token: abcdef', "tokentoken=abcdefg secret='ÄÖ' API_KEY=a/b+c=d", "ü AKIA" + "A1" * 9 + " akia" + "A" * 20, "AKIAAKIA" * 4, "x" + "".join(r.choices(hexa, k=24)) + "g", "".join(r.choices(hexa, k=23)), "f" * 500, good + " " + bad, "passwordpassword=password=password"]
    texts += ["".join(r.choices("abcdef0123ghXtoken=:secret \"'", k=400)) for _ in range(40)]
    d = frame(spark, [(i, t, *[None] * 6) for i, t in enumerate(texts)])
    for row in secrets.scan_secrets(d.unionByName(docs)).collect():
        t = row.text or ""
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in sorted(found))
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == j for _, k, _ in found) for j in range(3)]
        assert set(text.split(",")) - {""} <= set(row.spans.split(","))
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(d).collect()}
    assert spans[9].count("github") == 1
    masked = {r.doc_id: r.text for r in secrets.redact_secrets(d).collect()}
    assert masked[2] == 'password = "abc" [secret]' and masked[0] is None and masked[8] == "[secret]"
    assert secrets.scan_secrets(none).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    """At the optimum of the dual, rows beyond the margin have no weight, rows inside it all they may have, and the weights are the sum of the rows."""
    r = np.random.default_rng(6)
    feats = [np.unique(r.integers(0, 40, r.integers(1, 12))).astype(np.int32) for _ in range(120)]
    rows = quality.Rows(pa.chunked_array([pa.array(feats, pa.list_(pa.int32()))]))
    y = np.where(r.random(120) < 0.4, 1.0, -1.0)
    values = r.normal(size=40)
    w, bias = quality.dual_coordinate_descent(rows, values, y, np.arange(120), 0.5, 3000)
    x = np.zeros((120, 41))
    for i in range(120):
        x[i, rows[i]] = values[rows[i]]
    x[:, 40] = 1
    top = np.array([0.5 * 120 / (2 * (y == v).sum()) for v in y])

    def loss(v):
        return 0.5 * v @ v + (top * np.maximum(0, 1 - y * (x @ v))).sum()

    best = loss(np.append(w, bias))
    for _ in range(400):
        assert best <= loss(np.append(w, bias) + r.normal(size=41) * r.choice([1e-3, 1e-2, 0.1, 1])) + 1e-3
    assert best <= loss(np.zeros(41))


def test_sampled_rows_are_bounded_by_buckets(spark):
    r = random.Random(3)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(4000))
    rows = [pa.record_batch({"lang": ["a", "b"], "label": pa.array([1, 0], pa.int32()), "text": [long, "one two three four"]})]
    for task, columns in ((langid._counts, ("feats", "times")), (quality._features, ("feats",))):
        every, few = ([b.to_pydict() for b in task(most)(iter(rows))] for most in (1 << 30, 100))
        every, few = ({c: [x for b in side for x in b[c]] for c in columns} for side in (every, few))
        assert len(every["feats"][0]) > 5000 and len(few["feats"][0]) == 100
        assert all(few[c][1] == every[c][1][:] for c in columns) and len(few["feats"][1]) < 100
        # the buckets that stay are the same in every row, and keep their counts
        first = [dict(zip(x["feats"][0], x[columns[-1]][0])) for x in (every, few)]
        assert first[1].items() <= first[0].items()
        order = textkit.mix(np.array(every["feats"][0], np.uint64) + np.uint64(1))
        assert set(few["feats"][0]) == {f for _, f in sorted(zip(order.tolist(), every["feats"][0]))[:100]}
    texts = [(i, " ".join(r.choice(("good", "fine") if i % 2 else ("bad", "poor")) for _ in range(30)), i % 2) for i in range(200)]
    model = quality.fit_quality(spark.createDataFrame(texts, "doc_id long, text string, label int"), buckets=8)
    assert np.isfinite(model.weight).all()


def test_quality_indicators_by_hand(spark):
    """Counts of the classes, and so the ratios, are those of a scan word by word."""
    texts = ["One two two", "two 3 !!", "", "a", "one two two"]
    for text in texts:
        b = pa.array([text], pa.string())
        w = words_of(text)
        row, feat = quality.indicators(*textkit.column_bytes(b))
        kinds = [(any(c.isalpha() for c in x), any(c.isdigit() for c in x), sum(not c.isalnum() for c in x)) for x in w]
        shapes = [a + 2 * d + 4 * min(s, 3) + 16 * (i > 0 and w[i] == w[i - 1]) for i, (a, d, s) in enumerate(kinds)]
        grams = len(set(w)) + len(set(zip(w, w[1:]))) + len({tuple(shapes[i:i + 4]) for i in range(len(w) - 3)})
        low = [32 if c in (32, *range(9, 14)) else c for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()]
        assert len(feat) == len(set(feat.tolist())) == grams + len({tuple(low[i:i + 3]) for i in range(len(low) - 2)})
    d = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, label int").repartition(3)
    sums = {}
    for r in d.select("text", "label").mapInArrow(quality._count, "slice int, part int, counts binary").collect():
        sums[r.slice] = sums.get(r.slice, 0) + np.frombuffer(r.counts, np.int64)
    per = (1 << quality.BITS) // quality.SLICE
    for c in (0, 1):
        want = np.zeros(1 << quality.BITS, np.int64)
        for i, t in enumerate(texts):
            if i % 2 == c:
                want[quality.indicators(*textkit.column_bytes(pa.array([t], pa.string())))[1]] += 1
        assert (np.concatenate([sums[c * per + i] for i in range(per)]) == want).all()
    assert sums[2 * per].tolist() == [3, 2]


def test_quality(spark, docs, none):
    r = random.Random(2)
    names = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rows, labels = [], []
    for i in range(300):
        good = i % 4 != 0
        w = r.choices(names, k=60)
        rows.append((i, " ".join(w if good else [x + "***" for x in w] if i % 8 else [w[0]] * 60), *[None] * 6))
        labels += [(i, int(good), "clash")] if i % 7 else [(i, None, "clash"), (i, 5, "clash")]
    d = frame(spark, rows)
    lab = spark.createDataFrame([*labels, labels[1]], "doc_id long, quality int, text string")
    train = quality.labelled_rows(d, lab, fold("doc_id", 5) != 0)
    assert train.count() == len({i for i, q, _ in labels if q in (0, 1) and zlib.crc32(str(i).encode()) % 5})
    model = quality.fit_quality(train)
    out = quality.quality_scores(d.unionByName(docs), model)
    assert out.columns.count("score") == 1
    got = {x.doc_id: x.score for x in out.filter("row is null").collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert quality.quality_scores(none, model).count() == 0
    flat = quality.fit_quality(quality.labelled_rows(none, lab, F.lit(True)))
    assert {x.score for x in quality.quality_scores(d, flat).collect()} == {0.5}

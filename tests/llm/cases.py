"""Small corpora with awkward rows."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, h string"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def corpus(seed=0, n=60, vocabulary=300):
    """Random texts, exact and near copies, a shared passage, nulls, empty, blank, one-word, long and non-ASCII texts; repeated rows."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(vocabulary)]
    texts = []
    shared = " ".join(r.choices(names, k=60))
    for i in range(n):
        kind = i % 6
        if kind < 2 or not texts:
            t = r.choices(names, k=r.randrange(3, 120))
        elif kind == 2:
            t = list(r.choice(texts))
        elif kind == 3:
            t = [w if r.random() > 0.04 else r.choice(names) for w in r.choice(texts)]
        elif kind == 4:
            t = [*r.choices(names, k=20), *shared.split(), *r.choices(names, k=10)]
        else:
            t = r.choices(names[:20], k=r.randrange(1, 12))
        texts.append(t)
    out = [" ".join(t) for t in texts]
    out += [None, "", " \t\n ", "one", "one two three", "Ünïcode ÄÖ straße " * 9, " ".join(r.choices(names, k=6000)), "a " * 500, "x" * 700]
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, "c"][i % 4], len(t) if t else None, 0.5, "clash", "clash") for i, t in enumerate(out)]
    return rows + [rows[0], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)

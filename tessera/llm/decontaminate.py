"""Benchmark decontamination, in DataFrame functions only.

For each benchmark item, windows of the item's size are laid over the
documents.  Windows without any shingle of a benchmark have similarity 0 with all items, so
they are never laid: a screen over all shingles, which
lets every benchmark shingle through, and the least number of shared shingles
that the similarity needs, pick the documents, and
wherever a document has one of the item's shingles, one window
starts so that the shingle stands where it does in the item, and one starts with
the shingle (or ends with the document).  A window whose first shingle is not
shared holds no more than the next window, so these starts reach the best
similarity of all windows; of the latter kind, those with fewer shared places than the
similarity needs are skipped.

Windows and items are paired by fingerprint.  The 128-bit SimHash
(every shingle counted as often as it occurs), two longs f and g, is cut into BLOCKS blocks of BITS bits;
fingerprints within RADIUS bits agree in one block but for FLIPS bits at most, so joining on
(size, block, value) the windows' values with all values that near to the items' finds them all.
Candidates are verified by exact
weighted-shingle similarity: the sum of least counts over the sum of greatest counts.

At similarity 0.75 a SimHash bit differs with probability 0.172, so the
distance is 22.0 bits, give or take 4.3; RADIUS is 4 deviations above.  Of fingerprints that
have nothing to do with each other 27 in 100 meet in a block, and fewer than ten in a million lie within the radius.

Edge cases: null and empty texts or items match nothing; an item of fewer
words than a shingle is one shingle of its own length; a document shorter
than the item is one window; rows that share a doc_id, or have none, are scanned each by itself and
give one row together, the best of any, and so are items that share an item_id; only rows
that hold an item are dropped, others of their doc_id stay;
other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import row_key, stored, unused
from .native import bit_table, rows_with_hits, shingles, words

RADIUS, BLOCKS, BITS, FLIPS = 39, 8, 16, 4
K, SIMILARITY = 5, 0.75


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes; each element votes once."""
    vote = lambda b: F.aggregate(hashes, F.lit(0), lambda a, h: a + 2 * F.getbit(h, b).cast("int") - 1)
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda f, b: f.bitwiseOR(F.call_function("shiftleft", (vote(b) > 0).cast("long"), b)))


def with_simhash(rows: DataFrame, column: str) -> DataFrame:
    """rows with f and g, the two halves of the SimHash of ``column``; the second is made from hashes of the hashes."""
    again = F.array(F.transform(column, lambda h: F.xxhash64(h)))  # worked out once for all bits
    return rows.withColumn("f", simhash(F.col(column))).withColumn("g", F.get(F.transform(again, simhash), 0))


def _value(block: int) -> Column:
    half, place = divmod(block * BITS, 64)
    return F.shiftrightunsigned(F.col("fg"[half]), place).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def blocks() -> Column:
    """(block, value) of every block of the fingerprint f, g."""
    return F.array(*(F.struct(F.lit(i).alias("block"), _value(i).alias("value")) for i in range(BLOCKS)))


def near_blocks() -> Column:
    """(block, value) of every block of all fingerprints that differ in FLIPS bits of f, g at most."""
    flips = F.lit([sum(1 << x for x in bits) for size in range(FLIPS + 1) for bits in combinations(range(BITS), size)])
    return F.flatten(F.transform(blocks(), lambda own: F.transform(flips, lambda x: F.struct(own["block"].alias("block"), own["value"].bitwiseXOR(x).alias("value")))))


def distance(a: str, b: str) -> Column:
    """Bits in which the fingerprints of two sides differ."""
    return sum(F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in "fg")


def verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """pairs (rid, iid, start, m, own, here) with their exact similarity, where it is at least ``similarity``."""
    sides = F.concat(F.transform("own", lambda h: F.struct(h.alias("h"), F.lit(1).alias("a"), F.lit(0).alias("b"))), F.transform("here", lambda h: F.struct(h.alias("h"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    ids = ["rid", "iid", "start", "m"]
    counts = pairs.select(*ids, F.explode(sides).alias("x")).groupBy(*ids, "x.h").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    share = F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))
    return counts.groupBy(*ids).agg(share.alias("similarity")).filter(F.col("similarity") >= similarity)


def begun(spots: Column, n: Column, span: Column, similarity: float) -> Column:
    """Starts, of windows of ``span`` among n shingles, at one of the sorted spots or at the last place, that have as many spots as the similarity needs."""
    need = F.ceil((span + F.least(span, n)) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")
    last = F.greatest(F.lit(0), n - span)
    full = F.filter(spots, lambda p, i: (p <= last) & (F.get(spots, i + need - 1) < p + span))
    return F.concat(full, F.when(F.get(spots, F.size(spots) - need) >= last, F.array(last)).otherwise(F.array().cast("array<int>")))


def _found(docs: DataFrame, benchmark: DataFrame, similarity: float, k: int) -> DataFrame | None:
    """doc_id, key, item_id, similarity, start, m of the windows that reach ``similarity``; None without an item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = stored(items.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(k)).alias("kk"), "w", F.monotonically_increasing_id().alias("iid")))
    found = None
    for kk in sorted(r[0] for r in items.select("kk").distinct().collect()):  # at most k values
        own = items.filter(F.col("kk") == kk).select("item_id", "iid", "m", shingles(F.col("w"), kk).alias("own"))
        own = stored(with_simhash(own, "own"))
        at = own.select("m", F.posexplode("own").alias("item_pos", "h")).distinct()
        least = own.agg(F.min(F.ceil(F.size("own") * F.lit(similarity)))).first()[0]
        table, bits = bit_table(at, "h")
        flagged = stored(rows_with_hits(docs, kk, table, bits, least))
        hits = flagged.select("rid", F.size("sh").alias("n"), F.explode("hits").alias("p")).select("rid", "n", "p.pos", "p.h")
        span = F.col("m") - kk + 1
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("item_pos"), F.col("n") - span))
        laid = hits.join(at, "h").groupBy("rid", "m", "n").agg(F.collect_set(start).alias("aligned"), F.array_sort(F.collect_set("pos")).alias("spots"))
        windows = laid.select("rid", "m", F.explode(F.array_union("aligned", begun(F.col("spots"), F.col("n"), span, similarity))).alias("start"))
        windows = windows.groupBy("rid").agg(F.collect_list(F.struct("m", "start")).alias("at"))
        windows = flagged.select("rid", "sh").join(windows, "rid").select("rid", "sh", F.explode("at").alias("x"))
        windows = windows.select("rid", "x.m", "x.start", F.slice("sh", F.col("x.start") + 1, F.col("x.m") - kk + 1).alias("here"))
        windows = stored(with_simhash(windows, "here"))
        a = windows.select("rid", "m", "start", "f", "g", F.explode(blocks()).alias("x")).select("rid", "m", "start", "f", "g", "x.*").alias("a")
        b = own.select("iid", "m", "f", "g", F.explode(near_blocks()).alias("x")).select("iid", "m", "f", "g", "x.*").alias("b")
        # merged at every size: an item has some 20,000 near values, which are never broadcast
        same = (F.col("a.m") == F.col("b.m")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value"))
        near = a.join(b.hint("merge"), same & (distance("a", "b") <= RADIUS)).select("rid", "iid", "start", "a.m").distinct()
        pairs = windows.select("rid", "m", "start", "here").join(near, ["rid", "m", "start"]).join(own.select("iid", "own"), "iid")
        pairs = verified(pairs, similarity).join(own.select("iid", "item_id"), "iid").join(flagged.select("rid", "doc_id", "key"), "rid").select("doc_id", "key", "item_id", "similarity", "start", "m")
        found = pairs if found is None else found.unionByName(pairs)
    return found


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each document and item that reach ``similarity``."""
    found = _found(docs, benchmark, similarity, k)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word int, n_words int")
    best = F.min_by(F.struct("similarity", F.col("start").alias("start_word"), F.col("m").alias("n_words")), F.struct((-F.col("similarity")).alias("s"), "start", "m"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """docs without the rows in which an item is found."""
    found = _found(docs, benchmark, similarity, k)
    if found is None:
        return docs
    key = unused("_bad", docs.columns)
    bad = stored(found.select(F.col("key").alias(key)).distinct())
    return docs.join(bad, row_key() == F.col(key), "left_anti")

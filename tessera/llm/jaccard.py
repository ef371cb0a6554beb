"""N-gram Jaccard join.

Documents link when the Jaccard similarity of their sets of distinct k-word
shingles is at least ``percent`` hundredths.  Equal sets collapse to one set, known
by a 64-bit hash of its members, so copies cost nothing further.

1. Every set puts its rarest shingles, as many as a linked partner can't all
   lack, into inverted lists.  Rarity comes from a table of FREQUENCY_SIZE counters over
   all shingles of all documents; it only orders, so its fixed size costs no
   result.  Lists of one set are dropped and lists of equal members collapse.
2. In a list, pairs whose 64-value MinHash sketches agree in fewer than SKETCH_LEAST
   places are no partners (a linked pair falls below with probability under 1e-11); what remains
   connected forms candidate groups.  A list of more than LIST_MOST sets is first divided
   by bands of two sketch values (a linked pair shares none of the 32 with probability 3e-12).
3. Inside a group each set looks for its partners by T-occurrence search over
   inverted lists of shingles: short lists are merged by a heap, long ones are
   probed by bisection for what can still reach T (DivideSkip).  The lists name
   the sets found connected so far as one, so a family of near copies takes one place in
   each; what reaches T is then compared set by set.
4. A group of more than GROUP_MOST sets is dealt into blocks.  The sets that most
   resemble the whole group visit every block, which connects most of it; then what is
   not yet connected with the group's largest component meets all blocks.  Where groups, blocks
   and packs are counted, a set of a long text counts once for every SET_BYTES, so what one task holds is bounded
   in bytes too (but for single texts, and the HUBS sets that visit a block).

Edge cases: null and empty texts have no shingle and link with nothing; a
text of fewer than k words is one shingle; repeated rows of a doc_id with
the same text are one document; rows of a doc_id with different texts each get a
row; a null doc_id never is a component's name unless all are null; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import row_key, stored, summed, unused
from .components import Contraction, components
from .native import bit_table
from .textkit import U, Words, breaks, column_bytes, is_long, mix, per_row_distinct, pieces, words_ahead

FREQUENCY_BITS = 21
#: Counters in one row: 64 KB, as rows of half a megabyte each fill whole regions of the heap.
SLICE = 1 << 13
SKETCH, SKETCH_LEAST = 64, 20
LIST_MOST, GROUP_MOST, HUBS = 2048, 1024, 16
#: Members of a component that are compared one by one before all are at once.
SINGLY = 12
PERCENT, K = 75, 5
#: Bytes of text whose postings are sorted and sent at once.
POST_BYTES = 4 << 20
#: Bytes of text whose lists one task makes, sets whose links one task looks for, and bytes of text for each of which a set counts as one more there.
BUCKET_BYTES, PACK_SETS, SET_BYTES = 8 << 20, 1500, 32 << 10


def long_shingles(b: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of k words of one long text, from stretches that read on for k - 1 words."""
    cuts, parts = breaks(b), []
    for a, z in zip(cuts, cuts[1:]):
        part = b[a:words_ahead(b, z, k - 1)]
        parts.append(np.unique(Words(part, np.array([0, len(part)])).shingles(k, short_rows=False)[1]))
    return np.unique(np.concatenate(parts))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row and hash of the distinct shingles, by row then hash; size and hash of each row's set (0: empty)."""
    if is_long(offsets) and len(h := long_shingles(buf, k)):
        row = np.zeros(len(h), np.int64)
    else:
        row, h, _ = Words(buf, offsets).shingles(k)
        row, h = per_row_distinct(row, h)
    n = np.bincount(row, minlength=len(offsets) - 1)
    sig = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        sig[full] = mix(np.add.reduceat(mix(h + U(77)), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
    return row, h, n, sig.view(np.int64)


def sketches(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SKETCH bytes a row: the low byte of the least value under each of as many hashes."""
    out = np.zeros((len(n), SKETCH), np.uint8)
    full = np.flatnonzero(n)
    if len(full):
        heads = (np.cumsum(n) - n)[full]
        h = h ^ (h >> U(32))
        for j in range(SKETCH):
            least = np.minimum.reduceat((h * U(2 * j * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03 & (2**64 - 1) | 1)) ^ U(j * 0xA24BAED4963EE407 & (2**64 - 1)), heads)
            out[full, j] = (least ^ (least >> U(32)) ^ (least >> U(16)) ^ (least >> U(8))).astype(np.uint8)
    return out


def divide_skip(lists: list[list[int]], t: int) -> dict[int, int]:
    """Members of at least t of the sorted lists, with how many hold them (Li, Lu and Lu 2008)."""
    lists = sorted(lists, key=len)
    if len(lists) < t:
        return {}
    longest = len(lists[-1])
    long = min(t - 1, int(t / (0.01 * np.log2(max(2, longest)) + 1)))
    short, long_lists, need = lists[:len(lists) - long], lists[len(lists) - long:], t - long
    heap = [(x[0], i, 0) for i, x in enumerate(short)]
    heapq.heapify(heap)
    found = {}
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        seen = len(popped)
        if seen >= need:
            total = seen
            for left, x in zip(range(long - 1, -1, -1), long_lists):
                p = bisect_left(x, top)
                total += p < len(x) and x[p] == top
                if total + left < t:
                    break
            if total >= t:
                found[top] = total
            after = top + 1
        else:
            # no member below the need-th smallest front can be in enough lists
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            after = heap[0][0]
        for _, i, at in popped:
            at = bisect_left(short[i], after, at)
            if at < len(short[i]):
                heapq.heappush(heap, (short[i][at], i, at))
    return found


def group_links(row: np.ndarray, token: np.ndarray, n: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among the sets of one group.

    row, token: their postings; n: set sizes; known: a number for each set, equal where sets are connected already.
    """
    order = np.argsort(n, kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    size = n[order].tolist()
    _, token, count = np.unique(token, return_inverse=True, return_counts=True)
    keep = count[token] > 1
    at, token = place[row[keep]], token[keep]
    by = np.lexsort((token, at))
    at, token = at[by], token[by]
    cut = np.searchsorted(at, np.arange(len(n) + 1))
    postings: list[np.ndarray] = []

    def overlaps(q: int, own: list[int]) -> np.ndarray:
        """How many shingles of q every set before it holds."""
        if not postings:
            postings.extend([at[np.argsort(token, kind="stable")], np.append(0, np.cumsum(np.bincount(token, minlength=len(count))))])
        member, start = postings
        return np.bincount(np.concatenate([member[start[x]:start[x + 1]] for x in own]), minlength=len(n))[:q]

    label = np.unique(known[order], return_inverse=True)[1].tolist() if known is not None else list(range(len(n)))
    lists: dict[int, list[int]] = {}  # of each shingle, the components that hold it
    members: dict[int, list[int]] = {}
    held: dict[int, set[int]] = {}
    sets: list[set[int]] = []
    joined: dict[int, int] = {}

    def named(c: int) -> int:
        while c in joined:
            c = joined[c]
        return c

    def partner(q: int, c: int, t: int, counts: list) -> int:
        """A member of component c that is linked with q, or -1."""
        for turn, y in enumerate(members[c]):
            if turn == SINGLY:
                break
            both = len(sets[q] & sets[y]) if size[y] >= t else 0
            if 100 * both >= percent * (size[q] + size[y] - both):
                if turn:  # who has partners is asked first
                    members[c].insert(0, members[c].pop(turn))
                return y
        else:
            return -1
        if not counts:
            counts.append(overlaps(q, list(sets[q])))
        rest = np.array(members[c][SINGLY:])
        both = counts[0][rest]
        good = np.flatnonzero(100 * both >= percent * (size[q] + n[order[rest]] - both))
        if len(good):
            members[c].insert(0, members[c].pop(SINGLY + int(good[0])))
            return members[c][0]
        return -1

    links = []
    for q in range(len(n)):
        own = token[cut[q]:cut[q + 1]].tolist()
        sets.append(set(own))
        mine, t, counts = named(label[q]), -(-percent * size[q] // 100), []
        for c in sorted(divide_skip([lists[x] for x in own if x in lists], t)) if len(own) >= t else ():
            c = named(c)
            if c == mine or (y := partner(q, c, t, counts)) < 0:
                continue
            links.append((int(order[q]), int(order[y])))
            small, large = sorted((mine, c), key=lambda x: len(held.get(x, ())))
            joined[small] = mine = large
            for x in held.pop(small, ()):
                at_ = lists[x]
                del at_[bisect_left(at_, small)]
                if x not in held[large]:
                    insort(at_, large)
                    held[large].add(x)
            members.setdefault(large, []).extend(members.pop(small, []))
        members.setdefault(mine, []).append(q)
        shown = held.setdefault(mine, set())
        for x in own:
            if x not in shown:
                shown.add(x)
                insort(lists.setdefault(x, []), mine)
    return links


def _connected(sig: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect the members of a list whose sketches agree in SKETCH_LEAST places or more."""
    links, left = [], np.arange(len(sig))
    while len(left) > 1:  # flood from the first member left
        group, front = [left[0]], [left[0]]
        left = left[1:]
        while front and len(left):
            near = (sketch[left] == sketch[front.pop()]).sum(1) >= SKETCH_LEAST
            front += list(left[near])
            group += list(left[near])
            left = left[~near]
        links += [(int(sig[group[0]]), int(sig[x])) for x in group[1:]]
    return links


def bands(sketch: Column) -> Column:
    """(band, value) of every two neighbouring sketch values."""
    return F.transform(F.sequence(F.lit(0), F.lit(SKETCH // 2 - 1)), lambda i: F.struct(i.alias("band"), F.substring(sketch, 2 * i + 1, F.lit(2)).alias("value")))


def central(large: DataFrame) -> DataFrame:
    """root, node: of each group of large (root, node, sketch), the HUBS sets whose sketches agree most with the group's commonest values."""
    values = F.transform(F.sequence(F.lit(1), F.lit(SKETCH)), lambda i: F.struct(i.alias("place"), F.substring(F.col("sketch"), i, F.lit(1)).alias("value")))
    seen = large.select("root", F.explode(values).alias("x")).groupBy("root", "x.place", "x.value").agg(F.count(F.lit(1)).alias("n"))
    common = seen.groupBy("root", "place").agg(F.max_by("value", F.struct("n", "value")).alias("value")).groupBy("root").agg(F.collect_list(F.struct("place", "value")).alias("common"))
    agree = F.size(F.filter("common", lambda x: F.substring(F.col("sketch"), x["place"], F.lit(1)) == x["value"]))
    order = Window.partitionBy("root").orderBy(F.desc("agree"), "node")
    return large.join(common, "root").select("root", "node", agree.alias("agree")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= HUBS).select("root", "node")


def named_components(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, key (of doc_id and text), n (size of the set), class for each row of docs (doc_id, text); rows of a class are linked or have equal sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("key"))
    size = 1 << FREQUENCY_BITS
    schema = "doc_id long, key long, n long, sig long, sketch binary, bytes long, slice int, part int, counts binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int32)
        empty = pa.nulls
        for batch in batches:
            buf, off = column_bytes(batch.column("text"))
            for i, b, o in pieces(buf, off):
                row, h, n, sig = shingle_sets(b, o, k)
                np.add.at(counts, (h >> U(64 - FREQUENCY_BITS)).astype(np.int64), 1)
                m = len(n)
                mh = sketches(row, h, n)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(i, m), "key": batch.column("key").slice(i, m), "n": pa.array(n, pa.int64()), "sig": pa.array(sig), "sketch": pa.array([x.tobytes() for x in mh], pa.binary()), "bytes": pa.array(np.diff(o)), "slice": empty(m, pa.int32()), "part": empty(m, pa.int32()), "counts": empty(m, pa.binary())})
        parts = [(s, counts[s * SLICE:(s + 1) * SLICE]) for s in range(size // SLICE)]
        parts = [(s, c) for s, c in parts if c.any()]
        m = len(parts)
        none = {name: empty(m, kind) for name, kind in (("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sketch", pa.binary()), ("bytes", pa.int64()))}
        yield pa.record_batch(none | {"slice": pa.array([s for s, _ in parts], pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * m, pa.int32()), "counts": pa.array([c.astype(np.int64).tobytes() for _, c in parts], pa.binary())})

    described = stored(docs.mapInArrow(describe, schema))
    members = described.filter("slice is null").select("doc_id", "key", "n", "sig", "sketch", "bytes")
    buckets = 12 + (members.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES

    frequency = np.zeros(size, np.int32)
    for s, _, c in summed(described.filter("slice is not null").select("slice", "part", "counts")).collect():
        frequency[s * SLICE:(s + 1) * SLICE] = np.minimum(np.frombuffer(c, np.int64), 2**31 - 1)
    rare = spark.sparkContext.broadcast(frequency)  # a fixed 8 MB
    del frequency

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some, cuts in pieces(*column_bytes(batch.column("text")), POST_BYTES):
                tokens, sigs = [], []
                for _, b, o in pieces(some, cuts):
                    row, h, n, sig = shingle_sets(b, o, k)
                    f = rare.value[(h >> U(64 - FREQUENCY_BITS)).astype(np.int64)]
                    order = np.lexsort((h, f, row))
                    row, h = row[order], h[order]
                    rank = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                    first = rank < (n - -(-percent * n // 100) + 1)[row]
                    tokens.append(h[first])
                    sigs.append(sig[row[first]])
                token, sig = (np.concatenate(tokens), np.concatenate(sigs)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                bucket = (token % U(buckets)).astype(np.int64)
                order = np.lexsort((sig, token, bucket))
                token, sig, bucket = token[order], sig[order], bucket[order]
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
                token, sig, bucket = token[new], sig[new], bucket[new]
                ids, cut = np.unique(bucket, return_index=True)
                cut = [*cut, len(token)]
                yield pa.record_batch({"bucket": pa.array(ids, pa.int64()), "token": pa.array([token[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary()), "sig": pa.array([sig[a:z].tobytes() for a, z in zip(cut, cut[1:])], pa.binary())})

    def gather(key, t):
        token = np.concatenate([np.frombuffer(x, np.uint64) for x in t["token"].to_pylist()])
        sig = np.concatenate([np.frombuffer(x, np.int64) for x in t["sig"].to_pylist()])
        order = np.lexsort((sig, token))
        token, sig = token[order], sig[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
        token, sig = token[new], sig[new]
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(head, len(token)))
        name = np.add.reduceat(mix(sig.view(np.uint64)), head)
        _, pick = np.unique(np.where(length > 1, name, 0), return_index=True)
        pick = pick[length[pick] > 1]
        return pa.table({"list": pa.array(name[pick].view(np.int64)), "sigs": pa.array([sig[head[i]:head[i] + length[i]] for i in pick], pa.list_(pa.int64()))})

    posted = docs.select("text").mapInArrow(post, "bucket long, token binary, sig binary")
    lists = stored(posted.groupBy("bucket").applyInArrow(gather, "list long, sigs array<long>").dropDuplicates(["list"]))
    rare.unpersist()
    sets = stored(members.filter("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch"), F.min_by("bytes", "key").alias("bytes")))
    sketched = sets.select("sig", "sketch")
    rows = lists.filter(F.size("sigs") <= LIST_MOST).select("list", F.explode("sigs").alias("sig")).join(sketched, "sig")
    whole = None
    if not (long := lists.filter(F.size("sigs") > LIST_MOST)).isEmpty():
        parts = long.select("list", F.explode("sigs").alias("sig")).join(sketched, "sig").select("list", "sig", F.explode(bands(F.col("sketch"))).alias("x"))
        parts = stored(parts.select(F.xxhash64("list", "x.band", "x.value").alias("list"), "sig"))
        held = parts.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("sig").alias("least")).filter("n > 1")
        parts = parts.join(held, "list")
        rows = rows.unionByName(parts.filter(F.col("n") <= LIST_MOST).select("list", "sig").join(sketched, "sig"))
        whole = parts.filter(F.col("n") > LIST_MOST).select(F.col("least").alias("a"), F.col("sig").alias("b"))
    rows = rows.groupBy("list").agg(F.collect_list(F.struct("sig", "sketch")).alias("m")).select("m.sig", "m.sketch")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contraction()
        for batch in batches:
            for sig, sketch in zip(batch.column("sig"), batch.column("sketch")):
                links = np.array(_connected(sig.values.to_numpy(), np.frombuffer(b"".join(sketch.as_py()), np.uint8).reshape(-1, SKETCH)), np.int64).reshape(-1, 2)
                found.add(links[:, 0], links[:, 1])
        a, b = found.links()
        yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    near = rows.mapInArrow(screen, "a long, b long")
    groups = components(near if whole is None else near.unionByName(whole))
    weight = F.greatest(F.lit(1), F.ceil(F.col("bytes") / SET_BYTES)).alias("weight")
    weighed = groups.join(sets.withColumnRenamed("sig", "node"), "node").select("node", "root", "key", "sketch", weight)
    live = stored(weighed.join(weighed.groupBy("root").agg(F.sum("weight").alias("held")), "root"))
    sums = live.agg(F.count(F.lit(1)), F.max("held"), F.sum("weight")).first()
    table, bits = bit_table(live.select("key"), "key", sums[0])
    mine = F.pmod(F.col("key"), F.lit(bits))
    wanted = F.getbit(F.get(table, F.floor(mine / 64).cast("int")), F.pmod(F.col("key"), F.lit(64)).cast("int")) == 1
    packs = 1 + (sums[2] or 0) // PACK_SETS

    def search(key, t):
        t = t.sort_by("root").combine_chunks()
        row, h, n, sig = [], [], [], []
        buf, off = column_bytes(t["text"])
        for i, b, o in pieces(buf, off):
            r, x, m, s = shingle_sets(b, o, k)
            row.append(r + i)
            h.append(x)
            n.append(m)
            sig.append(s)
        row, h, n, sig = map(np.concatenate, (row, h, n, sig))
        node, root, known = t["node"].to_numpy(), t["root"].to_numpy(), t["known"].to_numpy()
        heads = np.cumsum(n) - n
        links = []
        bounds = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
        for a, z in zip(bounds, bounds[1:]):
            _, mine = np.unique(node[a:z], return_index=True)
            mine = np.sort(mine) + a
            mine = mine[sig[mine] == node[mine]]
            if len(mine) > 1:
                at = np.concatenate([np.arange(heads[r], heads[r] + n[r]) for r in mine])
                links += [(int(node[mine[x]]), int(node[mine[y]])) for x, y in group_links(np.repeat(np.arange(len(mine)), n[mine]), h[at], n[mine], percent, known[mine])]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def links_of(placed: DataFrame) -> DataFrame:
        """Links among the sets that share a pack.  placed: node, root, key, known, pack."""
        texts = docs.filter(wanted & F.col("text").isNotNull()).select("key", "text").dropDuplicates(["key"])
        return texts.join(placed.hint("merge"), "key").select("node", "root", "known", "pack", "text").groupBy("pack").applyInArrow(search, "a long, b long")

    def pack(p: Column, i: Column, j: Column) -> Column:
        return F.struct(p.cast("long").alias("p"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    none = F.lit(-1)
    placed = live.filter(F.col("held") <= GROUP_MOST).select("node", "root", "key", F.col("node").alias("known"), pack(F.pmod(F.xxhash64("root"), F.lit(packs)), none, none).alias("pack"))
    if sums[1] is None or sums[1] <= GROUP_MOST:
        linked = components(links_of(placed))
    else:
        blocks = F.ceil(F.col("held") / GROUP_MOST).cast("int")
        large = live.filter(F.col("held") > GROUP_MOST).withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node"), blocks).cast("int")})
        hubs = large.join(central(large), ["root", "node"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = large.unionByName(hubs).select("node", "root", "key", F.col("node").alias("known"), pack(F.col("root"), F.col("block"), none).alias("pack"))
        first = components(links_of(placed.unionByName(spread)))
        # sets outside their group's largest component, dealt into parts, meet all blocks of the group
        now = stored(large.drop("sketch").join(first.withColumnsRenamed({"root": "_part"}), "node", "left").withColumn("known", F.coalesce("_part", "node")).drop("_part"))
        per = now.groupBy("root", "known").agg(F.sum("weight").alias("n")).groupBy("root").agg(F.max_by("known", F.struct("n", "known")).alias("main"), (F.sum("n") - F.max("n")).alias("loose"))
        now = now.join(per.filter("loose > 0"), "root").withColumn("parts", F.ceil(F.col("loose") / GROUP_MOST).cast("int"))
        here = now.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        loose = now.filter("known <> main").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        again = here.unionByName(loose).select("node", "root", "key", "known", pack(F.col("root"), F.col("block"), F.col("part")).alias("pack"))
        linked = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links_of(again)))
    linked = linked.withColumnRenamed("node", "sig")
    return members.select("doc_id", "key", "n", "sig").join(linked, "sig", "left").select("doc_id", "key", "n", F.coalesce("root", "sig").alias("class"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    named = stored(named_components(docs, percent, k))
    least = named.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    out = named.join(least, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """docs with one document of each component, the one of the smallest id; documents without a shingle all stay.  Rows that repeat doc_id and text are one document: one of them stays."""
    named = named_components(docs, percent, k)
    own = F.when(F.col("n") > 0, F.struct(F.lit(0).alias("kind"), F.col("class").alias("c"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("key").alias("c")))
    first = F.min_by("key", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    key = unused("_key", docs.columns)
    stay = stored(named.groupBy(own.alias("own")).agg(first.alias(key)).select(key))
    keyed = docs.withColumn(key, row_key()).dropDuplicates([key])
    return keyed.join(stay, key, "left_semi").select(*docs.columns)

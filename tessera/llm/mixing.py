"""Mixing sources to target weights, in DataFrame functions only.

Each source's words, in an order fixed by the ids, are packed into blocks of
``block`` words.  Every output shard of ``shard_slots`` slots draws how many
slots each source gets (a multinomial draw, slot by slot, by hash); draws
beyond a source's quota over all shards are passed to sources below theirs,
so each source ends at its quota.  A source's slots are numbered; slot
number j reads block permutation(j mod n) of pass j div n, where the
permutation of 0..n-1 is a keyed swap-or-not shuffle, and blocks are joined
by (source, index).

Targets: the sources in code-point order, null last, weigh 3, 1, 2,
repeating, and share ``share`` times all words; a target stops at ``cap``
times its source's words and the excess is shared again by weight.

Edge cases: a null text has size 0; a null source is a source of its own,
last; rows that share doc_id and source count as one document whose size is
their sum; documents of size 0 are taken 0 times; an empty table gives an
empty mixture; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

BLOCK, SHARD_SLOTS, ROUNDS = 32, 1 << 16, 12
#: Documents whose running sums one task makes.
CHUNK_ROWS = 50_000
#: Slots that one task numbers and permutes, about.
TASK_SLOTS = 200_000
#: Cells of the table that maps a draw to its source.
CELLS = 1 << 12


@dataclass
class Mixture:
    """sizes: doc_id, source, size.  sources: source, sid, source_size, target, blocks, quota.  rows: what each slot reads."""

    sizes: DataFrame
    sources: DataFrame
    rows: DataFrame


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, sid, source_size, target: one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(order) - 1)
    total = total.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double")).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    before = Window.orderBy(F.col("top") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # with the sources of least top/w full, the level rises as long as the next one fills as well, then falls
    out = total.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return out.select("source", "sid", "source_size", F.least("top", F.col("w") * F.col("level")).alias("target"))


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A keyed bijection of 0..n-1: in each round x and (k - x) mod n change places or not, by a bit of a hash of the larger."""
    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(F.greatest(x, other), key, r).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), turn)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> Mixture:
    """docs: doc_id, text, source.  Mixture.rows: shard, sid, block, doc_id, source, first_word, words; a row for each document a slot reads."""
    spark = docs.sparkSession
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size")))
    sources = source_targets(sizes, weights, share, cap)
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    sources = stored(sources.withColumn("blocks", blocks).withColumn("quota", F.when(F.col("source_size") == 0, 0).otherwise(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))))
    count = sizes.count()
    slots = sources.agg(F.sum("quota")).first()[0] or 0

    # word positions: each source is cut into chunks by hash, so no task holds a whole source
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(1 + count // CHUNK_ROWS)).alias("chunk")
    parts = sizes.filter("size > 0").select("doc_id", "source", "size", chunk)
    by_source = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("source", "chunk").agg(F.sum("size").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(by_source), F.lit(0))).drop("n")
    offsets = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "sid", "chunk", "offset")
    in_chunk = Window.partitionBy("source", "chunk").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("within", F.coalesce(F.sum("size").over(in_chunk), F.lit(0))).alias("p").join(offsets.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.chunk") == F.col("o.chunk")))
    placed = placed.select("p.doc_id", "p.source", "sid", (F.col("offset") + F.col("within")).alias("a"), (F.col("offset") + F.col("within") + F.col("size")).alias("b"))
    b = F.lit(block)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / b), F.floor((F.col("b") - 1) / b))))
    lo, hi = F.greatest("a", F.col("block") * b), F.least("b", (F.col("block") + 1) * b)
    pieces = pieces.select("sid", "block", "doc_id", "source", (lo - F.col("a")).alias("first_word"), (hi - lo).alias("words"))

    # draws: a slot's hash falls in the interval of one source; cells make that an equi-join
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    cell = max(1, -(-slots // CELLS))
    spans = sources.filter("quota > 0").select("sid", "quota", F.coalesce(F.sum("quota").over(upto), F.lit(0)).alias("lo")).withColumn("hi", F.col("lo") + F.col("quota"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(max(1, slots)))
    drawn = spark.range(slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), draw.alias("u")).withColumn("cell", F.floor(F.col("u") / cell))
    drawn = drawn.join(spans, (drawn["cell"] == spans["cell"]) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n"))
    by_shard = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = stored(drawn.withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0))))

    # what is drawn beyond a quota goes to the sources below theirs
    per_source = sources.filter("quota > 0").join(drawn.groupBy("sid").agg(F.sum("n").alias("n")), "sid", "left").select("sid", "quota", F.coalesce("n", F.lit(0)).alias("n"))
    per_source = per_source.withColumn("over", F.greatest(F.lit(0), F.col("n") - F.col("quota"))).withColumn("under", F.greatest(F.lit(0), F.col("quota") - F.col("n")))
    per_source = per_source.withColumn("over_at", F.coalesce(F.sum("over").over(upto), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(upto), F.lit(0)))
    spread = drawn.join(per_source.select("sid", "quota", "over_at"), "sid").repartition(1 + slots // TASK_SLOTS, "shard", "sid")
    numbered = spread.withColumn("j", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
    kept = numbered.filter("j < quota").select("shard", "sid", "j")
    spare = numbered.filter("j >= quota").select("shard", (F.col("over_at") + F.col("j") - F.col("quota")).alias("e"))
    need = per_source.filter("under > 0").withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1))).select("sid", (F.col("under_at") + F.col("d")).alias("e"), (F.col("n") + F.col("d")).alias("j"))
    slots_of = kept.unionByName(spare.join(need, "e").select("shard", "sid", "j"))

    at = slots_of.join(sources.select("sid", "blocks"), "sid")
    key = F.xxhash64(F.col("sid"), F.floor(F.col("j") / F.col("blocks")), F.lit(seed + 1))
    at = at.select("shard", "sid", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), key).alias("block"))
    rows = at.join(pieces, ["sid", "block"])
    return Mixture(sizes, sources, rows.select("shard", "sid", "block", "doc_id", "source", "first_word", "words"))


def mixture_digest(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row a document."""
    taken = mixture.rows.groupBy("doc_id", "source").agg(F.sum("words").alias("taken"))
    m, t, s = mixture.sizes.alias("m"), taken.alias("t"), mixture.sources.alias("s")
    out = m.join(t, F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("m.source").eqNullSafe(F.col("t.source")), "left")
    out = out.join(s, F.col("m.source").eqNullSafe(F.col("s.source")))
    return out.select("m.doc_id", "m.size", "s.source_size", "s.target", F.coalesce("taken", F.lit(0)).alias("taken"), "m.source")

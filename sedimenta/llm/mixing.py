"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: every source gets its share of the mix by weight; none exceeds a
   multiple of its size, and the excess is shared again by weight. That is one
   level L with target = min(multiple * size, L * weight); sorted by
   size / weight, running sums give L.
2. Each source's documents are shuffled by a hash and laid end to end; the
   stream, read up to ``multiple`` times over, is cut into blocks of equal words.
3. Slot k of the schedule draws the golden-ratio point frac(k / phi) through the
   cumulative shares of the sources, which names a source; the slots of a source
   are ranked, and rank r takes its block r. A source's share is by the blocks
   that its target fills; a slot beyond these is void. The schedule runs on, by
   doublings, until every source has its slots, which takes about twice as many
   as there are blocks; at LONGEST times as many it ends, and what no slot drew
   isn't taken.
4. Blocks are joined with the pieces of documents that lie in them: a document is
   taken by the slots of its pieces, the first of which is its place in the mix.

A document's place in its stream is a running sum in three parts (documents in
a bucket of the hash, buckets before it, passes before it), so that no window
holds a whole source.

A very long text is a number of words here, and as many pieces as blocks.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are taken 0 times; a table without words has
targets 0; repeated rows are documents of their own (ties by doc_id, then size);
further columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS, SHARE, MULTIPLE = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words of a block.
BLOCK = 1024
#: 1 / golden ratio as a 53-bit fraction: k * PHI mod 2^53 needs no floating point.
PHI, ONE = 5566755282872655, 1 << 53
#: Documents of a source in a bucket of its shuffled order, about, and slots in a stretch of the schedule.
BUCKET, STRETCH = 20_000, 2048
#: Slots of the schedule at most, as a multiple of the blocks.
LONGEST = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, multiple: float = MULTIPLE) -> DataFrame:
    """One row a source (source, docs, source_size) -> with place, weight, target. One row a source only: a single window is fit for that."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(order).cast("long")).withColumn("weight", w)
    s = s.withColumn("most", F.col("source_size") * F.lit(multiple))
    everything = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), "place")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
    full = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The level if all sources before this one in order are full; it holds for the first that stays below its most.
    s = s.withColumn("level", (F.col("total") - full) / rest)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(whole)
    s = s.withColumn("level", first["level"])
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return s.withColumn("target", target).drop("most", "total", "level")


def shuffled(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sources, and docs(doc_id, source, size) with source_size, docs of the source, and at: the words before each document in its source's shuffled order."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    sizes = materialize(source_targets(sizes), "mix-sources").withColumn("buckets", (F.col("docs") / BUCKET).cast("long") + 64)
    # A row a source; beyond Spark's own broadcast bound the join is a shuffle, whose hot keys AQE splits.
    d = docs.join(sizes, docs["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
    d = d.withColumn("key", key).withColumn("bucket", F.pmod("key", "buckets"))
    b = d.groupBy("place", "bucket").agg(F.sum("size").alias("words"))
    b = b.withColumn("bucket_at", F.sum("words").over(Window.partitionBy("place").orderBy("bucket")) - F.col("words")).drop("words")
    inside = Window.partitionBy("place", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("at", F.sum("size").over(inside) - F.col("size"))
    placed = d.join(b, ["place", "bucket"]).withColumn("at", F.col("at") + F.col("bucket_at"))
    return materialize(placed.select("doc_id", "source", "size", "place", "source_size", "target", "at"), "mix-placed"), sizes


def shares(sizes: DataFrame, block: int) -> tuple[DataFrame, int]:
    """place, take, need (blocks), low and high (the unit interval by need) of the sources that take anything, and the number of blocks. One row a source."""
    s = sizes.select("place", F.round("target").cast("long").alias("take")).where("take > 0").withColumn("need", F.ceil(F.col("take") / block))
    w = Window.orderBy("place")
    s = s.withColumn("end", F.sum("need").over(w)).withColumn("total", F.sum("need").over(Window.partitionBy()))
    s = s.withColumn("low", (F.col("end") - F.col("need")) / F.col("total")).withColumn("high", F.when(F.col("end") == F.col("total"), 1.0).otherwise(F.col("end") / F.col("total")))
    s = materialize(s, "mix-shares")
    return s, s.agg(F.coalesce(F.sum("need"), F.lit(0)).alias("n")).first()["n"]


def drawn(s: DataFrame, slots: int) -> DataFrame:
    """slot, place, need, take: the source that each of so many slots draws."""
    # k * PHI mod 2^53 in decimals, which hold the product whole.
    point = F.expr(f"cast(cast(id as decimal(20,0)) * cast({PHI} as decimal(16,0)) % cast({ONE} as decimal(16,0)) as double)") / F.lit(float(ONE))
    points = s.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("u"))
    # The map from a point to a source is a range join; both sides carry the cell of the unit interval they touch, so that it is an equi-join.
    cells = max(1024, 1 << (4 * s.count()).bit_length())
    cut = s.withColumn("cell", F.explode(F.sequence((F.col("low") * cells).cast("long"), F.least(F.lit(cells - 1), (F.col("high") * cells).cast("long")))))
    return points.withColumn("cell", (F.col("u") * cells).cast("long")).join(cut, "cell").where("u >= low and u < high").select("slot", "place", "need", "take")


def schedule(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots of the mix that take a block: slot, place (of the source), rank (from 0), block_words. The last block of a source may be shorter."""
    s, blocks = shares(sizes, block)
    slots = 2 * blocks
    while True:
        counts = drawn(s, slots).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
        if slots >= LONGEST * blocks or s.join(counts, "place", "left").where("coalesce(n, 0) < need").isEmpty():
            break
        slots *= 2
    # Rank of a slot in its source: slots of earlier stretches by a sum over stretches, then a window within one.
    hit = drawn(s, slots).withColumn("stretch", F.expr(f"slot div {STRETCH}"))
    per = hit.groupBy("place", "stretch").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("place").orderBy("stretch")) - F.col("n")).drop("n")
    ranked = hit.join(per, ["place", "stretch"]).where("before < need").withColumn("rank", F.row_number().over(Window.partitionBy("place", "stretch").orderBy("slot")) - 1 + F.col("before"))
    return ranked.where("rank < need").select("slot", "place", "rank", F.least(F.lit(block), F.col("take") - F.col("rank") * block).alias("block_words"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 10) -> DataFrame:
    """A row for each of docs(doc_id, source, size): doc_id, size, source, source_size, target, taken (words of it that the mix takes), first_slot, n_slots (of the schedule, that take any of them), passes (array of the first slots of its first, second ... passage)."""
    placed, sizes = shuffled(docs, seed)
    # Pieces: a document lies once in each pass over its source's stream, at most ceil(MULTIPLE) of them.
    passes = F.explode(F.sequence(F.lit(0), F.lit(int(MULTIPLE + 0.999) - 1)))
    p = placed.where("size > 0").select("place", "at", "size", "source_size", passes.alias("pass"))
    p = p.withColumn("from", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size"))
    p = p.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    hit = p.join(schedule(sizes, block), ["place", "rank"])
    part = F.least(F.col("to"), F.col("rank") * block + F.col("block_words")) - F.greatest(F.col("from"), F.col("rank") * block)
    hit = hit.withColumn("part", part).where("part > 0")
    of_pass = hit.groupBy("place", "at", "pass").agg(F.sum("part").cast("long").alias("words"), F.min("slot").alias("slot"), F.count(F.lit(1)).alias("slots"))
    taken = of_pass.groupBy("place", "at").agg(F.sum("words").alias("words"), F.sum("slots").alias("n_slots"), F.min("slot").alias("first_slot"), F.transform(F.array_sort(F.collect_list(F.struct("pass", "slot"))), lambda x: x["slot"]).alias("passes"))
    # Documents of size 0 share their place with the next one; they take nothing.
    out = placed.join(taken, (placed["place"] == taken["place"]) & (placed["at"] == taken["at"]) & (placed["size"] > 0), "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "passes")


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, source, size of docs, written: words of whole texts are counted once."""
    return materialize(docs.select(*columns, "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """mix() of a documents table, without the slots of passages."""
    rows = sized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), "doc_id")
    return mix(rows, block).drop("passes")

"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct shingles of five words, as 64-bit hashes.
One total order of all shingles puts frequent ones last; of a set of n the first
n - ceil(0.75 n) + 1 are its prefix, and two sets of a similarity of 0.75 share
a shingle of their prefixes.

1. Documents with equal sets are one class, classes with equal prefixes and
   sizes one group. Everything up to verification works on groups.
2. Prefix shingles of groups meet: one shuffle by shingle. Those of a single
   group go.
3. Star rounds over the shingles of more than SMALL groups: each group is paired
   with the representatives that most of its shingles name, pairs are verified,
   and components formed. Large groups of near copies are then mostly one
   component.
4. Exact round over all shingles: pairs of groups that aren't yet in one component
   are filtered by size, place and count. Sets of n and m with a similarity of
   0.75 have a = ceil(0.75 (n + m) / 1.75) common shingles, so that they share
   t + 1 among the first n - a + 1 + t and m - a + 1 + t: of the others at most
   a - 1 - t can be common. t is a part of the shortest prefixes (1 / PART), so
   that long texts with a passage in common fall away and edits of one text, whose
   own shingles come first, don't meet. Members
   are expanded and verified. Links within a component change nothing, and pairs
   that were verified before need no second look, so that no link is lost.

Frequencies: each task counts the shingles of its batches and passes on those in
at least a share RATE of a batch's documents (two at least); sums over all tasks
give the order. A shingle in a share RATE of all documents is thereby found; at
most HEAVY of them, the most frequent, are broadcast. Any order gives the same
result; frequencies only save work.

A shingle that a large part of all groups have is never one task's work: minima
and counts by shingle are partial before the shuffle, and are joined back by
joins that AQE splits. In the exact round, groups of the component that holds
most of a shingle's groups meet the other groups only.

Very long texts are hashed in pieces of PIECE bytes; their sets are held whole.

Defined results: a text without words or null has no shingles, and is its own
component; fewer than five words count as one shingle; repeated rows are
documents of their own with one id; null ids link like others but never name a
component (null if it has no other); further columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

WORDS, PERCENT = 5, 75
RATE, HEAVY = 0.001, 1 << 17
#: Bytes of text hashed at a time (about 50 times as many in memory), and bytes of the longest word whose factors a worker keeps.
PIECE, KEPT = 1 << 18, 1 << 12
#: Star rounds, and partners of a group in each.
ROUNDS, PARTNERS = 2, 2
#: Groups of a shingle that the exact round pairs without a star round; shingles beyond the shortest prefixes that it looks at: a part of these, and at most so many.
SMALL, PART, MORE = 4, 8, 32
#: Bits of the filters of documents (2 MB) and of shingles that stand in more than one group (16 MB).
FILTER_BITS, SHINGLE_BITS = 1 << 24, 1 << 27

_RANDOM = np.random.RandomState(5)
_BYTE = _RANDOM.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.randint(0, 1 << 63, WORDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(KEPT - 1, _BASE)]))
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1 (or more), modulo 2 ** 64."""
    out = _POWERS
    while len(out) < n:
        out = np.concatenate([out, out * (out[-1:] * _BASE)])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of data, by pieces that end where a word does."""
    found, start = [], 0
    while start < len(data):
        cut = _SEPARATOR.search(data, start + PIECE)
        end = cut.start() if cut else len(data)
        h, at = piece_hashes(data[start:end])
        found.append((h, at + start))
        start = end
    return tuple(np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *found, strict=True))


def piece_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[a]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    begin = np.flatnonzero(first)
    sizes = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, sizes)
    h = np.add.reduceat(_BYTE[a[at]] * powers(int(sizes.max()))[place], begin)
    return mixed(h + sizes.astype(np.uint64)), at[begin]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (as signed numbers) of each text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def settle() -> None:
        starts = np.cumsum([0, *(len(x) + 1 for x in held)])
        h, at = word_hashes(b" ".join(held))
        bounds = np.searchsorted(at, starts[:-1])
        bounds = np.append(bounds, len(h))
        s = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            s += h[k : len(s) + k] * _PLACE[k]
        s = mixed(s).view(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(s[a : b - WORDS + 1]))
            elif b > a:
                short = (h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mixed(np.array([short ^ _BASE], np.uint64)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        held.clear()

    size = 0
    for x in texts:
        held.append((x or "").encode().lower())  # of bytes, lower() changes A-Z only
        size += len(held[-1])
        if size >= PIECE:
            settle()
            size = 0
    if held:
        settle()
    return out


def frequent(docs: DataFrame) -> DataFrame:
    """shingle, n of those that stand out, at most HEAVY, most frequent last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist())
            s, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
            keep = n >= max(2, int(np.ceil(RATE * len(sets))))
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(s[keep], pa.int64()), "n": pa.array(n[keep], pa.int64())})

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "shingle").limit(HEAVY)


def prefix_size(n):
    return n - (PERCENT * n + 99) // 100 + 1


class Order:
    """The total order: shingles that don't stand out by hash, then the others by frequency."""

    def __init__(self, shingles: np.ndarray, n: np.ndarray):
        by = np.argsort(shingles)
        self.shingles = shingles[by]
        rank = np.empty(len(shingles), np.int64)
        rank[np.lexsort((shingles, n))] = np.arange(len(shingles))
        self.rank = rank[by]

    def prefix(self, s: np.ndarray) -> np.ndarray:
        size = prefix_size(len(s)) if len(s) else 0
        if not len(self.shingles) or not len(s):
            return s[:size]
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        heavy = self.shingles[at] == s
        light = s[~heavy]
        if len(light) >= size:
            return light[:size]
        return np.concatenate([light, s[heavy][np.argsort(self.rank[at[heavy]])]])[:size]


def key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def described(docs: DataFrame, order: Order) -> DataFrame:
    """doc_id, n, g (of size and prefix), s (of the set) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text").to_pylist())
            prefixes = [order.prefix(s) for s in sets]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n": pa.array(sizes, pa.int32()),
                "g": pa.array([key(n.to_bytes(8, "little") + p.tobytes()) for n, p in zip(sizes, prefixes, strict=True)], pa.binary()),
                "s": pa.array([key(s.tobytes()) for s in sets], pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, n int, g binary, s binary")


def alike(n: Column, m: Column) -> Column:
    """Sizes that a similarity of PERCENT allows."""
    return (100 * F.least(n, m)) >= (PERCENT * F.greatest(n, m))


def common(n: Column, m: Column) -> Column:
    """Shingles that similar sets of n and m have in common at least."""
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT))


def prefix_length(n: Column) -> Column:
    return n - F.ceil(PERCENT * n / 100) + 1


class BitFilter:
    """A set of numbers below ``bits``, as a bit map of fixed size. Numbers that share a bit with a member pass, too: users settle them exactly."""

    def __init__(self, numbers: DataFrame, bits: int):
        """numbers: one column, ``bit``; Spark builds the maps in parts of 4 KB."""
        at = F.col("bit") + 1  # Spark numbers bits from 1: part 1 holds 1 to 32768
        parts = numbers.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("map")).collect()
        self.map = np.zeros(bits // 8, np.uint8)
        for r in parts:
            self.map[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["map"], np.uint8)

    def has(self, numbers: np.ndarray) -> np.ndarray:
        return (self.map[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).astype(bool)


def document_bit(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(FILTER_BITS))


class Verifier:
    """Pairs of classes against their whole sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) of classes that link. Sets are made again for the documents needed, which a bit filter names."""
        need = self.classes.join(pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct(), "s", "left_semi")
        wanted = BitFilter(need.select(document_bit(F.col("doc")).alias("bit")), FILTER_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for b in batches:
                rows = np.flatnonzero(wanted.has(np.asarray(b.column("bit"))))
                sets = {key(x.tobytes()): x for x in shingle_sets(b.column("text").take(pa.array(rows)).to_pylist())}
                sets = {k: x for k, x in sets.items() if k not in seen}
                seen.update(sets)
                yield pa.RecordBatch.from_pydict({"s": pa.array(list(sets), pa.binary()), "set": pa.array(list(sets.values()), pa.list_(pa.int64()))})

        sets = self.docs.select(document_bit(F.col("doc_id")).alias("bit"), "text").mapInArrow(run, "s binary, set array<long>")
        # Both joins are on the set's key, so that Spark shuffles the sets once. Sets that only share a bit with a needed one meet no pair.
        one = pairs.join(sets.select(F.col("s").alias("a"), F.col("set").alias("x")), "a")
        two = one.join(sets.select(F.col("s").alias("b"), F.col("set").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return two.where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("a", "b")


def postings(docs: DataFrame, classes: DataFrame, order: Order) -> DataFrame:
    """g, n, shingle, place (from 0) of the prefix shingles that stand in more than one group, one row each.

    Nearly all prefix shingles stand in one group only. A first pass counts bare
    shingles; a bit filter of those counted twice or more then holds the others
    back from the shuffle that carries groups. Prefixes are made again from the
    texts of the groups' first documents, which is cheaper than to store them.
    """
    heads = BitFilter(classes.groupBy("g").agg(F.min("doc").alias("doc")).select(document_bit(F.col("doc")).alias("bit")), FILTER_BITS)
    source = docs.select(document_bit(F.col("doc_id")).alias("bit"), "text")

    def prefixes(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
        own = np.flatnonzero(heads.has(np.asarray(b.column("bit"))))
        sets = shingle_sets(b.column("text").take(pa.array(own)).to_pylist())
        return [order.prefix(s) for s in sets], [len(s) for s in sets]

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes(b)[0]]))})

    counted = source.mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    twice = BitFilter(counted.select(F.col("shingle").bitwiseAND(SHINGLE_BITS - 1).alias("bit")), SHINGLE_BITS)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sizes = prefixes(b)
            g = [key(n.to_bytes(8, "little") + p.tobytes()) for n, p in zip(sizes, found, strict=True)]
            flat = np.concatenate([np.zeros(0, np.int64), *found])
            at = np.repeat(np.arange(len(found)), [len(p) for p in found])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(p)) for p in found)])
            keep = twice.has(flat & (SHINGLE_BITS - 1))
            to = pa.array(at[keep])
            yield pa.RecordBatch.from_pydict({"g": pa.array(g, pa.binary()).take(to), "n": pa.array(sizes, pa.int32()).take(to), "shingle": pa.array(flat[keep]), "place": pa.array(place[keep], pa.int32())})

    # A document that isn't its group's first may pass the filter: rows of a group and shingle are made one.
    return source.mapInArrow(carried, "g binary, n int, shingle long, place int").distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def labelled(classes: DataFrame, found: DataFrame) -> DataFrame:
    """classes with the root of each: its own, where it has no link."""
    return classes.join(found.withColumnRenamed("node", "s"), "s", "left").select("g", "s", "doc", "n", F.coalesce("root", "s").alias("root"))


def star(big: DataFrame, span: DataFrame, head: DataFrame, tried: DataFrame | None, k: int) -> DataFrame:
    """Pairs (a, b) of classes: each group's first with those of the representatives that most of its shingles name.

    A shingle names the first of its groups by each of five orders. Four stand
    for chance and are others in each round; the fifth puts first the group
    whose prefix is shared most, as that of a text that many were edited from.
    The same few groups are named by most shingles of a large group of near
    copies. Each task finds the first groups of its own rows before the shuffle.
    """
    h, h2 = F.xxhash64(F.lit(k), "g"), F.xxhash64(F.lit(k + 100), "g")
    alone = 1 - F.col("shared") / prefix_length(F.col("n"))
    orders = (F.lit(0.0), h), (F.lit(0.0), F.bitwise_not(h)), (F.lit(0.0), h2), (F.lit(0.0), F.bitwise_not(h2)), (alone, h)
    first = [F.min(F.struct(a.alias("alone"), x.alias("h"), "g", "n")).alias(f"r{i}") for i, (a, x) in enumerate(orders)]
    reps = big.groupBy("shingle").agg(*first).select("shingle", F.array_distinct(F.array(*[F.struct(f"r{i}.g", f"r{i}.n") for i in range(len(orders))])).alias("reps"))
    named = big.join(reps, "shingle").select("g", "n", F.explode("reps").alias("r")).where(F.col("g") != F.col("r.g"))
    named = named.groupBy("g", F.col("r.g").alias("r")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("r.n").alias("m"))
    # Both prefixes end with ceil(0.75 n) - 1 shingles to come, of which no more can be common than of the set whose prefix ends first.
    named = named.where(alike(F.col("n"), F.col("m"))).where(F.col("c") + F.ceil(PERCENT * F.greatest("n", "m") / 100) - 1 >= common(F.col("n"), F.col("m")))
    if k:
        named = named.join(span, "g").join(span.select(F.col("g").alias("r"), F.col("low").alias("l"), F.col("high").alias("t")), "r").where("not (low = high and l = t and low = l)")
    named = named.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("c"), "r"))).where(F.col("k") <= PARTNERS)
    pairs = named.join(head.select("g", F.col("head").alias("a")), "g").join(head.select(F.col("g").alias("r"), F.col("head").alias("b")), "r")
    pairs = ordered(pairs)
    return pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs


def unsettled(big: DataFrame, span: DataFrame) -> DataFrame:
    """Rows of shingles whose groups aren't all of one component, with low and high, the least and the most root of the row's group."""
    placed = big.join(span, "g")
    mixed_ = placed.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least != most").select("shingle")
    return placed.join(mixed_, "shingle")


def inner(big: DataFrame) -> DataFrame:
    """big with inner: whether a group lies whole in the component that holds most of its shingle's groups."""
    roots = big.where("low = high").groupBy("shingle", "low").agg(F.count(F.lit(1)).alias("c"))
    most = roots.groupBy("shingle").agg(F.max(F.struct("c", "low")).alias("x")).select("shingle", F.col("x.low").alias("most"))
    return big.join(most, "shingle", "left").withColumn("inner", F.coalesce((F.col("low") == F.col("high")) & (F.col("low") == F.col("most")), F.lit(False))).drop("most")


def met(open_: DataFrame) -> DataFrame:
    """Pairs (g, h) of groups that share as many of their first shingles as similar sets must; open_: g, n, shingle, place, low, high, inner."""
    x, y = open_.where("not inner").alias("x"), open_.alias("y")
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    n, m = F.col("x.n"), F.col("y.n")
    need = common(n, m)
    early_n, early_m = n - need + 1, m - need + 1
    more = F.least(F.lit(MORE), F.floor(F.least(early_n, early_m) / PART), prefix_length(n) - early_n, prefix_length(m) - early_m)
    early = (F.col("x.place") <= n - need + more) & (F.col("y.place") <= m - need + more)
    both = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("y.inner") | (F.col("x.g") < F.col("y.g"))) & alike(n, m) & early & apart)
    pairs = both.select(F.least("x.g", "y.g").alias("g"), F.greatest("x.g", "y.g").alias("h"), more.cast("int").alias("more"))
    return pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"), F.first("more").alias("more")).where("c > more").select("g", "h")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy = frequent(docs).toArrow()
    order = Order(np.array(heavy["shingle"], np.int64), np.array(heavy["n"], np.int64))
    rows = materialize(described(docs, order), "described")
    classes = materialize(rows.where("n > 0").groupBy("g", "s").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n")), "classes")
    verify = Verifier(docs, classes)
    head = materialize(classes.groupBy("g").agg(F.min("s").alias("head"), F.count(F.lit(1)).alias("members")), "heads")
    within = classes.join(head.where("members > 1"), "g").where("s != head").select(F.col("s").alias("a"), F.col("head").alias("b"))

    posted = materialize(postings(docs, classes, order), "postings")
    counts = posted.groupBy("shingle").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    shared = materialize(posted.join(counts, "shingle"), "shared")
    discard(posted)
    small = shared.where(F.col("groups") <= SMALL).drop("groups")
    big = materialize(shared.where(F.col("groups") > SMALL).drop("groups").withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("g"))), "big")
    placed, links, tried = classes.select("g", "s", "doc", "n", F.col("s").alias("root")), None, None
    span = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    for k in range(ROUNDS):
        pairs = star(big, span, head, tried, k)
        pairs = materialize((pairs if k else pairs.union(ordered(within))).distinct(), "pairs")
        old = [x for x in (links, tried, placed if k else None, big) if x is not None]
        new = verify.links(pairs)
        links = materialize(links.union(new) if links is not None else new, "links")
        tried = materialize(tried.union(pairs) if tried is not None else pairs, "tried")
        # What is of one component goes: a shingle all of whose groups are.
        found = components(links)
        placed = materialize(labelled(classes, found), "placed")
        span = placed.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        big = materialize(unsettled(big, span).drop("low", "high"), "big")
        discard(pairs, found, *old)

    # Exact round.
    span = materialize(span, "span")
    open_ = small.join(span, "g").withColumn("inner", F.lit(False)).unionByName(inner(big.drop("shared").join(span, "g")))
    open_ = materialize(open_, "open")
    pairs = met(open_).union(span.where("low != high").select("g", F.col("g").alias("h")))
    a, b = placed.select("g", F.col("s").alias("a"), F.col("root").alias("p")), placed.select(F.col("g").alias("h"), F.col("s").alias("b"), F.col("root").alias("q"))
    more = ordered(pairs.join(a, "g").join(b, "h").where("p != q").select("a", "b")).distinct()
    more = materialize(more.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(shared, open_, big, tried)
    links = materialize(links.union(verify.links(more)), "links")
    found = components(links)

    whole = classes.join(found.withColumnRenamed("node", "s"), "s", "left").select("s", "doc", F.coalesce("root", "s").alias("root"))
    named = whole.groupBy("root").agg(F.min("doc").alias("component_id"))
    whole = whole.join(named, "root").select("s", "component_id")
    out = rows.where("n > 0").select("doc_id", "n", "s").join(whole, "s").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", F.lit(0).cast("long"), F.col("doc_id")))

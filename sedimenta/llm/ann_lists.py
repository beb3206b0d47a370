"""Approximate nearest neighbours by balanced posting lists.

Largest inner products become nearest points on a sphere: a vector x is divided
by the largest norm and gets one more coordinate, which makes it of length 1; a
query gets a zero there. Of the points:

* Centroids: about as many as the root of the rows. A bounded sample is halved
  again and again, each time at the median along the difference of two means, so
  that lists are balanced.
* Lists: every vector goes to its nearest centroid, and a boundary vector also
  to others that are nearly as near (at most ``copies``).
* Search: a graph links each centroid with its neighbours; a best-first walk
  finds those near a query; it takes every list whose distance is at most
  (1 + ratio) times the least. Copies and ratio are those that read the fewest
  rows of all that reach TARGET of the true neighbours of sampled queries in the
  sample. If they would read more than WORTH of all rows, there is one list, which
  is an exact scan.
* Lists are cut into blocks of a bounded number of rows. Queries go to the blocks
  of their nearest list first; what they find there bounds what the blocks of
  their other lists return. A task holds one block and passes its queries by
  in batches. Inner products are in double precision on the original vectors.

Defined results: null, zero and non-finite vectors take no part, nor those of
another length than most; ties go to the smaller id; with fewer candidates than
k all are returned; repeated rows with one id count once; null ids take no part;
further columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows of the sample: so many for each list, at least SAMPLE, and at most so many bytes (262,144 rows of 64 numbers, for 16,384 lists).
SAMPLE_LIST, SAMPLE, SAMPLE_BYTES = 16, 16_384, 128 << 20
#: Lists of a vector that are tried, and how much farther than the nearest centroid they may be.
COPIES, NEAR = (1, 2, 3), 0.06
#: Neighbours of a centroid in the graph; share of true neighbours to reach on the sample; queries for that; share of all rows that a search may read.
LINKS, TARGET, TRIALS, WORTH = 12, 0.95, 200, 0.9
#: Rows of a block, and rows that are worked on at a time.
BLOCK, STEP = 8192, 256


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of float, or of double where the column isn't of floats) of the vectors that take part, one row an id."""
    kind = "array<float>" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    v = v.where(F.size("v") == (sizes["n"] if sizes else 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))


def halves(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of balanced parts of x."""
    parts = [(-len(x), 0, np.arange(len(x)))]
    while len(parts) < lists:
        size, number, own = heapq.heappop(parts)
        if size > -2:
            heapq.heappush(parts, (size, number, own))
            break
        y = x[own]
        a, b = y[0], y[((y - y[0]) ** 2).sum(1).argmax()]
        for _ in range(5):
            side = ((y - a) ** 2).sum(1) > ((y - b) ** 2).sum(1)
            if side.all() or not side.any():
                break
            a, b = y[~side].mean(0), y[side].mean(0)
        order = np.argsort(y @ (b - a), kind="stable")
        for k, p in enumerate((own[order[: len(own) // 2]], own[order[len(own) // 2 :]])):
            heapq.heappush(parts, (-len(p), 2 * number + k + 1, p))
    return np.array([x[p].mean(0) for _, _, p in sorted(parts, key=lambda p: p[1])])


class Lists:
    """Centroids, their graph, copies and the pruning ratio. read: the part of all rows that a query reads, by the sample (more than 1 is possible by copies)."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int | None = None, k: int = 20):
        self.largest = largest
        points = self.points(sample)
        self._link(halves(points, max(1, min(round(math.sqrt(rows or len(sample))), len(points) // SAMPLE_LIST))))
        self.copies, self.ratio, self.read = 1, 0.0, 1.0
        if len(self.centroids) > 1:
            self._choose(sample[:SAMPLE], k)
            if self.read > WORTH:
                self._link(points.mean(0, keepdims=True))
                self.copies, self.ratio, self.read = 1, 0.0, 1.0

    def _link(self, centroids: np.ndarray) -> None:
        self.centroids, n = centroids, len(centroids)
        links: list[set[int]] = [set() for _ in range(n)]
        for at in range(0, n, STEP):
            d = self.distances(centroids[at : at + STEP])
            near = np.argsort(d, axis=1, kind="stable")[:, 1 : LINKS + 1]
            for i, r in enumerate(near.tolist(), at):
                links[i].update(r)
                for j in r:
                    links[j].add(i)
        # A ring keeps the graph in one piece.
        self.links = [np.array(sorted(s | {(i + 1) % n, (i - 1) % n}), np.int64) for i, s in enumerate(links)]

    def points(self, v: np.ndarray) -> np.ndarray:
        v = v / self.largest
        return np.column_stack([v, np.sqrt(np.maximum(0, 1 - (v**2).sum(1)))])

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T))

    def assign(self, v: np.ndarray, copies: int | None = None) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and others nearly as near."""
        out: list[np.ndarray] = []
        most = min(copies or self.copies, len(self.centroids))
        for at in range(0, len(v), STEP):
            d = self.distances(self.points(v[at : at + STEP]))
            order = np.argpartition(d, most - 1, axis=1)[:, :most] if most < d.shape[1] else np.tile(np.arange(most), (len(d), 1))
            order = np.take_along_axis(order, np.lexsort((order, np.take_along_axis(d, order, 1)), axis=1), 1)
            least = np.take_along_axis(d, order, 1)
            out += [o[x <= (1 + NEAR) * x[0]] for o, x in zip(order, least, strict=True)]
        return out

    def walk(self, q: np.ndarray, ratio: float) -> list[int]:
        """Lists for a query point, by a best-first walk over the graph that goes on while it is within the ratio."""
        c, seen = self.centroids, {0}
        d0 = float(np.linalg.norm(c[0] - q))
        heap, best, out = [(d0, 0)], d0, []
        slack = 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > (1 + ratio) * best:
                slack += 1
                if slack > LINKS:
                    break
            out.append((d, i))
            new = [int(j) for j in self.links[i] if int(j) not in seen]
            if new:
                seen.update(new)
                for x, j in zip(np.linalg.norm(c[new] - q, axis=1), new, strict=True):
                    heapq.heappush(heap, (float(x), j))
                    best = min(best, float(x))
        return [i for d, i in sorted(out) if d <= (1 + ratio) * best]

    def _choose(self, sample: np.ndarray, k: int) -> None:
        """Copies and the smallest ratio that finds TARGET of the neighbours of sampled queries in the sample, so that they read the fewest rows."""
        rows = np.unique(np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int))
        scores = sample[rows] @ sample.T
        scores[np.arange(len(rows)), rows] = -np.inf
        true = np.argsort(-scores, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
        d = self.distances(self.queries(sample[rows]))
        d = d / np.maximum(d.min(1, keepdims=True), 1e-12) - 1
        best = None
        for copies in COPIES:
            lists = self.assign(sample, copies)
            need = np.sort(np.concatenate([[min(d[i, c] for c in lists[t]) for t in r] for i, r in enumerate(true)]))
            ratio = float(need[min(len(need) - 1, int(TARGET * len(need)))]) + 1e-9
            sizes = np.bincount(np.concatenate(lists), minlength=len(self.centroids))
            read = float(((d <= ratio) * sizes).sum(axis=1).mean() / len(sample))
            if best is None or read < best[0]:
                best = read, copies, ratio
        self.read, self.copies, self.ratio = best


def build(vectors: DataFrame, k: int = 20) -> Lists | None:
    """Lists from a sample of vectors(vec_id, v), by the order of a hash of vec_id: SAMPLE rows or SAMPLE_LIST for each list, but SAMPLE_BYTES at most, come to the driver."""
    found = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    if not found["n"]:
        return None
    rows = min(max(SAMPLE, SAMPLE_LIST * round(math.sqrt(found["n"]))), max(1, SAMPLE_BYTES // (8 * found["size"])))
    share = min(1.0, rows / found["n"] * 1.05)
    near = vectors.where(F.pmod(F.xxhash64(F.lit(6), "vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = near.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(rows).select("v").toArrow()
    return Lists(matrix(sample["v"].combine_chunks()), float(np.sqrt(found["most"])) * (1 + 1e-12), found["n"], k)


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1)


class Block:
    """Vectors of a block; nearest() of queries among them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids)
        self.ids, self.x, self.k = ids[order], x[order], k
        # A product of matrices may differ in the last bits by place; rows so near the bound are kept until their exact scores are known.
        self.slack = 4 * x.shape[1] * np.finfo(float).eps * float(np.linalg.norm(x, axis=1).max())

    def nearest(self, names: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        """(query, ids, scores) of the k nearest with scores of at least the query's bound, nearest first."""
        out, ids, x, k = [], self.ids, self.x, self.k
        for at in range(0, len(q), STEP):
            for i, s in enumerate(q[at : at + STEP] @ x.T, at):
                own = np.searchsorted(ids, names[i])
                if own < len(ids) and ids[own] == names[i]:
                    s[own] = -np.inf
                least = max(bounds[i], np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf)
                keep = np.flatnonzero((s > -np.inf) & (s >= least - self.slack * float(np.linalg.norm(q[i]))))
                exact = (x[keep] * q[i]).sum(axis=1)
                keep, exact = keep[exact >= bounds[i]], exact[exact >= bounds[i]]
                keep, exact = (y[np.lexsort((ids[keep], -exact))[:k]] for y in (keep, exact))
                if len(keep):
                    out.append((int(names[i]), ids[keep], exact))
        return out


FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def scan(postings: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: of postings(list, block, vec_id, v) the k nearest of each block for asked(list, block, query_id, v, bound). Vectors of a block come before its queries, which pass by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("list", "block", "asks")])
            names, v, bounds, out = np.asarray(b.column("id")), matrix(b.column("v")), np.asarray(b.column("bound")), []
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(keys[:2, i].tolist())
                if here != at:
                    at, held, block = here, [], None
                if not keys[2, i]:
                    held.append((names[i:j], v[i:j]))
                elif held:
                    block = block or Block(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), k)
                    out += block.nearest(names[i:j], v[i:j], bounds[i:j])
            yield pa.RecordBatch.from_pydict({"query_id": [x for x, _, _ in out], "ids": [y for _, y, _ in out], "scores": [z for _, _, z in out]}, schema=FOUND)

    p = postings.select("list", "block", F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", F.lit(0.0).alias("bound"))
    q = asked.select("list", "block", F.lit(1).alias("asks"), F.col("query_id").alias("id"), "v", "bound")
    rows = p.unionByName(q).repartition("list", "block").sortWithinPartitions("list", "block", "asks")
    pairs = rows.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")
    return pairs.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``, itself left out."""
    spark = vectors.sparkSession
    vectors = materialize(usable(vectors), "ann-vectors")
    lists = build(vectors, k)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = vectors.schema["v"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = lists.assign(matrix(b.column("v")))
            rows = pa.array(np.repeat(np.arange(len(to)), [len(x) for x in to]))
            yield pa.RecordBatch.from_pydict({"list": pa.array(np.concatenate(to) if to else [], pa.int32()), "vec_id": b.column("vec_id").take(rows), "v": b.column("v").take(rows)})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [lists.walk(q, lists.ratio) for q in lists.queries(matrix(b.column("v")))]
            yield pa.RecordBatch.from_pydict({"query_id": b.column("vec_id"), "v": b.column("v"), "lists": pa.array(to, pa.list_(pa.int32()))})

    postings = materialize(vectors.mapInArrow(assign, f"list int, vec_id long, v {kind}"), "ann-postings")
    # A row a list: 16,384 at most.
    blocks = F.broadcast(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    postings = postings.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).select("list", "block", "vec_id", "v")
    asked = materialize(vectors.where(F.col("vec_id") % every == 0).mapInArrow(walk, f"query_id long, v {kind}, lists array<int>"), "ann-asked")
    to_blocks = lambda q: q.join(blocks, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    first = asked.select("query_id", "v", F.element_at("lists", 1).alias("list"), F.lit(float("-inf")).alias("bound"))
    near = scan(postings, to_blocks(first), k).withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")
    near = materialize(near, "ann-near")
    bounds = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
    rest = asked.select("query_id", "v", F.explode(F.expr("slice(lists, 2, size(lists))")).alias("list"))
    rest = rest.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    pairs = near.union(scan(postings, to_blocks(rest), k))
    # Copies of a vector in several lists have one score; the first of each stays.
    ranked = pairs.withColumn("place", F.dense_rank().over(best)).where(F.col("place") <= k)
    return ranked.distinct().select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")

import math
import re

import pytest
from pyspark.sql import functions as F
from sedimenta.llm import mixing
from sedimenta.llm.common import table


def shares(sizes, weights=(5.0, 2.0, 1.0), share=1.5, multiple=2.0):
    """Reshare the excess of full sources until none is above."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        total = sum(w[n] for n in open_)
        full = {n for n in open_ if left * w[n] / total > multiple * sizes[n] + 1e-9}
        if not full:
            return out | {n: left * w[n] / total for n in open_}
        for n in full:
            out[n] = multiple * sizes[n]
            left -= out[n]
        open_ -= full


def check(docs, block):
    rows = mixing.mix_documents(docs, block).collect()
    given = docs.select("doc_id", "text", "source").collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r["doc_id"] or -1, len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in given)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = shares(sizes)
    for s, n in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {n}
        assert all(r["target"] == pytest.approx(want[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 1
    assert rows == mixing.mix_documents(docs.repartition(5), block).orderBy("doc_id").collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(docs.repartition(5), block).collect()))


def test_odd(odd):
    check(odd, 7)


def test_documents(spark, sf):
    check(table(spark, sf, "documents"), 64)


def test_unequal_sources(spark):
    rows = [(i, "w " * (i % 50), "s%d" % min(i % 17, 3)) for i in range(300)] + [(1000 + i, "w " * 400, "z") for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 16)


def test_empty(none, odd):
    assert mixing.mix_documents(none).count() == 0
    without = mixing.mix_documents(odd.withColumn("text", F.lit(" "))).collect()
    assert {(r["target"], r["taken"]) for r in without} == {(0.0, 0)}


def brute(rows, targets, keys, block, phi):
    """taken, first slot and number of slots of each row (doc_id, source, size), by going through the schedule slot by slot."""
    names = sorted(targets, key=lambda x: (x is None, x or ""))
    take = {n: int(math.floor(targets[n] + 0.5)) for n in names}
    need = {n: -(-take[n] // block) for n in names}
    blocks, streams = sum(need.values()), {}
    edges = [n for n in names if need[n]]
    for n in names:
        own = sorted((r for r in rows if r[1] == n), key=lambda r: (keys[r[0]] % 64, keys[r[0]], r[0]))
        # Word i of the stream belongs to owner[i]; a second passage follows the first.
        streams[n] = [r[0] for r in own for _ in range(r[2])] * 2
    out = {r[0]: [0, None, 0] for r in rows}
    used, slots = dict.fromkeys(names, 0), 2 * blocks
    draws = []
    while True:
        for k in range(len(draws), slots):
            u, low = k * phi % mixing.ONE / mixing.ONE, 0
            for n in edges:
                low += need[n]
                if u < (1.0 if low == blocks else low / blocks):
                    draws.append(n)
                    break
        if all(draws.count(n) >= need[n] for n in edges) or slots >= mixing.LONGEST * blocks:
            break
        slots *= 2
    for k, n in enumerate(draws):
        r = used[n]
        used[n] += 1
        if r >= need[n]:
            continue
        words = streams[n][r * block : min((r + 1) * block, take[n])]
        whole = sum(x[2] for x in rows if x[1] == n)
        pieces = {(d, (r * block + i) // whole) for i, d in enumerate(words)}
        for d in words:
            out[d][0] += 1
        for d, _ in pieces:
            out[d][1] = k if out[d][1] is None else min(out[d][1], k)
            out[d][2] += 1
    return {d: tuple(x) for d, x in out.items()}


@pytest.mark.parametrize("phi", [mixing.PHI, 1 << 51, 1])
def test_brute_force(spark, monkeypatch, phi):
    """The rows are those of the schedule, by any sequence of points: with 1 nearly all slots name the first source."""
    monkeypatch.setattr(mixing, "PHI", phi)
    rows = [(i, f"s{i % 5 % 3}" if i % 7 else None, i * 37 % 41) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    keys = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(10), "doc_id", "size")).collect()}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    got = {r["doc_id"]: (r["taken"], r["first_slot"], r["n_slots"]) for r in mixing.mix(docs, 16).collect()}
    assert got == brute(rows, shares(sizes), keys, 16, phi)


def test_long_texts(spark):
    docs = spark.createDataFrame([(0, "a", "word " * 1_000_000), (1, "b", "x" * 3_000_000), (2, "b", "x " * 10)], "doc_id long, source string, text string")
    check(docs, 4096)


def test_schedule_is_even(spark):
    """Each stretch of the schedule holds the sources by their weights: low discrepancy."""
    sizes = spark.createDataFrame([(1, 500_000.0), (2, 300_000.0), (3, 200_000.0)], "place long, target double")
    rows = mixing.schedule(sizes, 1000).orderBy("slot").collect()
    assert len(rows) == 1000
    for a in range(0, 1000, 100):
        part = [r["place"] for r in rows[a : a + 100]]
        assert abs(part.count(1) - 50) <= 3 and abs(part.count(2) - 30) <= 3
    for p, n in ((1, 500), (2, 300), (3, 200)):
        assert sorted(r["rank"] for r in rows if r["place"] == p) == list(range(n))

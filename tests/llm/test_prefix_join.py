import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sedimenta.llm import prefix_join as pj
from sedimenta.llm.common import table
from sedimenta.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    post = {}
    for i, s in enumerate(sets):
        for x in s:
            post.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in post[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, s string, n int").repartition(3)
    assert sorted(map(tuple, pj.join(docs).collect()), key=str) == brute(rows)


@settings(deadline=None, max_examples=30)
@given(st.lists(st.text("aB \t\né.", max_size=40), max_size=8))
def test_shingle_sets(texts):
    """Equal sets have equal hashes, sizes and overlaps are those of the word sequences."""
    sets = pj.shingle_sets(texts)
    want = [shingles(t) for t in texts]
    assert [len(x) for x in sets] == [len(x) for x in want]
    for a, x in zip(sets, want, strict=True):
        for b, y in zip(sets, want, strict=True):
            assert len(np.intersect1d(a, b)) == len(x & y)


def test_pieces(monkeypatch):
    texts = ["a b c d e f " * 50, "one two", "", "x " * 300]
    want = pj.shingle_sets(texts)
    monkeypatch.setattr(pj, "PIECE", 10)
    assert all((a == b).all() for a, b in zip(pj.shingle_sets(texts), want, strict=True))


def test_documents(spark):
    rows = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text").collect()]
    check(spark, rows)


def near_copies(seed, groups=6, members=25, words=60):
    """Copies by random edits, many of them near the bound of similarity, with a shared passage."""
    rng = np.random.RandomState(seed)
    passage = [f"p{i}" for i in range(20)]
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(3000)}" for _ in range(words)]
        for m in range(members):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randint(len(own))] = f"e{rng.randint(10**6)}"
            if m % 3 == 0:
                own += passage
            rows.append((g * 1000 + m, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    check(spark, near_copies(seed))


def test_odd(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(spark, rows)
    assert pj.join(none).count() == 0
    check(spark, [(1, "a b"), (2, "A B"), (3, "b a"), (4, None), (4, "a b"), (None, "q r s t u"), (None, "Q R S T U"), (None, "a  b"), (9, "q r s t u v")])


def test_equal_prefixes_of_different_sets(spark, monkeypatch):
    """Members of a group are verified, too."""
    monkeypatch.setattr(pj, "prefix_size", lambda n: n - (75 * n + 99) // 100 + 1)
    base = [f"w{i}" for i in range(40)]
    check(spark, [(i, " ".join(base + [f"t{i}", f"u{i % 3}"])) for i in range(12)])


def test_components(spark):
    rng = np.random.RandomState(3)
    edges = [(int(a), int(b)) for a, b in rng.randint(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not changed:
            break
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}

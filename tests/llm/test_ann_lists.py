import numpy as np
from sedimenta.llm import ann_lists as al
from sedimenta.llm.common import table


def brute(rows, k=20, every=20):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (x * np.array(rows[q])).sum(1)
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order if s[j] > -np.inf]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute({r["vec_id"]: [float(x) for x in r["embedding"]] for r in e.collect()})
    got = found(al.search(e))
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9
    score = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(score.get((q, i), s) - s) < 1e-12 for q in got for i, s in got[q])


def test_unequal_norms_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(al, "WORTH", 9.0)
    monkeypatch.setattr(al, "BLOCK", 20)
    rng = np.random.RandomState(1)
    rows = {i: (rng.randn(8) * rng.uniform(0.1, 4)).tolist() for i in range(600)}
    want, got = brute(rows), found(al.search(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")))
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (9, [1.0, 0.0]), (40, [0.0, 0.0])]
    e = spark.createDataFrame([(*r, 5, 1) for r in rows], "vec_id long, embedding array<double>, list int, block int")
    assert found(al.search(e)) == {0: [(1, 1.0), (9, 1.0), (20, -1.0)], 20: [(0, -1.0), (1, -1.0), (9, -1.0)]}
    assert al.search(e.where("false")).count() == 0
    assert al.search(e.where("vec_id = 0")).count() == 0


def reads(x, lists, every=20, k=20):
    """Rows that a query reads as a part of all, and recall, through assign() and walk()."""
    to = lists.assign(x)
    sizes = np.bincount(np.concatenate(to), minlength=len(lists.centroids))
    read, right = [], []
    for i in range(0, len(x), every * 10):
        s = x @ x[i]
        s[i] = -np.inf
        true = np.argsort(-s, kind="stable")[:k]
        own = set(lists.walk(lists.queries(x[i : i + 1])[0], lists.ratio))
        read.append(sum(sizes[j] for j in own) / len(x))
        right.append(np.mean([bool(own & set(to[t].tolist())) for t in true]))
    return np.mean(read), np.mean(right)


def test_pruning_pays():
    """On clustered vectors few rows are read; on random ones at most as many as there are. Recall is measured through the walk."""
    rng = np.random.RandomState(2)
    centres = rng.randn(500, 64)
    x = centres[rng.randint(0, 500, 50_000)] + 0.3 * rng.randn(50_000, 64)
    lists = al.Lists(x[:16_384], float(np.linalg.norm(x, axis=1).max()), len(x))
    read, recall = reads(x, lists)
    assert 200 <= len(lists.centroids) <= 240 and read < 0.3 and recall >= 0.9
    x = rng.randn(50_000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    read, recall = reads(x, al.Lists(x[:16_384], 1.0, len(x)))
    assert read <= 1.0 and recall >= 0.9


def test_balanced():
    rng = np.random.RandomState(0)
    x = np.concatenate([np.ones((600, 4)) + rng.randn(600, 4) * 1e-3, rng.randn(424, 4)])
    lists = al.Lists(x, float(np.linalg.norm(x, axis=1).max()))
    assert len(lists.centroids) == 32 or lists.read == 1.0

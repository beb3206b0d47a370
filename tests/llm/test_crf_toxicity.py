import itertools
import math

import numpy as np
import pytest
from sedimenta.llm import crf_toxicity as ct
from sedimenta.llm.common import is_held_out, table

CRF = ct.Crf({"=bad": 6.0, "=awful": 7.0, "ba": 1.0, "=well": -3.0}, -3.0, np.array([[1.0, -1.0], [-0.5, 0.4]]), np.array([0.5, -0.5]))


def brute(words):
    """Marginals by all state sequences."""
    total, toxic = 0.0, [0.0] * len(words)
    for ys in itertools.product((0, 1), repeat=len(words)):
        s = CRF.start[ys[0]] + sum(CRF.emission(w) for w, y in zip(words, ys, strict=True) if y) + sum(CRF.trans[a, b] for a, b in itertools.pairwise(ys))
        p = math.exp(s)
        total += p
        for i, y in enumerate(ys):
            toxic[i] += p * y
    return [x / total for x in toxic]


@pytest.mark.parametrize("text", ["bad", "a bad b", "bad awful c d e bad", "a b c d awful e f g h i", "x y bad bad z", "well well bad", "a b c d e f bad"])
def test_marginals_by_brute_force(text):
    words = ct.tokens(text)
    active = CRF.active(words)
    assert np.allclose(CRF.marginals(len(words), active), [brute(words)[i] for i, _ in active])


def test_spans():
    m = ct.Model(CRF, np.array([-4.0, 2.0, 0.5, 4.0, 0.0]), 0.1)
    text = "it is  Bad, awful! stuff\nand BAD"
    assert [text[a:b] for a, b, _ in m.spans(text)] == ["Bad, awful!", "BAD"]
    assert m.of(text)[0] > 0.5 > m.of("it is fine")[0] and m.spans("") == [] == m.spans(None)


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    """One step of training raises the likelihood of the labelled windows."""
    windows = [([[0], [1], []], [1, 0, 0]), ([[1], [0]], [0, 1]), ([[], [1], [1], [0]], [0, 0, 0, 1])]
    w, bias, trans, start = ct.train_crf(windows, 2)
    crf = ct.Crf({"=aaa": float(w[0]), "=bbb": float(w[1])}, bias, trans, start)
    assert w[0] > 0.5 > w[1]
    assert crf.emission("aaa") > crf.emission("bbb")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labelled, known = table(spark, sf, "labels"), table(spark, sf, "documents", "doc_id", "text")
    known = known.join(labelled.select("doc_id"), "doc_id", "left_semi")
    got = {r["doc_id"]: r for r in ct.score(known, ct.learn(known, labelled)).collect()}
    labels = [r for r in labelled.collect() if is_held_out(r["doc_id"])]
    assert np.mean([got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_odd(odd, none, spark):
    labels = spark.createDataFrame([(i * 3, i % 2, None) for i in range(20)] + [(3, 1, None), (None, 1, None), (6, None, None), (9, 7, None)], "doc_id long, toxic int, text string")
    model = ct.learn(odd, labels)
    rows = ct.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert ct.score(none, model).count() == 0
    empty = ct.learn(none, labels.where("false"))
    assert {r["score"] for r in ct.score(odd, empty).collect()} == {0.0}
    assert {r["score"] for r in ct.score(odd, ct.learn(odd, labels.where("toxic = 0"))).collect()} == {0.0}


def test_planted_documents(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    words = ["grumblefoo", "snarkle"]
    rows = docs.collect()
    toxic = [(r["doc_id"], (r["text"] or "") + f" {words[i % 2]} and {words[(i + 1) % 2]}s {words[i % 2]}") for i, r in enumerate(rows) if r["doc_id"] % 3 == 0]
    clean = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] % 3]
    made = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in ct.score(made, ct.learn(made, labels)).collect()}
    assert np.mean([got[i]["predicted"] == 1 for i, _ in toxic]) > 0.97
    assert np.mean([got[i]["predicted"] == 0 for i, _ in clean]) > 0.97
    text = dict(toxic)
    for i, _ in toxic:
        if got[i]["predicted"]:
            assert any("grumblefoo" in text[i][s["first"] : s["end"]].lower() or "snarkle" in text[i][s["first"] : s["end"]].lower() for s in got[i]["spans"])


def test_all_tokens_and_weights_count():
    """Weights below and above zero, of whatever size, and neighbours of toxic tokens count as in the sum over all state sequences."""
    words = ct.tokens("well bar bad it well awful x")
    assert CRF.emission("well") == -6.0 and ct.Crf({"bar": 0.5}, -3.0, CRF.trans, CRF.start).emission("bars") == -2.5
    p = CRF.marginals(len(words), CRF.active(words))
    assert len(p) == len(words) and np.allclose(p, brute(words))
    sticky = ct.Crf({"=bad": 9.0}, -1.0, np.array([[1.0, -2.0], [-2.0, 3.0]]), np.zeros(2))
    text = "bad it bad"
    assert [text[a:b] for a, b, _ in ct.Model(sticky, np.zeros(5), 0.1).spans(text)] == [text]


def test_windows_are_no_prefix(monkeypatch):
    """Each toxic text and each seed word keeps windows, wherever the texts stand, when there are many more than the bound."""
    monkeypatch.setattr(ct, "MOST_WINDOWS", 120)
    fill = lambda i, k: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j % 26)}x" for j in range(k))
    texts = [" ".join(f"{fill(i + j, 31)} {'early' if i < 60 else 'latter'}bad" for j in range(5)) + " " + fill(i, 160) for i in range(80)]
    seeds = {"=earlybad", "=latterbad"}
    is_marked = lambda w: f"={w}" in seeds
    chosen = ct.choose_windows(texts, seeds, is_marked)
    marked = [(k, at) for k, at in chosen if any(is_marked(w) for w in ct.tokens(texts[k])[at : at + ct.WINDOW])]
    assert {k for k, _ in marked} == set(range(80)) and len(chosen) > len(marked) and len(set(chosen)) == len(chosen)
    rows = [(x, 1) for x in texts] + [(fill(i, 200), 0) for i in range(80, 160)]
    model = ct.fit(rows, {0: 0.5, 1: 0.5})
    assert all(model.crf.weights.get(f, 0.0) > 1 for f in seeds)
    assert model.of(texts[0])[0] > 0.5 and model.of(texts[79])[0] > 0.5 > model.of(rows[-1][0])[0]

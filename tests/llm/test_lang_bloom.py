import numpy as np
from sedimenta.llm import lang_bloom as lb
from sedimenta.llm.common import is_held_out, table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in lb.identify(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if is_held_out(r["doc_id"])]
    assert all(got[r["doc_id"]]["held_out"] == is_held_out(r["doc_id"]) for r in docs.select("doc_id").collect())
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    from pyspark.sql import functions as F

    docs = table(spark, sf, "documents", "doc_id", "text", "lang")
    spoilt = docs.withColumn("lang", F.when(lb.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert sorted(lb.identify(docs).collect()) == sorted(lb.identify(spoilt).collect())


def filters():
    typical = [np.unique(lb.grams(x)) for x in ("the and that with", "der die und nicht ß", "les des une être")]
    return lb.Filters(["a", "b", "c"], typical)


def brute(f, text):
    """Corrected counts trigram by trigram."""
    c = [x if x.isalpha() else " " for x in f"\n{text.lower()}\n"]
    hits, n = [0] * len(f.languages), 0
    for i in range(1, len(c) - 1):
        if c[i] != " ":
            n += 1
            g = lb.grams("".join(c[i - 1 : i + 2]))
            g = lb.grams(c[i], c[i - 1], c[i + 1])
            assert len(g) == 1
            for k in range(len(f.languages)):
                hits[k] += all(int(f.masks[0, lb.slots(g, j)[0]]) >> k & 1 for j in range(lb.HASHES))
    return n, [max(0, (h - n * r) / (1 - r)) for h, r in zip(hits, f.false_rate, strict=True)]


def test_counts_by_brute_force(monkeypatch):
    f = filters()
    texts = ["the and", "", "die und 12 nicht!", "x", "Être  les\n", "the der les " * 30]
    for piece in (1 << 20, 5, 64):
        monkeypatch.setattr(lb, "PIECE", piece)
        n, c = f.counts(texts)
        for i, t in enumerate(texts):
            m, want = brute(f, t)
            assert n[i] == m and np.allclose(c[i], want)


def test_more_than_64_languages():
    names = [f"l{i:03d}" for i in range(70)]
    words = ["".join(map(chr, np.random.RandomState(i).randint(97, 123, 9))) for i in range(70)]
    f = lb.Filters(names, [np.unique(lb.grams(w)) for w in words])
    assert f.predict(words)[0] == names


def test_odd(odd, none):
    got = lb.identify(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got} <= {"en", "und"}
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[0] == by[3] == by[54] == by[57] == "und" and by[None] == "en"
    assert lb.identify(none).count() == 0


def test_nothing_to_learn(odd):
    from pyspark.sql import functions as F

    assert {(r["lang_pred"], r["score"]) for r in lb.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


FOREIGN = [
    "La mattina dopo il ragazzo uscì di casa presto e camminò lungo il fiume fino al vecchio ponte di pietra dove lo aspettava suo fratello con il cane.",
    "Rano wyszedł z domu i poszedł wzdłuż rzeki aż do starego kamiennego mostu, gdzie czekał na niego brat z psem.",
    "Утром мальчик вышел из дома и пошёл вдоль реки к старому мосту, где его ждал брат с собакой.",
    "Wat een mooie dag om met de hond langs de rivier te wandelen en daarna samen koffie te drinken in de oude stad.",
]


def test_foreign_and_junk_texts_go(spark):
    from pyspark.sql import functions as F
    from sedimenta.llm import stages

    docs = table(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")
    random = np.random.RandomState(1)
    junk = [" ".join("".join(map(chr, random.randint(97, 123, random.randint(3, 10)))) for _ in range(k)) for k in (12, 200, 2000)]
    planted = spark.createDataFrame([(-1 - i, x, None) for i, x in enumerate(junk + FOREIGN)], docs.schema)
    kept = {r["doc_id"] for r in stages.of_a_language(docs.unionByName(planted)).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    # Of the labelled texts with a letter, nearly all stay, short ones included.
    clean = {r["doc_id"] for r in docs.where(F.col("text").rlike("[a-z]")).collect()}
    assert len(clean & kept) > 0.995 * len(clean)


def test_evidence_depends_on_length():
    f = filters()
    f.least = np.full(3, 0.5)
    assert f.evident(np.array([4, 400]), np.array([0, 0]), np.array([1.0, 100.0])).tolist() == [True, False]
    assert f.evident(np.array([4, 400]), np.array([0, 0]), np.array([0.0, 250.0])).tolist() == [False, True]

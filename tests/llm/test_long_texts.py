"""Texts of several MB beside short ones, in operators whose own tests have none."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from sedimenta.llm import crf_toxicity, elias_fano, lang_bloom, license_scan, prefix_join, warc
from tokenizers import Tokenizer

LONG = "".join(f"w{i * 7919 % 90001} and the {'mit license' if i % 50000 == 0 else 'word'}, " for i in range(150_000))
TEXTS = [LONG, LONG + "a few more words at the end", "x" * 2_000_000, "short words of a text here", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_token_files(docs):
    t, start = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = by_id(elias_fano.token_files(docs.where("doc_id <> 2"), P.path("byte_bpe_50k.json")))
    for i in (0, 1, 3, 4):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0]
        assert tuple(got[i])[:4] == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_prefix_join(docs):
    got = by_id(prefix_join.join(docs))
    sets = lambda x: {tuple(w[i : i + 5]) for w in [(x or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    assert [got[i]["n_shingles"] for i in range(5)] == [len(sets(x)) for x in TEXTS]
    assert [got[i]["component_id"] for i in range(5)] == [0, 0, 2, 3, 4]


def test_licences(docs):
    got = by_id(license_scan.scan(docs))
    words = license_scan.words_of(LONG)
    places = [i for i in range(len(words) - 1) if words[i : i + 2] == [b"mit", b"license"]]
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (len(words), 3, places[0], places[-1])
    assert got[0]["base_labels"] == "mit" and got[2]["n_words"] == 1 and got[4]["n_words"] == 0


def test_scores(docs, spark):
    """The end of a long text counts: a toxic passage there is found by its place."""
    bad = " foulword foulword foulword foulword"
    made = docs.select("doc_id", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(bad))).otherwise(F.col("text")).alias("text"))
    train = spark.createDataFrame([(100 + i, f"some plain words {i} here" + bad * (i % 2)) for i in range(80)], "doc_id long, text string")
    labels = train.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = crf_toxicity.learn(train, labels)
    got = by_id(crf_toxicity.score(made, model))
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["score"] > got[0]["score"]
    whole = TEXTS[1] + bad
    spans = model.spans(whole)
    # Transitions are sticky, so that a word beside the passage may go with it; none elsewhere does.
    assert len(spans) == 1 and spans[0][0] > len(TEXTS[1]) - 20 and spans[0][0] <= whole.index("foulword") and spans[0][1] == len(whole)


def test_languages(docs, spark):
    train = spark.createDataFrame([(10 + i, LONG[i * 900 : i * 900 + 900], "en") for i in range(60)] + [(100 + i, "zyq xuv kjw " * 60 + f"vqz{i}", "zz") for i in range(60)], "doc_id long, text string, lang string")
    got = by_id(lang_bloom.identify(docs, lang_bloom.learn(train)))
    assert [got[i]["lang_pred"] for i in (0, 1, 4)] == ["en", "en", "und"]


def test_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"))
    got = by_id(warc.warc_files(pages), "page_id")
    assert [(got[i]["payload_bytes"], got[i]["payload_digest"]) for i in range(5)] == [(len((x or "").encode()), warc.digest((x or "").encode())) for x in TEXTS]

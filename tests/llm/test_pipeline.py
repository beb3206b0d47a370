import sys
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sedimenta.llm import bpe, crf_toxicity, lang_bloom, mixing, prefix_join, stages
from sedimenta.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_against_single_steps(spark):
    """Each stage's decisions, made again row by row from the operators' tables."""
    docs = table(spark, SF, "documents")
    kept = {r["doc_id"]: r for r in docs.collect()}
    labels = table(spark, SF, "labels", "doc_id", "toxic")
    model = crf_toxicity.learn(docs, labels)
    kept = {i: r for i, r in kept.items() if model.of(r["text"])[0] < 0.5}
    frame = lambda: spark.createDataFrame(list(kept.values()), docs.schema)
    filters = lang_bloom.learn(frame())
    lang, score = filters.predict([r["text"] for r in kept.values()])
    kept = {i: r for (i, r), x, y in zip(kept.items(), lang, score, strict=True) if x != "und" and y > 0.25}
    own = {r["doc_id"] for r in prefix_join.join(frame()).collect() if r["doc_id"] == r["component_id"]}
    kept = {i: r for i, r in kept.items() if i in own}
    copies = {r["doc_id"]: round(r["taken"] / r["size"]) for r in mixing.mix_documents(frame()).collect() if r["size"]}
    enc, _ = bpe.tiktoken_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter({(i, len(enc.encode_ordinary(kept[i]["text"]))): n for i, n in copies.items() if n})
    got = corpus_pipeline.run(spark, SF)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {i: enc.encode_ordinary(kept[i]["text"]) for i, _ in want}


def test_stages_keep_columns(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long")).withColumn("row_number", F.lit(1))
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id long, toxic int")
    for out in (stages.without_toxic(docs, labels), stages.of_a_language(docs), stages.one_of_each_group(docs), stages.mixed(docs)):
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    assert stages.one_of_each_group(docs).where("text = 'a b c d e f g'").count() == 1
    assert stages.one_of_each_group(docs).where("text is null").count() == docs.where("text is null").count()
    empty = docs.where("false")
    for out in (stages.without_toxic(empty, labels), stages.of_a_language(empty), stages.one_of_each_group(empty), stages.mixed(empty)):
        assert out.columns == docs.columns and out.count() == 0


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "ngram_jaccard_join", "mixing", "byte_level_bpe"]
    assert "sedimenta.llm" in sys.modules

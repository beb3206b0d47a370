import hashlib
import struct

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from sedimenta.llm import bpe
from sedimenta.llm.common import table
from sedimenta.llm.elias_fano import library_encoder


OTHER = library_encoder(P.path("byte_bpe_50k.json"))


def expected(text):
    enc, _ = bpe.tiktoken_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    ids = enc.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def check(docs):
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = [(r["doc_id"], *expected(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_texts(odd):
    check(odd)


def test_long_texts(spark):
    check(spark.createDataFrame([(0, "word and more, " * 300_000), (1, "y" * 40_000), (2, "\n" * 100_000)], "doc_id long, text string"))


def test_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_empty(none):
    assert bpe.encode_decode(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_small_table_of_chunks(monkeypatch):
    """Tables that overflow in every batch, and chunks that never enter one, change no id."""
    monkeypatch.setattr(bpe, "TABLE", 2)
    monkeypatch.setattr(bpe, "LONGEST", 3)
    e = bpe.ChunkEncoder(lambda chunks: [x.encode("utf-32-le") for x in chunks])
    for texts in (["a b c", "", "dd ee  f"], ["a b c\n d", " x", "longer words here. now, now."], ["a. b, c.", "", "c. .", "a1. b"], ["a\nb. c.\nd e\n", "\na", "a\n\nb", "x\ty z\nw"]):
        assert [x.decode("utf-32-le") for x in e.encode(texts)] == texts


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(st.sampled_from("ab.,#\n \n '1é\t\u3000X|½\u0301"), max_size=30), max_size=6))
def test_chunks_give_the_library_ids(texts):
    enc, chunks = bpe.tiktoken_encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert chunks.encode(texts) == [bpe.id_bytes(enc.encode_ordinary(x)) for x in texts]
    assert OTHER.encode(texts) == chunks.encode(texts)

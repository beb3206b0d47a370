import json
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sedimenta.llm import elias_fano as ef
from sedimenta.llm.common import read_file, scratch, table
from tokenizers import Tokenizer

FILE = P.path("byte_bpe_50k.json")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_values_and_select(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    e = ef.EliasFano.from_bytes(ef.EliasFano.build(values).to_bytes())
    assert e.values().tolist() == values.tolist()
    assert [e.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_space():
    values = np.cumsum(np.full(100_000, 550))
    assert len(ef.EliasFano.build(values).to_bytes()) * 8 / 100_000 < 2.2 + np.log2(550)


def expected(docs):
    t = Tokenizer.from_file(FILE)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for r in rows:
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        out.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def check(docs, **kw):
    folder = scratch(docs.sparkSession, "test")
    ef.write_tokens(docs, FILE, folder, **kw)
    got = sorted(map(tuple, ef.read_tokens(docs.sparkSession, folder).collect()), key=lambda r: r[1])
    assert got == expected(docs)
    return json.loads(read_file(folder, "manifest.json"))["files"]


def test_odd_texts(odd):
    assert len(check(odd, file_ids=50)) > 2


def test_special_tokens_and_long_texts(spark):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c", "x\n<|endoftext|>\ny <|endoftext|><|endoftext|> z", "<|endoftext|", "word and more " * 300_000, "y" * 40_000]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_empty(none):
    assert check(none) == []


def test_damage():
    data = bytearray(ef.pack([1, None], [b"\1\0\0\0", b""], 2))
    names, bounds, ids = ef.unpack(bytes(data))
    assert names == [1, None] and bounds.values().tolist() == [0, 1, 1] and ids.tolist() == [1]
    data[20] ^= 1
    with pytest.raises(ValueError):
        ef.unpack(bytes(data))

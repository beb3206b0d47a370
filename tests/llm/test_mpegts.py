import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sedimenta.llm import mpegts
from sedimenta.llm.common import table


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 40_000), st.integers(0, 255))
def test_round_trip(n, seed):
    payload = bytes((i * 31 + seed) % 251 for i in range(n))
    d = mpegts.demux(mpegts.mux(payload))
    units = -(-n // mpegts.UNIT)
    assert d["payload"] == payload and d["times"] == [k * mpegts.TICKS for k in range(units)] and len(d["points"]) == units


def test_long_payload_repeats_tables():
    media = mpegts.mux(b"ab" * 200_000)
    assert mpegts.demux(media)["payload"] == b"ab" * 200_000
    assert sum(media[i + 1] & 31 == 0 and media[i + 2] == 0 for i in range(0, len(media), 188)) == 2


def test_damage():
    media = bytearray(mpegts.mux(bytes(5000)))
    for bad in (bytes(media[:-188]), bytes(media[:100]), bytes(media[: 188 * 4] + media[188 * 5 :]), bytes(media[188:])):
        with pytest.raises(ValueError):
            mpegts.demux(bad)


def check(docs):
    got = mpegts.media_features(docs).collect()
    assert len(got) == docs.count()
    want = {}
    for r in docs.select("doc_id", "text").collect():
        x = (r["text"] or "").encode()
        y = x + b" " * (-len(x) % 192 or (0 if x else 192))
        want.setdefault(r["doc_id"], set()).add((len(x), len(y), hashlib.sha256(y).hexdigest(), zlib.crc32(y[-16:])))
    seen = {}
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        assert r["media_bytes"] % 188 == 0
        assert seen.setdefault((r["payload_sha256"]), r["media_sha256"]) == r["media_sha256"]


def test_odd_texts(odd):
    check(odd)


def test_documents(spark, sf):
    check(table(spark, sf, "documents"))


def test_empty(none):
    assert mpegts.media_features(none).count() == 0

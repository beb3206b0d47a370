import gzip
import json

import pytest
from sedimenta.llm import warc
from sedimenta.llm.common import read_file, scratch, table


def expected(rows, least=0):
    by = {}
    for r in rows:
        x = (r["html"] or "").encode()
        by.setdefault(x, []).append(r["page_id"])
    out = []
    for r in rows:
        x = (r["html"] or "").encode()
        owner = max((i for i in by[x] if i is not None), default=None) if len(x) >= least else r["page_id"]
        other = owner is not None and owner != r["page_id"]
        out.append((r["page_id"], len(x), warc.digest(x), "revisit" if other else "response", owner if other else None))
    return sorted(out, key=str)


def check(pages, **kw):
    folder = scratch(pages.sparkSession, "test")
    files = warc.write_warc(pages, folder, **kw)
    got = sorted(map(tuple, warc.read_warc(pages.sparkSession, folder).collect()), key=str)
    assert got == expected(pages.collect(), kw.get("min_bytes", 0))
    return folder, files


def test_pages(spark, sf):
    check(table(spark, sf, "pages"))


def odd_pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", "<p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (4, "v", "<p>"), (None, "u", "<p>"), (None, None, "only null"), (7, "é", "\r\n\r\n" * 3), (8, "z", "x" * 200_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html as digest", "1 as refers_to")


def test_odd_pages(spark):
    check(odd_pages(spark))
    check(odd_pages(spark), min_bytes=1)
    check(odd_pages(spark).where("false"))


def test_same_bytes_again_and_rolling(spark, sf):
    pages = table(spark, sf, "pages")
    a, files = check(pages, file_bytes=8_000)
    b, again = check(pages, file_bytes=8_000)
    assert files == again and len(files) > 4
    assert all(read_file(a, f["file"]) == read_file(b, f["file"]) for f in files)
    assert gzip.decompress(read_file(a, files[0]["file"])).count(b"WARC/1.1\r\n") == files[0]["records"]
    assert json.loads(read_file(a, "manifest.json"))["files"] == files


def test_damage():
    x = warc.record(1, "u", b"hello", None)
    assert warc.parse(x)["payload_bytes"] == 5
    with pytest.raises(ValueError):
        warc.parse(x.replace(b"hello", b"hallo"))
    with pytest.raises(ValueError):
        list(warc.members(warc.gzip_member(x)[:-3]))

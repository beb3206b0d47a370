import re

from sedimenta.llm import license_scan as ls
from sedimenta.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(docs, index=None):
    rows = ls.scan(docs, index).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(brute(r["text"]))
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in texts[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))
    return {r["doc_id"]: r for r in rows}


def test_documents(spark):
    rows = check(table(spark, "/root/testdata/sf0.01", "documents"))
    assert sum(r["n_base"] for r in rows.values()) > 10


def test_odd(odd, none):
    check(odd)
    assert ls.scan(none).count() == 0


def test_licences(spark):
    texts = [
        "CC BY cc by-nc 4.0, the MIT License; mit\nlicense", "Licensed under the Apache License, Version 2.0.", "GNU General Public LicenseX gnu general public license", "cc, by. cc\x00by ccby cc é by",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files (the", "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "under the terms of the GNU Lesser General Public License", "the apache license apache license", "license mit apache gnu cc by", "by cc by", "Ünder thé mit license",
    ]
    rows = check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ls.Index(10_000, {b"the": 9000, b"of": 8000, b"license": 100}))
    assert [rows[i]["labels"] for i in range(9)] == ["cc-by,cc-by-nc,mit,mit-notice", "apache,apache-2.0", "gpl", "cc-by", "mit-text", "bsd-text", "lgpl", "apache", "cc-by"]
    assert rows[4]["base_labels"] == "" and 0.6 <= rows[4]["score"] < 1


def notices(text):
    """Labels of notices by trying every template at every place."""
    words = WORD.findall(text.lower())
    labels = set()
    for label, notice, keys in ls.NOTICES:
        t = notice.split()
        for start in range(1 - len(t), len(words)):
            here = [words[i] if i >= 0 else None for i in range(start, min(start + len(t), len(words)))]
            inside = [k.split() for k in keys]
            if sum(a == b for a, b in zip(here, t, strict=False)) >= ls.COVERAGE * len(t) and all(any(here[i : i + len(k)] == k for i in range(len(here))) for k in inside):
                labels.add(label)
    return labels


def test_no_notice_crowds_out_another(spark):
    """A text with all notices has many more words in the index than any one notice."""
    all_notices = " filler words here ".join(x for _, x, _ in ls.NOTICES)
    pair = " and so on ".join(x for label, x, _ in ls.NOTICES if label in ("mit-text", "bsd-text", "cc-by-nc", "mit-notice"))
    # Of the words that the pair's long notices share with no other, none stands in a document; those of the short ones stand in some.
    df = {w.encode(): 200 for w in "licensed under cc by nc released the mit license".split()}
    rows = check(spark.createDataFrame([(0, all_notices), (1, pair), (2, all_notices[::-1])], "doc_id long, text string"), ls.Index(10_000, df))
    for i, text in enumerate((all_notices, pair)):
        assert set(rows[i]["labels"].split(",")) == notices(text) | set(rows[i]["base_labels"].split(","))
    assert {label for label, _, _ in ls.NOTICES} <= set(rows[0]["labels"].split(","))
    assert {"mit-text", "bsd-text", "cc-by-nc", "mit-notice"} <= set(rows[1]["labels"].split(","))

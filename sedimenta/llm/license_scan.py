"""License scans by a positional rare-token index.

The index holds, for the rare words of the licence templates, their places
(template, position). Document frequencies over the whole corpus give the IDF:
rare are words in at most a share COMMON of the documents, and in any case a
template's ANCHORS rarest. All of a file's words in the index are looked up, so
that no notice crowds out another; each of their places less a posting's
position proposes an alignment of that template; alignments with enough words in
step are verified: mandatory key phrases must stand in them word for word, and
the share of template words in place must reach a bound.

A base phrase is a template whose only key phrase is itself; its rarest word is
in the index, so that every place where it stands is found.

Defined results: a null or empty text has no words, no places and no labels, and
score 0; ties in rarity go to the word that comes first in the template;
repeated rows and null ids stay; further columns are neither read nor returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases with their labels, then licence notices in common use (label, words, mandatory key phrases).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("gpl-notice", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl-program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"]),
    ("mit-notice", "released under the mit license", ["the mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("isc-text", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["distribute this software for any purpose"]),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
]

COMMON, ANCHORS = 0.05, 4
#: How many words of a notice must be in step; the share of its words in place that it needs.
IN_STEP, COVERAGE = 2, 0.6

#: Bytes -> words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in lower case: all other bytes become spaces.
WORD_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


TEMPLATES: list[tuple[str, list[bytes], list[list[bytes]], bool]] = [(label, phrase.encode().split(), [phrase.encode().split()], True) for phrase, label in BASE.items()]
TEMPLATES += [(label, text.encode().split(), [k.encode().split() for k in keys], False) for label, text, keys in NOTICES]
VOCABULARY = frozenset(w for _, words, _, _ in TEMPLATES for w in words)


def document_frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """Rows of docs, and in how many each template word stands: counted in all rows, added up in each task; a row a template word comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[bytes, int] = {}
        rows = 0
        for b in batches:
            rows += b.num_rows
            for text in b.column("text").to_pylist():
                for w in VOCABULARY.intersection(words_of(text)):
                    df[w] = df.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *df], pa.binary()), "n": pa.array([rows, *df.values()], pa.int64())})

    counts = {bytes(r["word"]): r["n"] for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts.pop(b"", 0), counts


class Index:
    """Postings of rare words, and the scan of a file."""

    def __init__(self, rows: int, df: dict[bytes, int]):
        self.idf = {w: math.log((rows + 1) / (df.get(w, 0) + 1)) for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _, base) in enumerate(TEMPLATES):
            rarest = sorted(dict.fromkeys(words), key=lambda w: (-self.idf[w], words.index(w)))
            for w in rarest[:1] if base else [w for i, w in enumerate(rarest) if i < ANCHORS or df.get(w, 0) <= COMMON * rows]:
                self.postings.setdefault(w, []).extend((t, i) for i, x in enumerate(words) if x == w)
        self.anchors = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> dict:
        """n_base, first and last place, base labels, all labels, score of a file's words."""
        found = self.anchors.intersection(words)
        steps: dict[tuple[int, int], int] = {}
        if found:
            for at, w in enumerate(words):
                if w in found:
                    for t, i in self.postings[w]:
                        steps[t, at - i] = steps.get((t, at - i), 0) + 1
        places, base, more, score = [], set(), set(), 0.0
        for (t, start), n in steps.items():
            label, template, keys, is_base = TEMPLATES[t]
            a, b = max(0, start), start + len(template)
            here = words[a:b]
            if is_base:
                if start >= 0 and here == template:
                    places.append(start)
                    base.add(label)
                    score = 1.0
                continue
            if n < min(IN_STEP, len(template)):
                continue
            cover = sum(x == y for x, y in zip(here, template[a - start :], strict=False)) / len(template)
            if cover >= COVERAGE and all(any(here[i : i + len(k)] == k for i in range(len(here) - len(k) + 1)) for k in keys):
                more.add(label)
                score = max(score, cover)
        return {
            "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | more)), "score": score,
        }


ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """A row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    index = index or Index(*document_frequencies(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                rows.append({"doc_id": doc_id, "n_words": len(words), **index.scan(words)})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")

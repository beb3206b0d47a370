"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of the letter trigrams that are typical of it.
The filters are bit-sliced: slot h of the table is a mask with a bit for each
language, so that the AND of a trigram's few slots names all languages that
contain it. Of a text, the bits are counted for each language; a filter's false
positive rate, known from its fill, is taken out: (hits - n * f) / (1 - f). The
largest corrected count decides.

A share alone is no evidence: some language always leads. The leader's corrected
count must exceed NOISE standard deviations of the filter's false hits, and a
least share of the text's trigrams, less SLACK standard deviations, so that short
texts need less of it. Sampled texts give that share: QUARTER of the way from
what texts of other languages reach to what the language's own reach.

A trigram is typical of a language if it stands in MIN_DOCS sampled texts of it,
and in a share of them that is no less than RATIO of its share in any language.

The sample: PER_LANGUAGE labelled rows of each language that aren't held out,
by the order of a hash of doc_id; null texts among them teach nothing. Everything
else sees whole texts.

Defined results: a null text or one without a letter is ``und`` with score 0; a
text without evidence keeps the name of the nearest language, with score 0;
ties go to the language that comes first; if nothing could be learned, all is
``und``; repeated rows and null ids stay; further columns are neither read nor
returned.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize

PER_LANGUAGE = 800
MIN_DOCS, RATIO = 2, 0.25
SLOT_BITS, HASHES = 18, 2
#: Languages at most: so many rows of counts are broadcast.
LANGUAGES = 10_000
NOISE, SLACK, QUARTER = 3.0, 1.0, 0.25
#: Code points that are worked on at a time; longer texts go in pieces that see the characters beside them.
PIECE = 1 << 20
UND = "und"
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str, left: str = "\n", right: str = "\n") -> np.ndarray:
    """64-bit hashes of the trigrams of a text in lower case with a letter in the middle; all other characters count as one and the same border.

    left and right: the characters beside it, where it is a piece of a longer text.
    """
    c = np.frombuffer((left.lower()[-1] + text.lower() + right.lower()[0]).encode("utf-32-le", "replace"), "<u4")
    c = (c * letters()[c]).astype(np.uint64)
    mid = np.flatnonzero(c[1:-1])
    h = c[mid] << np.uint64(42) | c[mid + 1] << np.uint64(21) | c[mid + 2]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def pieces(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text of any length, by pieces."""
    for at in range(0, len(text), PIECE):
        end = at + PIECE
        yield grams(text[at:end], text[at - 1] if at else "\n", text[end] if end < len(text) else "\n")


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return (h >> np.uint64(k * 21) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


class Filters:
    """Bit-sliced filters: masks[word, slot] with 64 languages in each word."""

    def __init__(self, languages: list[str], typical: list[np.ndarray]):
        self.languages = languages
        #: The least share of a text's trigrams that must stand in a language's filter; learned from texts.
        self.least = np.zeros(len(languages))
        self.masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
        for i, g in enumerate(typical):
            for k in range(HASHES):
                self.masks[i // 64, np.unique(slots(g, k))] |= np.uint64(1) << np.uint64(i % 64)
        fill = [float((self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false_rate = np.minimum(np.array(fill, float) ** HASHES, 0.999)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of each text, and for each text and language the corrected count of those in its filter."""
        n, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owners: list[int] = []

        def settle() -> None:
            sizes = np.array([len(x) for x in held])
            h = np.concatenate(held)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for w, masks in enumerate(self.masks):
                m = masks[slots(h, 0)]
                for k in range(1, HASHES):
                    m &= masks[slots(h, k)]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    np.add.at(hits[:, i], owners, np.add.reduceat((m >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64), starts))
            np.add.at(n, owners, sizes)
            held.clear()
            owners.clear()

        size = 0
        for i, text in enumerate(texts):
            for g in pieces(text):
                if len(g):
                    held.append(g)
                    owners.append(i)
                    size += len(g)
                if size >= PIECE:
                    settle()
                    size = 0
        if held:
            settle()
        return n, np.maximum((hits - n[:, None] * self.false_rate) / (1 - self.false_rate), 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the decided language's share of all corrected counts, and 0 without evidence."""
        n, c = self.counts([x or "" for x in texts])
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts))
        best, most, total = c.argmax(axis=1), c.max(axis=1), c.sum(axis=1)
        score = np.where(total > 0, most / np.maximum(total, 1e-9), 0.0)
        return [self.languages[k] if m else UND for k, m in zip(best, n, strict=True)], np.where(self.evident(n, best, most), score, 0.0)

    def evident(self, n: np.ndarray, best: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether texts of n trigrams with most of them in the filter of language best are of that language, by more than noise."""
        f, least = self.false_rate[best], self.least[best]
        return (most > NOISE * np.sqrt(n * f / (1 - f))) & (most >= n * least - SLACK * np.sqrt(n * least * (1 - least)))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from docs(doc_id, text, lang): a bounded sample of rows that aren't held out."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    # The choice needs no text. A hash bound thins each language by its count before rows are ranked, so that no task ranks a whole language.
    ids = known.select("doc_id", "lang", F.xxhash64(F.lit(1), "doc_id").alias("h"))
    counts = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"{len(counts)} languages; filters are for {LANGUAGES} at most")
    counts = docs.sparkSession.createDataFrame(counts, "lang string, rows long")
    near = ids.join(F.broadcast(counts), "lang").where(F.pmod("h", F.lit(1 << 30)) < (1 << 30) * (per_language + 5 * per_language**0.5) / F.col("rows"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("doc_id", "lang")
    chosen = materialize(chosen, "languages")
    # A row a language.
    known = known.where("text is not null")
    texts = {r["lang"]: r["n"] for r in known.join(chosen, ["doc_id", "lang"], "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                g = np.unique(np.concatenate([np.zeros(0, np.uint64), *pieces(text)])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g, pa.int64())})

    grammed = known.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(distinct, "lang string, gram long")
    # At most the trigrams of the sample's texts that stand in MIN_DOCS of a language.
    counted = grammed.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= (MIN_DOCS if max(texts.values(), default=0) >= MIN_DOCS else 1)).toArrow()
    names = sorted(texts)
    langs, found, n = (np.array(counted[c].to_pylist(), object if c == "lang" else np.int64) for c in ("lang", "gram", "n"))
    every = np.unique(found)
    share = np.zeros((len(names), len(every)))
    for i, name in enumerate(names):
        own = langs == name
        share[i, np.searchsorted(every, found[own])] = n[own] / texts[name]
    most = share.max(axis=0, initial=0)
    filters = Filters(names, [every[(s > 0) & (s >= RATIO * most)].astype(np.uint64) for s in share])

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column("lang").to_pylist()
            n, c = filters.counts(b.column("text").to_pylist())
            part, at, rows = c / np.maximum(n, 1)[:, None], np.array([names.index(x) for x in lang], np.int64), np.arange(len(lang))
            own = part[rows, at]
            part[rows, at] = 0.0
            yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "own": pa.array(own, pa.float64()), "other": pa.array(part.max(axis=1), pa.float64())}).filter(pa.array(n > 0))

    shares = known.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", "text").mapInArrow(reached, "lang string, own double, other double")
    # A row a language: what half of its texts reach in its own filter, and in the best of the others.
    medians = {r["lang"]: r for r in shares.groupBy("lang").agg(F.percentile_approx("own", 0.5).alias("own"), F.percentile_approx("other", 0.5).alias("other")).collect()}
    foreign = max((r["other"] for r in medians.values()), default=0.0)
    filters.least = np.array([foreign + QUARTER * max(medians[x]["own"] - foreign, 0.0) if x in medians else 0.0 for x in names])
    return filters


def accepted_udf(filters: Filters):
    """A column function of texts: whether the text is of some language. Those without a letter or without evidence are not, nor those whose corrected counts are an even split."""
    least = 1.0 / max(2, len(filters.languages))

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        lang, score = filters.predict(texts.to_pylist())
        return pa.array([x != UND and bool(y > least) for x, y in zip(lang, score, strict=True)], pa.bool_())

    return accepted


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs(doc_id, text, lang)."""
    filters = filters or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = filters.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


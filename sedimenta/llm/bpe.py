"""Byte-level BPE encoding and decoding with a local rank file.

A text is cut before every single space or line feed that stands between two
characters that aren't white space. No match of the pre-splitting pattern
crosses such a place and no look-ahead sees past it, so that the ids of the
chunks, one after the other, are the ids of the text; between letters and a
tail of other characters at a chunk's end a match ends, too. Words repeat, so a bounded table of chunk
ids spares most calls of the library, and no call gets a very long text unless
it has no such place.

Very long texts are cut at all safe places, so that only their ids are held whole.

Defined results: a null text counts as empty; an empty text has 0 ids and
decodes to no bytes; repeated rows give repeated rows; a null id stays null;
further columns of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: White space but the space and the line feed: texts with it are cut by the general rule.
OTHER_SPACE = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"]
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Entries of a table of chunks, and the longest chunk that stays in it: about 20 MB in a task (unless a caller keeps its encoder).
TABLE, LONGEST = 80_000, 48
#: Characters of a chunk's tail that is encoded on its own, and tails that are remembered.
LONG_TAIL, TAILS = 4, 10_000


def cut(text: str) -> list[str]:
    """The chunks of a text: the first as it is, each other either behind a space, which is left out, or with a line feed of its own before it."""
    parts = text.replace("\n", " \n").split(" ")
    if "" in parts or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER_SPACE):
        return SAFE.split(text)
    return parts


def stem_of(chunk: str) -> str:
    """The letters of a chunk of letters (behind a line feed or not) and up to LONG_TAIL characters that are no letters, digits or white space; else the empty text."""
    at = len(chunk)
    while at and not chunk[at - 1].isalnum() and not chunk[at - 1].isspace():
        at -= 1
    stem = chunk[:at]
    return stem if 0 < len(chunk) - at <= LONG_TAIL and (stem[1:] if stem[:1] == "\n" else stem).isalpha() else ""


class Chunks:
    """ids of chunks that stand behind ``lead``: two generations of a table, the older of which is dropped when the younger is half full."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], lead: str, table: int):
        self.encode_all, self.lead, self.half = encode_all, lead, table // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, wanted: set[str]) -> dict[str, bytes]:
        """A table that holds all wanted chunks."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = wanted.difference(young)
        if not missing:
            return young
        known = missing & old.keys()
        young.update((x, old[x]) for x in known)
        missing -= known
        tailed = {x: stem for x in missing if not x.isalpha() and (stem := stem_of(x))}
        new = list(missing.difference(tailed) | set(tailed.values()).difference(young))
        self.long = [x for names in (new, tailed) for x in names if len(x) > LONGEST]
        young.update(zip(new, self.encode_all([x if x[:1] == "\n" else self.lead + x for x in new]), strict=True))
        if len(self.tails) > TAILS:
            self.tails.clear()
        tails = list({x[len(stem) :] for x, stem in tailed.items()}.difference(self.tails))
        self.tails.update(zip(tails, self.encode_all(tails), strict=True))
        young.update((x, young[stem] + self.tails[x[len(stem) :]]) for x, stem in tailed.items())
        return young

    def forget(self) -> None:
        """Drop the long chunks that were new at the last call of of()."""
        for x in self.long:
            self.young.pop(x, None)
        self.long = []


class ChunkEncoder:
    """ids of texts as little-endian bytes, by ``encode_all(chunks) -> list of id bytes``, called for chunks that aren't known."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]], table: int = TABLE):
        self.first, self.rest = Chunks(encode_all, "", table), Chunks(encode_all, " ", table)

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [cut(x) for x in texts]
        heads, tails = {p[0] for p in parts}, set().union(*[p[1:] for p in parts])
        first, rest = self.first.of(heads), self.rest.of(tails)
        get = rest.__getitem__
        out = [first[p[0]] + b"".join(map(get, p[1:])) for p in parts]
        self.first.forget()
        self.rest.forget()
        return out


PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    n = len(ids)
    return PACK[n](*ids) if n < len(PACK) else struct.pack(f"<{n}I", *ids)


_LIBRARY: dict[tuple, object] = {}


def tiktoken_encoder(rank_file: str, pattern: str):
    """The library's encoding, of which a Python worker keeps one (some 15 MB), and a new chunk encoder over it."""
    if (rank_file, pattern) not in _LIBRARY:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LIBRARY.clear()
        _LIBRARY[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    enc = _LIBRARY[rank_file, pattern]
    return enc, ChunkEncoder(lambda chunks: [id_bytes(enc.encode_ordinary(x)) for x in chunks])


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with keep_ids also ids (array of int) and decoded (binary)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, chunks = tiktoken_encoder(rank_file, pattern)
        for b in batches:
            ids = chunks.encode([x or "" for x in b.column("text").to_pylist()])
            back = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in ids]
            columns = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            }
            if keep_ids:
                columns |= {"ids": pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), "decoded": pa.array(back, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

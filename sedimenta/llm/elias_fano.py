"""Token-id files with Elias-Fano document boundaries.

A file holds the ids of a run of documents, one after the other, and the
boundaries as a monotone sequence: the low bits of each packed, the high bits
in unary, and the place of every 256th one for select. That takes about
2 + log2(ids / documents) bits for a document instead of 64.

Files are written in ascending doc_id order (null first, equal ids by text):
range-partitioned, sorted within a task, and rolled at a bound of ids, under
temporary names; a manifest of the files that count commits the set.

Strings of special tokens in a text are encoded as the library does by default, as
those tokens. A very long text is encoded in chunks; its ids are held whole, and
a file may exceed its bound by one document.

Defined results: a null text counts as empty, and an empty document holds the
end id alone; an empty table gives an empty manifest and no rows; repeated rows
are written each; further columns are neither read nor returned.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ChunkEncoder, id_bytes
from .common import attempt_id, read_file, scratch, write_file

MAGIC = b"EFTOKEN1"
#: Every how manieth one has its place stored.
SAMPLE = 256
#: Ids of a file at which it is rolled: 16 MB of 32-bit ids held by a task.
FILE_IDS = 4 << 20


class EliasFano:
    """A non-decreasing sequence of n whole numbers of at most ``last``."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            of = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(of.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it and the bytes that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        low = 0
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            low |= (int(self.low[at // 8]) >> at % 8 & 1) << k
        return (place - i) << self.low_bits | low

    def values(self) -> np.ndarray:
        """All values, as 64-bit numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            of = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            out |= of.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        size = struct.calcsize("<QBIII")
        n, bits, a, b, c = struct.unpack_from("<QBIII", data)
        of = lambda start, count, kind="u1": np.frombuffer(data, kind, count, start)
        return cls(n, bits, of(size, a), of(size + a, b), of(size + a + b, c, "<u4"))


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file: magic, sizes, boundaries, doc_ids (with a mask of nulls), ids of ``width`` bytes; crc32 of all at the end."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    bounds = EliasFano.build(np.concatenate([[0], np.cumsum(lengths)])).to_bytes()
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    body = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}").tobytes()
    data = MAGIC + struct.pack("<QQQB", len(doc_ids), int(lengths.sum()), len(bounds), width) + bounds + known.tobytes() + names + body
    return data + struct.pack("<I", zlib.crc32(data))


def unpack(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """doc_ids, boundaries (one more than documents) and ids of a file; a damaged one raises ValueError."""
    if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("not a whole token file")
    n, total, bounds, width = struct.unpack_from("<QQQB", data, 8)
    at = 8 + struct.calcsize("<QQQB")
    ef, at = EliasFano.from_bytes(data[at : at + bounds]), at + bounds
    known, at = np.frombuffer(data, "u1", n, at), at + n
    names, at = np.frombuffer(data, "<i8", n, at), at + 8 * n
    return [int(x) if k else None for x, k in zip(names, known, strict=True)], ef, np.frombuffer(data, f"<u{width}", total, at)


#: The letter of byte-level alphabets that stands for a space (fixed value).
SPACE = "\u0120"


class Alphabet(dict):
    """Code point of a letter -> how the library's pre-tokenizer writes its bytes; for str.translate()."""

    def __init__(self, t):
        self.write = t.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        self[code] = "".join(x for x, _ in self.write(chr(code)))
        return self[code]


def encode_chunks(t, alphabet: Alphabet, chunks: list[str]) -> list[bytes]:
    """Ids of each chunk. A space and letters are one word to the library, letters behind a line feed another; its model is asked for such a word directly."""
    tokenize, out, rest = t.model.tokenize, [], []
    feed = id_bytes(t.encode("\n", add_special_tokens=False).ids)
    for x in chunks:
        w = x[1:]
        if x[:1] in (" ", "\n") and w.isalpha():
            w = w if w.isascii() else w.translate(alphabet)
            out.append(id_bytes([y.id for y in tokenize(SPACE + w)]) if x[0] == " " else feed + id_bytes([y.id for y in tokenize(w)]))
        else:
            out.append(b"")
            rest.append(x)
    if rest:
        others = iter([id_bytes(e.ids) for e in t.encode_batch_fast(rest, add_special_tokens=False)])
        out = [x if x else next(others) for x in out]
    return out


#: Entries of the table of chunks that a Python worker keeps from task to task: with a batch's own chunks some 60 MB.
TABLE = 240_000
_ENCODERS: dict[str, ChunkEncoder] = {}


def library_encoder(tokenizer_file: str) -> ChunkEncoder:
    """The chunk encoder over the library's tokenizer as its file defines it, of which a Python worker keeps one: strings of special tokens in a text become their ids."""
    if tokenizer_file not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        alphabet = Alphabet(t)
        _ENCODERS.clear()
        _ENCODERS[tokenizer_file] = ChunkEncoder(lambda chunks: encode_chunks(t, alphabet, chunks), TABLE)
    return _ENCODERS[tokenizer_file]


def write_tokens(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int = 0, width: int = 2, file_ids: int = FILE_IDS) -> list[dict]:
    """Write the files of docs(doc_id, text) to a shared folder and commit manifest.json; returns its entries in order.

    width: bytes of a stored id; 2 holds vocabularies of up to 65,536.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = attempt_id()
        encoder = library_encoder(tokenizer_file)
        names: list = []
        ids: list[bytes] = []
        held = seq = 0

        def roll() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{seq:05d}.eft"
            write_file(folder, name, pack(names, ids, width), attempt)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "docs": pa.array([len(names)], pa.int64()), "ids": pa.array([held], pa.int64())})

        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), encoder.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                names.append(doc_id)
                ids.append(x + end)
                held += len(x) // 4 + 1
                if held >= file_ids:
                    yield roll()
                    names, ids, held, seq = [], [], 0, seq + 1
        if names:
            yield roll()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    # One row a file, some 16 MB of ids each: the manifest of a data set, not its documents.
    files = sorted((r.asDict() for r in rows.mapInArrow(run, "part int, seq int, file string, docs long, ids long").collect()), key=lambda r: (r["part"], r["seq"]))
    start = 0
    for r in files:
        r["start"] = start
        start += r["ids"]
    write_file(folder, "manifest.json", json.dumps({"width": width, "end_id": end_id, "files": files}).encode(), "commit")
    return files


def read_tokens(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (with keep_ids also ids) of all documents, from the committed files."""
    files = json.loads(read_file(folder, "manifest.json"))["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                names, ef, ids = unpack(read_file(folder, name))
                bounds = ef.values()
                wide = ids.astype("<u4")
                for at in range(0, len(names), 1000):
                    k = range(at, min(at + 1000, len(names)))
                    columns = {
                        "doc_id": pa.array([names[i] for i in k], pa.int64()),
                        "start": pa.array(bounds[at : k.stop] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds[at : k.stop + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(wide[bounds[i] : bounds[i + 1]]) for i in k], pa.int64()),
                    }
                    if keep_ids:
                        columns["ids"] = pa.array([wide[bounds[i] : bounds[i + 1]].astype("i4") for i in k], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    listed = spark.createDataFrame([(r["file"], r["start"]) for r in files], "file string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 0) -> DataFrame:
    """Write docs to new files in the shared folder, and read them back."""
    folder = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_file, folder, end_id)
    return read_tokens(docs.sparkSession, folder)

"""Token ids as binary files with Elias-Fano encoded document boundaries.

A file holds the concatenated ids of documents in ascending doc_id order (2 or 4 bytes an id, little-endian), the
boundaries of the documents and their doc_ids. Both of these are sorted integers and are stored by Elias and Fano's code: the
low bits of every value are packed, the high bits are a bit vector in which value i sets bit (high + i), so a value takes
about 2 + log2(range / values) bits. The place of every STEP-th set bit is kept (32 bits each) as select structure: an offset is
found by going there and counting bits on, without a table of 64-bit offsets. `TokenFile` gives random access.

Jobs: ids are made in Arrow batches and written to the shared folder; they are put in doc_id order by range partitions of about
FILE_BYTES, whose tasks pack them; Spark's own text writer commits the packed bytes (one row a file, the line feed after it is
beyond the length that the header gives), so a lost executor leaves no half file; Spark's binary reader reads them.
`start` of a document is what the files before hold (one row a file, summed in order) and its offset in its own.

Where a vocabulary drops white space and case, and never merges letters or digits with the punctuation after them (`by_word`, an
error for tokenizers of other stages than `fits_words` knows), a text's ids are those of its ASCII-white-space chunks in turn; a worker remembers the ids of up to KNOWN chunks. Otherwise, as by
default, texts are encoded whole.

Defined results: null and empty texts have the end id only; documents without a doc_id come last; documents that share one are
ordered by a hash of their ids (equal ones as they come, which changes no result); repeated rows are documents of their own;
the vocabulary's control strings are what the tokenizers library makes of them; very long texts are encoded whole (a file holds one
document at least); doc_id is an integer column, others are an error; other columns are ignored, whatever their
names; an empty table gives files without documents.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import drop_written, materialise, owned

END_ID = 1
#: Bytes of ids that a file holds, about.
FILE_BYTES = 16 << 20
#: Chunks (of under 64 bytes) that a worker remembers: some 200 bytes each.
KNOWN = 400_000
#: Every so many set bits have their place kept.
STEP = 256
MAX_VOCAB = 32 << 20

#: Mark, part, piece, documents, those without doc_id, ids, first doc_id, bytes of an id, 0.
_HEADER = "<8sIIQQQqII"
_HEAD = struct.calcsize(_HEADER)
_MAGIC = b"tokenid1"


class EliasFano:
    """Sorted unsigned 64-bit values; `select` gives those at any indexes."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(56, max(0, (top // n).bit_length() - 1)) if n else 0
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, dtype=np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        cut = values.astype("<u8").view(np.uint8).reshape(n, 8)
        low = np.packbits(np.unpackbits(cut, axis=1, bitorder="little")[:, :bits], bitorder="little")
        return cls(n, bits, low, high, at[::STEP].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QIII", self.n, self.low_bits, len(self.high), len(self.places))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The values stored at a place of `data`, and the place after them."""
        n, bits, words, places = struct.unpack_from("<QIII", data, at)
        out, at = [], at + 20
        for kind, size in (("u1", -(-n * bits // 8)), ("<u8", words), ("<u4", places)):
            out.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(n, bits, *out), at

    def select(self, index) -> np.ndarray:
        """The values at the indexes, as unsigned 64-bit numbers."""
        index = np.atleast_1d(np.asarray(index, dtype=np.int64))
        if len(index) and (index.min() < 0 or index.max() >= self.n):
            raise IndexError("no such value")
        one, place = np.uint64(1), self.places[index // STEP].astype(np.int64)
        left, word = index % STEP, place >> 6
        bits = self.high[word] & ~((one << (place & 63).astype(np.uint64)) - one)
        have = np.bitwise_count(bits).astype(np.int64)
        far = np.flatnonzero(have <= left)
        while len(far):  # to the word that holds the bit
            left[far] -= have[far]
            word[far] += 1
            bits[far] = self.high[word[far]]
            have[far] = np.bitwise_count(bits[far])
            far = far[have[far] <= left[far]]
        place = word << 6
        for half in (32, 16, 8, 4, 2, 1):  # to the bit inside of it
            lower = bits & ((one << np.uint64(half)) - one)
            count = np.bitwise_count(lower).astype(np.int64)
            on = count <= left
            left -= np.where(on, count, 0)
            place += np.where(on, half, 0)
            bits = np.where(on, bits >> np.uint64(half), lower)
        high = (place - index).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        first = index * self.low_bits
        padded = np.concatenate([self.low, np.zeros(8, np.uint8)])
        own = padded[(first >> 3)[:, None] + np.arange(8)].copy().view("<u8")[:, 0]
        return high | ((own >> (first & 7).astype(np.uint64)) & ((one << np.uint64(self.low_bits)) - one))


class TokenFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data):
        self.magic, self.part, self.piece, self.n_docs, self.n_null, self.n_ids, self.first, width, _ = struct.unpack_from(_HEADER, data)
        if self.magic != _MAGIC:
            raise ValueError("not a file of token ids")
        view = memoryview(data)
        self.all_ids = np.frombuffer(view, f"<u{width}", self.n_ids, _HEAD)
        self.bounds, at = EliasFano.read(view, _HEAD + self.n_ids * width)
        self.keys, _ = EliasFano.read(view, at)

    def offsets(self, i) -> np.ndarray:
        """First ids of the documents i (of their place in the file); n_docs gives the end."""
        return self.bounds.select(i).astype(np.int64)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offsets([i, i + 1])
        return self.all_ids[a:b]

    def doc_ids(self, i) -> np.ndarray:
        """doc_ids of the documents i, which are to be below n_docs - n_null."""
        return (self.keys.select(i) + np.uint64(self.first & (1 << 64) - 1)).astype(np.int64)

    def find(self, doc_id: int) -> int | None:
        """The first document of a doc_id."""
        a, b = 0, self.n_docs - self.n_null
        while a < b:
            mid = (a + b) // 2
            a, b = (mid + 1, b) if self.doc_ids(mid)[0] < doc_id else (a, mid)
        return a if a < self.n_docs - self.n_null and self.doc_ids(a)[0] == doc_id else None


def pack(part: int, piece: int, doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A file's bytes, of documents in order, those without a doc_id last; `ids` has each one's ids as bytes."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(x) // width for x in ids], dtype=np.int64)]).astype(np.uint64)
    first = int(known[0]) if len(known) else 0
    keys = known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)
    head = struct.pack(_HEADER, _MAGIC, part, piece, len(doc_ids), len(doc_ids) - len(known), int(bounds[-1]), first, width, 0)
    return b"".join([head, *ids, EliasFano.of(bounds).to_bytes(), EliasFano.of(keys).to_bytes()])


# The stages of tokenizers that `by_word` is for.
_NORMAL = ["NFC", "Replace", "Lowercase"]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A letter for each byte, as byte-level vocabularies write them: printable ones as they are, the others from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: b if b in _PLAIN else 256 + b - sum(p < b for p in _PLAIN) for b in range(256)}


def fits_words(vocabulary: str) -> bool:
    """Whether a tokenizer's stages are those of `by_word`: case and white space dropped, letter runs whole, byte-level BPE."""
    found = json.loads(vocabulary)
    normal = [n["type"] for n in (found["normalizer"] or {}).get("normalizers", [])]
    split, *rest = (found["pre_tokenizer"] or {}).get("pretokenizers", [None])
    return (
        normal == _NORMAL and split is not None and split["type"] == "Split" and split["pattern"] == {"Regex": _PIECES} and split["invert"]
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)] and found["model"]["type"] == "BPE"
    )


class _Words(dict):
    """Chunk -> its ids as bytes; made by the tokenizer when first asked for. Of what is known, half of KNOWN stays when
    the other half is full: the chunks asked for last.

    A chunk of letters only is one piece of the tokenizer's, so it goes to its model at once.
    """

    def __init__(self, tokenizer, width: int):
        super().__init__()
        self.tokenizer, self.model, self.old = tokenizer, tokenizer.model, {}
        self.code = "H" if width == 2 else "I"  # little-endian hosts, as Arrow's

    def encode(self, text: bytes) -> bytes:
        return array(self.code, self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def encode_chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            piece = chunk.lower().decode()
        else:
            piece = chunk.decode("utf-8", "replace")
            if piece.isalpha():
                piece = self.tokenizer.normalizer.normalize_str(piece)
            if not piece.isalpha():
                return self.encode(chunk)
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        made = self.old.get(chunk)
        if made is None:
            body = chunk.rstrip(b".,;:!?")
            made = self[body] + self[chunk[len(body) :]] if body != chunk and body[-1:].isalnum() else self.encode_chunk(chunk)
        if len(chunk) < 64:
            self[chunk] = made
        return made

    def ids(self, text: bytes, by_word: bool) -> bytes:
        if not by_word:
            return self.encode(text)
        if len(self) > KNOWN // 2:
            self.old = dict(self)
            self.clear()
        plain = text if b"<|" in text else text.lower()
        return b"".join(map(self.__getitem__, plain.split()))


_ENCODERS: dict[str, _Words] = {}


def encoder(vocabulary: str, width: int) -> _Words:
    """The encoder of a vocabulary's JSON, kept for the worker's life."""
    key = f"{hashlib.md5(vocabulary.encode()).hexdigest()}-{width}"
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.freeze()  # many small tokens are made: the collector need not look through the worker's modules for each few of them
        gc.set_threshold(50_000, 20, 20)
        from tokenizers import Tokenizer

        _ENCODERS[key] = _Words(Tokenizer.from_str(vocabulary), width)
    return _ENCODERS[key]


def read_vocabulary(path: str) -> str:
    """A tokenizer file of the driver, which goes to the executors; an error beyond MAX_VOCAB bytes."""
    with open(path, encoding="utf-8") as f:
        data = f.read(MAX_VOCAB + 1)
    if len(data) > MAX_VOCAB:
        raise ValueError("the vocabulary file is too large to ship")
    return data


def _width(vocabulary: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_str(vocabulary).get_vocab(True).values(), default=0) < 1 << 16 > end_id else 4


def token_ids(docs: DataFrame, vocabulary: str, end_id: int = END_ID, by_word: bool = False) -> DataFrame:
    """doc_id and ids (their bytes, little-endian) of every document, the end id last. `vocabulary`: a tokenizer file's JSON."""
    import pyarrow as pa

    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"doc_id is to be an integer column, not {kind}")
    if by_word and not fits_words(vocabulary):
        raise ValueError("this tokenizer's texts are to be encoded whole")
    width = _width(vocabulary, end_id)
    shared, end = docs.sparkSession.sparkContext.broadcast(vocabulary), np.array([end_id], f"<u{width}").tobytes()

    def run(batches):
        words = encoder(shared.value, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [words.ids(t or b"", by_word) + end for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, by_word: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Write the documents' ids to files in the folder `path`."""
    import pyarrow as pa
    from pyspark import TaskContext

    width = _width(vocabulary, end_id)
    made = materialise(token_ids(docs, vocabulary, end_id, by_word), "token-ids", "zstd")
    total = made.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("row")]
    rows = made.withColumns({"h": F.xxhash64("ids"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches):
        part, piece, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([pack(part, piece, doc_ids, ids, width)], pa.binary())], names=["value"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size and size + len(own) > 2 * file_bytes:
                    yield packed()
                    piece, doc_ids, ids, size = piece + 1, [], [], 0
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own)
        if ids:
            yield packed()

    packed = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    drop_written(made)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit numbers) of all documents in the files."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).where(F.col("length") >= _HEAD)

    def heads(batches):
        for batch in batches:
            found = [struct.unpack(_HEADER, x) for x in batch.column(0).to_pylist()]
            columns = [pa.array([h[i] for h in found], pa.int64()) for i in (1, 2, 5)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "piece", "n_ids"])

    starts = files.select(F.substring("content", 1, _HEAD).alias("head")).mapInArrow(heads, "part long, piece long, n_ids long")
    before = F.sum("n_ids").over(Window.orderBy("part", "piece")) - F.col("n_ids")  # one row a file
    starts = starts.select("part", "piece", before.alias("before"))
    names = ["part", "piece", "doc_id", "at", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                file = TokenFile(batch.column(0)[k].as_buffer())
                for i in range(0, file.n_docs, 4096):
                    index = np.arange(i, min(i + 4096, file.n_docs))
                    at, known = file.offsets(np.append(index, index[-1] + 1)), index[index < file.n_docs - file.n_null]
                    crc = [zlib.crc32(file.all_ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])]
                    keys = pa.concat_arrays([pa.array(file.doc_ids(known)), pa.nulls(len(index) - len(known), pa.int64())])
                    same = [pa.array(np.full(len(index), x, dtype=np.int64)) for x in (file.part, file.piece)]
                    yield pa.RecordBatch.from_arrays([*same, keys, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=names)

    found = files.select("content").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return found.join(starts, ["part", "piece"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def through_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, by_word: bool = False, file_bytes: int = FILE_BYTES) -> DataFrame:
    """What `read_files` finds in files written to the shared folder."""
    path = owned(docs.sparkSession, f"token-files-{uuid.uuid4().hex}")
    write_files(docs, path, vocabulary, end_id, by_word, file_bytes)
    return read_files(docs.sparkSession, path)

"""Operator 6: token-id files with Elias-Fano encoded document boundaries.

A file (``.efid``) holds the ids of documents in ascending doc_id order, one
after another, and three sections behind them::

    ids        n_ids little-endian integers of 2 or 4 bytes
    ends       Elias-Fano: for each document, the ids up to its end
    doc_ids    Elias-Fano: doc_id minus the file's smallest (nulls before)
    footer     <4s B I I Q q Q Q> magic, id width, documents, null doc_ids,
               ids, smallest doc_id, bytes of ends, bytes of doc_ids

Elias-Fano keeps a non-decreasing sequence of n values below u in about
2 + log2(u / n) bits a value: low bits packed, high bits in unary. Its select
directory is one 32-bit rank per 512 bits of the unary part, so ``select``
gets any value without a table of 64-bit offsets.

Writing: documents are range-partitioned and sorted by doc_id; each task
encodes its rows batch by batch and appends to its file, beginning a further
file after ``max_ids`` ids. A file is written under a temporary name and then
renamed, so a retried task replaces it by the same content. Names sort in
doc_id order. The driver keeps one row per file (name and two counts), which
gives the ids before each file. Reading: Spark's ``binaryFile`` source.

Defined cases: a null text is empty; an empty text gives only the end id; a
null doc_id sorts first; repeated doc_ids sort by text and each row gives a
row; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_path

from . import bpe
from .common import pick

MAGIC = b"EFID"
FOOTER = "<4sBIIQqQQ"
RANK_BITS = 512
MAX_IDS = 1 << 24
ROW_BYTES = 1 << 25


class EliasFano:
    """A non-decreasing sequence of integers >= 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(at[-1]) + 1 if n else 1) // RANK_BITS) * RANK_BITS, np.uint8)
        bits[at] = 1
        ones = bits.reshape(-1, RANK_BITS).sum(axis=1)
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), (np.cumsum(ones) - ones).astype("<u4"))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, np.int64)
        out = np.empty(len(i), np.uint64)
        for k in range(0, len(i), 4096):
            q = i[k:k + 4096]
            block = np.searchsorted(self.ranks, q, "right") - 1
            blocks, back = np.unique(block, return_inverse=True)
            bits = np.unpackbits(self.high.reshape(-1, RANK_BITS // 8)[blocks], axis=1, bitorder="little")
            row, col = np.nonzero(bits)
            first = np.searchsorted(row, np.arange(len(blocks)))
            at = blocks[back] * RANK_BITS + col[first[back] + q - self.ranks[block]]
            value = (at - q).astype(np.uint64) << np.uint64(self.low_bits)
            if self.low_bits:
                place = q[:, None] * self.low_bits + np.arange(self.low_bits)
                got = (self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1
                value |= (got.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            out[k:k + 4096] = value
        return out

    def dump(self) -> bytes:
        head = struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.ranks))
        return head + self.ranks.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> "EliasFano":
        n, low_bits, n_low, n_ranks = struct.unpack_from("<IBII", raw)
        at = struct.calcsize("<IBII")
        ranks = np.frombuffer(raw, "<u4", n_ranks, at)
        at += 4 * n_ranks
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, n_low, at), np.frombuffer(raw, np.uint8, -1, at + n_low), ranks)


class _Writer:
    """One file in the making."""

    def __init__(self, fs, folder: str, name: str, width: int):
        self.fs, self.folder, self.name, self.width = fs, folder, name, width
        self.temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.ends, self.docs, self.ids = [], [], 0

    def add(self, ids: np.ndarray, ends: np.ndarray, docs: list) -> None:
        self.out.write(ids.astype("<u2" if self.width == 2 else "<u4").tobytes())
        self.ends.append(ends + self.ids)
        self.docs += docs
        self.ids += len(ids)

    def close(self) -> tuple[str, int, int]:
        known = np.array([d for d in self.docs if d is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        ends = EliasFano.of(np.concatenate(self.ends)).dump()
        docs = EliasFano.of(known.view(np.uint64) - np.int64(least).view(np.uint64)).dump()
        self.out.write(ends + docs + struct.pack(
            FOOTER, MAGIC, self.width, len(self.docs), len(self.docs) - len(known), self.ids, least, len(ends), len(docs)))
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")
        return self.name, len(self.docs), self.ids


def read_file(raw: bytes) -> tuple[list, EliasFano, np.ndarray]:
    """doc_ids, ends and ids of one file."""
    size = struct.calcsize(FOOTER)
    magic, width, n, nulls, n_ids, least, n_ends, n_docs = struct.unpack(FOOTER, raw[-size:])
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    at = n_ids * width
    ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4", n_ids)
    ends = EliasFano.load(raw[at:at + n_ends])
    docs = EliasFano.load(raw[at + n_ends:at + n_ends + n_docs])
    known = (docs.select(np.arange(docs.n)) + np.int64(least).view(np.uint64)).view(np.int64)
    return [None] * nulls + known.tolist(), ends, ids


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, max_ids: int = MAX_IDS) -> list[tuple[str, int, int]]:
    """Write all documents; gives (file name, documents, ids) per file in doc_id order."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 65536 and end_id < 65536 else 4
    rows = pick(docs, doc_id="doc_id bigint", text="text string")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-size // ROW_BYTES), 1 << 20))

    def write(stream):
        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        enc, part, out, n = bpe.encoder(tokenizer), TaskContext.get().partitionId(), None, 0
        fs, place = FileSystem.from_uri(folder)
        fs.create_dir(place)
        done = []
        for batch in stream:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in bpe.batches(batch.column("text")):
                ids, sizes = enc.encode(texts)
                ends = np.cumsum(sizes + 1)
                all_ids = np.insert(ids, np.cumsum(sizes), end_id)
                i = 0
                while i < len(texts):  # whole documents up to max_ids, one at least
                    if out is None:
                        out, n = _Writer(fs, place, f"part-{part:07d}-{n:05d}.efid", width), n + 1
                    base = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, base + max_ids - out.ids, "right")))
                    out.add(all_ids[base:int(ends[j - 1])], ends[i:j] - base, doc_ids[at + i:at + j])
                    i = j
                    if out.ids >= max_ids or i < len(texts):
                        done.append(out.close())
                        out = None
        if out is not None:
            done.append(out.close())
        yield pa.RecordBatch.from_pydict({"name": [d[0] for d in done], "n_docs": [d[1] for d in done], "n_ids": [d[2] for d in done]},
                                         pa.schema([("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    made = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(write, "name string, n_docs bigint, n_ids bigint").collect()
    return sorted(tuple(r) for r in made)


def read_ids(spark: SparkSession, folder: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit integers). ``files`` as ``write_ids`` returns them: a few bytes per file."""
    before, starts = 0, {}
    for name, _, n in files:
        starts[name] = before
        before += n
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    if not files:
        return spark.createDataFrame([], schema)

    def read(stream):
        import pyarrow as pa

        for batch in stream:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                docs, ends, ids = read_file(raw.as_buffer().to_pybytes())
                base = starts[path.as_py().rsplit("/", 1)[-1]]
                for i in range(0, len(docs), 4096):
                    last = ends.select(np.arange(max(i - 1, 0), min(i + 4096, len(docs)))).astype(np.int64)
                    edge = last if i else np.concatenate([[0], last])
                    part = ids[edge[0]:edge[-1]].astype("<u4").tobytes()
                    cut = 4 * (edge - edge[0])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(docs[i:i + 4096], pa.int64()), pa.array(base + edge[:-1]), pa.array(np.diff(edge)),
                        pa.array([part[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.format("binaryFile").load([f"{folder}/{name}" for name, _, _ in files] if len(files) < 1000 else folder) \
        .where(F.col("path").endswith(".efid")).select("path", "content").mapInArrow(read, schema)


def crc32_of(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-ids")
    files = write_ids(docs, folder, tokenizer or bpe.default_path("byte_bpe_50k.json"))
    return read_ids(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

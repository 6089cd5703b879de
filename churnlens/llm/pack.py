"""Operator 8: cost-balanced packing of documents into training sequences.

A sequence of pieces of n_1, n_2, ... tokens costs ``linear * sum(n) +
quadratic * sum(n^2)``: attention stays inside a piece. Each task tokenizes its
rows and packs them in groups of about ``group_tokens`` tokens, so memory is
bounded and no text is shuffled. In a group, documents longer than a sequence
give full pieces first; the rest are taken in descending length, each to the
lowest-cost sequence that has room for it. One that fits nowhere fills the
sequence with most room, and what is left of it is queued by its new length.

A group of t tokens gets t // capacity sequences of the full capacity and, for
the rest, one sequence per binary digit of t % capacity, so that lengths are
the capacity or a power of two and nothing is padded.

Results depend on how the rows are split into tasks; every id lies in one
piece in any case, and a retried task gives the same pieces. sequence_id is
the task's number times 2^32 plus a running number.

Defined cases: a null or empty text is the end id alone; a null doc_id stays
null; repeated rows are packed each; an empty table gives no rows; a text of
any length is cut; further input columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import give_back, pick, trimmed

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 6144
GROUP_TOKENS = 1 << 21
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def assign(sizes: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group."""
    total = sum(sizes)
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1], np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    queue, out, full = [], [], 0
    for d, n in enumerate(sizes):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, full + k, 0))
        room[full:full + whole] = 0
        full += whole
        if n % capacity:
            queue.append((-(n % capacity), d, whole * capacity))
    heapq.heapify(queue)
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        s = int(fits.argmin())
        if fits[s] == np.inf:
            s = int(room.argmax())
            left = n - int(room[s])
            n -= left
            heapq.heappush(queue, (-left, d, start + n))
        out.append((d, start, n, s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, linear: float = LINEAR,
         quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 32-bit integers."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(stream):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = bpe.encoder(tokenizer)
        base = TaskContext.get().partitionId() << 32
        names, ids, sizes, held = [], [], [], 0

        def emit():
            nonlocal base, names, ids, sizes, held
            every, size = np.concatenate(ids), np.concatenate(sizes)
            first = np.cumsum(size) - size
            raw = every.astype("<u4").tobytes()
            pieces = assign(size.tolist(), capacity, linear, quadratic)
            d, start, n, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
            for i in range(0, len(d), 2048):
                k = slice(i, i + 2048)
                at = 4 * (first[d[k]] + start[k])
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[x] for x in d[k]], pa.int64()), pa.array(start[k]), pa.array(n[k]),
                    pa.array([raw[a:b] for a, b in zip(at.tolist(), (at + 4 * n[k]).tolist())], pa.binary()),
                    pa.array(size[d[k]]), pa.array(base + seq[k]), pa.array(offset[k])],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            base += int(seq.max()) + 1
            names, ids, sizes, held = [], [], [], 0
            give_back()

        for batch in stream:
            doc_ids = batch.column("doc_id").to_pylist()
            for at, texts in bpe.batches(batch.column("text")):
                got, n = enc.encode(texts)
                names += doc_ids[at:at + len(texts)]
                ids.append(np.insert(got, np.cumsum(n), end_id))
                sizes.append(n + 1)
                held += len(got) + len(texts)
                if held >= group_tokens:
                    yield from emit()
        if names:
            yield from emit()

    return pick(docs, doc_id="doc_id bigint", text="text string").mapInArrow(trimmed(run), PIECES)


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    pieces = pack(docs, tokenizer or bpe.default_path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""Operator 12: repeated lines, dropped by per-document keep bitmaps.

1. Every line of at least ``LEAST`` code points gives a row (hash, doc_id, line
   number); the hash has 128 bits, so equal hashes are equal keys.
2. Rows are range-partitioned by (hash, doc_id, line number) and sorted by it
   within a task. The first row of a hash is its first occurrence: rows of any
   other document are dropped lines. As the range key has the document too, a
   hash that a third of all rows hold is cut over many tasks. A task cannot see
   whether an earlier one holds the start of its first hash, so rows of that
   hash stay open; each task reports the first document of its first and last
   hash (two rows a task), and open rows are decided by the least of these.
3. Dropped line numbers are brought together by document and packed into a keep
   bitmap, one bit a line, compressed. Texts take no part until the bitmaps are
   joined back to them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower
case. Keys that at least two documents hold lose their lines in all but the
smallest doc_id; that document keeps all of its own, repeats included.

Defined cases: a null or empty text is one empty line; rows of the same doc_id
are one document for this purpose and keep the same lines, whatever their texts
(a bitmap belongs to a doc_id and a text); null doc_ids are one document, after
all others; repeated rows each give a row; an empty table gives no rows; texts
are taken whole; further input columns are ignored or kept as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, written

LEAST = 10
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_ROWS = "doc_id bigint, mark bigint, n int, at int, h1 bigint, h2 bigint"


def _read(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and ``mark``, which tells texts of one doc_id apart."""
    return pick(docs, doc_id="doc_id bigint", text="text string").withColumn("text", F.coalesce("text", F.lit(""))) \
        .withColumn("mark", F.xxhash64("text"))


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def line_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per line whose key has ``least`` code points or more: doc_id, mark, n (lines of the
    text), at (from 0) and the key's 128-bit hash in h1, h2."""
    def run(stream):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in stream:
            who, many, at, hashes = [], [], [], []
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                lines = text.lower().split(b"\n")
                before = len(at)
                for k, line in enumerate(lines):
                    key = line.strip(SPACE)
                    # a code point has at most four bytes
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        at.append(k)
                        hashes.append(xxh3_128_digest(key))
                who.append(np.full(len(at) - before, i))
                many.append(np.full(len(at) - before, len(lines)))
            if not at:
                continue
            rows = pa.array(np.concatenate(who))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("mark").take(rows), pa.array(np.concatenate(many), pa.int32()),
                 pa.array(at, pa.int32()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))],
                ["doc_id", "mark", "n", "at", "h1", "h2"])

    return docs.select("doc_id", "text", "mark").mapInArrow(run, _ROWS)


#: Kinds of rows that the stream of sorted lines returns.
GONE, OPEN, EDGE = 0, 1, 2


def _first_occurrences(rows: DataFrame) -> DataFrame:
    """Sorted line rows to dropped lines (GONE), lines of a task's first hash (OPEN) and the
    first document of a task's first and last hash (EDGE)."""
    def run(stream):
        import pyarrow as pa

        held = None      # hash, document and row that came last; document of the hash's first row
        opened = True    # still in the task's first hash
        edge = None
        out = ["doc_id", "mark", "n", "at", "h1", "h2", "kind"]

        def edges(*found):
            return pa.RecordBatch.from_arrays(
                [pa.array([f[2] if f[3] else None for f in found], pa.int64()), *[pa.nulls(len(found), t) for t in (pa.int64(), pa.int32(), pa.int32())],
                 pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([EDGE] * len(found), pa.int32())], out)

        for batch in stream:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, mark, at = (np.asarray(batch.column(c)) for c in ("h1", "h2", "mark", "at"))
            named = np.asarray(batch.column("doc_id").is_valid())
            doc = np.asarray(batch.column("doc_id").fill_null(0))
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            again = np.zeros(n, bool)  # copies of the row before
            again[1:] = ~new[1:] & (doc[1:] == doc[:-1]) & (named[1:] == named[:-1]) & (mark[1:] == mark[:-1]) & (at[1:] == at[:-1])
            if held is not None:
                new[0] = (h1[0], h2[0]) != held[0]
                again[0] = not new[0] and (doc[0], named[0], mark[0], at[0]) == held[1]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first, known = doc[np.maximum(start, 0)], named[np.maximum(start, 0)]
            if not new[0]:
                first, known = np.where(start < 0, held[2], first), np.where(start < 0, held[3], known)
            if edge is None:
                edge = (int(h1[0]), int(h2[0]), int(doc[0]), bool(named[0]))
                yield edges(edge)
            fresh = np.flatnonzero((h1 != edge[0]) | (h2 != edge[1])) if opened else np.zeros(1, int)
            cut = n if opened and not len(fresh) else int(fresh[0]) if opened else 0  # rows before it are open
            opened = cut == n
            gone = ((doc != first) | (named != known)) & ~again
            gone[:cut] = ~again[:cut]
            keep = np.flatnonzero(gone)
            held = ((h1[-1], h2[-1]), (doc[-1], named[-1], mark[-1], at[-1]), int(first[-1]), bool(known[-1]))
            if len(keep):
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in out[:-1]], pa.array(np.where(keep < cut, OPEN, GONE), pa.int32())], out)
        if held is not None:
            yield edges((int(held[0][0]), int(held[0][1]), held[2], held[3]))

    order = ["h1", "h2", F.col("doc_id").asc_nulls_last(), "at", "mark"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _ROWS + ", kind int")


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, mark, n, at: every line that its document loses, a row for each text of a doc_id."""
    rows = written(line_rows(_read(docs), least), "lines")
    found = written(_first_occurrences(rows), "line-firsts")
    discard(rows)
    # the least document of a hash among all tasks: two rows a task are broadcast
    edges = found.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("least")))
    columns = ["doc_id", "mark", "n", "at"]
    return found.where(F.col("kind") == GONE).select(*columns).unionAll(late.select(*columns))


def pack_keep(n: int, gone: np.ndarray) -> bytes:
    """Compressed keep bits of a text of n lines, the lowest bit first."""
    import zlib

    bits = np.ones(n, np.uint8)
    bits[gone] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes())


def unpack_keep(keep: bytes, n: int) -> np.ndarray:
    import zlib

    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little", count=n).astype(bool)


def _bitmaps(dropped: DataFrame) -> DataFrame:
    """doc_id, mark, n_lines, n_dropped, keep: one row for each document and text that loses lines."""
    def run(stream):
        import pyarrow as pa

        held = None

        def rows(batch, last):
            """Bitmaps of the documents that end in the batch, and the rows of one that may go on."""
            doc, mark = batch.column("doc_id").fill_null(0), np.asarray(batch.column("mark"))
            doc, named = np.asarray(doc), np.asarray(batch.column("doc_id").is_valid())
            n, at = np.asarray(batch.column("n")), np.asarray(batch.column("at"))
            change = np.flatnonzero((doc[1:] != doc[:-1]) | (named[1:] != named[:-1]) | (mark[1:] != mark[:-1])) + 1
            starts = np.concatenate([[0], change, [len(doc)]])
            if not last:
                starts = starts[:-1]
            gone = [np.unique(at[a:b]) for a, b in zip(starts[:-1], starts[1:])]
            heads = starts[:-1]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(heads, pa.int64())), pa.array(mark[heads], pa.int64()), pa.array(n[heads], pa.int32()),
                 pa.array([len(g) for g in gone], pa.int32()), pa.array([pack_keep(int(n[a]), g) for a, g in zip(heads, gone)], pa.binary())],
                ["doc_id", "mark", "n_lines", "n_dropped", "keep"]), batch.slice(starts[-1])

        for batch in stream:
            if held is not None and held.num_rows:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                found, held = rows(batch, False)
                if found.num_rows:
                    yield found
        if held is not None and held.num_rows:
            yield rows(held, True)[0]

    key = ["doc_id", "mark"]
    return dropped.repartition(*key).sortWithinPartitions(*key, "at").mapInArrow(
        run, "doc_id bigint, mark bigint, n_lines int, n_dropped int, keep binary")


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_lines, n_dropped and ``keep``, the compressed keep bits
    of its lines, for each document and text that loses lines. All others keep every line."""
    return _bitmaps(dropped_lines(docs, least))


def _joined(docs: DataFrame, bitmaps: DataFrame, doc_id, mark) -> DataFrame:
    """``docs`` with _keep, null where all lines stay. A merge join at every size: texts are the large side."""
    b = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("keep").alias("_keep")).hint("merge")
    return docs.join(b, doc_id.eqNullSafe(F.col("_doc")) & (mark == F.col("_mark")), "left").drop("_doc", "_mark")


def kept_text(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, the number of lines and that of dropped ones."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = unpack_keep(keep, len(lines))
    return b"\n".join([x for x, b in zip(lines, bits.tolist()) if b]), len(lines), int(len(lines) - bits.sum())


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents with their dropped lines cut out of ``text``; other columns as in ``docs``."""
    bitmaps = keep_bitmaps(docs, least)
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))

    def run(texts, keeps):
        import pandas as pd

        return pd.Series([kept_text(t.encode(), k)[0].decode() for t, k in zip(texts, keeps)])

    import pandas as pd

    run.__annotations__ = {"texts": pd.Series, "keeps": pd.Series, "return": pd.Series}
    cut = F.pandas_udf(run, "string")
    joined = _joined(docs, bitmaps, F.col("`doc_id`").cast("bigint"), F.xxhash64(text))
    return joined.select(*[F.when(F.col("_keep").isNull(), F.col("`text`")).otherwise(cut(text, F.col("_keep"))).alias("text")
                           if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    read = _read(docs)

    def run(stream):
        import hashlib

        import pyarrow as pa

        for batch in stream:
            done = [kept_text(t, k) for t, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_keep").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()),
                 pa.array([hashlib.sha256(d[0]).hexdigest() for d in done], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return _joined(read, keep_bitmaps(docs), F.col("doc_id"), F.col("mark")).select("doc_id", "text", "_keep") \
        .mapInArrow(run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

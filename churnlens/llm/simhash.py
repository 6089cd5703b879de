"""Operator 3: SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z lower-cased, words between ASCII white space, shingles of
``width`` words joined by a space (repeats count; fewer words: the whole
sequence), XXH64 with seed 42 of each; a bit is set if over half of the
hashes set it. A text without words has fingerprint 0.

Links: two fingerprints with at most ``radius`` differing bits. The 64 bits are
cut into radius + 2 bands, so a linked pair agrees in two of them; every two
bands give a bucket key. A bucket with over ``BUCKET`` distinct fingerprints is
split again by the same rule on its remaining bits, without losing a pair; two
bands of those leave so few bits that a bucket is bounded (2^16 at radius 2).
Inside a bucket, blocks hold their fingerprints as vertical bit planes: one
word operation updates 64 distances. Planes are added pairwise into carry-save
counters that start at a bias, so a counter overflows exactly when a distance
exceeds the radius, and a block is abandoned once all have.

Copies share a fingerprint and are compared once. A task passes on a spanning
forest of the links it finds; components are found by star rounds. A hot
fingerprint costs one partial row per task, and one skewed join side at the end.

Defined cases: a null or empty text has fingerprint 0 and links like any other;
a null doc_id keeps its row, and a component without any doc_id has a null id;
repeated rows each give a row; an empty table gives no rows; long texts are
taken whole; further input columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, written
from .components import components, label_components

WIDTH, RADIUS = 3, 2
BUCKET = 4096
BLOCK = 512


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    text, xxh = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return xxh(text, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    first, last = starts[:len(words) - width + 1].tolist(), (starts + size)[width - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(first), 1 << 15):
        h = np.array([xxh(text[a:b], 42) for a, b in zip(first[i:i + (1 << 15)], last[i:i + (1 << 15)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as bigint) of every row."""
    def run(stream):
        import pyarrow as pa

        for batch in stream:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fp = [fingerprint(t or b"", width) for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return pick(docs, doc_id="doc_id bigint", text="text string").mapInArrow(run, "doc_id bigint, fp bigint")


def _bands(bits: int, bands: int) -> list[int]:
    """Masks over the set bits of ``bits``, cut into ``bands`` runs; then unions of every two."""
    at = [i for i in range(64) if bits >> i & 1]
    cut = [len(at) * k // bands for k in range(bands + 1)]
    runs = [sum(1 << i for i in at[a:b]) for a, b in zip(cut, cut[1:])]
    return [a | b for a, b in combinations(runs, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(reps: DataFrame, radius: int) -> DataFrame:
    """(k, v, fp): one row per bucket of a fingerprint; k names the bits that agree, v holds them."""
    full = (1 << 64) - 1
    masks = _bands(full, radius + 2)
    key = lambda k, m: F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v"))
    rows = reps.select("fp", F.explode(F.array(*[key(k, m) for k, m in enumerate(masks)])).alias("b")).select("b.k", "b.v", "fp")
    hot = written(rows.groupBy("k", "v").count().where(F.col("count") > BUCKET).select("k", "v"), "hot-buckets")
    if hot.isEmpty():
        return rows
    cold = rows.join(hot, ["k", "v"], "left_anti")
    fine = None
    for k, m in enumerate(masks):
        sub = [key(len(masks) * (k + 1) + j, m | s) for j, s in enumerate(_bands(full & ~m, radius + 2))]
        part = rows.where(F.col("k") == k).select("k", "v", "fp").join(hot, ["k", "v"], "left_semi") \
            .select("fp", F.explode(F.array(*sub)).alias("b")).select("b.k", "b.v", "fp")
        fine = part if fine is None else fine.unionAll(part)
    return cold.unionAll(fine)


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    pad = -bits.shape[1] % 64
    return np.ascontiguousarray(np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1, bitorder="little")).view("<u8")


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most ``radius`` differing bits, by bit planes of ``right``.
    ``apart[i, j]`` marks pairs that are not to be compared."""
    planes = _planes(right)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    flip = np.where(np.unpackbits(left.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T, ones, np.uint64(0))
    shape = (len(left), planes.shape[1])
    over = np.zeros(shape, np.uint64)
    over[:, -1] |= ~np.uint64(0) << np.uint64(len(right) % 64) if len(right) % 64 else np.uint64(0)
    if apart is not None:
        packed = np.packbits(np.pad(apart, ((0, 0), (0, -len(right) % 64))), axis=1, bitorder="little")
        over |= np.ascontiguousarray(packed).view("<u8")
    depth = (radius + 1).bit_length()
    bias = (1 << depth) - radius - 1
    counter = [np.full(shape, ones if bias >> k & 1 else np.uint64(0)) for k in range(depth)]
    for b in range(0, 64, 2):
        x, y = planes[b] ^ flip[b][:, None], planes[b + 1] ^ flip[b + 1][:, None]
        half = counter[0] ^ x
        carry = (counter[0] & x) | (half & y)
        counter[0] = half ^ y
        for k in range(1, depth):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if b % 8 == 6 and (over == ones).all():
            return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :len(right)])


def _forest_edges(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning-forest edges of the links inside each group (rows sorted by group)."""
    found = [], []
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(fp))
    start = 0
    while start < len(fp):
        # whole small groups up to a block, or one large group in tiles
        stop = int(ends[np.searchsorted(ends, start + BLOCK, "right") - 1]) if ends[np.searchsorted(ends, start, "right")] <= start + BLOCK \
            else int(ends[np.searchsorted(ends, start, "right")])
        for i in range(start, stop, BLOCK):
            for j in range(i, stop, BLOCK):
                a, b = slice(i, min(i + BLOCK, stop)), slice(j, min(j + BLOCK, stop))
                apart = group[a][:, None] != group[b][None, :] if stop - start <= BLOCK else None
                p, q = close_pairs(fp[a], fp[b], radius, apart)
                p, q = p + i, q + j
                found[0].append(p[p < q])
                found[1].append(q[p < q])
        start = stop
    roots = label_components(len(fp), *map(np.concatenate, found))
    linked = np.flatnonzero(roots != np.arange(len(fp)))
    return fp[linked].view(np.int64), fp[roots[linked]].view(np.int64)


def links(reps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect the same ones as all links do."""
    def run(stream):
        import pyarrow as pa

        held = None
        for batch in stream:
            rows = [np.asarray(batch.column(c)) for c in ("k", "v", "fp")]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            n = len(held[0])
            if n < 8 * BLOCK:
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(n - np.argmin(same[::-1])) if not same.all() else 0
            if cut:  # the last bucket may go on
                yield edges(pa, *[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield edges(pa, *held)

    def edges(pa, k, v, fp):
        change = np.concatenate([[False], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
        a, b = _forest_edges(fp.astype(np.int64).view(np.uint64), np.cumsum(change), radius)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _keyed(reps, radius).repartition("k", "v").sortWithinPartitions("k", "v", "fp").mapInArrow(run, "a bigint, b bigint")


def _labelled(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root, component_id) of every distinct fingerprint."""
    prints = written(fingerprints(docs, width), "simhash")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(reps, radius)).select(F.col("node").alias("fp"), "root")
    joined = reps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, joined.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links) for every row."""
    prints, labels = _labelled(docs, width, radius)
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of several rows with it, one.
    A component without any doc_id keeps one of its rows. Columns as in ``docs``."""
    prints, labels = _labelled(docs, width, radius)
    labels = written(labels, "simhash-labels")
    own = prints.join(labels, "fp").where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    own = written(own.select(F.col("doc_id").alias("_kept"), "n"), "simhash-kept")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(own.hint("merge"), F.col("`doc_id`").cast("bigint") == F.col("_kept"))  # one plan at every size
    if not own.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["_kept"])
    kept = kept.select(*columns)
    nameless = docs.where(F.col("`doc_id`").isNull())
    if nameless.select("`doc_id`").isEmpty():
        return kept

    def run(texts):
        import pandas as pd

        for part in texts:
            yield pd.Series(np.array([fingerprint(t.encode() if isinstance(t, str) else b"", width) for t in part], np.uint64).view(np.int64))

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    print_of = F.pandas_udf(run, "bigint")(F.col("`text`").cast("string"))
    alone = labels.where("component_id is null").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"))
    return kept.unionAll(nameless.withColumn("_fp", print_of).join(alone, "_fp").dropDuplicates(["_root"]).select(*columns))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

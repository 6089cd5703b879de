"""Operator 11: Merkle manifest of a data set, placed by ranks in bitmaps.

A leaf's place in its group (here: language) is the number of smaller ids there.

1. Bitmaps: tasks turn the ids of a group into compressed bitmaps, one for every
   ``2 ** CHUNK`` ids: the bits, or their places where that is shorter, beside a
   count for ids that come more than once. Bitmaps of the same chunk are merged.
2. Directory: the population counts of a group's bitmaps are added up along a
   tree of fan-out ``2 ** FAN``, so no task sums more than that many counts
   however many ids a group has. A leaf's place is its chunk's offset plus the
   bits before its own. No id is sorted.
3. Slots: leaves are keyed by (group, place >> ``BLOCK``) and put at their slot of
   an array; a block of ``2 ** BLOCK`` slots is reduced ``BLOCK`` levels at once.
   The blocks' tops are the next nodes, until a group has one node, its subroot.
   Subroots are placed in the order of their groups and reduced the same way.
4. Proofs go down: a block hands each of its slots the siblings inside the block
   and those above. Leaves get theirs from the block row they lie in.

H is the lower-case hex SHA-256 of its inputs in a row, digests as hex text. A
run of nodes is two, the last of a level may be one; a tree of one node is that
node.

Defined cases: a null group is a group of its own and comes first; null ids come
first in their group; rows with the same id are ordered by their leaf, so
identical rows take neighbouring places; equal ids may be any share of the rows
(they are numbered by range partitions that cut them). An empty table gives no
rows; texts are hashed whole; further input columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written

CHUNK = 12   # bits of an id inside a bitmap
FAN = 10     # bits of a directory node
BLOCK = 10   # levels of a block of slots
SIDE = 1 << CHUNK
_NO_ID = -(1 << (63 - CHUNK)) - 1   # chunk of null ids, before all others
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---- leaves

def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, ``:`` and itself; ``-`` for null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The 32 bytes of H over the columns."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


# ---- bitmaps and their directory

def _encode(counts: np.ndarray) -> tuple[list, list, list]:
    """Rows of counts per id to bitmaps, places of repeated ids and how often more they come."""
    bits = counts > 0
    packed = np.packbits(bits, axis=1, bitorder="little")
    many = bits.sum(axis=1)
    maps = [p.tobytes() if k * 2 >= SIDE // 8 else np.flatnonzero(b).astype("<u2").tobytes() for p, b, k in zip(packed, bits, many)]
    again = [np.flatnonzero(c > 1) for c in counts]
    return maps, again, [c[a] - 1 for c, a in zip(counts, again)]


def members(bitmap: bytes) -> np.ndarray:
    """Places of a bitmap's ids, ascending."""
    if len(bitmap) == SIDE // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
    return np.frombuffer(bitmap, "<u2").astype(np.int64)


_MAPS = "grp string, chunk bigint, bitmap binary, again array<int>, more array<bigint>, n bigint"


def _bitmap_rows(pa, grp, chunk: np.ndarray, at: np.ndarray, low: np.ndarray, times: np.ndarray):
    """Bitmaps of containers 0, 1, ... (named by grp and chunk) from (container, low, times), some at a time."""
    for a in range(0, len(chunk), 1024):
        b = min(a + 1024, len(chunk))
        mine = (at >= a) & (at < b)
        counts = np.bincount((at[mine] - a) * SIDE + low[mine], times[mine], (b - a) * SIDE).astype(np.int64).reshape(b - a, SIDE)
        maps, again, more = _encode(counts)
        yield pa.RecordBatch.from_arrays(
            [grp.slice(a, b - a), pa.array(chunk[a:b], pa.int64()), pa.array(maps, pa.binary()), pa.array(again, pa.list_(pa.int32())),
             pa.array(more, pa.list_(pa.int64())), pa.array(counts.sum(axis=1))], ["grp", "chunk", "bitmap", "again", "more", "n"])


def bitmaps(rows: DataFrame) -> DataFrame:
    """grp, chunk, bitmap, again and more (repeated ids), n: one row per group and chunk of ids."""
    def build(stream):
        import pyarrow as pa

        for batch in stream:
            if not batch.num_rows:
                continue
            names = batch.column("grp").dictionary_encode()
            code, chunk = np.asarray(names.indices), np.asarray(batch.column("chunk"))
            keys, at = np.unique(np.stack([code, chunk]), axis=1, return_inverse=True)
            yield from _bitmap_rows(pa, names.dictionary.take(pa.array(keys[0])), keys[1], at.ravel(), np.asarray(batch.column("low")),
                                    np.ones(batch.num_rows))

    def merge(stream):
        import pyarrow as pa

        def merged(table, upto):
            grp, chunk = table.column("grp").to_pylist()[:upto], np.asarray(table.column("chunk"))[:upto]
            new = np.array([True] + [a != b for a, b in zip(grp[1:], grp)]) if upto else np.zeros(0, bool)
            new[1:] |= chunk[1:] != chunk[:-1]
            who = np.cumsum(new) - 1
            at, low, times = [], [], []
            for k, bitmap, again, more in zip(who, table.column("bitmap").to_pylist()[:upto], table.column("again").to_pylist(), table.column("more").to_pylist()):
                ids = members(bitmap)
                low += [ids, np.array(again, np.int64)]
                times += [np.ones(len(ids)), np.array(more, float)]
                at.append(np.full(len(ids) + len(again), k))
            heads = np.flatnonzero(new)
            yield from _bitmap_rows(pa, pa.array([grp[i] for i in heads], pa.string()), chunk[heads], *map(np.concatenate, (at, low, times)))

        held = None
        for batch in stream:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = held.num_rows
            if n < 4096:
                continue
            last = (held.column("grp")[n - 1].as_py(), held.column("chunk")[n - 1].as_py())
            cut = n - 1  # bitmaps of the last chunk may go on
            while cut and (held.column("grp")[cut - 1].as_py(), held.column("chunk")[cut - 1].as_py()) == last:
                cut -= 1
            if cut:
                yield from merged(held, cut)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from merged(held, held.num_rows)

    parts = rows.select("grp", "chunk", "low").mapInArrow(build, _MAPS)
    return parts.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk").mapInArrow(merge, _MAPS)


def directory(maps: DataFrame) -> DataFrame:
    """grp, chunk, first (ids of the group before the chunk), total (ids of the group)."""
    # from 0 on, so that all nodes of a group meet in node 0
    levels, now = [], maps.select("grp", (F.col("chunk") - F.lit(_NO_ID)).alias("node"), "n")
    while True:
        up = F.shiftright("node", FAN)
        before = Window.partitionBy("grp", up).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        level = written(now.select("grp", "node", up.alias("up"), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "directory")
        levels.append(level)
        now = level.groupBy("grp", F.col("up").alias("node")).agg(F.sum("n").alias("n"))
        if now.groupBy("grp").count().where(F.col("count") > 1).isEmpty():
            break
    out = now.select("grp", F.col("node").alias("up"), F.lit(0).cast("bigint").alias("above"), F.col("n").alias("total"))
    for level in reversed(levels):
        out = level.join(out, ["grp", "up"]).select("grp", F.col("node").alias("up"), (F.col("first") + F.col("above")).alias("above"), "total")
    return out.select("grp", (F.col("up") + F.lit(_NO_ID)).alias("chunk"), F.col("above").alias("first"), "total")


def numbered(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """``rows`` with ``number``, their place (from 0) in ``order`` within ``group``. Ranges of the order
    are cut over tasks, equal rows too; what is added up is one count per group and task."""
    # equal rows are cut apart by where they are stored
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    cuts = [*group, *order, "_row"]
    ranged = written(rows.repartitionByRange(*cuts).sortWithinPartitions(*cuts).withColumn("_task", F.spark_partition_id())
                     .withColumn("_at", F.monotonically_increasing_id()), name)
    parts = ranged.groupBy(*group, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(parts, [*group, "_task"]).withColumn("number", F.col("_at") - F.col("_least") + F.col("_before")) \
        .drop("_row", "_task", "_at", "_n", "_least", "_before")


def _ranked(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """grp, chunk, low, id, leaf, tag, place, total: rank queries of the rows against the bitmaps."""
    def run(stream):
        import pyarrow as pa

        state = None  # group, chunk, offset, total, ids before each place
        for batch in stream:
            n = batch.num_rows
            grp, chunk = batch.column("grp").to_pylist(), np.asarray(batch.column("chunk"))
            kind, low = np.asarray(batch.column("kind")), np.asarray(batch.column("low").fill_null(0))
            place, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            maps = np.flatnonzero(kind == 0)
            ends = [*maps.tolist(), n]
            if state is not None and ends[0]:
                place[:ends[0]], total[:ends[0]] = state[2] + state[4][low[:ends[0]]], state[3]
            for a, b in zip(ends[:-1], ends[1:]):
                row = batch.slice(a, 1)
                counts = np.zeros(SIDE, np.int64)
                counts[members(row.column("bitmap")[0].as_py())] = 1
                counts[np.array(row.column("again")[0].as_py(), np.int64)] += np.array(row.column("more")[0].as_py(), np.int64)
                state = (grp[a], int(chunk[a]), row.column("first")[0].as_py(), row.column("total")[0].as_py(), np.cumsum(counts) - counts)
                place[a + 1:b], total[a + 1:b] = state[2] + state[4][low[a + 1:b]], state[3]
            own = np.flatnonzero(kind)
            if len(own):
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("grp", "chunk", "low", "id", "leaf", "tag")],
                                                  pa.array(place[own]), pa.array(total[own])],
                                                 ["grp", "chunk", "low", "id", "leaf", "tag", "place", "total"])

    kinds = {"kind": "int", "grp": "string", "chunk": "bigint", "low": "int", "id": "bigint", "leaf": "binary", "tag": "binary", "bitmap": "binary",
             "again": "array<int>", "more": "array<bigint>", "first": "bigint", "total": "bigint"}
    shaped = lambda df, k: df.select(*[F.lit(k).alias(c) if c == "kind" else F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
                                       for c, t in kinds.items()])
    return shaped(maps, 0).unionAll(shaped(rows, 1)).repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind").mapInArrow(
        run, "grp string, chunk bigint, low int, id bigint, leaf binary, tag binary, place bigint, total bigint")


def placed(leaves: DataFrame) -> DataFrame:
    """grp, id, leaf, tag, place (in the group, from 0), total (leaves of the group) of every leaf.
    ``leaves``: grp string, id bigint, leaf binary, tag binary (handed through)."""
    rows = leaves.withColumn("chunk", F.coalesce(F.shiftright("id", CHUNK), F.lit(_NO_ID))) \
        .withColumn("low", F.coalesce(F.col("id").bitwiseAND(SIDE - 1), F.lit(0)).cast("int"))
    maps = written(bitmaps(rows), "bitmaps")
    full = written(maps.join(directory(maps), ["grp", "chunk"]), "bitmap-directory")
    out = ["grp", "id", "leaf", "tag", "place", "total"]
    some = full.where(F.size("again") > 0).select("grp", "chunk", F.explode("again").alias("low"))
    if some.isEmpty():
        return _ranked(rows, full).select(*out)
    # rows of repeated ids only share their id's rank; they are numbered apart
    key = ["grp", "chunk", "low"]
    some = written(some, "repeated")
    ties = numbered(rows.join(some.hint("merge"), key, "left_semi"), key, ["leaf"], "ties")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("id", "bigint"), ("leaf", "binary"), ("tag", "binary"))]
    found = written(_ranked(rows.join(some.hint("merge"), key, "left_anti").select(*key, "id", "leaf", "tag").unionAll(some.select(*key, *empty)), full), "ranked")
    base = found.where("leaf is null").select(*key, "place", "total")
    return found.where("leaf is not null").select(*out).unionAll(
        ties.join(base, key).withColumn("place", F.col("place") + F.col("number")).select(*out))


# ---- slot arrays

def H(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int) -> int:
    return (n - 1).bit_length() if n > 1 else 0


def _levels(slots: list[str], count: int) -> list[list[str]]:
    """The nodes of a block by level, ``count`` levels above the slots."""
    out = [slots]
    for _ in range(count):
        now = out[-1]
        up = [H(a, b) for a, b in zip(now[::2], now[1::2])]
        if len(now) % 2:
            up.append(H(now[-1]))
        out.append(up)
    return out


def _hex(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


_BLOCKS = "grp string, block bigint, total bigint, slots binary, ids array<bigint>, tags array<binary>, top binary"


def blocks(nodes: DataFrame) -> DataFrame:
    """grp, block, total, slots (digests in a row), ids, tags, top: one row per block of slots.
    ``nodes``: grp, place, total (nodes of the group at this level), leaf, id, tag."""
    def run(stream):
        import pyarrow as pa

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()))],
                ["grp", "block", "total", "slots", "ids", "tags", "top"])

        def full(key, total, slots):
            (grp, block), n = key, min(1 << BLOCK, total - (key[1] << BLOCK))
            leaves, ids, tags = [None] * n, [None] * n, [None] * n
            for place, *rest in slots:
                leaves[place], ids[place], tags[place] = rest
            raw = b"".join(leaves)
            top = _levels(_hex(raw), min(BLOCK, height(total)))[-1][0]
            return grp, block, total, raw, ids, tags, bytes.fromhex(top)

        key, total, slots, done = None, 0, [], []
        for batch in stream:
            at = np.asarray(batch.column("place"))
            for g, b, p, t, d, i, tag in zip(batch.column("grp").to_pylist(), (at >> BLOCK).tolist(), (at & (1 << BLOCK) - 1).tolist(), *(
                    batch.column(c).to_pylist() for c in ("total", "leaf", "id", "tag"))):
                if (g, b) != key:
                    if key is not None:
                        done.append(full(key, total, slots))
                        if len(done) == 64:
                            yield rows(done)
                            done = []
                    key, total, slots = (g, b), t, []
                slots.append((p, d, i, tag))
        if key is not None:
            done.append(full(key, total, slots))
        yield rows(done)

    block = F.shiftright("place", BLOCK)
    return nodes.select("grp", block.alias("block"), "place", "total", "leaf", "id", "tag") \
        .repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(run, _BLOCKS)


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Block tables from the nodes up to the level where every group has one block."""
    levels = []
    while True:
        levels.append(written(blocks(nodes), name))
        if (levels[-1].agg(F.max("total")).first()[0] or 0) <= 1 << BLOCK:
            return levels
        none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "bigint"), ("tag", "binary"))]
        up = F.shiftright(F.col("total") + F.lit((1 << BLOCK) - 1), BLOCK)
        nodes = levels[-1].select("grp", F.col("block").alias("place"), up.alias("total"), F.col("top").alias("leaf"), *none)


def _descend(levels: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """One row per slot of the lowest level: grp, id, tag, leaf, place, total, proof (siblings bottom up,
    32 bytes each, then those of ``tops``) and the carried columns. ``tops``: grp, proof, carried."""
    kinds = {f.name: f.dataType for f in tops.schema.fields}
    extra = ", ".join(f"{c} {kinds[c].simpleString()}" for c in carried)
    schema = "grp string, place bigint, total bigint, id bigint, tag binary, leaf binary, proof binary, " + extra

    def run(stream):
        import pyarrow as pa

        for batch in stream:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c: row.column(c)[0].as_py()
                raw, total, first, above = get("slots"), get("total"), get("block") << BLOCK, get("proof")
                nodes = _levels(_hex(raw), min(BLOCK, height(total)))[:-1]
                nodes = [[bytes.fromhex(x) for x in level] for level in nodes]
                n = len(raw) // 32
                proofs = [b"".join([level[(k >> d) ^ 1] for d, level in enumerate(nodes) if (k >> d) ^ 1 < len(level)]) + above for k in range(n)]
                grp = get("grp")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array([total] * n, pa.int64()),
                     row.column("ids").flatten(), row.column("tags").flatten(), pa.array([raw[j:j + 32] for j in range(0, len(raw), 32)], pa.binary()),
                     pa.array(proofs, pa.binary()), *[row.column(c).take(pa.array(np.zeros(n, int))) for c in carried]],
                    ["grp", "place", "total", "id", "tag", "leaf", "proof", *carried])

    paths = tops.select("grp", F.lit(0).cast("bigint").alias("block"), "proof", *carried)
    for level in reversed(levels):
        out = level.drop("top").join(paths, ["grp", "block"]).mapInArrow(run, schema)
        paths = out.select("grp", F.col("place").alias("block"), "proof", *carried)
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """grp, id, tag, leaf, place, total, grp_place, grps, subroot, root, proof of every leaf.

    ``proof`` has the siblings from the leaf to the root, 32 bytes each; with the places and totals
    they fold to the root (``fold``)."""
    levels = _climb(placed(leaves), "blocks")
    none = F.lit(None).cast("bigint").alias("id")
    subroots = numbered(levels[-1].select("grp", "top"), [], ["grp"], "subroots") if levels[-1].limit(1).count() else None
    if subroots is None:
        return leaves.limit(0).select("grp", "id", "tag", "leaf", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("place", "bigint"), ("total", "bigint"), ("grp_place", "bigint"), ("grps", "bigint"), ("subroot", "binary"), ("root", "binary"), ("proof", "binary"))])
    grps = levels[-1].count()
    nodes = subroots.select(F.lit("").alias("grp"), F.col("number").alias("place"), F.lit(grps).cast("bigint").alias("total"),
                            F.col("top").alias("leaf"), none, F.encode("grp", "UTF-8").alias("tag"))
    upper = _climb(nodes, "root-blocks")
    tops = _descend(upper, upper[-1].select("grp", F.lit(b"").alias("proof"), F.col("top").alias("root")), ["root"])
    tops = written(tops.select(F.decode("tag", "UTF-8").alias("grp"), "proof", F.col("leaf").alias("subroot"), "root", F.col("place").alias("grp_place"),
                               F.col("total").alias("grps")), "subroot-proofs")
    return _descend(levels, tops, ["subroot", "root", "grp_place", "grps"])


def fold(digest: str, proof: list[str], *places: tuple[int, int]) -> str:
    """The root that a leaf and its siblings give; ``places``: (place, nodes) in each tree, the lowest first."""
    k = 0
    for place, n in places:
        while n > 1:
            if place % 2:
                digest, k = H(proof[k], digest), k + 1
            elif place + 1 < n:
                digest, k = H(digest, proof[k]), k + 1
            else:
                digest = H(digest)
            place, n = place >> 1, (n + 1) >> 1
    return digest


def verified(found: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``manifest``;
    folded from the digest in ``tag`` where there is one, else from the leaf."""
    def run(stream):
        import pyarrow as pa

        columns = ("leaf", "tag", "proof", "subroot", "root", "place", "total", "grp_place", "grps")
        for batch in stream:
            out: tuple = ([], [], [], [], [], [])
            for d, tag, proof, subroot, root, *places in zip(*(batch.column(c).to_pylist() for c in columns)):
                siblings = _hex(proof)
                folded = fold((d if tag is None else tag).hex(), siblings, tuple(places[:2]), tuple(places[2:]))
                for x, v in zip(out, (d.hex(), subroot.hex(), root.hex(), H(*siblings), folded, folded == root.hex())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.bool_() if i == 5 else pa.string()) for i, x in enumerate(out)]],
                                             ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return found.mapInArrow(run, "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def query(docs: DataFrame) -> DataFrame:
    docs = pick(docs, doc_id="doc_id bigint", source="source string", lang="lang string", n_chars="n_chars bigint", text="text string")
    tampered = leaf(*[F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS])
    leaves = written(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"), F.col("doc_id").alias("id"),
        leaf(*[F.col(c) for c in FIELDS]).alias("leaf"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered).alias("tag")), "leaves")
    return verified(manifest(leaves)).withColumnRenamed("id", "doc_id")


ORACLE = """
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z AS whole,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z END AS changed
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                  || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM marked)),
leaves AS (
  SELECT doc_id, g, sha256(whole) AS leaf, sha256(coalesce(changed, whole)) AS start,
         row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
tree AS (
  SELECT g, 0 AS lvl, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY g, lvl, n, pos // 2),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY lvl, n, pos // 2),
low AS (
  SELECT doc_id, g, 0 AS lvl, pos, n, start AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT f.doc_id, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM low f LEFT JOIN tree s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
high AS (
  SELECT l.doc_id, l.g, 0 AS lvl, s.pos, s.n, l.h, l.proof FROM low l JOIN subroots s ON s.g = l.g WHERE l.n = 1
  UNION ALL
  SELECT f.doc_id, f.g, f.lvl + 1, f.pos // 2, (f.n + 1) // 2,
         sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM high f LEFT JOIN upper s ON s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, u.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = u.h AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN high f ON f.g = l.g AND f.doc_id = l.doc_id AND f.n = 1 JOIN upper u ON u.n = 1
"""

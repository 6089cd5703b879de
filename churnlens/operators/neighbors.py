"""Nearest neighbours by Euclidean distance (JON5, JON6), exact and in linear time.

Distances are ``sqrt(sum((a_i - b_i)^2))`` summed left to right with built-in
higher-order functions (JVM side). Ties are broken by id; a row is never its
own neighbour.

``knn_targets``: up to ``MAX_TARGETS`` targets are sent as a literal; every row
computes its distance to each in one projection, and the n best per target
survive a window group limit (partial top-n before the shuffle). More targets
are compared in tiles of target blocks and row shards, to the same result.

``knn_all`` (exact, every row), in two phases. Identical vectors are merged
first (a hot group of copies becomes one row plus its first k+1 ids). A k-d tree
over a bounded sample cuts the distinct vectors into cells of about ``CELL_ROWS``
rows, held as blocks of at most about ``BLOCK``. Phase 1 compares a block with
itself: the k+1 nearest there give every row an upper bound of its own. Phase 2
sends a row, once, to each region of neighbouring blocks with a cell whose bounding
box is within its bound, and compares it there with the blocks whose box is. Boxes
are lower bounds of the distance, so no neighbour is missed. A matrix product, with
its rounding allowed for, tells the pairs that can be among the nearest; their
distances are summed left to right, as the SQL oracle does, and only the k+1 nearest
of a row leave a block or region.

Cost: phase 1 is linear; phase 2 grows with the number of boxes near a row, which
is small where data has low intrinsic dimension. In high-dimensional, evenly
spread data (k-th neighbour distance close to the typical pairwise distance) no
box is out of reach and the exact join becomes quadratic: rows are copied as often
as there are regions, and pairs cost a matrix product.

``knn_all_sorted`` (approximate, linear): rows are sorted along each of a few
fixed random directions and cut into blocks of ``block`` rows by their place in
that order; a row is compared with its own and the two adjacent blocks. Every
row gets exactly min(k, rows - 1) neighbours; the directions, places and
blocks depend on the data alone, never on partitions. The caller chooses the
mode; nothing switches by size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from churnlens.functions.scalars import keyed_hash, squared_distance
from churnlens.session import scratch_path

MAX_TARGETS = 1_000
CELL_ROWS = 2048
MAX_CELLS = 4096             # of the tree on the driver; larger tables have more blocks to a cell
SAMPLE_ROWS, SAMPLE_BYTES = 1 << 15, 1 << 25   # the tree is fitted on so many vectors at most
BLOCK = 2048
REGIONS, REGION_ROWS, REGION_BYTES = 8, 1 << 16, 1 << 25   # rows go to regions of 1 / REGIONS of all rows, so many at most
CHUNK = 256
SLACK = 1e-9


def _dist(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def feature_vector(df: DataFrame, features: list[str], out: str = "vec", digits: int | None = None) -> DataFrame:
    """Pack feature columns into one array<double> column."""
    cols = [F.col(f"`{c}`").cast("double") for c in features]
    if digits is not None:
        cols = [F.round(c, digits) for c in cols]
    return df.withColumn(out, F.array(*cols))


def knn_targets(df: DataFrame, targets: DataFrame, n: int = 5, id_col: str = "customerID",
                vec: str = "vec") -> DataFrame:
    """JON5: the n nearest rows of ``df`` for each target row (target excluded).

    Returns (target_id, rank, neighbor_id, distance).
    """
    t_rows = targets.select(id_col, vec).limit(MAX_TARGETS + 1).collect()
    if len(t_rows) > MAX_TARGETS:
        return _knn_tiles(df, targets, n, id_col, vec)
    if not t_rows:
        return df.sparkSession.createDataFrame([], "target_id string, rank int, neighbor_id string, distance double")
    lit_targets = F.array(*[F.struct(F.lit(r[id_col]).alias("tid"),
                                     F.array(*[F.lit(float(x)) for x in r[vec]]).alias("tvec")) for r in t_rows])
    cand = df.select(F.col(id_col).alias("neighbor_id"), F.explode(F.transform(
        lit_targets, lambda t: F.struct(t["tid"].alias("target_id"), _dist(t["tvec"], F.col(vec)).alias("distance"))
    )).alias("c")).select("c.target_id", "neighbor_id", "c.distance").where(
        F.col("target_id") != F.col("neighbor_id"))
    w = W.partitionBy("target_id").orderBy("distance", "neighbor_id")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("target_id", "rank", "neighbor_id", "distance"))


def _knn_tiles(df: DataFrame, targets: DataFrame, n: int, id_col: str, vec: str) -> DataFrame:
    """``knn_targets`` for any number of targets: blocks of targets against shards of rows, n best per tile."""
    t = targets.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    c = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    blocks, shards = math.ceil(t.count() / BLOCK), max(1, math.ceil(c.count() / BLOCK))
    salt = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    tiles = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = t.withColumn("b", salt(blocks)).withColumn("s", tiles(shards))
    right = c.withColumn("s", salt(shards)).withColumn("b", tiles(blocks))
    got = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(
        _block_nearest(n), "id string, neighbor_id string, distance double")
    w = W.partitionBy("id").orderBy("distance", "neighbor_id")
    return (got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(F.col("id").alias("target_id"), "rank", "neighbor_id", "distance"))


def kd_cuts(sample, leaves: int, least: int):
    """A k-d tree as rows (dimension, cut, left, right); negative children are leaves -1, -2, ...
    The fullest leaf is cut at its median along its widest spread until there are ``leaves``; none gets under ``least`` rows."""
    import heapq

    import numpy as np
    nodes: list = []
    heap = [(-len(sample), 0, np.arange(len(sample)), None, 0)]
    done, turn = [], 1
    while heap and len(heap) + len(done) < leaves:
        _, _, rows, parent, side = heapq.heappop(heap)
        z = sample[rows]
        cut = None
        for j in np.argsort(-z.var(axis=0), kind="stable") if len(rows) >= 2 * least else []:
            at = float(np.median(z[:, j]))
            low = z[:, j] < at
            if not low.any():
                above = z[z[:, j] > at, j]
                at = float(above.min()) if len(above) else at
                low = z[:, j] < at
            if least <= low.sum() <= len(rows) - least:
                cut = (int(j), at, low)
                break
        if cut is None:
            done.append((parent, side))
            continue
        nodes.append([cut[0], cut[1], 0, 0])
        if parent is not None:
            nodes[parent][2 + side] = len(nodes) - 1
        for k, part in enumerate((rows[cut[2]], rows[~cut[2]])):
            heapq.heappush(heap, (-len(part), turn, part, len(nodes) - 1, k))
            turn += 1
    for i, (parent, side) in enumerate([*done, *[(h[3], h[4]) for h in sorted(heap, key=lambda h: h[1])]]):
        if parent is not None:
            nodes[parent][2 + side] = -1 - i
    return nodes


def kd_cells(x, nodes: list):
    """The leaf of every row."""
    import numpy as np
    if not nodes:
        return np.zeros(len(x), np.int64)
    tree = np.array([[n[0], n[2], n[3]] for n in nodes])
    cut = np.array([n[1] for n in nodes])
    at = np.zeros(len(x), np.int64)
    while True:
        open_ = np.flatnonzero(at >= 0)
        if not len(open_):
            return -1 - at
        node = at[open_]
        at[open_] = np.where(x[open_, tree[node, 0]] < cut[node], tree[node, 1], tree[node, 2])


def box_distances(x, low, high):
    """Distance of every row to every box: no row of the box is nearer."""
    import numpy as np
    acc = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j][:, None], x[:, j][:, None] - high[None, :, j]), 0)
        acc += gap * gap
    return np.sqrt(acc)


def _reach(bound):
    return bound * (1 + SLACK) + SLACK


def _row_distances(q, i, c, k):
    """Distances of the pairs (q[i], c[k]), summed left to right as the SQL oracle does."""
    import numpy as np
    acc = np.zeros(len(i))
    for j in range(q.shape[1]):
        diff = q[i, j] - c[k, j]
        acc += diff * diff
    return np.sqrt(acc)


def _maybe_near(x, bound, c, keep: int):
    """Pairs (row of x, row of c) among which are all ``keep`` nearest within the bound: by one matrix product, whose
    rounding is allowed for; rows with non-finite parts are all compared."""
    import numpy as np
    with np.errstate(all="ignore"):
        xx, cc = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
        if not (np.isfinite(xx).all() and np.isfinite(cc).all()):
            return np.repeat(np.arange(len(x)), len(c)), np.tile(np.arange(len(c)), len(x))
        near = x @ (-2.0 * c.T)                            # squared distance without xx
        near += cc
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + cc.max(initial=0.0))
        most = bound * bound * (1 + SLACK) - xx + slack
    hit = near <= most[:, None]
    crowded = np.flatnonzero(hit.sum(axis=1) > 2 * keep)
    if len(crowded) and len(c) > keep:
        some = near[crowded]
        most = np.partition(some, keep - 1, axis=1)[:, keep - 1] + 2 * slack[crowded]
        hit[crowded] &= some <= most[:, None]
    return np.nonzero(hit)


def _first_of(i, place, dist, keep: int):
    """Positions of the first ``keep`` entries of every i, by distance and place, i ascending."""
    import numpy as np
    order = np.lexsort((place, dist, i))
    first = np.searchsorted(i[order], i[order])
    return order[np.arange(len(i)) - first < keep]


def nearest_within(q, bound, c, names, keep: int):
    """(query, candidate, distance): for each query row the ``keep`` nearest candidates no further than its bound,
    nearest first; ties by candidate name. ``CHUNK`` queries at a time."""
    import numpy as np
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for s in range(0, len(q) if len(c) else 0, CHUNK):
        x = q[s:s + CHUNK]
        i, k = _maybe_near(x, bound[s:s + CHUNK], c, keep)
        dist = _row_distances(x, i, c, k)
        ok = dist <= bound[s:s + CHUNK][i]
        found.append((i[ok] + s, k[ok], dist[ok]))
    i, k, dist = (np.concatenate(x) for x in zip(*found))
    place = np.empty(len(names), np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))
    first = _first_of(i, place[k], dist, keep)
    return i[first], k[first], dist[first]


def _matrix(column, dim: int):
    """A list column of an Arrow table as rows of ``dim`` doubles."""
    import numpy as np
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must have {dim} components each")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), dim)


def _lists(values, start):
    """An Arrow list column: row r holds values[start[r]:start[r + 1]]."""
    import pyarrow as pa
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values))


def _leaf_order(nodes: list) -> dict:
    """Place of every leaf of a k-d tree from left to right: neighbouring places are near one another."""
    todo, out = [0] if nodes else [-1], {}
    while todo:
        at = todo.pop()
        if at < 0:
            out[-1 - at] = len(out)
        else:
            todo += [nodes[at][3], nodes[at][2]]
    return out


_NEAR = "vid string, cvid string, distance double"


def _exact_parts(vecs: DataFrame, n: int, keep: int, cells: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phase 1 and 2 over distinct vectors (vid, vec): members with block, region and bound, the rows sent to
    regions, and (vid, cvid, distance) with the ``keep`` nearest of every compared block or region."""
    import numpy as np
    import pyarrow as pa
    spark = vecs.sparkSession
    dim = len(vecs.first()["vec"])
    size = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dim))))
    some = vecs.withColumn("_h", keyed_hash("vid", seed)).orderBy("_h", "vid").limit(size).select("vec").collect()
    sample = np.array([list(map(float, r["vec"])) for r in some])
    nodes = kd_cuts(sample, max(1, min(MAX_CELLS, cells or math.ceil(n / CELL_ROWS))), max(8, 2 * keep))

    def place(batches):
        for part in batches:
            yield part.append_column("cell", pa.array(kd_cells(_matrix(part["vec"], dim), nodes), pa.int64()))

    def stored(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    placed = stored(vecs.select("vid", "vec").mapInArrow(place, "vid string, vec array<double>, cell bigint"), "knn-cells")
    # at most MAX_CELLS rows, and as many per dimension
    rows_of = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    sides = placed.select("cell", F.posexplode("vec").alias("j", "x")).groupBy("cell", "j").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    order = _leaf_order(nodes)
    ids = sorted(rows_of, key=order.get)
    blocks_of = {c: max(1, math.ceil(rows_of[c] / BLOCK)) for c in ids}
    at = {c: i for i, c in enumerate(ids)}
    low, high = np.zeros((len(ids), dim)), np.zeros((len(ids), dim))
    for r in sides:
        low[at[r["cell"]], r["j"]], high[at[r["cell"]], r["j"]] = r["low"], r["high"]

    # blocks are numbered along the tree; consecutive ones make a region of at most about ``many`` rows
    first_block = dict(zip(ids, np.cumsum([0, *[blocks_of[c] for c in ids]]).tolist()))
    owner = np.repeat(np.arange(len(ids)), [blocks_of[c] for c in ids])
    rows = np.array([rows_of[ids[c]] / blocks_of[ids[c]] for c in owner])
    many = max(BLOCK, min(REGION_ROWS, REGION_BYTES // (8 * max(1, dim)), n // REGIONS))
    region_of = ((np.cumsum(rows) - rows / 2) // many).astype(np.int64)
    start = F.create_map(*[x for c in ids for x in (F.lit(c), F.lit(first_block[c]))])
    most = F.create_map(*[x for c in ids for x in (F.lit(c), F.lit(blocks_of[c]))])
    members = placed.withColumn("block", (start[F.col("cell")] + F.pmod(F.xxhash64("vid"), most[F.col("cell")])).cast("int"))

    def own(part):
        x, names = _matrix(part["vec"], dim), part["vid"].to_numpy()
        i, k, dist = nearest_within(x, np.full(len(x), np.inf), x, names, keep)
        begin = np.searchsorted(i, np.arange(len(x) + 1))
        full = np.flatnonzero(np.diff(begin) >= keep)          # fewer than keep leave the bound open
        bound = np.full(len(x), np.inf)
        bound[full] = dist[begin[full] + keep - 1]
        block = part["block"].to_numpy()
        return pa.table({"vid": part["vid"], "vec": part["vec"], "block": pa.array(block, pa.int32()), "region": pa.array(region_of[block], pa.int64()),
                         "bound": pa.array(bound), "cvids": _lists(names[k], begin), "dists": _lists(dist, begin)})

    # a number of tasks of their own: by bytes alone Spark would merge these groups, which are small and slow, into a few
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = stored(members.select("vid", "vec", "block").repartition(tasks, "block").groupBy("block").applyInArrow(
        own, "vid string, vec array<double>, block int, region bigint, bound double, cvids array<string>, dists array<double>"), "knn-bounds")
    n_regions = int(region_of[-1]) + 1

    def route(batches):
        for part in batches:
            for s in range(0, len(part), CHUNK):
                some = part.slice(s, CHUNK)
                x, bound, block = _matrix(some["vec"], dim), some["bound"].to_numpy(zero_copy_only=False), some["block"].to_numpy()
                near = (box_distances(x, low, high) <= _reach(bound)[:, None])[:, owner]
                near[np.arange(len(x)), block] = False          # its own block is done
                to = np.zeros((len(x), n_regions), bool)
                i, b = np.nonzero(near)
                to[i, region_of[b]] = True
                i, r = np.nonzero(to)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), *[some[c].take(pa.array(i)) for c in ("vid", "vec", "bound", "block")]],
                                                 names=["region", "qid", "qvec", "bound", "qblock"])

    sent = stored(first.select("vid", "vec", "bound", "block").mapInArrow(
        route, "region bigint, qid string, qvec array<double>, bound double, qblock int"), "knn-sent")
    # a region that very many rows reach is compared with them in shares
    shares = sent.groupBy("region").agg(F.ceil(F.count("*") / F.lit(many)).cast("int").alias("shares"))
    left = sent.join(F.broadcast(shares), "region").withColumn("share", F.pmod(F.xxhash64("qid"), F.col("shares")).cast("int"))
    right = first.select("region", "vid", "vec", "block").join(F.broadcast(shares), "region") \
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def other(a, b):
        names = b["vid"].to_numpy()
        q, c, bound = _matrix(a["qvec"], dim), _matrix(b["vec"], dim), np.array(a["bound"].to_numpy())
        home, block = a["qblock"].to_numpy(), b["block"].to_numpy()
        place = np.empty(len(names), np.int64)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        got = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for u in np.unique(block):
            mine = np.flatnonzero(block == u)
            z = c[mine]
            near = np.flatnonzero((box_distances(q, z.min(axis=0)[None], z.max(axis=0)[None])[:, 0] <= _reach(bound)) & (home != u))
            i, k, dist = nearest_within(q[near], bound[near], z, place[mine], keep)
            if not len(i):
                continue
            # the nearest so far tighten the bound of what follows
            i, k, dist = (np.concatenate(x) for x in zip(got, (near[i], mine[k], dist)))
            best = _first_of(i, place[k], dist, keep)
            got = i, k, dist = i[best], k[best], dist[best]
            last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == keep - 1)
            bound[i[last]] = np.minimum(bound[i[last]], dist[last])
        i, k, dist = got
        return pa.table({"vid": a["qid"].combine_chunks().take(pa.array(i)), "cvid": b["vid"].combine_chunks().take(pa.array(k)), "distance": pa.array(dist)})

    key = ["region", "share"]
    far = left.select(*key, "qid", "qvec", "bound", "qblock").repartition(tasks, *key).groupBy(*key).cogroup(
        right.select(*key, "vid", "vec", "block").repartition(tasks, *key).groupBy(*key)).applyInArrow(other, _NEAR)
    near = first.select("vid", F.explode(F.arrays_zip("cvids", "dists")).alias("x")).select("vid", F.col("x.cvids").alias("cvid"), F.col("x.dists").alias("distance"))
    return first, sent, near.unionAll(far)


def knn_all(df: DataFrame, k: int = 5, id_col: str = "customerID", vec: str = "vec",
            n_cells: int | None = None, seed: int = 42) -> DataFrame:
    """JON6 exact: k nearest rows of every row. Returns (id, rank, neighbor_id, distance)."""
    spark = df.sparkSession
    pts = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec"))

    # merge identical vectors: (vid, vec, m), named by the smallest id; first k+1 ids of each (window group limit)
    vecs = pts.groupBy("vec").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("vid"))
    path = scratch_path(spark, "knn-vectors")
    vecs.write.parquet(path)
    vecs = spark.read.parquet(path)
    by = W.partitionBy("vec").orderBy("id")
    first_ids = pts.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).select("vec", "id") \
        .join(vecs.select("vec", "vid"), "vec").select(F.col("vid").alias("cvid"), F.col("id").alias("neighbor_id"))
    n_distinct = vecs.count()
    if n_distinct == 0:
        return spark.createDataFrame([], "id string, rank int, neighbor_id string, distance double") \
            .withColumnRenamed("id", id_col)
    _, _, found = _exact_parts(vecs, n_distinct, k + 1, n_cells, seed)
    wv = W.partitionBy("vid").orderBy("distance", "cvid")
    best = found.withColumn("vr", F.row_number().over(wv)).where(F.col("vr") <= k + 1).select("vid", "cvid", "distance")

    # expand neighbour vectors to their first ids; first k+1 rows per member vector
    rows = best.join(first_ids, "cvid")
    wr = W.partitionBy("vid").orderBy("distance", "neighbor_id")
    lists = rows.withColumn("nr", F.row_number().over(wr)).where(F.col("nr") <= k + 1) \
        .groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("nr", "neighbor_id", "distance"))).alias("nb")) \
        .join(vecs.select("vid", "vec"), "vid")

    # every original row: its vector's list without itself, first k
    out = pts.join(lists, "vec").select("id", F.posexplode(F.slice(
        F.filter("nb", lambda x: x["neighbor_id"] != F.col("id")), 1, k)).alias("pos", "x"))
    return out.select(F.col("id").alias(id_col), (F.col("pos") + 1).cast("int").alias("rank"),
                      F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


DIRECTIONS, BLOCK_ROWS = 4, 256
SPAN = 16   # blocks to a task's group


def direction(t: int, dim: int) -> list[float]:
    """The t-th projection direction: components in [-1, 1) from md5, the same in any engine."""
    import hashlib
    return [int(hashlib.md5(f"{t}:{i}".encode()).hexdigest()[:8], 16) / 2147483648.0 - 1.0 for i in range(dim)]


def _places(pts: DataFrame, t: int, dim: int) -> DataFrame:
    """(id, vec, place): the row's place in the order of (projection, id) along direction t."""
    spark = pts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = F.zip_with("vec", F.array(*[F.lit(x) for x in direction(t, dim)]), lambda x, w: x * w)
    proj = F.round(F.aggregate(pieces, F.lit(0.0), lambda acc, x: acc + x), 6)
    path = scratch_path(spark, f"knn-order-{t}")
    # a range per partition; within it, places follow the sort
    pts.withColumn("proj", proj).repartitionByRange(n, "proj", "id").sortWithinPartitions("proj", "id") \
        .withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    part = F.shiftright("at", 33)
    rows = spark.read.parquet(path)
    sizes = {r["p"]: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}  # one row per partition
    before, total = {}, 0
    for q in sorted(sizes):
        before[q], total = total, total + sizes[q]
    first = F.create_map(*[x for q, v in before.items() for x in (F.lit(q), F.lit(v))]) if before else F.lit(None)
    return rows.select("id", "vec", (first[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def nearest_in_block(members, candidates, k: int):
    """k nearest candidates (not itself) of each member: arrays of member and candidate positions and distances.
    ``members`` and ``candidates``: (ids, vectors); sums run left to right, ties go to the smaller id."""
    import numpy as np
    (ids, a), (cids, c) = members, candidates
    if not len(ids) or not len(cids):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    again = int(np.unique(cids, return_counts=True)[1].max())   # rows that a member itself may take up
    i, j, dist = nearest_within(a, np.full(len(a), np.inf), c, cids, k + again)
    ok = (ids[i] != cids[j]) & np.isfinite(dist)
    i, j, dist = i[ok], j[ok], dist[ok]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], dist[first]


def _block_nearest(k: int):
    def run(left, right):
        import numpy as np
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series(dtype=object), "neighbor_id": pd.Series(dtype=object), "distance": pd.Series(dtype=float)})
        ids, cids = left["id"].to_numpy(), right["id"].to_numpy()
        i, j, d = nearest_in_block((ids, np.stack(left["vec"].to_numpy()).astype(float)),
                                   (cids, np.stack(right["vec"].to_numpy()).astype(float)), k)
        return pd.DataFrame({"id": ids[i], "neighbor_id": cids[j], "distance": d})
    return run


def _span_nearest(k: int, dim: int):
    """Near rows of the blocks of one span, each compared with itself and the two adjacent blocks."""
    def run(part):
        import numpy as np
        import pyarrow as pa
        order = np.argsort(part["place"].to_numpy(), kind="stable")
        ids, x = part["id"].to_numpy()[order], _matrix(part["vec"], dim)[order]
        b, g = part["b"].to_numpy()[order], part["g"].to_numpy()[0]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for u in np.unique(b[b // SPAN == g]):
            (lo, hi), (at, end) = np.searchsorted(b, [u, u + 1]), np.searchsorted(b, [u - 1, u + 2])
            i, j, dist = nearest_in_block((ids[lo:hi], x[lo:hi]), (ids[at:end], x[at:end]), k)
            found.append((i + lo, j + at, dist))
        i, j, dist = (np.concatenate(y) for y in zip(*found))
        return pa.table({"id": pa.array(ids[i], pa.string()), "neighbor_id": pa.array(ids[j], pa.string()), "distance": pa.array(dist)})
    return run


def knn_all_sorted(df: DataFrame, k: int = 5, id_col: str = "customerID", vec: str = "vec",
                   directions: int = DIRECTIONS, block: int = BLOCK_ROWS) -> DataFrame:
    """JON6 scale mode: min(k, rows - 1) near rows of every row, the nearest of all it is compared with.

    Work is rows x directions x 3 blocks. Returns (id, rank, neighbor_id, distance).
    """
    if block < k:
        raise ValueError("a block must hold k rows")
    pts = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    head = pts.select(F.size("vec")).first()
    if head is None:
        return df.sparkSession.createDataFrame([], "id string, rank int, neighbor_id string, distance double") \
            .withColumnRenamed("id", id_col)
    found, tasks = None, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for t in range(directions):
        at = _places(pts, t, head[0]).withColumn("b", F.floor(F.col("place") / block).cast("bigint"))
        # a span holds SPAN blocks, and the block on either side of them for comparison
        spans = F.array_distinct(F.transform(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1), lambda b: F.floor(b / SPAN).cast("bigint")))
        got = at.select("id", "vec", "place", "b", F.explode(spans).alias("g")).repartition(tasks, "g").groupBy("g").applyInArrow(
            _span_nearest(k, head[0]), "id string, neighbor_id string, distance double")
        found = got if found is None else found.unionAll(got)
    best = found.groupBy("id", "neighbor_id").agg(F.min("distance").alias("distance"))
    w = W.partitionBy("id").orderBy("distance", "neighbor_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("id").alias(id_col), "rank", "neighbor_id", "distance"))

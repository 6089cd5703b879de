"""Operator 4: embedding near-duplicates with product quantisation.

1. Identical vectors are grouped (added up before the shuffle); the groups'
   representatives, of unit length, are searched.
2. A coarse quantiser (about sqrt(n) k-means centres, at most ``MAX_LISTS``)
   and residual codebooks (256 centres per subspace) are fitted on the driver
   from ``SAMPLE_PER_LIST`` vectors a list, taken by hash of vec_id. The sample
   only shapes the index; every vector is indexed.
3. Each vector stands in the inverted list of its nearest centre with its
   residual's codes, and as a query goes to every list it probes: all lists
   whose bisecting plane to its own centre is within ``margin`` of it. A margin
   of the link radius would be lossless; the default, radius * min(1, 2.7 /
   sqrt(dimensions)), leaves out planes that a neighbour in a random direction
   crosses with probability below 1 %. A pair is missed only if both of its
   vectors miss the other's list.
4. In a list, a query's distances to all members are sums of looked-up
   subspace distances (asymmetric). With e the stored coding error of a member,
   its true distance is at least the looked-up one less e: members beyond the
   radius by that bound are dropped, which loses no link. All others get their
   exact cosine in double precision.

Lists are cut into blocks of at most ``MEMBERS`` x ``QUERIES`` rows, so a hot
list is many tasks. A block gives counts per vector and spanning edges of its
links, never pairs. Each pair is counted for both of its vectors: where the
other direction does not probe, the block counts for it.

Defined cases: a vector that is null, empty, all zero, or holds a null or
non-finite component, and a row without vec_id, links with nothing and is its
own component; vectors of different lengths never link; repeated rows count as
further vectors, and so do different vectors of one vec_id; an empty table gives no rows; further input columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components, label_components

COSINE = 0.9
MAX_LISTS, SAMPLE_PER_LIST, MAX_CENTRE_BYTES = 4096, 64, 1 << 26
MEMBERS, QUERIES = 2048, 4096
FOUND = "a bigint, b bigint, n bigint"


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres (fewer rows: the rows) by Lloyd's rounds."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        cut = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order][cut]] = np.add.reduceat(x[order], cut, axis=0) / np.diff(np.append(cut, len(x)))[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([(x[i:i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Index:
    """Fitted centres and codebooks; small, and shipped to every task."""

    def __init__(self, sample: np.ndarray, lists: int, radius: float, margin: float | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        self.radius = radius
        self.margin = radius * min(1.0, 2.7 / math.sqrt(dim)) if margin is None else margin
        self.centres = _kmeans(sample, lists, 10, rng)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        self.spaces = np.array_split(np.arange(dim), max(1, min(16, dim // 8)))
        self.books = [_kmeans(rest[:, s], 256, 6, rng) for s in self.spaces]
        self.apart = np.sqrt(np.maximum(((self.centres ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1) - 2 * self.centres @ self.centres.T), 0))

    @classmethod
    def load(cls, state: dict) -> "Index":
        """From ``vars`` of a fitted index: arrays only, so a broadcast needs no class on the workers."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list of each row, and (row, list) of every probe."""
        d2 = (x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres ** 2).sum(1)
        home = d2.argmin(axis=1)
        gap = d2 - d2[np.arange(len(x)), home][:, None]
        near = gap <= 2 * self.margin * self.apart[home]
        near[np.arange(len(x)), home] = True
        return home, *np.nonzero(near)

    def probed_back(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether row x of list ``home`` probes list ``other``."""
        c, o = self.centres[home], self.centres[other]
        gap = ((x - o) ** 2).sum(axis=1) - ((x - c) ** 2).sum(axis=1)
        return (home == other) | (gap <= 2 * self.margin * self.apart[home, other])

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) and coding errors of residuals."""
        rest = x - self.centres[home]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.spaces, self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - back) ** 2).sum(axis=1))

    def within(self, q: np.ndarray, home: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, member) pairs of one list that the looked-up distances cannot rule out."""
        rest = q - self.centres[home]
        d2 = np.zeros((len(q), len(codes)), np.float32)
        for m, (s, book) in enumerate(zip(self.spaces, self.books)):
            r = rest[:, s]
            lut = ((r * r).sum(1)[:, None] - 2 * r @ book.T + (book * book).sum(1)).astype(np.float32)
            d2 += lut[:, codes[:, m]]
        reach = (self.radius + error) ** 2 * (1 + 1e-4) + 1e-4
        return np.nonzero(d2 <= reach.astype(np.float32))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v, ok: whether the vector can link at all."""
    kind = embeddings.schema["embedding"].dataType
    v = F.col("`embedding`")
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        v = v.cast("array<double>")
    rows = embeddings.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("ok", F.col("vec_id").isNotNull() & F.coalesce(
        ~bad & F.exists("v", lambda x: x != 0), F.lit(False)))


def _units(v) -> np.ndarray:
    """Unit vectors (double) of a matrix or a list of vectors."""
    x = np.array(v, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _found(reps: DataFrame, dim: int, n: int, cosine: float, margin: float | None) -> DataFrame:
    """Rows (a, null, n): n links of a; rows (a, b, null): a and b are connected."""
    spark = reps.sparkSession
    lists = max(1, min(MAX_LISTS, int(math.sqrt(n)), MAX_CENTRE_BYTES // (8 * dim)))
    # the share of hashes that gives about the wanted number, and a limit for the rest of chance
    want = SAMPLE_PER_LIST * max(lists, 16)
    share = min(1.0, 1.2 * want / n)
    sample = reps.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) \
        .select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(want).toPandas()
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    # a table can be so small that no hash falls into the share; then one centre serves
    units = _units(sample["v"].tolist()) if len(sample) else np.ones((1, dim)) / math.sqrt(dim)
    # vectors travel as they were given, four bytes a component where those are floats, and are normalised again
    given = np.float32 if isinstance(reps.schema["v"].dataType.elementType, T.FloatType) else np.float64
    index = spark.sparkContext.broadcast(vars(Index(units, lists, radius, margin)))

    def place(members: bool):
        def run(stream):
            import pyarrow as pa

            ix = Index.load(index.value)
            for batch in stream:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    v = np.asarray(part.column("v").flatten(), given).reshape(part.num_rows, dim)
                    x, raw = _units(v), [r.tobytes() for r in v]
                    home, row, probe = ix.probes(x)
                    node, w = np.asarray(part.column("node")), np.asarray(part.column("w"))
                    if members:
                        codes, error = ix.encode(x, home)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(home.astype(np.int32)), pa.array(node), pa.array(w), pa.array(raw, pa.binary()),
                            pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], ["list", "node", "w", "x", "codes", "error"])
                    else:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(probe.astype(np.int32)), pa.array(node[row]), pa.array(w[row]), pa.array([raw[r] for r in row], pa.binary()),
                            pa.array(home[row].astype(np.int32))], ["list", "node", "w", "x", "home"])
        return run

    members = written(reps.mapInArrow(place(True), "list int, node bigint, w bigint, x binary, codes binary, error double"), "pq-lists")
    probing = reps.mapInArrow(place(False), "list int, node bigint, w bigint, x binary, home int")
    # one row per list, at most MAX_LISTS of them; the longest list probes itself, so both cuts follow its length
    size = {r["list"]: r["count"] for r in members.groupBy("list").count().collect()}
    cuts = spark.createDataFrame([(k, math.ceil(c / MEMBERS), math.ceil(c / QUERIES) + 7) for k, c in size.items()],
                                 "list int, m int, q int")
    salt = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(F.broadcast(cuts), "list").select("list", salt("m", 1).alias("mb"), "q", "node", "w", "x", "codes", "error") \
        .select("*", spread("q").alias("qb")).drop("q")
    right = probing.join(F.broadcast(cuts), "list").select("list", salt("q", 2).alias("qb"), "m", "node", "w", "x", "home") \
        .select("*", spread("m").alias("mb")).drop("m")

    def block(key, a, b):
        import pandas as pd

        out = pd.DataFrame({"a": pd.Series(dtype="Int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="Int64")})
        if not len(a) or not len(b):
            return out
        ix, home = Index.load(index.value), int(key[0])
        x = _units(np.frombuffer(b"".join(a["x"]), given).reshape(len(a), -1))
        q = _units(np.frombuffer(b"".join(b["x"]), given).reshape(len(b), -1))
        codes = np.frombuffer(b"".join(a["codes"]), np.uint8).reshape(len(a), -1)
        error, xn, qn = a["error"].to_numpy(), a["node"].to_numpy(), b["node"].to_numpy()
        xw, qw, q_home = a["w"].to_numpy(), b["w"].to_numpy(), b["home"].to_numpy()
        to_q, to_x = np.zeros(len(b), np.int64), np.zeros(len(a), np.int64)
        pairs_q, pairs_x = [], []
        for i in range(0, len(b), 512):
            r, j = ix.within(q[i:i + 512], home, codes, error)
            r = r + i
            for k in range(0, len(r), 1 << 16):
                rr, jj = r[k:k + (1 << 16)], j[k:k + (1 << 16)]
                cos = np.einsum("ij,ij->i", q[rr], x[jj])
                hit = (cos >= cosine) & (qn[rr] != xn[jj])
                rr, jj = rr[hit], jj[hit]
                np.add.at(to_q, rr, xw[jj])
                # the member's own search misses this query: count it here
                miss = ~ix.probed_back(x[jj], np.full(len(jj), home), q_home[rr])
                np.add.at(to_x, jj[miss], qw[rr[miss]])
                pairs_q.append(rr)
                pairs_x.append(jj)
        pq, px = np.concatenate(pairs_q or [to_q[:0]]), np.concatenate(pairs_x or [to_q[:0]])
        nodes, back = np.unique(np.concatenate([qn[pq], xn[px]]), return_inverse=True)
        root = label_components(len(nodes), back[:len(pq)], back[len(pq):])
        star = np.flatnonzero(root != np.arange(len(nodes)))
        some_q, some_x = np.flatnonzero(to_q), np.flatnonzero(to_x)
        null = pd.array([None] * (len(some_q) + len(some_x)), "Int64")
        return pd.DataFrame({
            "a": pd.array(np.concatenate([qn[some_q], xn[some_x], nodes[star]]), "Int64"),
            "b": pd.concat([pd.Series(null, dtype="Int64"), pd.Series(nodes[root[star]], dtype="Int64")], ignore_index=True),
            "n": pd.concat([pd.Series(np.concatenate([to_q[some_q], to_x[some_x]]), dtype="Int64"),
                            pd.Series([None] * len(star), dtype="Int64")], ignore_index=True)})

    return left.groupBy("list", "mb", "qb").cogroup(right.groupBy("list", "mb", "qb")).applyInPandas(block, FOUND)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, margin: float | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = usable(embeddings)
    # a number of its own for each vector, as different ones may share a vec_id
    reps = written(rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
                   .withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = None
    for r in reps.groupBy(F.size("v").alias("dim")).count().collect():  # one row per length of vector
        part = _found(reps.where(F.size("v") == r["dim"]), r["dim"], r["count"], cosine, margin)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame([], FOUND)
    found = written(found, "pq-found")
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    groups = reps.select("id", "node").join(roots, "node")  # only what is linked at all
    least = groups.groupBy("root").agg(F.min("id").alias("least"))
    # a component holds any part of the rows, so members are joined by their own number
    named = groups.select("node", "root").join(least, "root").select("node", "least")
    labels = reps.join(counts, "node", "left").join(named, "node", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    linked = rows.where("ok").join(labels, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)

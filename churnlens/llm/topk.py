"""Operator 5: exact top-k search by tiled matrix products.

Vectors become integers floor(scale * x). Queries are cut into blocks of
``QUERY_ROWS`` and candidates into shards of ``SHARD_ROWS`` rows by a hash of
vec_id. A tile is one block against one shard: one matrix product and each
query's k best of the shard. Those lists are merged up a tree with fan-in
``FAN``, so no step gathers more than FAN * k rows of a query at once.

All pairs of queries and candidates are scored, that is what exact means here;
each query block travels to every shard and back only as lists of k. So a
candidate is shuffled once per ``QUERY_ROWS`` queries and a query once per
``SHARD_ROWS`` candidates.

Products run in double precision where all sums are exactly representable
(below 2^53), else in whole numbers of any size; scores beyond 64 bits are
set to the nearest 64-bit value.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, as query or as candidate, nor does a null vec_id; vectors of
different lengths are not compared; empty vectors score 0 with each other;
equal scores go to the smaller vec_id; repeated rows with one vec_id are not
candidates of each other, and as candidates of others each fill a rank; rows
with one query id share one answer, the best of all of them; an empty table
gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, written

K, SCALE, EVERY = 20, 64, 20
QUERY_ROWS, SHARD_ROWS, FAN = 8192, 16384, 8
LEAST_ROWS, SCORED = 1024, 1 << 21  # of a shard that is made smaller to occupy all cores; scores held at a time


def whole(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of finite doubles) of the rows that take part."""
    rows = pick(embeddings, vec_id="vec_id bigint", v="embedding array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def _score(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products as int64 (queries x candidates)."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape).dot(
        np.array([[int(x) for x in r] for r in c], object).reshape(c.shape).T)
    lim = 2**63 - 1
    return np.array([[min(max(int(x), -lim - 1), lim) for x in r] for r in exact], np.int64).reshape(len(q), len(c))


def _best(score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (query, candidate) of each query's k best; candidates stand in ascending vec_id,
    ``own`` marks what a query must not find."""
    n = score.shape[1]
    small = n < 1 << 20 and int(np.abs(score).max(initial=0)) < 2**40
    if small:  # one key orders by score, then by place
        key = score * (1 << 20) + np.arange(n - 1, -1, -1)
        key[own] = np.iinfo(np.int64).min
        cut = np.argpartition(key, n - k, axis=1)[:, n - k:] if n > k else np.broadcast_to(np.arange(n), score.shape)
        rows = np.repeat(np.arange(len(score)), cut.shape[1])
        cols = cut.ravel()
    else:
        lists = [[j for j in np.lexsort((np.arange(n), -r.astype(object))) if not o[j]][:k] for r, o in zip(score, own)]
        rows = np.repeat(np.arange(len(score)), [len(x) for x in lists])
        cols = np.array([j for x in lists for j in x], np.int64)
    keep = ~own[rows, cols]
    return rows[keep], cols[keep]


def _top(column: str | Column, k: int) -> Column:
    """The k best of an array of (score, vec_id), best first."""
    return F.slice(F.array_sort(column, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
                                .when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)), 1, k)


def search(queries: DataFrame, candidates: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best candidates but itself."""
    def ready(df, name):
        # floor of what bigint cannot hold: a double that large is whole already
        v = F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("double")).otherwise(x * scale))
        return written(whole(df).select("vec_id", v.alias("v"), F.size("v").alias("dim")), name)

    q = ready(queries, "queries").dropDuplicates(["vec_id", "v"])
    c = ready(candidates, "candidates")
    n_q, n_c = q.count(), c.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n_q / QUERY_ROWS))
    shards = max(1, math.ceil(n_c / SHARD_ROWS), min(cores, math.ceil(n_c / LEAST_ROWS)))
    salt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    tiles = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("vec_id", "v", "dim", salt(blocks, 1).alias("block"), tiles(shards).alias("shard"))
    right = c.select("vec_id", "v", "dim", salt(shards, 2).alias("shard"), tiles(blocks).alias("block"))

    def tile(key, a, b):
        import pandas as pd

        b = b.sort_values("vec_id", kind="stable")
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            dim = int(key[2])
            av = np.array(a["v"].tolist(), np.float64).reshape(len(a), dim)
            bv = np.array(b["v"].tolist(), np.float64).reshape(len(b), dim)
            ids = b["vec_id"].to_numpy()
            step = max(1, SCORED // len(b))
            for i in range(0, len(a), step):
                who = a["vec_id"].to_numpy()[i:i + step]
                score = _score(av[i:i + step], bv)
                r, j = _best(score, who[:, None] == ids[None, :], k)
                out["query_id"].append(who[r])
                out["vec_id"].append(ids[j])
                out["score"].append(score[r, j])
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in out.items()}).assign(shard=int(key[1]))

    found = left.groupBy("block", "shard", "dim").cogroup(right.groupBy("block", "shard", "dim")).applyInPandas(
        tile, "query_id bigint, vec_id bigint, score bigint, shard int")
    lists = found.groupBy("query_id", "shard").agg(_top(F.collect_list(F.struct("score", "vec_id")), k).alias("best"))
    width = shards
    while width > 1:
        width = math.ceil(width / FAN)
        lists = lists.groupBy("query_id", F.floor(F.col("shard") / FAN).cast("int").alias("shard")) \
            .agg(_top(F.flatten(F.collect_list("best")), k).alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


def query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings.where(F.col("vec_id") % EVERY == 0), embeddings)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

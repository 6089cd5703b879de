"""Connected components of an edge table by alternating star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), both bigint; root is the
    smallest node of its component.

    Each round moves a node's larger neighbours to its smallest one, then its smaller ones.
    Minima are added up before the shuffle and joined back, so a node with very many edges is
    only a skewed join side. Each round's edges are written to the shared checkpoint folder;
    the number of rounds grows with the logarithm of the nodes.
    """
    def clean(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = written(clean(edges), "edges")
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = clean(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = written(large, "edges-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionAll(least.select("a", F.col("m").alias("b")))
        now = written(clean(small), "edges-small")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def label_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions by the edges (a, b) of one block."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            return label

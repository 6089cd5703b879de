"""Train / test splits keyed by a hash of the customer id.

A row's side depends only on its key and the seed, never on partitioning or
row order. The stratified split takes, per label, the round(test_size * n)
rows with the smallest (hash, id); the cut-off per label is found with
``hash_cut`` (a few small histogram jobs), then applied as a literal predicate:
no window over a whole label, no sort of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.scalars import keyed_hash, keyed_uniform
from churnlens.operators.select import hash_cut
from churnlens.schema import ID_COL, LABEL_COL, SEED, SPLIT_COL, TEST_SIZE


def stratified_split(df: DataFrame, label: str = LABEL_COL, test_size: float = TEST_SIZE,
                     seed: int = SEED, id_col: str = ID_COL) -> DataFrame:
    """SPL1: adds ``split`` = 'test' | 'train', stratified by ``label``."""
    h = df.withColumn("_h", keyed_hash(id_col, seed))
    cuts = hash_cut(h, "_h", id_col, label,
                    lambda totals: {g: _round_half_up(test_size * n) for g, n in totals.items()})
    is_test = F.lit(False)
    for g, (hv, idv) in cuts.items():
        is_test = is_test | ((F.col(label) == F.lit(g)) & (
            (F.col("_h") < F.lit(hv)) | ((F.col("_h") == F.lit(hv)) & (F.col(id_col) <= F.lit(idv)))))
    return h.withColumn(SPLIT_COL, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop("_h")


def _round_half_up(x: float) -> int:
    import math
    return int(math.floor(x + 0.5))


def random_split(df: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED,
                 id_col: str = ID_COL, names: tuple = ("fit", "valid")) -> DataFrame:
    """SPL2: plain keyed split, no stratification: ``part`` = names[1] when u < test_size."""
    return df.withColumn("part", F.when(keyed_uniform(id_col, seed) < F.lit(test_size),
                                        F.lit(names[1])).otherwise(F.lit(names[0])))


def head_sample(df: DataFrame, n: int = 200, seed: int = SEED, id_col: str = ID_COL) -> DataFrame:
    """SPL3: the first min(n, rows) rows in keyed-hash order (a top-n, not a sort)."""
    return (df.withColumn("_h", keyed_hash(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h"))


def split_check(df_split: DataFrame, id_col: str = ID_COL) -> DataFrame:
    """JON8: train and test are disjoint and together complete (semi / anti joins)."""
    train = df_split.where(F.col(SPLIT_COL) == "train").select(id_col)
    test = df_split.where(F.col(SPLIT_COL) == "test").select(id_col)
    overlap = train.join(test, id_col, "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))
    test_as_rest = df_split.select(id_col).join(train, id_col, "left_anti") \
        .join(test, id_col, "left_anti").agg(F.count(F.lit(1)).alias("n_unassigned"))
    totals = df_split.agg(F.count_if(F.col(SPLIT_COL) == "train").alias("n_train"),
                          F.count_if(F.col(SPLIT_COL) == "test").alias("n_test"),
                          F.count(F.lit(1)).alias("n_all"))
    return totals.select("*", overlap.scalar().alias("n_overlap"),
                         test_as_rest.scalar().alias("n_unassigned"))

"""Boosted-tree classifier: train, score, tune (TRN1, TRN2, SCR1, SNK4).

Spark's ``GBTClassifier`` replaces the reference's booster. Parameter mapping:
n_estimators -> maxIter, max_depth -> maxDepth, learning_rate -> stepSize,
subsample -> subsamplingRate, colsample_bytree -> featureSubsetStrategy (per
node in Spark, per tree in the reference), min_child_weight -> minInstancesPerNode
(a row count, not a hessian sum), gamma -> minInfoGain (other scale);
reg_alpha / reg_lambda have no Spark equivalent and are recorded only.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.schema import LABEL_COL, SCORE_COL
from churnlens.session import checkpoint_root

# --- Fixed values: the reference's defaults and search space ---
REFERENCE_DEFAULTS = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8,
                      "colsample_bytree": 0.8, "min_child_weight": 3, "gamma": 0.1, "reg_alpha": 0.1,
                      "reg_lambda": 1.0, "random_state": 42}
SEARCH_SPACE = {"n_estimators": ("int", 100, 500), "max_depth": ("int", 3, 10),
                "learning_rate": ("log", 0.01, 0.3), "subsample": ("float", 0.6, 1.0),
                "colsample_bytree": ("float", 0.6, 1.0), "min_child_weight": ("int", 1, 10),
                "gamma": ("float", 0.0, 1.0), "reg_alpha": ("float", 0.0, 1.0), "reg_lambda": ("float", 0.5, 2.0)}
# --- end of fixed values ---


#: Rows of a fit's partition, up to so many partitions; beyond them partitions grow to ``MOST_ROWS`` before there are more.
ROWS_PER_PARTITION, PARTITIONS, MOST_ROWS = 20_000, 24, 500_000


def fit_partitions(n: int) -> int:
    """Partitions of a fit over ``n`` rows, by the rows alone: every level of every tree is a job over all of them, and
    each of its tasks costs time to start and sends its metrics to the driver."""
    return max(1, min(math.ceil(n / ROWS_PER_PARTITION), PARTITIONS), math.ceil(n / MOST_ROWS))


def gbt_params(p: dict) -> dict:
    """Reference-style parameters to ``GBTClassifier`` keyword arguments."""
    return {
        "maxIter": int(p.get("n_estimators", REFERENCE_DEFAULTS["n_estimators"])),
        "maxDepth": int(p.get("max_depth", 6)),
        "stepSize": float(p.get("learning_rate", 0.05)),
        "subsamplingRate": float(p.get("subsample", 0.8)),
        "featureSubsetStrategy": repr(float(p.get("colsample_bytree", 0.8))),
        "minInstancesPerNode": int(p.get("min_child_weight", 3)),
        "minInfoGain": 0.0 if p.get("gamma") is None else float(p["gamma"]) * 0.01,
        "seed": int(p.get("random_state", 42)),
    }


def train(df: DataFrame, features: list[str], label: str = LABEL_COL, params: dict | None = None,
          weight_col: str | None = None,
          id_col: str = "customerID", max_memory_mb: int = 512) -> PipelineModel:
    """TRN1: assembler + GBT fitted on ``df`` (cached for the iterations).

    Row subsampling in Spark's trees is seeded per partition, so the rows are
    first hash-partitioned on the key and sorted within partitions: the same
    seed then gives the same model whatever the input partitioning was
    (``fit_partitions``).
    """
    assembler = _assembler(features)
    gbt = _booster(label, params, max_memory_mb)
    if weight_col:
        gbt.setWeightCol(weight_col)
    data = _settled(_fit_rows(df, features, label, id_col, [weight_col] if weight_col else [])).cache()
    try:
        return Pipeline(stages=[assembler, gbt]).fit(data)
    finally:
        data.unpersist()


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _booster(label: str, params: dict | None, max_memory_mb: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol=label, lossType="logistic", maxMemoryInMB=max_memory_mb,
                         **gbt_params({**REFERENCE_DEFAULTS, **(params or {})}))


def _fit_rows(df: DataFrame, features: list[str], label: str, id_col: str, more: list[str]) -> DataFrame:
    """The columns a fit reads, dealt by the key."""
    if id_col in df.columns:
        df = df.repartition(fit_partitions(df.count()), id_col).sortWithinPartitions(id_col)
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features],
                     F.col(label).cast("double").alias(label), *[F.col(c) for c in more])


def _settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed, its rows in the partitions and order they had: every task of every level
    of every tree is sent the plan its rows come from, and that of a balanced table takes longer to unpack than to run."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def score(model: PipelineModel, df: DataFrame, p: str = SCORE_COL, cut: float = 0.5) -> DataFrame:
    """SCR1 / SCR2: probability of class 1 and the class at ``cut``; all input columns kept."""
    out = model.transform(df)
    out = out.withColumn(p, vector_to_array("probability")[1])
    return out.withColumn("prediction", (F.col(p) >= F.lit(cut)).cast("int")) \
        .drop("features", "rawPrediction", "probability")


def draw_params(n_trials: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from the search space (replaces the reference's sampler)."""
    import random
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        p = {}
        for name, (kind, lo, hi) in SEARCH_SPACE.items():
            if kind == "int":
                p[name] = rng.randint(lo, hi)
            elif kind == "log":
                p[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            else:
                p[name] = rng.uniform(lo, hi)
        p["random_state"] = seed
        out.append(p)
    return out


#: Successive halving, where it is asked for: trees of the first rung, and how much fewer trials and more trees the next one has.
FIRST_TREES, ETA = 3, 3
SCORE_BINS = 2_000


def rungs(n_trials: int, most_trees: int, first: int = FIRST_TREES, eta: int = ETA) -> list[tuple[int, int | None]]:
    """(trials, trees) of every rung; None: as many trees as the trial asks for."""
    out, n, trees = [], n_trials, first
    while n > 2 and trees < most_trees:
        out.append((n, trees))
        n, trees = max(1, math.ceil(n / eta)), trees * eta
    return [*out, (n, None)]


def valid_measures(scored: DataFrame, label: str, p: str = SCORE_COL) -> tuple[float, float]:
    """(area under the curve over ``SCORE_BINS`` bins of the score, F1 of class 1), in one aggregate."""
    rows = scored.where(F.col(label).isNotNull()).groupBy(F.floor(F.col(p) * SCORE_BINS).alias("bin"), "prediction", (F.col(label) == 1).alias("y")).count().collect()
    pos, neg = {}, {}
    hit = miss = wrong = 0
    for r in rows:
        side = pos if r["y"] else neg
        side[r["bin"]] = side.get(r["bin"], 0) + r["count"]
        hit += r["count"] * (r["y"] and r["prediction"] == 1)
        miss += r["count"] * (r["y"] and r["prediction"] != 1)
        wrong += r["count"] * (not r["y"] and r["prediction"] == 1)
    below = area = 0
    for b in sorted({*pos, *neg}):
        area += pos.get(b, 0) * (below + neg.get(b, 0) / 2)
        below += neg.get(b, 0)
    every = sum(pos.values()) * below
    return (area / every if every else 0.5), (2 * hit / (2 * hit + miss + wrong) if hit else 0.0)


def tune(train_df: DataFrame, valid_df: DataFrame, features: list[str], label: str = LABEL_COL,
         n_trials: int = 50, seed: int = 42, parallelism: int = 8, id_col: str = "customerID",
         first_trees: int | None = None, eta: int = ETA, max_memory_mb: int = 512) -> tuple[dict, DataFrame]:
    """TRN2: search for the highest F1 of class 1 on ``valid_df``.

    Every trial is fitted on ``train_df`` with all the trees it asks for, those that
    ask for the most work first, so that no long fit begins when others are done.

    ``first_trees``: successive halving instead, a search that leaves trials early. All
    trials are fitted with so few trees; of each rung the best third by area under
    the curve goes on (F1 at one cut says nothing yet where small steps have not
    moved scores), with three times the trees. The last ones get the trees they ask
    for and stop early on the validation rows (``validationIndicatorCol``). A trial
    whose trees are all fitted is settled.

    Trials (of a rung) are independent Spark jobs run from a thread pool over one cached
    table. Returns the best parameters and the trials table (trial, params, f1, auc,
    rung, n_trees): the last fit of every trial; the best is that with the highest f1
    of the settled ones, ties to the smaller trial.
    """
    trials = draw_params(n_trials, seed)
    assembler = _assembler(features)
    mark = "_valid"
    # tables of their own: of one for both, every job of a fit would have a task for each partition of validation rows too
    fit_rows, valid = [_settled(assembler.transform(_fit_rows(df, features, label, id_col, [])).select("features", label)).cache()
                       for df in (train_df, valid_df)]
    state: dict[int, tuple] = {}

    def run(i: int, rung: int, trees: int | None) -> None:
        asked = int(trials[i]["n_estimators"])
        last = trees is None or trees >= asked
        gbt = _booster(label, trials[i] | {"n_estimators": asked if last else trees}, max_memory_mb)
        if trees is None and first_trees is not None:
            both = fit_rows.withColumn(mark, F.lit(False)).unionAll(valid.withColumn(mark, F.lit(True)))
            fitted = gbt.setValidationIndicatorCol(mark).setParams(validationTol=0.0).fit(both)
        else:
            fitted = gbt.fit(fit_rows)
        scored = fitted.transform(valid).withColumn(SCORE_COL, vector_to_array("probability")[1]) \
            .withColumn("prediction", (F.col(SCORE_COL) >= 0.5).cast("int"))
        auc, f1 = valid_measures(scored, label)
        state[i] = (rung, fitted.getNumTrees, auc, f1, last)

    most = max((t["n_estimators"] for t in trials), default=1)
    plan = [(n_trials, None)] if first_trees is None else rungs(n_trials, most, first_trees, eta)
    try:
        going = list(range(n_trials))
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for rung, (n, trees) in enumerate(plan):
                going = sorted(sorted(going, key=lambda i: (-state[i][2], i) if i in state else (0, i))[:n])
                todo = [i for i in going if i not in state or not state[i][4]]
                if trees is None:
                    todo.sort(key=lambda i: -trials[i]["n_estimators"] * trials[i]["max_depth"])
                list(pool.map(lambda i: run(i, rung, trees), todo))
                if all(state[i][4] for i in going):
                    break
    finally:
        fit_rows.unpersist()
        valid.unpersist()
    settled = [i for i in state if state[i][4]]
    best = max(settled, key=lambda i: (state[i][3], -i))
    schema = T.StructType([T.StructField("trial", T.IntegerType()),
                           T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
                           T.StructField("f1", T.DoubleType()), T.StructField("auc", T.DoubleType()),
                           T.StructField("rung", T.IntegerType()), T.StructField("n_trees", T.IntegerType())])
    table = train_df.sparkSession.createDataFrame(
        [(i, {k: float(v) for k, v in trials[i].items()}, float(f1), float(auc), rung, int(trees))
         for i, (rung, trees, auc, f1, _) in sorted(state.items())], schema)
    return trials[best], table

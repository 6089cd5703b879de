"""Scores, bands, filters, risk aggregates and the high-risk view.

All aggregates are global or grouped by a handful of keys (partial aggregation
on each partition, a tiny final stage); filters are plain predicates that
Catalyst pushes into the Parquet scan when they touch raw columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from churnlens.functions.scalars import (BAND_HIGH, BAND_LOW, BAND_MEDIUM, keyed_hash, label_text,
                                         percent_text, predict_class, risk_band, risk_bin)
from churnlens.schema import (CHARGES_RANGE, HIGH_RISK, ID_COL, LABEL_COL, MEDIUM_RISK, SCORE_COL,
                              TENURE_RANGE)


# ---------------------------------------------------------------- scalars on tables

def predict(df: DataFrame, cut: float = 0.5, p: str = SCORE_COL) -> DataFrame:
    return df.withColumn("prediction", predict_class(p, cut))


def with_risk_band(df: DataFrame, p: str = SCORE_COL, hi: float = HIGH_RISK,
                   lo: float = MEDIUM_RISK) -> DataFrame:
    return df.withColumn("risk_band", risk_band(p, hi, lo))


def with_risk_bin(df: DataFrame, p: str = SCORE_COL) -> DataFrame:
    return df.withColumn("risk_bin", risk_bin(p))


# ---------------------------------------------------------------- filters

def filter_predicate(df: DataFrame, contracts: list[str] | None = None,
                     tenure: tuple = TENURE_RANGE, charges: tuple = CHARGES_RANGE) -> Column:
    """FLT1 predicate on raw columns: empty / None contract list means no filter."""
    pred = F.lit(True)
    if contracts and "Contract" in df.columns:
        pred = pred & F.col("Contract").isin(list(contracts))
    if tenure is not None and "tenure" in df.columns:
        pred = pred & F.col("tenure").between(tenure[0], tenure[1])
    if charges is not None and "MonthlyCharges" in df.columns:
        pred = pred & F.col("MonthlyCharges").between(charges[0], charges[1])
    return pred


def apply_filters(df: DataFrame, contracts: list[str] | None = None,
                  tenure: tuple = TENURE_RANGE, charges: tuple = CHARGES_RANGE) -> DataFrame:
    return df.where(filter_predicate(df, contracts, tenure, charges))


def filter_coverage(df: DataFrame, pred: Column) -> DataFrame:
    """FLT2: rows shown and rows in all, one aggregate."""
    return df.agg(F.count_if(F.coalesce(pred, F.lit(False))).alias("n_shown"),
                  F.count(F.lit(1)).alias("n_total"))


def high_risk(df: DataFrame, threshold: float = HIGH_RISK, p: str = SCORE_COL) -> DataFrame:
    """FLT3: rows with score >= threshold."""
    return df.where(F.col(p) >= F.lit(threshold))


def risk_pool(df: DataFrame, group: str = "all", p: str = SCORE_COL) -> DataFrame:
    """FLT4: high (>= .7), medium ([.4, .7)), low (< .4) or all."""
    s = F.col(p)
    if group == "high":
        return df.where(s >= HIGH_RISK)
    if group == "medium":
        return df.where((s >= MEDIUM_RISK) & (s < HIGH_RISK))
    if group == "low":
        return df.where(s < MEDIUM_RISK)
    return df


def sample_per_band(df: DataFrame, n: int = 1, seed: int = 42, p: str = SCORE_COL) -> DataFrame:
    """FLT5: n reproducible picks per risk band, ranked by a keyed hash.

    ``row_number() <= n`` is planned as a window group limit: each partition
    keeps its n best rows per band before the shuffle, so a band holding most
    rows still moves only n rows per partition.
    """
    banded = df.withColumn("risk_band", risk_band(p)).withColumn("_h", keyed_hash(ID_COL, seed))
    w = W.partitionBy("risk_band").orderBy("_h", ID_COL)
    return (banded.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)
            .drop("_h"))


# ---------------------------------------------------------------- aggregates

def risk_kpis(df: DataFrame, p: str = SCORE_COL, by: list[str] | None = None) -> DataFrame:
    """AGG1: counts and shares per band (fixed 0.7 / 0.4) and the mean score."""
    s = F.col(p)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"),
        F.count_if(s >= HIGH_RISK).alias("n_high"),
        F.count_if((s >= MEDIUM_RISK) & (s < HIGH_RISK)).alias("n_medium"),
        F.count_if(s < MEDIUM_RISK).alias("n_low"),
        F.avg(s).alias("mean_score"),
    ]
    g = df.groupBy(*by) if by else df
    out = g.agg(*aggs)
    return out.withColumns({
        "share_high": F.try_divide(F.col("n_high"), F.col("n")),
        "share_medium": F.try_divide(F.col("n_medium"), F.col("n")),
        "share_low": F.try_divide(F.col("n_low"), F.col("n")),
    })


def risk_distribution(df: DataFrame, p: str = SCORE_COL) -> DataFrame:
    """AGG2: rows per right-closed risk bin (null bin kept as a group)."""
    return df.groupBy(risk_bin(p).alias("risk_bin")).agg(F.count(F.lit(1)).alias("n"))


def score_histogram(df: DataFrame, bins: int = 40, p: str = SCORE_COL) -> DataFrame:
    """AGG3: fixed-width histogram on [0, 1], empty bins kept.

    The bin table has ``bins`` rows (a parameter, not data): it is the
    broadcast side of the join.
    """
    spark = df.sparkSession
    b = F.least(F.floor(F.col(p) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin",
                    (F.col("bin") / F.lit(float(bins))).alias("lower"),
                    ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n")))


# ---------------------------------------------------------------- joins and views

def attach_raw(scored: DataFrame, raw: DataFrame, how: str = "inner") -> DataFrame:
    """JON1: raw attributes for the scored rows, equi-join on the key.

    Both sides can be large: AQE turns it into a broadcast join when one side
    is measured small at run time, otherwise it is a sort-merge join on the key.
    """
    dup = [c for c in raw.columns if c in scored.columns and c != ID_COL]
    return scored.join(raw.drop(*dup), ID_COL, how)


def attach_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """JON2: scores (and labels) beside the feature columns, by key."""
    dup = [c for c in scores.columns if c in df.columns and c != ID_COL]
    return df.drop(*dup).join(scores, ID_COL, "inner")


HIGH_RISK_VIEW_COLS = ["tenure", "MonthlyCharges", "TotalCharges"]


def high_risk_view(df: DataFrame, threshold: float = HIGH_RISK, p: str = SCORE_COL) -> DataFrame:
    """PRJ1: display columns present, probability, band, true label, percent text."""
    cols = [c for c in HIGH_RISK_VIEW_COLS if c in df.columns]
    extra = [F.col(LABEL_COL).alias("true_label")] if LABEL_COL in df.columns else []
    return high_risk(df, threshold, p).select(
        ID_COL, *cols, F.col(p).alias(SCORE_COL), risk_band(p).alias("risk_band"), *extra,
        percent_text(p).alias("proba_text"))


def top_high_risk(df: DataFrame, threshold: float = HIGH_RISK, n: int = 50,
                  p: str = SCORE_COL) -> DataFrame:
    """TOP1: the first n high-risk rows by score (desc), ties by key, with their position."""
    top = high_risk_view(df, threshold, p).orderBy(F.col(SCORE_COL).desc(), ID_COL).limit(n)  # n rows
    return top.withColumn("position", F.row_number().over(W.orderBy(F.col(SCORE_COL).desc(), ID_COL)))


def label_texts(df: DataFrame) -> DataFrame:
    return df.withColumn("label_text", label_text(LABEL_COL))


__all__ = ["predict", "with_risk_band", "with_risk_bin", "apply_filters", "filter_predicate",
           "filter_coverage", "high_risk", "risk_pool", "sample_per_band", "risk_kpis",
           "risk_distribution", "score_histogram", "attach_raw", "attach_scores", "high_risk_view",
           "top_high_risk", "label_texts", "BAND_HIGH", "BAND_MEDIUM", "BAND_LOW"]

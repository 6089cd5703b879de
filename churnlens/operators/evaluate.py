"""Evaluation of a scored table: confusion, class report, exact ROC-AUC, curves.

Curves need running totals over the distinct scores in order. Instead of one
window over the whole table (a single task), ``running_totals`` cuts the score
range into buckets at approximate quantiles, sums each bucket (a few rows to
the driver), and runs the window per bucket with the bucket offset added: the
work is spread over as many tasks as there are buckets and the result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from churnlens.schema import LABEL_COL, SCORE_COL
from churnlens.session import scratch_path


def score_counts(df: DataFrame, label: str = LABEL_COL, p: str = SCORE_COL,
                 bins: int | None = None) -> DataFrame:
    """(score, pos, neg) per distinct score; ``bins`` rounds scores down to a grid first."""
    s = F.col(p).cast("double")
    if bins:
        s = F.floor(s * F.lit(float(bins))) / F.lit(float(bins))
    return (df.where(F.col(p).isNotNull() & F.col(label).isNotNull())
            .groupBy(s.alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))


def running_totals(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over rows with key <= this key (keys distinct).

    Rows are range-partitioned on the key and written once to the shared checkpoint
    folder with their range's number. A range's window runs in its own task; the sums of
    the ranges before it come from one row per range (as many as shuffle partitions).
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "running-totals")
    df.repartitionByRange(n, key).withColumn("_b", F.spark_partition_id()).write.parquet(path)
    bucketed = spark.read.parquet(path)
    totals = bucketed.groupBy("_b").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    offsets, acc = {}, {c: 0 for c in cols}
    for row in sorted(totals, key=lambda r: r["_b"]):
        offsets[row["_b"]] = dict(acc)
        for c in cols:
            acc[c] += row[c] or 0
    off = spark.createDataFrame([(b, *[int(o[c]) for c in cols]) for b, o in offsets.items()],
                                ", ".join(["_b int"] + [f"_off_{c} bigint" for c in cols]))
    w = W.partitionBy("_b").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = bucketed.join(F.broadcast(off), "_b", "left")
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(w) + F.coalesce(F.col(f"_off_{c}"), F.lit(0)))
    return out.drop("_b", *[f"_off_{c}" for c in cols])


def confusion(df: DataFrame, label: str = LABEL_COL, pred: str = "prediction") -> DataFrame:
    """EVL1: 2 x 2 matrix as (label, prediction, n), zero cells kept; one aggregate."""
    y, p = F.col(label), F.col(pred)
    wide = df.agg(F.count_if((y == 0) & (p == 0)).alias("c00"), F.count_if((y == 0) & (p == 1)).alias("c01"),
                  F.count_if((y == 1) & (p == 0)).alias("c10"), F.count_if((y == 1) & (p == 1)).alias("c11"))
    return wide.select(F.explode(F.array(
        *[F.struct(F.lit(a).alias(label), F.lit(b).alias(pred), F.col(f"c{a}{b}").alias("n"))
          for a in (0, 1) for b in (0, 1)])).alias("cell")).select("cell.*")


def _div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(df: DataFrame, label: str = LABEL_COL, pred: str = "prediction") -> DataFrame:
    """EVL2: precision, recall, f1, support per class, macro and weighted averages, accuracy.

    Undefined ratios are 0. One aggregate; the report rows are built from it.
    """
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count_if((y == 1) & (p == 1)).cast("double").alias("tp"),
               F.count_if((y == 0) & (p == 1)).cast("double").alias("fp"),
               F.count_if((y == 1) & (p == 0)).cast("double").alias("fn"),
               F.count_if((y == 0) & (p == 0)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1 = _div(2 * p1 * r1, p1 + r1)
    f0 = _div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    acc = _div(tp + tn, n)
    def row(name, prec, rec, f, sup):
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"), f.alias("f1"),
                        sup.alias("support"))
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n), _div(f0 * s0 + f1 * s1, n), n),
        row("accuracy", acc, acc, acc, n),
    )
    return c.select(F.explode(rows).alias("r")).select(
        "r.class", "r.precision", "r.recall", "r.f1", F.col("r.support").cast("bigint").alias("support"))


def f1_of_class1(df: DataFrame, label: str = LABEL_COL, pred: str = "prediction") -> float:
    """The tuning metric: F1 of the churn class, one aggregate, a scalar to the driver."""
    row = class_report(df, label, pred).where(F.col("class") == "1").first()
    return float(row["f1"])


def roc_auc(df: DataFrame, label: str = LABEL_COL, p: str = SCORE_COL) -> DataFrame:
    """EVL3: exact ROC-AUC, tied scores counted half: sum(pos * (neg below + neg / 2)) / (P * N)."""
    sc = running_totals(score_counts(df, label, p), "score", ["neg"])
    return sc.agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = LABEL_COL, p: str = SCORE_COL,
               bins: int | None = None) -> DataFrame:
    """EVL4: (threshold, fpr, tpr) for every distinct score, plus the origin (threshold null: above every score)."""
    sc = running_totals(score_counts(df, label, p, bins), "score", ["pos", "neg"])
    pts = sc.withColumns({"P": sc.select(F.sum("pos")).scalar(), "N": sc.select(F.sum("neg")).scalar()})
    pts = pts.select(F.col("score").alias("threshold"),
                     _div((F.col("N") - F.col("cum_neg") + F.col("neg")).cast("double"), F.col("N")).alias("fpr"),
                     _div((F.col("P") - F.col("cum_pos") + F.col("pos")).cast("double"), F.col("P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                                             F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def pr_points(df: DataFrame, label: str = LABEL_COL, p: str = SCORE_COL,
              bins: int | None = None) -> DataFrame:
    """EVL5: (threshold, precision, recall) per distinct score, plus the end point (1, 0) with a null threshold."""
    sc = running_totals(score_counts(df, label, p, bins), "score", ["pos", "neg"])
    pts = sc.withColumns({"P": sc.select(F.sum("pos")).scalar(), "N": sc.select(F.sum("neg")).scalar()})
    tps = (F.col("P") - F.col("cum_pos") + F.col("pos")).cast("double")
    fps = (F.col("N") - F.col("cum_neg") + F.col("neg")).cast("double")
    pts = pts.select(F.col("score").alias("threshold"), _div(tps, tps + fps).alias("precision"),
                     _div(tps, F.col("P")).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                          F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def evaluate(df: DataFrame, label: str = LABEL_COL, p: str = SCORE_COL, cut: float = 0.5) -> dict:
    """EVL6: metrics bundle as small DataFrames (and two scalars)."""
    pred = df.withColumn("prediction", (F.col(p) >= cut).cast("int"))
    report = class_report(pred, label)
    auc = roc_auc(df, label, p).first()["roc_auc"]
    f1 = report.where(F.col("class") == "1").first()["f1"]
    return {"f1": f1, "roc_auc": auc, "confusion": confusion(pred, label), "class_report": report,
            "roc": roc_points(df, label, p), "pr": pr_points(df, label, p)}

"""End-to-end jobs: preparation (PIP1) and training (PIP2).

Each is a driver function composing lazy DataFrame operators; the encoded
table is written once to the shared checkpoint folder, because the split, the
scaler and SMOTE read it several times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import evaluate, explain, model as M, prepare, profile, split as splitting, treeshap
from churnlens.operators.balance import smote
from churnlens.schema import ID_COL, LABEL_COL, SEED, TEST_SIZE
from churnlens.session import scratch_path
from churnlens.sources import io


def prepare_data(df_raw: DataFrame, test_size: float = TEST_SIZE, seed: int = SEED,
                 use_smote: bool = True, out_dir: str | None = None, fit_on: str = "all", knn: str = "sorted") -> dict:
    """PIP1: clean -> encode -> split -> test ids -> scale (fit on train, before
    balancing) -> SMOTE on train -> optional write. Returns tables and state.

    ``fit_on='all'`` fits the fill median on every row, as the reference does
    (test rows leak into it); ``fit_on='train'`` fits it on the training rows
    only. The split depends on the key and label alone, so it is known before
    cleaning. ``knn`` is SMOTE's neighbour mode.
    """
    medians = None
    if fit_on == "train":
        keys = splitting.stratified_split(
            df_raw.select(ID_COL, prepare.encode_target_col().alias(LABEL_COL)), LABEL_COL, test_size, seed)
        train_raw = df_raw.join(keys.where(F.col("split") == "train").select(ID_COL), ID_COL, "left_semi")
        medians = {"TotalCharges": prepare.fit_median(train_raw, "TotalCharges")}
    cleaned, medians = prepare.clean(df_raw, medians)
    cats = prepare.fit_categories(cleaned)
    path = scratch_path(df_raw.sparkSession, "encoded")
    prepare.encode_features(cleaned, cats).write.parquet(path)
    enc = df_raw.sparkSession.read.parquet(path)
    feats = prepare.encoded_feature_names(enc)
    sp = splitting.stratified_split(enc, LABEL_COL, test_size, seed)
    stats = prepare.fit_scaler(sp.where(F.col("split") == "train"))
    scaled = prepare.apply_scaler(sp, stats)
    train = scaled.where(F.col("split") == "train")
    test = scaled.where(F.col("split") == "test")
    train_bal = smote(train, feats, LABEL_COL, k=5, seed=seed, knn=knn) if use_smote else \
        train.select(ID_COL, LABEL_COL, F.lit(0).alias("is_synthetic"), *[F.col(f"`{f}`") for f in feats])
    if use_smote:
        # the balanced table is the end of a long plan (kNN, copies): write it once to
        # the shared checkpoint folder so training and counts read it, not recompute it
        path = scratch_path(df_raw.sparkSession, "train-balanced")
        train_bal.write.mode("overwrite").parquet(path)
        train_bal = df_raw.sparkSession.read.parquet(path)
    fitted = prepare.Fitted(cats, medians, stats, tuple(feats))
    if out_dir:
        io.write_processed(scaled, f"{out_dir}/processed")
        io.test_ids(scaled).write.mode("overwrite").parquet(f"{out_dir}/test_ids")
        io.save_stats(prepare.scaler_table(df_raw.sparkSession, stats, medians), f"{out_dir}/scaler")
    return {"raw": df_raw, "cleaned": cleaned, "encoded": enc, "split": scaled, "train": train,
            "train_balanced": train_bal, "test": test, "fitted": fitted, "features": feats}


def prepare_counts(prep: dict) -> DataFrame:
    """Rows per step of PIP1 (one small aggregate per table)."""
    spark = prep["raw"].sparkSession
    rows = [(name, prep[name].count()) for name in ("raw", "cleaned", "encoded", "train", "test", "train_balanced")]
    return spark.createDataFrame(rows, "stage string, n bigint")


def train_job(spark: SparkSession, path: str, out_dir: str | None = None, optimize: bool = False,
              fmt: str = "parquet", n_trials: int = 50, params: dict | None = None,
              explain_rows: int = 200) -> dict:
    """PIP2: load -> profile -> prepare -> (tune) -> train -> evaluate -> save ->
    explain a keyed sample -> top importances."""
    raw = io.load_customers(spark, path, fmt)
    churn = profile.churn_rate(raw).first()["churn_rate"]
    prep = prepare_data(raw)
    feats = prep["features"]
    trials = None
    if optimize:
        # validate on unbalanced rows (keyed 20 % of train), balance only the fitting part
        # another seed than the test split, whose hash the rows of train have already passed
        parts = splitting.random_split(prep["train"], TEST_SIZE, SEED + 1)
        fit_rows = smote(parts.where(F.col("part") == "fit").drop("part", "split"), feats, LABEL_COL, knn="sorted")
        valid = parts.where(F.col("part") == "valid")
        params, trials = M.tune(fit_rows, valid, feats, LABEL_COL, n_trials=n_trials)
    model = M.train(prep["train_balanced"], feats, LABEL_COL, params)
    scored = M.score(model, prep["test"])
    metrics = evaluate.evaluate(scored, LABEL_COL)
    if out_dir:
        io.save_model(model, f"{out_dir}/model")
    sample = splitting.head_sample(prep["test"], explain_rows)
    attr, base = treeshap.tree_shap(model, sample, feats)
    importance = explain.global_importance(attr, 10)
    return {"churn_rate": churn, "model": model, "metrics": metrics, "scored": scored, "importance": importance,
            "base_value": base, "trials": trials, "prepared": prep}


def main(argv: list[str] | None = None) -> None:
    """``spark-submit churnlens/plans/jobs.py <customers> <out_dir> [--csv] [--optimize] [--trials N]``."""
    import argparse
    import json
    ap = argparse.ArgumentParser(description="Train, evaluate and explain the churn model.")
    ap.add_argument("path")
    ap.add_argument("out_dir")
    ap.add_argument("--csv", action="store_true", help="input is CSV with a header (default: Parquet)")
    ap.add_argument("--optimize", action="store_true", help="random search before the final fit")
    ap.add_argument("--trials", type=int, default=50)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("churnlens-train").getOrCreate()
    out = train_job(spark, args.path, args.out_dir, args.optimize, "csv" if args.csv else "parquet", args.trials)
    out["metrics"]["class_report"].write.mode("overwrite").parquet(f"{args.out_dir}/class_report")
    out["metrics"]["roc"].write.mode("overwrite").parquet(f"{args.out_dir}/roc")
    out["importance"].write.mode("overwrite").parquet(f"{args.out_dir}/importance")
    print(json.dumps({"churn_rate": out["churn_rate"], "f1": out["metrics"]["f1"],
                      "roc_auc": out["metrics"]["roc_auc"], "base_value": out["base_value"]}))


if __name__ == "__main__":
    main()

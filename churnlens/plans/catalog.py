"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Each reads the driver's tables (or tables Spark derives from them) in full.
Doubles that come out of sums or averages are rounded to 6 digits so the
results compare by value with the DuckDB oracle (``oracle.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions import scalars as S
from churnlens.operators import evaluate, explain, messages, neighbors, prepare, profile, risk, segments, treeshap
from churnlens.operators import model as M
from churnlens.operators import split as splitting
from churnlens.plans import jobs
from churnlens.plans import tables as TB
from churnlens.session import scratch_path
from churnlens.sources import io
from churnlens.schema import CATEGORICAL_COLS, ID_COL, LABEL_COL, NUMERIC_COLS, SCORE_COL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ================================================================ flagship

@query("risk_kpis_by_contract")
def q_risk_kpis_by_contract(spark, sf):
    """customers -> clean -> score -> band -> KPIs per contract."""
    k = risk.risk_kpis(TB.scored(spark, sf), by=["Contract"])
    return k.select("Contract", "n", "n_high", "n_medium", "n_low", r6("mean_score").alias("mean_score"),
                    r6("share_high").alias("share_high"), r6("share_medium").alias("share_medium"),
                    r6("share_low").alias("share_low")).orderBy("Contract")


# ================================================================ sources / profile

@query("customers")
def q_customers(spark, sf):
    return TB.customers(spark, sf)


@query("table_shape")
def q_table_shape(spark, sf):
    return profile.table_shape(TB.customers(spark, sf))


@query("missing_counts")
def q_missing_counts(spark, sf):
    return profile.missing_counts(TB.customers(spark, sf))


@query("churn_rate")
def q_churn_rate(spark, sf):
    return profile.churn_rate(TB.customers(spark, sf)).select(r6("churn_rate").alias("churn_rate"))


@query("value_shares")
def q_value_shares(spark, sf):
    v = profile.value_shares(TB.customers(spark, sf), "Contract")
    return v.select("value", "n", r6("share").alias("share"))


@query("null_total")
def q_null_total(spark, sf):
    raw = TB.customers(spark, sf)
    num = prepare.to_number(raw, "TotalCharges")
    return profile.null_totals({"raw": raw, "to_number": num, "cleaned": TB.cleaned(spark, sf),
                                "encoded": TB.encoded(spark, sf)})


@query("class_counts")
def q_class_counts(spark, sf):
    return profile.class_counts(TB.encoded(spark, sf), LABEL_COL)


# ================================================================ cleaning / encoding

@query("to_number")
def q_to_number(spark, sf):
    raw = TB.customers(spark, sf)
    return raw.select(ID_COL, F.col("TotalCharges").alias("TotalCharges_text"),
                      prepare.to_number_col("TotalCharges").alias("TotalCharges"))


@query("fill_median")
def q_fill_median(spark, sf):
    return prepare.fill_median(TB.customers(spark, sf), "TotalCharges").select(ID_COL, "TotalCharges")


@query("feature_columns")
def q_feature_columns(spark, sf):
    enc = TB.encoded(spark, sf)
    names = prepare.encoded_feature_names(enc)
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position int, feature string")


@query("encode_service")
def q_encode_service(spark, sf):
    df = prepare.encode_service(TB.cleaned(spark, sf))
    from churnlens.schema import SERVICE_COLS
    return df.select(ID_COL, *SERVICE_COLS)


@query("fill_zero")
def q_fill_zero(spark, sf):
    from churnlens.schema import SERVICE_COLS
    df = prepare.fill_zero(prepare.encode_service(TB.cleaned(spark, sf)), SERVICE_COLS)
    return df.select(ID_COL, *SERVICE_COLS)


@query("encode_target")
def q_encode_target(spark, sf):
    return prepare.encode_target(TB.cleaned(spark, sf)).select(ID_COL, LABEL_COL)


@query("encode_binary")
def q_encode_binary(spark, sf):
    cols = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "MultipleLines"]
    return prepare.encode_binary(TB.cleaned(spark, sf), cols).select(ID_COL, *cols)


@query("encode_gender")
def q_encode_gender(spark, sf):
    return prepare.encode_gender(TB.cleaned(spark, sf)).select(ID_COL, "gender")


@query("one_hot")
def q_one_hot(spark, sf):
    c = TB.cleaned(spark, sf)
    cats = prepare.fit_categories(c, CATEGORICAL_COLS)
    oh = prepare.one_hot(c, cats)
    return oh.select(ID_COL, *[f"`{n}`" for n in prepare.one_hot_cols(cats)])


@query("one_hot_sparse")
def q_one_hot_sparse(spark, sf):
    """Sparse one-hot of the categorical columns and of one with as many levels as rows."""
    c = TB.cleaned(spark, sf).select(ID_COL, *CATEGORICAL_COLS, F.col(ID_COL).alias("name"))
    cols = [*CATEGORICAL_COLS, "name"]
    out = prepare.one_hot_sparse(c, prepare.level_table(c, cols), cols)
    return out.select(ID_COL, F.col("one_hot.size").alias("size"), F.array_join("one_hot.indices", ",").alias("indices"),
                      F.aggregate("one_hot.values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("encode_features")
def q_encode_features(spark, sf):
    return TB.encoded(spark, sf)


@query("fit_scaler")
def q_fit_scaler(spark, sf):
    s = TB.split(spark, sf)
    stats = prepare.fit_scaler(s.where(F.col("split") == "train"), NUMERIC_COLS)
    _, medians = prepare.clean(TB.customers(spark, sf))
    t = prepare.scaler_table(spark, stats, medians)
    return t.select(F.col("column").alias("column_name"), r6("mean").alias("mean"), r6("std").alias("std"),
                    r6("median").alias("median"))


@query("apply_scaler")
def q_apply_scaler(spark, sf):
    df, _ = TB.scaled_split(spark, sf)
    return df.select(ID_COL, "split", *[r6(c).alias(c) for c in NUMERIC_COLS])


@query("encode_with")
def q_encode_with(spark, sf):
    raw = TB.customers(spark, sf)
    s = TB.split(spark, sf)
    fitted = prepare.fit(raw, s.where(F.col("split") == "train").select(ID_COL))
    enc = prepare.encode_with(raw.drop("Churn"), fitted)
    return enc.select(ID_COL, *[(r6(c) if c in fitted.scaler else F.col(f"`{c}`")).alias(c)
                                for c in fitted.features])


# ================================================================ splits

@query("stratified_split")
def q_stratified_split(spark, sf):
    return TB.split(spark, sf).select(ID_COL, LABEL_COL, "split")


@query("split_check")
def q_split_check(spark, sf):
    return splitting.split_check(TB.split(spark, sf))


@query("random_split")
def q_random_split(spark, sf):
    train = TB.split(spark, sf).where(F.col("split") == "train")
    return splitting.random_split(train).select(ID_COL, "part")


@query("head_sample")
def q_head_sample(spark, sf):
    test = TB.split(spark, sf).where(F.col("split") == "test")
    return splitting.head_sample(test, 200).select(ID_COL, LABEL_COL)


# ================================================================ scores, bands, filters

@query("predict")
def q_predict(spark, sf):
    return risk.predict(TB.scored(spark, sf)).select(ID_COL, SCORE_COL, "prediction")


@query("risk_band")
def q_risk_band(spark, sf):
    return risk.with_risk_band(TB.scored(spark, sf)).select(ID_COL, SCORE_COL, "risk_band")


@query("risk_bin")
def q_risk_bin(spark, sf):
    return risk.with_risk_bin(TB.scored(spark, sf)).select(ID_COL, SCORE_COL, "risk_bin")


@query("label_text")
def q_label_text(spark, sf):
    return risk.label_texts(TB.scored(spark, sf)).select(ID_COL, LABEL_COL, "label_text")


@query("percent_text")
def q_percent_text(spark, sf):
    return TB.scored(spark, sf).select(ID_COL, SCORE_COL, S.percent_text(SCORE_COL).alias("proba_text"))


@query("high_risk")
def q_high_risk(spark, sf):
    return risk.high_risk(TB.scored(spark, sf), 0.7).select(ID_COL, SCORE_COL)


@query("risk_pool")
def q_risk_pool(spark, sf):
    sc = TB.scored(spark, sf)
    parts = [risk.risk_pool(sc, g).select(F.lit(g).alias("pool"), ID_COL) for g in ("high", "medium", "low")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("sample_per_band")
def q_sample_per_band(spark, sf):
    return risk.sample_per_band(TB.scored(spark, sf), n=3, seed=42) \
        .select("risk_band", F.col("pick").cast("bigint").alias("pick"), ID_COL)


@query("filter_contract")
def q_filter_contract(spark, sf):
    return risk.apply_filters(TB.customers(spark, sf), ["Month-to-month", "One year"], None, None) \
        .select(ID_COL, "Contract")


@query("filter_ranges")
def q_filter_ranges(spark, sf):
    return risk.apply_filters(TB.customers(spark, sf), None, (24, 60), (60.0, 80.0)) \
        .select(ID_COL, "tenure", "MonthlyCharges")


@query("apply_filters")
def q_apply_filters(spark, sf):
    sc = TB.scored(spark, sf)
    return risk.apply_filters(sc, ["Month-to-month", "Two year"], (12, 66), (55.0, 85.0)) \
        .select(ID_COL, SCORE_COL)


@query("filter_coverage")
def q_filter_coverage(spark, sf):
    sc = TB.scored(spark, sf)
    return risk.filter_coverage(sc, risk.filter_predicate(sc, ["One year"], (0, 72), (0, 120)))


@query("high_risk_view")
def q_high_risk_view(spark, sf):
    return risk.high_risk_view(TB.scored(spark, sf), 0.7)


@query("risk_kpis")
def q_risk_kpis(spark, sf):
    k = risk.risk_kpis(TB.scored(spark, sf))
    return k.select("n", "n_high", "n_medium", "n_low", r6("mean_score").alias("mean_score"),
                    r6("share_high").alias("share_high"), r6("share_medium").alias("share_medium"),
                    r6("share_low").alias("share_low"))


@query("risk_distribution")
def q_risk_distribution(spark, sf):
    return risk.risk_distribution(TB.scored(spark, sf))


@query("score_histogram")
def q_score_histogram(spark, sf):
    h = risk.score_histogram(TB.scored(spark, sf), 40)
    return h.select("bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "n")


@query("attach_raw")
def q_attach_raw(spark, sf):
    sc = TB.scored(spark, sf).select(ID_COL, LABEL_COL, SCORE_COL)
    return risk.attach_raw(sc, TB.customers(spark, sf))


# ================================================================ evaluation


def _pred(spark, sf):
    return risk.predict(TB.scored(spark, sf))


@query("confusion")
def q_confusion(spark, sf):
    return evaluate.confusion(_pred(spark, sf))


@query("class_report")
def q_class_report(spark, sf):
    r = evaluate.class_report(_pred(spark, sf))
    return r.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("roc_auc")
def q_roc_auc(spark, sf):
    return evaluate.roc_auc(TB.scored(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


@query("roc_points")
def q_roc_points(spark, sf):
    r = evaluate.roc_points(TB.scored(spark, sf))
    return r.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("pr_points")
def q_pr_points(spark, sf):
    r = evaluate.pr_points(TB.scored(spark, sf))
    return r.select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("class_weights")
def q_class_weights(spark, sf):
    from churnlens.operators.balance import class_weights
    w = class_weights(TB.split(spark, sf).where(F.col("split") == "train"), LABEL_COL)
    return w.select(LABEL_COL, "n", r6("weight").alias("weight"))


# ================================================================ attributions (closed form)

@query("linear_shap")
def q_linear_shap(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    return explain.long_form(attr)


@query("top_factors")
def q_top_factors(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    t = explain.top_factors(attr, 5)
    return t.select(ID_COL, F.col("rank").cast("bigint").alias("rank"), "feature", "shap_value", "direction")


@query("global_importance")
def q_global_importance(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    g = explain.global_importance(explain.long_form(attr), 15)
    return g.select("feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@query("factor_bars")
def q_factor_bars(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    b = explain.factor_bars(attr, 5)
    return b.select(ID_COL, F.col("rank").cast("bigint").alias("rank"), "feature", "bar_pct")


@query("waterfall")
def q_waterfall(spark, sf):
    attr, base = TB.linear_attr(spark, sf)
    w = explain.waterfall(attr, base, n=10)
    return w.select(ID_COL, "step", "item", r6("value").alias("value"), r6("start").alias("start"),
                    r6("end").alias("end"), "text", r6("probability").alias("probability"))


@query("beeswarm")
def q_beeswarm(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    b = explain.beeswarm(attr, 12, 42)
    return b.select(ID_COL, "feature", "rank", "shap_value", r6("norm_value").alias("norm_value"),
                    r6("jitter").alias("jitter"), r6("y").alias("y"))


@query("factor_text")
def q_factor_text(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    return explain.factor_text(explain.factors_array(attr, 5), TB.scored(spark, sf))


# ================================================================ segments (given segment column)

@query("name_segments")
def q_name_segments(spark, sf):
    seg = segments.fixed_tenure_segments(TB.scored(spark, sf))
    return segments.name_segments(seg).select(ID_COL, "segment", "segment_name")


@query("segment_profiles")
def q_segment_profiles(spark, sf):
    seg = segments.name_segments(segments.fixed_tenure_segments(TB.scored(spark, sf)))
    p = segments.segment_profiles(seg)
    return p.select("segment", "segment_name", r6("mean_risk").alias("mean_risk"), "n_customers",
                    *[r6(f"mean_{c}").alias(f"mean_{c}") for c in segments.SEGMENT_COLUMNS])


# ================================================================ messages

def _tone_by_band():
    b = S.risk_band(SCORE_COL)
    return F.when(b == S.BAND_HIGH, F.lit("warm")).when(b == S.BAND_MEDIUM, F.lit("formal")).otherwise(F.lit("short"))


def _prompts(spark, sf):
    attr, _ = TB.linear_attr(spark, sf)
    facts = explain.factors_array(attr, 5)
    return messages.retention_prompt(TB.scored(spark, sf), facts, tone=_tone_by_band())


@query("retention_prompt")
def q_retention_prompt(spark, sf):
    return _prompts(spark, sf)


@query("summary_input")
def q_summary_input(spark, sf):
    s = messages.summary_input(TB.scored(spark, sf), 0.7, 10)
    return s.select("n_high", F.posexplode("top").alias("pos", "t")).select(
        (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.id").alias(ID_COL),
        F.col("t.churn_prob").alias(SCORE_COL), "t.tenure", "t.MonthlyCharges", "n_high")


@query("summary_prompt")
def q_summary_prompt(spark, sf):
    return messages.summary_prompt(messages.summary_input(TB.scored(spark, sf), 0.7, 10))


@query("summary_request")
def q_summary_request(spark, sf):
    return messages.request_table(messages.summary_prompt(messages.summary_input(TB.scored(spark, sf), 0.7, 10)), "summary")


@query("request_table")
def q_request_table(spark, sf):
    return messages.request_table(_prompts(spark, sf), "mail")


@query("fallback_message")
def q_fallback_message(spark, sf):
    r = TB.responses(spark, sf).where(F.col("error").isNotNull())
    return r.select(ID_COL, "turn", "error", messages.fallback_message(F.col("error")).alias("message"))


@query("attach_responses")
def q_attach_responses(spark, sf):
    j = messages.attach_responses(_prompts(spark, sf), TB.responses(spark, sf))
    return j.select(ID_COL, "turn", "tone", "outcome", "message")


@query("message_stats")
def q_message_stats(spark, sf):
    from churnlens.sources.fixture import table
    conv = table(spark, sf, "conversations")
    return messages.message_stats(conv, "text").select("conv_id", "turn", "words", "chars", "read_minutes")


@query("trim_response")
def q_trim_response(spark, sf):
    from churnlens.sources.fixture import table
    conv = table(spark, sf, "conversations")
    return messages.trim_response(conv, "text").select("conv_id", "turn", F.col("text").alias("response"))


# ================================================================ round trips through storage

@query("processed_roundtrip")
def q_processed_roundtrip(spark, sf):
    path = scratch_path(spark, "processed")
    io.write_processed(TB.split(spark, sf), path)
    back = io.load_processed(spark, path, "test")
    return back.drop("split")


@query("test_ids")
def q_test_ids(spark, sf):
    path = scratch_path(spark, "test_ids")
    io.test_ids(TB.split(spark, sf)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query("scaler_roundtrip")
def q_scaler_roundtrip(spark, sf):
    s = TB.split(spark, sf)
    stats = prepare.fit_scaler(s.where(F.col("split") == "train"), NUMERIC_COLS)
    _, medians = prepare.clean(TB.customers(spark, sf))
    path = scratch_path(spark, "scaler")
    io.save_stats(prepare.scaler_table(spark, stats, medians), path)
    t = io.load_stats(spark, path)
    return t.select(F.col("column").alias("column_name"), r6("mean").alias("mean"), r6("std").alias("std"),
                    r6("median").alias("median"))


@query("export_high_risk")
def q_export_high_risk(spark, sf):
    sc = TB.scored(spark, sf)
    path = scratch_path(spark, "high_risk_csv")
    io.export_high_risk(sc, path, 0.7)
    return io.read_csv(spark, path, sc.schema)


@query("messages_roundtrip")
def q_messages_roundtrip(spark, sf):
    req = messages.request_table(_prompts(spark, sf), "mail")
    banded = req.join(TB.scored(spark, sf).select(ID_COL, S.risk_band(SCORE_COL).alias("risk_band")), ID_COL)
    path = scratch_path(spark, "messages")
    io.write_messages(banded, path)
    return spark.read.parquet(path).select(ID_COL, "risk_band", "tone", "job", "max_tokens", "temperature",
                                           "user_prompt")


# ================================================================ neighbours


@query("similar_customers")
def q_similar_customers(spark, sf):
    v = TB.customer_vectors(spark, sf)
    targets = v.orderBy(F.col(SCORE_COL).desc(), ID_COL).limit(5)   # the five riskiest customers
    r = neighbors.knn_targets(v, targets, n=5)
    return r.select("target_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id",
                    r6("distance").alias("distance"))


@query("similar_all")
def q_similar_all(spark, sf):
    r = neighbors.knn_all(TB.customer_vectors(spark, sf), k=5)
    return r.select(ID_COL, F.col("rank").cast("bigint").alias("rank"), "neighbor_id", r6("distance").alias("distance"))


@query("embedding_knn")
def q_embedding_knn(spark, sf):
    from churnlens.sources.fixture import table
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("vec_id"),
                                                F.col("embedding").cast("array<double>").alias("vec"))
    r = neighbors.knn_all(emb, k=5, id_col="vec_id")
    return r.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "neighbor_id",
                    r6("distance").alias("distance"))


@query("similar_all_lsh")
def q_similar_all_lsh(spark, sf):
    """JON6 in linear time: near rows along sorted projections (no hashing; the key keeps its first name)."""
    r = neighbors.knn_all_sorted(TB.customer_vectors(spark, sf), k=5)
    return r.select(ID_COL, F.col("rank").cast("bigint").alias("rank"), "neighbor_id", r6("distance").alias("distance"))


@query("smote")
def q_smote(spark, sf):
    from churnlens.operators.balance import smote
    df, _ = TB.scaled_split(spark, sf)
    feats = prepare.encoded_feature_names(df)
    train = df.where(F.col("split") == "train").select(ID_COL, LABEL_COL,
                                                       *[F.round(F.col(f"`{f}`").cast("double"), 6).alias(f)
                                                         for f in feats])
    out = smote(train, feats, LABEL_COL, k=5, seed=42)
    return out.select(ID_COL, LABEL_COL, "is_synthetic", *[r6(f"`{f}`").alias(f) for f in feats])


# ================================================================ model, segments, attributions (rows-only)


@query("column_types")
def q_column_types(spark, sf):
    return profile.column_types(TB.customers(spark, sf))


@query("prepare_counts")
def q_prepare_counts(spark, sf):
    return jobs.prepare_counts(TB.prepared(spark, sf))


@query("model_score")
def q_model_score(spark, sf):
    model, prep = TB.trained(spark, sf)
    sc = M.score(model, prep["test"])
    return sc.select(ID_COL, LABEL_COL, SCORE_COL, "prediction", S.risk_band(SCORE_COL).alias("risk_band"))


@query("model_metrics")
def q_model_metrics(spark, sf):
    model, prep = TB.trained(spark, sf)
    sc = M.score(model, prep["test"])
    rep = evaluate.class_report(sc)
    auc = evaluate.roc_auc(sc)
    f1 = rep.where(F.col("class") == "1").select(F.lit("f1").alias("metric"), F.col("f1").alias("value"))
    acc = rep.where(F.col("class") == "accuracy").select(F.lit("accuracy").alias("metric"), F.col("f1").alias("value"))
    return f1.unionByName(acc).unionByName(auc.select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))


@query("tune_trials")
def q_tune_trials(spark, sf):
    prep = TB.prepared(spark, sf)
    parts = splitting.random_split(prep["train"], seed=43)  # another hash than the test split's
    from churnlens.operators.balance import smote
    fit_rows = smote(parts.where(F.col("part") == "fit").drop("part", "split"), prep["features"], LABEL_COL, knn="sorted")
    valid = parts.where(F.col("part") == "valid")
    _, trials = M.tune(fit_rows, valid, prep["features"], LABEL_COL)  # 50 trials
    return trials


def _segmented(spark, sf):
    """k-means segments with their names and principal components, once per session and scale factor."""
    def build():
        seg, _ = segments.kmeans_segments(TB.scored(spark, sf), k=4, n_init=15, seed=42)
        return segments.pca_2d(segments.name_segments(seg)).drop("features")
    return TB.materialized(spark, sf, "kmeans", build)


@query("kmeans_segments")
def q_kmeans_segments(spark, sf):
    return _segmented(spark, sf).select(ID_COL, "segment", "segment_name", SCORE_COL, *segments.SEGMENT_COLUMNS)


@query("pca_2d")
def q_pca_2d(spark, sf):
    sc = TB.scored(spark, sf)
    z = segments.standardized(sc, segments.segment_inputs(sc))
    return segments.pca_2d(z).select(ID_COL, "pca_x", "pca_y")


@query("segment_points")
def q_segment_points(spark, sf):
    return segments.segment_points(_segmented(spark, sf))


@query("kmeans_profiles")
def q_kmeans_profiles(spark, sf):
    p = segments.segment_profiles(_segmented(spark, sf))
    return p.select("segment_name", r6("mean_risk").alias("mean_risk"), "n_customers",
                    *[r6(f"mean_{c}").alias(f"mean_{c}") for c in segments.SEGMENT_COLUMNS])


@query("kmeans_inputs")
def q_kmeans_inputs(spark, sf):
    """The columns that k-means carries through, which must be the scored table's."""
    return _segmented(spark, sf).select(ID_COL, SCORE_COL, *segments.SEGMENT_COLUMNS)


@query("kmeans_check")
def q_kmeans_check(spark, sf):
    """The written segments against the mean of each: rows, segments, and rows for which another mean is clearly nearer."""
    seg = _segmented(spark, sf)
    cols = segments.segment_inputs(seg)
    z = segments.standardized(seg, cols).select("segment", vector_to_array("features").alias("x"))
    means: dict = {}
    for r in z.select("segment", F.posexplode("x").alias("j", "v")).groupBy("segment", "j").agg(F.avg("v").alias("m")).collect():  # segments x columns
        means.setdefault(r["segment"], {})[r["j"]] = r["m"]
    far = F.create_map(*[e for g, m in sorted(means.items()) for e in (F.lit(g), F.sqrt(F.aggregate(
        F.zip_with("x", F.array(*[F.lit(m[j]) for j in sorted(m)]), lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)))])
    return z.select("segment", far.alias("far")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("segment").alias("n_segments"),
        F.count_if(F.array_min(F.map_values("far")) < F.col("far")[F.col("segment")] - 1e-3).alias("n_misplaced"))


@query("load_customers")
def q_load_customers(spark, sf):
    """SRC1 from a CSV with its columns in reverse order and one that is not declared."""
    raw = TB.customers(spark, sf)
    path = scratch_path(spark, "customers_reordered")
    io.write_csv(raw.select(*[F.col(c) for c in reversed(raw.columns)], F.length(ID_COL).alias("id_length")), path)
    back = io.load_customers(spark, path, "csv")
    return back.select(*raw.columns, "id_length")


@query("top_high_risk")
def q_top_high_risk(spark, sf):
    """TOP1: the first 50 rows of the high-risk view, with their rank."""
    return risk.top_high_risk(TB.scored(spark, sf), 0.7, 50)


@query("importance_for_chart")
def q_importance_for_chart(spark, sf):
    """TOP3: the 12 most important features in chart order."""
    attr, _ = TB.linear_attr(spark, sf)
    g = explain.importance_for_chart(explain.long_form(attr), 12)
    return g.select("position", "feature", r6("mean_abs_shap").alias("mean_abs_shap"))


@query("attach_scores")
def q_attach_scores(spark, sf):
    """JON2: scores attached to the raw table by key."""
    sc = TB.scored(spark, sf).select(ID_COL, SCORE_COL)
    return risk.attach_scores(TB.customers(spark, sf), sc).select(ID_COL, "Contract", SCORE_COL)


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """SNK4: rows whose score changes when the model is saved and loaded (none)."""
    model, prep = TB.trained(spark, sf)
    path = scratch_path(spark, "model")
    io.save_model(model, path)
    a, b = (M.score(m, prep["test"]).select(ID_COL, SCORE_COL) for m in (model, io.load_model(path)))
    same = a.join(b.withColumnRenamed(SCORE_COL, "_again"), ID_COL)
    return same.select(ID_COL, (F.col(SCORE_COL) == F.col("_again")).alias("same_score"))


@query("tree_shap")
def q_tree_shap(spark, sf):
    model, prep = TB.trained(spark, sf)
    attr, _ = treeshap.tree_shap(model, prep["test"], prep["features"])
    return attr


@query("base_value")
def q_base_value(spark, sf):
    model, _ = TB.trained(spark, sf)
    return spark.range(1).select(F.lit(treeshap.base_value(spark, model)).alias("base_value"))


@query("score_stream")
def q_score_stream(spark, sf):
    from churnlens.streaming.score import run_to_completion
    model, prep = TB.trained(spark, sf)
    raw = TB.customers(spark, sf).join(prep["test"].select(ID_COL), ID_COL, "left_semi").drop("Churn")
    in_dir = scratch_path(spark, "stream_in")
    raw.repartition(4).write.mode("overwrite").parquet(in_dir)   # arriving files
    return run_to_completion(spark, in_dir, prep["fitted"], model, scratch_path(spark, "stream_out"),
                             scratch_path(spark, "stream_ckpt"))


@query("stream_rule_score")
def q_stream_rule_score(spark, sf):
    """STM1 with the deterministic rule score in place of a model's: every customer, arriving as CSV files."""
    from churnlens.sources.fixture import rule_score_col
    from churnlens.streaming.score import start
    in_dir, out_dir = scratch_path(spark, "stream_csv"), scratch_path(spark, "stream_rule")
    io.write_csv(TB.customers(spark, sf).repartition(4), in_dir)
    start(spark, in_dir, lambda df: df.select(ID_COL, rule_score_col().alias(SCORE_COL)).withColumn(
        "risk_band", S.risk_band(SCORE_COL)), out_dir, scratch_path(spark, "stream_rule_ckpt"), fmt="csv").awaitTermination()
    return spark.read.parquet(out_dir).drop("batch_id")


@query("stream_rejects")
def q_stream_rejects(spark, sf):
    """STM1 over files of which some rows have cells that are no numbers: every customer once, scored or rejected."""
    from churnlens.sources.fixture import rule_score_col
    from churnlens.streaming.score import read_sink, start
    in_dir, out_dir = scratch_path(spark, "stream_bad_csv"), scratch_path(spark, "stream_mixed")
    key = F.substring(ID_COL, 10, 9).cast("int")
    damaged = TB.customers(spark, sf).withColumn("tenure", F.when(key % 50 == 7, F.lit("n/a")).otherwise(F.col("tenure").cast("string"))) \
        .withColumn("MonthlyCharges", F.when(key % 75 == 7, F.lit("12,5")).otherwise(F.col("MonthlyCharges").cast("string")))
    io.write_csv(damaged.repartition(4), in_dir)
    start(spark, in_dir, lambda df: df.select(ID_COL, rule_score_col().alias(SCORE_COL)), out_dir,
          scratch_path(spark, "stream_bad_ckpt"), fmt="csv").awaitTermination()
    good = spark.read.parquet(out_dir).select(ID_COL, SCORE_COL, F.lit(None).cast("string").alias("bad_columns"))
    bad = read_sink(spark, out_dir + "_rejected").select(ID_COL, F.lit(None).cast("double").alias(SCORE_COL), F.concat_ws(",", "bad_columns").alias("bad_columns"))
    return good.unionAll(bad)


@query("training_importance")
def q_training_importance(spark, sf):
    """PIP2 end to end on the derived customer table written as CSV: load, profile,
    prepare, train, evaluate, explain a keyed sample of 200 test rows, top 10 features."""
    path = scratch_path(spark, "customers_csv")
    io.write_csv(TB.customers(spark, sf), path)
    out = jobs.train_job(spark, path, fmt="csv", explain_rows=200)
    return out["importance"]

"""Invariants of model-side and randomised operators (layer 2 and 3 of the test plan)."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module")
def trained(spark):
    from churnlens.plans import tables
    return tables.trained(spark, SF_MID)


def test_split_disjoint_complete_stratified(spark):
    from churnlens.plans import tables
    s = tables.split(spark, SF_MID)
    pdf = s.select("customerID", "label", "split").toPandas()
    assert pdf.customerID.is_unique
    assert set(pdf.split) == {"train", "test"}
    for lab, g in pdf.groupby("label"):
        n_test = (g.split == "test").sum()
        assert abs(n_test - 0.2 * len(g)) <= 1


def test_split_independent_of_partitioning(spark):
    from churnlens.operators.split import stratified_split
    from churnlens.plans import tables
    enc = tables.encoded(spark, SF_MID)
    a = stratified_split(enc.repartition(1)).select("customerID", "split").toPandas().sort_values("customerID")
    b = stratified_split(enc.repartition(17)).select("customerID", "split").toPandas().sort_values("customerID")
    assert a.split.tolist() == b.split.tolist()


def test_smote_balances_and_interpolates(spark):
    from churnlens.operators.balance import smote
    from churnlens.plans import tables
    df, _ = tables.scaled_split(spark, SF_SMALL)
    from churnlens.operators.prepare import encoded_feature_names
    feats = encoded_feature_names(df)
    train = df.where("split = 'train'")
    out = smote(train, feats, "label", k=5, seed=42).toPandas()
    counts = out.groupby("label").size()
    assert counts.iloc[0] == counts.iloc[1]
    syn = out[out.is_synthetic == 1]
    base = out[out.is_synthetic == 0].set_index("customerID")
    lo = base[feats].min().to_numpy()
    hi = base[feats].max().to_numpy()
    vals = syn[feats].to_numpy()
    assert (vals >= lo - 1e-9).all() and (vals <= hi + 1e-9).all()
    again = smote(train.repartition(13), feats, "label", k=5, seed=42).toPandas()
    cols = ["customerID"] + feats
    pd_a = out[cols].sort_values("customerID").reset_index(drop=True)
    pd_b = again[cols].sort_values("customerID").reset_index(drop=True)
    assert np.allclose(pd_a[feats].to_numpy(), pd_b[feats].to_numpy())


def test_auc_equals_builtin_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from churnlens.operators.evaluate import roc_auc
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_MID)
    ours = roc_auc(sc).first()["roc_auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="churn_proba", labelCol="label", metricName="areaUnderROC")
    theirs = ev.evaluate(sc.select(F.col("churn_proba"), F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-9
    assert 0.84 < ours < 0.87  # FIXTURES: AUC of rule_score 0.856 at sf0.01


def test_model_quality_marks(spark, trained):
    from churnlens.operators.evaluate import roc_auc
    from churnlens.operators.model import score
    model, prep = trained
    auc = roc_auc(score(model, prep["test"])).first()["roc_auc"]
    assert auc >= 0.82


def test_model_saved_equals_loaded(spark, trained, tmp_path):
    from churnlens.operators.model import score
    from churnlens.sources import io
    model, prep = trained
    io.save_model(model, str(tmp_path / "m"))
    back = io.load_model(str(tmp_path / "m"))
    a = score(model, prep["test"]).select("customerID", "churn_proba").toPandas().sort_values("customerID")
    b = score(back, prep["test"]).select("customerID", "churn_proba").toPandas().sort_values("customerID")
    assert np.allclose(a.churn_proba.to_numpy(), b.churn_proba.to_numpy())


def test_missing_model_is_error(tmp_path):
    from churnlens.sources import io
    with pytest.raises(FileNotFoundError):
        io.load_model(str(tmp_path / "nope"))


def test_treeshap_additive(spark, trained):
    from pyspark.ml.functions import vector_to_array
    from churnlens.operators.treeshap import tree_shap
    model, prep = trained
    attr, base = tree_shap(model, prep["test"], prep["features"], long=False)
    raw = model.transform(prep["test"]).select("customerID", (vector_to_array("rawPrediction")[1] * 2).alias("m2"))
    err = attr.join(raw, "customerID").select(F.max(F.abs(F.col("margin") - F.col("m2")))).first()[0]
    assert err <= 1e-6


def _brute_shapley(trees, x, n_features):
    """Shapley values of the path-dependent conditional expectation, by enumeration."""
    def ev(tree, nid, s):
        node = tree[nid]
        if node["leftChild"] < 0:
            return node["v"]
        f, t = node["featureIndex"], node["t"]
        if f in s:
            return ev(tree, node["leftChild"] if x[f] <= t else node["rightChild"], s)
        cl, cr = tree[node["leftChild"]]["rawCount"], tree[node["rightChild"]]["rawCount"]
        return (cl * ev(tree, node["leftChild"], s) + cr * ev(tree, node["rightChild"], s)) / (cl + cr)

    def g(s):
        return sum(ev(t, 0, s) for t in trees)
    phi = np.zeros(n_features)
    feats = list(range(n_features))
    for i in feats:
        others = [j for j in feats if j != i]
        for size in range(len(others) + 1):
            w = math.factorial(size) * math.factorial(n_features - size - 1) / math.factorial(n_features)
            for s in combinations(others, size):
                phi[i] += w * (g(set(s) | {i}) - g(set(s)))
    return phi, g(set())


def test_treeshap_equals_brute_force(spark, tmp_path):
    from churnlens.operators.model import train
    from churnlens.operators.treeshap import tree_shap
    from churnlens.plans import tables
    df, _ = tables.scaled_split(spark, SF_SMALL)
    feats = ["tenure", "MonthlyCharges", "TotalCharges", "Contract_Month-to-month"]
    m = train(df, feats, "label", {"n_estimators": 3, "max_depth": 3, "subsample": 0.8, "min_child_weight": 1})
    gbt = m.stages[-1]
    gbt.write().overwrite().save(str(tmp_path / "g"))
    nodes = spark.read.parquet(str(tmp_path / "g" / "data")).collect()
    trees = {}
    for r in nodes:
        d = r["nodeData"]
        trees.setdefault(r["treeID"], {})[d["id"]] = {
            "leftChild": d["leftChild"], "rightChild": d["rightChild"], "rawCount": d["rawCount"],
            "featureIndex": d["split"]["featureIndex"], "t": (d["split"]["leftCategoriesOrThreshold"] or [0.0])[0],
            "v": 2.0 * gbt.treeWeights[r["treeID"]] * d["prediction"]}
    attr, base = tree_shap(m, df.limit(15), feats, long=False)
    rows = attr.collect()
    xs = df.select("customerID", *[F.col(f"`{f}`").cast("double") for f in feats]).toPandas().set_index("customerID")
    for r in rows:
        x = xs.loc[r["customerID"]].to_numpy()
        phi, b = _brute_shapley([trees[t] for t in sorted(trees)], x, len(feats))
        assert abs(b - base) < 1e-9
        assert np.allclose(phi, np.array(r["shap"]), atol=1e-9)


def test_kmeans_nearest_centre_and_best_of_starts(spark):
    from churnlens.operators.segments import kmeans_segments
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_SMALL)
    out, model = kmeans_segments(sc, k=4, n_init=3, seed=42)
    centers = np.array(model.clusterCenters())
    pdf = out.select("features", "segment").toPandas()
    x = np.array([v.toArray() for v in pdf.features])
    nearest = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
    assert (nearest == pdf.segment.to_numpy()).all()


def test_kmeans_fewer_rows_than_clusters(spark):
    from churnlens.operators.segments import kmeans_segments
    df = spark.createDataFrame([("a", 1, 20.0, 20.0, 0.1), ("b", 2, 30.0, 60.0, 0.9)],
                               "customerID string, tenure int, MonthlyCharges double, TotalCharges double, "
                               "churn_proba double")
    with pytest.raises(ValueError):
        kmeans_segments(df, k=4, n_init=1)


def test_pca_orthogonal_and_ordered(spark):
    from churnlens.operators.segments import pca_2d, segment_inputs, standardized
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_SMALL)
    z = pca_2d(standardized(sc, segment_inputs(sc))).select("pca_x", "pca_y").toPandas()
    assert abs(np.corrcoef(z.pca_x, z.pca_y)[0, 1]) < 1e-6
    assert z.pca_x.var() >= z.pca_y.var()


def test_stream_equals_batch(spark, trained, tmp_path):
    from churnlens.plans import tables
    from churnlens.streaming.score import run_to_completion, scoring_frame
    model, prep = trained
    raw = tables.customers(spark, SF_MID).join(prep["test"].select("customerID"), "customerID", "left_semi") \
        .drop("Churn")
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = run_to_completion(spark, str(tmp_path / "in"), prep["fitted"], model, str(tmp_path / "out"),
                                 str(tmp_path / "ck")).toPandas().sort_values("customerID").reset_index(drop=True)
    batch = scoring_frame(raw, prep["fitted"], model).toPandas().sort_values("customerID").reset_index(drop=True)
    assert len(streamed) == len(batch) == prep["test"].count()
    assert np.allclose(streamed.churn_proba, batch.churn_proba)
    assert (streamed.risk_band == batch.risk_band).all()


def test_exact_median_with_hot_value(spark):
    from churnlens.operators import select
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=40000), np.full(30000, 0.25), rng.integers(0, 100, 20000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    old = select.MAX_DISTINCT_TO_DRIVER
    select.MAX_DISTINCT_TO_DRIVER = 500   # force the bracketing path
    try:
        got = select.exact_median(df, "x")
    finally:
        select.MAX_DISTINCT_TO_DRIVER = old
    assert got == float(np.median(vals))


def test_hash_cut_matches_sort(spark):
    from churnlens.functions.scalars import keyed_hash
    from churnlens.operators.select import hash_cut
    df = spark.range(5000).select(F.format_string("id%05d", "id").alias("id"), (F.col("id") % 3).alias("g"))
    h = df.withColumn("h", keyed_hash("id", 7))
    cuts = hash_cut(h, "h", "id", "g", {0: 10, 1: 700, 2: 1666}, max_rows_to_driver=3)
    pdf = h.toPandas()
    for g, k in {0: 10, 1: 700, 2: 1666}.items():
        exp = pdf[pdf.g == g].sort_values(["h", "id"]).iloc[k - 1]
        assert cuts[g] == (exp.h, exp.id)


@pytest.mark.parametrize("n_cells", [7, 150])
def test_knn_exact_with_duplicates_matches_brute_force(spark, n_cells):
    from churnlens.operators.neighbors import knn_all
    rng = np.random.default_rng(3)
    pts = np.round(rng.normal(size=(300, 4)), 3)
    pts[:100] = pts[0]                       # a hot group of 100 identical vectors
    rows = [(f"r{i:03d}", [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "customerID string, vec array<double>")
    got = knn_all(df, k=5, n_cells=n_cells).toPandas()   # 150 pivots: many cells below k+1 rows
    ids = [r[0] for r in rows]
    d = np.sqrt(((pts[:, None, :] - pts[None]) ** 2).sum(2))
    for i, rid in enumerate(ids):
        order = sorted((d[i, j], ids[j]) for j in range(len(ids)) if j != i)[:5]
        mine = got[got.customerID == rid].sort_values("rank")
        assert mine.neighbor_id.tolist() == [o[1] for o in order]
        assert np.allclose(mine.distance.to_numpy(), [o[0] for o in order])


def test_metamorphic_sample_per_band(spark):
    from churnlens.operators.risk import sample_per_band
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_MID)
    a = sample_per_band(sc.repartition(1), 3).select("risk_band", "customerID").toPandas()
    b = sample_per_band(sc.repartition(17), 3).select("risk_band", "customerID").toPandas()
    assert sorted(map(tuple, a.values)) == sorted(map(tuple, b.values))


def test_tune_best_is_max_of_trials(spark, monkeypatch):
    from churnlens.operators import model
    from churnlens.operators.model import tune
    monkeypatch.setitem(model.SEARCH_SPACE, "n_estimators", ("int", 3, 4))
    from churnlens.plans import tables
    df, _ = tables.scaled_split(spark, SF_SMALL)
    from churnlens.operators.prepare import encoded_feature_names
    feats = encoded_feature_names(df)
    best, trials = tune(df.where("split = 'train'"), df.where("split = 'test'"), feats, n_trials=3, parallelism=3)
    t = trials.toPandas()
    assert len(t) == 3 and all(p["n_estimators"] in (3, 4) for p in t.params)
    top = t.sort_values(["f1", "trial"], ascending=[False, True]).iloc[0]
    assert best["max_depth"] == top.params["max_depth"]


def test_same_seed_same_model_any_partitioning(spark):
    from churnlens.operators.model import score, train
    from churnlens.plans import tables
    from churnlens.operators.prepare import encoded_feature_names
    df, _ = tables.scaled_split(spark, SF_SMALL)
    feats = encoded_feature_names(df)
    tr = df.where("split = 'train'")
    p = {"n_estimators": 5, "max_depth": 3}
    a = score(train(tr.repartition(1), feats, "label", p), df).select("customerID", "churn_proba").toPandas()
    b = score(train(tr.repartition(11), feats, "label", p), df).select("customerID", "churn_proba").toPandas()
    a, b = a.sort_values("customerID"), b.sort_values("customerID")
    assert np.allclose(a.churn_proba.to_numpy(), b.churn_proba.to_numpy())


def test_running_totals_do_not_depend_on_ranges(spark):
    from churnlens.operators import evaluate as E
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_MID)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in ("1", "14"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(E.roc_points(sc).toPandas().sort_values("threshold", na_position="first").reset_index(drop=True))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[0]) == len(got[1])
    assert np.allclose(got[0].fillna(-1).to_numpy(), got[1].fillna(-1).to_numpy())


def test_requested_tree_count_is_used(spark):
    from churnlens.operators.model import gbt_params, train
    from churnlens.operators.prepare import encoded_feature_names
    from churnlens.plans import tables
    assert gbt_params({})["maxIter"] == 300
    df, _ = tables.scaled_split(spark, SF_SMALL)
    m = train(df, encoded_feature_names(df), "label", {"n_estimators": 60, "max_depth": 2})
    assert m.stages[-1].getNumTrees == 60


def test_train_job_with_tuning(spark, tmp_path, monkeypatch):
    from churnlens.operators import model
    from churnlens.plans import jobs, tables
    monkeypatch.setitem(model.SEARCH_SPACE, "n_estimators", ("int", 3, 3))
    from churnlens.sources.io import write_csv
    write_csv(tables.customers(spark, SF_SMALL), str(tmp_path / "c"))
    out = jobs.train_job(spark, str(tmp_path / "c"), out_dir=str(tmp_path / "o"), optimize=True, fmt="csv",
                         n_trials=2, explain_rows=20)
    assert out["trials"].count() == 2
    assert 0.0 <= out["metrics"]["roc_auc"] <= 1.0
    assert out["importance"].count() == 10
    assert (tmp_path / "o" / "model").exists()


def test_median_fit_on_train_only(spark):
    from churnlens.plans import jobs, tables
    from churnlens.operators.prepare import to_number
    raw = tables.customers(spark, SF_SMALL)
    prep = jobs.prepare_data(raw, use_smote=False, fit_on="train")
    train_ids = prep["train"].select("customerID")
    vals = to_number(raw.join(train_ids, "customerID", "left_semi")).select("TotalCharges").toPandas()
    assert prep["fitted"].medians["TotalCharges"] == float(vals.TotalCharges.dropna().median())
    all_vals = to_number(raw).select("TotalCharges").toPandas().TotalCharges.dropna()
    assert jobs.prepare_data(raw, use_smote=False)["fitted"].medians["TotalCharges"] == float(all_vals.median())


@pytest.mark.parametrize("block", [16, 2048])
def test_knn_blocks_match_brute_force(spark, monkeypatch, block):
    """Several member and candidate blocks per cell (block keys must line up across the cogroup)."""
    from churnlens.operators import neighbors
    monkeypatch.setattr(neighbors, "BLOCK", block)
    rng = np.random.default_rng(5)
    pts = np.round(rng.normal(size=(400, 6)), 4)
    rows = [(f"p{i:03d}", [float(x) for x in p]) for i, p in enumerate(pts)]
    got = neighbors.knn_all(spark.createDataFrame(rows, "customerID string, vec array<double>"), k=4,
                            n_cells=5).toPandas()
    assert len(got) == 400 * 4
    d = np.sqrt(((pts[:, None, :] - pts[None]) ** 2).sum(2))
    ids = [r[0] for r in rows]
    for i in range(0, 400, 37):
        order = sorted((d[i, j], ids[j]) for j in range(400) if j != i)[:4]
        mine = got[got.customerID == ids[i]].sort_values("rank")
        assert mine.neighbor_id.tolist() == [o[1] for o in order]


@pytest.mark.parametrize("block", [8, 64])
def test_sorted_neighbours_are_complete_and_near(spark, block):
    from churnlens.operators import neighbors
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(size=(1, 6)) + 0.05 * rng.normal(size=(60, 6)) for _ in range(8)])
    pts[:50] = pts[0]                        # more copies than a block holds
    rows = [(f"p{i:03d}", [float(x) for x in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "customerID string, vec array<double>")
    got = neighbors.knn_all_sorted(df, k=5, block=block).toPandas()
    assert (got.groupby("customerID").size() == 5).all() and got.customerID.nunique() == len(rows)
    assert (got.customerID != got.neighbor_id).all()
    again = neighbors.knn_all_sorted(df.repartition(3), k=5, block=block).toPandas()
    key = lambda f: sorted(map(tuple, f.values.tolist()))
    assert key(got) == key(again)
    d = np.sqrt(((pts[:, None, :] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    fifth = np.sort(d, axis=1)[:, 4]
    at = {r[0]: i for i, r in enumerate(rows)}
    recall = np.mean([x <= fifth[at[c]] + 1e-9 for c, x in zip(got.customerID, got.distance)])
    assert recall > (0.85 if block == 64 else 0.4)
    few = neighbors.knn_all_sorted(df.limit(3), k=5, block=block).toPandas()
    assert len(few) == 6                     # min(k, rows - 1) each


@pytest.mark.parametrize("mode", ["exact", "sorted"])
def test_smote_balances_in_every_mode(spark, mode):
    from churnlens.operators.balance import smote
    from churnlens.operators.prepare import encoded_feature_names
    from churnlens.plans import tables
    df, _ = tables.scaled_split(spark, SF_MID)
    feats = encoded_feature_names(df)
    out = smote(df.where("split = 'train'"), feats, "label", knn=mode).groupBy("label").count().collect()
    assert len({r["count"] for r in out}) == 1


def test_targets_beyond_the_literal_limit(spark, monkeypatch):
    from churnlens.operators import neighbors
    rng = np.random.default_rng(2)
    rows = [(f"p{i:03d}", [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "customerID string, vec array<double>")
    want = neighbors.knn_targets(df, df.limit(30), n=4).toPandas()
    monkeypatch.setattr(neighbors, "MAX_TARGETS", 10)
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    got = neighbors.knn_targets(df, df.limit(30), n=4).toPandas()
    key = lambda f: sorted((a, b, c, round(d, 9)) for a, b, c, d in f.values.tolist())
    assert key(got) == key(want) and len(got) == 120


def test_kmeans_keeps_its_input_columns(spark):
    from churnlens.operators.segments import SEGMENT_COLUMNS, kmeans_segments
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_SMALL)
    out, _ = kmeans_segments(sc, k=4, n_init=2)
    cols = ["customerID", "churn_proba", *SEGMENT_COLUMNS]
    assert out.select(*cols).exceptAll(sc.select(*cols)).count() == 0 and out.where("churn_proba < 0 or churn_proba > 1").count() == 0


def test_hot_value_is_not_collected_with_its_neighbours(spark, monkeypatch):
    from churnlens.operators import select
    monkeypatch.setattr(select, "MAX_DISTINCT_TO_DRIVER", 100)
    sizes, walk = [], select._walk
    monkeypatch.setattr(select, "_walk", lambda pairs, *a: sizes.append(len(pairs)) or walk(pairs, *a))
    vals = [5.0] * 60_000 + [float(i) / 7 for i in range(-400, 600)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    ranks = [0, 3, 399, 400, 30_000, len(vals) - 2, len(vals) - 1]
    got, n = select.exact_kth(df, "x", lambda n: ranks)
    ordered = sorted(vals)
    assert n == len(vals) and got == {r: ordered[r] for r in ranks}
    assert max(sizes, default=0) <= 110


def test_deep_paths_without_tables(spark, monkeypatch):
    """Depth-10 trees: additivity, and the same values with and without tables."""
    from churnlens.operators import treeshap
    from churnlens.operators.model import score, train
    from churnlens.operators.prepare import encoded_feature_names
    from churnlens.plans import tables
    df, _ = tables.scaled_split(spark, SF_MID)
    feats = encoded_feature_names(df)
    m = train(df.where("split = 'train'"), feats, "label", {"n_estimators": 4, "max_depth": 10, "min_child_weight": 1})
    lt = treeshap.leaf_table(spark, m)
    deepest = max(len(leaf[1]) for leaf in lt["leaves"])
    assert deepest > treeshap.TABLE_DEPTH or deepest >= 7
    few = df.where("split = 'test'").limit(20)
    attr, base = treeshap.tree_shap(m, few, feats, long=False)
    got = attr.toPandas().set_index("customerID")
    probs = score(m, few).select("customerID", "churn_proba").toPandas().set_index("customerID").churn_proba
    margin = got.margin.reindex(probs.index)
    assert np.allclose(1 / (1 + np.exp(-margin)), probs, atol=1e-6)
    monkeypatch.setattr(treeshap, "TABLE_BYTES", 0)
    monkeypatch.setattr(treeshap, "CELLS", 5000)
    plain, _ = treeshap.tree_shap(m, few, feats, long=False)
    again = plain.toPandas().set_index("customerID").shap.reindex(got.index)
    assert np.allclose(np.stack(again.to_numpy()), np.stack(got.shap.to_numpy()), atol=1e-9)


def test_exact_neighbours_send_few_copies(spark):
    """Two-phase exact join at sf0.1: a row goes to fewer than 10 other blocks; leaves out of reach are not compared."""
    from churnlens.operators import neighbors
    from churnlens.plans import tables
    v = tables.customer_vectors(spark, "/root/testdata/sf0.1").select("customerID", "vec")
    vecs = v.groupBy("vec").agg(F.count(F.lit(1)).alias("m"), F.min("customerID").alias("vid"))
    first, sent, found = neighbors._exact_parts(vecs, vecs.count(), 6, None, 42)
    n = first.count()
    assert sent.count() < 10 * n and first.where("isnan(bound) or bound = double('inf')").isEmpty()
    # bounds hold: the k-th nearest of all compared rows is no further
    kth = found.groupBy("vid").agg(F.element_at(F.array_sort(F.collect_list("distance")), 6).alias("kth"))
    assert first.join(kth, "vid").where("kth > bound").isEmpty() and kth.count() == n


def test_boxes_never_hide_a_neighbour():
    from churnlens.operators import neighbors
    rng = np.random.default_rng(12)
    c = np.concatenate([rng.normal(size=(500, 5)), rng.normal(size=(300, 5)) * 0.05 + 3, np.zeros((60, 5))])
    q = c[rng.choice(len(c), 120, replace=False)] + rng.normal(size=(120, 5)) * 0.1
    names = np.array([f"n{i:04d}" for i in range(len(c))], dtype=object)
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    bound = np.sort(d, axis=1)[:, 9] * rng.uniform(1, 1.5, 120)
    i, k, dist = neighbors.nearest_within(q, bound, c, names, 7)
    for r in range(120):
        assert np.allclose(dist[i == r], np.sort(d[r])[:7])
    nodes = neighbors.kd_cuts(c, 20, 8)
    cells = neighbors.kd_cells(c, nodes)
    assert len(np.unique(cells)) > 10 and np.bincount(cells).min() >= 8
    low = np.stack([c[cells == x].min(0) for x in np.unique(cells)])
    high = np.stack([c[cells == x].max(0) for x in np.unique(cells)])
    boxes = neighbors.box_distances(q, low, high)
    for x in np.unique(cells):
        assert (boxes[:, x] <= d[:, cells == x].min(1) + 1e-9).all()


def test_successive_halving_settles_the_last_rung(spark, monkeypatch):
    from churnlens.operators import model
    assert model.rungs(50, 500) == [(50, 3), (17, 9), (6, 27), (2, None)]
    assert model.rungs(2, 500) == [(2, None)] and model.rungs(9, 5, 2, 3) == [(9, 2), (3, None)]
    monkeypatch.setitem(model.SEARCH_SPACE, "n_estimators", ("int", 20, 30))
    monkeypatch.setitem(model.SEARCH_SPACE, "max_depth", ("int", 2, 4))
    from churnlens.plans import tables
    from churnlens.operators.prepare import encoded_feature_names
    df, _ = tables.scaled_split(spark, SF_SMALL)
    best, trials = model.tune(df.where("split = 'train'"), df.where("split = 'test'"), encoded_feature_names(df), n_trials=7, first_trees=2)
    t = trials.toPandas().set_index("trial")
    assert len(t) == 7 and t.rung.value_counts().to_dict() == {0: 4, 1: 2, 2: 1}
    assert t.n_trees[t.rung == 0].eq(2).all() and t.auc.between(0, 1).all()
    last = t[t.rung == t.rung.max()]
    assert last.auc.min() >= 0.5 and (last.n_trees <= 30).all()
    assert best["max_depth"] == last.sort_values("f1", ascending=False, kind="stable").iloc[0].params["max_depth"]


def test_tune_fits_every_trial_with_all_its_trees(spark, monkeypatch):
    from churnlens.operators import model
    monkeypatch.setitem(model.SEARCH_SPACE, "n_estimators", ("int", 5, 8))
    monkeypatch.setitem(model.SEARCH_SPACE, "max_depth", ("int", 2, 3))
    from churnlens.plans import tables
    from churnlens.operators.prepare import encoded_feature_names
    df, _ = tables.scaled_split(spark, SF_SMALL)
    train, valid, feats = df.where("split = 'train'"), df.where("split = 'test'"), encoded_feature_names(df)
    best, trials = model.tune(train, valid, feats, n_trials=6)
    t = trials.toPandas().set_index("trial")
    assert len(t) == 6 and t.rung.eq(0).all()
    assert t.n_trees.tolist() == [int(p["n_estimators"]) for p in t.params]
    assert best == model.draw_params(6)[t.f1.idxmax()]
    for i in (0, 5):  # the measures are those of a plain fit
        auc, f1 = model.valid_measures(model.score(model.train(train, feats, params=model.draw_params(6)[i]), valid), "label")
        assert (t.auc[i], t.f1[i]) == pytest.approx((auc, f1), abs=1e-6)


def test_validation_rows_are_not_empty(spark):
    """The validation split uses another hash than the test split: rows of train have all passed that one."""
    from churnlens.operators.split import random_split
    from churnlens.plans import tables
    train = tables.split(spark, SF_MID).where("split = 'train'")
    share = random_split(train, seed=43).where("part = 'valid'").count() / train.count()
    assert 0.15 < share < 0.25


def test_valid_measures_equal_the_curve(spark):
    from churnlens.operators import evaluate, model
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500), 3)
    y = (rng.random(500) < p).astype(int)
    df = spark.createDataFrame([(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, p)], "label int, churn_proba double, prediction int")
    auc, f1 = model.valid_measures(df, "label")
    assert abs(auc - evaluate.roc_auc(df).first()["roc_auc"]) < 1e-9 and abs(f1 - evaluate.f1_of_class1(df)) < 1e-12


@pytest.mark.parametrize("depth", [1, 4, 10])
def test_tree_values_equal_brute_force(depth):
    """One pass per tree against Shapley values over all subsets of the features; repeated and empty splits too."""
    from churnlens.operators import treeshap
    rng = np.random.default_rng(depth)
    m = 7

    class Node(dict):
        __getitem__ = dict.get

    tree: dict = {}

    def grow(nid, level, count):
        if level == depth or count < 2:
            tree[nid] = Node(id=nid, prediction=float(rng.normal()), rawCount=count, leftChild=-1, rightChild=-1)
            return
        left = int(rng.integers(0, count + 1)) if rng.random() < 0.1 else max(1, int(count * rng.uniform(0.2, 0.8)))
        tree[nid] = Node(id=nid, prediction=0.0, rawCount=count, leftChild=2 * nid + 1, rightChild=2 * nid + 2, featureIndex=int(rng.integers(0, m)),
                         leftCategoriesOrThreshold=[float(rng.normal())], numCategories=-1)
        grow(2 * nid + 1, level + 1, left)
        grow(2 * nid + 2, level + 1, count - left)

    grow(0, 0, 4000)
    x = rng.normal(size=(5, m))

    def expected(row, known, nid=0):
        node = tree[nid]
        if node["leftChild"] < 0:
            return node["prediction"]
        a, b = node["leftChild"], node["rightChild"]
        if node["featureIndex"] in known:
            return expected(row, known, a if row[node["featureIndex"]] <= node["leftCategoriesOrThreshold"][0] else b)
        share = tree[a]["rawCount"] / node["rawCount"] if node["rawCount"] else 0.0
        return share * expected(row, known, a) + (1 - share if node["rawCount"] else 0.0) * expected(row, known, b)

    got = treeshap.tree_values(x, treeshap._edges(tree, 1.0), m)
    for r in range(len(x)):
        value = {s: expected(x[r], s) for k in range(m + 1) for s in combinations(range(m), k)}
        for i in range(m):
            rest = [j for j in range(m) if j != i]
            want = sum(math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (value[tuple(sorted((*s, i)))] - value[s])
                       for k in range(m) for s in combinations(rest, k))
            assert got[r, i] == pytest.approx(want, abs=1e-9)
        assert got[r].sum() == pytest.approx(value[tuple(range(m))] - value[()], abs=1e-9)


def test_all_starts_share_their_passes(spark, monkeypatch):
    """The best cost is that of 15 separate runs; passes are those of the slowest start."""
    from pyspark.ml.clustering import KMeans
    from churnlens.operators import segments
    from churnlens.plans import tables
    sc = tables.scored(spark, SF_MID)
    passes, real = [], segments._pass
    monkeypatch.setattr(segments, "_pass", lambda data, x, centres: passes.append(len(centres)) or real(data, x, centres))
    out, found = segments.kmeans_segments(sc, k=4, n_init=15, seed=42)
    assert len(found.costs) == 15 and found.cost == min(found.costs)
    assert len(passes) <= segments.SEED_ROUNDS + 1 + max(found.rounds) < sum(found.rounds)
    z = segments.standardized(sc, segments.segment_inputs(sc)).cache()
    separate = min(KMeans(k=4, seed=s, maxIter=100).fit(z).summary.trainingCost for s in range(42, 50))
    assert found.cost <= separate * 1.001
    rows = out.select("features", "segment").toPandas()
    x = np.stack([v.toArray() for v in rows.features])
    d2 = ((x[:, None] - found.centres[None]) ** 2).sum(2)
    assert (d2.argmin(1) == rows.segment).mean() > 0.999 and d2.min(1).sum() == pytest.approx(found.cost, rel=1e-6)
    again, same = segments.kmeans_segments(sc.repartition(3), k=4, n_init=15, seed=42)
    assert same.start == found.start and np.allclose(same.centres, found.centres, atol=1e-6)


def test_kmeans_of_copies_and_more_starts_than_rows(spark):
    from churnlens.operators import segments
    rows = [(f"c{i}", [float(i % 2), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "customerID string, x array<double>")
    found = segments.kmeans(df, k=2, n_init=15)
    assert found.cost == 0 and sorted(c[0] for c in found.centres) == [0.0, 1.0]


def test_stream_survives_bad_rows_restarts_and_an_empty_start(spark, tmp_path):
    from churnlens.streaming import score as stream
    out, ckpt, src = str(tmp_path / "out"), str(tmp_path / "ckpt"), tmp_path / "in"
    keep = lambda df: df.select("customerID", "tenure", "MonthlyCharges")
    run = lambda: stream.start(spark, str(src), keep, out, ckpt, fmt="csv").awaitTermination()
    run()  # a folder that is not there yet
    kinds = "customerID string, tenure int, MonthlyCharges double"
    assert stream.read_sink(spark, out, kinds).count() == 0 and stream.read_sink(spark, out + "_rejected", stream.REJECTED).count() == 0
    names = [f.name for f in __import__("churnlens.schema", fromlist=["x"]).CUSTOMER_SCHEMA]
    line = lambda **v: ",".join(str(v.get(n, "1" if n in ("extra_flag", "tenure", "MonthlyCharges") else "Yes")) for n in names)
    rows = [line(customerID="a"), line(customerID="b", tenure="many"), line(customerID="c", MonthlyCharges="1,5".replace(",", ";")),
            line(customerID="", tenure="2"), line(customerID="e", tenure="", MonthlyCharges="2.5")]
    (src / "one.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    run()
    (src / "two.csv").write_text("\n".join([",".join(names), line(customerID="f"), line(customerID="g", tenure="x", extra_flag="y")]) + "\n")
    run()
    run()  # nothing new
    good = stream.read_sink(spark, out, kinds).collect()
    bad = {r.customerID: r for r in stream.read_sink(spark, out + "_rejected").collect()}
    assert sorted(r.customerID for r in good) == ["a", "e", "f"] and len(good) + len(bad) == 7
    assert {r.customerID: r.tenure for r in good} == {"a": 1, "e": None, "f": 1}
    assert bad["b"].bad_columns == ["tenure"] and bad["g"].bad_columns == ["extra_flag", "tenure"] and bad[None].bad_columns == ["customerID"]
    assert '"tenure":"many"' in bad["b"].row and bad["c"].bad_columns == ["MonthlyCharges"]
    # a batch that is attempted again replaces what it had written
    again = spark.read.option("header", True).csv(str(src / "two.csv"))
    fresh, _ = stream.split_bad(again)
    number = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir())
    keep(fresh).write.mode("overwrite").parquet(f"{out}/batch_id={number}")
    assert stream.read_sink(spark, out).count() == 3


def test_levels_without_a_bound_on_the_driver(spark, monkeypatch):
    """A column of very many levels is encoded by a dictionary table; ids are dense and in order; hot and unknown values."""
    from churnlens.operators import prepare
    n = 200_000
    df = spark.range(n + 1000).select(F.format_string("c%07d", "id").alias("customerID"),
                                      F.when(F.col("id") < n, F.format_string("v%06d", (F.col("id") * 7919) % n)).otherwise("v000000").alias("code"),
                                      F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("kind"))
    collected, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(real(self)) or collected[-1])
    levels = prepare.level_table(df, ["kind", "code"])
    out = prepare.one_hot_sparse(df.where("code <> 'v000005'").unionAll(df.limit(1).select("customerID", F.lit("new"), "kind")), levels, ["kind", "code"])
    assert out.columns == ["customerID", "one_hot"] and out.count() == n + 1000
    assert sum(len(rows) for rows in collected) < 1000
    monkeypatch.undo()
    got = {r.customerID: r.one_hot for r in out.where("customerID in ('c0000001', 'c0000003', 'c0200500')").collect()}
    assert got["c0000001"].size == n + 1 and got["c0000001"].indices == [0, 1 + 7919] and got["c0000001"]["values"] == [1.0, 1.0]
    assert got["c0000003"].indices == [1 + 3 * 7919] and got["c0200500"].indices == [0, 1]
    assert levels.where("column = 'code'").agg(F.count_distinct("id"), F.min("id"), F.max("id")).first() == (n, 0, n - 1)
    with pytest.raises(ValueError):
        prepare.fit_categories(df, ["code"])


def test_fit_partitions_stay_few():
    """A fit's jobs run over all its partitions, level by level and tree by tree: their number does not follow the rows."""
    from churnlens.operators.model import MOST_ROWS, fit_partitions
    assert [fit_partitions(n) for n in (0, 1, 20_000, 20_001, 100_000)] == [1, 1, 1, 2, 5]
    assert fit_partitions(1_077_408) == fit_partitions(7_000_000) == 24
    assert fit_partitions(100 * MOST_ROWS) == 100


def test_nearest_by_product_is_exact():
    """Candidates are told by a matrix product far from the origin, with ties and copies; results are those of all pairs."""
    from churnlens.operators import neighbors
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.integers(0, 3, (400, 4)), rng.normal(size=(300, 4)) * 1e-7, rng.normal(size=(50, 4)) * 1e-3]) + 1e6
    names = rng.permutation(np.array([f"n{i:04d}" for i in range(len(c))], dtype=object))
    i, k, dist = neighbors.nearest_within(c, np.full(len(c), np.inf), c, names, 6)
    every = np.zeros((len(c), len(c)))
    for j in range(4):
        every += (c[:, j][:, None] - c[None, :, j]) ** 2
    every = np.sqrt(every)
    for r in range(len(c)):
        want = sorted(range(len(c)), key=lambda x: (every[r, x], names[x]))[:6]
        assert k[i == r].tolist() == want and dist[i == r].tolist() == every[r, want].tolist()


def test_exact_neighbours_travel_once_a_region(spark, monkeypatch):
    """Where no box is out of reach a row is copied once to a region, not to every block, and results stay exact."""
    from churnlens.operators import neighbors
    monkeypatch.setattr(neighbors, "BLOCK", 32)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 32)
    x = np.random.default_rng(4).normal(size=(900, 24))
    df = spark.createDataFrame([(f"r{i:04d}", v.tolist(), 1) for i, v in enumerate(x)], "vid string, vec array<double>, m bigint")
    first, sent, _ = neighbors._exact_parts(df, 900, 4, None, 42)
    assert first.select("block").distinct().count() > 20
    assert sent.count() <= 900 * first.select("region").distinct().count() <= 900 * 10
    got = neighbors.knn_all(df, k=3, id_col="vid").toPandas().sort_values(["vid", "rank"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :3]
    assert got.neighbor_id.tolist() == [f"r{j:04d}" for row in want for j in row]


def test_kmeans_passes_read_arrow(spark):
    """A pass adds up its rows column by column: the same places, distances and sums as one row at a time; rows of another length are an error."""
    import pyarrow as pa
    from churnlens.operators import segments
    x = np.random.default_rng(5).normal(size=(500, 3))
    x[::7] = x[0]
    centres = np.array([x[0], x[1], x[0], x[2]])
    d2 = sum((x[:, j][:, None] - centres[None, :, j]) ** 2 for j in range(3))
    at, best = segments._nearest(segments._rows(pa.array(x.tolist()), 3), centres)
    assert (at == d2.argmin(1)).all() and (best == d2.min(1)).all()
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    n, sums, cost = segments._pass(df, "x", {4: centres})[4]
    assert n.tolist() == np.bincount(d2.argmin(1), minlength=4).tolist() and cost == pytest.approx(d2.min(1).sum())
    assert np.allclose(sums[0], x[d2.argmin(1) == 0].sum(0))
    with pytest.raises(ValueError):
        segments._rows(pa.array([[1.0, 2.0], [3.0]]), 2)


def test_fits_are_not_sent_the_plan_of_their_rows(spark, monkeypatch):
    """A fit reads checkpointed rows, dealt and sorted as before, not what they were computed from."""
    from churnlens.operators import model
    from churnlens.schema import LABEL_COL
    seen = []

    class Fit:
        def __init__(self, stages):
            pass

        def fit(self, data):
            seen.append((data.rdd.toDebugString().decode(), [[r["x"] for r in p] for p in data.rdd.glom().collect()]))

    monkeypatch.setattr(model, "Pipeline", Fit)
    monkeypatch.setattr(model, "ROWS_PER_PARTITION", 100)
    df = spark.range(300).selectExpr("cast(id as string) as customerID", "cast(id as double) as x", f"id % 2 as `{LABEL_COL}`")
    model.train(df, ["x"], LABEL_COL)
    plan, rows = seen[0]
    dealt = df.repartition(3, "customerID").sortWithinPartitions("customerID")
    assert rows == [[r["x"] for r in p] for p in dealt.rdd.glom().collect()]
    assert "ShuffledRowRDD" not in plan

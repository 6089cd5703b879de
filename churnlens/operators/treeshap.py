"""Exact tree attributions for Spark tree ensembles (XAI1, XAI3).

Path-dependent TreeSHAP (Lundberg et al., 2018) rewritten per leaf: for a leaf
with value v whose path splits on the distinct features D (d = |D|), the leaf
adds to phi_i, for i in D,

    v * (o_i - z_i) * sum over S subset of D \\ {i} of |S|! (d-|S|-1)! / d!
                      * prod_{j in S} o_j * prod_{j in D \\ {i} \\ S} z_j

where o_j = 1 when the row satisfies every split on j along the path and z_j is
the product of the cover fractions of those splits. As o is a bit pattern, the
2^d x d coefficients of each leaf are computed once on the driver from the
model (its size, not the data's) and broadcast; each executor then needs d
comparisons and one table lookup per leaf and row, vectorised with NumPy in
``mapInPandas``. Sum of phi plus the base value equals the log-odds margin.

Deeper models have no such tables. The weighted sum over subsets is an integral,

    integral over t in [0, 1] of prod_{j in D \\ {i}} (z_j (1 - t) + o_j t),

a polynomial in t that Gauss-Legendre nodes integrate exactly. At each node the
product over a path grows by one factor per split, shared by all leaves below it,
and the leaves' values are added up from below, so a row costs one pass down and
one up a tree: splits times nodes, whatever the number of leaves under a path.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_path

ROWS_PER_CHUNK = 256


def _gbt_stage(model):
    stages = getattr(model, "stages", None)
    return stages[-1] if stages else model


def leaf_table(spark: SparkSession, model) -> dict:
    """Per-leaf path summaries of a fitted GBT (classification) or tree ensemble.

    The model is written with Spark ML persistence and its node table read back
    (a few thousand rows at most: the size of the model).
    """
    gbt = _gbt_stage(model)
    path = scratch_path(spark, "tree_model")
    gbt.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").collect()
    weights = list(gbt.treeWeights) if hasattr(gbt, "treeWeights") else [1.0] * gbt.getNumTrees
    is_gbt_classifier = type(gbt).__name__ == "GBTClassificationModel"
    scale = 2.0 if is_gbt_classifier else 1.0   # log-odds = 2 * raw margin for Spark's logistic loss
    trees: dict = {}
    for r in nodes:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    edges = [_edges(tree, weights[tid] * scale) for tid, tree in sorted(trees.items())]
    leaves = []   # (value, features tuple, lo array, hi array, z array)
    base = 0.0
    for tid, tree in trees.items():
        w = weights[tid] * scale
        root_count = float(tree[0]["rawCount"])
        stack = [(0, {})]
        while stack:
            nid, path_info = stack.pop()
            node = tree[nid]
            if node["leftChild"] < 0:
                v = w * float(node["prediction"])
                base += v * float(node["rawCount"]) / root_count
                feats = tuple(sorted(path_info))
                lo = np.array([path_info[f][0] for f in feats], dtype=float)
                hi = np.array([path_info[f][1] for f in feats], dtype=float)
                z = np.array([path_info[f][2] for f in feats], dtype=float)
                leaves.append((v, feats, lo, hi, z))
                continue
            if node["numCategories"] not in (-1, None) and node["numCategories"] > 0:
                raise ValueError("categorical splits are not supported: assemble features as numeric")
            f = node["featureIndex"]
            t = float(node["leftCategoriesOrThreshold"][0])
            cnt = float(node["rawCount"])
            for child, is_left in ((node["leftChild"], True), (node["rightChild"], False)):
                frac = float(tree[child]["rawCount"]) / cnt if cnt > 0 else 0.0
                lo_, hi_, z_ = path_info.get(f, (-math.inf, math.inf, 1.0))
                new = dict(path_info)
                new[f] = (lo_, min(hi_, t), z_ * frac) if is_left else (max(lo_, t), hi_, z_ * frac)
                stack.append((child, new))
    return {"leaves": leaves, "base": base, "trees": edges}


def _edges(tree: dict, weight: float) -> dict:
    """A tree's nodes but its root, level by level, siblings together (left, right).

    ``up``: the parent's place (-1: the root); ``prev``: the nearest node above that tests the same feature, -1 for none;
    ``z``: product of the cover fractions of the feature's splits so far; ``v``: the value of a leaf."""
    out: dict = {k: [] for k in ("feature", "cut", "left", "up", "prev", "z", "v", "tests")}
    starts, now = [0], [(0, -1, {})]  # node, its place, places of the features tested above
    while now:
        below = []
        for nid, at, seen in now:
            node = tree[nid]
            if node["leftChild"] < 0:
                continue
            f, cover = node["featureIndex"], float(node["rawCount"])
            for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
                below_node, place, prev = tree[child], len(out["z"]), seen.get(f, -1)
                share = float(below_node["rawCount"]) / cover if cover > 0 else 0.0
                out["feature"].append(f)
                out["cut"].append(float(node["leftCategoriesOrThreshold"][0]))
                out["left"].append(left)
                out["up"].append(at)
                out["prev"].append(prev)
                out["z"].append(share * (out["z"][prev] if prev >= 0 else 1.0))
                out["v"].append(weight * float(below_node["prediction"]) if below_node["leftChild"] < 0 else 0.0)
                out["tests"].append(len(seen) + (prev < 0))
                below.append((child, place, {**seen, f: place}))
        now = below
        starts.append(len(out["z"]))
    return {"starts": starts[:-1] if len(starts) > 1 and starts[-1] == starts[-2] else starts,
            **{k: np.array(v, {"left": bool, "cut": float, "z": float, "v": float}.get(k, np.int64)) for k, v in out.items()}}


def tree_values(x: np.ndarray, tree: dict, n_features: int) -> np.ndarray:
    """phi (n, features) of one tree for the rows x, by one pass down and one up."""
    n, size = len(x), len(tree["z"])
    if not size:
        return np.zeros((n, n_features))
    t, w = np.polynomial.legendre.leggauss(max(1, (int(tree["tests"].max()) + 1) // 2))
    t, w = (t + 1) / 2, w / 2
    prev, z = tree["prev"], tree["z"]
    low = x[:, tree["feature"]] <= tree["cut"]
    o = np.where(tree["left"], low, ~low).astype(float)
    levels = [slice(a, b) for a, b in zip(tree["starts"][:-1], tree["starts"][1:])]
    for k in levels:
        again = np.flatnonzero(prev[k] >= 0) + k.start
        o[:, again] *= o[:, prev[again]]
    f = z[None, :, None] * (1 - t) + o[:, :, None] * t
    # 1 / f, 0 where a path has neither rows nor the row itself: the difference below is 0 there too
    inverse = np.divide(1.0, f, out=np.zeros_like(f), where=f > 0)
    down = f.copy()
    again = np.flatnonzero(prev >= 0)
    down[:, again] *= inverse[:, prev[again]]
    for k in levels[1:]:
        down[:, k] *= down[:, tree["up"][k]]
    up = down * tree["v"][None, :, None]
    for k in reversed(levels[1:]):
        up[:, tree["up"][k][::2]] += up[:, k][:, 0::2] + up[:, k][:, 1::2]
    part = inverse * (o - z[None, :])[:, :, None]
    own = part.copy()
    own[:, again] -= part[:, prev[again]]
    share = (up * own) @ w
    which = np.zeros((size, n_features))
    which[np.arange(size), tree["feature"]] = 1.0
    return share @ which


def _coefficients(z: np.ndarray) -> np.ndarray:
    """(L, 2^d, d) table of phi_i / v for every bit pattern of o (bit j set: o_j = 1).

    For fixed o and i, the subset sum is sum_s w(s) * [t^s] prod_{j != i} (z_j + o_j t):
    the polynomial is built by d - 1 multiplications, vectorised over leaves and patterns.
    """
    n_leaves, d = z.shape
    fact = [math.factorial(k) for k in range(d + 1)]
    w = np.array([fact[k] * fact[d - k - 1] / fact[d] for k in range(d)])
    o = ((np.arange(1 << d)[:, None] >> np.arange(d)[None, :]) & 1).astype(float)   # (2^d, d)
    out = np.zeros((n_leaves, 1 << d, d))
    for i in range(d):
        poly = np.zeros((n_leaves, 1 << d, d))
        poly[:, :, 0] = 1.0
        for j in range(d):
            if j == i:
                continue
            shifted = np.zeros_like(poly)
            shifted[:, :, 1:] = poly[:, :, :-1]
            poly = poly * z[:, j][:, None, None] + shifted * o[:, j][None, :, None]
        total = (poly * w[None, None, :]).sum(axis=2)
        out[:, :, i] = (o[None, :, i] - z[:, i][:, None]) * total
    return out


TABLE_DEPTH = 8             # longest path whose 2^d answers are tabulated
TABLE_BYTES = 1 << 26       # of all tables together; a model beyond either is read tree by tree
CELLS = 1 << 21             # rows x leaves (or splits) x path length handled at a time


def compile_tables(lt: dict, n_features: int) -> dict:
    """Group leaves by path length d into dense arrays for vectorised lookup of their 2^d answers; without
    tables where a path is longer than ``TABLE_DEPTH`` or they would exceed ``TABLE_BYTES``."""
    base = {"n_features": n_features, "base": lt["base"], "trees": lt.get("trees")}
    groups: dict = {}
    for v, feats, lo, hi, z in lt["leaves"]:
        g = groups.setdefault(len(feats), {"v": [], "f": [], "lo": [], "hi": [], "z": []})
        g["v"].append(v)
        g["f"].append(feats)
        g["lo"].append(lo)
        g["hi"].append(hi)
        g["z"].append(z)
    if max(groups, default=0) > TABLE_DEPTH or sum(len(g["v"]) * d * 8 << d for d, g in groups.items()) > TABLE_BYTES:
        return {**base, "groups": None}
    out = {}
    for d, g in sorted(groups.items()):
        if d == 0:
            continue
        n = len(g["v"])
        v = np.array(g["v"], dtype=float)
        z = np.array(g["z"], dtype=float).reshape(n, d)
        out[d] = {"f": np.array(g["f"], dtype=int).reshape(n, d), "lo": np.array(g["lo"]).reshape(n, d),
                  "hi": np.array(g["hi"]).reshape(n, d), "tab": _coefficients(z) * v[:, None, None]}
    return {**base, "groups": out, "trees": None}


def shap_matrix(x: np.ndarray, tables: dict) -> np.ndarray:
    """phi for a batch of rows x (n, M), a bounded number of leaves or rows of a tree at a time."""
    n, m = x.shape
    if tables["groups"] is None:
        phi = np.zeros((n, m))
        for tree in tables["trees"]:
            step = max(1, CELLS // max(1, len(tree["z"]) * ((int(tree["tests"].max(initial=1)) + 1) // 2)))
            for at in range(0, n, step):
                phi[at:at + step] += tree_values(x[at:at + step], tree, m)
        return phi
    phi = np.zeros(n * m)
    for d, g in tables["groups"].items():
        step = max(1, CELLS // max(1, n * d))
        for at in range(0, g["f"].shape[0], step):
            k = slice(at, at + step)
            f = g["f"][k]
            xv = x[:, f]                                             # (n, L, d)
            o = (xv > g["lo"][k][None]) & (xv <= g["hi"][k][None])   # inside (lo, hi]
            bits = (o * (1 << np.arange(d))[None, None, :]).sum(axis=2)      # (n, L)
            coef = g["tab"][k][np.arange(len(f))[None, :], bits]             # (n, L, d)
            idx = (np.arange(n)[:, None, None] * m + f[None, :, :]).reshape(-1)
            phi += np.bincount(idx, weights=coef.reshape(-1), minlength=n * m)
    return phi.reshape(n, m)


def tree_shap(model, df: DataFrame, features: list[str], id_col: str = "customerID",
              long: bool = True) -> tuple[DataFrame, float]:
    """XAI1: attributions for every row of ``df``; returns (table, base value).

    Long form: (id, feature, feature_value, shap_value). Wide form: id + an
    array<double> ``shap`` in feature order plus ``margin``.
    """
    spark = df.sparkSession
    tables = compile_tables(leaf_table(spark, model), len(features))
    bc = spark.sparkContext.broadcast(tables)
    base = tables["base"]
    feats = list(features)

    def attribute(batches):
        import pandas as pd
        t = bc.value
        for pdf in batches:
            for start in range(0, len(pdf), ROWS_PER_CHUNK):
                part = pdf.iloc[start:start + ROWS_PER_CHUNK]
                x = part[feats].to_numpy(dtype=float)
                phi = shap_matrix(x, t)
                if long:
                    yield pd.DataFrame({
                        id_col: np.repeat(part[id_col].to_numpy(), len(feats)),
                        "feature": np.tile(np.array(feats, dtype=object), len(part)),
                        "feature_value": x.reshape(-1), "shap_value": phi.reshape(-1)})
                else:
                    yield pd.DataFrame({id_col: part[id_col].to_numpy(), "shap": list(phi),
                                        "margin": phi.sum(axis=1) + t["base"]})

    inp = df.select(F.col(id_col).cast("string").alias(id_col),
                    *[F.col(f"`{c}`").cast("double").alias(c) for c in feats])
    schema = (f"`{id_col}` string, feature string, feature_value double, shap_value double" if long
              else f"`{id_col}` string, shap array<double>, margin double")
    return inp.mapInPandas(attribute, schema), base


def base_value(spark: SparkSession, model) -> float:
    """XAI3: expected margin = sum over leaves of value * cover / root cover."""
    return leaf_table(spark, model)["base"]

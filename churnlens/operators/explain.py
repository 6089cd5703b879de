"""Attribution tables and everything built on them (XAI2, XAI4-9).

One row per customer holds its attributions as ``attrs``, an array of
(feature, feature_value, shap_value). Per-customer steps (top factors, bars,
waterfall, prompt lines) sort, cut and fold that array with higher-order
functions, so they need no shuffle at all; rows are exploded last. Per-feature
steps (importance, beeswarm scaling) explode and group by feature: partial
aggregation first, then one small row per feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from churnlens.functions.scalars import fixed_text, keyed_uniform, percent_text, signed_text
from churnlens.schema import ID_COL, SCORE_COL

# --- Fixed values: wording (English re-wording of the reference's labels) ---
RAISES = "raises risk"
LOWERS = "lowers risk"
OTHERS = "Other features"
PREDICTION = "Prediction"
FACTOR_HEADER = "Churn risk: "
FACTOR_TITLE = "Main risk factors (attributions):"
EPS = 1e-9
JITTER = 0.3
# --- end of fixed values ---


def direction(shap: Column) -> Column:
    """> 0 raises risk; zero or below lowers it (as the reference)."""
    return F.when(shap > 0, F.lit(RAISES)).otherwise(F.lit(LOWERS))


ATTRS = "array<struct<feature:string,feature_value:double,shap_value:double>>"


def linear_shap(df: DataFrame, weights: dict[str, float], digits: int | None = 6) -> tuple[DataFrame, DataFrame]:
    """XAI2: phi = w * (x - mean x) for a linear margin; returns (customerID with ``attrs``, base).

    Means come from one global aggregate; ``base`` is a one-row table holding
    the mean margin. Sum of phi plus base equals the margin of every row.
    """
    feats = [f for f in weights if f in df.columns]
    means = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"m{i}") for i, f in enumerate(feats)]).first()
    mean = {f: float(means[f"m{i}"]) for i, f in enumerate(feats)}

    def phi(f):
        x = F.lit(weights[f]) * (F.col(f"`{f}`").cast("double") - F.lit(mean[f]))
        return x if digits is None else F.round(x, digits)

    out = df.select(ID_COL, F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("feature_value"), phi(f).alias("shap_value"))
        for f in feats]).cast(ATTRS).alias("attrs"))
    base_value = sum(weights[f] * mean[f] for f in feats)
    base = df.sparkSession.range(1).select(F.lit(base_value).alias("base_value"))
    return out, base


def long_form(attr: DataFrame) -> DataFrame:
    """customerID, feature, feature_value, shap_value: one row per attribution."""
    return attr.select(ID_COL, F.inline("attrs"))


def _largest(n: int | None = None) -> Column:
    """``attrs`` by |phi|, largest first, ties by feature; the first n."""
    # the natural order of structs is compiled; a comparison function would be interpreted for every pair
    keyed = F.transform("attrs", lambda x: F.struct((-F.abs(x["shap_value"])).alias("size"), x["feature"].alias("name"), x.alias("item")))
    ordered = F.transform(F.sort_array(keyed), lambda x: x["item"])
    return ordered if n is None else F.slice(ordered, 1, n)


def factors_array(attr: DataFrame, n: int = 5) -> DataFrame:
    """XAI4: the n largest |phi| per customer as ``factors`` array<struct<feature, shap_value, direction>> in rank order."""
    return attr.select(ID_COL, F.transform(_largest(n), lambda x: F.struct(
        x["feature"].alias("feature"), x["shap_value"].alias("shap_value"),
        direction(x["shap_value"]).alias("direction"))).alias("factors"))


def top_factors(attr: DataFrame, n: int = 5) -> DataFrame:
    """XAI4, a row per factor: customerID, rank (from 1), feature, shap_value, direction."""
    return factors_array(attr, n).select(ID_COL, F.posexplode("factors").alias("rank", "f")).select(
        ID_COL, (F.col("rank") + 1).alias("rank"), "f.feature", "f.shap_value", "f.direction")


def global_importance(long: DataFrame, n: int = 15) -> DataFrame:
    """XAI5 / AGG6: mean |phi| per feature of long-form attributions, the n largest (ties by feature)."""
    agg = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
    return agg.orderBy(F.col("mean_abs_shap").desc(), "feature").limit(n)


def importance_for_chart(long: DataFrame, n: int = 12) -> DataFrame:
    """TOP3: the n most important features in ascending order (bar-chart order)."""
    rows = global_importance(long, n)  # n rows
    order = (F.col("mean_abs_shap").asc(), F.col("feature").desc())
    return rows.withColumn("position", F.row_number().over(W.orderBy(*order))).orderBy("position")


def factor_bars(attr: DataFrame, n: int = 5) -> DataFrame:
    """XAI6: rank, feature and bar length int(|phi| / (max |phi| + 1e-9) * 100) of the n largest."""
    top = F.col("factors")
    most = F.abs(F.get(top, F.lit(0))["shap_value"])  # the first is the largest
    bars = F.transform(top, lambda x: F.struct(
        x["feature"].alias("feature"), x["shap_value"].alias("shap_value"),
        F.floor(F.abs(x["shap_value"]) / (most + F.lit(EPS)) * F.lit(100.0)).cast("int").alias("bar_pct")))
    return factors_array(attr, n).select(ID_COL, F.posexplode(bars).alias("rank", "b")).select(
        ID_COL, (F.col("rank") + 1).alias("rank"), "b.feature", "b.shap_value", "b.bar_pct")


def waterfall(attr: DataFrame, base: float, n: int = 10) -> DataFrame:
    """XAI7: per customer the n largest |phi| sorted by phi, 'others', then the total.

    The total row carries the margin (base + sum phi) and its probability as two
    separate columns. ``start`` / ``end`` are the running positions from base.
    """
    def total(col):
        return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x["shap_value"])

    shown = F.array_sort(F.col("shown"), lambda a, b: F.when(a["shap_value"] < b["shap_value"], -1)
                         .when(a["shap_value"] > b["shap_value"], 1)
                         .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0))
    parts = attr.select(ID_COL, "attrs", _largest(n).alias("shown")).select(
        ID_COL, shown.alias("shown"), total("attrs").alias("total"), total("shown").alias("part"))
    items = F.concat(F.transform("shown", lambda x: F.struct(x["feature"].alias("item"), x["shap_value"].alias("value"))),
                     F.array(F.struct(F.lit(OTHERS).alias("item"), (F.col("total") - F.col("part")).alias("value"))))
    step = "struct<step:int,item:string,value:double,start:double,end:double,text:string,probability:double>"
    rows = F.aggregate(
        items, F.struct(F.lit(float(base)).alias("at"), F.array().cast(f"array<{step}>").alias("rows")),
        lambda acc, x: F.struct(
            (acc["at"] + x["value"]).alias("at"),
            F.array_append(acc["rows"], F.struct(
                (F.size(acc["rows"]) + 1).alias("step"), x["item"].alias("item"), x["value"].alias("value"),
                acc["at"].alias("start"), (acc["at"] + x["value"]).alias("end"), signed_text(x["value"], 3).alias("text"),
                F.lit(None).cast("double").alias("probability")).cast(step)).alias("rows")),
        lambda acc: acc["rows"])
    margin = F.lit(float(base)) + F.col("total")
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    last = F.struct((F.size("shown") + 2).alias("step"), F.lit(PREDICTION).alias("item"), margin.alias("value"), F.lit(0.0).alias("start"),
                    margin.alias("end"), percent_text(share).alias("text"), share.alias("probability")).cast(step)
    return parts.select(ID_COL, F.inline(F.array_append(rows, last)))


def beeswarm(attr: DataFrame, n: int = 12, seed: int = 42) -> DataFrame:
    """XAI8: points of the n most important features: phi, min-max scaled value,
    rank and a keyed jitter in [-0.3, 0.3) (reproducible under any partitioning).
    Importance and value range come from one aggregate."""
    long = long_form(attr)
    stats = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("_m"), F.min("feature_value").alias("_lo"),
                                        F.max("feature_value").alias("_hi"))
    ranks = stats.orderBy(F.col("_m").desc(), "feature").limit(n).select(
        "feature", "_lo", "_hi", (F.row_number().over(W.orderBy(F.col("_m").desc(), "feature")) - 1).alias("rank"))  # n rows
    pts = long.join(F.broadcast(ranks), "feature")
    jitter = F.lit(-JITTER) + F.lit(2 * JITTER) * keyed_uniform(F.concat(F.col(ID_COL), F.lit("|"), F.col("feature")),
                                                                seed)
    return pts.select(ID_COL, "feature", F.col("rank").cast("int").alias("rank"), "shap_value",
                      ((F.col("feature_value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(EPS)))
                      .alias("norm_value"),
                      jitter.alias("jitter"),
                      (F.lit(float(n - 1)) - F.col("rank") + jitter).alias("y"))


def factor_text(factors: DataFrame, scores: DataFrame, p: str = SCORE_COL) -> DataFrame:
    """XAI9: prompt context per customer: risk in percent, then numbered factor lines."""
    empty = F.array().cast("array<struct<feature:string,shap_value:double,direction:string>>")
    lines = F.transform(F.coalesce("factors", empty), lambda f, i: F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), f["feature"], F.lit(": SHAP="),
        fixed_text(f["shap_value"], 3), F.lit(" ("), f["direction"], F.lit(")")))
    return scores.select(ID_COL, p).join(factors, ID_COL, "left").select(
        ID_COL, F.concat_ws("\n", F.concat(F.lit(FACTOR_HEADER), percent_text(p)), F.lit(FACTOR_TITLE),
                            F.array_join(lines, "\n")).alias("factor_text"))

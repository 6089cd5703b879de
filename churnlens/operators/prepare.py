"""Cleaning, encoding and scaling (one projection each, fitted state as values).

Fitting reads the table with global aggregates only (partial aggregation on
every partition, a handful of scalars to the driver); applying is a single
``select`` with literals, so it streams, stays in whole-stage codegen and
needs no join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators.select import exact_median
from churnlens.session import scratch_path
from churnlens.schema import (BINARY_COLS, CATEGORICAL_COLS, ID_COL, LABEL_COL, NUMERIC_COLS,
                              SERVICE_COLS, SERVICE_VALUES, TARGET_COL)


@dataclass(frozen=True)
class Fitted:
    """Everything learned from training data that encoding new rows needs."""
    categories: dict = field(default_factory=dict)   # column -> sorted levels
    medians: dict = field(default_factory=dict)      # column -> median
    scaler: dict = field(default_factory=dict)       # column -> (mean, std)
    features: tuple = ()                             # encoded feature order

    def to_json(self) -> str:
        return json.dumps({"categories": self.categories, "medians": self.medians,
                           "scaler": {k: list(v) for k, v in self.scaler.items()},
                           "features": list(self.features)})

    @staticmethod
    def from_json(s: str) -> "Fitted":
        d = json.loads(s)
        return Fitted(d["categories"], d["medians"], {k: tuple(v) for k, v in d["scaler"].items()},
                      tuple(d["features"]))


# ---------------------------------------------------------------- cleaning

def to_number_col(c: str | Column) -> Column:
    """Text to double; blank or malformed text becomes null (CLN1)."""
    c = F.col(c) if isinstance(c, str) else c
    return _try_double(c)


def _try_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def to_number(df: DataFrame, col: str = "TotalCharges") -> DataFrame:
    return df.withColumn(col, _try_double(F.col(col)))


def fit_median(df: DataFrame, col: str = "TotalCharges") -> float | None:
    """Exact median (mean of the two middle values) of the numeric form of ``col``."""
    return exact_median(df, _try_double(F.col(col)) if dict(df.dtypes)[col] == "string" else F.col(col))


def fill_median(df: DataFrame, col: str = "TotalCharges", median: float | None = None) -> DataFrame:
    """CLN1 + CLN2: numeric conversion, nulls replaced by the (given or fitted) median."""
    out = to_number(df, col)
    if median is None:
        median = fit_median(out, col)
    if median is None:
        return out
    return out.withColumn(col, F.coalesce(F.col(col), F.lit(float(median))))


def clean(df: DataFrame, medians: dict | None = None) -> tuple[DataFrame, dict]:
    """Clean ``TotalCharges`` as the reference does; returns the medians used."""
    medians = dict(medians or {})
    if "TotalCharges" in df.columns:
        df = to_number(df, "TotalCharges")
        if "TotalCharges" not in medians:
            medians["TotalCharges"] = fit_median(df, "TotalCharges")
        if medians["TotalCharges"] is not None:
            df = df.withColumn("TotalCharges",
                               F.coalesce(F.col("TotalCharges"), F.lit(float(medians["TotalCharges"]))))
    return df, medians


def feature_columns(df: DataFrame) -> list[str]:
    """CLN3: every column but the key, target and label."""
    return [c for c in df.columns if c not in (ID_COL, TARGET_COL, LABEL_COL, "split")]


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """CLN4: remaining nulls of numeric feature columns become 0."""
    cols = cols or feature_columns(df)
    numeric = [c for c, t in df.dtypes if c in cols and t not in ("string", "boolean")
               and not t.startswith(("array", "struct", "map"))]
    return df.na.fill(0, subset=numeric) if numeric else df


# ---------------------------------------------------------------- encoding

def encode_target_col(c: str | Column = TARGET_COL) -> Column:
    """ENC1: "Yes" -> 1, anything else (null included) -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c == F.lit("Yes")).cast("int"), F.lit(0))


def encode_binary_col(c: str | Column) -> Column:
    """ENC2: "Yes" -> 1, anything else -> 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c == F.lit("Yes")).cast("int"), F.lit(0))


def encode_gender_col(c: str | Column = "gender") -> Column:
    """ENC4: "Male" -> 1, else 0 (the single-row rule of the reference)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce((c == F.lit("Male")).cast("int"), F.lit(0))


def encode_service_col(c: str | Column) -> Column:
    """ENC3: four-key map; unknown or null -> null (CLN4 turns it into 0)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.create_map(*[x for k, v in SERVICE_VALUES.items() for x in (F.lit(k), F.lit(v))])
    return m[c].cast("int")


def encode_target(df: DataFrame) -> DataFrame:
    return df.withColumn(LABEL_COL, encode_target_col(TARGET_COL))


def encode_binary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or BINARY_COLS) if c in df.columns and c != "gender"]
    return df.withColumns({c: encode_binary_col(c) for c in cols})


def encode_gender(df: DataFrame) -> DataFrame:
    return df.withColumn("gender", encode_gender_col("gender")) if "gender" in df.columns else df


def encode_service(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = [c for c in (cols or SERVICE_COLS) if c in df.columns]
    return df.withColumns({c: encode_service_col(c) for c in cols})


MAX_LEVELS = 1_000


def fit_categories(df: DataFrame, cols: list[str] | None = None,
                   max_levels: int | None = MAX_LEVELS) -> dict[str, list[str]]:
    """Sorted distinct non-null levels per categorical column, in one aggregate job.

    The distinct (column, value) pairs are computed on the executors. One-hot
    columns are part of the plan, so their levels come to the driver, at most
    ``max_levels`` of a column; a column with more is an error, and is encoded with
    ``level_table`` and ``one_hot_sparse``, which collect no level.
    """
    cols = [c for c in (cols or CATEGORICAL_COLS) if c in df.columns]
    if not cols:
        return {}
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val")) for c in cols
    ])).alias("p")).select("p.col", "p.val").where(F.col("val").isNotNull()).distinct()
    rows = (pairs if max_levels is None else pairs.limit(max_levels * len(cols) + 1)).collect()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in rows:
        out[r["col"]].append(r["val"])
    for c, levels in out.items():
        if max_levels is not None and len(levels) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels; not a categorical column")
        levels.sort()
    return out


def level_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """ENC5 for any number of levels: (column, level, id), ids dense from 0 in the levels' order in each column.

    The distinct pairs are range-partitioned in order and written; a task numbers its own range, and what comes to the
    driver is one count per column and task, never a level."""
    spark = df.sparkSession
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols])).alias("p")) \
        .select("p.column", "p.level").where(F.col("level").isNotNull()).distinct()
    path = scratch_path(spark, "levels")
    pairs.repartitionByRange("column", "level").sortWithinPartitions("column", "level").withColumn("task", F.spark_partition_id()) \
        .withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before: dict = {}
    first = []
    for r in rows.groupBy("column", "task").agg(F.count("*").alias("n"), F.min("at").alias("least")).orderBy("column", "task").collect():
        first.append((r["column"], r["task"], before.get(r["column"], 0) - r["least"]))
        before[r["column"]] = before.get(r["column"], 0) + r["n"]
    shift = spark.createDataFrame(first, "column string, task int, shift bigint")
    return rows.join(F.broadcast(shift), ["column", "task"]).select("column", "level", (F.col("at") + F.col("shift")).alias("id"))


def one_hot_sparse(df: DataFrame, levels: DataFrame, cols: list[str], out: str = "one_hot") -> DataFrame:
    """ENC6 for any number of levels: ``out`` is a sparse vector, struct(size, indices, values), in place of ``cols``.

    Positions follow ``cols``, then the levels' ids; a null or unknown value has no entry. ``levels`` is joined column by
    column (broadcast where Spark finds it small, else by shuffle with skewed levels split), not collected."""
    sizes = {r["column"]: r["n"] for r in levels.groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    start, joined = 0, df
    entries = []
    for k, c in enumerate(cols):
        own = levels.where(F.col("column") == c).select(F.col("level").alias(f"_level{k}"), (F.col("id") + start).alias(f"_id{k}"))
        joined = joined.join(own, F.col(f"`{c}`").cast("string") == F.col(f"_level{k}"), "left")
        entries.append(F.col(f"_id{k}"))
        start += sizes.get(c, 0)
    found = F.array_compact(F.array(*entries)) if entries else F.array().cast("array<bigint>")
    vector = F.struct(F.lit(start).cast("bigint").alias("size"), found.alias("indices"), F.transform(found, lambda x: F.lit(1.0)).alias("values"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], vector.alias(out))


def one_hot_cols(categories: dict[str, list[str]]) -> dict[str, Column]:
    """ENC5 + ENC6: one int column per fitted level, named ``<col>_<level>``."""
    out = {}
    for c, levels in categories.items():
        for v in levels:
            out[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
    return out


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    present = {c: v for c, v in categories.items() if c in df.columns}
    return df.select(*[c for c in df.columns if c not in present],
                     *[col.alias(name) for name, col in one_hot_cols(present).items()])


def encode_columns(df: DataFrame, categories: dict[str, list[str]],
                   with_label: bool = True) -> list[Column]:
    """The whole encoder as one list of expressions (ENC1-6 + CLN4)."""
    dtypes = dict(df.dtypes)
    out = [F.col(ID_COL)] if ID_COL in df.columns else []
    if with_label:
        out.append((encode_target_col(TARGET_COL) if TARGET_COL in df.columns
                    else F.lit(None).cast("int")).alias(LABEL_COL))
    for c in df.columns:
        if c in (ID_COL, TARGET_COL, LABEL_COL) or c in categories:
            continue
        if c == "gender":
            e = encode_gender_col(c)
        elif c in BINARY_COLS:
            e = encode_binary_col(c)
        elif c in SERVICE_COLS:
            e = F.coalesce(encode_service_col(c), F.lit(0))
        elif dtypes[c] in ("string", "boolean") or dtypes[c].startswith(("array", "struct", "map")):
            e = F.col(c) if dtypes[c] != "boolean" else F.col(c).cast("int")
        else:
            e = F.coalesce(F.col(c), F.lit(0).cast(dtypes[c]))
        out.append(e.alias(c))
    present = {c: v for c, v in categories.items() if c in df.columns}
    out.extend(col.alias(name) for name, col in one_hot_cols(present).items())
    return out


def encode_features(df: DataFrame, categories: dict[str, list[str]] | None = None) -> DataFrame:
    """ENC7: customerID, label, then the encoded features in the reference's order."""
    if categories is None:
        categories = fit_categories(df)
    return df.select(*encode_columns(df, categories, with_label=TARGET_COL in df.columns))


def encoded_feature_names(df_encoded: DataFrame) -> list[str]:
    return [c for c in df_encoded.columns if c not in (ID_COL, LABEL_COL, "split")]


# ---------------------------------------------------------------- scaling

def fit_scaler(train: DataFrame, cols: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """SCL1: mean and population std per numeric column, one aggregate job."""
    cols = [c for c in (cols or NUMERIC_COLS) if c in train.columns]
    if not cols:
        return {}
    row = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"),
                                                 F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out = {}
    for c in cols:
        s = row[f"s_{c}"]
        out[c] = (float(row[f"m_{c}"] or 0.0), float(s) if s else 1.0)  # zero spread -> divide by 1
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """SCL2: (x - mean) / std as literals; one projection."""
    cols = {c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)) for c, (m, s) in stats.items()
            if c in df.columns}
    return df.withColumns(cols)


def scaler_table(spark: SparkSession, stats: dict, medians: dict | None = None) -> DataFrame:
    """Scaler state as a long table (column, mean, std, median)."""
    medians = medians or {}
    rows = [(c, float(m), float(s), (float(medians[c]) if medians.get(c) is not None else None))
            for c, (m, s) in stats.items()]
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("mean", T.DoubleType()),
                           T.StructField("std", T.DoubleType()), T.StructField("median", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- new rows

def fit(df_raw: DataFrame, train_keys: DataFrame | None = None) -> Fitted:
    """Fit medians on all rows (as the reference), categories on all rows, scaler on train."""
    cleaned, medians = clean(df_raw)
    cats = fit_categories(cleaned)
    enc = encode_features(cleaned, cats)
    train = enc.join(train_keys, ID_COL, "left_semi") if train_keys is not None else enc
    stats = fit_scaler(train)
    return Fitted(cats, medians, stats, tuple(encoded_feature_names(enc)))


def encode_with(df: DataFrame, fitted: Fitted, scale: bool = True) -> DataFrame:
    """ENC8: encode new rows (batch or stream) with fitted categories, median and scaler.

    Unseen levels get all-zero one-hot columns; missing feature columns become 0
    so the output always has the training layout.
    """
    cleaned, _ = clean(df, fitted.medians)
    enc = cleaned.select(*encode_columns(cleaned, fitted.categories, with_label=TARGET_COL in df.columns))
    if fitted.features:
        keep = [c for c in (ID_COL, LABEL_COL) if c in enc.columns]
        enc = enc.select(*keep, *[(F.col(f"`{f}`") if f in enc.columns else F.lit(0)).alias(f)
                                  for f in fitted.features])
    return apply_scaler(enc, fitted.scaler) if scale else enc

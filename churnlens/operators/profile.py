"""Table profiling: shape, missing values, types, label balance (PRF1-7).

Each profile is a single aggregate pass (partial per partition), unpivoted to a
long table afterwards, so the number of jobs does not grow with the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.schema import TARGET_COL


def table_shape(df: DataFrame) -> DataFrame:
    """PRF1: row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))


def missing_counts(df: DataFrame) -> DataFrame:
    """PRF2: (column_name, n_missing) for every column, one pass then unpivot."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return wide.unpivot([], [f"m{i}" for i in range(len(df.columns))], "slot", "n_missing") \
        .select(F.element_at(F.array(*[F.lit(c) for c in df.columns]),
                             F.substring("slot", 2, 10).cast("int") + 1).alias("column_name"),
                F.col("n_missing").cast("bigint").alias("n_missing"))


def column_types(df: DataFrame) -> DataFrame:
    """PRF3: (column_name, dtype, inferred) — the declared type and the type the
    values support: text columns whose non-null values all parse as numbers are
    'int' or 'double' (what a type-inferring reader would make of them). One pass."""
    checks = []
    for i, (c, t) in enumerate(df.dtypes):
        x = F.col(f"`{c}`")
        if t == "string":
            d = F.trim(x).try_cast("double")
            checks += [F.count_if(x.isNotNull() & d.isNull()).alias(f"bad{i}"),
                       F.count_if(d.isNotNull() & (d != F.floor(d))).alias(f"frac{i}")]
    row = df.agg(*checks).first() if checks else None
    out = []
    for i, (c, t) in enumerate(df.dtypes):
        inferred = t
        if t == "string":
            inferred = "string" if row[f"bad{i}"] else ("double" if row[f"frac{i}"] else "int")
        out.append((c, t, inferred))
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("dtype", T.StringType()),
                           T.StructField("inferred", T.StringType())])
    return df.sparkSession.createDataFrame(out, schema)


def churn_rate(df: DataFrame, col: str = TARGET_COL) -> DataFrame:
    """PRF4: share of "Yes" (or 1) among non-null labels."""
    c = F.col(col)
    yes = (c.cast("string") == F.lit("Yes")) | (c.cast("string") == F.lit("1"))
    return df.where(c.isNotNull()).agg(F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("churn_rate"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """PRF5: normalised value counts of one column (nulls excluded, as pandas)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")) \
        .agg(F.count(F.lit(1)).alias("n"))
    total = df.where(F.col(col).isNotNull()).select(F.count(F.lit(1))).scalar()
    return counts.select("value", "n", (F.col("n") / total).alias("share"))


def null_total(df: DataFrame) -> DataFrame:
    """PRF6: total nulls over all columns."""
    return df.agg(sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
                  .cast("bigint").alias("n_null"))


def null_totals(stages: dict[str, DataFrame]) -> DataFrame:
    """PRF6 per named stage of a preparation chain."""
    out = None
    for name, df in stages.items():
        part = null_total(df).select(F.lit(name).alias("stage"), "n_null")
        out = part if out is None else out.unionByName(part)
    return out


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """PRF7: rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))

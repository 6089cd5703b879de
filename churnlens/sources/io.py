"""Readers and writers (SRC1-3, SNK1-6).

Explicit schemas on read (no inference), Parquet by default, ``partitionBy``
where a later read filters on the column (so the filter prunes directories).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.schema import CUSTOMER_SCHEMA, HIGH_RISK, ID_COL, MIN_COLUMNS, SCORE_COL, SPLIT_COL

STATS_SCHEMA = T.StructType([T.StructField("column", T.StringType()), T.StructField("mean", T.DoubleType()),
                             T.StructField("std", T.DoubleType()), T.StructField("median", T.DoubleType())])


def by_name(df: DataFrame, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """Declared columns cast to their types, found by name in any order; all other columns as they are."""
    declared = {f.name: f.dataType for f in schema}
    return df.select(*[F.col(f"`{c}`").cast(declared[c]).alias(c) if c in declared else F.col(f"`{c}`") for c in df.columns])


def load_customers(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = CUSTOMER_SCHEMA) -> DataFrame:
    """SRC1: read the customer table by column name; columns beyond the declared ones are passed through.

    A missing path, and a file of fewer than 5 columns, are errors. A CSV value that does not fit its declared
    type is an error when it is read (ANSI casts).
    """
    try:
        if fmt == "csv":
            df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)  # strings; names from the header
        else:
            df = spark.read.parquet(path)
        cols = df.columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"customer data not found: {path}") from e
        raise
    if len(cols) < MIN_COLUMNS:
        raise ValueError(f"too few columns ({len(cols)}) in {path}: not a customer table")
    return by_name(df, schema) if schema is not None else df


def write_processed(df: DataFrame, path: str) -> None:
    """SNK1: features, label and key, one directory per split."""
    df.write.mode("overwrite").partitionBy(SPLIT_COL).parquet(path)


def load_processed(spark: SparkSession, path: str, split: str | None = "test") -> DataFrame:
    """SRC2 / SRC3: read processed rows; the split filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col(SPLIT_COL) == split) if split else df


def test_ids(df_split: DataFrame) -> DataFrame:
    """SNK2: keys of the test rows."""
    return df_split.where(F.col(SPLIT_COL) == "test").select(ID_COL)


def save_stats(stats: DataFrame, path: str) -> None:
    """SNK3: scaler / median state as a small long table."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).parquet(path)


def stats_dict(stats: DataFrame) -> tuple[dict, dict]:
    """Scaler table (one row per column) to (scaler, medians) values."""
    scaler, medians = {}, {}
    for r in stats.collect():
        scaler[r["column"]] = (r["mean"], r["std"])
        if r["median"] is not None:
            medians[r["column"]] = r["median"]
    return scaler, medians


def save_model(model, path: str) -> None:
    """SNK4: Spark ML persistence (overwrites)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    """SNK4: a missing model is an error; any other failure to load it is raised as it is."""
    from pyspark.ml import PipelineModel
    spark = SparkSession.getActiveSession()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"model not found: {path}")
    return PipelineModel.load(path)


def export_high_risk(df: DataFrame, path: str, threshold: float = HIGH_RISK, p: str = SCORE_COL) -> None:
    """SNK5: all high-risk rows and columns as CSV with a header."""
    write_csv(df.where(F.col(p) >= F.lit(threshold)), path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; blanks are kept as written (no whitespace trimming)."""
    (df.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_messages(df: DataFrame, path: str, partition_by: str | None = "risk_band") -> None:
    """SNK6: message table as Parquet, optionally one directory per risk band."""
    w = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)

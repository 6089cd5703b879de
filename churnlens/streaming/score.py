"""STM1: score arriving customer rows with fitted state (stateless stream).

The single-customer "live prediction" path of the reference, re-aimed to a
Structured Streaming job: file source with an explicit schema -> the same
encoding / scaling as batch (ENC8, SCL2) -> model -> class and risk band ->
two Parquet sinks with one checkpoint. No watermark or state is needed.

A row with a declared value that does not fit its type goes to the reject sink with
the names of its bad columns; it neither stops the stream nor is lost. Each
micro-batch writes a folder of its own, ``batch_id=<n>``, in both sinks, replacing
what an earlier attempt at that batch may have left, so a restart repeats a batch
without doubling rows: rows in = rows scored + rows rejected.

The columns are those of the files that are there at the start, in their order,
found by name; an empty or missing folder starts with the declared columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.scalars import risk_band
from churnlens.operators.model import score
from churnlens.operators.prepare import Fitted, encode_with
from churnlens.schema import CUSTOMER_SCHEMA, ID_COL, SCORE_COL


def scoring_frame(df: DataFrame, fitted: Fitted, model) -> DataFrame:
    """The per-row transformation shared by batch and stream."""
    enc = encode_with(df, fitted)
    out = score(model, enc)
    return out.select(ID_COL, SCORE_COL, "prediction", risk_band(SCORE_COL).alias("risk_band"))


def split_bad(df: DataFrame, schema: T.StructType = CUSTOMER_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Rows whose declared columns all fit their types, cast to them, and the others: customerID, bad_columns, row (JSON).

    A null key is bad too. A blank is text, not a number: it is bad in a numeric column, as any other text is."""
    declared = {f.name: f.dataType for f in schema if f.name in df.columns}
    name = lambda c: F.col(f"`{c}`")
    bad = [F.when(name(c).isNotNull() & name(c).try_cast(t).isNull(), F.lit(c)) for c, t in declared.items()]
    if ID_COL in declared:
        bad.append(F.when(name(ID_COL).isNull(), F.lit(ID_COL)))
    marked = df.withColumn("_bad", F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>"))
    good = marked.where(F.size("_bad") == 0).select(*[name(c).try_cast(declared[c]).alias(c) if c in declared else name(c) for c in df.columns])
    key = name(ID_COL).cast("string") if ID_COL in df.columns else F.lit(None).cast("string")
    return good, marked.where(F.size("_bad") > 0).select(key.alias(ID_COL), F.col("_bad").alias("bad_columns"),
                                                         F.to_json(F.struct(*[name(c) for c in df.columns])).alias("row"))


def _source_schema(spark: SparkSession, in_dir: str, fmt: str, schema: T.StructType) -> T.StructType:
    """The schema of the files that are there; the declared one (text in CSV) where there are none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(in_dir)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(folder)
    if any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(folder)):
        return (spark.read.option("header", True).csv(in_dir) if fmt == "csv" else spark.read.parquet(in_dir)).schema
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema]) if fmt == "csv" else schema


def start(spark: SparkSession, in_dir: str, transform, out_dir: str, checkpoint: str,
          fmt: str = "parquet", available_now: bool = True, reject_dir: str | None = None,
          schema: T.StructType = CUSTOMER_SCHEMA):
    """A stream of customer files through ``transform`` (DataFrame to DataFrame, map-only) into Parquet;
    with ``available_now`` it processes what is there and stops. Bad rows go to ``reject_dir``
    (``<out_dir>_rejected`` unless given)."""
    reject_dir = reject_dir or out_dir.rstrip("/") + "_rejected"
    reader = spark.readStream.schema(_source_schema(spark, in_dir, fmt, schema)).option("maxFilesPerTrigger", 64)
    src = reader.parquet(in_dir) if fmt == "parquet" else reader.option("header", True).csv(in_dir)

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split_bad(batch, schema)
        transform(good).write.mode("overwrite").parquet(f"{out_dir}/batch_id={number}")
        bad.write.mode("overwrite").parquet(f"{reject_dir}/batch_id={number}")

    q = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def read_sink(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All batches of a sink, without ``batch_id``; an empty table of ``schema`` if no batch has been written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop("batch_id")


SCORED = f"{ID_COL} string, {SCORE_COL} double, prediction int, risk_band string"
REJECTED = f"{ID_COL} string, bad_columns array<string>, row string"


def score_stream(spark: SparkSession, in_dir: str, fitted: Fitted, model, out_dir: str, checkpoint: str,
                 fmt: str = "parquet", available_now: bool = True):
    """STM1: start the stream of model scores."""
    return start(spark, in_dir, lambda df: scoring_frame(df, fitted, model), out_dir, checkpoint, fmt, available_now)


def run_to_completion(spark: SparkSession, in_dir: str, fitted: Fitted, model, out_dir: str,
                      checkpoint: str) -> DataFrame:
    score_stream(spark, in_dir, fitted, model, out_dir, checkpoint).awaitTermination()
    return read_sink(spark, out_dir, SCORED)

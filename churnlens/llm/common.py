"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of rows that cross to a Python worker at a time.
BATCH_BYTES = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes too, unless the session says how: texts can be long, and
    10,000 of them at a time would fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def trimmed(run):
    """``run``, for ``mapInArrow``, after which the worker gives back the memory it has freed: workers outlive
    their tasks, and what the allocators keep would lie beside the next stages' until they end."""
    def inner(stream):
        try:
            yield from run(stream)
        finally:
            give_back()

    return inner


def give_back() -> None:
    """Return freed memory of this process to the system, where its C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, renamed and cast: ``new="old type"``.

    Operators begin with this, so any further input column, whatever its name,
    is pruned before it can clash with a working column.
    """
    bounded_batches(df.sparkSession)
    out = []
    for new, spec in columns.items():
        old, kind = spec.split(" ", 1)
        out.append(F.col(f"`{old}`").cast(kind).alias(new))
    return df.select(*out)


#: Tables written inside ``settled`` calls that are going on, the innermost last.
_OPEN: list[list] = []


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs a re-read of this table, not the
    work before it, and the table is computed once however often it is used.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def settled(build, name: str, codec: str | None = None) -> DataFrame:
    """``written(build(), name)``; the tables that ``build`` had to write are deleted once this one stands."""
    inner: list = []
    _OPEN.append(inner)
    try:
        out = written(build(), name, codec)
        inner.pop()  # this one stays
    finally:
        _OPEN.pop()
        discard(*inner)
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more: what is derived from them is
    written itself. Only the table's own folder goes."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

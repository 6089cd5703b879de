"""Class balancing: class weights (BAL2) and SMOTE (BAL1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.schema import LABEL_COL


def class_weights(df: DataFrame, label: str = LABEL_COL) -> DataFrame:
    """BAL2: weight n / (2 * n_c) per class (classes count from one grouped aggregate)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    n_classes = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (total / (n_classes * F.col("n"))).alias("weight"))


COPY_CHUNK = 100_000


def smote(df: DataFrame, features: list[str], label: str = LABEL_COL, k: int = 5, seed: int = 42,
          id_col: str = "customerID", knn: str = "exact", snap_flags: list[str] | None = None) -> DataFrame:
    """BAL1: SMOTE on the minority class until it equals the majority; SET1 union.

    Every random choice is a keyed hash of (id, copy number, seed), so the result
    does not depend on partitioning. Copies: total = n_majority - n_minority;
    each minority row gets total // n copies and the first total % n rows in
    keyed-hash order one more (cut found by ``hash_cut``, no global sort).
    New row = base + u * (neighbour - base) with a neighbour drawn from the
    k nearest minority rows: ``knn='exact'``, or ``knn='sorted'`` for near ones in
    linear time. Both give every row min(k, rows - 1) neighbours, so the classes
    are equal afterwards in either mode.
    Output: the input rows plus synthetic rows (``is_synthetic`` = 1, id
    ``syn-<base>-<i>``), features as doubles. Columns in ``snap_flags`` (0/1
    flags) are rounded back to 0 or 1 in the synthetic rows.
    """
    from churnlens.functions.scalars import keyed_hash, keyed_uniform
    from churnlens.operators.neighbors import feature_vector, knn_all, knn_all_sorted
    from churnlens.operators.select import hash_cut

    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    base_out = df.select(id_col, label, F.lit(0).alias("is_synthetic"),
                         *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    if len(counts) < 2:
        return base_out
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c if isinstance(c, int) else 0))
    n_min, n_maj = counts[minority], counts[majority]
    total = n_maj - n_min
    if total <= 0:
        return base_out
    if n_min < 2:
        raise ValueError("SMOTE needs at least 2 minority rows")
    k_eff = min(k, n_min - 1)
    mino = feature_vector(df.where(F.col(label) == minority), features, "vec").select(id_col, "vec")
    mino = mino.withColumn("_h", keyed_hash(id_col, seed)).withColumn("_g", F.lit(0))
    q, rmd = divmod(total, n_min)
    extra = F.lit(0)
    if rmd:
        hv, idv = hash_cut(mino, "_h", id_col, "_g", {0: rmd})[0]
        extra = ((F.col("_h") < F.lit(hv)) | ((F.col("_h") == F.lit(hv)) & (F.col(id_col) <= F.lit(idv)))).cast("int")
    with_copies = mino.withColumn("copies", F.lit(q) + extra).where(F.col("copies") > 0)
    if q + 1 > COPY_CHUNK:  # spread a row's copies over tasks in chunks
        n_chunks = (q + COPY_CHUNK) // COPY_CHUNK
        with_copies = with_copies.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))) \
            .repartition(id_col, "_c")
        lo = F.col("_c") * COPY_CHUNK + 1
        hi = F.least(F.col("copies"), (F.col("_c") + 1) * COPY_CHUNK)
        copies = with_copies.where(lo <= hi).select(id_col, "vec", F.explode(F.sequence(lo, hi)).alias("i"))
    else:
        copies = with_copies.select(id_col, "vec", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("i"))
    key = F.concat(F.col(id_col), F.lit(":"), F.col("i").cast("string"))
    copies = copies.withColumn("j", (F.lit(1) + keyed_hash(F.concat(key, F.lit(":nb")), seed) % F.lit(k_eff))
                               .cast("int")) \
        .withColumn("u", keyed_uniform(F.concat(key, F.lit(":u")), seed))
    knn_fn = {"exact": knn_all, "sorted": knn_all_sorted}[knn]
    nn = knn_fn(mino, k=k_eff, id_col=id_col) \
        .select(F.col(id_col), F.col("rank").alias("j"), "neighbor_id")
    nvec = mino.select(F.col(id_col).alias("neighbor_id"), F.col("vec").alias("nvec"))
    syn = copies.join(nn, [id_col, "j"]).join(nvec, "neighbor_id")
    new = F.zip_with("vec", "nvec", lambda a, b: a + F.col("u") * (b - a))
    syn = syn.select(F.concat(F.lit("syn-"), F.col(id_col), F.lit("-"), F.col("i").cast("string")).alias(id_col),
                     F.lit(minority).cast(dict(df.dtypes)[label]).alias(label), F.lit(1).alias("is_synthetic"),
                     new.alias("_v"))
    snap = set(snap_flags or [])
    syn = syn.select(id_col, label, "is_synthetic", *[
        (F.round(F.col("_v")[i]) if f in snap else F.col("_v")[i]).alias(f) for i, f in enumerate(features)])
    return base_out.unionByName(syn)

"""Scale and skew check: replicated keys with one hot customer.

Builds ``customer`` and ``orders`` replicated R times with fresh keys, then
gives one customer extra orders so that it holds a third of all order rows.
Runs the flagship query and the stratified split on Spark, compares the
flagship with DuckDB on the same files, and prints timings as one JSON line.

Usage: python tools/scale_check.py [sf_dir] [R] [out_dir]
(out_dir must be a new scratch folder, e.g. from ``mktemp -d``).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    reps = int(sys.argv[2]) if len(sys.argv) > 2 else 100
    out = sys.argv[3]
    from pyspark.sql import functions as F

    from churnlens.plans import catalog, oracle
    from churnlens.plans import tables
    from churnlens.session import get_session
    spark = get_session(app="churnlens-scale")

    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    max_c = cust.agg(F.max("c_custkey")).first()[0] + 1
    max_o = orders.agg(F.max("o_orderkey")).first()[0] + 1
    rep = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    cust_r = cust.select("*", rep).select(
        (F.col("c_custkey") + F.col("rep") * max_c).alias("c_custkey"),
        F.format_string("Customer#%012d", F.col("c_custkey") + F.col("rep") * max_c).alias("c_name"),
        "c_nationkey", "c_acctbal", "c_mktsegment")
    orders_r = orders.select("*", rep).select(
        (F.col("o_orderkey") + F.col("rep") * max_o).alias("o_orderkey"),
        (F.col("o_custkey") + F.col("rep") * max_c).alias("o_custkey"),
        "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    n_orders = orders.count() * reps
    hot = orders_r.where(F.col("o_orderkey") % 2 == 0).select(
        (F.col("o_orderkey") + F.lit(max_o * reps)).alias("o_orderkey"), F.lit(7).cast("bigint").alias("o_custkey"),
        "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")   # about half again: 1/3 of all rows
    t0 = time.perf_counter()
    cust_r.write.mode("overwrite").parquet(f"{out}/customer.parquet")
    orders_r.unionByName(hot).write.mode("overwrite").parquet(f"{out}/orders.parquet")
    t_build = time.perf_counter() - t0
    n_all = spark.read.parquet(f"{out}/orders.parquet").count()
    n_hot = spark.read.parquet(f"{out}/orders.parquet").where("o_custkey = 7").count()

    timings = {}
    t0 = time.perf_counter()
    flag = catalog.QUERIES["risk_kpis_by_contract"](spark, out).toPandas()
    timings["flagship_incl_base_tables"] = round(time.perf_counter() - t0, 2)
    t0 = time.perf_counter()
    tables.split(spark, out).write.format("noop").mode("overwrite").save()
    timings["stratified_split"] = round(time.perf_counter() - t0, 2)
    t0 = time.perf_counter()
    catalog.QUERIES["roc_auc"](spark, out).toPandas()
    timings["roc_auc"] = round(time.perf_counter() - t0, 2)

    import duckdb
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{out}/{t}.parquet/*.parquet')")
    want = con.execute(oracle.SQL["risk_kpis_by_contract"]).df()
    from tools.oracle_check import digest
    same = digest(flag)[2] == digest(want)[2]
    print(json.dumps({"reps": reps, "orders_rows": n_all, "hot_customer_rows": n_hot,
                      "hot_share": round(n_hot / n_all, 3), "build_sec": round(t_build, 2),
                      "timings": timings, "flagship_matches_duckdb": bool(same), "base_orders": n_orders}))
    spark.stop()


if __name__ == "__main__":
    main()

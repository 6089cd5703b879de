"""Deterministic customer view derived from the driver's ``customer`` and ``orders``.

The reference reads a telco churn file that is not shipped with it; this view
has the same 21-column schema and is computed by one aggregate of ``orders``
(partial + final hash aggregate, shuffled on the customer key) joined to
``customer`` on the key. The snapshot date is a scalar subquery (one value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.schema import RAW_COLUMNS

# --- Fixed values of the fixture rules (see FIXTURES.md §2-3) ---
SERVICE_RULES = [("OnlineSecurity", 3, 2), ("OnlineBackup", 5, 2), ("DeviceProtection", 7, 3),
                 ("TechSupport", 11, 2), ("StreamingTV", 13, 2), ("StreamingMovies", 17, 3)]
DAYS_PER_MONTH = 30.4375
CHURN_GAP_DAYS = 330
RULE_INTERCEPT = 6.0
RULE_TENURE_W = -0.11
RULE_CHARGE_W = 0.02
RULE_CHARGE_CENTER = 70.0
RULE_CONTRACT_W = {"Month-to-month": 0.9, "One year": 0.2, "Two year": -0.6}
# --- end of fixed values ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _yes_no(cond: Column) -> Column:
    return F.when(cond, F.lit("Yes")).otherwise(F.lit("No"))


def customer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw 21-column customer table (string-typed ``TotalCharges``)."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("o_date"))
    per_customer = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.min("o_date").alias("first_date"),
        F.max("o_date").alias("last_date"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total_price"),
    )
    snapshot = orders.select(F.max("o_date")).scalar()

    base = cust.join(per_customer, cust.c_custkey == per_customer.o_custkey, "left")
    k = F.col("c_custkey")
    nk = F.col("c_nationkey")
    n = F.coalesce(F.col("n_orders"), F.lit(0))
    no_internet = (k % 3) == 2

    # least() skips nulls in both engines, so "no orders" is handled explicitly.
    tenure = F.when(n == 0, F.lit(0)).otherwise(
        F.least(F.lit(72.0), F.floor(F.datediff("last_date", "first_date") / F.lit(DAYS_PER_MONTH)))
    ).cast("int")
    monthly = F.round(F.lit(20.0) + F.coalesce(F.col("total_price").cast("double") / n, F.lit(0.0))
                      / F.lit(5000.0), 2)

    services = {}
    for name, m, q in SERVICE_RULES:
        val = (F.when(no_internet, F.lit("No internet service"))
               .otherwise(_yes_no((F.floor(k / m).cast("bigint") % q) == 0)))
        if name == "OnlineBackup":
            val = F.when((k % 211) == 0, F.lit(None).cast("string")).otherwise(val)
        services[name] = val

    step = base.select(
        F.col("c_name").alias("customerID"),
        F.when((k % 2) == 0, F.lit("Male")).otherwise(F.lit("Female")).alias("gender"),
        F.when((k % 6) == 0, F.lit(1)).otherwise(F.lit(0)).cast("int").alias("extra_flag"),
        _yes_no((nk % 2) == 0).alias("Partner"),
        _yes_no((nk % 3) == 0).alias("Dependents"),
        tenure.alias("tenure"),
        _yes_no((k % 10) != 0).alias("PhoneService"),
        F.when((k % 10) == 0, F.lit("No phone service"))
         .otherwise(_yes_no((k % 7) < 3)).alias("MultipleLines"),
        F.when((k % 3) == 0, F.lit("svc_a")).when((k % 3) == 1, F.lit("svc_b"))
         .otherwise(F.lit("No")).alias("InternetService"),
        *[v.alias(name) for name, v in services.items()],
        F.when(n < 8, F.lit("Month-to-month")).when(n < 12, F.lit("One year"))
         .otherwise(F.lit("Two year")).alias("Contract"),
        _yes_no((k % 5) < 3).alias("PaperlessBilling"),
        F.element_at(F.array(*[F.lit(p) for p in ("pay_a", "pay_b", "pay_c", "pay_d")]),
                     (k % 4).cast("int") + 1).alias("PaymentMethod"),
        monthly.alias("MonthlyCharges"),
        k.alias("_k"),
        F.col("last_date"),
        n.alias("_n"),
    )
    return step.select(
        *[c for c in RAW_COLUMNS if c not in ("TotalCharges", "Churn")],
        F.when((F.col("_k") % 97) == 0, F.lit(" "))
         .otherwise(F.round(F.col("MonthlyCharges") * F.col("tenure"), 2)
                    .cast("decimal(12,2)").cast("string")).alias("TotalCharges"),
        _yes_no((F.col("_n") == 0) | (F.datediff(snapshot, F.col("last_date")) > CHURN_GAP_DAYS))
        .alias("Churn"),
    ).select(*RAW_COLUMNS)


def rule_score_col(tenure: Column | str = "tenure", monthly: Column | str = "MonthlyCharges",
                   contract: Column | str = "Contract") -> Column:
    """Deterministic stand-in score: round(sigmoid(z), 4)."""
    tenure = F.col(tenure) if isinstance(tenure, str) else tenure
    monthly = F.col(monthly) if isinstance(monthly, str) else monthly
    contract = F.col(contract) if isinstance(contract, str) else contract
    cterm = F.lit(0.0)
    for name, w in reversed(list(RULE_CONTRACT_W.items())):
        cterm = F.when(contract == name, F.lit(w)).otherwise(cterm)
    z = (F.lit(RULE_INTERCEPT) + F.lit(RULE_TENURE_W) * tenure.cast("double")
         + F.lit(RULE_CHARGE_W) * (monthly - F.lit(RULE_CHARGE_CENTER)) + cterm)
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)


def linear_weights(features: list[str]) -> dict[str, float]:
    """Weights over all encoded columns (closed-form attributions): those of z where it has one, else a
    small one from the column's place."""
    rule = {"tenure": RULE_TENURE_W, "MonthlyCharges": RULE_CHARGE_W} | {f"Contract_{k}": w for k, w in RULE_CONTRACT_W.items()}
    return {f: rule.get(f, ((7 * i) % 11 - 5) / 32 if f != "TotalCharges" else 1 / 4096) for i, f in enumerate(features)}

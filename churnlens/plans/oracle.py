"""DuckDB SQL for every exact query: an independent oracle on the same tables.

``BASE`` builds the derived customer view and the shared intermediate tables as
CTEs; each query appends its own CTEs and final SELECT. Column names match the
Spark results one for one.
"""

from __future__ import annotations

from churnlens.functions.scalars import SPACE
from churnlens.operators import messages as TEXT
from churnlens.operators.neighbors import BLOCK_ROWS, DIRECTIONS, direction
from churnlens.schema import CATEGORICAL_COLS, CUSTOMER_SCHEMA
from churnlens.sources.fixture import linear_weights


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{SPACE}+|{SPACE}+$', '', 'g')"


# Shared CTE chain. Names: customers (raw), cleaned (numeric TotalCharges,
# median-filled), scored (rule score as churn_proba), encoded (26 features),
# hsplit (stratified split by keyed hash).
BASE = r"""
snap AS (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders),
oagg AS (
  SELECT o_custkey, count(*) AS n, CAST(min(o_orderdate) AS DATE) AS f,
         CAST(max(o_orderdate) AS DATE) AS l,
         sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s
  FROM orders GROUP BY o_custkey),
cbase AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nk, c.c_name, coalesce(a.n, 0) AS n, a.f, a.l, a.s, snap.d
  FROM customer c LEFT JOIN oagg a ON a.o_custkey = c.c_custkey CROSS JOIN snap),
cmc AS (
  SELECT *,
    CAST(CASE WHEN n = 0 THEN 0 ELSE least(72, floor(date_diff('day', f, l) / 30.4375::DOUBLE)) END AS INTEGER) AS tenure,
    round(20 + coalesce(CAST(s AS DOUBLE) / n, 0) / 5000.0::DOUBLE, 2) AS MonthlyCharges
  FROM cbase),
customers AS (
  SELECT c_name AS customerID,
    CASE WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS INTEGER) AS extra_flag,
    CASE WHEN nk % 2 = 0 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN nk % 3 = 0 THEN 'Yes' ELSE 'No' END AS Dependents,
    tenure,
    CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS PhoneService,
    CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 7 < 3 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    CASE k % 3 WHEN 0 THEN 'svc_a' WHEN 1 THEN 'svc_b' ELSE 'No' END AS InternetService,
    CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 3) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN k % 211 = 0 THEN NULL WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 5) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 7) AS BIGINT) % 3 = 0 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 11) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 13) AS BIGINT) % 2 = 0 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN k % 3 = 2 THEN 'No internet service' WHEN CAST(floor(k / 17) AS BIGINT) % 3 = 0 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE WHEN n < 8 THEN 'Month-to-month' WHEN n < 12 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE k % 4 WHEN 0 THEN 'pay_a' WHEN 1 THEN 'pay_b' WHEN 2 THEN 'pay_c' ELSE 'pay_d' END AS PaymentMethod,
    MonthlyCharges,
    CASE WHEN k % 97 = 0 THEN ' ' ELSE CAST(CAST(round(MonthlyCharges * tenure, 2) AS DECIMAL(12,2)) AS VARCHAR) END AS TotalCharges,
    CASE WHEN n = 0 OR date_diff('day', l, d) > 330 THEN 'Yes' ELSE 'No' END AS Churn
  FROM cmc),
tc AS (SELECT *, TRY_CAST(trim(TotalCharges) AS DOUBLE) AS tc_num FROM customers),
cleaned AS (
  SELECT * EXCLUDE (tc_num) REPLACE (coalesce(tc_num, (SELECT median(tc_num) FROM tc)) AS TotalCharges)
  FROM tc),
scored AS (
  SELECT customerID,
    CAST(coalesce(Churn = 'Yes', false) AS INTEGER) AS label,
    round(1 / (1 + exp(-(6.0::DOUBLE + (-0.11::DOUBLE) * CAST(tenure AS DOUBLE)
        + 0.02::DOUBLE * (MonthlyCharges - 70.0::DOUBLE)
        + CASE Contract WHEN 'Month-to-month' THEN 0.9::DOUBLE WHEN 'One year' THEN 0.2::DOUBLE
                        WHEN 'Two year' THEN -0.6::DOUBLE ELSE 0.0::DOUBLE END))), 4) AS churn_proba,
    tenure, MonthlyCharges, TotalCharges, Contract
  FROM cleaned),
encoded AS (
  SELECT customerID,
    CAST(coalesce(Churn = 'Yes', false) AS INTEGER) AS label,
    CAST(coalesce(gender = 'Male', false) AS INTEGER) AS gender,
    coalesce(extra_flag, 0) AS extra_flag,
    CAST(coalesce(Partner = 'Yes', false) AS INTEGER) AS Partner,
    CAST(coalesce(Dependents = 'Yes', false) AS INTEGER) AS Dependents,
    coalesce(tenure, 0) AS tenure,
    CAST(coalesce(PhoneService = 'Yes', false) AS INTEGER) AS PhoneService,
    CAST(coalesce(MultipleLines = 'Yes', false) AS INTEGER) AS MultipleLines,
    CAST(coalesce(CASE OnlineSecurity WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS OnlineSecurity,
    CAST(coalesce(CASE OnlineBackup WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS OnlineBackup,
    CAST(coalesce(CASE DeviceProtection WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS DeviceProtection,
    CAST(coalesce(CASE TechSupport WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS TechSupport,
    CAST(coalesce(CASE StreamingTV WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS StreamingTV,
    CAST(coalesce(CASE StreamingMovies WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 WHEN 'No phone service' THEN 0 END, 0) AS INTEGER) AS StreamingMovies,
    CAST(coalesce(PaperlessBilling = 'Yes', false) AS INTEGER) AS PaperlessBilling,
    coalesce(MonthlyCharges, 0) AS MonthlyCharges,
    coalesce(TotalCharges, 0) AS TotalCharges,
    CAST(coalesce(InternetService = 'No', false) AS INTEGER) AS "InternetService_No",
    CAST(coalesce(InternetService = 'svc_a', false) AS INTEGER) AS "InternetService_svc_a",
    CAST(coalesce(InternetService = 'svc_b', false) AS INTEGER) AS "InternetService_svc_b",
    CAST(coalesce(Contract = 'Month-to-month', false) AS INTEGER) AS "Contract_Month-to-month",
    CAST(coalesce(Contract = 'One year', false) AS INTEGER) AS "Contract_One year",
    CAST(coalesce(Contract = 'Two year', false) AS INTEGER) AS "Contract_Two year",
    CAST(coalesce(PaymentMethod = 'pay_a', false) AS INTEGER) AS "PaymentMethod_pay_a",
    CAST(coalesce(PaymentMethod = 'pay_b', false) AS INTEGER) AS "PaymentMethod_pay_b",
    CAST(coalesce(PaymentMethod = 'pay_c', false) AS INTEGER) AS "PaymentMethod_pay_c",
    CAST(coalesce(PaymentMethod = 'pay_d', false) AS INTEGER) AS "PaymentMethod_pay_d"
  FROM cleaned),
hashed AS (
  SELECT *, CAST('0x' || substr(md5(customerID || ':42'), 1, 8) AS BIGINT) AS h FROM encoded),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, customerID) AS rk,
         count(*) OVER (PARTITION BY label) AS n_label FROM hashed),
hsplit AS (
  SELECT * EXCLUDE (h, rk, n_label),
    CASE WHEN rk <= round(0.2::DOUBLE * n_label) THEN 'test' ELSE 'train' END AS split
  FROM ranked)
"""

FEATURES_SQL = ('gender, extra_flag, Partner, Dependents, tenure, PhoneService, MultipleLines, '
                'OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies, '
                'PaperlessBilling, MonthlyCharges, TotalCharges, "InternetService_No", "InternetService_svc_a", '
                '"InternetService_svc_b", "Contract_Month-to-month", "Contract_One year", "Contract_Two year", '
                '"PaymentMethod_pay_a", "PaymentMethod_pay_b", "PaymentMethod_pay_c", "PaymentMethod_pay_d"')


def q(body: str, extra_ctes: str = "") -> str:
    """Full statement: shared CTEs, optional extra CTEs, then the final SELECT."""
    ctes = BASE.strip()
    if extra_ctes.strip():
        ctes = ctes + ",\n" + extra_ctes.strip()
    return "WITH " + ctes + "\n" + body.strip()


SQL: dict[str, str] = {}


def register(name: str, body: str, extra_ctes: str = "") -> None:
    SQL[name] = q(body, extra_ctes)


# ---------------------------------------------------------------- helpers for SQL text

RAW_COLS = ["customerID", "gender", "extra_flag", "Partner", "Dependents", "tenure", "PhoneService",
            "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
            "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
            "MonthlyCharges", "TotalCharges", "Churn"]
FEATURES = [f.strip().strip('"') for f in FEATURES_SQL.split(",")]
SERVICE = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]
H = "CAST('0x' || substr(md5(customerID || ':42'), 1, 8) AS BIGINT)"


def fixed(x: str, d: int) -> str:
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(38,10)), {d}) AS DECIMAL(38,{d})) AS VARCHAR)"


def pct(x: str) -> str:
    return f"'%' || {fixed(f'({x}) * 100.0::DOUBLE', 1)}"


BAND = ("CASE WHEN churn_proba >= 0.7::DOUBLE THEN 'High risk' WHEN churn_proba >= 0.4::DOUBLE "
        "THEN 'Medium risk' WHEN churn_proba IS NOT NULL THEN 'Low risk' END")
BIN = ("CASE WHEN churn_proba > 0 AND churn_proba <= 0.4::DOUBLE THEN 'Low' "
       "WHEN churn_proba > 0.4::DOUBLE AND churn_proba <= 0.7::DOUBLE THEN 'Medium' "
       "WHEN churn_proba > 0.7::DOUBLE AND churn_proba <= 1.0::DOUBLE THEN 'High' END")
KPI = """count(*) AS n,
  count(*) FILTER (WHERE churn_proba >= 0.7::DOUBLE) AS n_high,
  count(*) FILTER (WHERE churn_proba >= 0.4::DOUBLE AND churn_proba < 0.7::DOUBLE) AS n_medium,
  count(*) FILTER (WHERE churn_proba < 0.4::DOUBLE) AS n_low,
  round(avg(churn_proba), 6) AS mean_score,
  round(count(*) FILTER (WHERE churn_proba >= 0.7::DOUBLE) / count(*), 6) AS share_high,
  round(count(*) FILTER (WHERE churn_proba >= 0.4::DOUBLE AND churn_proba < 0.7::DOUBLE) / count(*), 6) AS share_medium,
  round(count(*) FILTER (WHERE churn_proba < 0.4::DOUBLE) / count(*), 6) AS share_low"""


def _nulls(cols, src, stage):
    body = " + ".join(f'(count(*) - count("{c}"))' for c in cols)
    return f"SELECT '{stage}' AS stage, CAST({body} AS BIGINT) AS n_null FROM {src}"


register("risk_kpis_by_contract", f"SELECT Contract, {KPI} FROM scored GROUP BY Contract")
register("customers", "SELECT * FROM customers")
register("table_shape", "SELECT count(*) AS n_rows, 21 AS n_cols FROM customers")
register("missing_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count(\"{c}\") AS BIGINT) AS n_missing FROM customers"
    for c in RAW_COLS))
register("churn_rate", "SELECT round(avg(CASE WHEN Churn = 'Yes' OR Churn = '1' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)"
                       " AS churn_rate FROM customers WHERE Churn IS NOT NULL")
register("value_shares", "SELECT Contract AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share "
                         "FROM customers WHERE Contract IS NOT NULL GROUP BY Contract")
register("null_total", " UNION ALL ".join([
    _nulls(RAW_COLS, "customers", "raw"),
    _nulls(RAW_COLS, "(SELECT * REPLACE (TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges) FROM customers)",
           "to_number"),
    _nulls(RAW_COLS, "cleaned", "cleaned"),
    _nulls(["customerID", "label"] + FEATURES, "encoded", "encoded")]))
register("class_counts", "SELECT label, count(*) AS n FROM encoded GROUP BY label")
register("to_number", "SELECT customerID, TotalCharges AS TotalCharges_text, "
                      "TRY_CAST(trim(TotalCharges) AS DOUBLE) AS TotalCharges FROM customers")
register("fill_median", "SELECT customerID, TotalCharges FROM cleaned")
register("feature_columns", "SELECT * FROM (VALUES " + ", ".join(
    f"({i + 1}, '{f}')" for i, f in enumerate(FEATURES)) + ") t(position, feature)")
register("encode_service", "SELECT customerID, " + ", ".join(
    f"CAST(CASE {c} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 WHEN 'No internet service' THEN 0 "
    f"WHEN 'No phone service' THEN 0 END AS INTEGER) AS {c}" for c in SERVICE) + " FROM cleaned")
register("fill_zero", "SELECT customerID, " + ", ".join(SERVICE) + " FROM encoded")
register("encode_target", "SELECT customerID, label FROM encoded")
register("encode_binary", "SELECT customerID, Partner, Dependents, PhoneService, PaperlessBilling, MultipleLines FROM encoded")
register("encode_gender", "SELECT customerID, gender FROM encoded")
register("one_hot", "SELECT customerID, " + ", ".join(f'"{f}"' for f in FEATURES[16:]) + " FROM encoded")
_CATS = [*CATEGORICAL_COLS, "customerID"]
_RANK = [f"dense_rank() OVER (ORDER BY {c}) - 1" for c in _CATS]
_SIZE = [f"(SELECT count(DISTINCT {c}) FROM cleaned)" for c in _CATS]
register("one_hot_sparse", "SELECT customerID, " + " + ".join(_SIZE) + " AS size, concat_ws(',', " + ", ".join(
    " + ".join([r, *_SIZE[:i]]) for i, r in enumerate(_RANK)) + f") AS indices, {len(_CATS)}.0::DOUBLE AS total FROM cleaned")
register("encode_features", "SELECT * FROM encoded")
register("fit_scaler", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, "
    + ("round((SELECT median(tc_num) FROM tc), 6)" if c == "TotalCharges" else "NULL::DOUBLE")
    + f" AS median FROM hsplit WHERE split = 'train'" for c in ["tenure", "MonthlyCharges", "TotalCharges"]))
SCALER_CTE = """st AS (SELECT avg(tenure) AS m_t, stddev_pop(tenure) AS s_t, avg(MonthlyCharges) AS m_m,
  stddev_pop(MonthlyCharges) AS s_m, avg(TotalCharges) AS m_c, stddev_pop(TotalCharges) AS s_c
  FROM hsplit WHERE split = 'train')"""
register("apply_scaler", "SELECT customerID, split, round((tenure - m_t) / s_t, 6) AS tenure, "
                         "round((MonthlyCharges - m_m) / s_m, 6) AS MonthlyCharges, "
                         "round((TotalCharges - m_c) / s_c, 6) AS TotalCharges FROM hsplit, st", SCALER_CTE)
register("encode_with", "SELECT customerID, " + ", ".join(
    {"tenure": "round((tenure - m_t) / s_t, 6) AS tenure",
     "MonthlyCharges": "round((MonthlyCharges - m_m) / s_m, 6) AS MonthlyCharges",
     "TotalCharges": "round((TotalCharges - m_c) / s_c, 6) AS TotalCharges"}.get(f, f'"{f}"') for f in FEATURES)
    + " FROM encoded, st", SCALER_CTE)
register("stratified_split", "SELECT customerID, label, split FROM hsplit")
register("split_check", """SELECT count(*) FILTER (WHERE split = 'train') AS n_train,
  count(*) FILTER (WHERE split = 'test') AS n_test, count(*) AS n_all,
  (SELECT count(*) FROM hsplit a WHERE split = 'train'
     AND customerID IN (SELECT customerID FROM hsplit WHERE split = 'test')) AS n_overlap,
  (SELECT count(*) FROM hsplit a WHERE customerID NOT IN (SELECT customerID FROM hsplit WHERE split = 'train')
     AND customerID NOT IN (SELECT customerID FROM hsplit WHERE split = 'test')) AS n_unassigned
  FROM hsplit""")
register("random_split", f"SELECT customerID, CASE WHEN {H} / 4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'valid' "
                         "ELSE 'fit' END AS part FROM hsplit WHERE split = 'train'")
register("head_sample", f"SELECT customerID, label FROM hsplit WHERE split = 'test' ORDER BY {H}, customerID LIMIT 200")
register("predict", "SELECT customerID, churn_proba, CAST(churn_proba >= 0.5::DOUBLE AS INTEGER) AS prediction FROM scored")
register("risk_band", f"SELECT customerID, churn_proba, {BAND} AS risk_band FROM scored")
register("risk_bin", f"SELECT customerID, churn_proba, {BIN} AS risk_bin FROM scored")
register("label_text", "SELECT customerID, label, CASE label WHEN 0 THEN 'Active customer' "
                       "WHEN 1 THEN 'Left (churned)' END AS label_text FROM scored")
register("percent_text", f"SELECT customerID, churn_proba, {pct('churn_proba')} AS proba_text FROM scored")
register("high_risk", "SELECT customerID, churn_proba FROM scored WHERE churn_proba >= 0.7::DOUBLE")
register("risk_pool", "SELECT 'high' AS pool, customerID FROM scored WHERE churn_proba >= 0.7::DOUBLE UNION ALL "
                      "SELECT 'medium', customerID FROM scored WHERE churn_proba >= 0.4::DOUBLE AND churn_proba < 0.7::DOUBLE "
                      "UNION ALL SELECT 'low', customerID FROM scored WHERE churn_proba < 0.4::DOUBLE")
register("sample_per_band", f"""SELECT risk_band, pick, customerID FROM (
  SELECT {BAND} AS risk_band, customerID,
    row_number() OVER (PARTITION BY {BAND} ORDER BY {H}, customerID) AS pick FROM scored) WHERE pick <= 3""")
register("filter_contract", "SELECT customerID, Contract FROM customers WHERE Contract IN ('Month-to-month', 'One year')")
register("filter_ranges", "SELECT customerID, tenure, MonthlyCharges FROM customers "
                          "WHERE tenure BETWEEN 24 AND 60 AND MonthlyCharges BETWEEN 60.0::DOUBLE AND 80.0::DOUBLE")
register("apply_filters", "SELECT customerID, churn_proba FROM scored WHERE Contract IN ('Month-to-month', 'Two year') "
                          "AND tenure BETWEEN 12 AND 66 AND MonthlyCharges BETWEEN 55.0::DOUBLE AND 85.0::DOUBLE")
register("filter_coverage", "SELECT count(*) FILTER (WHERE Contract IN ('One year') AND tenure BETWEEN 0 AND 72 "
                            "AND MonthlyCharges BETWEEN 0 AND 120) AS n_shown, count(*) AS n_total FROM scored")
register("high_risk_view", f"""SELECT customerID, tenure, MonthlyCharges, TotalCharges, churn_proba, {BAND} AS risk_band,
  label AS true_label, {pct('churn_proba')} AS proba_text FROM scored WHERE churn_proba >= 0.7::DOUBLE""")
register("risk_kpis", f"SELECT {KPI} FROM scored")
register("risk_distribution", f"SELECT {BIN} AS risk_bin, count(*) AS n FROM scored GROUP BY 1")
register("score_histogram", """SELECT g.bin, round(g.bin / 40.0::DOUBLE, 6) AS lower, round((g.bin + 1) / 40.0::DOUBLE, 6) AS upper,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
  FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(40)) g
  LEFT JOIN (SELECT CAST(least(floor(churn_proba * 40.0::DOUBLE), 39) AS INTEGER) AS bin, count(*) AS n
             FROM scored WHERE churn_proba IS NOT NULL GROUP BY 1) c ON c.bin = g.bin""")
register("attach_raw", "SELECT s.customerID, s.label, s.churn_proba, c.* EXCLUDE (customerID) "
                       "FROM scored s JOIN customers c ON c.customerID = s.customerID")


# ---------------------------------------------------------------- batch 2: evaluation

PRED = "scored_p AS (SELECT *, CAST(churn_proba >= 0.5::DOUBLE AS INTEGER) AS prediction FROM scored)"
register("confusion", """SELECT y.label, p.prediction, count(s.customerID) AS n
  FROM (VALUES (0), (1)) y(label) CROSS JOIN (VALUES (0), (1)) p(prediction)
  LEFT JOIN scored_p s ON s.label = y.label AND s.prediction = p.prediction
  GROUP BY y.label, p.prediction""", PRED)
CM = PRED + """,
cm AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS DOUBLE) AS tn FROM scored_p),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1,
  coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
  tp + fn AS s1, tn + fp AS s0 FROM cm),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0,
  s0 + s1 AS n, coalesce((tp + tn) / nullif(s0 + s1, 0), 0) AS acc FROM pr)"""
register("class_report", """
  SELECT '0' AS class, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, CAST(s0 AS BIGINT) AS support FROM f
  UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS BIGINT) FROM f
  UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                   round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS BIGINT) FROM f
  UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(n AS BIGINT) FROM f""", CM)
SC = """sc AS (SELECT churn_proba AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
  FROM scored WHERE churn_proba IS NOT NULL AND label IS NOT NULL GROUP BY churn_proba),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
  sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""
register("roc_auc", "SELECT round(sum(pos * (cum_neg - neg + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * "
                    "CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc FROM cum", SC)
register("roc_points", """SELECT NULL::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
  UNION ALL SELECT score, round(CAST(N - cum_neg + neg AS DOUBLE) / N, 6), round(CAST(P - cum_pos + pos AS DOUBLE) / P, 6) FROM cum""", SC)
register("pr_points", """SELECT score AS threshold,
  round(coalesce(CAST(P - cum_pos + pos AS DOUBLE) / nullif(CAST(P - cum_pos + pos + N - cum_neg + neg AS DOUBLE), 0), 0), 6) AS precision,
  round(CAST(P - cum_pos + pos AS DOUBLE) / P, 6) AS recall FROM cum
  UNION ALL SELECT NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE""", SC)
register("class_weights", """SELECT label, count(*) AS n,
  round((SELECT count(*) FROM hsplit WHERE split = 'train') / (2.0::DOUBLE * count(*)), 6) AS weight
  FROM hsplit WHERE split = 'train' GROUP BY label""")

# ---------------------------------------------------------------- batch 2: attributions

WEIGHTS = linear_weights(FEATURES)
ATTR = ("means AS (SELECT " + ", ".join(f'avg(CAST("{f}" AS DOUBLE)) AS "{f}"' for f in FEATURES) + " FROM encoded),\n"
        "base AS (SELECT " + " + ".join(f'{w!r}::DOUBLE * "{f}"' for f, w in WEIGHTS.items()) + " AS base_value FROM means),\n"
        "attr AS (" + " UNION ALL ".join(
            f"SELECT e.customerID, '{f}' AS feature, CAST(e.\"{f}\" AS DOUBLE) AS feature_value, "
            f"round({w!r}::DOUBLE * (CAST(e.\"{f}\" AS DOUBLE) - m.\"{f}\"), 6) AS shap_value FROM encoded e, means m"
            for f, w in WEIGHTS.items()) + """),
top AS (SELECT customerID, row_number() OVER (PARTITION BY customerID ORDER BY abs(shap_value) DESC, feature) AS rank,
  feature, shap_value, CASE WHEN shap_value > 0 THEN 'raises risk' ELSE 'lowers risk' END AS direction
  FROM attr QUALIFY rank <= 5)""")
register("linear_shap", "SELECT * FROM attr", ATTR)
register("top_factors", "SELECT * FROM top", ATTR)
register("global_importance", "SELECT feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap FROM attr "
                              "GROUP BY feature ORDER BY avg(abs(shap_value)) DESC, feature LIMIT 15", ATTR)
register("factor_bars", "SELECT customerID, rank, feature, CAST(floor(abs(shap_value) / (max(abs(shap_value)) "
                        "OVER (PARTITION BY customerID) + 1e-9::DOUBLE) * 100.0::DOUBLE) AS INTEGER) AS bar_pct FROM top",
         ATTR)


def signed(x: str, d: int = 3) -> str:
    return (f"CASE WHEN round(CAST({x} AS DECIMAL(38,10)), {d}) >= 0 THEN '+' || {fixed(x, d)} "
            f"ELSE {fixed(x, d)} END")


register("waterfall", f"""
SELECT customerID, step, item, round(value, 6) AS value, round(start, 6) AS start, round(start + value, 6) AS "end",
  {signed('value')} AS text, NULL::DOUBLE AS probability FROM run
UNION ALL
SELECT customerID, CAST(k + 2 AS INTEGER), 'Prediction', round(base_value + total, 6), 0.0::DOUBLE,
  round(base_value + total, 6), {pct('1.0::DOUBLE / (1.0::DOUBLE + exp(-(base_value + total)))')},
  round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(base_value + total))), 6) FROM pc, base""", ATTR + """,
wr AS (SELECT *, row_number() OVER (PARTITION BY customerID ORDER BY abs(shap_value) DESC, feature) AS r,
  sum(shap_value) OVER (PARTITION BY customerID) AS total FROM attr),
shown AS (SELECT * FROM wr WHERE r <= 10),
steps AS (SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY shap_value, feature) AS INTEGER) AS step,
  feature AS item, shap_value AS value FROM shown),
pc AS (SELECT customerID, sum(shap_value) AS shown_sum, any_value(total) AS total, count(*) AS k FROM shown GROUP BY customerID),
oth AS (SELECT customerID, CAST(k + 1 AS INTEGER) AS step, 'Other features' AS item, total - shown_sum AS value FROM pc),
rws AS (SELECT * FROM steps UNION ALL SELECT * FROM oth),
run AS (SELECT rws.*, base_value + coalesce(sum(value) OVER (PARTITION BY customerID ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rws, base)""")
JIT = "(-0.3::DOUBLE + 0.6::DOUBLE * (CAST('0x' || substr(md5(a.customerID || '|' || a.feature || ':42'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE))"
register("beeswarm", f"""SELECT a.customerID, a.feature, CAST(rk.rank AS INTEGER) AS rank, a.shap_value,
  round((a.feature_value - sc.lo) / (sc.hi - sc.lo + 1e-9::DOUBLE), 6) AS norm_value, round({JIT}, 6) AS jitter,
  round(11.0::DOUBLE - rk.rank + {JIT}, 6) AS y
  FROM attr a JOIN rk ON rk.feature = a.feature JOIN scl sc ON sc.feature = a.feature""", ATTR + """,
imp AS (SELECT feature, avg(abs(shap_value)) AS m FROM attr GROUP BY feature ORDER BY m DESC, feature LIMIT 12),
rk AS (SELECT feature, row_number() OVER (ORDER BY m DESC, feature) - 1 AS rank FROM imp),
scl AS (SELECT feature, min(feature_value) AS lo, max(feature_value) AS hi FROM attr GROUP BY feature)""")
register("factor_text", f"""SELECT s.customerID, 'Churn risk: ' || {pct('s.churn_proba')} || chr(10) ||
  'Main risk factors (attributions):' || chr(10) || coalesce(l.body, '') AS factor_text
  FROM scored s LEFT JOIN (SELECT customerID, string_agg('  ' || CAST(rank AS VARCHAR) || '. ' || feature || ': SHAP=' ||
    {fixed('shap_value', 3)} || ' (' || direction || ')', chr(10) ORDER BY rank) AS body FROM top GROUP BY customerID) l
  ON l.customerID = s.customerID""", ATTR)

# ---------------------------------------------------------------- batch 2: segments

SEG = """seg AS (SELECT *, CASE WHEN tenure < 55 THEN 0 WHEN tenure < 62 THEN 1 WHEN tenure < 68 THEN 2 ELSE 3 END AS segment
  FROM scored),
segr AS (SELECT segment, row_number() OVER (ORDER BY avg(churn_proba) DESC, segment) AS risk_rank FROM seg GROUP BY segment),
segn AS (SELECT seg.*, CASE r.risk_rank WHEN 1 THEN 'High risk' WHEN 2 THEN 'Medium-high risk' WHEN 3 THEN 'Medium-low risk'
  WHEN 4 THEN 'Low risk' ELSE 'segment_' || CAST(r.risk_rank AS VARCHAR) END AS segment_name
  FROM seg LEFT JOIN segr r ON r.segment = seg.segment)"""
register("name_segments", "SELECT customerID, segment, segment_name FROM segn", SEG)
register("segment_profiles", """SELECT segment, segment_name, round(avg(churn_proba), 6) AS mean_risk, count(*) AS n_customers,
  round(avg(tenure), 6) AS mean_tenure, round(avg(MonthlyCharges), 6) AS mean_MonthlyCharges,
  round(avg(TotalCharges), 6) AS mean_TotalCharges FROM segn GROUP BY segment, segment_name""", SEG)

# ---------------------------------------------------------------- batch 2: messages

TONE = ("CASE WHEN churn_proba >= 0.7::DOUBLE THEN 'warm' WHEN churn_proba >= 0.4::DOUBLE THEN 'formal' ELSE 'short' END")
TONE_NOTE = "CASE tone " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TEXT.TONES.items()) + f" ELSE '{TEXT.TONES[TEXT.DEFAULT_TONE]}' END"
PROMPTS = ATTR + f""",
flines AS (SELECT customerID, string_agg('driver.' || CAST(rank AS VARCHAR) || '=' || feature || '; ' || direction || '; ' ||
  {fixed('abs(shap_value)', 3)} || chr(10), '' ORDER BY rank) AS lines FROM top GROUP BY customerID),
ptone AS (SELECT s.*, {TONE} AS tone, f.lines FROM scored s LEFT JOIN flines f ON f.customerID = s.customerID),
prompts AS (SELECT customerID, tone,
  '{TEXT.PROMPT_HEAD}' || chr(10) || 'score=' || coalesce({pct('churn_proba')}, 'n/a') || chr(10) ||
  'contract=' || coalesce(Contract, 'n/a') || chr(10) || 'monthly=' || coalesce({fixed('MonthlyCharges', 2)}, 'n/a') || chr(10) ||
  'tenure_months=' || coalesce(CAST(tenure AS VARCHAR), 'n/a') || chr(10) || coalesce(lines, '') ||
  'style=' || {TONE_NOTE} || chr(10) || 'to=customer' || chr(10) || '{TEXT.PROMPT_TAIL}' AS user_prompt FROM ptone)"""
register("retention_prompt", "SELECT * FROM prompts", PROMPTS)
TOP10 = """hr AS (SELECT * FROM scored WHERE churn_proba >= 0.7::DOUBLE),
t10 AS (SELECT CAST(row_number() OVER (ORDER BY churn_proba DESC, customerID) AS INTEGER) AS rank, customerID, churn_proba,
  tenure, MonthlyCharges FROM hr QUALIFY rank <= 10)"""
register("summary_input", "SELECT rank, customerID, churn_proba, tenure, MonthlyCharges, "
                          "(SELECT count(*) FROM hr) AS n_high FROM t10", TOP10)
SUMMARY = f"""SELECT (SELECT count(*) FROM hr) AS n_high,
  '{TEXT.SUMMARY_HEAD}' || chr(10) || 'accounts=' || CAST((SELECT count(*) FROM hr) AS VARCHAR) || chr(10) ||
  coalesce((SELECT string_agg('account.' || CAST(rank AS VARCHAR) || '=' || customerID || '; tenure ' || CAST(tenure AS VARCHAR) ||
     '; monthly ' || {fixed('MonthlyCharges', 2)} || '; score ' || {pct('churn_proba')} || chr(10), '' ORDER BY rank) FROM t10), '') ||
  '{TEXT.SUMMARY_TAIL}' AS user_prompt"""
register("summary_prompt", SUMMARY, TOP10)


def lit(s: str) -> str:
    """A SQL string literal, newlines spelled with chr(10)."""
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


register("request_table", f"SELECT customerID, tone, user_prompt, 'mail' AS job, {lit(TEXT.MAIL_SYSTEM_PROMPT)} AS system_prompt, "
                          "CAST(500 AS INTEGER) AS max_tokens, 0.7::DOUBLE AS temperature FROM prompts", PROMPTS)
FALLBACK_HEAD, FALLBACK_TAIL = TEXT.FALLBACK_TEMPLATE.split("{detail}")
register("summary_request", f"SELECT n_high, user_prompt, 'summary' AS job, {lit(TEXT.SUMMARY_SYSTEM_PROMPT)} AS system_prompt, "
                            f"CAST(800 AS INTEGER) AS max_tokens, 0.5::DOUBLE AS temperature FROM ({SUMMARY})", TOP10)


def reason(e: str) -> str:
    return (f"CASE WHEN contains({e}, 'API key') OR contains(lower({e}), 'authentication') "
            f"THEN '{TEXT.ERROR_KEY}' WHEN contains(lower({e}), 'rate limit') THEN '{TEXT.ERROR_RATE}' "
            f"ELSE '{TEXT.ERROR_OTHER}' || {e} END")


def fallback(e: str) -> str:
    return f"({lit(FALLBACK_HEAD)} || {reason(e)} || {lit(FALLBACK_TAIL)})"


RESP = """resp AS (SELECT 'Customer#' || lpad(CAST(conv_id AS VARCHAR), 9, '0') AS customerID, turn,
  CASE conv_id % 5 WHEN 1 THEN 'Invalid API key provided' WHEN 2 THEN 'Authentication failed for this request'
    WHEN 3 THEN 'Rate Limit exceeded, retry later' WHEN 4 THEN 'Connection timed out' END AS error, text
  FROM conversations WHERE role = 'assistant'),
resp2 AS (SELECT customerID, turn, CASE WHEN error IS NULL THEN text END AS response, error FROM resp)"""
register("fallback_message", "SELECT customerID, turn, error, " + fallback("error")
         + " AS message FROM resp2 WHERE error IS NOT NULL", RESP)
register("attach_responses", "SELECT p.customerID, r.turn, p.tone, CASE WHEN r.response IS NOT NULL THEN 'ok' ELSE 'fallback' END AS outcome, "
         "CASE WHEN r.response IS NOT NULL THEN " + strip("r.response") + " ELSE "
         + fallback("coalesce(r.error, 'no response')")
         + " END AS message FROM prompts p LEFT JOIN resp2 r ON r.customerID = p.customerID", PROMPTS + ",\n" + RESP)
WORDS = f"len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> ''))"
register("message_stats", f"""SELECT conv_id, turn, CAST({WORDS} AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars,
  CAST(greatest(1, round_even({WORDS} / 200.0::DOUBLE, 0)) AS INTEGER) AS read_minutes FROM conversations""")
register("trim_response", "SELECT conv_id, turn, " + strip("text") + " AS response FROM conversations")

# ---------------------------------------------------------------- batch 2: storage round trips

register("processed_roundtrip", "SELECT * EXCLUDE (split) FROM hsplit WHERE split = 'test'")
register("test_ids", "SELECT customerID FROM hsplit WHERE split = 'test'")
SQL["scaler_roundtrip"] = SQL["fit_scaler"]
register("export_high_risk", "SELECT * FROM (SELECT s.customerID, s.label, s.churn_proba, c.* EXCLUDE (customerID) "
                             "FROM scored s JOIN cleaned c USING (customerID)) WHERE churn_proba >= 0.7::DOUBLE")
register("messages_roundtrip", f"SELECT p.customerID, {BAND.replace('churn_proba', 's.churn_proba')} AS risk_band, p.tone, "
                               "'mail' AS job, CAST(500 AS INTEGER) AS max_tokens, 0.7::DOUBLE AS temperature, p.user_prompt "
                               "FROM prompts p JOIN scored s ON s.customerID = p.customerID", PROMPTS)


# ---------------------------------------------------------------- batch 3: neighbours

SCALED = {"tenure": "(tenure - m_t) / s_t", "MonthlyCharges": "(MonthlyCharges - m_m) / s_m",
          "TotalCharges": "(TotalCharges - m_c) / s_c"}
VEC = "[" + ", ".join(f"round(CAST({SCALED.get(f, chr(34) + f + chr(34))} AS DOUBLE), 6)" for f in FEATURES) + "]"
VECS = SCALER_CTE + f""",
hv AS (SELECT customerID, label, split, {VEC} AS vec FROM hsplit, st),
vecs AS (SELECT hv.*, s.churn_proba FROM hv JOIN scored s ON s.customerID = hv.customerID)"""


def dist(a: str, b: str) -> str:
    return (f"sqrt(list_reduce(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])), "
            "lambda acc, x: acc + x))")


register("similar_customers", f"""SELECT target_id, rank, neighbor_id, round(d, 6) AS distance FROM (
  SELECT t.customerID AS target_id, c.customerID AS neighbor_id, {dist('t.vec', 'c.vec')} AS d,
    row_number() OVER (PARTITION BY t.customerID ORDER BY {dist('t.vec', 'c.vec')}, c.customerID) AS rank
  FROM (SELECT * FROM vecs ORDER BY churn_proba DESC, customerID LIMIT 5) t JOIN vecs c ON c.customerID <> t.customerID)
  WHERE rank <= 5""", VECS)
register("similar_all", f"""SELECT customerID, rank, neighbor_id, round(d, 6) AS distance FROM (
  SELECT a.customerID, b.customerID AS neighbor_id, {dist('a.vec', 'b.vec')} AS d,
    row_number() OVER (PARTITION BY a.customerID ORDER BY {dist('a.vec', 'b.vec')}, b.customerID) AS rank
  FROM vecs a JOIN vecs b ON a.customerID <> b.customerID) WHERE rank <= 5""", VECS)
register("embedding_knn", f"""SELECT vec_id, rank, neighbor_id, round(d, 6) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, {dist('a.vec', 'b.vec')} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {dist('a.vec', 'b.vec')}, b.vec_id) AS rank
  FROM ev a JOIN ev b ON a.vec_id <> b.vec_id) WHERE rank <= 5""",
         "ev AS (SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)")

HN = "CAST('0x' || substr(md5({x} || ':42'), 1, 8) AS BIGINT)"
SMOTE = VECS + f""",
tr AS (SELECT * FROM vecs WHERE split = 'train'),
cnt AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
mn AS (SELECT label AS minl, n AS n_min FROM cnt ORDER BY n, label LIMIT 1),
mj AS (SELECT n AS n_maj FROM cnt ORDER BY n DESC, label LIMIT 1),
prm AS (SELECT n_min, n_maj, (n_maj - n_min) // n_min AS q, (n_maj - n_min) % n_min AS rmd,
  least(5, n_min - 1) AS keff FROM mn, mj),
mino AS (SELECT tr.* FROM tr, mn WHERE tr.label = mn.minl),
rk AS (SELECT mino.*, row_number() OVER (ORDER BY {HN.format(x='customerID')}, customerID) AS hr FROM mino),
cp AS (SELECT rk.*, q + CASE WHEN hr <= rmd THEN 1 ELSE 0 END AS copies FROM rk, prm),
ex AS (SELECT customerID, label, vec, unnest(range(1, copies + 1)) AS i FROM cp WHERE copies > 0),
knn AS (SELECT a.customerID, b.customerID AS neighbor_id,
  row_number() OVER (PARTITION BY a.customerID ORDER BY {dist('a.vec', 'b.vec')}, b.customerID) AS j
  FROM mino a JOIN mino b ON a.customerID <> b.customerID),
sy AS (SELECT ex.*, CAST(1 + {HN.format(x="ex.customerID || ':' || CAST(i AS VARCHAR) || ':nb'")} % keff AS INTEGER) AS j,
  {HN.format(x="ex.customerID || ':' || CAST(i AS VARCHAR) || ':u'")} / 4294967296.0::DOUBLE AS u FROM ex, prm),
syn AS (SELECT 'syn-' || sy.customerID || '-' || CAST(sy.i AS VARCHAR) AS customerID, sy.label, 1 AS is_synthetic,
  list_transform(list_zip(sy.vec, nb.vec), lambda p: p[1] + u * (p[2] - p[1])) AS vec
  FROM sy JOIN knn ON knn.customerID = sy.customerID AND knn.j = sy.j
  JOIN mino nb ON nb.customerID = knn.neighbor_id),
allr AS (SELECT customerID, label, 0 AS is_synthetic, vec FROM tr UNION ALL SELECT * FROM syn)"""
register("smote", "SELECT customerID, label, is_synthetic, " + ", ".join(
    f'round(vec[{i + 1}], 6) AS "{f}"' for i, f in enumerate(FEATURES)) + " FROM allr", SMOTE)

# ---------------------------------------------------------------- batch 4: further keys

register("load_customers", "SELECT *, CAST(length(customerID) AS INTEGER) AS id_length FROM customers")
register("top_high_risk", f"""SELECT customerID, tenure, MonthlyCharges, TotalCharges, churn_proba, {BAND} AS risk_band,
  label AS true_label, {pct('churn_proba')} AS proba_text,
  CAST(row_number() OVER (ORDER BY churn_proba DESC, customerID) AS INTEGER) AS position
  FROM scored WHERE churn_proba >= 0.7::DOUBLE QUALIFY position <= 50""")
register("importance_for_chart", "SELECT CAST(row_number() OVER (ORDER BY m, feature DESC) AS INTEGER) AS position, feature, "
                                 "round(m, 6) AS mean_abs_shap FROM (SELECT feature, avg(abs(shap_value)) AS m FROM attr "
                                 "GROUP BY feature ORDER BY m DESC, feature LIMIT 12)", ATTR)
register("attach_scores", "SELECT c.customerID, c.Contract, s.churn_proba FROM customers c JOIN scored s ON s.customerID = c.customerID")
register("kmeans_inputs", "SELECT customerID, churn_proba, tenure, MonthlyCharges, TotalCharges FROM scored")
register("kmeans_check", "SELECT count(*) AS n_rows, 4 AS n_segments, 0 AS n_misplaced FROM customers")
register("model_roundtrip", "SELECT customerID, true AS same_score FROM hsplit WHERE split = 'test'")
register("prepare_counts", """SELECT * FROM (SELECT unnest(['raw', 'cleaned', 'encoded']) AS stage, (SELECT count(*) FROM customers) AS n)
  UNION ALL SELECT split, count(*) FROM hsplit GROUP BY split
  UNION ALL SELECT 'train_balanced', 2 * max(n) FROM (SELECT count(*) AS n FROM hsplit WHERE split = 'train' GROUP BY label)""")
register("stream_rule_score", f"SELECT customerID, churn_proba, {BAND} AS risk_band FROM scored")
BAD = "concat_ws(',', CASE WHEN k % 50 = 7 THEN 'tenure' END, CASE WHEN k % 75 = 7 THEN 'MonthlyCharges' END)"
register("stream_rejects", f"""SELECT customerID, CASE WHEN b = '' THEN churn_proba END AS churn_proba, nullif(b, '') AS bad_columns
  FROM (SELECT customerID, churn_proba, {BAD} AS b FROM (SELECT customerID, churn_proba, CAST(substr(customerID, 10, 9) AS INTEGER) AS k FROM scored))""")
TYPES = {f.name: f.dataType.simpleString() for f in CUSTOMER_SCHEMA}
register("column_types", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, " + (f"'{t}'" if t != "string" else
    f"CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST(trim({c}) AS DOUBLE) IS NULL) > 0 THEN 'string' "
    f"WHEN count(*) FILTER (WHERE TRY_CAST(trim({c}) AS DOUBLE) <> floor(TRY_CAST(trim({c}) AS DOUBLE))) > 0 THEN 'double' ELSE 'int' END")
    + " AS inferred FROM " + ("customers" if t == "string" else "(SELECT 1)") for c, t in TYPES.items()))
PLACED = VECS + ",\n" + "pl AS (" + " UNION ALL ".join(
    f"SELECT {t} AS t, customerID, vec, round(list_reduce(list_transform(list_zip(vec, "
    f"[{', '.join(f'{x!r}::DOUBLE' for x in direction(t, len(FEATURES)))}]), lambda p: p[1] * p[2]), lambda acc, x: acc + x), 6) AS proj FROM vecs"
    for t in range(DIRECTIONS)) + f"""),
blk AS (SELECT t, customerID, vec, (row_number() OVER (PARTITION BY t ORDER BY proj, customerID) - 1) // {BLOCK_ROWS} AS b FROM pl),
cand AS (SELECT DISTINCT a.customerID, c.customerID AS neighbor_id FROM blk a JOIN blk c
  ON a.t = c.t AND c.b BETWEEN a.b - 1 AND a.b + 1 AND a.customerID <> c.customerID)"""
register("similar_all_lsh", f"""SELECT customerID, rank, neighbor_id, round(d, 6) AS distance FROM (
  SELECT p.customerID, p.neighbor_id, {dist('a.vec', 'b.vec')} AS d,
    row_number() OVER (PARTITION BY p.customerID ORDER BY {dist('a.vec', 'b.vec')}, p.neighbor_id) AS rank
  FROM cand p JOIN vecs a ON a.customerID = p.customerID JOIN vecs b ON b.customerID = p.neighbor_id) WHERE rank <= 5""", PLACED)

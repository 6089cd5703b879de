"""Column roles and the raw customer schema."""

from pyspark.sql import types as T

ID_COL = "customerID"
TARGET_COL = "Churn"
LABEL_COL = "label"
SCORE_COL = "churn_proba"
SPLIT_COL = "split"

# --- Fixed values: column roles, category values, defaults of the reference ---
BINARY_COLS = ["gender", "Partner", "Dependents", "PhoneService", "PaperlessBilling", "MultipleLines"]
SERVICE_COLS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                "StreamingTV", "StreamingMovies"]
CATEGORICAL_COLS = ["InternetService", "Contract", "PaymentMethod"]
NUMERIC_COLS = ["tenure", "MonthlyCharges", "TotalCharges"]
SERVICE_VALUES = {"Yes": 1, "No": 0, "No internet service": 0, "No phone service": 0}
CONTRACTS = ["Month-to-month", "One year", "Two year"]
TENURE_RANGE = (0, 72)
CHARGES_RANGE = (0, 120)
HIGH_RISK = 0.7
MEDIUM_RISK = 0.4
TEST_SIZE = 0.2
SEED = 42
MIN_COLUMNS = 5
# --- end of fixed values ---

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType(), False),
    T.StructField("gender", T.StringType()),
    T.StructField("extra_flag", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])

RAW_COLUMNS = [f.name for f in CUSTOMER_SCHEMA.fields]

"""Hand-made edge rows (FIXTURES §6)."""

import pytest
from pyspark.sql import functions as F

from churnlens.schema import CUSTOMER_SCHEMA


def _raw(spark, rows):
    """Raw customer rows from partial dicts (missing columns null)."""
    names = [f.name for f in CUSTOMER_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CUSTOMER_SCHEMA)


def test_to_number_blank_abc_null(spark):
    from churnlens.operators.prepare import to_number
    df = _raw(spark, [{"customerID": "a", "TotalCharges": " "}, {"customerID": "b", "TotalCharges": "abc"},
                      {"customerID": "c", "TotalCharges": None}, {"customerID": "d", "TotalCharges": " 12.5 "}])
    got = {r.customerID: r.TotalCharges for r in to_number(df).collect()}
    assert got == {"a": None, "b": None, "c": None, "d": 12.5}


def test_median_even_count_fills(spark):
    from churnlens.operators.prepare import fill_median
    df = _raw(spark, [{"customerID": c, "TotalCharges": v} for c, v in
                      [("a", "1"), ("b", "2"), ("c", "10"), ("d", "20"), ("e", " ")]])
    got = {r.customerID: r.TotalCharges for r in fill_median(df).collect()}
    assert got["e"] == 6.0


def test_service_null_and_unknown_then_zero(spark):
    from churnlens.operators.prepare import encode_features
    df = _raw(spark, [{"customerID": "a", "OnlineBackup": None, "Churn": None},
                      {"customerID": "b", "OnlineBackup": "maybe", "Churn": "Yes"},
                      {"customerID": "c", "OnlineBackup": "No phone service", "Churn": "No"}])
    got = {r.customerID: (r.OnlineBackup, r.label) for r in encode_features(df, {}).collect()}
    assert got == {"a": (0, 0), "b": (0, 1), "c": (0, 0)}


def test_unseen_contract_gets_zero_columns(spark):
    from churnlens.operators.prepare import Fitted, encode_with
    fitted = Fitted({"Contract": ["Month-to-month", "One year", "Two year"]}, {"TotalCharges": 5.0},
                    {"tenure": (10.0, 2.0)}, ("tenure", "Contract_Month-to-month", "Contract_One year",
                                              "Contract_Two year", "TotalCharges"))
    df = _raw(spark, [{"customerID": "a", "Contract": "Ten year", "tenure": 12, "TotalCharges": " "}])
    r = encode_with(df, fitted).first()
    assert (r["Contract_Month-to-month"], r["Contract_One year"], r["Contract_Two year"]) == (0, 0, 0)
    assert r["tenure"] == 1.0 and r["TotalCharges"] == 5.0


def test_gender_rule(spark):
    from churnlens.operators.prepare import encode_gender
    df = _raw(spark, [{"customerID": "a", "gender": "Male"}, {"customerID": "b", "gender": "Female"},
                      {"customerID": "c", "gender": None}])
    assert {r.customerID: r.gender for r in encode_gender(df).collect()} == {"a": 1, "b": 0, "c": 0}


@pytest.mark.parametrize("p,band,bin_", [(0.0, "Low risk", None), (0.3999, "Low risk", "Low"),
                                         (0.4, "Medium risk", "Low"), (0.5, "Medium risk", "Medium"),
                                         (0.7, "High risk", "Medium"), (1.0, "High risk", "High")])
def test_band_edges(spark, p, band, bin_):
    from churnlens.functions.scalars import risk_band, risk_bin
    r = spark.createDataFrame([(p,)], "churn_proba double").select(
        risk_band("churn_proba").alias("b"), risk_bin("churn_proba").alias("n")).first()
    assert (r.b, r.n) == (band, bin_)


def test_tied_scores_auc_half(spark):
    from churnlens.operators.evaluate import roc_auc
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, churn_proba double")
    assert roc_auc(df).first()["roc_auc"] == pytest.approx((1 + 0.5 + 1 + 1) / 4)


def test_single_class_report_zeros(spark):
    from churnlens.operators.evaluate import class_report
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    rows = {r["class"]: r for r in class_report(df).collect()}
    assert rows["1"]["precision"] == 0.0 and rows["1"]["f1"] == 0.0 and rows["1"]["support"] == 0
    assert rows["accuracy"]["f1"] == 1.0


def test_smote_single_class_unchanged(spark):
    from churnlens.operators.balance import smote
    df = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "customerID string, label int, x double")
    assert smote(df, ["x"], "label").count() == 2


def test_smote_small_minority_uses_fewer_neighbours(spark):
    from churnlens.operators.balance import smote
    rows = [(f"m{i}", 0, float(i)) for i in range(8)] + [("a", 1, 100.0), ("b", 1, 104.0), ("c", 1, 110.0)]
    out = smote(spark.createDataFrame(rows, "customerID string, label int, x double"), ["x"], "label", k=5)
    pdf = out.toPandas()
    assert (pdf.groupby("label").size() == 8).all()
    syn = pdf[pdf.is_synthetic == 1]
    assert syn.x.between(100.0, 110.0).all()


def test_tied_and_zero_attributions(spark):
    from churnlens.operators.explain import top_factors
    from churnlens.operators.explain import ATTRS
    attr = spark.createDataFrame([("a", [("f2", 1.0, 0.5), ("f1", 1.0, -0.5), ("f3", 0.0, 0.0)])],
                                 f"customerID string, attrs {ATTRS}")
    rows = top_factors(attr, 3).orderBy("rank").collect()
    assert [r.feature for r in rows] == ["f1", "f2", "f3"]
    assert rows[2].direction == "lowers risk" and rows[1].direction == "raises risk"


def test_empty_contract_list_is_no_filter_and_no_match(spark):
    from churnlens.operators.risk import apply_filters, filter_coverage, filter_predicate
    df = spark.createDataFrame([("a", "One year", 10, 50.0), ("b", "Two year", 80, 50.0)],
                               "customerID string, Contract string, tenure int, MonthlyCharges double")
    assert apply_filters(df, []).count() == 1          # tenure 80 is outside 0-72
    none = filter_coverage(df, filter_predicate(df, ["Month-to-month"])).first()
    assert (none.n_shown, none.n_total) == (0, 2)


def test_fallback_kinds_and_trim(spark):
    from churnlens.operators.messages import ERROR_KEY, ERROR_OTHER, ERROR_RATE, attach_responses
    req = spark.createDataFrame([(c,) for c in "abcd"], "customerID string")
    resp = spark.createDataFrame([("a", None, "Bad API key"), ("b", None, "AUTHENTICATION failed"),
                                  ("c", None, "RATE LIMIT hit"), ("d", "  \n hello there \t ", None)],
                                 "customerID string, response string, error string")
    got = {r.customerID: r.message for r in attach_responses(req, resp).collect()}
    assert ERROR_KEY in got["a"] and ERROR_KEY in got["b"] and ERROR_RATE in got["c"]
    assert got["d"] == "hello there"
    other = spark.createDataFrame([("x", None, "boom")], "customerID string, response string, error string")
    assert ERROR_OTHER + "boom" in attach_responses(spark.createDataFrame([("x",)], "customerID string"),
                                                    other).first().message


@pytest.mark.parametrize("words,minutes", [(0, 1), (100, 1), (300, 2), (500, 2)])
def test_reading_minutes_half_even(spark, words, minutes):
    from churnlens.operators.messages import message_stats
    text = " ".join(["w"] * words)
    r = message_stats(spark.createDataFrame([(text,)], "message string")).first()
    assert (r.words, r.read_minutes) == (words, minutes)


def test_loader_guards(spark, tmp_path):
    from churnlens.sources.io import load_customers
    with pytest.raises(FileNotFoundError):
        load_customers(spark, str(tmp_path / "missing.csv"), "csv")
    p = tmp_path / "thin.csv"
    p.write_text("a,b\n1,2\n")
    for schema in ({}, {"schema": None}):
        with pytest.raises(ValueError):
            load_customers(spark, str(p), "csv", **schema)


def test_loader_reads_by_name(spark, tmp_path):
    from churnlens.sources.io import load_customers
    p = tmp_path / "swapped.csv"
    p.write_text("Dependents,note,Partner,tenure,customerID,MonthlyCharges\nNo,x y,Yes,7,c1,20.5\n")
    df = load_customers(spark, str(p), "csv")
    assert df.first().asDict() == {"Dependents": "No", "note": "x y", "Partner": "Yes", "tenure": 7, "customerID": "c1",
                                   "MonthlyCharges": 20.5}
    df.write.parquet(str(tmp_path / "p"))
    assert load_customers(spark, str(tmp_path / "p")).columns == df.columns
    bad = tmp_path / "bad.csv"
    bad.write_text("customerID,Partner,tenure,Dependents,Churn\nc1,Yes,seven,No,No\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_customers(spark, str(bad), "csv").collect()


def test_unicode_white_space(spark):
    from churnlens.operators.messages import message_stats, trim_response
    nb, em = chr(0xA0), chr(0x2003)
    text = f"{nb}\n two{em}words {nb}"
    r = message_stats(spark.createDataFrame([(text,)], "message string")).first()
    assert r.words == len(text.split()) == 2
    assert trim_response(spark.createDataFrame([(text,)], "response string")).first().response == text.strip()


def test_only_local_masters_get_a_local_folder():
    import types

    from churnlens.session import checkpoint_root
    ctx = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=ctx)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(session)


def test_missing_model_is_told_from_a_broken_one(spark, tmp_path):
    from churnlens.sources.io import load_model
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"))
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception) as e:
        load_model(str(tmp_path / "broken"))
    assert not isinstance(e.value, FileNotFoundError)


def test_csv_round_trip(spark, tmp_path):
    from churnlens.plans import tables
    from churnlens.sources.io import load_customers, write_csv
    from conftest import SF_SMALL
    c = tables.customers(spark, SF_SMALL)
    write_csv(c, str(tmp_path / "c"))
    back = load_customers(spark, str(tmp_path / "c"), "csv")
    assert back.exceptAll(c).count() == 0 and c.exceptAll(back).count() == 0


def test_scan_prunes_columns_and_pushes_filters(spark):
    from churnlens.sources.fixture import table
    from conftest import SF_SMALL
    plan = table(spark, SF_SMALL, "orders").where(F.col("o_custkey") < 10).select("o_totalprice") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), LessThan(o_custkey,10)]" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_smote_snap_flags(spark):
    from churnlens.operators.balance import smote
    rows = [(f"m{i}", 0, float(i), float(i % 2)) for i in range(8)] + \
           [("a", 1, 100.0, 0.0), ("b", 1, 104.0, 1.0), ("c", 1, 110.0, 1.0)]
    df = spark.createDataFrame(rows, "customerID string, label int, x double, flag double")
    out = smote(df, ["x", "flag"], "label", k=2, snap_flags=["flag"]).toPandas()
    assert set(out.flag.unique()) <= {0.0, 1.0}


def test_column_types_inferred_from_values(spark):
    from churnlens.operators.profile import column_types
    df = spark.createDataFrame([("a", "1", "1.5", " "), ("b", "2", "2", "3")],
                               "customerID string, ints string, nums string, blanky string")
    got = {r.column_name: r.inferred for r in column_types(df).collect()}
    assert got == {"customerID": "string", "ints": "int", "nums": "double", "blanky": "string"}

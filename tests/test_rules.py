import pytest
from pyspark.sql import functions as F

from creditloom.functions import rules as R
from creditloom.functions import serving as V
from creditloom.operators import loans


def perf(spark, rows):
    """rows: (loan, status, modification, assistance, zero balance, age, eltv)"""
    schema = (
        "loan_identifier string, current_loan_delinquency_status string, modification_flag string, "
        "borrower_assistance_status string, zero_balance_code string, loan_age int, estimated_ltv string, "
        "remaining_months_to_maturity int, current_interest_rate double"
    )
    return spark.createDataFrame([(*r, 300, 4.0) for r in rows], schema)


@pytest.mark.parametrize(
    "row, level",
    [
        (("RA", None, None), 3), (("0", None, None), 0), (("1", None, None), 1), (("5", None, "F"), 1),
        (("6", None, None), 2), (("0", "Y", None), 2), (("0", None, "F"), 1), ((None, None, None), 0),
        (("junk", None, None), 0),
    ],
)
def test_stress_ladder(spark, row, level):
    out = loans.loan_labels(perf(spark, [("a", *row, None, 1, "80")])).first()
    assert (out["bssi"], out["stress_flag"], out["stress_level"]) == (level, int(level > 0), min(level, 2))


def test_rollup_keeps_feature_side_and_labels_use_label_side(spark):
    df = perf(
        spark,
        [
            ("a", "RA", None, None, "01", 0, "999"), ("a", "RA", "Y", None, None, 0, ""),
            ("b", "3", None, "F", None, 7, "80"), ("b", "x", None, None, None, 9, "300"), (None, "9", None, None, None, 1, "1"),
        ],
    )
    out = {r["loan_identifier"]: r for r in loans.loan_rollup(df).collect()}
    assert set(out) == {"a", "b"}
    only_ra = loans.loan_labels(df).where("loan_identifier = 'a'").first()
    assert only_ra["max_delinquency"] is None and only_ra["bssi"] == 3
    assert out["a"]["max_delinquency"] == 0.0 and out["a"]["estimated_ltv_avg"] is None
    assert (out["a"]["ever_modified"], out["a"]["modification_count"], out["a"]["ever_zero_balance"]) == (1, 1, 1)
    assert out["b"]["avg_delinquency"] == 1.5 and out["b"]["months_delinquent"] == 1
    assert out["b"]["estimated_ltv_max"] == 300.0 and out["b"]["rate_volatility"] == 0.0


def test_zero_age_counts_as_one_month_and_negative_age_passes(spark):
    df = spark.createDataFrame([(2, 0), (2, 4), (2, -2), (2, None)], "n int, age int")
    got = [r[0] for r in df.select(R.per_month_of_age(F.col("n"), F.col("age"))).collect()]
    assert got == [2.0, 0.5, -1.0, None]


def test_serviceability_is_null_safe_and_unclipped_on_ltv(spark):
    rows = [(850, 120, 200, 4), (700, None, 80, 1), (700, 30, 80, 2)]
    df = spark.createDataFrame(rows, "credit_score int, dti int, ltv int, num_borrowers int")
    got = [r[0] for r in df.select(R.serviceability_score()).collect()]
    assert got[0] == pytest.approx(40 + 0 - 20 + 10) and got[1] is None
    assert got[2] == pytest.approx(700 / 850 * 40 + 15 + 4 + 5)


def test_category_text(spark):
    df = spark.createDataFrame([(35620.0, "A"), (1.5, None), (None, "nan")], "msa double, channel string")
    rows = df.select(R.category_text(df, "msa"), R.category_text(df, "channel")).collect()
    assert [tuple(r) for r in rows] == [("35620", "A"), ("1.5", "UNKNOWN"), ("UNKNOWN", "nan")]


def test_months_between(spark):
    df = spark.createDataFrame([(201803, 204802), (201812, 201901), (None, 201901)], "a int, b int")
    got = [r[0] for r in df.select(R.months_between_yyyymm(F.col("a"), F.col("b"))).collect()]
    assert got == [359, 1, None]


def test_amount_rounding_is_half_even_and_null_safe(spark):
    df = spark.sql("select log1p(cast(v as double)) l from values (10500), (11500), (12500), (1), (9e9), (null) t(v)")
    got = [r[0] for r in df.select(V.clean_amount(F.col("l"))).collect()]
    assert got[3:] == [10_000, 2_000_000, None]
    assert all(v % 1000 == 0 for v in got[:5])


def test_terms(spark):
    df = spark.createDataFrame([(150.0,), (151.0,), (210.0,), (500.0,), (15.0,), (None,)], "t double")
    rows = df.select(V.clean_term(F.col("t"), F.lit(False)).alias("m"), V.clean_term(F.col("t"), F.lit(True)).alias("c")).collect()
    assert [r["m"] for r in rows] == [120, 180, 180, 360, 120, None]
    assert [r["c"] for r in rows] == [120, 180, 180, 360, 180, None]
    assert [r[0] for r in df.select(V.clip_rate(F.col("t"))).collect()] == [20.0, 20.0, 20.0, 20.0, 15.0, None]


def test_applications_defaults_and_violations(spark):
    df = spark.createDataFrame([(1, 740, "ca"), (2, 9999, "NEW"), (3, None, None)], "id int, credit_score int, property_state string")
    out = {r["id"]: r for r in V.validate_applications(df).collect()}
    assert out[1]["accepted"] and out[2]["violations"] == ["credit_score", "property_state"]
    assert out[3]["violations"] == ["credit_score", "property_state"]
    row = V.application_features(df.where("id = 1"), keep=["id"], unknown_msa=True).first()
    assert row["property_state"] == "CA" and row["msa"] == "UNKNOWN" and row["quarter"] == "2018Q4"
    assert row["first_time_homebuyer_indicator"] == "N" and len(row) == 21

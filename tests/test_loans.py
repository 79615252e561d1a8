import numpy as np
import pandas as pd
import pytest

from creditloom import schemas as S
from creditloom.operators import loans, quality


def test_buckets_equal_pandas_qcut_with_ties(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"quarter": rng.choice(["q1", "q2"], 3000), "bss": np.round(rng.normal(50, 9, 3000), 1)})
    pdf.loc[rng.random(3000) < 0.05, "bss"] = np.nan
    df = spark.createDataFrame(pdf.reset_index().astype(object).where(pdf.reset_index().notna(), None), "index long, quarter string, bss double")
    got = loans.quantile_buckets(df, "bss").toPandas().set_index("index").sort_index()
    for _, part in pdf.groupby("quarter"):
        want = pd.qcut(part.bss, 5, labels=[1, 2, 3, 4, 5])
        assert (got.loc[part.index, "bss_level"].fillna(0) == want.astype(float).fillna(0)).all()
    assert got.bss_bucket[got.bss_level == 1].unique().tolist() == ["Very Low"]
    assert got.bss_bucket[got.bss_level.isna()].isna().all()


def test_coinciding_edges_are_an_error_and_empty_groups_stay_null(spark):
    df = spark.createDataFrame([("q1", 1.0)] * 10 + [("q2", None)] * 3, "quarter string, bss double")
    with pytest.raises(ValueError, match="unique"):
        loans.quantile_buckets(df, "bss")
    empty = loans.quantile_buckets(df.where("quarter = 'q2'"), "bss").collect()
    assert [r["bss_level"] for r in empty] == [None] * 3


def test_norms_per_group_and_constant_column(spark):
    rows = [("q1", 600, 10, 3.0, 1, 80), ("q1", 800, 30, 5.0, 1, 60), ("q2", 700, 10, 3.0, 1, 80), ("q2", 720, None, 4.0, 2, 70)]
    df = spark.createDataFrame(rows, "quarter string, credit_score int, dti int, interest_rate double, num_borrowers int, ltv int")
    out = loans.add_norms(df).orderBy("quarter", "credit_score").collect()
    assert [r["credit_score_norm"] for r in out] == [0.0, 1.0, 0.0, 1.0]
    assert [r["ltv_norm"] for r in out] == [0.0, 1.0, 0.0, 1.0]
    assert [r["num_borrowers_norm"] for r in out] == [None, None, 0.0, 1.0]
    assert out[2]["dti_norm"] is None and out[0]["dti_norm"] == 1.0
    whole = loans.add_norms(df, by=[]).orderBy("credit_score").collect()
    assert [r["credit_score_norm"] for r in whole] == [0.0, 0.5, 0.6, 1.0]


def test_left_join_keeps_unmatched_and_right_names(spark):
    left = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "loan_identifier string, max_delinquency int, ever_modified boolean")
    right = spark.createDataFrame([("a", 5.0, 1)], "loan_identifier string, max_delinquency double, ever_modified int")
    out = {r["loan_identifier"]: r for r in loans.join_features(left, right).collect()}
    assert out["a"]["max_delinquency"] == 5.0 and out["b"]["max_delinquency"] is None
    assert len(out["a"]) == 3


def test_union_fails_on_schema_drift(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    assert loans.union_quarters([a, a.select("y", "x")]).count() == 2
    with pytest.raises(Exception):
        loans.union_quarters([a, a.select("x")])


def test_reconciliation(spark):
    a = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "loan_identifier string")
    b = spark.createDataFrame([("a",), ("c",)], "loan_identifier string")
    assert quality.reconcile_keys(a, b).first().asDict() == {
        "left_keys": 2, "right_keys": 2, "left_only": 1, "right_only": 1, "counts_match": True,
    }
    quality.require_same_keys(a, b)
    with pytest.raises(ValueError):
        quality.require_same_keys(a, b, strict=True)
    with pytest.raises(ValueError):
        quality.require_same_keys(a, b.limit(1))


def test_master_validation(spark):
    df = spark.createDataFrame([(1,)], "loan_identifier int")
    with pytest.raises(ValueError, match="stress_flag"):
        quality.validate_master(df)
    full = spark.createDataFrame([], ", ".join(f"{c} int" for c in S.MASTER_REQUIRED))
    with pytest.raises(ValueError, match="empty"):
        quality.validate_master(full)

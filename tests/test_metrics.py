import numpy as np
import pandas as pd
import pytest

from creditloom.operators import metrics


def test_auc_with_ties_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    want = ((pos > neg) + 0.5 * (pos == neg)).mean()
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    assert metrics.roc_auc(df, "y", "s").first()["roc_auc"] == pytest.approx(want)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()["roc_auc"] is None


def test_regression_and_amount(spark):
    pdf = pd.DataFrame({"y": [1.0, 2.0, 4.0], "p": [1.5, 2.0, 3.0]})
    row = metrics.regression_metrics(spark.createDataFrame(pdf), "y", "p").first()
    error = pdf.y - pdf.p
    assert row["rmse"] == pytest.approx(np.sqrt((error**2).mean())) and row["mae"] == pytest.approx(0.5)
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((pdf.y - pdf.y.mean()) ** 2).sum())
    assert row["mape_pct"] == pytest.approx((error.abs() / pdf.y).mean() * 100)
    amount = metrics.amount_metrics(spark.createDataFrame(pdf), "y", "p").first()
    assert amount["mae_dollars"] == pytest.approx((np.expm1(pdf.y) - np.expm1(pdf.p)).abs().mean())
    flat = spark.createDataFrame(pd.DataFrame({"y": [2.0, 2.0], "p": [1.0, 2.0]}))
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] is None


def test_binary_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    assert metrics.binary_metrics(df, "y", "p").first().asDict() == {
        "accuracy": pytest.approx(1 / 3), "precision": 0.0, "recall": 0.0, "f1": 0.0,
    }


def test_classification_report(spark):
    pairs = [(15, 15), (15, 30), (30, 30), (30, 30), (99, 30), (30, 7)]
    df = spark.createDataFrame(pairs, "y int, p int")
    out = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert (out["15"]["precision"], out["15"]["recall"], out["15"]["support"]) == (1.0, 0.5, 2)
    assert out["30"]["precision"] == 0.5 and out["30"]["recall"] == pytest.approx(2 / 3)
    assert out["7"]["support"] == 0 and out["99"]["f1"] == 0.0
    assert out["accuracy"]["f1"] == pytest.approx(0.5) and out["accuracy"]["support"] == 6
    assert out["macro avg"]["precision"] == pytest.approx(1.5 / 4)
    assert out["weighted avg"]["recall"] == pytest.approx(0.5)


def test_best_by_metric_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "model string, mae double")
    assert metrics.best_by_metric(df, "mae", ["model"]).first()["model"] == "a"
    assert metrics.best_by_metric(df, "mae", ["model"], ascending=False).first()["model"] == "a"

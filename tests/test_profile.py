import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import profile, quality


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(1e6, 2, n)
    pdf = pd.DataFrame(
        {"x": x, "y": x * 2 + rng.normal(0, 3, n), "z": rng.integers(0, 5, n).astype(float), "flat": 0.1, "label": rng.integers(0, 3, n)}
    )
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    pdf.loc[rng.random(n) < 0.3, "z"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, data):
    out = spark.createDataFrame(data)
    return out.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c != "label" else c for c in out.columns])


def test_correlation(df, data):
    names = ["x", "y", "z", "flat"]
    got = profile.correlation_matrix(df, names).toPandas().pivot(index="feature_a", columns="feature_b", values="corr")
    want = data[names].corr()
    for a in names:
        for b in names:
            if np.isnan(want.loc[a, b]):
                assert np.isnan(got.loc[a, b])
            else:
                assert got.loc[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_describe_whole_and_grouped(df, data):
    got = profile.numeric_summary(df, ["x", "y", "z"]).toPandas().set_index("column")
    want = data[["x", "y", "z"]].describe().T
    for a, b in zip(["count", "mean", "std", "min", "q25", "q50", "q75", "max"], want.columns):
        assert np.allclose(got.loc[want.index, a].astype(float), want[b], rtol=1e-9)
    grouped = profile.numeric_summary(df, ["y"], ["label"]).toPandas().set_index("label").sort_index()
    assert np.allclose(grouped.q50, data.groupby("label").y.median())


def test_outliers_and_missing(df, data):
    got = profile.outlier_summary(df, ["y", "flat"]).toPandas().set_index("column")
    q1, q3 = data.y.quantile([0.25, 0.75])
    want = ((data.y < q1 - 1.5 * (q3 - q1)) | (data.y > q3 + 1.5 * (q3 - q1))).sum()
    assert got.outlier_count["y"] == want and got.outlier_count["flat"] == 0
    missing = profile.missing_values(df).collect()
    assert missing[0]["column"] == "z" and missing[0]["missing_count"] == data.z.isna().sum()
    summary = {r["metric"]: r["value"] for r in profile.dataset_summary(df).collect()}
    assert summary["Missing Cells"] == data.isna().sum().sum() and summary["Numeric Columns"] == 5


def test_histogram_matches_numpy(df, data):
    for name in ("x", "flat"):
        counts, edges = np.histogram(data[name], bins=30)
        got = profile.histogram(df, name, 30).orderBy("bin").toPandas()
        assert (got["count"].to_numpy() == counts).all() and np.allclose(got.low, edges[:-1])


def test_mutual_information(df, data):
    got = profile.mutual_information(df, ["x", "z"], "label", bins=4).toPandas().set_index("feature").score
    z = data.z.fillna(data.z.median())
    edges = np.unique(data.z.dropna().quantile([0.25, 0.5, 0.75]))
    joint = pd.crosstab(np.searchsorted(edges, z, side="left"), data.label) / len(data)
    outer = np.outer(joint.sum(axis=1), joint.sum(axis=0))
    want = (joint.to_numpy() * np.log(np.where(joint > 0, joint / outer, 1))).sum()
    assert got["z"] == pytest.approx(want, abs=1e-12)


def test_counts_and_crosstab(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 1), ("a", None)], "k string, f int")
    counts = [tuple(r) for r in profile.value_counts(df, "k", keep_null=True).collect()]
    assert counts == [("a", 3, 0.6), (None, 1, 0.2), ("b", 1, 0.2)]
    assert [r["pct"] for r in profile.value_counts(df, "k").collect()] == [0.75, 0.25]
    by_row = {r["k"]: (r["f_0"], r["f_1"]) for r in profile.crosstab(df, "k", "f", [0, 1], "index").collect()}
    assert by_row == {"a": (50.0, 50.0), "b": (0.0, 100.0)}
    by_column = {r["k"]: (r["f_0"], r["f_1"]) for r in profile.crosstab(df, "k", "f", [0, 1], "columns").collect()}
    assert by_column == {"a": (100.0, 50.0), "b": (0.0, 50.0)}
    assert {r["column"] for r in profile.constant_features(df.withColumn("c", F.lit("N"))).collect()} == {"c"}
    top = [(r["value"], r["count"]) for r in profile.top_values(df, ["k"], 1).collect()]
    assert top == [("a", 3)]


def test_quality_reports(spark):
    df = spark.createDataFrame([("7", 1, 9999), ("X", 0, 700), (None, 1, 9999)], "f string, t int, credit_score int")
    bad = [tuple(r) for r in quality.domain_check(df, {"f": ["7", "N"]}).collect()]
    assert bad == [("f", "X", 1)]
    census = quality.sentinel_census(df, {"credit_score": 9999}).first()
    assert census["sentinel_count"] == 2 and census["sentinel_pct"] == pytest.approx(200 / 3)
    leak = {r["feature"]: r["present"] for r in quality.leakage_check(df.withColumnRenamed("credit_score", "max_delinquency"), "t").collect()}
    assert leak["max_delinquency"] and not leak["avg_delinquency"]
    unseen = quality.unseen_categories(df.where("t = 1"), {"valid": df}, ["f"]).collect()
    assert [tuple(r) for r in unseen] == [("valid", "f", "X")]


def test_unseen_by_split_and_codes_of_other_columns(spark):
    df = spark.createDataFrame([("a", 999), ("b", 9999), ("c", 7), ("c", 999), (None, None)], "f string, n int")
    got = quality.unseen_categories(df.where("f = 'a'"), {"valid": df.where("f = 'b' OR f IS NULL"), "test": df}, ["f"]).collect()
    assert sorted((r.split, r.column, r.value) for r in got) == [("test", "f", "b"), ("test", "f", "c"), ("valid", "f", "b")]
    assert quality.code_census(df, ["n"], [999, 9999]).first() == ("n", 3, 60.0)

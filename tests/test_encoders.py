import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators import encoders


def test_median_fill_and_mode_ties(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (10.0, "b"), (None, "a")], "x double, c string")
    other = spark.createDataFrame([(None, None)], "x double, c string")
    assert tuple(encoders.median_fill(train, other).first()) == (2.0, "UNKNOWN")
    assert encoders.impute_mode(train, other, ["c"]).first()["c"] == "a"


def test_scaler_population_std_constant_and_all_null(spark):
    train = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, 5.0, None)], "x double, k double, n double")
    scaler = encoders.NumericScaler.fit(train, ["x", "k", "n"])
    assert scaler.medians == {"x": 2.0, "k": 5.0, "n": 0.0}
    assert scaler.stds["x"] == pytest.approx(np.std([1, 3, 2])) and scaler.stds["k"] == 1.0
    assert [r["k"] for r in scaler.transform(train).collect()] == [0.0] * 3


def small(spark, rows=200):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(
        {"id": range(rows), "num": rng.normal(0, 1, rows), "cat": rng.choice(["A", "B", "C", "rare"], rows, p=[0.5, 0.3, 0.17, 0.03]), "one": "X"}
    )
    return pdf, spark.createDataFrame(pdf)


def test_preprocessor_linear_and_tree(spark):
    pdf, df = small(spark)
    linear = encoders.TabularPreprocessor("linear", ["num"], ["cat", "one"]).fit(df)
    assert linear.feature_names == ["num", "cat__A", "cat__B", "cat__C", "one__X"]
    unknown = spark.createDataFrame([(900, 0.0, "new", "X"), (901, None, None, None)], "id long, num double, cat string, one string")
    rows = linear.assemble(df.unionByName(unknown)).orderBy("id").collect()
    for r in rows:
        v = r["features"].toArray()
        assert v[1:].tolist() == [float(r["cat"] == c) for c in "ABC"] + [float(r["one"] == "X")]
    assert rows[0]["features"].toArray()[0] == pytest.approx((pdf.num[0] - pdf.num.mean()) / pdf.num.std(ddof=0))
    assert rows[0]["num"] == pdf.num[0]  # raw columns stay
    tree = encoders.TabularPreprocessor("tree", ["num"], ["cat", "one"]).fit(df)
    codes = {r["cat"]: r["features"].toArray()[1] for r in tree.assemble(df.unionByName(unknown)).collect()}
    assert codes == {"A": 0.0, "B": 1.0, "C": 2.0, "rare": 3.0, "new": -1.0, None: -1.0}
    long = linear.transform_long(df, ["id"]).where("id = 0").collect()
    assert {r["feature"] for r in long} == {"num", f"cat__{pdf.cat[0]}", "one__X"} - ({"cat__rare"} if pdf.cat[0] == "rare" else set())
    with pytest.raises(ValueError):
        encoders.TabularPreprocessor("other")


def test_dictionary_is_sorted_and_dense(spark):
    rng = np.random.default_rng(8)
    words = [f"{x:x}é" for x in rng.integers(0, 10**6, 3000)] + ["UNKNOWN"] * 3000 + [None] * 50
    df = spark.createDataFrame([(i, w, "k") for i, w in enumerate(words)], "id int, c string, d string")
    made = encoders.fit_categories(df.repartition(9), ["c", "d"])
    order = sorted(set(words) - {None})
    assert made.values("c") == order and made.values("d") == ["k"] and made.sizes == {"c": len(order), "d": 1}
    assert made.common == {"c": {"UNKNOWN": float(order.index("UNKNOWN"))}, "d": {"k": 0.0}}
    other = spark.createDataFrame([(-1, "new", None)], df.schema)
    for r in encoders.ordinal_encode(df.unionByName(other), made).collect():
        assert r["c_code"] == (order.index(r["c"]) if r["c"] in order else -1) and r["d_code"] == (0 if r["d"] else -1)
    assert encoders.fit_categories(df.where("id < 0"), ["c"]).sizes == {"c": 0}
    few = encoders.fit_categories(df, ["c"], min_count=2)
    assert few.values("c") == sorted({w for w in words if w and words.count(w) > 1})


def test_a_million_categories_and_a_hot_one(spark):
    """Half of the rows are UNKNOWN; the rest is one value in a million each. No join takes the hot value."""
    n = 1_000_000
    df = spark.range(2 * n).select("id", F.when(F.col("id") < n, F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0"))).otherwise("UNKNOWN").alias("c"))
    made = encoders.fit_categories(df, ["c"])
    assert made.sizes == {"c": n + 1} and made.common == {"c": {"UNKNOWN": 0.0}}
    coded = encoders.ordinal_encode(df, made)
    wrong = coded.where(F.col("c_code") != F.when(F.col("id") < n, F.col("id") + 1).otherwise(0))
    assert wrong.count() == 0 and coded.count() == 2 * n


def test_target_encoding_by_brute_force(spark):
    pdf, df = small(spark)
    pdf["cat"] = [f"own{i}" if i % 3 == 0 else c for i, c in enumerate(pdf["cat"])]  # common and rare values
    pdf["y"] = np.sin(pdf.id) + pdf.cat.map({"A": 1, "B": 5, "C": 9, "rare": 30}).fillna(2)
    df = spark.createDataFrame(pdf)
    encoder = encoders.TargetEncoder(["cat"], "y", ["id"]).fit(df)

    def encode(part, value):
        mean, var = part.y.mean(), part.y.var(ddof=0)
        rows = part[part.cat == value].y
        if len(rows) == 0:
            return mean
        share = var * len(rows) / (var * len(rows) + rows.var(ddof=0))
        return share * rows.mean() + (1 - share) * mean

    folds = {r["id"]: r["f"] for r in df.select("id", encoder._fold().alias("f")).collect()}
    pdf["fold"] = pdf.id.map(folds)
    assert pdf.fold.nunique() == 5
    for r in encoder.transform(df, training=True).collect():
        assert r["cat_encoded"] == pytest.approx(encode(pdf[pdf.fold != folds[r["id"]]], r["cat"]))
    fresh = spark.createDataFrame([(1, "A"), (2, "never seen")], "id long, cat string")
    got = {r["id"]: r["cat_encoded"] for r in encoder.transform(fresh).collect()}
    assert got[1] == pytest.approx(encode(pdf, "A")) and got[2] == pytest.approx(pdf.y.mean())


def test_class_weights(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,), (None,)], "y int")
    assert {r["y"]: r["weight"] for r in encoders.class_weights(df, "y").collect()} == {0: 4 / 6, 1: 2.0}
    assert encoders.positive_weight(df, "y") == 2.0

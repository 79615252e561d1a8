"""What lets the explanations, quantiles and stores grow: the same results from fewer or smaller steps."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.models import boosting as B
from creditloom.models import training as M
from creditloom.operators import explain, quantiles
from creditloom.sources import feature_store as store


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).selectExpr("id AS k", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id * 37 % 11 AS DOUBLE) AS b").cache()


def test_rollup_tasks_follow_the_contributions(spark, monkeypatch):
    monkeypatch.setattr(explain, "_TASK_CONTRIBUTIONS", 50)
    parts = spark.range(100).selectExpr(
        "IF(id < 10, NULL, id) AS k", "inline(array(named_struct('feature', 'x__1', 'contribution', id * 1D), named_struct('feature', 'x__2', 'contribution', 1D), named_struct('feature', 'y', 'contribution', -2D * id)))"
    )
    out = explain.attribution_rollup(parts, ["k"], 1)
    assert out.rdd.getNumPartitions() == 6
    got = {r["k"]: (r["feature"], r["value"]) for r in out.collect()}
    assert len(got) == 91 and got[50] == ("y", -100.0) and got[None] == ("y", -90.0)


def boosted():
    tree = B.Tree(np.array([1, 0, -1] + [-1] * 4, np.int32), np.array([1, 2, 0] + [0] * 4, np.int32), np.array([0.0, 0.0, 4.0, 1.0, -2.0, 0.0, 0.0]))
    return B.BoostedModel("squared", np.array([0.5]), [np.array([1.0, 2.0, 4.0]), np.array([3.0, 6.0])], [[tree]], np.ones(2))


def test_attribution_switches_bins(spark, rows):
    model = boosted()
    df = rows.select("k", array_to_vector(F.array("a", "b")).alias("features"))
    sample = rows.where("k < 5").select(F.array("a", "b").alias("x"))
    plain = explain.array_attribution(df, sample, model.scores, ["a", "b"], ["k"])
    bins = explain.array_attribution(df, sample, model.binned_scores, ["a", "b"], ["k"], prepare=model.binned)
    p, q = ({(r["k"], r["feature"]): r["contribution"] for r in d.collect()} for d in (plain, bins))
    assert p == q and len(p) == 400 and len(set(p.values())) > 5


def test_impact_of_codes_equals_impact_of_values(rows):
    model = boosted()

    def assemble(df):
        return df.withColumn("features", array_to_vector(F.array(F.col("b") / 2, F.col("a") + 1)))

    def predict(df):
        return model.transform(assemble(df), prediction="p").drop("features")

    plain = explain.model_permutation_impact(rows, predict, "p", ["a", "b"], ["k"]).collect()
    codes = explain.model_permutation_impact(rows, predict, "p", ["a", "b"], ["k"], encoded=(assemble, model.scores, ["b", "a"])).collect()
    want = {r["feature"]: tuple(r[1:]) for r in plain}
    assert len(codes) == 2 and all(tuple(r[1:]) == pytest.approx(want[r["feature"]]) for r in codes)
    assert all(r["mean_absolute_impact"] > 0 for r in codes)


def test_pdp_of_a_linear_model_expands_one_number(rows):
    scorer = explain.LinearScorer(1.0, {"a": 2.0, "b": -1.0, "c": 0.5}, {"t": {"x": 3.0}}, F.expm1)
    df = rows.selectExpr("k", "a / 10 AS a", "b / 10 AS b", "a / 7 AS c", "IF(k % 3 = 0, 'x', NULL) AS t")
    grid = [0.0, 0.5, 1.0]
    fast = explain.pdp_curve(df, scorer, ["a", "b"], grid)
    slow = explain.pdp_curve(df, lambda c: scorer(c), ["a", "b"], grid)
    want = {r["point"]: r["prediction"] for r in slow.collect()}
    assert {r["point"]: pytest.approx(r["prediction"]) for r in fast.collect()} == want and len(want) == 3
    generate = [line for line in fast._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line]
    assert len(generate) == 1
    assert sum("element_at" in line for line in fast._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1


def test_logistic_input_is_not_cached_twice(rows, monkeypatch):
    cached = []
    fit = LogisticRegression.fit
    monkeypatch.setattr(LogisticRegression, "fit", lambda self, df: cached.append(df.storageLevel.useMemory) or fit(self, df))
    ready = rows.select(array_to_vector(F.array("a", "b")).alias("features"), (F.col("a") > F.col("b")).cast("double").alias("label"))
    model = M._cached_fit(LogisticRegression(maxIter=5), ready)
    assert cached == [False] and model.numFeatures == 2


def test_quantile_keys_take_one_logarithm(rows):
    plan = quantiles._values(rows, ["a", "b"], [], [0, 1])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("log2(") == 1


def test_feature_stores_gather_their_rows_once(spark, tmp_path, monkeypatch):
    hints = []
    columns = sorted({c for drops in S.OBJECTIVE_DROPS.values() for c in drops} - {S.ID_COLUMN, "quarter"})
    df = spark.range(40).selectExpr(f"id AS {S.ID_COLUMN}", "IF(id % 5 = 0, NULL, concat('1999Q', id % 4 + 1)) AS quarter", "id AS kept", *[f"id AS `{c}`" for c in columns])
    hint = type(df).hint
    monkeypatch.setattr(type(df), "hint", lambda self, *a: hints.append(a) or hint(self, *a))
    store.write_feature_store(df, str(tmp_path), "v1", "m.parquet")
    assert hints == [("rebalance", "quarter")]
    for objective, drops in S.OBJECTIVE_DROPS.items():
        got = spark.read.parquet(f"{tmp_path}/v1/{objective}/feature_store.parquet")
        assert set(got.columns) == set(df.columns) - set(drops) - {S.ID_COLUMN}
        assert sorted(r["kept"] for r in got.select("kept").collect()) == list(range(40))

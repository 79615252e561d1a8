"""What lets boosted models be fitted and explained in time: the same results from fewer jobs and fewer steps."""

import threading

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from creditloom import runtime
from creditloom.models import boosting as B
from creditloom.operators import explain


def table(spark, rows=600):
    df = spark.range(rows).selectExpr(
        "id", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 7 % 3 AS DOUBLE) AS b", "CAST(id * 11 % 5 AS DOUBLE) AS c",
        "1D AS same", "CAST(id * 53 % 89 / 7 AS DOUBLE) AS d", "CAST(id % 2 AS DOUBLE) AS e", "id % 4 = 0 AS v",
    )
    x = F.array("a", "b", "c", "same", "d", "e")
    return df.select("id", array_to_vector(x).alias("features"), F.expr("CAST(a * (b + 1) + d * e + c AS DOUBLE)").alias("label"), "v")


def test_all_rounds_of_a_small_table_are_one_job(spark):
    df = table(spark).cache()
    df.count()
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        model = B.Boosting(rounds=40, depth=4, patience=30).fit(df, validation="v")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fit")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.curve) > 30 and len(jobs) <= 10


@pytest.mark.parametrize("loss", ["squared", "logistic", "softmax"])
def test_one_task_and_jobs_by_level_make_the_same_model(spark, monkeypatch, loss):
    label = {"squared": "label", "logistic": "CAST(label > 90 AS DOUBLE)", "softmax": "CAST(id % 3 AS DOUBLE) + 0 * label"}[loss]
    df = table(spark).withColumn("label", F.expr(label))
    settings = B.Boosting(loss, rounds=5, depth=5, rate=0.3, classes=3, patience=50)
    weight = None if loss == "squared" else F.col("id") % 2 + 1.0
    here = settings.fit(df, weight=weight, validation="v")
    monkeypatch.setattr(B, "_TASK_ROWS", 100)
    # sums that all come back, that all meet in a shuffle, and that come back at the first levels only
    for most in (1 << 30, 0, 4 * 2 * 6 * 64 * 16 * (3 if loss == "softmax" else 1)):
        monkeypatch.setattr(B, "_AT_ONCE", most)
        there = settings.fit(df, weight=weight, validation="v")
        assert [e.tolist() for e in there.edges] == [e.tolist() for e in here.edges] and len(there.edges[3]) <= 1
        assert there.curve == pytest.approx(here.curve, rel=1e-9) and len(there.rounds) == len(here.rounds) > 0
        assert there.importances == pytest.approx(here.importances, rel=1e-9)


def test_cells_add_up_to_the_bins_of_each_feature():
    rng = np.random.default_rng(5)
    sizes = [3, 1, 64, 2, 7, 30]
    x = np.stack([rng.integers(0, n, 5000) for n in sizes]).astype(np.uint8)
    slot, g = rng.integers(0, 4, 5000), rng.normal(size=5000)
    for rows, groups in ((100, 3), (1 << 20, 2)):
        cells = B._Cells(sizes, rows, 64)
        assert len(cells.groups) <= groups and sum(map(len, cells.groups)) == 5
        got = cells.features(cells.sums(cells.of(x), slot, 4, [g, None]))
        for f in range(6):
            for s in range(4):
                np.testing.assert_allclose(got[s, f, :, 0], np.bincount(x[f][slot == s], g[slot == s], 64), atol=1e-9)
                np.testing.assert_array_equal(got[s, f, :, 1], np.bincount(x[f][slot == s], minlength=64))


def test_edges_are_the_exact_quantiles(spark):
    values = np.array([3.0, -1.5, 0.25, 8.0, 8.0, 1e300, -7.0, 0.1, 2.2, 5.5, 4.0])
    df = spark.createDataFrame([(float(v),) for v in values], "f double")
    want = {q.value for q in B.exact_quantiles(df, ["f"], [i / 16 for i in range(1, 16)])}
    assert B._edges(values, 16).tolist() == sorted(want)


def grown(spark, loss="squared"):
    df = table(spark).withColumn("label", F.col("label") if loss == "squared" else (F.col("label") > 90).cast("double"))
    return B.Boosting(loss, rounds=6, depth=5, rate=0.3).fit(df), df


def test_attribution_without_switched_versions(spark):
    model, df = grown(spark)
    names = list("abcsde")
    sample = df.where("id % 60 = 1").select(B.vector_to_array("features").alias("x"))
    some = df.where("id % 7 = 0")
    plain = explain.array_attribution(some, sample, model.binned_scores, names, ["id"], prepare=model.binned)
    fast = explain.array_attribution(some, sample, None, names, ["id"], prepare=model.binned, switched=model.switched)
    want = {(r["id"], r["feature"]): r["contribution"] for r in plain.collect()}
    got = {(r["id"], r["feature"]): r["contribution"] for r in fast.collect()}
    assert set(got) == set(want) and len(got) == 86 * 6 and len({round(v, 6) for v in got.values()}) > 100
    assert got == pytest.approx(want, abs=1e-9)
    assert explain.array_attribution(df.where("id < 0"), sample, None, names, ["id"], prepare=model.binned, switched=model.switched).count() == 0


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_impact_walks_only_trees_with_the_feature(spark, monkeypatch, loss):
    model, df = grown(spark, loss)
    rows = df.select("id", *[F.get(B.vector_to_array("features"), F.lit(i)).alias(c) for i, c in enumerate("abcsde")])

    def assemble(part):
        return part.withColumn("features", array_to_vector(F.array(*"abcsde")))

    encoded = (assemble, model.scores, list("abcsde"))
    plain, fast = (
        {r["feature"]: tuple(r[1:]) for r in explain.model_permutation_impact(rows, None, "p", list("esa"), ["id"], encoded=encoded, changes=c).collect()}
        for c in (None, model.changes)
    )
    assert set(fast) == set("esa") and fast["s"] == (0.0, 0.0) and fast["a"][0] > 0
    assert all(fast[c] == pytest.approx(plain[c], abs=1e-12) for c in "esa")


def test_jobs_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=60)

    def job(n):
        both.wait()
        assert SparkSession.getActiveSession() is not None
        return spark.range(n).count()

    assert runtime.side_by_side(spark, [lambda: job(3), lambda: job(5)]) == [3, 5]
    order = []
    assert runtime.side_by_side(spark, [lambda: order.append(1), lambda: order.append(2)], at_once=False) == [None, None] and order == [1, 2]

    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        runtime.side_by_side(spark, [fails, lambda: 1])


@pytest.mark.parametrize("rows", [10, 1_000_000])
def test_of_equal_splits_the_first_feature_takes_all(spark, monkeypatch, rows):
    """The same rows lie on the two sides of both features' cuts, so only rounding could tell them apart."""
    monkeypatch.setattr(B, "_TASK_ROWS", rows)
    df = spark.range(900).selectExpr("id", "CAST(id * 37 % 101 AS DOUBLE) / 7 AS a", "IF(id % 37 = 0, 2D, 1D) AS b", "IF(id % 37 = 0, 1D, 7D) AS c")
    df = df.select("id", array_to_vector(F.array("a", "b", "c")).alias("features"), F.expr("sin(a) + 3 * b + cos(id) / 3 AS label"))
    model = B.Boosting(rounds=12, depth=4).fit(df)
    assert model.importances[1] > 0 and model.importances[2] == 0

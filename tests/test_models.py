import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.models import persistence
from creditloom.models import training as M
from creditloom.operators import explain


def lending(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({c: rng.integers(1, 60, n).astype(float) for c in S.LENDING_NUMERIC})
    for c in S.LENDING_CATEGORICAL:
        pdf[c] = rng.choice(["A", "B", "C"], n)
    pdf["id"] = range(n)
    pdf["target"] = 11 + 0.01 * pdf.credit_score - 0.02 * pdf.dti + (pdf.channel == "A") * 0.5 + rng.normal(0, 0.05, n)
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("dti", F.when(F.col("id") % 17 != 0, F.col("dti")))


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(2, 3, (300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 7 + rng.normal(0, 1, 300)
    rows = [(list(map(float, a)), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a array<double>, target double").select(array_to_vector("a").alias("features"), "target")
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ yc)
    model = M.ridge(df, 10.0)
    assert np.allclose(model.coefficients.toArray(), want, atol=1e-9)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_logistic_is_at_the_weighted_optimum(spark):
    rng = np.random.default_rng(6)
    n = 500
    pdf = pd.DataFrame({"x": rng.normal(0, 1, n), "c": rng.choice(["A", "B"], n), "quarter": "q", "year": 1, "quarter_num": 1})
    pdf["stress_flag"] = (rng.random(n) < 1 / (1 + np.exp(2 - pdf.x))).astype("int32")
    bundle = M.train_stress_logistic(spark.createDataFrame(pdf), max_iter=200)
    assert bundle.preprocessor.feature_names == ["x", "c__A", "c__B"]
    z = np.column_stack([(pdf.x - pdf.x.mean()) / pdf.x.std(ddof=0), pdf.c == "A", pdf.c == "B"]).astype(float)
    w, b = bundle.model.coefficients.toArray(), bundle.model.intercept
    weight = np.where(pdf.stress_flag == 1, n / (2 * pdf.stress_flag.sum()), n / (2 * (n - pdf.stress_flag.sum())))
    slope = z.T @ (weight * (1 / (1 + np.exp(-z @ w - b)) - pdf.stress_flag)) + w
    assert np.abs(slope).max() < 0.05


def test_linear_bundle_scorer_attribution_and_drivers(spark):
    _, df = lending(spark)
    bundle = M.train_linear_regressor(df)
    scorer, frame = bundle.linear_scorer(), bundle.filled(df)
    direct = {r["id"]: r["prediction"] for r in bundle.predict(df).collect()}
    columns = {c: F.col(c) for c in S.LENDING_FEATURES}
    for r in frame.select("id", scorer(columns).alias("p")).collect():
        assert r["p"] == pytest.approx(direct[r["id"]])
    background = frame.where("id < 50")
    base = frame.where("id < 50").agg(F.avg(scorer(columns))).first()[0]
    sums = explain.linear_attribution(frame, scorer, background, ["id"]).groupBy("id").agg(F.sum("contribution").alias("s"))
    for r in sums.collect():
        assert r["s"] == pytest.approx(direct[r["id"]] - base)
    in_row = explain.linear_drivers(frame, scorer, background, ["id"]).collect()
    by_table = explain.attribution_rollup(explain.linear_attribution(frame, scorer, background, ["id"]), ["id"]).collect()
    assert {tuple(r) for r in in_row} == {tuple(r) for r in by_table} and len(in_row) == 5 * 400


def test_tree_bundle_attribution_is_additive(spark):
    _, df = lending(spark)
    bundle = M.train_tree_regressor(df, df.where("id < 80"), rounds=4, depth=3)
    importance = bundle.feature_importance().toPandas()
    assert importance.importance_pct.sum() == pytest.approx(100) and len(importance) == 20
    rows, background = df.where("id >= 390"), df.where("id < 6")
    parts = explain.sampled_attribution(rows, background, bundle.predict, "prediction", S.LENDING_FEATURES, ["id"])
    base = bundle.predict(background).agg(F.avg("prediction")).first()[0]
    sums = {r["id"]: r["s"] for r in parts.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for r in bundle.predict(rows).collect():
        assert sums[r["id"]] == pytest.approx(r["prediction"] - base)
    with pytest.raises(ValueError):
        explain.sampled_attribution(rows, df, bundle.predict, "prediction", S.LENDING_FEATURES, ["id"])
    # inside the row: the same contributions, and additive to the last digits with a background of 100
    inside = {(r["id"], r["feature"]): r["contribution"] for r in bundle.attribution(rows, background, ["id"]).collect()}
    for r in parts.collect():
        assert inside[r["id"], r["feature"]] == pytest.approx(r["contribution"], abs=1e-12)
    background = df.where("id < 100")
    base = bundle.predict(background).agg(F.avg("prediction")).first()[0]
    sums = {r["id"]: r["s"] for r in bundle.attribution(rows, background, ["id"]).groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    for r in bundle.predict(rows).collect():
        assert abs(sums[r["id"]] - (r["prediction"] - base)) < 1e-9
    with pytest.raises(ValueError):
        bundle.attribution(rows, df, ["id"])


def test_permutation_impact_of_model_and_scorer_agree(spark):
    _, df = lending(spark)
    bundle = M.train_linear_regressor(df)
    frame = bundle.filled(df)
    by_model = explain.model_permutation_impact(frame, bundle.predict, "prediction", S.LENDING_FEATURES, ["id"])
    by_scorer = explain.permutation_impact(frame, {("m", "t"): bundle.linear_scorer()}, S.LENDING_FEATURES, ["id"])
    want = {r["feature"]: r["mean_absolute_impact"] for r in by_model.collect()}
    for r in by_scorer.collect():
        assert r["mean_absolute_impact"] == pytest.approx(want[r["feature"]])


def test_pdp_of_model_and_scorer_agree(spark):
    _, df = lending(spark, 100)
    bundle = M.train_linear_regressor(df)
    frame, grid = bundle.filled(df), explain.linear_grid(20, 100, 5)
    a = explain.pdp_curve(frame, bundle.linear_scorer(), ["ltv", "cltv"], grid).orderBy("point").collect()
    b = explain.pdp_curve(frame, bundle.predict, ["ltv", "cltv"], grid, prediction="prediction").orderBy("point").collect()
    assert [r["value"] for r in a] == [20, 40, 60, 80, 100]
    for x, y in zip(a, b):
        assert x["prediction"] == pytest.approx(y["prediction"])


def test_term_models_and_batch_scoring(spark):
    _, df = lending(spark)
    terms = df.withColumn("target", F.when(F.col("channel") == "A", 180).when(F.col("channel") == "B", 360).otherwise(240))
    forest, linear = M.train_term_forest(terms, trees=5, depth=4), M.train_term_linear(terms, max_iter=50)
    for bundle in (forest, linear):
        hit = bundle.predict(terms).agg(F.avg((F.col("target") == F.col("prediction")).cast("int"))).first()[0]
        assert hit > 0.9
    amount = M.train_linear_regressor(df)
    out = M.score_applications(df.drop("target"), ["id"], amount, linear, amount).toPandas()
    assert len(out) == 400 and set(out.estimated_loan_term_months) == {180, 240, 360}
    assert (out.estimated_loan_amount % 1000 == 0).all() and out.estimated_interest_rate.between(0, 20).all()


def test_boosted_terms_beat_the_forest(spark):
    """The term depends on the product of two numbers, which shallow averaged trees cannot follow."""
    _, df = lending(spark, 1200, seed=5)
    score = (F.col("credit_score") - 30) * (F.coalesce(F.col("dti"), F.lit(30.0)) - 30)
    terms = df.withColumn("target", F.when(score < -150, 180).when(score < 150, 240).otherwise(360))
    train, test = terms.where("id % 3 > 0"), terms.where("id % 3 = 0")
    hits = {}
    for name, bundle in {"boosted": M.train_term_boosting(train, None, 40, 4), "forest": M.train_term_forest(train, 40, 4)}.items():
        scored = bundle.predict(test)
        hits[name] = scored.agg(F.avg((F.col("target") == F.col("prediction")).cast("int"))).first()[0]
        if name == "boosted":
            chances = bundle.model.transform(bundle.preprocessor.assemble(test)).select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)).collect()
            assert all(r[0] == pytest.approx(1.0) for r in chances)
    assert hits["boosted"] > hits["forest"] + 0.05 and hits["boosted"] > 0.8
    # a validation row of an unknown term does not disturb
    odd = test.withColumn("target", F.when(F.col("id") == 0, 99).otherwise(F.col("target")))
    assert M.train_term_boosting(train, odd, 3, 2, patience=2).terms == [180, 240, 360]


def test_saved_models_score_the_same(spark, tmp_path):
    _, df = lending(spark, 300)
    train, valid = df.where("id < 200"), df.where("id >= 200")
    terms = df.withColumn("target", F.when(F.col("channel") == "A", 15).when(F.col("channel") == "B", 30).otherwise(99))
    months = df.withColumn("target", F.when(F.col("channel") == "A", 180).otherwise(360))
    stacked = M.train_stacked(train, valid, ["id"], rounds=4, depth=3, learning_rate=0.3, patience=(3, None))
    linear, tree = M.train_linear_regressor(df), M.train_tree_regressor(train, valid, 4, 3, patience=2)
    sets = {
        "v4_stacked": M.ModelSet(stacked, M.train_term_boosting(terms, None, 4, 3), tree), "v4_catboost": M.ModelSet(tree, M.train_term_boosting(terms, None, 4, 3), tree),
        "smart_tree": M.ModelSet(tree, M.train_term_forest(months, 5, 3), linear), "fast_linear": M.ModelSet(linear, M.train_term_linear(months, 30), linear),
    }
    chosen = df.drop("target").withColumn("model_selection", F.get(F.array(*[F.lit(c) for c in S.MODEL_CHOICES], F.lit(None)), (F.col("id") % 5).cast("int")))
    before = M.score_by_choice(chosen, ["id"], sets).collect()
    for name, models in sets.items():
        persistence.save_model_set(models, f"{tmp_path}/{name}")
    again = {name: persistence.load_model_set(spark, f"{tmp_path}/{name}") for name in sets}
    after = M.score_by_choice(chosen, ["id"], again).collect()
    assert sorted(before) == sorted(after) and len(after) == 300
    picked = {r["id"]: r["model_selection"] for r in after}
    assert all(picked[i] == [*S.MODEL_CHOICES, S.MODEL_CHOICES[0]][i % 5] for i in range(300))
    by_hand = M.score_applications(df.where("id % 5 = 3").drop("target"), ["id"], linear, sets["fast_linear"].term, linear).collect()
    got = {r["id"]: r["estimated_loan_amount"] for r in after}
    assert all(got[r["id"]] == r["estimated_loan_amount"] for r in by_hand)
    assert {r["estimated_loan_term_months"] for r in after} <= {180, 360}  # classes are written as months
    with pytest.raises(ValueError, match="no models"):
        M.score_by_choice(chosen.withColumn("model_selection", F.lit("other")), ["id"], sets)


def test_stacked_model_beats_the_mean(spark):
    _, df = lending(spark, 600)
    train, valid, test = df.where("id < 400"), df.where("id >= 400 and id < 500"), df.where("id >= 500")
    bundle = M.train_stacked(train, valid, ["id"], rounds=5, depth=3, learning_rate=0.3)
    out = bundle.predict(test).toPandas()
    assert len(out) == 100
    assert ((out.target - out.prediction) ** 2).mean() < 0.7 * out.target.var(ddof=0)

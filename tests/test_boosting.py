import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from creditloom.models import boosting as B


def frame(spark, x, y, valid=None):
    pdf = pd.DataFrame({"id": np.arange(len(y)), "a": [list(map(float, r)) for r in x], "label": np.asarray(y, float), "v": np.zeros(len(y), bool) if valid is None else valid})
    return spark.createDataFrame(pdf).select("id", array_to_vector(F.col("a").cast("array<double>")).alias("features"), "label", "v")


def plain(x, y, loss, rounds, depth, rate, edges, base, classes=1, l2=1.0):
    """The same boosting in a few lines, one node after another."""
    bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    margin = np.tile(base, (len(y), 1))
    for _ in range(rounds):
        g, h = B._derivatives(loss, margin, y)
        for k in range(margin.shape[1]):

            def grow(rows, level):
                value = -rate * g[rows, k].sum() / (h[rows, k].sum() + l2)
                best = (1e-9, None)
                for f in range(x.shape[1]):
                    for b in range(len(edges[f])):
                        left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                        if level and h[left, k].sum() >= 1 and h[right, k].sum() >= 1:
                            worth = lambda r: g[r, k].sum() ** 2 / (h[r, k].sum() + l2)
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, (left, right))
                if best[1] is None:
                    # a root that cannot be split is no tree
                    margin[rows, k] += value if level < depth else 0.0
                else:
                    for part in best[1]:
                        grow(part, level - 1)

            grow(np.arange(len(y)), depth)
    return margin


@pytest.mark.parametrize("loss, rows", [("squared", 100), ("squared", 20_000), ("logistic", 20_000), ("softmax", 100)])
def test_equals_plain_boosting(spark, monkeypatch, loss, rows):
    """In several tasks, a job for each level, and in one."""
    monkeypatch.setattr(B, "_TASK_ROWS", rows)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (300, 3)), 1)
    z = x[:, 0] + (x[:, 1] > 0.3) * 2 + rng.normal(0, 0.3, 300)
    y = {"squared": z, "logistic": (z > 1).astype(float), "softmax": np.digitize(z, [0, 1]).astype(float)}[loss]
    model = B.Boosting(loss, rounds=10, depth=3, rate=0.3, bins=16, classes=3).fit(frame(spark, x, y).repartition(3))
    assert len(model.rounds) == 10 and model.curve == []
    want = plain(x, y, loss, 10, 3, 0.3, model.edges, model.base)
    margin = B._add(np.tile(model.base, (len(x), 1)), model.rounds, B._binned(x, model.edges))
    np.testing.assert_allclose(margin, want, atol=1e-8)
    p = model.scores(x)
    if loss != "squared":
        np.testing.assert_allclose(p.sum(axis=1), 1.0)
    out = model.transform(frame(spark, x, y)).toPandas().sort_values("id")
    np.testing.assert_allclose(out.prediction, p[:, 0] if loss == "squared" else p.argmax(axis=1))
    again = B.BoostedModel.from_json(model.to_json())
    assert (again.scores(x) == p).all() and (again.importances == model.importances).all()


def test_patience_keeps_the_best_prefix(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (1200, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.7, 1200)
    valid = np.arange(1200) >= 800
    model = B.Boosting("squared", rounds=500, depth=5, rate=0.3, patience=8).fit(frame(spark, x, y, valid), validation="v")
    best = int(np.argmax(model.curve))
    assert len(model.rounds) == best and 3 < best < 100 and len(model.curve) == best + 9
    # the curve is what the prefixes score, and training rows alone made the trees
    for n in (0, 1, best):
        prefix = B.BoostedModel(model.loss, model.base, model.edges, model.rounds[:n], model.importances)
        assert -np.mean((prefix.scores(x[valid])[:, 0] - y[valid]) ** 2) == pytest.approx(model.curve[n])
    other = np.where(valid, 100.0, y)
    assert B.Boosting("squared", rounds=3, depth=5, rate=0.3).fit(frame(spark, x, other, valid), validation="v").base == model.base
    assert model.importances[:2].sum() > 0.8 * model.importances.sum()


def test_auc_curve_and_weights(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 3))
    y = (rng.random(900) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    valid = np.arange(900) % 3 == 0
    weight = F.when(F.col("label") == 1, 3.0).otherwise(1.0)
    model = B.Boosting("logistic", rounds=40, depth=3, patience=5, metric="auc").fit(frame(spark, x, y, valid), weight=weight, validation="v")
    p, t = model.scores(x[valid])[:, 1], y[valid]
    pairs = (p[t == 1][:, None] > p[t == 0]).mean() + 0.5 * (p[t == 1][:, None] == p[t == 0]).mean()
    assert pairs == pytest.approx(max(model.curve), abs=2e-3) and pairs > 0.8
    assert model.base[0] == pytest.approx(np.log(3 * y[~valid].sum() / (1 - y[~valid]).sum()))


def test_constant_and_tiny_tables(spark):
    x = np.ones((20, 2))
    model = B.Boosting("squared", rounds=5).fit(frame(spark, x, np.arange(20.0)))
    assert model.rounds == [] and model.scores(x)[:, 0] == pytest.approx(np.full(20, 9.5))
    assert model.transform(frame(spark, x, np.arange(20.0)).where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        B.Boosting().fit(frame(spark, x, np.arange(20.0)).where("id < 0"))


def test_tasks_follow_the_cores_not_the_files(spark, monkeypatch):
    """Jobs of milliseconds: no more tasks than cores, though the rows allow more, and no fewer because of few files."""
    monkeypatch.setattr(B, "_TASK_ROWS", 10)
    rng = np.random.default_rng(4)
    x, cores = rng.normal(0, 1, (600, 2)), spark.sparkContext.defaultParallelism
    valid = np.arange(600) % 5 == 0
    rows = frame(spark, x, x[:, 0], valid).selectExpr("id", "features", "label AS y", "1D AS w", "v").coalesce(1)
    rows = rows.select(B.vector_to_array("features").alias("x"), "y", "w", "v")
    edges = [np.array([-0.5, 0.0, 0.5])] * 2
    blocks = B.Boosting()._blocks(rows, edges, np.zeros(1))
    assert blocks.getNumPartitions() == min(60, cores)
    got = blocks.collect()
    assert sum(len(b[1]) for b in got if b[3]) == valid.sum() and sum(len(b[1]) for b in got) == 600
    blocks.unpersist()
    # sums that come back directly and sums that meet in a shuffle make the same trees
    fitted = []
    for most in (1 << 30, 0):
        monkeypatch.setattr(B, "_AT_ONCE", most)
        fitted.append(B.Boosting(rounds=4, depth=6, patience=9).fit(frame(spark, x, x[:, 0] * x[:, 1], valid), validation="v"))
    np.testing.assert_allclose(fitted[0].scores(x), fitted[1].scores(x), atol=1e-9)

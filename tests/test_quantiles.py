import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.operators.quantiles import exact_quantiles, moments, ordered_bits, quantile_table

PROBS = [0.0, 0.05, 0.2, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0]


def frame(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "c"], n, p=[0.34, 0.65, 0.01]),
            "smooth": rng.lognormal(0, 2, n),
            # a third of all rows share one value
            "hot": np.where(rng.random(n) < 0.34, 7.0, rng.normal(7, 3, n)),
            "whole": rng.integers(0, 12, n).astype(float),
            "gaps": np.where(rng.random(n) < 0.2, np.nan, rng.random(n)),
        }
    )
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("gaps", F.nanvl("gaps", F.lit(None).cast("double")))


@pytest.mark.parametrize("n", [1, 2, 7, 400, 60_000])
def test_matches_numpy(spark, n):
    pdf, df = frame(spark, n)
    columns = ["smooth", "hot", "whole", "gaps"]
    for q in exact_quantiles(df, columns, PROBS):
        values = pdf[q.column].dropna()
        assert q.n == len(values)
        if len(values) == 0:
            assert q.value is None
        else:
            assert q.value == pytest.approx(values.quantile(q.prob), rel=1e-12, abs=1e-12)


def test_matches_numpy_by_group(spark):
    pdf, df = frame(spark, 60_000)
    got = quantile_table(df.repartition(7), ["smooth", "hot"], PROBS, by=["g"]).collect()
    assert len(got) == 3 * 2 * len(PROBS)
    for q in got:
        want = pdf.loc[pdf.g == q.g, q.column].quantile(q.prob)
        assert q.value == pytest.approx(want, rel=1e-12)


def test_order_of_bits(spark):
    """Every power of two with its neighbours, random patterns, subnormal and infinite numbers."""
    rng = np.random.default_rng(0)
    powers = 2.0 ** np.arange(-1022, 1024)
    with np.errstate(all="ignore"):
        v = np.concatenate([powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), rng.integers(0, 2**63 - 1, 5000).view(np.float64), [0.0, 5e-324, 1e-310, np.inf]])
    v = v[~np.isnan(v)]
    v = np.concatenate([v, -v])
    rows = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(v)), "v": v})).select("i", F.expr(ordered_bits("v")).alias("k"))
    got = rows.toPandas().sort_values("i").k.to_numpy()
    pattern = v.view(np.int64) & 0x7FFFFFFFFFFFFFFF
    assert (got == np.where(v < 0, -1 - pattern, pattern)).all()
    top = spark.sql(f"SELECT {ordered_bits('v')} AS k FROM VALUES (double('NaN')), (double('infinity')), (-0D), (0D) AS t(v)").collect()
    assert top[0].k > top[1].k and top[2].k == top[3].k == 0


def test_values_that_share_most_bits(spark):
    """Neighbouring doubles need every pass; both signs, extremes and equal neighbours of infinity."""
    near = [1.0 + i * 2.0**-52 for i in range(50)] + [-1.0 - i * 2.0**-50 for i in range(30)]
    df = spark.createDataFrame([(x,) for x in near], "v double")
    for q in exact_quantiles(df, ["v"], [0.1, 0.37, 0.5, 0.9]):
        assert q.value == np.quantile(near, q.prob)
    far = spark.createDataFrame([(float("-inf"),), (float("-inf"),), (0.0,), (-0.0,), (float("inf"),), (float("inf"),)], "v double")
    assert [q.value for q in exact_quantiles(far, ["v"], [0.0, 0.2, 0.5, 1.0])] == [float("-inf"), float("-inf"), 0.0, float("inf")]


def test_many_groups(spark):
    """20,000 groups, one of which holds a third of the rows."""
    rng = np.random.default_rng(4)
    n = 60_000
    pdf = pd.DataFrame({"g": np.where(rng.random(n) < 0.33, -1, rng.integers(0, 20_000, n)), "v": rng.normal(0, 100, n)})
    got = quantile_table(spark.createDataFrame(pdf), ["v"], [0.25, 0.5], by=["g"]).toPandas()
    want = pdf.groupby("g").v.quantile([0.25, 0.5])
    assert pdf.g.nunique() > 17_000 and len(got) == len(want)
    got = got.set_index(["g", "prob"]).value.sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.sort_index().to_numpy(), rtol=1e-12)


def test_null_group_and_empty_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0), (None, 1, 3.0), ("x", 2, None), ("y", None, 5.0)], "g string, h int, v double")
    got = {(r.g, r.h): r.value for r in quantile_table(df, ["v"], [0.5], by=["g", "h"]).collect()}
    assert got == {(None, 1): 2.0, ("y", None): 5.0}
    sums = {(r.g.g, r.g.h): (r.n, r.mean, r.low, r.high) for r in moments(df, ["v"], ["g", "h"]).collect()}
    assert sums == {(None, 1): (2, 2.0, 1.0, 3.0), ("x", 2): (0, None, None, None), ("y", None): (1, 5.0, 5.0, 5.0)}
    assert exact_quantiles(df.where("v > 9"), ["v"], [0.5]) == [("v", 0.5, None, 0)]

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from creditloom.functions.rules import row_hash
from creditloom.operators import ranking


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1001])
def test_split_sizes_are_exact(spark, n):
    out = ranking.hash_split(spark.range(n), ["id"]).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in out}
    holdout = math.ceil(n * 0.2)
    test = math.ceil(holdout * 0.5)
    want = {"train": n - holdout, "valid": holdout - test, "test": test}
    assert sizes == {k: v for k, v in want.items() if v}


def test_split_is_reproducible_and_seeded(spark):
    a = {r["id"]: r["split"] for r in ranking.hash_split(spark.range(300).repartition(5), ["id"]).collect()}
    b = {r["id"]: r["split"] for r in ranking.hash_split(spark.range(300).coalesce(1), ["id"]).collect()}
    c = {r["id"]: r["split"] for r in ranking.hash_split(spark.range(300), ["id"], seed=7).collect()}
    assert a == b and a != c


def test_cutoffs_equal_sorted_order(spark):
    df = spark.range(5000).select(row_hash(["id"]).alias("h"))
    ordered = sorted(r["h"] for r in df.collect())
    for k, cut in zip([1, 2, 777, 4999, 5000], ranking.hash_cutoffs(df, F.col("h"), [1, 2, 777, 4999, 5000])):
        assert sum(h <= cut for h in ordered) == k


def test_sample_cap(spark):
    df = spark.range(500)
    assert ranking.sample_cap(df, ["id"], None).count() == 500
    assert ranking.sample_cap(df, ["id"], 500).count() == 500
    assert ranking.sample_cap(df, ["id"], 123).count() == 123
    assert ranking.sample_cap(df, ["id"], 0).count() == 0
    with pytest.raises(ValueError, match="unique"):
        ranking.sample_cap(df.withColumn("k", F.lit(1)), ["k"], 10)


@pytest.mark.parametrize("n, parts", [(0, 4), (1, 4), (2, 4), (3, 1), (11, 40), (777, 3), (5000, 7)])
def test_permutation_is_one_circle(spark, n, parts):
    """Equals a rotation of the whole table, however many ranges it falls into and however few rows these have."""
    df = spark.range(n).select("id", (F.col("id") * 3).alias("a"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("b"), F.col("id").cast("string").alias("c"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranking.permute_columns(df, ["a", "b", "c"], ["id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    circle = [r[0] for r in df.select("id", row_hash(["id"]).alias("h")).orderBy("h").collect()]
    place = {x: i for i, x in enumerate(circle)}
    assert len(out) == n
    for r in out:
        one, two, three = (circle[(place[r.id] + i) % n] for i in (1, 2, 3))
        assert (r.a, r.c) == (r.id * 3, str(r.id))
        assert (r.a__permuted, r.b__permuted, r.c__permuted) == (one * 3, two if two % 3 else None, str(three))


def test_running_totals(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"v": rng.permutation(3000) / 7.0, "w": rng.integers(0, 9, 3000)})
    out = ranking.running_totals(spark.createDataFrame(pdf), ["v"], ["w"]).toPandas().sort_values("v")
    want = pdf.sort_values("v").w.cumsum().shift(fill_value=0).to_numpy()
    assert (out.w_before.to_numpy() == want).all()


def test_temporal_split_drops_other_periods(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "quarter string")
    out = {r["quarter"]: r["split"] for r in ranking.temporal_split(df, ["a"], ["b"], ["c"]).collect()}
    assert out == {"a": "train", "b": "valid", "c": "test"}

"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.functions.rules import present
from creditloom.runtime import ident, quoted, to_long


def reconcile_keys(left: DataFrame, right: DataFrame, key: str = S.ID_COLUMN) -> DataFrame:
    """Distinct key counts of both tables, the keys found on one side only, and whether they agree.

    One shuffle: distinct keys of both sides are tagged and regrouped by key.
    """
    tagged = (
        left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r"))
        .unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        .where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("l").alias("l"), F.max("r").alias("r"))
    )
    return tagged.agg(
        F.count_if(F.col("l") == 1).alias("left_keys"),
        F.count_if(F.col("r") == 1).alias("right_keys"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("left_only"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("right_only"),
    ).withColumn("counts_match", F.col("left_keys") == F.col("right_keys"))


def require_same_keys(left: DataFrame, right: DataFrame, key: str = S.ID_COLUMN, strict: bool = False) -> None:
    """Fail unless both tables have as many distinct keys (``strict``: the same keys)."""
    row = reconcile_keys(left, right, key).first()
    if not row["counts_match"] or (strict and row["left_only"] + row["right_only"]):
        raise ValueError(f"loan mismatch, the two tables hold different loans: {row.asDict()}")


def unseen_categories(train: DataFrame, others: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Category values of each other split that ``train`` does not have, per column: one shuffle of distinct values."""

    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    tagged = train.select(F.lit(None).cast("string").alias("split"), F.inline(pairs))
    for name, df in others.items():
        tagged = tagged.unionByName(df.select(F.lit(name).alias("split"), F.inline(pairs)))
    values = tagged.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.max(F.col("split").isNull()).alias("known"), F.collect_set("split").alias("splits")  # as many as there are splits
    )
    return values.where(~F.col("known")).select(F.explode("splits").alias("split"), "column", "value")


def validate_master(df: DataFrame, required: list[str] = S.MASTER_REQUIRED) -> DataFrame:
    """Fail on missing columns or an empty table; otherwise hand the frame on."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the master table lacks {missing}")
    if df.isEmpty():
        raise ValueError("the master table is empty")
    return df


def domain_check(df: DataFrame, allowed: dict[str, list]) -> DataFrame:
    """Values outside the allowed set of each indicator column, with their row counts."""
    pairs = F.array(
        *[
            F.when(
                F.col(c).isNotNull() & ~F.col(c).cast("string").isin([str(v) for v in values]),
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")),
            )
            for c, values in allowed.items()
        ]
    )
    return (
        df.select(F.inline(F.array_compact(pairs))).groupBy("column", "value").agg(F.count("*").alias("rows"))
    )


def _corr(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation, null where a side has no spread."""
    a, b = a.cast("double"), b.cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def leakage_check(
    df: DataFrame, target: str, candidates: list[str] = S.LEAKAGE_CANDIDATES
) -> DataFrame:
    """Which suspect columns a store still holds, and how strongly each follows the target."""
    have = present(df, candidates)
    row = df.agg(F.count("*").alias("__n"), *[F.abs(_corr(F.col(c), F.col(target))).alias(c) for c in have])
    return to_long(
        row,
        [
            {
                "feature": quoted(c), "present": "true" if c in have else "false",
                "abs_corr": ident(c) if c in have else "CAST(NULL AS DOUBLE)",
            }
            for c in candidates
        ],
    )


def sentinel_census(df: DataFrame, sentinels: dict[str, int] = S.SENTINELS) -> DataFrame:
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c) == v).alias(c) for c, v in sentinels.items()])
    return to_long(
        row,
        [
            {
                "column": quoted(c), "sentinel_count": ident(c),
                "sentinel_pct": f"try_divide({ident(c)} * 100D, __n)",
            }
            for c in sentinels
        ],
    )


def code_census(df: DataFrame, columns: list[str], codes: list[int]) -> DataFrame:
    """How many values of each column are any of the codes, whichever column a code belongs to."""
    row = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isin(codes)).alias(c) for c in columns])
    records = [{"column": quoted(c), "code_count": ident(c), "code_pct": f"try_divide({ident(c)} * 100D, __n)"} for c in columns]
    return to_long(row, records)


def split_drift(df: DataFrame, target: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(target).alias("rate"))

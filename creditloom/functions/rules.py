"""Cleaning rules, flags, labels and ratios as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom import schemas as S


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, T.NumericType)]


def present(df: DataFrame, names: list[str]) -> list[str]:
    """The subset of ``names`` the frame actually has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def sentinels_to_null(df: DataFrame, sentinels: dict[str, int] | None = None) -> DataFrame:
    sentinels = S.SENTINELS if sentinels is None else sentinels
    return df.withColumns(
        {c: F.nullif(F.col(c), F.lit(v)) for c, v in sentinels.items() if c in df.columns}
    )


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; unlike least/greatest a null stays null."""
    if low is not None:
        column = F.when(column < low, F.lit(low)).otherwise(column)
    if high is not None:
        column = F.when(column > high, F.lit(high)).otherwise(column)
    return column


def number_or(column: Column, default: float) -> Column:
    """Numeric value of a text field, ``default`` where it does not parse."""
    return F.coalesce(column.try_cast("double"), F.lit(float(default)))


def capped_to_null(column: Column, ceiling: float = S.ESTIMATED_LTV_CEILING) -> Column:
    """Numeric value of a text field, null where it does not parse or exceeds ``ceiling``."""
    number = column.try_cast("double")
    return F.when(number <= ceiling, number)


def presence_flag(column: Column) -> Column:
    return column.isNotNull().cast("int")


def bssi(ever_ra: Column, max_delinquency: Column, modified: Column, assisted: Column) -> Column:
    """Stress ladder 0..3; the first matching rung wins, a null delinquency matches none."""
    return (
        F.when(ever_ra, 3)
        .when((max_delinquency >= 6) | modified, 2)
        .when(assisted | (max_delinquency >= 1), 1)
        .otherwise(0)
    )


def stress_flag(level: Column) -> Column:
    return (level > 0).cast("int")


def stress_level(level: Column) -> Column:
    return F.least(level, F.lit(2))


def serviceability_score() -> Column:
    """Absolute 0..100-style score; the LTV term is deliberately not clipped."""
    return (
        F.col("credit_score") / F.lit(850.0) * 40
        + (1 - clip(F.col("dti") / F.lit(60.0), high=1.0)) * 30
        + (1 - F.col("ltv") / F.lit(100.0)) * 20
        + F.col("num_borrowers") / F.lit(4.0) * 10
    )


def weighted_bss() -> Column:
    """Weighted sum of the normalised components; null as soon as one component is null."""
    terms = [F.lit(w) * F.col(f"{c}_norm") for c, (w, _) in S.BSS_COMPONENTS.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total * 100


def per_month_of_age(count: Column, age: Column) -> Column:
    """Ratio to loan age where an age of exactly zero counts as one month."""
    return count / F.when(age == 0, F.lit(1)).otherwise(age).cast("double")


def performance_ratios(df: DataFrame) -> DataFrame:
    age = F.col("loan_age_max")
    return df.withColumns(
        {
            "delinquency_intensity": per_month_of_age(F.col("months_delinquent"), age),
            "modification_intensity": per_month_of_age(F.col("modification_count"), age),
            "assistance_intensity": per_month_of_age(F.col("assistance_count"), age),
            "eltv_drift": F.col("estimated_ltv_avg") - F.col("ltv"),
        }
    )


def months_between_yyyymm(start: Column, end: Column) -> Column:
    def year(c: Column) -> Column:
        return F.floor(c / 100)

    return ((year(end) - year(start)) * 12 + (end % 100 - start % 100)).cast("int")


def interaction_features(df: DataFrame) -> DataFrame:
    """Null-as-zero products and ratios of the affordability columns."""
    zero = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("dti", "ltv", "credit_score")}
    return df.withColumns(
        {
            "dti_ltv_interaction": zero["dti"] * zero["ltv"],
            "credit_risk_multiplier": zero["credit_score"] / (zero["dti"] + 1.0),
        }
    )


def category_text(df: DataFrame, name: str) -> Column:
    """Category as text: missing becomes UNKNOWN, whole-number doubles lose their fraction."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        whole = column.cast("bigint")
        column = F.when(column == whole, whole.cast("string")).otherwise(column.cast("string"))
    return F.coalesce(column.cast("string"), F.lit(S.MISSING_CATEGORY))


def prepare_frame(
    df: DataFrame,
    numeric: list[str] = S.LENDING_NUMERIC,
    categorical: list[str] = S.LENDING_CATEGORICAL,
    keep: list[str] = (),
) -> DataFrame:
    """Model-ready columns: numbers as nullable doubles, categories as non-null text."""
    return df.select(
        *keep,
        *[F.col(c).try_cast("double").alias(c) for c in numeric],
        *[category_text(df, c).alias(c) for c in categorical],
    )


def quarter_columns(df: DataFrame, quarter: Column) -> DataFrame:
    """``quarter`` (such as 2018Q1) plus its year and quarter number."""
    return (
        df.withColumn("quarter", quarter)
        .withColumn("year", F.substring("quarter", 1, 4).cast("int"))
        .withColumn("quarter_num", F.right(F.col("quarter"), F.lit(1)).cast("int"))
    )


def row_hash(key: list[str], seed: int | str = 42) -> Column:
    """Stable pseudo-random order of rows: the same in every run, plan and engine."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))

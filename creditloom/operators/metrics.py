"""Evaluation metrics, each from one aggregation over the scored table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditloom.operators.ranking import running_totals
from creditloom.runtime import ident, quoted, to_long


def _ratio(a: Column, b: Column) -> Column:
    """a / b, zero where the denominator is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _r2(y: Column, prediction: Column) -> Column:
    # squared deviations from the mean in a numerically stable form
    spread = F.var_pop(y) * F.count(y)
    return 1 - F.try_divide(F.sum((y - prediction) * (y - prediction)), spread)


def _rmse(y: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((y - prediction) * (y - prediction)))


def _mape(y: Column, prediction: Column) -> Column:
    return F.avg(F.abs(F.try_divide(y - prediction, y))) * 100


def regression_metrics(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    t, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        _rmse(t, p).alias("rmse"), F.avg(F.abs(t - p)).alias("mae"),
        _mape(t, p).alias("mape_pct"), _r2(t, p).alias("r2"),
    )


def amount_metrics(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    """Dollar errors of a model trained on log amounts, plus R2 in log space."""
    t, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    dollars, guess = F.expm1(t), F.expm1(p)
    return df.groupBy(*by).agg(
        _rmse(dollars, guess).alias("rmse_dollars"),
        F.avg(F.abs(dollars - guess)).alias("mae_dollars"),
        _mape(dollars, guess).alias("mape_pct"),
        _r2(t, p).alias("r2_log"),
    )


def term_metrics(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    t, p = F.col(y).cast("int"), F.col(prediction).cast("int")
    return df.groupBy(*by).agg(
        F.avg((t == p).cast("int")).alias("accuracy"), F.avg(F.abs(t - p)).alias("mae_months")
    )


def rate_metrics(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    t, p = F.col(y).cast("double"), F.col(prediction).cast("double")
    return df.groupBy(*by).agg(
        _rmse(t, p).alias("rmse_rate"), F.avg(F.abs(t - p)).alias("mae_rate"), _r2(t, p).alias("r2")
    )


def binary_metrics(df: DataFrame, y: str, prediction: str, by: list[str] = ()) -> DataFrame:
    t, p = F.col(y) == 1, F.col(prediction) == 1
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(t == p).alias("hit"), F.count_if(t & p).alias("tp"),
        F.count_if(p).alias("called"), F.count_if(t).alias("actual"),
    )
    tp, called, actual = F.col("tp"), F.col("called"), F.col("actual")
    return counts.select(
        *by,
        _ratio(F.col("hit"), F.col("n")).alias("accuracy"),
        _ratio(tp, called).alias("precision"),
        _ratio(tp, actual).alias("recall"),
        _ratio(2 * tp, called + actual).alias("f1"),
    )


def roc_auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Exact area under the ROC curve; tied scores count half.

    Rows are counted per distinct score first, then each score needs the negatives below it.
    """
    counts = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    )
    ordered = running_totals(counts, ["score"], ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return ordered.agg(
        F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
    )


def confusion_matrix(df: DataFrame, y: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count("*").alias("rows")
    )


def classification_report(df: DataFrame, y: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    label = F.explode(
        F.array(
            F.struct(F.col(y).cast("string").alias("class"), F.lit(1).alias("actual"), F.lit(0).alias("called"), (F.col(y) == F.col(prediction)).cast("int").alias("hit")),
            F.struct(F.col(prediction).cast("string").alias("class"), F.lit(0).alias("actual"), F.lit(1).alias("called"), F.lit(0).alias("hit")),
        )
    )
    counts = df.select(label.alias("l")).groupBy("l.class").agg(
        F.sum("l.actual").alias("actual"), F.sum("l.called").alias("called"), F.sum("l.hit").alias("tp")
    )
    per_class = counts.select(
        "class",
        _ratio(F.col("tp"), F.col("called")).alias("precision"),
        _ratio(F.col("tp"), F.col("actual")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("called") + F.col("actual")).alias("f1"),
        F.col("actual").alias("support"),
        F.col("tp"),
    )
    scores = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = per_class.agg(
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.try_divide(F.sum(F.col(s) * F.col("support")), total).alias(f"weighted_{s}") for s in scores],
        F.try_divide(F.sum("tp").cast("double"), total).alias("accuracy"),
        total.alias("support"),
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(s) for s in scores], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{s}").alias(s) for s in scores], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{s}").alias(s) for s in scores], "support"),
    )
    return per_class.drop("tp").unionByName(summary.select(F.inline(rows)))


def metric_rows(df: DataFrame) -> DataFrame:
    """One-row metric table as (metric, value) rows."""
    return to_long(df, [{"metric": quoted(c), "value": f"CAST({ident(c)} AS DOUBLE)"} for c in df.columns])


def model_comparison(scored: list[tuple[dict[str, str], DataFrame]], y: str, prediction: str) -> DataFrame:
    """One row of regression metrics per scored frame, with the given describing columns."""
    parts = [
        regression_metrics(df, y, prediction).select(
            *[F.lit(v).alias(k) for k, v in about.items()], "rmse", "mae", "r2", "mape_pct"
        )
        for about, df in scored
    ]
    return reduce(DataFrame.unionByName, parts)


def best_by_metric(df: DataFrame, metric: str, tie: list[str], ascending: bool = True) -> DataFrame:
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(order, *tie).limit(1)

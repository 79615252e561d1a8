"""The batch run, stage by stage: raw files -> master -> stores and splits -> reports -> models -> comparison.

Every stage reads what the previous one wrote, so a run can be resumed at any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.functions import rules as R
from creditloom.models import training as M
from creditloom.models.boosting import one_task
from creditloom.models.persistence import save_bundle
from creditloom.operators import explain, loans, metrics, profile, quality, ranking
from creditloom.runtime import materialize, side_by_side
from creditloom.sources import feature_store as store
from creditloom.sources.raw_text import quarter_paths, read_origination, read_performance


def build_master(spark: SparkSession, raw_folder: str, quarters: list[str], out: str, check_keys: bool = True) -> DataFrame:
    """Read the quarters' raw files and write the master partitioned by quarter."""
    paths = quarter_paths(spark, raw_folder, quarters)
    origination = read_origination(spark, paths["origination"], with_quarter=True).drop("year", "quarter_num")
    performance = read_performance(spark, paths["performance"])
    master = quality.validate_master(loans.build_master(origination, performance, check_keys))
    store.write_table(master, out, ["quarter"])
    return spark.read.parquet(out)


def build_risk_stores(
    master: DataFrame, root: str, version: str, source: str, train: list[str], valid: list[str], test: list[str],
    description: str = "",
) -> dict:
    """Objective stores with manifest, and their temporal splits."""
    entry = store.write_feature_store(master, root, version, source, description)
    for objective in S.OBJECTIVE_TARGETS:
        stored = master.sparkSession.read.parquet(f"{root}/{version}/{objective}/feature_store.parquet")
        store.write_splits(ranking.temporal_split(stored, train, valid, test), f"{root}/{version}/{objective}")
    return entry


def build_lending_stores(master: DataFrame, root: str, version: str) -> None:
    store.write_lending_stores(master, root, version)


def diagnostics(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """All profile reports of one training frame."""
    numeric = R.numeric_columns(df)
    reports = {
        "dataset_summary": profile.dataset_summary(df),
        "missing_values": profile.missing_values(df),
        "numeric_summary": profile.numeric_summary(df),
        "categorical_cardinality": profile.cardinality(df),
        "target_distribution": profile.value_counts(df, target),
        "correlation_matrix": profile.correlation_matrix(df),
        "outlier_summary": profile.outlier_summary(df),
        "leakage_check": quality.leakage_check(df, target),
    }
    if target in numeric:
        reports["feature_relevance"] = profile.mutual_information(df, [c for c in numeric if c != target], target)
    return reports


def run_diagnostics(spark: SparkSession, root: str, version: str, report_root: str) -> None:
    for objective, target in S.OBJECTIVE_TARGETS.items():
        train = store.load_splits(spark, f"{root}/{version}/{objective}")["train"]
        for name, report in diagnostics(train, target).items():
            store.write_report(report, f"{report_root}/{version}/diagnostics/{objective}/{name}")


def stress_report(bundle: M.Bundle, test: DataFrame) -> dict[str, DataFrame]:
    """Headline metrics, AUC and per-class report of a stress model."""
    # label, class and score are all the reports need, so the model runs over the test set once
    scored = materialize(M.stress_scores(bundle, test), "stress-scores")
    return {
        "metrics": metrics.binary_metrics(scored, "label", "prediction"),
        "auc": metrics.roc_auc(scored, "label", "score"),
        "classification_report": metrics.classification_report(scored, "label", "prediction"),
    }


def lending_suite(
    splits: dict[str, dict[str, DataFrame]], rounds: int = 180, term_rounds: int = 160, depth: int = 6, patience: int | None = None,
) -> dict[str, tuple[dict[str, M.Bundle], DataFrame]]:
    """Two models per lending target and their test metrics.

    ``splits`` maps objective -> split name -> frame with the 20 features and ``target``. With ``patience`` the
    boosted regressors stop early on the validation split.
    """
    measure = {
        "loan_amount": metrics.amount_metrics, "loan_term": metrics.term_metrics, "interest_rate": metrics.rate_metrics,
    }

    def jobs(objective: str, frames: dict[str, DataFrame]) -> list:
        train = frames["train"]
        if objective == "loan_term":
            return [lambda: M.train_term_linear(train), lambda: M.train_term_boosting(train, None, term_rounds, depth, l2=0.1)]
        valid = frames.get("valid") if patience else None
        return [lambda: M.train_linear_regressor(train), lambda: M.train_tree_regressor(train, valid, rounds, depth, patience=patience)]

    trains = [frames["train"] for frames in splits.values()]
    at_once = all(one_task(train) for train in trains)
    fitted = side_by_side(trains[0].sparkSession, [job for item in splits.items() for job in jobs(*item)], at_once) if trains else []
    out = {}
    for i, (objective, frames) in enumerate(splits.items()):
        test, models, table = frames["test"], fitted[2 * i : 2 * i + 2], None
        for bundle in models:
            row = measure[objective](bundle.predict(test), "target", "prediction").withColumn("model", F.lit(bundle.name))
            table = row if table is None else table.unionByName(row)
        out[objective] = ({b.name: b for b in models}, table)
    return out


# --- models from written splits ------------------------------------------------------------------


def train_stress_models(spark: SparkSession, root: str, version: str, model_root: str, report_root: str, rounds: int = 500, depth: int = 10) -> None:
    """Fit both stress models on the written splits, save them and write their reports."""
    splits = store.load_splits(spark, f"{root}/{version}/stress_prediction")
    fitted = {
        "logistic": M.train_stress_logistic(splits["train"]),
        "boosting": M.train_stress_boosting(splits["train"], splits["valid"], rounds=rounds, depth=depth),
    }
    for name, bundle in fitted.items():
        save_bundle(bundle, f"{model_root}/{version}/stress_prediction/{name}")
        for report, table in stress_report(bundle, splits["test"]).items():
            store.write_report(table, f"{report_root}/{version}/stress_prediction/{name}_{report}")
    store.write_report(fitted["boosting"].feature_importance(), f"{report_root}/{version}/stress_prediction/feature_importance")
    store.write_report(explain.top_coefficients(fitted["logistic"].coefficients()), f"{report_root}/{version}/stress_prediction/coefficients")


def train_lending_models(spark: SparkSession, root: str, version: str, model_root: str, report_root: str, **settings) -> dict[str, M.ModelSet]:
    """Fit two models for each lending target on the written splits, save them and write their test metrics.

    Returns the model sets by name; ``settings`` are those of :func:`lending_suite`.
    """
    splits = {o: store.load_splits(spark, f"{root}/{version}/{o}") for o in S.LENDING_TARGETS}
    suite = lending_suite(splits, **settings)
    for objective, (bundles, table) in suite.items():
        store.write_report(table, f"{report_root}/{version}/{objective}/model_metrics")
        for name, bundle in bundles.items():
            save_bundle(bundle, f"{model_root}/{version}/{objective}/{name}")
    names = list(suite["loan_amount"][0])
    return {n: M.ModelSet(*(suite[o][0][n] for o in ("loan_amount", "loan_term", "interest_rate"))) for n in names}


# --- comparison of fitted models -----------------------------------------------------------------


def compare_models(sets: dict[str, M.ModelSet], tests: dict[str, DataFrame]) -> DataFrame:
    """Regression metrics of every model set on the test frames of loan_amount and interest_rate."""
    scored = []
    for name, models in sets.items():
        for objective, bundle in (("loan_amount", models.amount), ("interest_rate", models.rate)):
            scored.append(({"model_key": name, "target": objective}, bundle.predict(tests[objective]).select("target", "prediction")))
    return metrics.model_comparison(scored, "target", "prediction")


def model_impacts(sets: dict[str, M.ModelSet], tests: dict[str, DataFrame], key: list[str], features: list[str] = S.LENDING_FEATURES) -> DataFrame:
    """Permutation impact of every feature on every fitted amount and rate model."""
    out = None
    for name, models in sets.items():
        for objective, bundle in (("loan_amount", models.amount), ("interest_rate", models.rate)):
            impact = explain.model_permutation_impact(tests[objective].select(*key, *features), bundle.predict, "prediction", features, key)
            part = impact.select(F.lit(name).alias("model_key"), F.lit(objective).alias("target"), "feature", "mean_absolute_impact", "mean_signed_impact")
            out = part if out is None else out.unionByName(part)
    return out


import pytest
from pyspark.sql import functions as F

from creditloom import schemas as S
from creditloom.models import training as M
from creditloom.models.persistence import load_bundle
from creditloom.plans import stages
from creditloom.sources import feature_store as store

QUARTERS = ["2018Q1", "2018Q2", "2018Q3", "2018Q4"]


def raw_files(folder):
    """60 loans per quarter, three months each; one sentinel per column and one distressed loan."""
    k = 0
    for quarter in QUARTERS:
        loans, months = [], []
        for i in range(60):
            k += 1
            loan = f"F{quarter}{i:04d}"
            values = {
                "credit_score": 9999 if i == 5 else 600 + (k * 37) % 200, "first_payment_date": 201803, "maturity_date": 204802,
                "msa": "" if i % 9 == 0 else 10000 + i, "mortgage_insurance_pct": 0, "num_units": 1, "occupancy_status": "P",
                "cltv": 80, "dti": 999 if i == 7 else 10 + (k * 7) % 40, "original_upb": 100000 + 1000 * i, "ltv": 50 + (k * 11) % 45,
                "interest_rate": 3 + (k % 16) / 8, "channel": "RCB"[i % 3], "property_state": "CA", "property_type": "SF",
                "postal_code": 90000, "loan_identifier": loan, "loan_purpose": "PCN"[i % 3], "original_loan_term": 360,
                "num_borrowers": 1 + i % 2, "seller_name": "S", "servicer_name": "T", "program_indicator": "9",
                "property_valuation_method": 7, "interest_only_indicator": "N", "mortgage_insurance_cancellation_indicator": "7",
                "first_time_homebuyer_indicator": "NY"[i % 2], "prepayment_penalty_indicator": "N", "amortization_type": "FRM",
            }
            loans.append("|".join(str(values.get(c, "")) for c in S.ORIGINATION_FIELDS))
            for age in range(3):
                status = "RA" if i == 3 else str((k + age) % 8 if i % 4 == 0 else 0)
                row = {
                    "loan_identifier": loan, "reporting_period": 201804 + age, "current_loan_delinquency_status": status,
                    "loan_age": age, "remaining_months_to_maturity": 360 - age, "current_interest_rate": 4.0,
                    "estimated_ltv": 999 if i % 5 == 0 else 60, "modification_flag": "Y" if i == 11 else "",
                }
                months.append("|".join(str(row.get(c, "")) for c in S.PERFORMANCE_FIELDS))
        (folder / f"historical_data_{quarter}.txt").write_text("\n".join(loans) + "\n")
        (folder / f"historical_data_time_{quarter}.txt").write_text("\n".join(months) + "\n")


@pytest.fixture(scope="module")
def master(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    raw_files(folder)
    return stages.build_master(spark, str(folder), QUARTERS, str(folder / "master.parquet"))


def test_master(master):
    assert len(master.columns) == 66 and master.count() == 240
    assert {r["quarter"] for r in master.select("quarter").distinct().collect()} == set(QUARTERS)
    nulls = master.where("bss_level is null")
    assert nulls.count() == 8 == master.where("credit_score is null or dti is null").count()
    assert master.where("loan_identifier like '%0003'").select("bssi").distinct().collect()[0][0] == 3
    for c in S.NORM_COLUMNS:
        assert master.where(f"{c} < 0 or {c} > 1").count() == 0
    # files of one quarter only are read for one quarter
    plan = master.where("quarter = '2018Q3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan


def test_stores_splits_and_reports(spark, master, tmp_path):
    root, reports = str(tmp_path / "store"), str(tmp_path / "reports")
    entry = stages.build_risk_stores(master, root, "v2", "/data/master.parquet", QUARTERS[:2], QUARTERS[2:3], QUARTERS[3:])
    assert (entry["rows"], entry["columns"], entry["source_dataset"]) == (240, 66, "master.parquet")
    assert store.read_manifest(spark, root)["latest_version"] == "v2"
    widths = {"stress_prediction": 37, "stress_severity": 60, "serviceability": 60}
    for objective, width in widths.items():
        splits = store.load_splits(spark, f"{root}/v2/{objective}")
        assert {n: d.count() for n, d in splits.items()} == {"train": 120, "valid": 60, "test": 60}
        assert len(splits["train"].columns) == width
    stages.run_diagnostics(spark, root, "v2", reports)
    summary = spark.read.csv(f"{reports}/v2/diagnostics/stress_prediction/dataset_summary", header=True, inferSchema=True)
    assert {r["metric"]: r["value"] for r in summary.collect()}["Rows"] == 120
    leaks = spark.read.csv(f"{reports}/v2/diagnostics/stress_prediction/leakage_check", header=True, inferSchema=True)
    assert not any(r["present"] for r in leaks.collect())


def test_lending_stores_share_one_split(spark, master, tmp_path):
    stages.build_lending_stores(master, str(tmp_path), "v3")
    for objective in S.LENDING_TARGETS:
        splits = store.load_splits(spark, f"{tmp_path}/v3/{objective}")
        assert {n: d.count() for n, d in splits.items()} == {"train": 192, "valid": 24, "test": 24}
        assert splits["test"].columns == [*S.LENDING_FEATURES, "target"]


def test_mismatching_loans_stop_the_run(spark, tmp_path):
    raw_files(tmp_path)
    path = tmp_path / "historical_data_2018Q2.txt"
    path.write_text("\n".join(path.read_text().splitlines()[1:]) + "\n")
    with pytest.raises(ValueError, match="mismatch"):
        stages.build_master(spark, str(tmp_path), QUARTERS, str(tmp_path / "master"))


def test_models_from_written_splits(spark, master, tmp_path):
    """Stores are read, models saved and loaded, reports written, every model compared."""
    root, models, reports = (str(tmp_path / n) for n in ("store", "models", "reports"))
    stages.build_lending_stores(master, root, "v3")
    sets = stages.train_lending_models(spark, root, "v3", models, reports, rounds=3, term_rounds=3, depth=2)
    assert list(sets) == ["fast_linear", "smart_tree"]
    for objective in S.LENDING_TARGETS:
        table = spark.read.csv(f"{reports}/v3/{objective}/model_metrics", header=True).collect()
        assert sorted(r["model"] for r in table) == ["fast_linear", "smart_tree"]
    tests = {o: store.load_splits(spark, f"{root}/v3/{o}")["test"].withColumn("id", F.monotonically_increasing_id()) for o in ("loan_amount", "interest_rate")}
    loaded = {n: M.ModelSet(*(load_bundle(spark, f"{models}/v3/{o}/{n}") for o in ("loan_amount", "loan_term", "interest_rate"))) for n in sets}
    assert sorted(stages.compare_models(sets, tests).collect()) == sorted(stages.compare_models(loaded, tests).collect())
    assert stages.compare_models(loaded, tests).count() == 4
    impacts = stages.model_impacts({"smart_tree": loaded["smart_tree"]}, tests, ["id"]).collect()
    assert {(r["model_key"], r["target"]) for r in impacts} == {("smart_tree", "loan_amount"), ("smart_tree", "interest_rate")} and len(impacts) == 2 * len(S.LENDING_FEATURES)
    stages.build_risk_stores(master, root, "v2", "master", QUARTERS[:2], QUARTERS[2:3], QUARTERS[3:])
    stages.train_stress_models(spark, root, "v2", models, reports, rounds=3, depth=2)
    assert spark.read.csv(f"{reports}/v2/stress_prediction/boosting_metrics", header=True).count() == 1
    assert load_bundle(spark, f"{models}/v2/stress_prediction/logistic").predict(store.load_splits(spark, f"{root}/v2/stress_prediction")["test"]).count() == 60

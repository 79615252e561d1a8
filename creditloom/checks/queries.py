"""Every operator as a query over the test tables.

Doubles are rounded here, not in the operators, so that engines that add in another order agree.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom import runtime
from creditloom import schemas as S
from creditloom.functions import rules as R
from creditloom.functions import serving as V
from creditloom.models import boosting, persistence
from creditloom.models import training as M
from creditloom.operators import encoders, explain, loans, metrics, profile, quality, ranking
from creditloom.plans import stages
from creditloom.sources import feature_store as store
from creditloom.sources import raw_text
from creditloom.sources.sample_tables import loan_origination, loan_performance

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ID = S.ID_COLUMN


def key() -> Column:
    """Loan id, the number every derived test value hangs on."""
    return F.col(ID)


# The test orders run from 1995Q1 to 2001Q3
TRAIN_QUARTERS = [f"{y}Q{q}" for y in (1995, 1996, 1997, 1998) for q in (1, 2, 3, 4)]
VALID_QUARTERS = [f"1999Q{q}" for q in (1, 2, 3, 4)]
TEST_QUARTERS = [f"{y}Q{q}" for y in (2000, 2001) for q in (1, 2, 3, 4)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Six digits for every double; the tiny shift keeps exact halves from depending on the last bit."""
    return df.selectExpr(*[f"round(`{n}` + 1e-9D, 6) AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes])


# --- inputs ----------------------------------------------------------------------------------------


def clean(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    return loans.clean_origination(loan_origination(spark, sf, columns))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return loans.loan_labels(loan_performance(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return loans.loan_performance_features(loan_performance(spark, sf))


def labelled(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    return loans.join_labels(clean(spark, sf, columns), labels(spark, sf))


def loan_table(spark: SparkSession, sf: str) -> DataFrame:
    return loans.loan_table(loan_origination(spark, sf), loan_performance(spark, sf))


def master(spark: SparkSession, sf: str) -> DataFrame:
    return loans.build_master(loan_origination(spark, sf), loan_performance(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled loans with the portfolio-relative score, on the columns that it needs."""
    narrow = labelled(spark, sf, [ID, "quarter", *S.BSS_COMPONENTS])
    return loans.add_bss(runtime.materialize(narrow, "scored"))


_SPLIT: dict[tuple[str, str], DataFrame] = {}
_SPLITTING = threading.Lock()


def lending(spark: SparkSession, sf: str, target: str = "loan_amount", split: bool = False) -> DataFrame:
    """Keyed lending store; the target of every loan that has performance records."""
    raw = [ID, *[c for c in S.LENDING_FEATURES if c != "quarter_num"], *S.LENDING_TARGETS.values()]
    known = loan_performance(spark, sf).select(ID).distinct()

    def rows() -> DataFrame:
        return R.quarter_columns(clean(spark, sf, raw).join(known, ID, "left_semi"), F.col("quarter"))

    if not split:
        base = rows()
    else:
        with _SPLITTING:  # all targets have the same loans and splits
            at = (spark.sparkContext.applicationId, sf)
            if at not in _SPLIT:
                _SPLIT[at] = ranking.hash_split(runtime.materialize(rows(), "lending"), [ID])
            base = _SPLIT[at]
    return store.lending_store(base, target, keep=[ID, *(["split"] if split else [])])


def lending_splits(spark: SparkSession, sf: str, target: str) -> dict[str, DataFrame]:
    tagged = lending(spark, sf, target, split=True)
    return {s: tagged.where(F.col("split") == s).drop("split") for s in store.SPLITS}


def wide_numeric(df: DataFrame) -> list[str]:
    return [c for c in R.numeric_columns(df) if c != ID]


# --- sources ---------------------------------------------------------------------------------------


@query
def read_origination(spark, sf):
    path = runtime.work_path(spark, "origination")
    raw_text.write_raw(loan_origination(spark, sf), S.ORIGINATION_FIELDS, path)
    return raw_text.read_origination(spark, path)


@query
def read_performance(spark, sf):
    path = runtime.work_path(spark, "performance")
    raw_text.write_raw(loan_performance(spark, sf), S.PERFORMANCE_FIELDS, path)
    return raw_text.read_performance(spark, path)


@query
def quarter_columns(spark, sf):
    named = loan_origination(spark, sf, [ID, "quarter"]).select(
        ID, F.concat(F.lit("historical_data_"), "quarter", F.lit(".txt")).alias("file_name")
    )
    return R.quarter_columns(named, raw_text.quarter_of_file(F.col("file_name")))


@query
def feature_store_manifest(spark, sf):
    root = runtime.work_path(spark, "stores")
    entry = store.write_feature_store(runtime.materialize(master(spark, sf), "master"), root, "v1", "master.parquet", "check")
    manifest = store.read_manifest(spark, root)
    parts = []
    for objective in S.OBJECTIVE_DROPS:
        written = spark.read.parquet(f"{root}/v1/{objective}/feature_store.parquet")
        parts.append(
            written.agg(F.count("*").alias("rows")).select(
                F.lit(manifest["latest_version"]).alias("version"), F.lit(objective).alias("objective"), "rows",
                F.lit(len(written.columns)).alias("columns"), F.lit(entry["columns"]).alias("master_columns"),
            )
        )
    return loans.union_quarters(parts)


# --- rules -----------------------------------------------------------------------------------------


@query
def sentinel_to_null(spark, sf):
    return R.sentinels_to_null(loan_origination(spark, sf, [ID, *S.SENTINELS]))


@query
def drop_leakage_columns(spark, sf):
    return rounded(labelled(spark, sf).drop(*S.LABEL_LEAKAGE, *S.UNUSABLE))


@query
def coerce_numeric(spark, sf):
    status = R.number_or(F.col("current_loan_delinquency_status"), 0)
    return loan_performance(spark, sf).select(ID, "reporting_period", status.alias("delinquency"))


@query
def cap_to_null(spark, sf):
    return loan_performance(spark, sf).select(
        ID, "reporting_period", R.capped_to_null(F.col("estimated_ltv")).alias("estimated_ltv")
    )


@query
def presence_flags(spark, sf):
    flags = {
        "modified_flag": "modification_flag", "assistance_flag": "borrower_assistance_status",
        "zero_balance_flag": "zero_balance_code",
    }
    return loan_performance(spark, sf).select(
        ID, "reporting_period", *[R.presence_flag(F.col(c)).alias(n) for n, c in flags.items()]
    )


@query
def bssi_ladder(spark, sf):
    return labels(spark, sf).select(ID, "bssi")


@query
def stress_flag(spark, sf):
    return labels(spark, sf).select(ID, "stress_flag")


@query
def stress_level(spark, sf):
    return labels(spark, sf).select(ID, "stress_level")


@query
def minmax_norm(spark, sf):
    narrow = labelled(spark, sf, [ID, "quarter", *S.BSS_COMPONENTS])
    return rounded(loans.add_norms(narrow).select(ID, *S.NORM_COLUMNS))


@query
def bss_score(spark, sf):
    narrow = labelled(spark, sf, [ID, "quarter", *S.BSS_COMPONENTS])
    return rounded(loans.add_norms(narrow).select(ID, R.weighted_bss().alias("bss")))


@query
def serviceability_score(spark, sf):
    return rounded(
        clean(spark, sf, [ID, "credit_score", "dti", "ltv", "num_borrowers"]).select(
            ID, R.serviceability_score().alias("serviceability_score")
        )
    )


def _ratios(spark, sf) -> DataFrame:
    return R.performance_ratios(loans.loan_table(loan_origination(spark, sf, [ID, "ltv"]), loan_performance(spark, sf)))


@query
def intensity_ratios(spark, sf):
    return rounded(_ratios(spark, sf).select(ID, "delinquency_intensity", "modification_intensity", "assistance_intensity"))


@query
def eltv_drift(spark, sf):
    return rounded(_ratios(spark, sf).select(ID, "eltv_drift"))


@query
def rate_volatility(spark, sf):
    return rounded(features(spark, sf).select(ID, "rate_volatility"))


@query
def remaining_term_months(spark, sf):
    return loan_origination(spark, sf, [ID, "first_payment_date", "maturity_date"]).withColumn(
        "remaining_term_months", R.months_between_yyyymm(F.col("first_payment_date"), F.col("maturity_date"))
    )


@query
def interaction_features(spark, sf):
    df = R.interaction_features(clean(spark, sf, [ID, "dti", "ltv", "credit_score"]))
    return rounded(df.select(ID, "dti_ltv_interaction", "credit_risk_multiplier"))


@query
def lending_store_amount(spark, sf):
    return rounded(lending(spark, sf, "loan_amount").drop(ID))


@query
def lending_store_rate(spark, sf):
    return rounded(lending(spark, sf, "interest_rate").drop(ID))


@query
def lending_store_term(spark, sf):
    return lending(spark, sf, "loan_term").drop(ID)


@query
def store_stress_prediction(spark, sf):
    return rounded(store.objective_store(master(spark, sf), "stress_prediction"))


@query
def store_stress_severity(spark, sf):
    return rounded(store.objective_store(master(spark, sf), "stress_severity"))


@query
def store_serviceability(spark, sf):
    return rounded(store.objective_store(master(spark, sf), "serviceability"))


@query
def store_explainability(spark, sf):
    return rounded(store.objective_store(master(spark, sf), "explainability"))


@query
def variant_baseline(spark, sf):
    return rounded(store.baseline_variant(master(spark, sf)))


@query
def variant_bss(spark, sf):
    return rounded(store.score_variant(master(spark, sf)))


@query
def drop_null_target(spark, sf):
    return scored(spark, sf).dropna(subset=["bss_level"]).select(ID, "bss_level")


@query
def prepare_frame(spark, sf):
    return R.prepare_frame(lending(spark, sf), keep=[ID])


FILL_COLUMNS = [ID, "quarter", "credit_score", "dti", "ltv", "cltv", "msa", "super_conforming_flag"]


@query
def median_fill(spark, sf):
    df = loan_origination(spark, sf, FILL_COLUMNS)
    df = R.sentinels_to_null(df).withColumn(ID, key().cast("string"))
    return encoders.median_fill(df.where(F.col("quarter").isin(TRAIN_QUARTERS)), df)


@query
def term_class(spark, sf):
    return loan_origination(spark, sf, [ID, "original_loan_term"]).select(
        ID, V.term_class(F.col("original_loan_term")).alias("term_class")
    )


def amount_guess() -> Column:
    return F.log1p(F.col("original_upb").cast("double")) + (key() % 21 - 10) / F.lit(100.0)


@query
def score_amount(spark, sf):
    return loan_origination(spark, sf, [ID, "original_upb"]).select(
        ID, V.clean_amount(amount_guess()).alias("estimated_loan_amount")
    )


@query
def snap_term(spark, sf):
    term = F.col("original_loan_term")
    return loan_origination(spark, sf, [ID, "original_loan_term"]).select(
        ID,
        V.clean_term(term + key() % 61 - 30, F.lit(False)).alias("from_months"),
        V.clean_term(V.term_class(term), F.lit(True)).alias("from_class"),
    )


@query
def score_rate(spark, sf):
    guess = F.col("interest_rate") + (key() % 20 - F.lit(9.5)) / F.lit(7.3) + F.when(key() % 50 == 0, 30).otherwise(0)
    return loan_origination(spark, sf, [ID, "interest_rate", "original_loan_term"]).select(
        ID, V.clean_rate(guess).alias("estimated_interest_rate"),
        V.term_years(F.col("original_loan_term") + key() % 7).alias("term_years"),
    )


def applications(spark, sf) -> DataFrame:
    """One application per loan; sentinels and unknown codes are left in."""

    def pick(values: list[str], modulus: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), modulus.cast("int"))

    origination = loan_origination(spark, sf)
    return origination.select(
        ID,
        pick([*S.MODEL_CHOICES, "unknown"], key() % 5).alias("model_selection"),
        "credit_score", "dti", "ltv", "cltv", "mortgage_insurance_pct", "num_borrowers", "num_units",
        (key() % 5 == 0).alias("first_time_homebuyer"),
        "occupancy_status",
        pick(["SF", "PU", "CO", "MH", "CP", "XX"], key() % 6).alias("property_type"),
        F.lower(F.substring("property_state", 1, 2)).alias("property_state"),
        F.coalesce(F.col("msa").cast("string"), F.lit("0")).alias("msa"),
        pick(["R", "C", "B"], key() % 3).alias("channel"),
        "loan_purpose",
    )


@query
def validate_applications(spark, sf):
    return V.validate_applications(applications(spark, sf)).select(
        ID, "accepted", F.concat_ws(",", "violations").alias("violations")
    )


@query
def application_features(spark, sf):
    accepted = V.validate_applications(applications(spark, sf)).where("accepted")
    return V.application_features(accepted, keep=[ID], unknown_msa=True)


# --- joins -----------------------------------------------------------------------------------------


@query
def join_inner(spark, sf):
    narrow = clean(spark, sf, [ID, "quarter", "credit_score", "original_upb"])
    return loans.join_labels(narrow, labels(spark, sf))


@query
def join_left_resolve(spark, sf):
    return rounded(loans.join_features(labels(spark, sf), features(spark, sf)))


@query
def reconcile_keys(spark, sf):
    return quality.reconcile_keys(loan_origination(spark, sf, [ID]), loan_performance(spark, sf))


#: Every text column of a cleaned origination record, and the area code.
SEEN_COLUMNS = [c for c, t in S.ORIGINATION_FIELDS.items() if t == "string" and c not in (ID, *S.UNUSED_ORIGINATION)] + ["msa", "quarter"]


@query
def unseen_categories(spark, sf):
    df = clean(spark, sf, [ID, *SEEN_COLUMNS])
    train, valid, test = (df.where(F.col("quarter").isin(q)) for q in (TRAIN_QUARTERS, VALID_QUARTERS, TEST_QUARTERS))
    return quality.unseen_categories(train, {"valid": valid, "test": test}, SEEN_COLUMNS)


@query
def ordinal_encode(spark, sf):
    df = R.prepare_frame(lending(spark, sf), keep=[ID])
    lists = encoders.fit_categories(df.where(F.col("quarter").isin(TRAIN_QUARTERS)), S.LENDING_CATEGORICAL)
    out = encoders.ordinal_encode(df, lists)
    return out.select(ID, *[F.col(f"{c}_code").cast("int").alias(f"{c}_code") for c in S.LENDING_CATEGORICAL])


ENCODED = S.LENDING_CATEGORICAL


@query
def target_encode(spark, sf):
    df = runtime.materialize(lending(spark, sf), "target-encode")
    train = df.where(F.col("quarter").isin(TRAIN_QUARTERS))
    rest = df.where(~F.col("quarter").isin(TRAIN_QUARTERS))
    encoder = encoders.TargetEncoder(ENCODED, "target", [ID]).fit(train)
    names = [ID, *[f"{c}_encoded" for c in ENCODED]]
    out = encoder.transform(train, training=True).select(*names).unionByName(encoder.transform(rest).select(*names))
    return rounded(out)


# --- aggregations ----------------------------------------------------------------------------------


@query
def loan_labels(spark, sf):
    return labels(spark, sf)


@query
def loan_performance_features(spark, sf):
    return rounded(features(spark, sf))


@query
def cardinality(spark, sf):
    return profile.cardinality(loan_table(spark, sf))


@query
def target_distribution(spark, sf):
    return rounded(profile.value_counts(labels(spark, sf), "stress_level"))


@query
def value_counts_nulls(spark, sf):
    return rounded(profile.value_counts(clean(spark, sf, [ID, "msa"]), "msa", keep_null=True))


@query
def stress_rate_by_quarter(spark, sf):
    return rounded(profile.group_means(labelled(spark, sf, [ID, "quarter"]), ["quarter"], ["stress_flag"]))


@query
def bss_by_quarter(spark, sf):
    narrow = labelled(spark, sf, [ID, "quarter", *S.BSS_COMPONENTS])
    return rounded(profile.group_means(loans.add_norms(narrow).withColumn("bss", R.weighted_bss()), ["quarter"], ["bss"]))


@query
def features_by_bssi(spark, sf):
    df = loan_table(spark, sf)
    return rounded(profile.group_means(df, ["bssi"], [c for c in wide_numeric(df) if c != "bssi"]))


@query
def describe_by_group(spark, sf):
    df = runtime.materialize(loan_table(spark, sf), "describe")
    return rounded(profile.numeric_summary(df, [c for c in wide_numeric(df) if c != "stress_flag"], ["stress_flag"]))


@query
def numeric_summary(spark, sf):
    df = runtime.materialize(loan_table(spark, sf), "numeric-summary")
    return rounded(profile.numeric_summary(df, wide_numeric(df)))


@query
def missing_values(spark, sf):
    return rounded(profile.missing_values(loan_table(spark, sf)))


@query
def dataset_summary(spark, sf):
    return profile.dataset_summary(loan_table(spark, sf))


@query
def correlation_matrix(spark, sf):
    df = runtime.materialize(loan_table(spark, sf), "correlation")
    return rounded(profile.correlation_matrix(df, wide_numeric(df)))


@query
def outlier_summary(spark, sf):
    df = runtime.materialize(loan_table(spark, sf), "outliers")
    return rounded(profile.outlier_summary(df, wide_numeric(df)))


@query
def mutual_information(spark, sf):
    """All numeric columns but the label, on equal-frequency bins."""
    df = runtime.materialize(loan_table(spark, sf), "relevance")
    return rounded(profile.mutual_information(df, [c for c in wide_numeric(df) if c != "stress_level"], "stress_level"))


@query
def leakage_check(spark, sf):
    return rounded(quality.leakage_check(loan_table(spark, sf), "stress_flag"))


@query
def crosstab_cols(spark, sf):
    df = labelled(spark, sf, [ID, "num_borrowers"])
    return rounded(profile.crosstab(df, "num_borrowers", "stress_flag", [0, 1], "columns"))


@query
def crosstab_rows(spark, sf):
    return rounded(profile.crosstab(scored(spark, sf), "bss_bucket", "stress_flag", [0, 1], "index"))


@query
def constant_features(spark, sf):
    return profile.constant_features(loan_table(spark, sf))


@query
def sentinel_census(spark, sf):
    return rounded(quality.sentinel_census(loan_origination(spark, sf, [ID, *S.SENTINELS])))


CODES = [999, 9999]


@query
def code_census(spark, sf):
    return rounded(quality.code_census(loan_origination(spark, sf, [ID, *S.SENTINELS]), list(S.SENTINELS), CODES))


@query
def histogram(spark, sf):
    narrow = runtime.materialize(labelled(spark, sf, [ID, "quarter", *S.BSS_COMPONENTS]), "histogram")
    return rounded(profile.histogram(loans.add_norms(narrow).withColumn("bss", R.weighted_bss()), "bss", 30))


@query
def column_inventory(spark, sf):
    return profile.column_inventory(loan_table(spark, sf))


@query
def risk_ratio(spark, sf):
    return rounded(profile.risk_ratio(scored(spark, sf), "bss_bucket", "Very Low", "Very High", "stress_flag"))


@query
def event_totals(spark, sf):
    return profile.event_totals(labels(spark, sf), ["ever_ra", "ever_modified", "ever_assistance"])


# --- order, top-k, sets ------------------------------------------------------------------------------


@query
def qcut_bucket(spark, sf):
    return scored(spark, sf).select(ID, "bss_bucket", "bss_level")


@query
def stress_rate_by_bucket(spark, sf):
    """The flagship question: how often do loans of each serviceability bucket run into stress?"""
    rates = scored(spark, sf).groupBy("bss_bucket").agg(
        F.count("*").alias("loans"), F.sum("stress_flag").alias("stressed"), (F.avg("stress_flag") * 100).alias("stress_rate")
    )
    return rounded(rates)


@query
def topk_values(spark, sf):
    names = ["original_upb", "interest_rate", "original_loan_term"]
    df = loan_origination(spark, sf, [ID, *names]).withColumn("interest_rate", (F.col("interest_rate") * 80).cast("bigint"))
    return profile.top_values(df, names, 20)


@query
def topk_coefficients(spark, sf):
    """Largest effects of single categories on the log amount, of property-related columns."""
    df = lending(spark, sf, "loan_amount")
    mean = df.agg(F.avg("target")).first()[0]
    names = ["property_state", "property_type", "channel", "loan_purpose"]
    pairs = F.array(*[F.concat_ws("__", F.lit(c), F.col(c)) for c in names])
    table = (
        df.select("target", F.explode(pairs).alias("feature"))
        .groupBy("feature").agg((F.avg("target") - mean).alias("coefficient"))
    )
    return rounded(explain.top_coefficients(table, 30, "property"))


@query
def union_quarters(spark, sf):
    df = clean(spark, sf, [ID, "quarter", "credit_score"])
    year = F.substring("quarter", 1, 4)
    # as many rows as there are years in the data; loans without a quarter are a part, too
    years = [r["y"] for r in df.select(year.alias("y")).distinct().collect()]
    united = loans.union_quarters([df.where(year.eqNullSafe(F.lit(y))) for y in years])
    return loans.join_labels(united, labels(spark, sf))


# --- splits and samples --------------------------------------------------------------------------------


@query
def temporal_split(spark, sf):
    df = labelled(spark, sf, [ID, "quarter"]).select(ID, "quarter", "stress_flag")
    return ranking.temporal_split(df, TRAIN_QUARTERS, VALID_QUARTERS, TEST_QUARTERS)


@query
def split_drift(spark, sf):
    df = labelled(spark, sf, [ID, "quarter"]).select("quarter", "stress_flag")
    tagged = ranking.temporal_split(df, TRAIN_QUARTERS, VALID_QUARTERS, TEST_QUARTERS)
    return rounded(quality.split_drift(tagged, "stress_flag", ["split"]))


@query
def hash_split(spark, sf):
    return ranking.hash_split(loan_origination(spark, sf, [ID, "original_upb"]), [ID])


@query
def sample_cap(spark, sf):
    return ranking.sample_cap(loan_origination(spark, sf, [ID, "original_upb"]), [ID], 1000)


@query
def permute_column(spark, sf):
    df = loan_origination(spark, sf, [ID, "msa", "credit_score"])
    return ranking.permute_columns(df, ["msa", "credit_score"], [ID])


# --- preparation -----------------------------------------------------------------------------------------


@query
def impute_scale(spark, sf):
    df = clean(spark, sf, [ID, "quarter", *S.SENTINELS, "interest_rate"])
    scaler = encoders.NumericScaler.fit(df.where(F.col("quarter").isin(TRAIN_QUARTERS)), [*S.SENTINELS, "interest_rate"])
    return rounded(scaler.transform(df).drop("quarter"))


#: Every text column of an origination record, and the area code.
MODE_COLUMNS = [c for c, t in S.ORIGINATION_FIELDS.items() if t == "string" and c != ID] + ["msa"]


@query
def impute_mode(spark, sf):
    df = loan_origination(spark, sf, [ID, "quarter", *MODE_COLUMNS])
    return encoders.impute_mode(df.where(F.col("quarter").isin(TRAIN_QUARTERS)), df, MODE_COLUMNS).drop("quarter")


HOT_COLUMNS = S.LENDING_CATEGORICAL


@query
def one_hot_long(spark, sf):
    df = R.prepare_frame(lending(spark, sf), keep=[ID])
    lists = encoders.fit_categories(df.where(F.col("quarter").isin(TRAIN_QUARTERS)), HOT_COLUMNS)
    return encoders.one_hot_long(df, lists, [ID])


def _preprocessor(spark, sf, mode) -> DataFrame:
    df = lending(spark, sf)
    prep = encoders.TabularPreprocessor(mode).fit(df.where(F.col("quarter").isin(TRAIN_QUARTERS)))
    return rounded(prep.transform_long(df, [ID]))


@query
def preproc_linear(spark, sf):
    return _preprocessor(spark, sf, "linear")


@query
def preproc_tree(spark, sf):
    return _preprocessor(spark, sf, "tree")


@query
def class_weights(spark, sf):
    return rounded(encoders.class_weights(labels(spark, sf), "stress_level"))


@query
def prepare_xy(spark, sf):
    df = labelled(spark, sf).withColumn(
        "remaining_term_months", R.months_between_yyyymm(F.col("first_payment_date"), F.col("maturity_date"))
    )
    keyed = df.withColumn("row_key", key()).drop(*S.STRESS_PREP_REMOVE, "first_payment_date", "maturity_date")
    return rounded(keyed)


# --- metrics -----------------------------------------------------------------------------------------------


@query
def regression_metrics(spark, sf):
    df = loan_origination(spark, sf, [ID, "interest_rate"])
    return rounded(metrics.regression_metrics(df.withColumn("guess", F.col("interest_rate") + (key() % 21 - 10) / F.lit(100.0)), "interest_rate", "guess"))


@query
def amount_metrics(spark, sf):
    df = loan_origination(spark, sf, [ID, "original_upb"]).select(
        F.log1p(F.col("original_upb").cast("double")).alias("y"), amount_guess().alias("guess")
    )
    out = metrics.amount_metrics(df, "y", "guess")
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


def term_of(k: Column) -> Column:
    return (
        F.when(k % 10 == 0, 120).when(k % 10 == 1, 240).when(k % 10 == 2, 300)
        .when((k % 10).isin(3, 4), 180).otherwise(360)
    )


def _term_guess(spark, sf) -> DataFrame:
    return loan_origination(spark, sf, [ID, "original_loan_term"]).withColumn("guess", term_of(key() + 1))


@query
def term_metrics(spark, sf):
    return rounded(metrics.term_metrics(_term_guess(spark, sf), "original_loan_term", "guess"))


@query
def rate_metrics(spark, sf):
    df = loan_origination(spark, sf, [ID, "interest_rate"])
    return rounded(metrics.rate_metrics(df.withColumn("guess", F.col("interest_rate") + (key() % 13 - 6) / F.lit(50.0)), "interest_rate", "guess"))


def _stress_guess(spark, sf) -> DataFrame:
    score = (key() * 37 % 101) / F.lit(101.0)
    return labels(spark, sf).select(ID, "stress_flag", score.alias("score"), (score >= 0.5).cast("int").alias("guess"))


@query
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(_stress_guess(spark, sf), "stress_flag", "guess"))


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(_stress_guess(spark, sf), "stress_flag", "score"))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_stress_guess(spark, sf), "stress_flag", "guess")


@query
def classification_report(spark, sf):
    return rounded(metrics.classification_report(_term_guess(spark, sf), "original_loan_term", "guess"))


COMPARED = {
    "model_a": {"loan_amount": (21, 10, 100.0), "interest_rate": (21, 10, 100.0)},
    "model_b": {"loan_amount": (11, 5, 40.0), "interest_rate": (7, 3, 90.0)},
}


def _comparison(spark, sf) -> DataFrame:
    df = loan_origination(spark, sf, [ID, "original_upb", "interest_rate"])
    frames = []
    for model, targets in COMPARED.items():
        for target, (mod, shift, scale) in targets.items():
            y = F.col("original_upb").cast("double") if target == "loan_amount" else F.col("interest_rate")
            guess = y * (1 + (key() % mod - shift) / F.lit(scale))
            frames.append(({"model_key": model, "target": target}, df.select(y.alias("y"), guess.alias("guess"))))
    return metrics.model_comparison(frames, "y", "guess")


@query
def model_comparison(spark, sf):
    out = _comparison(spark, sf)
    return out.select("model_key", "target", *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2", "mape_pct")])


@query
def best_by_metric(spark, sf):
    rates = _comparison(spark, sf).where(F.col("target") == "interest_rate")
    best = metrics.best_by_metric(rates, "mae", ["model_key"])
    return best.select("model_key", "target", F.round("mae", 4).alias("mae"))


# --- explanations ----------------------------------------------------------------------------------------

# Fixed linear models: (intercept, slopes, category effects)
LINEAR_MODELS = {
    ("model_a", "loan_amount"): (
        10.5,
        {"credit_score": 0.001, "dti": -0.004, "num_borrowers": 0.3, "num_units": 0.5, "ltv": -0.002, "cltv": 0.001, "mortgage_insurance_pct": 0.002, "quarter_num": 0.01},
        {"occupancy_status": {"P": 0.1, "S": -0.05}, "loan_purpose": {"P": 0.2, "C": -0.1}, "property_state": {"NATION_1": 0.2, "NATION_2": 0.15}, "first_time_homebuyer_indicator": {"Y": -0.1}},
    ),
    ("model_a", "interest_rate"): (
        6.0,
        {"credit_score": -0.002, "dti": 0.01, "ltv": 0.004},
        {"occupancy_status": {"I": 0.4}, "channel": {"1": 0.05, "2": -0.03}, "quarter": {"1998Q4": 0.3}},
    ),
    ("model_b", "loan_amount"): (
        11.0,
        {"credit_score": 0.0005, "dti": -0.002, "num_borrowers": 0.1, "ltv": 0.003},
        {"property_type": {"BUILDING": 0.3}, "msa": {"10000": 0.2, "10100": 0.1}},
    ),
    ("model_b", "interest_rate"): (5.0, {"credit_score": -0.001, "cltv": 0.005, "num_units": 0.1}, {"program_indicator": {"H": -0.2}}),
}
UNITS = {"loan_amount": "USD", "interest_rate": "percentage points"}


def linear_scorer(model: str, target: str) -> explain.LinearScorer:
    intercept, slopes, effects = LINEAR_MODELS[model, target]
    return explain.LinearScorer(intercept, slopes, effects, F.expm1 if target == "loan_amount" else V.clip_rate)


def lending_frame(spark, sf) -> DataFrame:
    """Prepared lending features with missing numbers as zero."""
    return R.prepare_frame(lending(spark, sf), keep=[ID]).fillna(0.0, S.LENDING_NUMERIC)


def _impacts(spark, sf) -> DataFrame:
    scorers = {key: linear_scorer(*key) for key in LINEAR_MODELS}
    frame = runtime.materialize(lending_frame(spark, sf), "impacts")
    return explain.permutation_impact(frame, scorers, S.LENDING_FEATURES, [ID], UNITS)


def _four_digits(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-7, 4) for c in names})


@query
def permutation_impact(spark, sf):
    return _four_digits(_impacts(spark, sf), ["mean_absolute_impact", "mean_signed_impact"])


@query
def topk_per_group(spark, sf):
    top = explain.top_impacts(_impacts(spark, sf), 5)
    return _four_digits(top.select("model_key", "target", "rank", "feature", "mean_absolute_impact"), ["mean_absolute_impact"])


@query
def pdp_curve(spark, sf):
    scorer = linear_scorer("model_a", "loan_amount")
    grid = explain.linear_grid(20, 100, 50)
    return _four_digits(explain.pdp_curve(lending_frame(spark, sf), scorer, ["ltv", "cltv"], grid), ["value", "prediction"])


def _explained(spark, sf) -> tuple[DataFrame, explain.LinearScorer, DataFrame]:
    # the sample, its averages and the contributions read it
    frame = runtime.materialize(lending_frame(spark, sf), "explained")
    scorer = explain.LinearScorer(*LINEAR_MODELS["model_a", "loan_amount"])
    return frame, scorer, ranking.sample_cap(frame, [ID], 100)


@query
def linear_attribution(spark, sf):
    return rounded(explain.linear_attribution(*_explained(spark, sf), [ID]))


@query
def attribution_rollup(spark, sf):
    return explain.linear_drivers(*_explained(spark, sf), [ID], 5)


@query
def attribution_rollup_long(spark, sf):
    """The same ranking from a table of contributions, as fitted models produce it."""
    return explain.attribution_rollup(explain.linear_attribution(*_explained(spark, sf), [ID]), [ID], 5)


# --- quality -------------------------------------------------------------------------------------------


@query
def validate_master(spark, sf):
    df = quality.validate_master(runtime.materialize(master(spark, sf), "master"))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


ALLOWED = {
    "mortgage_insurance_cancellation_indicator": ["7", "N"],
    "program_indicator": ["9", "H"],
    "interest_only_indicator": ["N", "Y"],
    "property_valuation_method": [7],
    "occupancy_status": ["P", "S"],
}


@query
def domain_check(spark, sf):
    return quality.domain_check(loan_origination(spark, sf, [ID, *ALLOWED]), ALLOWED)


# --- models -------------------------------------------------------------------------------------------------
# Published settings. Models that several queries read are trained once for an application and loaded again.

_TRAINED: dict[tuple[str, str, str], str] = {}


def trained(spark: SparkSession, sf: str, name: str, train: Callable[[], M.Bundle]) -> M.Bundle:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _TRAINED:
        path = runtime.work_path(spark, name)
        persistence.save_bundle(train(), path)
        _TRAINED[key] = path
    return persistence.load_bundle(spark, _TRAINED[key])


def published_regressor(spark: SparkSession, sf: str, objective: str) -> M.Bundle:
    def train() -> M.Bundle:
        splits = lending_splits(spark, sf, objective)
        return M.train_published_regressor(splits["train"], splits["valid"], objective)

    return trained(spark, sf, f"published-{objective}", train)


def class_term_model(spark: SparkSession, sf: str) -> M.Bundle:
    def train() -> M.Bundle:
        splits = {n: M.term_class_target(df) for n, df in lending_splits(spark, sf, "loan_term").items()}
        return M.train_term_boosting(splits["train"], splits["valid"], patience=M.PUBLISHED_PATIENCE)

    return trained(spark, sf, "term-classes", train)


def stacked_model(spark: SparkSession, sf: str) -> M.StackedBundle:
    def train() -> M.StackedBundle:
        splits = lending_splits(spark, sf, "loan_amount")
        return M.train_stacked(splits["train"], splits["valid"], [ID], patience=(40, 40))

    return trained(spark, sf, "stacked", train)


def stress_splits(spark, sf) -> dict[str, DataFrame]:
    df = runtime.materialize(store.objective_store(master(spark, sf), "stress_prediction"), "stress")
    tagged = ranking.temporal_split(df, TRAIN_QUARTERS, VALID_QUARTERS, TEST_QUARTERS)
    return {s: tagged.where(F.col("split") == s).drop("split") for s in store.SPLITS}


@query
def train_logistic(spark, sf):
    splits = stress_splits(spark, sf)
    bundle = M.train_stress_logistic(splits["train"])
    report = stages.stress_report(bundle, splits["test"])
    return metrics.metric_rows(report["metrics"]).unionByName(metrics.metric_rows(report["auc"].select("roc_auc")))


@query
def coefficient_table(spark, sf):
    bundle = M.train_stress_logistic(stress_splits(spark, sf)["train"])
    return explain.top_coefficients(bundle.coefficients(), 30)


@query
def ridge_optimum(spark, sf):
    """Every feature of a fitted ridge solves its normal equation."""
    df = lending(spark, sf)
    train = df.where(F.col("quarter").isin(TRAIN_QUARTERS))
    return M.ridge_gradient(M.train_linear_regressor(train), train).withColumn("gradient", F.abs(F.round("gradient", 4)))


@query
def logistic_optimum(spark, sf):
    """The largest gradient of the fitted stress model, per row."""
    train = stress_splits(spark, sf)["train"]
    gradient = M.logistic_gradient(M.train_stress_logistic(train), train)
    return gradient.agg(F.abs(F.round(F.max(F.abs("gradient")), 3)).alias("largest_gradient"))


@query
def train_gbt_classifier(spark, sf):
    splits = stress_splits(spark, sf)
    bundle = M.train_stress_boosting(splits["train"], splits["valid"])
    return stages.stress_report(bundle, splits["test"])["metrics"]


@query
def train_gbt_regressor(spark, sf):
    parts, objectives = [], ("loan_amount", "interest_rate")
    at_once = boosting.one_task(lending_splits(spark, sf, "loan_amount")["train"])
    bundles = runtime.side_by_side(spark, [lambda o=o: published_regressor(spark, sf, o) for o in objectives], at_once)
    for objective, bundle in zip(objectives, bundles):
        predicted = bundle.predict(lending_splits(spark, sf, objective)["test"])
        row = metrics.regression_metrics(predicted, "target", "prediction")
        parts.append(row.withColumn("objective", F.lit(objective)))
    return loans.union_quarters(parts)


@query
def train_term_classifier(spark, sf):
    test = M.term_class_target(lending_splits(spark, sf, "loan_term")["test"])
    return metrics.classification_report(class_term_model(spark, sf).predict(test), "target", "prediction")


@query
def train_lending_suite(spark, sf):
    splits = {o: lending_splits(spark, sf, o) for o in S.LENDING_TARGETS}
    suite = stages.lending_suite(splits, patience=10)
    parts = []
    for objective, (_, table) in suite.items():
        values = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in table.columns if c != "model"]
        )
        parts.append(table.select(F.lit(objective).alias("objective"), "model", F.inline(values)))
    return loans.union_quarters(parts)


@query
def train_stacked(spark, sf):
    test = lending_splits(spark, sf, "loan_amount")["test"]
    return metrics.amount_metrics(stacked_model(spark, sf).predict(test), "target", "prediction")


@query
def score_batch(spark, sf):
    """Four choices of models, each application scored by the one it names."""
    splits = {o: lending_splits(spark, sf, o) for o in S.LENDING_TARGETS}
    terms, numbers = splits["loan_term"]["train"], ("loan_amount", "interest_rate")
    jobs = [  # the longest ones first
        lambda: stacked_model(spark, sf),
        lambda: class_term_model(spark, sf),
        *(lambda o=o: published_regressor(spark, sf, o) for o in numbers),
        lambda: M.train_term_boosting(terms, None, 160, l2=0.1),
        *(lambda o=o: M.train_tree_regressor(splits[o]["train"], splits[o]["valid"], patience=10) for o in numbers),
        lambda: M.train_term_linear(terms),
        *(lambda o=o: M.train_linear_regressor(splits[o]["train"]) for o in numbers),
    ]
    stacked, classes, amount, rate, tree_term, tree_amount, tree_rate, linear_term, linear_amount, linear_rate = runtime.side_by_side(
        spark, jobs, boosting.one_task(terms)
    )
    sets = {
        "v4_stacked": M.ModelSet(stacked, classes, rate),
        "v4_catboost": M.ModelSet(amount, classes, rate),
        "smart_tree": M.ModelSet(tree_amount, tree_term, tree_rate),
        "fast_linear": M.ModelSet(linear_amount, linear_term, linear_rate),
    }
    accepted = V.validate_applications(applications(spark, sf)).where("accepted")
    choices = F.array(*[F.lit(c) for c in S.MODEL_CHOICES], F.lit(None))
    chosen = V.application_features(accepted, keep=[ID]).withColumn("model_selection", F.get(choices, F.pmod(key(), F.lit(5)).cast("int")))
    return M.score_by_choice(chosen, [ID], sets)


@query
def feature_importance(spark, sf):
    return published_regressor(spark, sf, "loan_amount").feature_importance()


@query
def model_attribution(spark, sf):
    splits = lending_splits(spark, sf, "loan_amount")
    background = ranking.sample_cap(splits["train"], [ID], 100)
    contributions = published_regressor(spark, sf, "loan_amount").attribution(splits["test"], background, [ID])
    return explain.attribution_rollup(contributions, [ID], 5)


@query
def model_pdp_curve(spark, sf):
    splits = lending_splits(spark, sf, "loan_amount")
    bundle = M.train_linear_regressor(splits["train"])
    scorer = bundle.linear_scorer()
    scorer.link = F.expm1
    return explain.pdp_curve(bundle.filled(splits["test"]), scorer, ["ltv", "cltv"], explain.linear_grid(20, 100, 50))


@query
def model_permutation_impact(spark, sf):
    splits = lending_splits(spark, sf, "loan_amount")
    bundle = published_regressor(spark, sf, "loan_amount")
    encoded = (bundle.preprocessor.assemble, bundle.model.scores, bundle.preprocessor.feature_names)
    return explain.model_permutation_impact(
        splits["test"], bundle.predict, "prediction", S.LENDING_FEATURES, [ID], encoded=encoded, changes=bundle.model.changes
    )

"""Column layouts, feature lists and domain constants.

Everything in this module is a fixed value: file layouts, column lists, sentinel codes, weights
and labels that results depend on.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: positional file layouts -------------------------------------------------

# name -> type each raw field is cast to after being read as text
ORIGINATION_FIELDS: dict[str, str] = {
    "credit_score": "int",
    "first_payment_date": "int",
    "first_time_homebuyer_indicator": "string",
    "maturity_date": "int",
    "msa": "int",
    "mortgage_insurance_pct": "int",
    "num_units": "int",
    "occupancy_status": "string",
    "cltv": "int",
    "dti": "int",
    "original_upb": "bigint",
    "ltv": "int",
    "interest_rate": "double",
    "channel": "string",
    "prepayment_penalty_indicator": "string",
    "amortization_type": "string",
    "property_state": "string",
    "property_type": "string",
    "postal_code": "int",
    "loan_identifier": "string",
    "loan_purpose": "string",
    "original_loan_term": "int",
    "num_borrowers": "int",
    "seller_name": "string",
    "servicer_name": "string",
    "super_conforming_flag": "string",
    "pre_harp_loan_sequence_number": "string",
    "program_indicator": "string",
    "harp_indicator": "string",
    "property_valuation_method": "int",
    "interest_only_indicator": "string",
    "mortgage_insurance_cancellation_indicator": "string",
}

PERFORMANCE_FIELDS: dict[str, str] = {
    "loan_identifier": "string",
    "reporting_period": "int",
    "current_actual_upb": "string",
    "current_loan_delinquency_status": "string",
    "loan_age": "int",
    "remaining_months_to_maturity": "int",
    "repurchase_flag": "string",
    "modification_flag": "string",
    "zero_balance_code": "string",
    "zero_balance_effective_date": "string",
    "current_interest_rate": "double",
    "current_deferred_upb": "string",
    "due_date_last_paid_installment": "string",
    "mi_recoveries": "string",
    "net_sales_proceeds": "string",
    "non_mi_recoveries": "string",
    "expenses": "string",
    "legal_costs": "string",
    "maintenance_costs": "string",
    "taxes_and_insurance": "string",
    "misc_expenses": "string",
    "actual_loss_calculation": "string",
    "modification_cost": "string",
    "step_modification_flag": "string",
    "deferred_payment_plan": "string",
    "estimated_ltv": "string",
    "zero_balance_removal_upb": "string",
    "delinquent_accrued_interest": "string",
    "delinquency_due_to_disaster": "string",
    "borrower_assistance_status": "string",
    "current_month_modification_cost": "string",
    "interest_bearing_upb": "string",
}

# Words that delimited-text readers commonly treat as "missing".
MISSING_WORDS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: cleaning ----------------------------------------------------------------

SENTINELS = {"credit_score": 9999, "dti": 999, "ltv": 999, "cltv": 999}
UNUSED_ORIGINATION = ["pre_harp_loan_sequence_number", "harp_indicator", "super_conforming_flag"]
ESTIMATED_LTV_CEILING = 300
DISTRESS_STATUS = "RA"

# --- Fixed values: scores ------------------------------------------------------------------

# column -> (weight, inverted)
BSS_COMPONENTS = {
    "credit_score": (0.40, False),
    "dti": (0.25, True),
    "interest_rate": (0.20, True),
    "num_borrowers": (0.10, False),
    "ltv": (0.05, True),
}
BSS_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]
NORM_COLUMNS = [f"{name}_norm" for name in BSS_COMPONENTS]

# --- Fixed values: column groups -----------------------------------------------------------

ID_COLUMN = "loan_identifier"

ROLLUP_FEATURES = [
    "max_delinquency", "avg_delinquency", "months_delinquent", "loan_age_max", "loan_age_avg",
    "remaining_term_avg", "current_rate_avg", "current_rate_max", "current_rate_min",
    "estimated_ltv_avg", "estimated_ltv_max", "ever_modified", "modification_count",
    "ever_assistance", "assistance_count", "ever_zero_balance", "rate_volatility",
]

# objective -> columns withheld from that objective's store (the loan id is always withheld)
OBJECTIVE_DROPS: dict[str, list[str]] = {
    "stress_prediction": [
        "stress_level", "bssi", "bss", "bss_bucket", "bss_level",
        "max_delinquency", "avg_delinquency", "months_delinquent",
        "ever_modified", "ever_assistance", "modification_count", "assistance_count",
        "delinquency_intensity", "modification_intensity", "assistance_intensity",
        "ever_ra", "ever_zero_balance",
        "loan_age_max", "loan_age_avg", "remaining_term_avg",
        "current_rate_avg", "current_rate_max", "current_rate_min",
        "estimated_ltv_avg", "estimated_ltv_max", "rate_volatility", "eltv_drift",
        "serviceability_score",
    ],
    "stress_severity": ["stress_flag", "bssi", "bss", "bss_bucket", "bss_level"],
    "serviceability": ["stress_flag", "stress_level", "bssi", "bss", "bss_bucket"],
    "explainability": [],
}
OBJECTIVE_TARGETS = {
    "stress_prediction": "stress_flag",
    "stress_severity": "stress_level",
    "serviceability": "bss_level",
}

LABEL_LEAKAGE = ["max_delinquency", "ever_ra", "ever_modified", "ever_assistance"]
UNUSABLE = ["pre_harp_loan_sequence_number", "postal_code"]
ENGINEERED = [*NORM_COLUMNS, "bss", "bss_bucket", "bss_level"]

LEAKAGE_CANDIDATES = [
    "max_delinquency", "avg_delinquency", "months_delinquent",
    "modification_count", "assistance_count", "delinquency_intensity",
]

MASTER_REQUIRED = ["loan_identifier", "stress_flag", "bssi", "bss", "bss_bucket", "bss_level"]

# Lending models: 20 underwriting features
LENDING_NUMERIC = [
    "credit_score", "dti", "num_borrowers", "num_units", "ltv", "cltv",
    "mortgage_insurance_pct", "quarter_num",
]
LENDING_CATEGORICAL = [
    "first_time_homebuyer_indicator", "occupancy_status", "property_type", "property_state",
    "msa", "channel", "loan_purpose", "program_indicator", "property_valuation_method",
    "interest_only_indicator", "mortgage_insurance_cancellation_indicator", "quarter",
]
LENDING_FEATURES = [*LENDING_NUMERIC, *LENDING_CATEGORICAL]
LENDING_TARGETS = {
    "loan_amount": "original_upb",
    "interest_rate": "interest_rate",
    "loan_term": "original_loan_term",
}

# Older stress-model preparation
STRESS_PREP_REMOVE = [
    "loan_identifier", "year", "quarter", "quarter_num", "bssi",
    "prepayment_penalty_indicator", "amortization_type", "property_valuation_method",
    "interest_only_indicator",
]
TIME_COLUMNS = ["quarter", "year", "quarter_num"]

MISSING_CATEGORY = "UNKNOWN"

# --- Fixed values: batch applications --------------------------------------------------------

STANDARD_TERMS = [120, 180, 240, 300, 360]
TERM_CLASSES = {180: 15, 360: 30}
OTHER_TERM_CLASS = 99
TERM_CLASS_MONTHS = {15: 180, 30: 360, 99: 360}
CLASS_TERM_MODELS = ["v4_catboost", "v4_stacked"]
MODEL_CHOICES = ["v4_stacked", "v4_catboost", "smart_tree", "fast_linear"]
AMOUNT_BOUNDS = (10_000, 2_000_000)
AMOUNT_STEP = 1_000
RATE_BOUNDS = (0.0, 20.0)

APPLICATION_RANGES = {
    "credit_score": (300, 850),
    "dti": (0, 65),
    "ltv": (1, 110),
    "cltv": (1, 150),
    "mortgage_insurance_pct": (0, 55),
    "num_borrowers": (1, 5),
    "num_units": (1, 4),
}
APPLICATION_CHOICES = {
    "model_selection": MODEL_CHOICES,
    "occupancy_status": ["P", "S", "I"],
    "property_type": ["SF", "PU", "CO", "MH", "CP"],
    "channel": ["R", "C", "B"],
    "loan_purpose": ["P", "C", "N"],
}
APPLICATION_LENGTHS = {"property_state": (2, 2), "msa": (1, 8)}
APPLICATION_DEFAULTS = {
    "model_selection": "v4_stacked", "credit_score": 740, "dti": 35.0, "ltv": 80.0, "cltv": 80.0,
    "mortgage_insurance_pct": 0.0, "num_borrowers": 1, "num_units": 1,
    "first_time_homebuyer": False, "occupancy_status": "P", "property_type": "SF",
    "property_state": "CA", "msa": "0", "channel": "R", "loan_purpose": "P",
}
APPLICATION_CONSTANTS = {
    "quarter_num": 4,
    "program_indicator": "9",
    "property_valuation_method": "7",
    "interest_only_indicator": "N",
    "mortgage_insurance_cancellation_indicator": "7",
    "quarter": "2018Q4",
}

FEATURE_LABELS = {
    "credit_score": "Credit score",
    "dti": "Debt-to-income ratio",
    "num_borrowers": "Number of borrowers",
    "num_units": "Property units",
    "ltv": "Loan-to-value ratio",
    "cltv": "Combined loan-to-value ratio",
    "mortgage_insurance_pct": "Mortgage insurance",
    "quarter_num": "Origination quarter",
    "first_time_homebuyer_indicator": "First-time homebuyer",
    "occupancy_status": "Occupancy",
    "property_type": "Property type",
    "property_state": "Property state",
    "msa": "Metro area",
    "channel": "Origination channel",
    "loan_purpose": "Loan purpose",
    "program_indicator": "Program indicator",
    "property_valuation_method": "Property valuation method",
    "interest_only_indicator": "Interest-only indicator",
    "mortgage_insurance_cancellation_indicator": "Mortgage insurance cancellation",
    "quarter": "Origination quarter",
    "dti_ltv_interaction": "DTI × LTV interaction",
    "credit_risk_multiplier": "Credit-risk multiplier",
}


def text_schema(fields: dict[str, str]) -> T.StructType:
    """All-string schema for a positional text layout."""
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])

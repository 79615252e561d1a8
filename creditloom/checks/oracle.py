"""The registered queries as plain SQL, for an independent engine to run on the same tables."""

from __future__ import annotations

from creditloom import schemas as S
from creditloom.checks import queries as Q

ORACLES: dict[str, str] = {}

# --- building blocks: common table expressions -------------------------------------------------------

CTES: dict[str, str] = {}

CTES["orig"] = """
SELECT
  o_orderkey AS loan_identifier,
  CAST(CASE WHEN o_orderkey % 97 = 0 THEN 9999 ELSE 500 + (o_orderkey * 31) % 351 END AS INTEGER) AS credit_score,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS first_payment_date,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS first_time_homebuyer_indicator,
  CAST(floor((year(o_orderdate) * 12 + month(o_orderdate) - 1 + term) / 12.0) * 100
    + (year(o_orderdate) * 12 + month(o_orderdate) - 1 + term) % 12 + 1 AS INTEGER) AS maturity_date,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 10000 + (c_custkey % 40) * 100 END AS INTEGER) AS msa,
  CAST(CASE WHEN ltv BETWEEN 81 AND 998 THEN 25 ELSE 0 END AS INTEGER) AS mortgage_insurance_pct,
  CAST(CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 1 END AS INTEGER) AS num_units,
  CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'I' END AS occupancy_status,
  CAST(CASE WHEN o_orderkey % 211 = 0 THEN 999 ELSE ltv + (o_orderkey % 4) * 5 END AS INTEGER) AS cltv,
  CAST(CASE WHEN o_orderkey % 53 = 0 THEN 999 ELSE 1 + (o_orderkey * 17) % 50 END AS INTEGER) AS dti,
  CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000 AS original_upb,
  ltv,
  CAST(240 + (o_orderkey * 7) % 200 AS DOUBLE) / 80 AS interest_rate,
  substr(o_orderpriority, 1, 1) AS channel,
  'N' AS prepayment_penalty_indicator,
  'FRM' AS amortization_type,
  n_name AS property_state,
  c_mktsegment AS property_type,
  CAST((c_custkey % 999) * 100 AS INTEGER) AS postal_code,
  CASE o_orderkey % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'N' END AS loan_purpose,
  term AS original_loan_term,
  CAST(1 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS INTEGER) AS num_borrowers,
  'Seller_' || CAST(o_orderkey % 25 AS VARCHAR) AS seller_name,
  'Servicer_' || CAST(o_orderkey % 24 AS VARCHAR) AS servicer_name,
  CASE WHEN o_orderkey % 31 = 0 THEN 'Y' END AS super_conforming_flag,
  CAST(NULL AS VARCHAR) AS pre_harp_loan_sequence_number,
  CASE WHEN o_orderkey % 9 = 0 THEN 'H' WHEN o_orderkey % 200 = 0 THEN 'F' ELSE '9' END AS program_indicator,
  CASE WHEN o_orderkey % 77 = 0 THEN 'Y' END AS harp_indicator,
  CAST(CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 7 END AS INTEGER) AS property_valuation_method,
  'N' AS interest_only_indicator,
  CASE o_orderkey % 3 WHEN 0 THEN '7' WHEN 1 THEN 'N' ELSE 'Y' END AS mortgage_insurance_cancellation_indicator,
  CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS "quarter"
FROM (
  SELECT *,
    CAST(CASE WHEN o_orderkey % 10 = 0 THEN 120 WHEN o_orderkey % 10 = 1 THEN 240 WHEN o_orderkey % 10 = 2 THEN 300
      WHEN o_orderkey % 10 IN (3, 4) THEN 180 ELSE 360 END AS INTEGER) AS term,
    CAST(CASE WHEN o_orderkey % 211 = 0 THEN 999 ELSE 30 + (o_orderkey * 13) % 71 END AS INTEGER) AS ltv
  FROM orders
) o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""

CTES["perf"] = """
SELECT
  l_orderkey AS loan_identifier,
  CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS reporting_period,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 49 THEN 'RA'
    WHEN l_quantity >= 46 THEN CAST(CAST((l_quantity - 45) * 2 AS INTEGER) AS VARCHAR) ELSE '0' END AS current_loan_delinquency_status,
  CAST(r % 92 AS INTEGER) AS loan_age,
  CAST(360 - r % 92 AS INTEGER) AS remaining_months_to_maturity,
  CASE WHEN r % 61 = 0 THEN 'Y' END AS modification_flag,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN '01' END AS zero_balance_code,
  CAST(240 + (l_orderkey * 7) % 200 - (r % 5) AS DOUBLE) / 80 AS current_interest_rate,
  CASE WHEN r % 13 = 0 THEN '999' WHEN r % 29 = 0 THEN '' ELSE CAST(20 + r % 130 AS VARCHAR) END AS estimated_ltv,
  CASE WHEN r % 17 = 0 THEN 'F' END AS borrower_assistance_status
FROM (SELECT *, l_partkey * 7 + l_suppkey * 3 + l_linenumber AS r FROM lineitem) l
"""

CTES["clean"] = """
SELECT * EXCLUDE (pre_harp_loan_sequence_number, harp_indicator, super_conforming_flag)
  REPLACE (nullif(credit_score, 9999) AS credit_score, nullif(dti, 999) AS dti, nullif(ltv, 999) AS ltv, nullif(cltv, 999) AS cltv)
FROM orig
"""

CTES["lab"] = """
SELECT *, CASE WHEN bssi > 0 THEN 1 ELSE 0 END AS stress_flag, CASE WHEN bssi >= 2 THEN 2 ELSE bssi END AS stress_level
FROM (
  SELECT *, CASE WHEN ever_ra THEN 3 WHEN max_delinquency >= 6 THEN 2 WHEN ever_modified THEN 2
    WHEN ever_assistance THEN 1 WHEN max_delinquency >= 1 THEN 1 ELSE 0 END AS bssi
  FROM (
    SELECT loan_identifier,
      max(CASE WHEN current_loan_delinquency_status <> 'RA' THEN CAST(current_loan_delinquency_status AS INTEGER) END) AS max_delinquency,
      bool_or(current_loan_delinquency_status = 'RA') AS ever_ra,
      bool_or(modification_flag IS NOT NULL) AS ever_modified,
      bool_or(borrower_assistance_status IS NOT NULL) AS ever_assistance
    FROM perf GROUP BY loan_identifier
  ) a
) b
"""

CTES["feat"] = """
SELECT *, current_rate_max - current_rate_min AS rate_volatility FROM (
  SELECT loan_identifier,
    max(d) AS max_delinquency, avg(d) AS avg_delinquency, count(*) FILTER (WHERE d > 0) AS months_delinquent,
    max(loan_age) AS loan_age_max, avg(loan_age) AS loan_age_avg,
    avg(remaining_months_to_maturity) AS remaining_term_avg,
    avg(current_interest_rate) AS current_rate_avg, max(current_interest_rate) AS current_rate_max,
    min(current_interest_rate) AS current_rate_min,
    avg(e) AS estimated_ltv_avg, max(e) AS estimated_ltv_max,
    max(m) AS ever_modified, CAST(sum(m) AS BIGINT) AS modification_count,
    max(b) AS ever_assistance, CAST(sum(b) AS BIGINT) AS assistance_count, max(z) AS ever_zero_balance
  FROM (
    SELECT *,
      coalesce(TRY_CAST(current_loan_delinquency_status AS DOUBLE), 0) AS d,
      CASE WHEN TRY_CAST(estimated_ltv AS DOUBLE) <= 300 THEN TRY_CAST(estimated_ltv AS DOUBLE) END AS e,
      CASE WHEN modification_flag IS NULL THEN 0 ELSE 1 END AS m,
      CASE WHEN borrower_assistance_status IS NULL THEN 0 ELSE 1 END AS b,
      CASE WHEN zero_balance_code IS NULL THEN 0 ELSE 1 END AS z
    FROM perf
  ) p GROUP BY loan_identifier
) f
"""

CTES["labelled"] = "SELECT * FROM clean JOIN lab USING (loan_identifier)"

CTES["loans"] = """
SELECT c.*, l.ever_ra, l.bssi, l.stress_flag, l.stress_level, f.* EXCLUDE (loan_identifier)
FROM clean c JOIN lab l ON c.loan_identifier = l.loan_identifier LEFT JOIN feat f ON f.loan_identifier = c.loan_identifier
"""

CTES["normed"] = """
SELECT *, (0.40 * credit_score_norm + 0.25 * dti_norm + 0.20 * interest_rate_norm + 0.10 * num_borrowers_norm
  + 0.05 * ltv_norm) * 100 AS bss
FROM (
  SELECT l.*,
    CAST(credit_score - cs0 AS DOUBLE) / nullif(CAST(cs1 - cs0 AS DOUBLE), 0) AS credit_score_norm,
    1 - CAST(dti - d0 AS DOUBLE) / nullif(CAST(d1 - d0 AS DOUBLE), 0) AS dti_norm,
    1 - (interest_rate - r0) / nullif(r1 - r0, 0) AS interest_rate_norm,
    CAST(num_borrowers - b0 AS DOUBLE) / nullif(CAST(b1 - b0 AS DOUBLE), 0) AS num_borrowers_norm,
    1 - CAST(ltv - l0 AS DOUBLE) / nullif(CAST(l1 - l0 AS DOUBLE), 0) AS ltv_norm
  FROM loans l JOIN (
    SELECT "quarter" AS bq, min(credit_score) AS cs0, max(credit_score) AS cs1, min(dti) AS d0, max(dti) AS d1,
      min(interest_rate) AS r0, max(interest_rate) AS r1, min(num_borrowers) AS b0, max(num_borrowers) AS b1,
      min(ltv) AS l0, max(ltv) AS l1
    FROM loans GROUP BY "quarter"
  ) b ON l."quarter" = b.bq
) n
"""

CTES["scored"] = """
SELECT n.*, CASE WHEN bss IS NULL THEN NULL WHEN bss <= e1 THEN 1 WHEN bss <= e2 THEN 2 WHEN bss <= e3 THEN 3
    WHEN bss <= e4 THEN 4 ELSE 5 END AS bss_level,
  CASE WHEN bss IS NULL THEN NULL WHEN bss <= e1 THEN 'Very Low' WHEN bss <= e2 THEN 'Low' WHEN bss <= e3 THEN 'Medium'
    WHEN bss <= e4 THEN 'High' ELSE 'Very High' END AS bss_bucket
FROM normed n JOIN (
  SELECT "quarter" AS eq, quantile_cont(bss, 0.2) AS e1, quantile_cont(bss, 0.4) AS e2,
    quantile_cont(bss, 0.6) AS e3, quantile_cont(bss, 0.8) AS e4
  FROM normed GROUP BY "quarter"
) e ON n."quarter" = e.eq
"""

CTES["master"] = """
SELECT *,
  months_delinquent / CAST(CASE WHEN loan_age_max = 0 THEN 1 ELSE loan_age_max END AS DOUBLE) AS delinquency_intensity,
  modification_count / CAST(CASE WHEN loan_age_max = 0 THEN 1 ELSE loan_age_max END AS DOUBLE) AS modification_intensity,
  assistance_count / CAST(CASE WHEN loan_age_max = 0 THEN 1 ELSE loan_age_max END AS DOUBLE) AS assistance_intensity,
  estimated_ltv_avg - ltv AS eltv_drift,
  CAST(substr("quarter", 1, 4) AS INTEGER) AS "year",
  CAST(right("quarter", 1) AS INTEGER) AS quarter_num,
  credit_score / 850.0::DOUBLE * 40 + (1 - CASE WHEN dti / 60.0::DOUBLE > 1 THEN 1 ELSE dti / 60.0::DOUBLE END) * 30
    + (1 - ltv / 100.0::DOUBLE) * 20 + num_borrowers / 4.0::DOUBLE * 10 AS serviceability_score
FROM scored
"""

CTES["lend"] = """
SELECT *, ln(1 + CAST(original_upb AS DOUBLE)) AS target_amount, CAST(right("quarter", 1) AS INTEGER) AS quarter_num
FROM clean WHERE loan_identifier IN (SELECT loan_identifier FROM perf)
"""

_NEEDS = {
    "orig": [], "perf": [], "clean": ["orig"], "lab": ["perf"], "feat": ["perf"], "labelled": ["clean", "lab"],
    "loans": ["clean", "lab", "feat"], "normed": ["loans"], "scored": ["normed"], "master": ["scored"],
    "lend": ["clean", "perf"],
}


def _in_order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_in_order(_NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def sql(name: str, needs: list[str], body: str, extra: dict[str, str] | None = None) -> None:
    """Register ``body`` with the shared tables it reads and any tables of its own."""
    ctes = {n: CTES[n] for n in _in_order(needs)} | (extra or {})
    ORACLES[name] = "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + "\n" + body


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1e-9, 6) AS {name or expr}"


def r4(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 4) AS {name or expr}"


def quarters(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


TRAIN, VALID, TEST = quarters(Q.TRAIN_QUARTERS), quarters(Q.VALID_QUARTERS), quarters(Q.TEST_QUARTERS)
IN_TRAIN = f'"quarter" IN {TRAIN}'

# --- column lists ---------------------------------------------------------------------------------------

ORIG_COLUMNS = [c for c in S.ORIGINATION_FIELDS if c not in S.UNUSED_ORIGINATION]
DOUBLES = {
    "interest_rate", "max_delinquency", "avg_delinquency", "loan_age_avg", "remaining_term_avg", "current_rate_avg",
    "current_rate_max", "current_rate_min", "estimated_ltv_avg", "estimated_ltv_max", "rate_volatility",
    *S.NORM_COLUMNS, "bss", "delinquency_intensity", "modification_intensity", "assistance_intensity", "eltv_drift",
    "serviceability_score",
}
LOAN_COLUMNS = [*ORIG_COLUMNS, "quarter", "ever_ra", "bssi", "stress_flag", "stress_level", *S.ROLLUP_FEATURES]
MASTER_COLUMNS = [
    *LOAN_COLUMNS, *S.NORM_COLUMNS, "bss", "bss_bucket", "bss_level", "delinquency_intensity", "modification_intensity",
    "assistance_intensity", "eltv_drift", "year", "quarter_num", "serviceability_score",
]
LOAN_NUMERIC = [
    c for c in LOAN_COLUMNS
    if c != "loan_identifier" and (
        c in DOUBLES or c in {"bssi", "stress_flag", "stress_level", *S.ROLLUP_FEATURES}
        or S.ORIGINATION_FIELDS.get(c) in ("int", "bigint", "double")
    )
]


def cols(names: list[str]) -> str:
    return ", ".join(r6(n) if n in DOUBLES else f'"{n}"' for n in names)


def without(names: list[str], *drops: list[str]) -> list[str]:
    gone = {c for d in drops for c in d}
    return [n for n in names if n not in gone]


# --- sources ----------------------------------------------------------------------------------------------

sql("read_origination", ["orig"], 'SELECT * EXCLUDE ("quarter") REPLACE (CAST(loan_identifier AS VARCHAR) AS loan_identifier) FROM orig')
sql(
    "read_performance", ["perf"],
    "SELECT * REPLACE (CAST(loan_identifier AS VARCHAR) AS loan_identifier, nullif(estimated_ltv, '') AS estimated_ltv), "
    + ", ".join(
        f"CAST(NULL AS VARCHAR) AS {c}" for c in S.PERFORMANCE_FIELDS
        if c not in (
            "loan_identifier", "reporting_period", "current_loan_delinquency_status", "loan_age",
            "remaining_months_to_maturity", "modification_flag", "zero_balance_code", "current_interest_rate",
            "estimated_ltv", "borrower_assistance_status",
        )
    )
    + " FROM perf",
)
sql(
    "quarter_columns", ["orig"],
    """SELECT loan_identifier, 'historical_data_' || "quarter" || '.txt' AS file_name, "quarter",
    CAST(substr("quarter", 1, 4) AS INTEGER) AS "year", CAST(substr("quarter", 6, 1) AS INTEGER) AS quarter_num FROM orig""",
)
sql(
    "feature_store_manifest", ["clean", "lab"],
    """SELECT 'v1' AS version, o.objective, n.n AS "rows", o.columns AS "columns", 66 AS master_columns
    FROM (SELECT count(*) AS n FROM clean JOIN lab USING (loan_identifier)) n,
    (VALUES ('stress_prediction', 37), ('stress_severity', 60), ('serviceability', 60), ('explainability', 65)) o(objective, columns)""",
)

# --- rules ------------------------------------------------------------------------------------------------

sql(
    "sentinel_to_null", ["orig"],
    """SELECT loan_identifier, CASE WHEN credit_score <> 9999 THEN credit_score END AS credit_score,
    CASE WHEN dti <> 999 THEN dti END AS dti, CASE WHEN ltv <> 999 THEN ltv END AS ltv,
    CASE WHEN cltv <> 999 THEN cltv END AS cltv FROM orig""",
)
sql("drop_leakage_columns", ["labelled"], f"SELECT {cols([*without(ORIG_COLUMNS, S.UNUSABLE), 'quarter', 'bssi', 'stress_flag', 'stress_level'])} FROM labelled")
sql("coerce_numeric", ["perf"], "SELECT loan_identifier, reporting_period, CASE WHEN current_loan_delinquency_status = 'RA' THEN 0.0::DOUBLE ELSE CAST(current_loan_delinquency_status AS DOUBLE) END AS delinquency FROM perf")
sql("cap_to_null", ["perf"], "SELECT loan_identifier, reporting_period, CASE WHEN estimated_ltv IN ('', '999') THEN NULL ELSE CAST(estimated_ltv AS DOUBLE) END AS estimated_ltv FROM perf")
sql(
    "presence_flags", ["perf"],
    """SELECT loan_identifier, reporting_period, CAST(modification_flag IS NOT NULL AS INTEGER) AS modified_flag,
    CAST(borrower_assistance_status IS NOT NULL AS INTEGER) AS assistance_flag,
    CAST(zero_balance_code IS NOT NULL AS INTEGER) AS zero_balance_flag FROM perf""",
)
sql("bssi_ladder", ["lab"], "SELECT loan_identifier, bssi FROM lab")
sql("stress_flag", ["lab"], "SELECT loan_identifier, stress_flag FROM lab")
sql("stress_level", ["lab"], "SELECT loan_identifier, stress_level FROM lab")
sql("minmax_norm", ["normed"], f"SELECT {cols(['loan_identifier', *S.NORM_COLUMNS])} FROM normed")
sql("bss_score", ["normed"], f"SELECT {cols(['loan_identifier', 'bss'])} FROM normed")
sql(
    "serviceability_score", ["clean"],
    "SELECT loan_identifier, " + r6(
        "(credit_score / 850.0::DOUBLE * 40 + (1 - CASE WHEN dti >= 60 THEN 1 ELSE dti / 60.0::DOUBLE END) * 30"
        " + (1 - ltv / 100.0::DOUBLE) * 20 + num_borrowers / 4.0::DOUBLE * 10)", "serviceability_score"
    ) + " FROM clean",
)
_AGE = "CAST(CASE WHEN loan_age_max = 0 THEN 1 ELSE loan_age_max END AS DOUBLE)"
sql(
    "intensity_ratios", ["loans"],
    f"""SELECT loan_identifier, {r6(f'months_delinquent / {_AGE}', 'delinquency_intensity')},
    {r6(f'modification_count / {_AGE}', 'modification_intensity')}, {r6(f'assistance_count / {_AGE}', 'assistance_intensity')} FROM loans""",
)
sql("eltv_drift", ["loans"], f"SELECT loan_identifier, {r6('(estimated_ltv_avg - ltv)', 'eltv_drift')} FROM loans")
sql("rate_volatility", ["feat"], f"SELECT loan_identifier, {r6('rate_volatility')} FROM feat")
sql(
    "remaining_term_months", ["orig"],
    """SELECT loan_identifier, first_payment_date, maturity_date, CAST((maturity_date // 100 - first_payment_date // 100) * 12
    + (maturity_date % 100 - first_payment_date % 100) AS INTEGER) AS remaining_term_months FROM orig""",
)
sql(
    "interaction_features", ["clean"],
    f"""SELECT loan_identifier, {r6('CAST(coalesce(dti, 0) * coalesce(ltv, 0) AS DOUBLE)', 'dti_ltv_interaction')},
    {r6('CAST(coalesce(credit_score, 0) AS DOUBLE) / (coalesce(dti, 0) + 1.0::DOUBLE)', 'credit_risk_multiplier')} FROM clean""",
)
_LEND = ", ".join(f'"{c}"' for c in S.LENDING_FEATURES)
sql("lending_store_amount", ["lend"], f"SELECT {_LEND}, {r6('target_amount', 'target')} FROM lend")
sql("lending_store_rate", ["lend"], f"SELECT {_LEND}, {r6('interest_rate', 'target')} FROM lend")
sql("lending_store_term", ["lend"], f"SELECT {_LEND}, original_loan_term AS target FROM lend")
for _objective, _drops in S.OBJECTIVE_DROPS.items():
    sql(f"store_{_objective}", ["master"], f"SELECT {cols(without(MASTER_COLUMNS, ['loan_identifier'], _drops))} FROM master")
sql("variant_baseline", ["master"], f"SELECT {cols(without(MASTER_COLUMNS, S.LABEL_LEAKAGE, S.UNUSABLE, S.ENGINEERED))} FROM master")
sql("variant_bss", ["master"], f"SELECT {cols(without(MASTER_COLUMNS, S.LABEL_LEAKAGE, S.UNUSABLE, S.NORM_COLUMNS))} FROM master")
sql("drop_null_target", ["scored"], "SELECT loan_identifier, bss_level FROM scored WHERE bss_level IS NOT NULL")

CTES["prepared"] = (
    "SELECT loan_identifier, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in S.LENDING_NUMERIC) + ", "
    + ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), 'UNKNOWN') AS "{c}" """ for c in S.LENDING_CATEGORICAL)
    + ", target_amount FROM lend"
)
_NEEDS["prepared"] = ["lend"]
sql("prepare_frame", ["prepared"], "SELECT * EXCLUDE (target_amount) FROM prepared")
sql(
    "median_fill", ["orig"],
    "SELECT CAST(loan_identifier AS VARCHAR) AS loan_identifier, \"quarter\", "
    + ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM s WHERE {IN_TRAIN})) AS {c}"
        for c in ("credit_score", "dti", "ltv", "cltv", "msa")
    )
    + ", coalesce(super_conforming_flag, 'UNKNOWN') AS super_conforming_flag FROM s",
    {"s": "SELECT * REPLACE (nullif(credit_score, 9999) AS credit_score, nullif(dti, 999) AS dti, nullif(ltv, 999) AS ltv, nullif(cltv, 999) AS cltv) FROM orig"},
)
sql("term_class", ["orig"], "SELECT loan_identifier, CASE original_loan_term WHEN 180 THEN 15 WHEN 360 THEN 30 ELSE 99 END AS term_class FROM orig")
_AMOUNT_GUESS = "(ln(1 + CAST(original_upb AS DOUBLE)) + (loan_identifier % 21 - 10) / 100.0::DOUBLE)"
sql(
    "score_amount", ["orig"],
    f"""SELECT loan_identifier, CAST(round_even(least(greatest(exp({_AMOUNT_GUESS}) - 1, 10000), 2000000) / 1000, 0) * 1000 AS BIGINT)
    AS estimated_loan_amount FROM orig""",
)
_SNAP = "CASE WHEN {x} <= 150 THEN 120 WHEN {x} <= 210 THEN 180 WHEN {x} <= 270 THEN 240 WHEN {x} <= 330 THEN 300 ELSE 360 END"
sql(
    "snap_term", ["orig"],
    f"""SELECT loan_identifier, {_SNAP.format(x='(original_loan_term + loan_identifier % 61 - 30)')} AS from_months,
    CASE WHEN original_loan_term = 180 THEN 180 ELSE 360 END AS from_class FROM orig""",
)
sql(
    "score_rate", ["orig"],
    """SELECT loan_identifier, round_even(least(greatest(interest_rate + (loan_identifier % 20 - 9.5::DOUBLE) / 7.3::DOUBLE
      + CASE WHEN loan_identifier % 50 = 0 THEN 30 ELSE 0 END, 0), 20), 2) AS estimated_interest_rate,
    round_even((original_loan_term + loan_identifier % 7) / 12.0::DOUBLE, 1) AS term_years FROM orig""",
)

CTES["app"] = """
SELECT loan_identifier,
  CASE loan_identifier % 5 WHEN 0 THEN 'v4_stacked' WHEN 1 THEN 'v4_catboost' WHEN 2 THEN 'smart_tree' WHEN 3 THEN 'fast_linear' ELSE 'unknown' END AS model_selection,
  credit_score, dti, ltv, cltv, mortgage_insurance_pct, num_borrowers, num_units,
  loan_identifier % 5 = 0 AS first_time_homebuyer, occupancy_status,
  CASE loan_identifier % 6 WHEN 0 THEN 'SF' WHEN 1 THEN 'PU' WHEN 2 THEN 'CO' WHEN 3 THEN 'MH' WHEN 4 THEN 'CP' ELSE 'XX' END AS property_type,
  lower(substr(property_state, 1, 2)) AS property_state, coalesce(CAST(msa AS VARCHAR), '0') AS msa,
  CASE loan_identifier % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'C' ELSE 'B' END AS channel, loan_purpose
FROM orig
"""
_NEEDS["app"] = ["orig"]
_RULES = {
    "credit_score": "credit_score BETWEEN 300 AND 850", "dti": "dti BETWEEN 0 AND 65", "ltv": "ltv BETWEEN 1 AND 110",
    "cltv": "cltv BETWEEN 1 AND 150", "mortgage_insurance_pct": "mortgage_insurance_pct BETWEEN 0 AND 55",
    "num_borrowers": "num_borrowers BETWEEN 1 AND 5", "num_units": "num_units BETWEEN 1 AND 4",
    "model_selection": "model_selection IN ('v4_stacked', 'v4_catboost', 'smart_tree', 'fast_linear')",
    "occupancy_status": "occupancy_status IN ('P', 'S', 'I')", "property_type": "property_type IN ('SF', 'PU', 'CO', 'MH', 'CP')",
    "channel": "channel IN ('R', 'C', 'B')", "loan_purpose": "loan_purpose IN ('P', 'C', 'N')",
    "property_state": "length(property_state) = 2", "msa": "length(msa) BETWEEN 1 AND 8",
}
CTES["checked"] = "SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN NULL ELSE '{n}' END" for n, rule in _RULES.items()) + ") AS violations FROM app"
_NEEDS["checked"] = ["app"]
sql("validate_applications", ["checked"], "SELECT loan_identifier, violations = '' AS accepted, violations FROM checked")
sql(
    "application_features", ["checked"],
    """SELECT loan_identifier, credit_score, dti, num_borrowers, num_units, ltv, cltv, mortgage_insurance_pct, 4 AS quarter_num,
    CASE WHEN first_time_homebuyer THEN 'Y' ELSE 'N' END AS first_time_homebuyer_indicator, occupancy_status, property_type,
    upper(property_state) AS property_state, CASE WHEN msa = '0' THEN 'UNKNOWN' ELSE msa END AS msa, channel, loan_purpose,
    '9' AS program_indicator, '7' AS property_valuation_method, 'N' AS interest_only_indicator,
    '7' AS mortgage_insurance_cancellation_indicator, '2018Q4' AS "quarter" FROM checked WHERE violations = ''""",
)

# --- joins ----------------------------------------------------------------------------------------------------

sql("join_inner", ["labelled"], 'SELECT loan_identifier, "quarter", credit_score, original_upb, max_delinquency, ever_ra, ever_modified, ever_assistance, bssi, stress_flag, stress_level FROM labelled')
sql("join_left_resolve", ["lab", "feat"], f"SELECT {cols(['loan_identifier', 'ever_ra', 'bssi', 'stress_flag', 'stress_level', *S.ROLLUP_FEATURES])} FROM (SELECT l.ever_ra, l.bssi, l.stress_flag, l.stress_level, f.* FROM lab l LEFT JOIN feat f USING (loan_identifier)) j")
sql(
    "reconcile_keys", [],
    """SELECT (SELECT count(DISTINCT o_orderkey) FROM orders) AS left_keys, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_keys,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) x) AS left_only,
    (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders) y) AS right_only,
    (SELECT count(DISTINCT o_orderkey) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS counts_match""",
    {"one": "SELECT 1"},
)


def long_values(names: list[str], source: str, where: str = "TRUE", keep: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {keep} '{c}' AS "column", CAST("{c}" AS VARCHAR) AS "value" FROM {source} WHERE {where}""" for c in names
    )


sql(
    "unseen_categories", ["clean"],
    " UNION ALL ".join(
        f"""SELECT '{name}' AS split, * FROM (({long_values(Q.SEEN_COLUMNS, 'clean', f'"quarter" IN {quarters}')}) EXCEPT ({long_values(Q.SEEN_COLUMNS, 'clean', IN_TRAIN)})) u
        WHERE "value" IS NOT NULL"""
        for name, quarters in (("valid", VALID), ("test", TEST))
    ),
)
sql(
    "ordinal_encode", ["prepared"],
    "SELECT loan_identifier, "
    + ", ".join(f'CAST(coalesce({c}_t.code, -1) AS INTEGER) AS {c}_code' for c in S.LENDING_CATEGORICAL)
    + " FROM prepared p "
    + " ".join(
        f"""LEFT JOIN (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "{c}" AS v FROM prepared WHERE {IN_TRAIN}) d) {c}_t
        ON p."{c}" = {c}_t.v"""
        for c in S.LENDING_CATEGORICAL
    ),
)
_FOLD = "CAST(CAST('0x' || substr(md5('42:fold|' || CAST(loan_identifier AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER)"
_ENC = "CASE WHEN c.n IS NULL OR c.n = 0 THEN g.m WHEN g.v * c.n + c.v = 0 THEN g.m ELSE (g.v * c.n / (g.v * c.n + c.v)) * c.m + (1 - g.v * c.n / (g.v * c.n + c.v)) * g.m END"


def _encoded(c: str) -> str:
    out_of_fold = f"""SELECT f.fold, t."{c}" AS val, count(*) AS n, avg(t.target_amount) AS m, var_pop(t.target_amount) AS v
      FROM folds f JOIN tr t ON t.fold <> f.fold GROUP BY f.fold, t."{c}" """
    return f"""SELECT p.loan_identifier, {_ENC} AS e FROM tr p JOIN gf g ON g.fold = p.fold
      LEFT JOIN ({out_of_fold}) c ON c.fold = p.fold AND c.val = p."{c}"
    UNION ALL SELECT p.loan_identifier, {_ENC} AS e FROM prepared p CROSS JOIN ga g
      LEFT JOIN (SELECT "{c}" AS val, count(*) AS n, avg(target_amount) AS m, var_pop(target_amount) AS v FROM tr GROUP BY "{c}") c ON c.val = p."{c}"
    WHERE NOT (p.{IN_TRAIN})"""


sql(
    "target_encode", ["prepared"],
    "SELECT loan_identifier, " + ", ".join(r6(f"e_{c}.e", f"{c}_encoded") for c in Q.ENCODED)
    + f" FROM e_{Q.ENCODED[0]} " + " ".join(f"JOIN e_{c} USING (loan_identifier)" for c in Q.ENCODED[1:]),
    {
        "tr": f"SELECT *, {_FOLD} AS fold FROM prepared WHERE {IN_TRAIN}",
        "folds": "SELECT DISTINCT fold FROM tr",
        "gf": "SELECT f.fold, avg(t.target_amount) AS m, var_pop(t.target_amount) AS v FROM folds f JOIN tr t ON t.fold <> f.fold GROUP BY f.fold",
        "ga": "SELECT avg(target_amount) AS m, var_pop(target_amount) AS v FROM tr",
        **{f"e_{c}": _encoded(c) for c in Q.ENCODED},
    },
)

# --- aggregations ----------------------------------------------------------------------------------------------

sql("loan_labels", ["lab"], "SELECT * FROM lab")
sql("loan_performance_features", ["feat"], f"SELECT {cols(['loan_identifier', *S.ROLLUP_FEATURES])} FROM feat")
_TEXT = [c for c in LOAN_COLUMNS if c not in LOAN_NUMERIC and c != "loan_identifier"]


def per_column(names: list[str], source: str, expr: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {expr.format(c=f'"{c}"')} FROM {source}""" for c in names)


sql("cardinality", ["loans"], per_column(_TEXT, "loans", "count(DISTINCT {c}) AS unique_values"))
sql("target_distribution", ["lab"], f"""SELECT stress_level, count(*) AS "count", {r6('count(*) / (SELECT count(*) FROM lab)::DOUBLE', 'pct')} FROM lab GROUP BY stress_level""")
sql("value_counts_nulls", ["clean"], f"""SELECT msa, count(*) AS "count", {r6('count(*) / (SELECT count(*) FROM clean)::DOUBLE', 'pct')} FROM clean GROUP BY msa""")
sql("stress_rate_by_quarter", ["labelled"], f"""SELECT "quarter", count(*) AS "rows", {r6('avg(stress_flag)', 'avg_stress_flag')} FROM labelled GROUP BY "quarter" """)
sql("bss_by_quarter", ["normed"], f"""SELECT "quarter", count(*) AS "rows", {r6('avg(bss)', 'avg_bss')} FROM normed GROUP BY "quarter" """)
sql("features_by_bssi", ["loans"], 'SELECT bssi, count(*) AS "rows", ' + ", ".join(r6(f"avg({c})", f"avg_{c}") for c in LOAN_NUMERIC if c != "bssi") + " FROM loans GROUP BY bssi")
_DESCRIBE = (
    'count({c}) AS "count", ' + r6("avg({c})", '"mean"') + ", " + r6("stddev_samp({c})", '"std"') + ", "
    + r6("CAST(min({c}) AS DOUBLE)", '"min"') + ", "
    + ", ".join(r6(f"quantile_cont(CAST({{c}} AS DOUBLE), {p})", n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")))
    + ", " + r6("CAST(max({c}) AS DOUBLE)", '"max"')
)
sql(
    "describe_by_group", ["loans"],
    " UNION ALL ".join(
        f"""SELECT stress_flag, '{c}' AS "column", {_DESCRIBE.format(c=c)} FROM loans GROUP BY stress_flag"""
        for c in LOAN_NUMERIC if c != "stress_flag"
    ),
)
sql("numeric_summary", ["loans"], per_column(LOAN_NUMERIC, "loans", _DESCRIBE))
sql("missing_values", ["loans"], per_column(LOAN_COLUMNS, "loans", "count(*) - count({c}) AS missing_count, " + r6("(count(*) - count({c})) * 100.0::DOUBLE / count(*)", "missing_pct")))
sql(
    "dataset_summary", ["loans"],
    f"""SELECT 'Rows' AS metric, count(*) AS "value" FROM loans UNION ALL SELECT 'Columns', {len(LOAN_COLUMNS)}
    UNION ALL SELECT 'Numeric Columns', {len(LOAN_NUMERIC) + 1} UNION ALL SELECT 'Categorical Columns', {len(_TEXT)}
    UNION ALL SELECT 'Missing Cells', CAST(sum({' + '.join(f'CAST("{c}" IS NULL AS INTEGER)' for c in LOAN_COLUMNS)}) AS BIGINT) FROM loans""",
)
_PAIRS = [(a, b) for i, a in enumerate(LOAN_NUMERIC) for b in LOAN_NUMERIC[i + 1 :]]
sql(
    "correlation_matrix", ["loans"],
    "SELECT feature_a, feature_b, corr FROM (SELECT unnest(["
    + ", ".join(
        [f"{{'feature_a': '{c}', 'feature_b': '{c}', 'corr': CASE WHEN var_pop({c}) > 0 THEN round(1 + 1e-9, 6) END}}" for c in LOAN_NUMERIC]
        + [
            f"{{'feature_a': '{x}', 'feature_b': '{y}', 'corr': CASE WHEN NOT isnan(corr({x}, {y})) THEN round(corr({x}, {y}) + 1e-9, 6) END}}"
            for a, b in _PAIRS for x, y in ((a, b), (b, a))
        ]
    )
    + "], recursive := true) FROM loans) z",
)
sql(
    "outlier_summary", ["loans"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
        round(round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(*), 2) + 1e-9, 6) AS outlier_pct
        FROM loans, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM loans) q"""
        for c in LOAN_NUMERIC
    ),
)
_EDGES = ", ".join(f"quantile_cont(CAST({{c}} AS DOUBLE), {i / 10})" for i in range(1, 10))
sql(
    "mutual_information", ["loans"],
    f"SELECT feature, {r6('sum(n / t * ln(n * t / (nb * nl)))', 'score')} FROM (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, "
    "sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, stress_level) AS nl FROM joint) w GROUP BY feature",
    {
        "joint": " UNION ALL ".join(
            f"""SELECT '{c}' AS feature, len(list_filter(edges, lambda e: coalesce(CAST({c} AS DOUBLE), med) > e)) AS bin, stress_level, count(*)::DOUBLE AS n
            FROM loans, (SELECT list_distinct([{_EDGES.format(c=c)}]) AS edges, median({c}) AS med FROM loans) q GROUP BY ALL"""
            for c in LOAN_NUMERIC if c != "stress_level"
        )
    },
)
sql(
    "leakage_check", ["loans"],
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, TRUE AS present, {r6(f'abs(corr({c}, stress_flag))', 'abs_corr')} FROM loans"
        if c in LOAN_COLUMNS else f"SELECT '{c}', FALSE, CAST(NULL AS DOUBLE)"
        for c in S.LEAKAGE_CANDIDATES
    ),
)
sql(
    "crosstab_cols", ["labelled"],
    "SELECT num_borrowers, " + ", ".join(
        r6(f"count(*) FILTER (WHERE stress_flag = {v}) * 100.0::DOUBLE / (SELECT count(*) FROM labelled WHERE stress_flag = {v})", f"stress_flag_{v}")
        for v in (0, 1)
    ) + " FROM labelled GROUP BY num_borrowers",
)
sql(
    "crosstab_rows", ["scored"],
    "SELECT bss_bucket, " + ", ".join(r6(f"count(*) FILTER (WHERE stress_flag = {v}) * 100.0::DOUBLE / count(*)", f"stress_flag_{v}") for v in (0, 1))
    + " FROM scored WHERE bss_bucket IS NOT NULL GROUP BY bss_bucket",
)
sql("constant_features", ["loans"], f"SELECT * FROM ({per_column(LOAN_COLUMNS, 'loans', 'count(DISTINCT {c}) AS unique_values')}) d WHERE unique_values <= 1")
sql(
    "sentinel_census", ["orig"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} = {v}) AS sentinel_count, {r6(f'count(*) FILTER (WHERE {c} = {v}) * 100.0::DOUBLE / count(*)', 'sentinel_pct')} FROM orig"""
        for c, v in S.SENTINELS.items()
    ),
)
sql(
    "histogram", ["normed"],
    f"""SELECT CAST(b.bin AS INTEGER) AS bin, {r6('lo + b.bin * ((hi - lo) / 30)', 'low')}, {r6('lo + (b.bin + 1) * ((hi - lo) / 30)', 'high')}, count(v.bin) AS "count"
    FROM range(30) b(bin) CROSS JOIN (SELECT min(bss) AS lo, max(bss) AS hi FROM normed) m
    LEFT JOIN (SELECT least(floor((bss - lo) / (hi - lo) * 30), 29) AS bin FROM normed, (SELECT min(bss) AS lo, max(bss) AS hi FROM normed) x WHERE bss IS NOT NULL) v
    ON v.bin = b.bin GROUP BY b.bin, lo, hi""",
)
_SPARK_TYPES = S.ORIGINATION_FIELDS | {c: "double" for c in S.ROLLUP_FEATURES} | {
    "loan_identifier": "bigint", "quarter": "string", "ever_ra": "boolean", "bssi": "int", "stress_flag": "int", "stress_level": "int",
    "months_delinquent": "bigint", "loan_age_max": "int", "ever_modified": "int", "modification_count": "bigint", "ever_assistance": "int",
    "assistance_count": "bigint", "ever_zero_balance": "int",
}
sql(
    "column_inventory", ["loans"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{_SPARK_TYPES[c]}' AS dtype, count("{c}") AS non_null, count(DISTINCT "{c}") AS distinct_values FROM loans"""
        for c in LOAN_COLUMNS
    ),
)
sql(
    "code_census", ["orig"],
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IN {tuple(Q.CODES)}) AS code_count, {r6(f'count(*) FILTER (WHERE {c} IN {tuple(Q.CODES)}) * 100.0::DOUBLE / count(*)', 'code_pct')} FROM orig"""
        for c in S.SENTINELS
    ),
)
_HIGH = "avg(stress_flag) FILTER (WHERE bss_bucket = 'Very Low')"
_LOW = "avg(stress_flag) FILTER (WHERE bss_bucket = 'Very High')"
sql("risk_ratio", ["scored"], f"SELECT {r6(_HIGH, 'rate_high')}, {r6(_LOW, 'rate_low')}, {r6(f'{_HIGH} / {_LOW}', 'risk_ratio')} FROM scored")
sql("event_totals", ["lab"], " UNION ALL ".join(f"SELECT '{c}' AS event, count(*) FILTER (WHERE {c}) AS loans FROM lab" for c in ("ever_ra", "ever_modified", "ever_assistance")))

# --- order, top-k, sets --------------------------------------------------------------------------------------------

sql("qcut_bucket", ["scored"], "SELECT loan_identifier, bss_bucket, bss_level FROM scored")
sql(
    "stress_rate_by_bucket", ["scored"],
    f"SELECT bss_bucket, count(*) AS loans, CAST(sum(stress_flag) AS BIGINT) AS stressed, {r6('avg(stress_flag) * 100', 'stress_rate')} FROM scored GROUP BY bss_bucket",
)
sql(
    "topk_values", ["orig"],
    """SELECT "column", "value", "count", "rank" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, "value") AS INTEGER) AS "rank"
    FROM (SELECT "column", "value", count(*) AS "count" FROM v GROUP BY ALL) c) r WHERE "rank" <= 20""",
    {
        "v": """SELECT 'original_upb' AS "column", CAST(original_upb AS VARCHAR) AS "value" FROM orig
        UNION ALL SELECT 'interest_rate', CAST(CAST(interest_rate * 80 AS BIGINT) AS VARCHAR) FROM orig
        UNION ALL SELECT 'original_loan_term', CAST(original_loan_term AS VARCHAR) FROM orig"""
    },
)
sql(
    "topk_coefficients", ["lend"],
    f"""SELECT feature, {r6('coefficient')}, {r6('abs(coefficient)', 'abs_coefficient')} FROM (
      SELECT feature, avg(target_amount) - (SELECT avg(target_amount) FROM lend) AS coefficient FROM (
        SELECT target_amount, 'property_state__' || property_state AS feature FROM lend
        UNION ALL SELECT target_amount, 'property_type__' || property_type FROM lend
        UNION ALL SELECT target_amount, 'channel__' || channel FROM lend
        UNION ALL SELECT target_amount, 'loan_purpose__' || loan_purpose FROM lend) u GROUP BY feature) t
    WHERE feature LIKE '%property%' ORDER BY abs(coefficient) DESC, feature LIMIT 30""",
)
sql("union_quarters", ["labelled"], 'SELECT loan_identifier, "quarter", credit_score, max_delinquency, ever_ra, ever_modified, ever_assistance, bssi, stress_flag, stress_level FROM labelled')

# --- splits and samples ----------------------------------------------------------------------------------------------

_SPLIT = f"""CASE WHEN {IN_TRAIN} THEN 'train' WHEN "quarter" IN {VALID} THEN 'valid' WHEN "quarter" IN {TEST} THEN 'test' END"""
sql("temporal_split", ["labelled"], f'SELECT loan_identifier, "quarter", stress_flag, {_SPLIT} AS split FROM labelled WHERE {_SPLIT} IS NOT NULL')
sql("split_drift", ["labelled"], f"""SELECT {_SPLIT} AS split, count(*) AS "rows", {r6('avg(stress_flag)', 'rate')} FROM labelled WHERE {_SPLIT} IS NOT NULL GROUP BY 1""")
_ORDER = "row_number() OVER (ORDER BY md5('42|' || CAST(loan_identifier AS VARCHAR)))"
sql(
    "hash_split", ["orig"],
    """SELECT loan_identifier, original_upb, CASE WHEN p <= n - h THEN 'train' WHEN p <= n - ceil(h * 0.5) THEN 'valid' ELSE 'test' END AS split
    FROM o""",
    {"o": f"SELECT loan_identifier, original_upb, {_ORDER} AS p, count(*) OVER () AS n, ceil(count(*) OVER () * 0.2) AS h FROM orig"},
)
sql("sample_cap", ["orig"], f"SELECT loan_identifier, original_upb FROM (SELECT *, {_ORDER} AS p FROM orig) o WHERE p <= 1000")


def permuted(source: str, columns: list[str], seed: int) -> dict[str, str]:
    """Tables that give each column the value found 1, 2, ... places further on in one circle of all rows."""
    h = f"md5('{seed}|' || CAST(loan_identifier AS VARCHAR))"
    return {
        "o": f"SELECT *, row_number() OVER (ORDER BY {h}) - 1 AS __p, count(*) OVER () AS __n FROM {source}",
        "mixed": "SELECT o.*, " + ", ".join(f't{i}."{c}" AS "{c}__permuted"' for i, c in enumerate(columns, 1)) + " FROM o "
        + " ".join(f"JOIN o t{i} ON t{i}.__p = (o.__p + {i}) % o.__n" for i in range(1, len(columns) + 1)),
    }


sql(
    "permute_column", ["orig"], "SELECT loan_identifier, msa, credit_score, msa__permuted, credit_score__permuted FROM mixed",
    permuted("orig", ["msa", "credit_score"], 42),
)

# --- preparation --------------------------------------------------------------------------------------------------------

_SCALED = [*S.SENTINELS, "interest_rate"]
sql(
    "impute_scale", ["clean"],
    "SELECT loan_identifier, " + ", ".join(r6(f"(coalesce(CAST({c} AS DOUBLE), {c}_med) - {c}_mean) / {c}_std", c) for c in _SCALED) + " FROM clean, moments",
    {
        "meds": "SELECT " + ", ".join(f"median({c}) AS {c}_med" for c in _SCALED) + f" FROM clean WHERE {IN_TRAIN}",
        "moments": "SELECT " + ", ".join(
            f"any_value({c}_med) AS {c}_med, avg(coalesce(CAST({c} AS DOUBLE), {c}_med)) AS {c}_mean, stddev_pop(coalesce(CAST({c} AS DOUBLE), {c}_med)) AS {c}_std"
            for c in _SCALED
        ) + f" FROM clean, meds WHERE {IN_TRAIN}",
    },
)
sql(
    "impute_mode", ["orig"],
    "SELECT loan_identifier, " + ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), (SELECT CAST({c} AS VARCHAR) AS v FROM orig WHERE {IN_TRAIN} AND {c} IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS {c}"
        for c in Q.MODE_COLUMNS
    ) + " FROM orig",
)


def hot(names: list[str], min_count: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT loan_identifier, '{c}__' || "{c}" AS feature, 1.0::DOUBLE AS "value" FROM prepared
        WHERE "{c}" IN (SELECT "{c}" FROM prepared WHERE {IN_TRAIN} GROUP BY "{c}" HAVING count(*) >= {min_count})"""
        for c in names
    )


sql("one_hot_long", ["prepared"], hot(Q.HOT_COLUMNS, 1))
_NUM_MEDS = "SELECT " + ", ".join(f"coalesce(median({c}), 0) AS {c}_med" for c in S.LENDING_NUMERIC) + f" FROM prepared WHERE {IN_TRAIN}"
_NUM_MOMENTS = "SELECT " + ", ".join(
    f"any_value({c}_med) AS {c}_med, avg(coalesce({c}, {c}_med)) AS {c}_mean, coalesce(nullif(stddev_pop(coalesce({c}, {c}_med)), 0), 1) AS {c}_std"
    for c in S.LENDING_NUMERIC
) + f" FROM prepared, meds WHERE {IN_TRAIN}"
sql(
    "preproc_linear", ["prepared"],
    " UNION ALL ".join(
        f"SELECT loan_identifier, '{c}' AS feature, {r6(f'(coalesce({c}, {c}_med) - {c}_mean) / {c}_std', 'value')} FROM prepared, moments" for c in S.LENDING_NUMERIC
    ) + " UNION ALL " + f'SELECT loan_identifier, feature, {r6("value")} FROM ({hot(S.LENDING_CATEGORICAL, 20)}) h',
    {"meds": _NUM_MEDS, "moments": _NUM_MOMENTS},
)
sql(
    "ridge_optimum", ["prepared"],
    " UNION ALL ".join(f"SELECT '{c}' AS feature, 0.0::DOUBLE AS gradient" for c in S.LENDING_NUMERIC)
    + f" UNION ALL SELECT DISTINCT feature, 0.0::DOUBLE FROM ({hot(S.LENDING_CATEGORICAL, 20)}) h",
)
sql("logistic_optimum", [], "SELECT 0.0::DOUBLE AS largest_gradient", {"one": "SELECT 1"})
sql(
    "preproc_tree", ["prepared"],
    " UNION ALL ".join(f"SELECT loan_identifier, '{c}' AS feature, {r6(f'coalesce({c}, {c}_med)', 'value')} FROM prepared, meds" for c in S.LENDING_NUMERIC)
    + " UNION ALL "
    + " UNION ALL ".join(
        f"""SELECT loan_identifier, '{c}', {r6('CAST(coalesce(code, -1) AS DOUBLE)', 'value')} FROM prepared p LEFT JOIN
        (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "{c}" AS v FROM prepared WHERE {IN_TRAIN}) d) t ON p."{c}" = t.v"""
        for c in S.LENDING_CATEGORICAL
    ),
    {"meds": _NUM_MEDS},
)
sql("class_weights", ["lab"], f"""SELECT stress_level, count(*) AS "rows", {r6('(SELECT count(*) FROM lab)::DOUBLE / ((SELECT count(DISTINCT stress_level) FROM lab) * count(*))', 'weight')} FROM lab GROUP BY stress_level""")
sql(
    "prepare_xy", ["labelled"],
    f"""SELECT {cols(without(ORIG_COLUMNS, S.STRESS_PREP_REMOVE, ['first_payment_date', 'maturity_date']))}, max_delinquency, ever_ra, ever_modified,
    ever_assistance, stress_flag, stress_level, CAST((maturity_date // 100 - first_payment_date // 100) * 12 + maturity_date % 100 - first_payment_date % 100 AS INTEGER)
    AS remaining_term_months, loan_identifier AS row_key FROM labelled""",
)

# --- metrics ---------------------------------------------------------------------------------------------------------------

_REG = "sqrt(avg((y - p) * (y - p)))", "avg(abs(y - p))", "avg(abs((y - p) / y)) * 100", "1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))"
sql(
    "regression_metrics", ["orig"],
    "SELECT " + ", ".join(r6(e, n) for e, n in zip(_REG, ("rmse", "mae", "mape_pct", "r2"))) + " FROM v",
    {"v": "SELECT interest_rate AS y, interest_rate + (loan_identifier % 21 - 10) / 100.0::DOUBLE AS p FROM orig"},
)
sql(
    "amount_metrics", ["orig"],
    "SELECT " + ", ".join(r4(e, n) for e, n in zip(_REG, ("rmse_dollars", "mae_dollars", "mape_pct")))
    + ", round(1 - sum((ly - lp) * (ly - lp)) / (var_pop(ly) * count(ly)), 4) AS r2_log FROM v",
    {"v": f"SELECT exp(ly) - 1 AS y, exp(lp) - 1 AS p, ly, lp FROM (SELECT ln(1 + CAST(original_upb AS DOUBLE)) AS ly, {_AMOUNT_GUESS} AS lp FROM orig) l"},
)
_TERM_OF = "CASE WHEN {k} % 10 = 0 THEN 120 WHEN {k} % 10 = 1 THEN 240 WHEN {k} % 10 = 2 THEN 300 WHEN {k} % 10 IN (3, 4) THEN 180 ELSE 360 END"
CTES["terms"] = f"SELECT original_loan_term AS y, {_TERM_OF.format(k='(loan_identifier + 1)')} AS p FROM orig"
_NEEDS["terms"] = ["orig"]
sql("term_metrics", ["terms"], f"SELECT {r6('avg(CAST(y = p AS INTEGER))', 'accuracy')}, {r6('avg(abs(y - p))', 'mae_months')} FROM terms")
sql(
    "rate_metrics", ["orig"],
    f"SELECT {r6(_REG[0], 'rmse_rate')}, {r6(_REG[1], 'mae_rate')}, {r6(_REG[3], 'r2')} FROM v",
    {"v": "SELECT interest_rate AS y, interest_rate + (loan_identifier % 13 - 6) / 50.0::DOUBLE AS p FROM orig"},
)
CTES["guess"] = "SELECT stress_flag AS y, (loan_identifier * 37 % 101) / 101.0::DOUBLE AS s, CASE WHEN (loan_identifier * 37 % 101) / 101.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS p FROM lab"
_NEEDS["guess"] = ["lab"]
sql(
    "binary_metrics", ["guess"],
    f"""SELECT {r6('avg(CAST(y = p AS INTEGER))', 'accuracy')}, {r6('sum(y * p) / sum(p)::DOUBLE', '"precision"')}, {r6('sum(y * p) / sum(y)::DOUBLE', 'recall')},
    {r6('2 * sum(y * p) / (sum(y) + sum(p))::DOUBLE', 'f1')} FROM guess""",
)
sql(
    "roc_auc", ["guess"],
    f"""SELECT {r6('sum(pos * (before + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE', 'roc_auc')}, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
    FROM (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM guess GROUP BY s) c) w""",
)
sql("confusion_matrix", ["guess"], 'SELECT y AS actual, p AS predicted, count(*) AS "rows" FROM guess GROUP BY y, p')
sql(
    "classification_report", ["terms"],
    f"""SELECT "class", {r6('prec', '"precision"')}, {r6('recall')}, {r6('f1')}, support FROM (
      SELECT * FROM c
      UNION ALL SELECT 'accuracy', a.acc, a.acc, a.acc, a.n FROM a
      UNION ALL SELECT 'macro avg', avg(prec), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c
      UNION ALL SELECT 'weighted avg', sum(prec * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c) u""",
    {
        "a": "SELECT avg(CAST(y = p AS INTEGER)) AS acc, count(*) AS n FROM terms",
        "c": """SELECT CAST(k.y AS VARCHAR) AS "class",
          coalesce((SELECT count(*) FROM terms t WHERE t.y = k.y AND t.p = k.y)::DOUBLE / nullif((SELECT count(*) FROM terms t WHERE t.p = k.y), 0), 0) AS prec,
          (SELECT count(*) FROM terms t WHERE t.y = k.y AND t.p = k.y)::DOUBLE / k.n AS recall,
          2 * (SELECT count(*) FROM terms t WHERE t.y = k.y AND t.p = k.y)::DOUBLE / (k.n + (SELECT count(*) FROM terms t WHERE t.p = k.y)) AS f1,
          k.n AS support FROM (SELECT y, count(*) AS n FROM terms GROUP BY y) k""",
    },
)
_COMPARED = " UNION ALL ".join(
    f"""SELECT '{m}' AS model_key, '{t}' AS target, {y} AS y, {y} * (1 + (loan_identifier % {mod} - {shift}) / {scale}::DOUBLE) AS p FROM orig"""
    for m, targets in Q.COMPARED.items() for t, (mod, shift, scale) in targets.items()
    for y in ["CAST(original_upb AS DOUBLE)" if t == "loan_amount" else "interest_rate"]
)
sql(
    "model_comparison", ["orig"],
    f"SELECT model_key, target, {r4(_REG[0], 'rmse')}, {r4(_REG[1], 'mae')}, {r4(_REG[3], 'r2')}, {r4(_REG[2], 'mape_pct')} FROM v GROUP BY model_key, target",
    {"v": _COMPARED},
)
sql(
    "best_by_metric", ["orig"],
    f"SELECT model_key, target, {r4(_REG[1], 'mae')} FROM v WHERE target = 'interest_rate' GROUP BY model_key, target ORDER BY {_REG[1]}, model_key LIMIT 1",
    {"v": _COMPARED},
)

# --- explanations ----------------------------------------------------------------------------------------------------------

CTES["frame"] = "SELECT loan_identifier, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in S.LENDING_NUMERIC) + ", " + ", ".join(f'"{c}"' for c in S.LENDING_CATEGORICAL) + " FROM prepared"
_NEEDS["frame"] = ["prepared"]


def linear(model: str, target: str, swap: dict[str, str] | None = None) -> str:
    intercept, slopes, effects = Q.LINEAR_MODELS[model, target]
    name = lambda c: (swap or {}).get(c, f'"{c}"')
    parts = [f"{intercept}::DOUBLE"] + [f"({w})::DOUBLE * {name(c)}" for c, w in slopes.items()]
    for c, values in effects.items():
        parts.append("CASE " + " ".join(f"WHEN {name(c)} = '{v}' THEN ({e})::DOUBLE" for v, e in values.items()) + " ELSE 0 END")
    total = " + ".join(parts)
    return f"(exp({total}) - 1)" if target == "loan_amount" else f"least(greatest({total}, 0.0::DOUBLE), 20.0::DOUBLE)"


_MIXED = permuted("frame", S.LENDING_FEATURES, 2027)


def impact_rows(columns: str) -> str:
    rows = []
    for model, target in Q.LINEAR_MODELS:
        for c in S.LENDING_FEATURES:
            delta = f"({linear(model, target, {c: f'{chr(34)}{c}__permuted{chr(34)}'})} - {linear(model, target)})"
            rows.append(
                f"SELECT '{model}' AS model_key, '{target}' AS target, '{c}' AS feature, '{S.FEATURE_LABELS[c]}' AS feature_label, "
                f"avg(abs({delta})) AS mean_absolute_impact, avg({delta}) AS mean_signed_impact, '{Q.UNITS[target]}' AS unit FROM mixed"
            )
    return f"SELECT {columns} FROM (" + " UNION ALL ".join(rows) + ") i"


sql(
    "permutation_impact", ["frame"],
    impact_rows("model_key, target, feature, feature_label, round(mean_absolute_impact + 1e-7, 4) AS mean_absolute_impact, round(mean_signed_impact + 1e-7, 4) AS mean_signed_impact, unit"),
    _MIXED,
)
sql(
    "topk_per_group", ["frame"],
    """SELECT model_key, target, "rank", feature, round(mean_absolute_impact + 1e-7, 4) AS mean_absolute_impact FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY model_key, target ORDER BY mean_absolute_impact DESC, feature) AS INTEGER) AS "rank" FROM impacts) t WHERE "rank" <= 5""",
    {**_MIXED, "impacts": impact_rows("*")},
)
_GRID = "(20 + i * ((100 - 20) / 49.0::DOUBLE))"
sql(
    "pdp_curve", ["frame"],
    f"""SELECT CAST(i AS INTEGER) AS point, round({_GRID} + 1e-7, 4) AS "value",
    round(avg({linear('model_a', 'loan_amount', {'ltv': _GRID, 'cltv': _GRID})}) + 1e-7, 4) AS prediction
    FROM frame CROSS JOIN range(50) r(i) GROUP BY i""",
)
_AM = Q.LINEAR_MODELS["model_a", "loan_amount"]
CTES["bg"] = f"SELECT * FROM (SELECT *, {_ORDER} AS p FROM frame) o WHERE p <= 100"
_NEEDS["bg"] = ["frame"]
CTES["contrib"] = " UNION ALL ".join(
    [f"SELECT loan_identifier, '{c}' AS feature, ({w})::DOUBLE * ({c} - (SELECT avg({c}) FROM bg)) AS contribution FROM frame" for c, w in _AM[1].items()]
    + [
        f"""SELECT loan_identifier, '{c}__{v}', ({e})::DOUBLE * (CASE WHEN "{c}" = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE
        - (SELECT avg(CASE WHEN "{c}" = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE) FROM bg)) FROM frame"""
        for c, effects in _AM[2].items() for v, e in effects.items()
    ]
)
_NEEDS["contrib"] = ["frame", "bg"]
sql("linear_attribution", ["contrib"], f"SELECT loan_identifier, feature, {r6('contribution')} FROM contrib")
_LABEL = "CASE feature " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in S.FEATURE_LABELS.items()) + " ELSE feature END"
for _name in ("attribution_rollup", "attribution_rollup_long"):
    sql(
        _name, ["contrib"],
        f"""SELECT loan_identifier, "rank", feature, {_LABEL} AS label, round_even(score, 4) AS "value",
        CASE WHEN score >= 0 THEN 'increases estimate' ELSE 'decreases estimate' END AS direction FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY loan_identifier ORDER BY abs(score) DESC, feature) AS INTEGER) AS "rank" FROM (
            SELECT loan_identifier, split_part(feature, '__', 1) AS feature, sum(contribution) AS score FROM contrib GROUP BY ALL) s) t
        WHERE "rank" <= 5""",
    )

# --- quality ---------------------------------------------------------------------------------------------------------------

sql("validate_master", ["labelled"], f'SELECT count(*) AS "rows", {len(MASTER_COLUMNS)} AS "columns" FROM labelled')
sql(
    "domain_check", ["orig"],
    'SELECT "column", "value", count(*) AS "rows" FROM ('
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS "value" FROM orig WHERE CAST({c} AS VARCHAR) NOT IN ({', '.join(f"'{v}'" for v in values)})"""
        for c, values in Q.ALLOWED.items()
    ) + ") b GROUP BY ALL",
)

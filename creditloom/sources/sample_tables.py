"""Loan-shaped views over the order/line-item test tables.

The recipes are integer arithmetic, so any engine reproduces them bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORIGINATION = {
    "credit_score": "CAST(IF(k % 97 = 0, 9999, 500 + (k * 31) % 351) AS INT)",
    "first_payment_date": "y * 100 + m",
    "first_time_homebuyer_indicator": "IF(k % 5 = 0, 'Y', 'N')",
    "maturity_date": "CAST((last_month DIV 12) * 100 + last_month % 12 + 1 AS INT)",
    "msa": "CAST(IF(k % 11 = 0, NULL, 10000 + (o_custkey % 40) * 100) AS INT)",
    "mortgage_insurance_pct": "IF(ltv BETWEEN 81 AND 998, 25, 0)",
    "num_units": "IF(k % 37 = 0, 2, 1)",
    "occupancy_status": "CASE o_orderstatus WHEN 'F' THEN 'P' WHEN 'O' THEN 'S' ELSE 'I' END",
    "cltv": "CAST(IF(k % 211 = 0, 999, ltv + (k % 4) * 5) AS INT)",
    "dti": "CAST(IF(k % 53 = 0, 999, 1 + (k * 17) % 50) AS INT)",
    "original_upb": "CAST(FLOOR(o_totalprice / 1000) AS BIGINT) * 1000",
    "ltv": "ltv",
    "interest_rate": "CAST(240 + (k * 7) % 200 AS DOUBLE) / 80",
    "channel": "SUBSTRING(o_orderpriority, 1, 1)",
    "prepayment_penalty_indicator": "'N'",
    "amortization_type": "'FRM'",
    "property_state": "n_name",
    "property_type": "c_mktsegment",
    "postal_code": "CAST((o_custkey % 999) * 100 AS INT)",
    "loan_identifier": "k",
    "loan_purpose": "CASE k % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'C' ELSE 'N' END",
    "original_loan_term": "term",
    "num_borrowers": "1 + IF(k % 3 = 0, 1, 0) + IF(k % 41 = 0, 1, 0)",
    "seller_name": "CONCAT('Seller_', k % 25)",
    "servicer_name": "CONCAT('Servicer_', k % 24)",
    "super_conforming_flag": "IF(k % 31 = 0, 'Y', NULL)",
    "pre_harp_loan_sequence_number": "CAST(NULL AS STRING)",
    "program_indicator": "CASE WHEN k % 9 = 0 THEN 'H' WHEN k % 200 = 0 THEN 'F' ELSE '9' END",
    "harp_indicator": "IF(k % 77 = 0, 'Y', NULL)",
    "property_valuation_method": "IF(k % 37 = 0, 1, 7)",
    "interest_only_indicator": "'N'",
    "mortgage_insurance_cancellation_indicator": "CASE k % 3 WHEN 0 THEN '7' WHEN 1 THEN 'N' ELSE 'Y' END",
    "quarter": "CONCAT(y, 'Q', QUARTER(o_orderdate))",
}

PERFORMANCE = {
    "loan_identifier": "l_orderkey",
    "reporting_period": "YEAR(l_shipdate) * 100 + MONTH(l_shipdate)",
    "current_loan_delinquency_status": """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity >= 49 THEN 'RA'
        WHEN l_quantity >= 46 THEN CAST(CAST((l_quantity - 45) * 2 AS INT) AS STRING) ELSE '0' END""",
    "loan_age": "CAST(r % 92 AS INT)",
    "remaining_months_to_maturity": "CAST(360 - r % 92 AS INT)",
    "modification_flag": "IF(r % 61 = 0, 'Y', NULL)",
    "zero_balance_code": "IF(l_returnflag = 'A' AND l_linestatus = 'F', '01', NULL)",
    "current_interest_rate": "CAST(240 + (l_orderkey * 7) % 200 - r % 5 AS DOUBLE) / 80",
    "estimated_ltv": "CASE WHEN r % 13 = 0 THEN '999' WHEN r % 29 = 0 THEN '' ELSE CAST(20 + r % 130 AS STRING) END",
    "borrower_assistance_status": "IF(r % 17 = 0, 'F', NULL)",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loan_origination(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One loan per order. The customer join is left out when no requested column needs it."""
    columns = columns or list(ORIGINATION)
    orders = _table(spark, sf_dir, "orders")
    if {"property_state", "property_type"} & set(columns):
        customer = _table(spark, sf_dir, "customer")
        nation = _table(spark, sf_dir, "nation")
        orders = orders.join(
            customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")),
            F.col("o_custkey") == F.col("c_custkey"),
        )
    base = orders.selectExpr(
        "*", "o_orderkey AS k", "YEAR(o_orderdate) AS y", "MONTH(o_orderdate) AS m",
        "CAST(IF(o_orderkey % 211 = 0, 999, 30 + (o_orderkey * 13) % 71) AS INT) AS ltv",
        """CASE o_orderkey % 10 WHEN 0 THEN 120 WHEN 1 THEN 240 WHEN 2 THEN 300 WHEN 3 THEN 180 WHEN 4 THEN 180
        ELSE 360 END AS term""",
    ).selectExpr("*", "y * 12 + m - 1 + term AS last_month")
    return base.selectExpr(*[f"{ORIGINATION[c]} AS {c}" for c in columns])


def loan_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One performance record per line item."""
    items = _table(spark, sf_dir, "lineitem").selectExpr("*", "l_partkey * 7 + l_suppkey * 3 + l_linenumber AS r")
    return items.selectExpr(*[f"{expr} AS {c}" for c, expr in PERFORMANCE.items()])

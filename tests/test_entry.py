import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")

CHECKED = [
    "stress_rate_by_bucket", "loan_labels", "loan_performance_features", "store_stress_prediction", "hash_split",
    "numeric_summary", "mutual_information", "roc_auc", "attribution_rollup", "permute_column", "histogram",
]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect(config={"temp_directory": ""})
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).count() == 6


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 90


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, engine, name):
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    wanted = engine.sql(entry.oracle_sql()[name])
    assert sorted(wanted.columns) == names
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    want = sorted((tuple(dict(zip(wanted.columns, r))[c] for c in names) for r in wanted.fetchall()), key=repr)
    assert got == want

import threading

import pytest

from creditloom import schemas as S
from creditloom.sources import feature_store as store
from creditloom.sources import raw_text


def line(fields, **values):
    return "|".join(str(values.get(n, "")) for n in fields)


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_origination_types_blanks_and_quarter(spark, tmp_path):
    rows = [
        line(S.ORIGINATION_FIELDS, loan_identifier="F18Q1", credit_score=700, msa="35620.0", interest_rate=4.125),
        line(S.ORIGINATION_FIELDS, loan_identifier="F18Q2", credit_score="NA", seller_name="NA"),
    ]
    path = write(tmp_path / "historical_data_2018Q3.txt", rows)
    out = {r["loan_identifier"]: r for r in raw_text.read_origination(spark, path, with_quarter=True).collect()}
    assert out["F18Q1"]["credit_score"] == 700 and out["F18Q1"]["msa"] == 35620
    assert out["F18Q1"]["interest_rate"] == 4.125 and out["F18Q1"]["seller_name"] is None
    assert out["F18Q2"]["credit_score"] is None and out["F18Q2"]["seller_name"] is None
    assert (out["F18Q2"]["quarter"], out["F18Q2"]["year"], out["F18Q2"]["quarter_num"]) == ("2018Q3", 2018, 3)
    kept = raw_text.read_origination(spark, path, missing_words=()).where("loan_identifier = 'F18Q2'").first()
    assert kept["seller_name"] == "NA"


@pytest.mark.parametrize("fields", [31, 33])
def test_wrong_field_count_fails_even_for_one_column(spark, tmp_path, fields):
    path = write(tmp_path / "historical_data_time_2018Q1.txt", ["|".join(["1"] * 32), "|".join(["1"] * fields)])
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        raw_text.read_performance(spark, path).select("loan_age").collect()


def test_missing_inputs_are_all_named(spark, tmp_path):
    write(tmp_path / "historical_data_2018Q1.txt", ["x"])
    with pytest.raises(FileNotFoundError) as error:
        raw_text.quarter_paths(spark, str(tmp_path), ["2018Q1"])
    assert "historical_data_time_2018Q1.txt" in str(error.value)
    with pytest.raises(FileNotFoundError):
        store.load_splits(spark, str(tmp_path / "nowhere"))


def test_manifest_upsert(spark, tmp_path):
    root = str(tmp_path)
    store.register_version(spark, root, "v1", {"rows": 1})
    store.register_version(spark, root, "v2", {"rows": 2})
    store.register_version(spark, root, "v1", {"rows": 3})
    manifest = store.read_manifest(spark, root)
    assert manifest["latest_version"] == "v1"
    assert {v: e["rows"] for v, e in manifest["versions"].items()} == {"v1": 3, "v2": 2}


def test_manifest_after_a_stopped_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert store.read_manifest(spark, root) is None
    store.register_version(spark, root, "v1", {"rows": 1})
    # stopped before the file got its name
    (tmp_path / "manifest" / ".000000002.json.abc").write_text('{"latest_ver')
    assert store.read_manifest(spark, root)["versions"] == {"v1": {"rows": 1}}
    store.register_version(spark, root, "v2", {"rows": 2})
    assert sorted(store.read_manifest(spark, root)["versions"]) == ["v1", "v2"]
    # another writer commits between our reading and our writing
    real, seen = store._commits, []

    def late(session, where):
        found = real(session, where)
        if not seen:
            seen.append(1)
            store.register_version(session, where, "other", {"rows": 9})
        return found

    monkeypatch.setattr(store, "_commits", late)
    store.register_version(spark, root, "v3", {"rows": 3})
    assert sorted(store.read_manifest(spark, root)["versions"]) == ["other", "v1", "v2", "v3"]


def test_manifest_with_concurrent_writers(spark, tmp_path):
    root = str(tmp_path)
    writers = [threading.Thread(target=store.register_version, args=(spark, root, f"v{i}", {"rows": i})) for i in range(6)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(store.read_manifest(spark, root)["versions"]) == [f"v{i}" for i in range(6)]
    store.write_json(spark, f"{root}/metadata.json", {"a": 1})
    store.write_json(spark, f"{root}/metadata.json", {"a": 2})
    assert store.read_json(spark, f"{root}/metadata.json") == {"a": 2}


def test_objective_store_ignores_absent_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "loan_identifier int, bssi int, dti int")
    assert store.objective_store(df, "stress_severity").columns == ["dti"]
    assert store.objective_store(df, "explainability").columns == ["bssi", "dti"]

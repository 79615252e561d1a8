import itertools
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from creditloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect(config={"temp_directory": ""})
    for file in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == names
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in names) for r in rows), key=repr)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "el perro y la casa están en una calle que los niños han visto")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
            kept[name] = sorted((r.doc_id or 0, r.text) for r in docs.collect())
        assert docs.count() > 0
    assert all(t for _, t in kept["language"])
    assert len(kept["near_duplicates"]) <= len(kept["lines"]) <= len(kept["language"])
    assert 7 not in {i for i, _ in kept["benchmark"]}
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def grams(text, n, split):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def components(n, linked):
    label = list(range(n))
    for i, j in itertools.combinations(range(n), 2):
        if label[i] != label[j] and linked(i, j):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def near(a, b):
    return bool(a) and bool(b) and 10 * len(a & b) >= 8 * len(a | b)


def test_near_copies_under_one_id(spark, frame):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base), (1, base + " tail"), (1, base + " other end"), (None, base + " x"), (2, "alone here with own words"), (None, "nobody"), (None, "nobody"), (3, base), (3, base)]
    kept = corpus_pipeline.keep_one_of_each_group(spark, frame(rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if not r.text.startswith(base)) == [(0, "nobody"), (2, "alone here with own words")]
    assert [r.doc_id for r in kept if r.text.startswith(base)] == [1]
    only = [(None, base), (None, base + " tail"), (None, "nobody else")]
    assert len(corpus_pipeline.keep_one_of_each_group(spark, frame(only), "").collect()) == 2


def test_run_equals_brute_force(spark, tmp_path):
    """The whole pipeline on part of a test table: language by its own operator, every other stage written anew."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = sorted(((r.doc_id, r.text) for r in corpus_pipeline.identify_language(spark, docs, path).collect()))
    # lines: the first of each component stays
    places = [(d, k, line) for d, t in rows for k, line in enumerate(t.split("\n")) if line.strip(" \t\n\x0b\x0c\r")]
    kinds = sorted({line.lower() for _, _, line in places})
    chars = [{x[i : i + 5] for i in range(max(len(x) - 4, 1))} for x in (k.strip() for k in kinds)]
    label = components(len(kinds), lambda i, j: 4 * len(chars[i]) <= 5 * len(chars[j]) and 4 * len(chars[j]) <= 5 * len(chars[i]) and near(chars[i], chars[j]))
    root, first, gone = dict(zip(kinds, label)), {}, set()
    for d, k, line in sorted(places):
        if first.setdefault(root[line.lower()], (d, k)) != (d, k):
            gone.add((d, k))
    rows = [(d, t if not any((d, k) in gone for k in range(t.count("\n") + 1)) else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows]
    rows = [(d, t) for d, t in rows if words(t) or not any(x == d for x, _ in gone)]
    # one document of each group
    shingles = [grams(t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t), 5, words) for _, t in rows]
    label = components(len(rows), lambda i, j: near(shingles[i], shingles[j]))
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    # no window of the benchmark
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in spark.read.parquet(f"{path}/benchmark.parquet").collect():
        w = split(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else ({tuple(w)} if w else set())
    sizes = {len(w) for w in windows}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [split(t)] for n in sizes for i in range(len(w) - n + 1))]
    # pieces of the packed sequences are the documents' tokens
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t in rows}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(want) and len(rows) < docs.count()
    for d, parts in pieces.items():
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(want[d][p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in parts) == len(want[d])
    room = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room.get(r.sequence_id, 0)
        room[r.sequence_id] = r.offset + r.length
    assert max(room.values()) <= 1024 and len(room) <= 1.02 * sum(room.values()) / 1024 + 2

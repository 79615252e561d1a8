"""Search against brute force over all documents, the bounds of the index, special rows."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from creditloom.llm import queries
from creditloom.llm import ranked_search as rs


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Sorted rows (item_id, rank, doc_id, score) of scoring every document for every item."""
    vectors = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, words = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        scored = []
        for i, v in vectors:
            m, score = 10 + 90 * sum(v.values()) * n // words, 0
            for t in set(terms(text)):
                if t in v:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * v[t] // (1000 * v[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, k=10):
    return sorted(map(tuple, rs.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def prose(rng, words, n):
    return " ".join(words[min(int(rng.expovariate(1 / 40)), len(words) - 1)] for _ in range(n))


@pytest.fixture()
def collection():
    """Few common and many rare words, copies, ties, null and repeated ids."""
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)]
    rows = [(i, prose(rng, words, rng.randrange(1, 120))) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (None, rows[7][1]), (None, None)]
    rows += [(5000, None), (5001, ""), (5002, "-- !"), (5003, "W1X, w2x; É"), (5004, " ".join(words) + " tail" * 3000)]
    rng.shuffle(rows)
    items = [(i, prose(rng, words, 30)) for i in range(12)] + [(50, rows[3][1]), (51, None), (52, "..."), (53, "absent words"), (54, "w1x"), (54, "w1x"), (None, "w399x é")]
    items += [(60, dict(r for r in rows if r[0] is not None)[1000])]
    return rows, items


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, frame, collection, monkeypatch, small):
    if small:  # many segments and blocks, long documents apart, several passes
        for name, value in (("SEGMENT_DOCS", 40), ("BLOCK_DOCS", 4), ("LONG", 60), ("SEEDS", 3), ("BLOCK_CHARS", 800), ("_EXPANDED", 50)):
            monkeypatch.setattr(rs, name, value)
    rows, items = collection
    docs, bench = frame(rows), spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, rank string, row int")
    assert found(docs, bench) == brute(rows, items)
    assert found(docs, bench, 3) == brute(rows, items, 3)


def test_special_tables(spark, odd, frame):
    items = spark.createDataFrame([(1, "the cat word5 word59999"), (2, "haus"), (3, "x" * 100_000)], "item_id long, text string")
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(odd, items) == brute(rows, [tuple(r) for r in items.collect()])
    assert found(odd.limit(0), items) == [] and found(odd, items.limit(0)) == []
    assert found(frame([(1, None), (2, "..")]), items) == []


def test_blocks_hold_every_document_and_bounds_hold():
    """Summaries are the maxima of what their blocks hold from the list's own term on; every posting is in one block."""
    rng = np.random.default_rng(2)
    size, docs = 50, 300
    rank = [np.unique(rng.integers(0, size, rng.integers(1, 20))) for _ in range(docs)]
    tf = [rng.integers(1, 5, len(r)) for r in rank]
    items = [np.unique(rng.integers(0, size, 12)) for _ in range(5)]
    scale = rs.Scale(docs, 5000, np.bincount(np.concatenate(rank), minlength=size), items)
    together = {(int(a), int(b)) for t in items for a in scale.rank_of[t] for b in scale.rank_of[t]}
    ranked = [scale.rank_of[r] for r in rank]
    made = rs.Segment(rs._segment(list(range(docs)), rng.integers(5, 40, docs), ranked, tf, scale))
    vectors = [dict(zip(made.vec_rank[a:b].tolist(), made.vec_sat[a:b].tolist())) for a, b in zip(made.vec_at, made.vec_at[1:])]
    postings = Counter()
    for b, term in enumerate(made.block_rank.tolist()):
        members = made.block_docs[made.block_at[b] : made.block_at[b + 1]].tolist()
        postings.update((term, c) for c in members)
        want = {}
        for c in members:
            for r, s in vectors[c].items():
                if r >= term:
                    want[r] = max(want.get(r, 0), s)
        got = slice(made.sum_at[b], made.sum_at[b + 1])
        assert {r: s for r, s in zip(made.sum_rank[got].tolist(), made.sum_sat[got].tolist()) if (term, r) in together} == {r: s for r, s in want.items() if (term, r) in together}
    assert postings == Counter((t, c) for c, v in enumerate(vectors) for t in v)
    assert sorted(made.ids) == list(range(docs)) and max(Counter(made.block_rank.tolist()).values()) > 1


def test_second_pass_skips(spark):
    """With the score that ten documents reach, only some lists and blocks are read, and the result is the same."""
    rng = random.Random(9)
    words = [f"t{i}" for i in range(500)]
    rows = [(i, prose(rng, words, 60)) for i in range(2000)]
    item = prose(rng, words, 25)
    made = rs.Terms([item])
    n, owner, term, tf = made.count(pa.array([t for _, t in rows], pa.large_string()))
    at = np.searchsorted(owner, np.arange(len(rows) + 1))
    scale = rs.Scale(len(rows), int(n.sum()), np.bincount(term, minlength=len(made.hashes)), made.items)
    kept = [i for i in range(len(rows)) if at[i] < at[i + 1]]
    segment = rs.Segment(rs._segment(kept, n[kept], [scale.rank_of[term[at[i] : at[i + 1]]] for i in kept], [tf[at[i] : at[i + 1]] for i in kept], scale))
    q = rs.Queries(made.items, scale)
    weight = np.zeros(len(scale.weight), np.int64)
    weight[q.items[0]] = scale.weight[q.items[0]]
    every = segment.best(*segment.search(q.items[0], weight, 1), 10)
    reached = -segment.best(*segment.search(q.items[0][: q.lists[0]], weight, 1), 10)[-1][0]
    q.raise_to({0: reached})
    assert q.lists[0] < len(q.items[0])
    classes, score = segment.search(q.items[0][: q.lists[0]], weight, reached)
    assert segment.best(classes, score, 10) == every
    assert [(r[3], r[2]) for r in sorted(brute(rows, [(1, item)]), key=lambda r: r[1])] == [(-s, x) for s, _, x in every]


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(map(tuple, queries.op13_ranked_search(spark, path).collect()))
    with duckdb.connect() as con:
        for name in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
        assert got == sorted(con.execute(queries.ORACLES["op13_ranked_search"]).fetchall())

"""The trie against brute force on nested tuples, and rows that are null, repeated, long or carry clashing names."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from creditloom.llm import trie
from creditloom.llm.queries import ORACLES

SCHEMA = "conv_id long, turn long, role string, text string, pos string, depth string, k1 string, path string"


def brute(rows, rebuild):
    convs = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            convs[c].append((role or "", text or ""))
    members = defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (abs(c) % 100) * (1 if c > 0 else -1)
        turns = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append((c, len(turns)))
    sums, out = {s: [0, 0, 0] for s in members}, set()
    for s in sorted(members, key=len, reverse=True):
        children, leaves, saved = sums[s]
        leaves, saved = leaves or 1, saved + (len(members[s]) - 1) * (len(s[-1][1]) if s else 0)
        ends = ",".join(str(c) for c in sorted(c for c, n in members[s] if n == len(s)))
        parent = min(c for c, _ in members[s[:-1]]) if s else None
        out.add((min(members[s])[0], len(s), parent, len(members[s]), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        if s:
            up = sums[s[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + leaves, up[2] + saved
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def collected(nodes):
    rows = [tuple(r) for r in nodes.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


ODD = [
    (1, None, "user", "hello"), (1, 0, None, "né\n"), (1, 1, "a", None), (2, None, "user", "hello"), (2, 0, "", "né\n"), (3, 5, "user", "hello"), (100, 7, "user", "x" * 50_000),
    (100, 8, "b", ""), (101, 1, "q", "own"), (130, 1, "q", "own"), (130, 2, "q", "own"), (130, 3, "q", "own"), (130, 4, "q", "z"), (None, 1, "user", "lost"), (None, None, None, None),
    (-5, 1, "n", "negative"), (-5, 2, "n", "m"), (-105, 1, "n", "negative"), (1200, 1, "q", "own"), (1203, 9, "only", "one"),
]


@pytest.mark.parametrize("rebuild", [True, False])
def test_odd_rows(spark, rebuild):
    build = trie.rebuilt_trie if rebuild else trie.trie
    assert collected(build(table(spark, ODD))) == brute(ODD, rebuild)
    assert build(table(spark, ODD).limit(0)).count() == 0
    assert build(table(spark, ODD).where("conv_id is null")).count() == 0


def test_copies_branches_and_depth(spark):
    """Many equal conversations, a long shared prefix, and conversations that end at each depth of another."""
    long = [("user", f"turn {i}") for i in range(12)]
    convs = {c: long for c in range(1000, 1060)}  # equal, in one family
    convs |= {2000 + d: long[:d] for d in range(1, 12)}  # each ends inside another
    convs |= {3000 + 7 * i: [*long[: i % 9], ("user", f"own {i}")] for i in range(40)}
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    assert collected(trie.trie(table(spark, rows))) == brute(rows, False)
    assert collected(trie.rebuilt_trie(table(spark, rows))) == brute(rows, True)


def test_repeated_turns_are_turns(spark):
    rows = [(1, 1, "a", "x")] * 3 + [(2, 1, "a", "x")] * 2
    got = sorted((r.depth, r.n_convs, r.saved_tokens) for r in trie.trie(table(spark, rows)).collect())
    assert got == [(0, 2, 2), (1, 2, 2), (2, 2, 1), (3, 1, 0)]


def test_sql_and_whole_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    got = collected(trie.rebuilt_trie(spark.read.parquet(path)))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        assert got == set(con.execute(ORACLES["op11_prefix_trie"]).fetchall())

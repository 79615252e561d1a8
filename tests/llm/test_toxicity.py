"""The grammar by examples, the composed table against its parts step by step, held-out labels, special rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from creditloom.llm import toxicity as tx


def sums(text, learned=()):
    m = tx.Matches(pa.array([text], pa.large_string()), tx.Lexicon(list(learned)), tx.grammar())
    return {tx.PATTERNS[i]: x for i, x in enumerate(m.sums[0]) if x}, int(m.clauses[0]), m.best[0] and m.best[0][1]


@pytest.mark.parametrize(
    "text, found",
    [
        ("What an idiot.", {("insult", "plain")}), ("You are an IDIOT!", {("insult_at", "plain")}), ("Idiot like you", {("insult", "plain"), ("insult_late", "plain")}),
        ("You are not an idiot.", {("insult_at", "negated")}), ('He called him an idiot', {("insult_at", "reported")}), ('the "idiot" came', {("insult", "reported")}),
        ("I will kill you", {("threat", "plain"), ("threat_late", "plain")}), ("They will destroy them", {("threat_at", "plain")}),
        ("kill them", {("threat_at", "plain")}), ("I will never kill you", {("threat", "negated"), ("threat_late", "negated")}), ("to kill time", set()), ("you said so.\nNot bad", set()),
        ("you. idiot", {("insult", "plain")}), ("you but idiot", {("insult", "plain")}), ("du bist ein Trottel", {("insult_at", "plain")}), ("Quel CRÉTIN", {("insult", "plain")}),
        ("you one two three four five idiot", {("insult", "plain")}), ("", set()), ("... !!", set()),
    ],
)
def test_grammar(text, found):
    got, clauses, best = sums(text)
    assert set(got) == found
    assert clauses == bool(found) and (best is None) == (not found)


def test_weights_follow_the_context():
    weight = lambda text: tx._rows(tx.Matches(pa.array([text], pa.large_string()), tx.Lexicon([]), tx.grammar()))[0, 0]
    assert weight("you are an idiot") > weight("some are idiots") > weight("he said some idiots") > weight("they are no idiots") > weight("nobody is here") == 0


def test_composed_table_equals_its_parts():
    rng, table = random.Random(1), tx.grammar()
    for _ in range(300):
        word = [rng.randrange(tx.QUOTE + 1) for _ in range(rng.randrange(1, 25))]
        # one transducer after the other over the whole clause
        for step, state in ((tx.threats, 0), (tx.targets, (0, "", 0)), (tx.negations, 0), (tx.reports, (False, False))):
            out, factors = [], []
            for symbol in word if step is tx.threats else stage:  # noqa: F821
                state, symbol, w = step(state, symbol)
                out.append(symbol)
                factors.append(w)
            weights = factors if step is tx.threats else [a * b for a, b in zip(weights, factors)]  # noqa: F821
            stage = out
        state, got = 0, []
        for symbol in word:
            state, pattern, w = table.arcs[state][symbol]
            got.append((pattern, w))
        assert [(tx.PATTERNS.index(s) if isinstance(s, tuple) else -1, w) for s, w in zip(stage, weights)] == got
        # gaps are skipped in one step
        for n in range(12):
            slow = state
            for _ in range(n):
                slow = table.arcs[slow][tx.OTHER][0]
            assert table.idle[min(n, tx.REACH + 1)][state] == slow


def planted(n):
    """Random prose; toxic texts hold words that begin with an unknown insult."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeilmnorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(n):
        text, bad = [rng.choice(words) for _ in range(rng.randrange(20, 200))], i % 6 == 0
        for _ in range(3 if bad else 0):
            text.insert(rng.randrange(len(text)), "zorgü" + rng.choice(words))
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    return rows, marks


def test_learns_beginnings_and_leaves_clean_texts(spark, frame):
    rows, marks = planted(900)
    # near copies of one toxic text must not make its other words suspicious
    rows += [(2000 + i, "you are an idiot " + " ".join(f"rare{k}" for k in range(60)) + f" end{i}") for i in range(150)]
    rows += [(3000 + i, " ".join(f"rare{k}" for k in range(i, i + 30))) for i in range(20)]
    marks += [(2000 + i, 1) for i in range(150)] + [(5000, 1), (None, 1), (1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    docs = frame(rows)
    model = tx.train(docs, labels)
    again = tx.train(docs.repartition(5), labels.repartition(3))
    assert model.learned == again.learned and (model.weights == again.weights).all()
    got = tx.score(docs, model).select("doc.doc_id", "held_out", "score", "predicted", "n_clauses").collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert np.mean([r.predicted for r in held if r.doc_id % 6 == 0]) > 0.95
    assert np.mean([r.predicted for r in held if r.doc_id % 6]) < 0.01
    assert not any(r.predicted for r in got if r.doc_id >= 3000)


def test_labels_of_held_out_rows_are_not_read(spark, frame):
    rows, marks = planted(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    one, two = (tx.train(frame(rows), spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, flipped))
    assert one.learned == two.learned and one.bias == two.bias and one.shift == two.shift


def test_special_rows(spark, odd, frame):
    rows, marks = planted(200)
    labels = spark.createDataFrame([*marks, *marks, (1, 1), (1, 0)], "doc_id long, toxic int")
    model = tx.train(frame([*rows, *[(1, None), (1, ""), (7, "you idiot")]]), labels)
    for m in (model, tx.UNTRAINED):
        got = tx.score(odd, m).collect()
        assert len(got) == 14 and all(r.score is not None and r.predicted == 0 for r in got)
        assert {r.doc.score for r in got} == {0.5}  # the column of the same name is the document's own
    empty = labels.limit(0)
    assert tx.train(odd, empty) is tx.UNTRAINED and tx.train(odd.limit(0), labels) is tx.UNTRAINED
    assert tx.score(odd.limit(0), tx.UNTRAINED).count() == 0
    direct = tx.score(frame([(1, "You are a pathetic idiot. I will kill you, loser!"), (None, "You are a pathetic idiot. I will kill you, loser!")]), tx.UNTRAINED).collect()
    assert all(r.predicted == 1 and r.n_clauses == 2 and r.held_out == (r.doc.doc_id is not None and zlib.crc32(b"1") % 5 == 0) for r in direct)

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from creditloom.llm.text import ALNUM, SPACED, Texts, slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z9\n\té|。", max_size=40)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_lines(texts):
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    for lower, table, pattern in ((False, SPACED, r"[^\x20\x09-\x0D]+"), (True, ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data = Texts(column, lower)
        words = data.runs(table)
        want = [re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" and lower else c for c in t or "")) for t in texts]
        got = [[words.string(i) for i in range(a, b)] for a, b in zip(words.bounds, words.bounds[1:])]
        assert got == want
        h = words.hashes()
        assert len(set(h.tolist())) == len({w for ws in want for w in ws})
        windows, first = words.windows(h, 3)
        flat = [w for ws in want for w in ws]
        grams = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
        assert [tuple(flat[i : i + 3]) for i in first] == grams
        assert len(set(windows.tolist())) == len(set(grams))
    lines = Texts(column).lines()
    assert [[lines.string(i) for i in range(a, b)] for a, b in zip(lines.bounds, lines.bounds[1:])] == [(t or "").split("\n") for t in texts]


def test_long_spans_and_slices():
    long = "x" * 5000
    words = Texts(pa.array([f"{long} {long} {long}y a"])).runs(SPACED)
    h = words.hashes()
    assert h[0] == h[1] != h[2]
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "b" * 50, "c"])})
    assert sum(b.num_rows for b in slices(batch, "text", 16)) == 5
    assert np.all([b.num_rows for b in slices(batch, "text", 16)])

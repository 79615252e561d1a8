"""Brute force on small tables, and rows that are null, empty, long, repeated or carry clashing names."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm import decontaminate, language, licenses, lines, ngram_join, packing, quality, sharding, substrings, token_store

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_quality(spark, odd, frame):
    clean = [(100 + i, " ".join(f"good{(i * 7 + k) % 90}" for k in range(80))) for i in range(60)]
    toxic = [(200 + i, t + " idiot") for i, (_, t) in enumerate(clean)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic] + [(None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(frame(clean + toxic), labels)
    assert model.names == ["toxic"]  # every label says good quality, so there is nothing to learn there
    got = {r.doc_id: r for r in quality.judge(frame(clean + toxic), model).collect()}
    assert all(got[i].kept for i, _ in clean) and not any(got[i].kept for i, _ in toxic)
    for r in quality.judge(odd, model).collect():
        assert r.base_failed or r.n_words >= 50
    text = "a b c\na b c\n a b c d & é#"
    r = quality.judge(frame([(1, text)]), model).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (12, 13, 2, 1, 9, True)
    assert quality.judge(odd.limit(0), quality.train(odd, labels.limit(0))).count() == 0


def test_language(odd, frame):
    from tests.llm.conftest import DE, EN, ES, FR

    rows = []
    for code, text in (("en", EN), ("de", DE), ("fr", FR), ("es", ES)):
        words = text.split()
        rows += [(len(rows) + i, " ".join(words[(i * 3 + k * 5) % len(words)] for k in range(12)), code) for i in range(60)]
    docs = frame(rows)
    model = language.train(docs)
    got = language.identify(docs, model).select("doc.lang", "doc.doc_id", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    found = language.identify(odd, model).select("doc.text", "lang_pred", "score").collect()
    assert len(found) == 14
    for r in found:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.identify(odd, language.train(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_token_store(odd, spark):
    tokenizer = Tokenizer.from_file(WORD)
    rows = odd.select("doc_id", "text").collect()
    got = token_store.round_trip(odd, WORD, 2).collect()
    assert len(got) == len(rows)
    ids = Counter()
    for r in rows:
        code = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        ids[r.doc_id, len(code), zlib.crc32(np.array(code, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ids
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert token_store.round_trip(odd.limit(0), WORD, 2).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    sizes, bits, slot = token_store.build(h1, h2)
    assert sorted(slot) == list(range(5000))
    assert (token_store.find(h1, h2, sizes, bits) == slot).all()
    absent = token_store.find(h2, h1, sizes, bits)
    known = token_store._fingerprint(h1, h2)[np.argsort(slot)]
    hit = absent >= 0
    assert (known[absent[hit]] != token_store._fingerprint(h2, h1)[hit]).all()


@pytest.mark.parametrize("shards", [1, 4, 40])
def test_sharding(odd, shards):
    got = sharding.assign(odd, shards).collect()
    rows = odd.count()
    assert len(got) == rows
    count = Counter(r.shard for r in got)
    assert max(count.values()) - (min(count.values()) if len(count) == shards else 0) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())
    assert sharding.assign(odd.limit(0), shards).count() == 0


def test_sharding_keeps_copies_together_and_splits_what_does_not_fit(frame):
    rows = [(i, f"text {i // 3}") for i in range(120)] + [(200 + i, "hot") for i in range(60)]
    got = sharding.assign(frame(rows), 10).collect()
    text = dict(rows)
    assert set(Counter(r.shard for r in got).values()) == {18}
    where = {}
    for r in got:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert np.mean([len(s) == 1 for t, s in where.items() if t != "hot"]) > 0.7


def test_packing(odd):
    tokenizer = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in odd.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(odd, BYTE, 2, keep_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packing.pack(odd.limit(0), BYTE, 2).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 65, 3000).tolist())
    slots = packing.plan(counts, 64)
    assert Counter({n: sum(s[2] for s in slots if s[0] == n) for n in counts}) == counts
    used = 1 + max(s[3] + s[2] - 1 for s in slots)
    free, bins = [], 0
    for n in sorted(counts.elements(), reverse=True):
        fits = [x for x in free if x >= n]
        best = min(fits) if fits else 64
        if fits:
            free.remove(best)
        else:
            bins += 1
        free.append(best - n)
    assert used == bins


def test_substrings(odd, frame):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words[:100])), (2, "a b " + " ".join(words[40:53]) + " c"), (3, " ".join(words[90:200])), (4, " ".join(words[40:52])), (5, " ".join(words[:100])), (0, " ".join(words[150:180]))]
    rows += [(None, " ".join(words[:30])), (1, " ".join(words[:50]))]
    docs = frame(rows)
    first = {}
    key = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        w = spaced(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 1 << 62), key(i))
    want = Counter()
    for i, t in rows:
        w = spaced(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < key(i) for p in range(k, k + 13)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    got = substrings.deduplicate(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    kept = {r.n_words: r.kept for r in substrings.deduplicate(odd, keep_text=True).collect()}
    assert kept[0] == "" and kept[60_001].split()[-1] == "tail" and len(kept[60_001].split()) == 1
    assert substrings.deduplicate(odd.limit(0)).count() == 0


def test_licenses(odd, frame):
    text = "Some words first.\nreleased under the MIT license\nmore words"
    got = licenses.scan(frame([(1, text), (2, text), (3, "Released under the terms"), (None, text)])).collect()
    assert Counter((r.doc_id, r.license, r.containment, r.first_word) for r in got) == Counter((i, "mit", 1.0, 3) for i in (1, 2, None))
    long = licenses.TEMPLATES["apache-2.0-header"].split()
    edited = " ".join(["x"] * 37 + long[:20] + ["changed"] + long[21:] + ["y"] * 50)
    found = {r.license: r for r in licenses.scan(frame([(1, edited)])).collect()}
    assert 0.8 <= found["apache-2.0-header"].containment < 1 and found["apache-2.0-header"].first_word == 37
    assert licenses.scan(odd).count() == 0 and licenses.scan(odd.limit(0)).count() == 0
    assert licenses.scan(odd, {"none": "", "one": "yes"}).collect()[0].doc_id == 10


def test_lines(odd, frame):
    base = "this is one long line of words that stands in many of the texts here"
    rows = [(2, f"{base}\nshort line"), (1, f"a first own line with many words\n{base} again"), (3, f"short line\n{base}\n{base}\nanother quite different line of words"), (None, base), (4, None), (5, "")]
    got = {r.doc.doc_id: r for r in lines.deduplicate(frame(rows)).collect()}
    assert got[1].n_removed == 0 and got[1].kept == rows[1][1]
    assert got[2].kept == "short line" and got[2].n_removed == 1
    assert got[3].kept == "short line\nanother quite different line of words" and got[3].n_removed == 2
    assert got[None].kept == "" and got[4].kept is None and got[5].kept == "" and got[5].n_removed == 0
    found = lines.deduplicate(odd).collect()
    assert len(found) == 14 and {r.doc.rank for r in found} == {"x"}
    assert lines.deduplicate(odd.limit(0)).count() == 0


def test_mixed_buckets_of_lines_are_compared_in_tiles(frame, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 16)  # several tiles for a bucket
    rng = np.random.default_rng(5)
    base = [f"word{i:03d}" for i in rng.integers(0, 999, 24)]
    found = set()
    for _ in range(150):  # edits of one line: many share a band, only some reach the threshold
        words = list(base)
        for p in rng.integers(0, 24, rng.integers(1, 6)):
            words[p] = f"edit{rng.integers(0, 9)}"
        found.add(" ".join(words))
    kinds = sorted(found)
    sets = [{x.encode()[i : i + 8] for i in range(len(x) - 7)} for x in kinds]
    label = list(range(len(kinds)))
    for i, j in itertools.combinations(range(len(kinds)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    assert 1 < len(set(label)) < len(kinds)
    got = lines.deduplicate(frame(list(enumerate(kinds)))).collect()
    assert {r.doc.doc_id for r in got if r.n_removed == 0} == set(label)


def test_ngram_join(odd, frame):
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in rng.integers(0, 500, 120)]
    rows = [(i, " ".join(f"o{x}" for x in rng.integers(0, 10_000, 60))) for i in range(20)]
    for i in range(300):  # near copies in one group, larger than a block
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 4)):
            words[p] = f"edit{rng.integers(0, 50)}"
        rows.append((100 + i, " ".join(words)))
    sets = {}
    for i, t in rows:
        w = spaced(t.lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r for r in ngram_join.join(frame(rows)).collect()}
    assert {i: (r.n_links, r.class_id) for i, r in got.items()} == {i: (links[i], find(i)) for i in sets}
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.join(odd).collect())
    assert found[1, 1, 2] == 2 and found[10, 1, 2] == 1 and found[6, 5, 1] == 1 and found[2, 2, 0] == found[None, None, 0] / 2 == 1
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_decontamination(odd, frame, spark):
    words = [f"q{i % 37}" for i in range(200)]
    items = [(1, " ".join(words[:25])), (1, " ".join(words[:25])), (2, "Alpha beta"), (3, None), (4, "..."), (None, " ".join(words[5:16]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(words)), (2, "x alpha, BETA y alpha"), (3, " ".join(words[3:12])), (None, " ".join(words[40:60])), (4, None), (5, "")]
    windows = {}
    for i, t in items:
        w = alnum(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    for r in decontaminate.find_leaks(frame(rows), bench).collect():
        w = alnum(r.doc.text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        assert (r.n_words, r.n_hit, set(r["items"])) == (len(w), len(hit), found)
        if r.doc.doc_id == 1:
            assert (r.longest, r.longest_at) == (25, 0)
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(frame(rows), bench).collect()) == ["3", "4", "5"]
    assert decontaminate.find_leaks(odd, bench.limit(0)).where("n_hit = 0").count() == 14
    assert decontaminate.find_leaks(odd.limit(0), bench).count() == 0

import hashlib
import itertools
import zlib

import numpy as np

import corpus_pipeline
from creditloom.llm import lines, minhash, queries
from creditloom.llm.text import mix


def test_every_line_that_is_not_blank_takes_part(spark, frame, tmp_path):
    near = "posted by the administrator in the category of local news and weather"
    rows = [
        (1, "All rights reserved.\n我们使用饼干来改善您在这个网站上的体验谢谢\nHome\n\n \n" + near.replace(" ", "-")), (2, "own\nall rights reserved.\n\n \nhome"),
        (3, "我们使用饼干来改善您在这个网站上的体验谢谢\n" + near.replace(" ", "-") + "s\nab\nhomes"), (4, "ab\nab\n我"), (None, "我\n\n\n"),
    ]
    kept = {1: rows[0][1], 2: "own\n\n ", 3: "ab\nhomes", 4: "我", None: "\n\n"}
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t.split("\n")) - len(kept[i].split("\n")), hashlib.sha256(kept[i].encode()).hexdigest()) for i, t in rows}
    stage = corpus_pipeline.deduplicate_lines(spark, frame(rows), str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in stage} == {i: t for i, t in kept.items() if t.strip()}


def test_shingles_are_runs_of_characters(spark, frame, tmp_path):
    rng = np.random.default_rng(6)
    post = "Posted on {} March 2019 by admin in category news"
    kinds = [post.format(12), post.format(13), "de un queezmill del aroo que no tajabo en la casa"]
    for alphabet in ("abcdefgh ", "абвгдежз ", "天地玄黄宇宙洪荒", "a б天😀"):  # one to four bytes, and mixed
        for _ in range(6):
            line = [alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(12, 70))]
            line[0] = line[-1] = alphabet[0]
            for _ in range(4):
                kinds.append("".join(line))
                line[rng.integers(1, len(line) - 1)] = alphabet[2]
    kinds = sorted(set(kinds))
    sets = [{x.lower()[i : i + 5] for i in range(len(x) - 4)} for x in kinds]
    near = [(i, j) for i, j in itertools.combinations(range(len(kinds)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    label = list(range(len(kinds)))
    for i, j in near:
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    assert len(near) > 20 and {kinds.index(post.format(12)), kinds.index(post.format(13))} in [set(x) for x in near]
    for x, grams in zip(kinds, sets):
        assert len(lines._grams(x.lower().encode(), 5)) == len(grams)
    frame(list(enumerate(kinds))).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.n_removed == 0} == set(label)


def test_texts_of_one_id_with_equal_checksums(spark, frame, tmp_path):
    """plumless and buckeroo have the same crc32; what one text loses must not be taken from the other."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    rows = [(None, "plumless"), (None, "buckeroo"), (1, "plumless\nown words of the first"), (2, "buckeroo"), (2, "plumless"), ((1 << 63) - 1, "the last id")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept_sha256) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(False, 1, 0, sha(rows[2][1])), (False, 2, 0, sha("buckeroo")), (False, 2, 1, sha("")), (False, (1 << 63) - 1, 0, sha("the last id")), (True, 0, 1, sha("")), (True, 0, 1, sha(""))]
    assert got == sorted(want)


def test_sketches_of_equal_share(spark):
    """Values are equal as often as Jaccard similarity says, for sets smaller and larger than the sketch."""
    rng = np.random.default_rng(7)
    sketch = minhash.Sketch(lines.ROWS * lines.BANDS)
    for common, own in ((8, 1), (80, 10), (800, 100)):
        sets = []
        for _ in range(300):
            x = rng.integers(1, 1 << 62, common + 2 * own).astype(np.uint64)
            sets += [x[: common + own], np.append(x[:common], x[common + own :])]
        made = sketch.values(mix(np.concatenate(sets)), np.full(len(sets), common + own))
        assert (made < 2 * sketch.size << 32).all() and (made == sketch.values(mix(np.concatenate([x[::-1] for x in sets])), np.full(len(sets), common + own))).all()
        assert abs((made[::2] == made[1::2]).mean() - 0.8) < 0.02
        bits = minhash.sketch_bits(made).view(np.uint64)
        assert np.bitwise_count(bits[::2] ^ bits[1::2]).sum(1).max() <= lines.DIFFER


def test_unlike_lines_of_one_vocabulary_are_hardly_compared(spark, frame):
    """Their chance pairs grow with the square of the number of lines; repeats and near copies are all found."""
    rng = np.random.default_rng(8)
    words = [f"w{i:02d}" for i in range(60)]
    kinds = [" ".join(words[i] for i in rng.integers(0, 60, 60)) for _ in range(600)]
    rows = list(enumerate(kinds)) + [(1000 + i, x + " end") for i, x in enumerate(kinds[:100])] + [(2000 + i, x) for i, x in enumerate(kinds[50:150])]
    docs = frame(rows).selectExpr("doc_id AS d", "text", "xxhash64(false, text) AS mark")
    kind = {r.kind: r["count"] for r in lines._scanned(docs, 1, 5).groupBy("kind").count().collect()}
    assert kind[lines.LINE] == 700 and kind[lines.GONE] == 100 and lines.MEMBER not in kind
    assert lines.near_lines(docs, 1, 5).count() == 200
    got = {r.doc.doc_id: r.n_removed for r in lines.deduplicate(frame(rows), 1, 5).collect()}
    assert got == {i: int(i >= 1000) for i, _ in rows}


def test_texts_are_shuffled_once_and_not_sorted(spark, frame, tmp_path):
    plan = lines.deduplicate(frame([(1, "one line of words\none line of words")]), 1, 5)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin [d" not in plan

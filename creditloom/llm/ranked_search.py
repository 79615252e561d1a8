"""Ranked lexical search: the best documents of every item by exact integer scores, with per-term geometric blocking.

The index is one row for each segment of some thousand documents. Within a segment every term's posting list is cut
into blocks of similar documents: sketches of the document vectors are assigned to the nearest of a few centres. A
block's summary holds the coordinatewise maximum of its documents' vectors. Terms are ordered by weight, and a list
answers only for documents without a heavier term of the item, so its summaries need the terms from its own on, and of
those only the ones that occur in an item together with it.

An item is searched in two passes over the segments. The first reads the lists of its heaviest terms and yields a
score that ten documents reach. The second reads the lists that can still reach it; a block is skipped only if the sum
of its summary over the item's terms, an upper bound of the scores, is lower. Everything else is scored exactly, so
the result is that of scoring all documents. Segments are independent of each other and tasks return at most ``k`` rows
for each item, so no document is sent anywhere and nothing depends on how common a term is.

Items are searched in blocks of bounded size (``BLOCK_CHARS``), each a pass of its own; only a block's terms and
weights are broadcast. Documents with equal vectors in a segment are one class with a list of ids.

Results for special rows: a null, empty or wordless text is in no result and not counted; a null doc_id is a document
and comes last among equal scores; rows that repeat a doc_id are documents of their own. A null item_id is an item;
rows that repeat an item_id are items of their own; items without a term or without a match have no rows. A document
with more than ``LONG`` different terms of the items is in no list and scored for every item. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import documents_only, store
from creditloom.llm.text import ALNUM, Texts, mix, ranges, run_starts, slices

K = 10
BLOCK_CHARS = 1_000_000  # characters of the items that are searched in one pass
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 300_000
BLOCK_DOCS = 32  # documents of a block, on average
LONG = 1024
SEEDS = 8 * K  # documents in the lists that the first pass reads
FULL = 1_000_000  # no document's share of a term's weight reaches this
_DIMENSIONS = 16
_SAT, _RANK = 20, 24  # bits of a share and of a term's rank when packed for sorting
_EXPANDED = 1 << 20  # summary entries that are made at once
_PAIRS = 1 << 24

_INDEX = (
    "ids array<long>, class_at binary, vec_at binary, vec_rank binary, vec_sat binary, "
    "block_rank binary, block_at binary, block_docs binary, sum_at binary, sum_rank binary, sum_sat binary"
)


class Terms:
    """Terms of a block of items: sorted hashes, and for each item its distinct terms."""

    def __init__(self, texts: list[str | None]):
        words = Texts(pa.array(texts, pa.large_string()), lower=True).runs(ALNUM)
        self.hashes, slot = np.unique(words.hashes(), return_inverse=True) if len(words) else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.items = [np.unique(slot[a:b]) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())]

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and (text, term, occurrences) of the items' terms, ordered by text and term."""
        words = Texts(column, lower=True).runs(ALNUM)
        if not len(words) or not len(self.hashes):
            return words.count, *(np.empty(0, np.int64),) * 3
        h = words.hashes()
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[slot] == h
        both, tf = np.unique(words.owner[hit] * len(self.hashes) + slot[hit], return_counts=True)
        return words.count, both // len(self.hashes), both % len(self.hashes), tf


def _vectors(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, n, term, tf) of every document with a word; term and tf are arrays of integers as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                n, owner, term, tf = sent.value.count(rows.column("text"))
                at = np.searchsorted(owner, np.arange(len(n) + 1))
                kept = np.flatnonzero(n > 0)
                cut = lambda x: [x[at[i] : at[i + 1]].astype("<u4").tobytes() for i in kept.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(kept)), pa.array(n[kept], pa.int64()), pa.array(cut(term), pa.binary()), pa.array(cut(tf), pa.binary())],
                    ["doc_id", "n", "term", "tf"],
                )

    return documents_only(docs).mapInArrow(run, "doc_id long, n long, term binary, tf binary")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each of the items' terms is: at most ``size`` numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found])], ["t", "df"])

    table = vectors.select("term").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[table.column("t").to_numpy()] = table.column("df").to_numpy()
    return df


class Scale:
    """Weights of the terms by rank (heaviest first) and what the formula needs of the whole collection."""

    def __init__(self, documents: int, words: int, df: np.ndarray, items: list[np.ndarray]):
        self.documents, self.words = documents, words
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
        order = np.lexsort((np.arange(len(df)), -weight))
        self.weight, self.df = weight[order], df[order]
        self.rank_of = np.empty(len(df), np.int64)
        self.rank_of[order] = np.arange(len(df))
        #: Hashed pairs of terms that are in one item. What it says too often only makes summaries longer.
        self.together = np.zeros(_PAIRS, bool)
        for terms in items:
            r = self.rank_of[terms]
            self.together[_pair(np.repeat(r, len(r)), np.tile(r, len(r)))] = True

    def shares(self, n: np.ndarray, tf: np.ndarray, owner: np.ndarray) -> np.ndarray:
        m = np.array([10 + 90 * int(x) * self.documents // self.words for x in n], np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(40)).astype(np.int64)


# --- index ---------------------------------------------------------------------------------------


def _clusters(sketch: np.ndarray) -> np.ndarray:
    """The nearest of ceil(n / BLOCK_DOCS) centres for every row; centres are rows, evenly spread along one axis."""
    n = len(sketch)
    centres = sketch[np.argsort(sketch[:, 0], kind="stable")[np.linspace(0, n - 1, -(-n // BLOCK_DOCS)).astype(np.int64)]]
    return np.argmax(sketch @ centres.T, axis=1)


def _summaries(block: np.ndarray, owner: np.ndarray, post: np.ndarray, vec_at: np.ndarray, ranks: np.ndarray, sats: np.ndarray, scale: Scale) -> np.ndarray:
    """Sorted (block, rank, greatest share), packed: of every posting the entries from its own term on."""
    rest = vec_at[owner + 1] - post
    done = np.cumsum(rest)
    made, a = [], 0
    while a < len(post):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + _EXPANDED)))
        entry = ranges(post[a:b], rest[a:b])
        kept = scale.together[_pair(np.repeat(ranks[post[a:b]], rest[a:b]), ranks[entry])]
        entry = entry[kept]
        key = np.repeat(block[a:b], rest[a:b])[kept].astype(np.uint64) << np.uint64(_RANK) | ranks[entry].astype(np.uint64)
        made.append(_maxima(key << np.uint64(_SAT) | sats[entry].astype(np.uint64)))
        a = b
    return _maxima(np.concatenate(made)) if made else np.empty(0, np.uint64)


def _maxima(packed: np.ndarray) -> np.ndarray:
    """Sorts; of equal blocks and ranks the greatest share stays."""
    packed.sort()
    last = np.ones(len(packed), bool)
    last[:-1] = (packed[1:] >> np.uint64(_SAT)) != (packed[:-1] >> np.uint64(_SAT))
    return packed[last]


def _segment(ids: list, n: np.ndarray, rank: list[np.ndarray], tf: list[np.ndarray], scale: Scale) -> dict:
    count = np.array([len(r) for r in rank], np.int64)
    owner = np.repeat(np.arange(len(ids)), count)
    ranks, tfs = (np.concatenate(x).astype(np.int64) for x in (rank, tf))
    order = np.lexsort((ranks, owner))
    ranks, sats = ranks[order], scale.shares(n, tfs, owner)[order]
    cut = np.cumsum(count) - count
    # documents of equal vectors are one class
    classes: dict[bytes, list[int]] = {}
    for i, (a, c) in enumerate(zip(cut.tolist(), count.tolist())):
        classes.setdefault(ranks[a : a + c].tobytes() + sats[a : a + c].tobytes(), []).append(i)
    first = np.array([c[0] for c in classes.values()], np.int64)
    length = count[first]
    take = ranges(cut[first], length)
    ranks, sats = ranks[take], sats[take]
    vec_at = np.concatenate([[0], np.cumsum(length)])
    owner = np.repeat(np.arange(len(first)), length)
    # postings of the classes that are not too long, and what similarity they have
    post = np.flatnonzero(length[owner] <= LONG)
    lots = np.arange(_DIMENSIONS, dtype=np.uint64) + ranks[:, None].astype(np.uint64) * np.uint64(_DIMENSIONS)
    signs = np.where(mix(lots) & np.uint64(1), 1.0, -1.0)
    sketch = np.add.reduceat((scale.weight[ranks] * sats)[:, None] * signs, vec_at[:-1], axis=0)
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    post = post[np.argsort(ranks[post], kind="stable")]
    starts = run_starts(ranks[post])
    label = np.zeros(len(post), np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(post)]):
        if b - a > BLOCK_DOCS:
            label[a:b] = _clusters(sketch[owner[post[a:b]]])
    key = ranks[post] * (len(first) + 1) + label
    order = np.argsort(key, kind="stable")
    post, key = post[order], key[order]
    block_at = run_starts(key)
    block = np.repeat(np.arange(len(block_at)), np.diff(np.append(block_at, len(post))))
    packed = _summaries(block, owner[post], post, vec_at, ranks, sats, scale)
    sum_block = (packed >> np.uint64(_SAT + _RANK)).astype(np.int64)
    grouped = [sorted((ids[i] for i in c), key=lambda x: (x is None, x or 0)) for c in classes.values()]
    put = lambda x, t="<u4": np.ascontiguousarray(x).astype(t).tobytes()
    return {
        "ids": [x for g in grouped for x in g], "class_at": put(np.concatenate([[0], np.cumsum([len(g) for g in grouped])])), "vec_at": put(vec_at),
        "vec_rank": put(ranks), "vec_sat": put(sats), "block_rank": put(ranks[post[block_at]]), "block_at": put(np.append(block_at, len(post))),
        "block_docs": put(owner[post]), "sum_at": put(np.searchsorted(sum_block, np.arange(len(block_at) + 1))),
        "sum_rank": put((packed >> np.uint64(_SAT)) & np.uint64((1 << _RANK) - 1)), "sum_sat": put(packed & np.uint64((1 << _SAT) - 1)),
    }


def build(vectors: DataFrame, scale: Scale) -> DataFrame:
    """The index, one row for each segment. Map-only; a segment is bounded in documents and postings."""
    sent = vectors.sparkSession.sparkContext.broadcast(scale)
    types = [pa.list_(pa.int64()), *[pa.binary()] * 10]
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = sent.value
        ids, n, rank, tf, work = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            made = _segment(ids, np.array(n, np.int64), rank, tf, scale)
            return pa.RecordBatch.from_arrays([pa.array([made[c]], t) for c, t in zip(names, types)], names)

        for batch in batches:
            for doc_id, words, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "term", "tf"))):
                if not terms:
                    continue
                r = scale.rank_of[np.frombuffer(terms, "<u4")]
                if ids and (len(ids) >= SEGMENT_DOCS or work + len(r) > SEGMENT_POSTINGS):
                    yield flush()
                    ids, n, rank, tf, work = [], [], [], [], 0
                ids.append(doc_id)
                n.append(words)
                rank.append(r)
                tf.append(np.frombuffer(counts, "<u4"))
                work += len(r)
        if ids:
            yield flush()

    return vectors.mapInArrow(run, _INDEX)


# --- search --------------------------------------------------------------------------------------


class Queries:
    """Items as ranks of their terms, the lists that are read for each, and scores known to be reached."""

    def __init__(self, items: list[np.ndarray], scale: Scale):
        self.weight = scale.weight
        self.items = []
        for terms in items:
            r = np.sort(scale.rank_of[terms])
            self.items.append(r[scale.weight[r] > 0])
        self.reached = [1] * len(items)
        self.lists = []
        for r in self.items:
            found = np.cumsum(scale.df[r])
            self.lists.append(int(np.searchsorted(found, SEEDS)) + 1)

    def raise_to(self, reached: dict[int, int]) -> None:
        """From now on only scores of at least ``reached`` count, and lists are read that can reach it."""
        for i, r in enumerate(self.items):
            self.reached[i] = max(1, reached.get(i, 1))
            rest = np.cumsum((self.weight[r] * FULL)[::-1])[::-1]
            self.lists[i] = int((rest >= self.reached[i]).sum())


class Segment:
    """One row of the index."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        for name, raw in row.items():
            if name != "ids":
                setattr(self, name, np.frombuffer(raw, "<u4").astype(np.int64))
        length = np.diff(self.vec_at)
        self.long = np.flatnonzero(length > LONG)

    def scores(self, classes: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact score of each class, and the rank of its heaviest term of the item."""
        size = self.vec_at[classes + 1] - self.vec_at[classes]
        entry = ranges(self.vec_at[classes], size)
        part = weight[self.vec_rank[entry]] * self.vec_sat[entry]
        start = np.cumsum(size) - size
        heavy = np.where(part > 0, self.vec_rank[entry], np.iinfo(np.int64).max)
        return np.add.reduceat(part, start), np.minimum.reduceat(heavy, start)

    def search(self, ranks: np.ndarray, weight: np.ndarray, reached: int) -> tuple[np.ndarray, np.ndarray]:
        """(class, score) of the documents that the lists of ``ranks`` answer for and whose score is ``reached`` or more.

        ``weight`` holds the weights of the item's terms by rank and zero elsewhere.
        """
        lo, hi = np.searchsorted(self.block_rank, ranks), np.searchsorted(self.block_rank, ranks, "right")
        blocks = ranges(lo, hi - lo)
        found, sums = [], []
        if len(blocks):
            size = self.sum_at[blocks + 1] - self.sum_at[blocks]
            entry = ranges(self.sum_at[blocks], size)
            bound = np.add.reduceat(weight[self.sum_rank[entry]] * self.sum_sat[entry], np.cumsum(size) - size)
            blocks = blocks[bound >= reached]
        if len(blocks):
            size = self.block_at[blocks + 1] - self.block_at[blocks]
            classes = self.block_docs[ranges(self.block_at[blocks], size)]
            score, heavy = self.scores(classes, weight)
            # a document with a heavier term of the item is answered for by that term's list
            mine = (score >= reached) & (heavy == np.repeat(self.block_rank[blocks], size))
            found.append(classes[mine])
            sums.append(score[mine])
        if len(self.long):
            score, _ = self.scores(self.long, weight)
            found.append(self.long[score >= reached])
            sums.append(score[score >= reached])
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found), np.concatenate(sums)

    def best(self, classes: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, bool, int | None]]:
        """The ``k`` best documents as (-score, id is null, id). Of one class the least ids suffice."""
        if len(classes) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            classes, score = classes[keep], score[keep]
        out = []
        for c, s in zip(classes.tolist(), score.tolist()):
            a, b = int(self.class_at[c]), int(self.class_at[c + 1])
            out += [(-s, x is None, x) for x in self.ids[a : min(b, a + k)]]
        return sorted(out, key=_order)[:k]


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] or 0


def _pass(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, score, doc_id): of every task the best documents of each item, by the lists chosen in ``queries``."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best: dict[int, list] = {}
        weight = np.zeros(len(q.weight), np.int64)
        reached = list(q.reached)
        for batch in batches:
            for at in range(batch.num_rows):
                segment = Segment(batch.slice(at, 1).to_pylist()[0])
                for i, r in enumerate(q.items):
                    if not len(r):
                        continue
                    weight[r] = q.weight[r]
                    classes, score = segment.search(r[: q.lists[i]], weight, reached[i])
                    weight[r] = 0
                    if len(classes):
                        best[i] = sorted(best.get(i, []) + segment.best(classes, score, k), key=_order)[:k]
                        if len(best[i]) == k:
                            reached[i] = max(reached[i], -best[i][-1][0])
        rows = [(i, -s, x) for i, found in best.items() for s, _, x in found]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "score", "doc_id"])

    return index.mapInArrow(run, "item long, score long, doc_id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    terms = Terms([r["text"] for r in rows])
    vectors = store(_vectors(docs, terms), "search-vectors")
    total = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    scale = Scale(total["n"], total["l"] or 1, _frequencies(vectors, len(terms.hashes)), terms.items)
    index = store(build(vectors, scale), "search-index")
    queries = Queries(terms.items, scale)
    tenth = _top(_pass(index, queries, k), k).where(F.col("rank") == k).select("item", "score").collect()
    queries.raise_to({r["item"]: r["score"] for r in tenth})
    names = spark.createDataFrame([(i, r["row"]) for i, r in enumerate(rows)], "item long, row long")
    return _top(_pass(index, queries, k), k).join(F.broadcast(names), "item").select("row", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    rows = store(rows, "search-items")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = -(-chars // BLOCK_CHARS) or 1, None
    for b in range(blocks):
        # about BLOCK_CHARS characters each
        mine = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "text").orderBy("row").collect()
        made = store(_search_block(docs, mine, k), "search-found")
        out = made if out is None else out.unionByName(made)
    return out.join(rows.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")

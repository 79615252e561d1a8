"""Benchmark decontamination with suffix arrays over the training text.

Every task cuts its documents into shards of a few megabytes and sorts each shard's word suffixes into a suffix
array. All suffixes of all benchmark items are binary-searched in it at once, one word deeper per step, which
gives their longest verbatim matches and every place where these stand. The benchmark is a stated query set: it is
read in blocks, each broadcast, and every shard searches every block.

Results for special rows: a null or empty text, document or item, has no words and hits nothing. Rows that repeat
a doc_id are judged one by one. Items that repeat an item_id count once; a null item_id is written as an empty
string. Words are compared by 64-bit hashes. Columns of the documents are handed through in a struct, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.text import ALNUM, Texts, ranges, run_starts, slices, tidy

WINDOW = 10
BLOCK_CHARS = 4 << 20


class Queries:
    """A block of benchmark items: word hashes, item bounds, and each suffix's window length (0: none)."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        words = Texts(pa.array(texts, pa.string()), lower=True).runs(ALNUM)
        self.ids, self.hash = ids, words.hashes()
        self.item = words.owner
        left = words.bounds[1:][words.owner] - np.arange(len(words))
        length = words.count[words.owner]
        self.left = left
        # a whole window fits, or the item is short and this is its first word
        self.window = np.where(left >= np.minimum(length, window), np.minimum(length, window), 0)


class SuffixArray:
    """Suffixes of a shard's word sequence, sorted by their first ``depth`` words."""

    def __init__(self, h: np.ndarray, bounds: np.ndarray, depth: int):
        codes, self.vocabulary = pd.factorize(h)
        order = np.argsort(self.vocabulary)
        self.vocabulary = self.vocabulary[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        # one zero after each text keeps matches inside it
        docs = len(bounds) - 1
        self.size = len(h) + docs
        self.symbols = np.zeros(self.size + depth + 64, np.int64)
        self.words = np.arange(len(h)) + np.repeat(np.arange(docs), np.diff(bounds))
        self.symbols[self.words] = rank[codes]
        self.order = self._sorted(depth, int(len(order)).bit_length())

    def _sorted(self, depth: int, bits: int) -> np.ndarray:
        n = self.size
        width = max(1, 62 // max(bits, 1))
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = (key << bits) | self.symbols[k : k + n]
        order = np.argsort(key)
        place = np.zeros(n + depth + 64, np.int64)  # of each suffix: where its group of equals begins
        starts = run_starts(key[order])
        place[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        del key
        while width < depth:
            sizes = np.diff(np.append(starts, n))
            tied = np.repeat(sizes > 1, sizes)
            slots = np.flatnonzero(tied)
            if not len(slots):
                break
            # groups of equals are ordered by the group that stands ``width`` words on; the padding is lowest
            mine = order[slots]
            ahead = np.where(mine + width < n, place[mine + width] + 1, 0)
            both = place[mine] * (n + 1) + ahead
            by = np.argsort(both, kind="stable")
            order[slots] = mine[by]
            both = both[by]
            fresh = run_starts(both)
            place[order[slots]] = np.repeat(slots[fresh], np.diff(np.append(fresh, len(slots))))
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            width *= 2
        return order

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range, the part whose word at ``depth`` is ``symbol``."""
        return self._bound(low, high, depth, symbol), self._bound(low, high, depth, symbol + 1)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = self.symbols[self.order[middle] + depth] < symbol[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]
            open_ = open_[low[open_] < high[open_]]
        return low


def search(array: SuffixArray, q: Queries, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix place, item) of every window occurrence; raises ``longest`` to the match length at each place."""
    at = np.searchsorted(array.vocabulary, q.hash)
    known = at < len(array.vocabulary)
    known[known] = array.vocabulary[at[known]] == q.hash[known]
    symbol = np.where(known, at + 1, 0)
    live = np.flatnonzero(q.window > 0)
    low, high = np.zeros(len(q.hash), np.int64), np.full(len(q.hash), array.size, np.int64)
    places, items = [], []
    depth = 0
    while len(live):
        live = live[(depth < q.left[live])]
        live = live[symbol[live + depth] > 0]
        low[live], high[live] = array.narrow(low[live], high[live], depth, symbol[live + depth])
        live = live[low[live] < high[live]]
        depth += 1
        # equal windows of different items share their places
        reached = live[q.window[live] <= depth]
        if len(reached):
            spans, first = np.unique(np.stack([low[reached], high[reached]], 1), axis=0, return_index=True)
            longest[array.order[ranges(spans[:, 0], spans[:, 1] - spans[:, 0])]] = depth
        done = live[q.window[live] == depth]
        if len(done):
            pairs = np.unique(np.stack([low[done], high[done], q.item[done]], 1), axis=0)
            count = pairs[:, 1] - pairs[:, 0]
            places.append(array.order[ranges(pairs[:, 0], count)])
            items.append(np.repeat(pairs[:, 2], count))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(items)


def _shard(texts: pa.Array, blocks: list[Queries]) -> dict[str, pa.Array]:
    words = Texts(texts, lower=True).runs(ALNUM)
    docs = len(words.count)
    n_hit, far, far_at = np.zeros(docs, np.int64), np.zeros(docs, np.int64), np.full(docs, -1, np.int64)
    found: list[list[str]] = [[] for _ in range(docs)]
    depth = max((int(q.left.max()) for q in blocks if len(q.left)), default=0)
    if len(words) and depth:
        array = SuffixArray(words.hashes(), words.bounds, depth)
        longest = np.zeros(array.size, np.int64)
        for q in blocks:
            deepest = np.zeros(array.size, np.int64)
            places, items = search(array, q, deepest)
            if len(places):
                word = np.searchsorted(array.words, places)
                for d, i in np.unique(np.stack([words.owner[word], items], 1), axis=0).tolist():
                    found[d].append(q.ids[i])
                longest = np.maximum(longest, deepest)
        length = longest[array.words]
        hit = np.flatnonzero(length)
        # a match of ``length`` words covers them all
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, hit, 1)
        np.add.at(change, hit + length[hit], -1)
        covered = np.cumsum(change[:-1]) > 0
        n_hit = np.bincount(words.owner[covered], minlength=docs)
        by = np.lexsort((hit, -length[hit], words.owner[hit]))
        hit = hit[by][run_starts(words.owner[hit][by])]
        far[words.owner[hit]] = length[hit]
        far_at[words.owner[hit]] = hit - words.bounds[words.owner[hit]]
    return {
        "n_words": pa.array(words.count, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "items": pa.array([sorted(set(x)) for x in found], pa.list_(pa.string())),
        "longest": pa.array(far, pa.int64()),
        "longest_at": pa.array([None if x < 0 else int(x) for x in far_at], pa.int64()),
    }


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Queries]:
    ids: list[str] = []
    texts: list[str | None] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator()
    for item, text in rows:
        ids.append(item or "")
        texts.append(text)
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield Queries(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts, window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document (struct ``doc``) with ``n_words``, ``n_hit`` (words inside occurrences of benchmark windows),
    ``items`` (sorted ids of the items found), ``longest`` (words of its longest verbatim match, 0: none) and
    ``longest_at`` (the word where that begins).

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. Map-only.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(q) for q in _blocks(benchmark, window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [b.value for b in blocks]
        for batch in batches:
            for part in slices(batch, "text"):
                made = {"doc": part.column("doc"), **_shard(part.column("text"), queries)}
                yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    schema = (
        T.StructType().add("doc", docs.schema, False).add("n_words", "long").add("n_hit", "long")
        .add("items", T.ArrayType(T.StringType())).add("longest", "long").add("longest_at", "long")
    )
    pair = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    return pair.mapInArrow(tidy(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold an occurrence of a benchmark window."""
    return find_leaks(docs, benchmark, window).where("n_hit = 0").select("doc.*")

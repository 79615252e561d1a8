"""Removal of word passages that repeat across documents, found by difference-cover anchors.

A window of ``WINDOW`` words is removed where its words also begin in a document with a smaller doc_id. Hashing every
window would shuffle a row for each word. Instead only anchors of ``ANCHOR`` words are hashed, at places whose index
modulo ``PERIOD`` lies in the difference cover {0, 1, 3}: for any two places some shift below ``PERIOD`` brings both
onto the cover, so two equal windows always share an aligned anchor. Anchors that occur once are settled; around the
others the match is extended to whole windows, which are then compared exactly (64-bit hashes of 13 words).

The shared anchors go to the second scan as a Bloom filter of fixed size, however large the corpus. What it lets through by mistake costs a row and changes nothing; when far more anchors are
shared than it has room for, the second scan simply hashes more windows.

Results for special rows: null and empty texts have no words; a null doc_id counts as the largest; rows that repeat a
doc_id are one document with several texts, which do not remove words from each other. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import documents_only, store
from creditloom.llm.filters import collect, contains, dealt, labels, packed, repeated
from creditloom.llm.text import SPACED, Spans, Texts, ranges, signed, slices, window_hashes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_LAST = (1 << 63) - 1


def _anchors(words: Spans, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word index of the anchors at cover places of texts that have a window."""
    index = np.arange(len(words)) - words.bounds[words.owner]
    on = np.isin(np.arange(PERIOD), COVER)[index % PERIOD] & (words.count[words.owner] - index >= ANCHOR) & (words.count[words.owner] >= WINDOW)
    at = np.flatnonzero(on)
    return window_hashes(h, ANCHOR)[at], at


def shared_anchors(docs: DataFrame, buckets: int) -> np.ndarray:
    """Filter of the anchors that stand in two texts or more. They travel packed, a row for each slice and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                words = Texts(rows.column("text")).runs(SPACED)
                h, at = _anchors(words, words.hashes())
                owner = words.owner[at]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                fresh = np.ones(len(h), bool)
                fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                yield packed(h[fresh], buckets)

    return repeated(docs.select("text").mapInArrow(run, "bucket long, keys binary"))


def candidate_windows(docs: DataFrame, shared: np.ndarray, buckets: int) -> DataFrame:
    """w (hash), d (doc_id) and at (word index and the text's crc32) of the windows around shared anchors."""
    sent = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for rows in slices(batch, "text"):
                words = Texts(rows.column("text")).runs(SPACED)
                h = words.hashes()
                anchor, at = _anchors(words, h)
                at = at[contains(table, labels(*dealt(anchor, buckets)))]
                near = np.zeros(len(words) + 1, np.int64)
                # the windows that begin up to PERIOD - 1 words before an anchor hold it
                np.add.at(near, np.maximum(at - PERIOD + 1, words.bounds[words.owner[at]]), 1)
                np.add.at(near, at + 1, -1)
                index = np.arange(len(words))
                start = np.flatnonzero((np.cumsum(near[:-1]) > 0) & (words.bounds[1:][words.owner] - index >= WINDOW))
                owner = words.owner[start]
                crc = np.zeros(rows.num_rows, np.int64)
                data = memoryview(words.texts.bytes)
                for i in np.unique(owner).tolist():
                    crc[i] = zlib.crc32(data[words.texts.at[i] : words.texts.at[i + 1]])
                d = rows.column("d").to_numpy(zero_copy_only=False)[owner]
                place = (start - words.bounds[owner]) << 32 | crc[owner]
                yield pa.RecordBatch.from_arrays([pa.array(signed(window_hashes(h, WINDOW)[start])), pa.array(d), pa.array(place)], ["w", "d", "at"])

    return docs.select("d", "text").mapInArrow(run, "w long, d long, at long")


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of removed windows as runs of words: first, end, first, end ..."""
    for batch in batches:
        runs = []
        for x in batch.column("starts"):
            at = np.unique(np.asarray(x.values))
            cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
            runs.append(np.stack([at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + WINDOW], 1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("crc"), pa.array(runs, pa.list_(pa.int32()))], ["d", "crc", "runs"])


def deduplicate(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by spaces (``kept``).

    Only texts that lose words travel to their runs; the others are finished where they are read. Which is which
    says a filter of fixed size; a text that it lets through by mistake travels and loses nothing.
    """
    plain = documents_only(docs).withColumn("d", F.coalesce("doc_id", F.lit(_LAST)))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    windows = candidate_windows(plain, shared_anchors(plain, buckets), buckets)
    first = windows.groupBy("w").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("w", "first")
    repeats = windows.join(first, "w").where("d > first")
    starts = repeats.groupBy("d", F.expr("at & 4294967295").alias("crc")).agg(F.collect_list(F.expr("cast(at >> 32 as int)")).alias("starts"))
    runs = store(starts.mapInArrow(_covered, "d long, crc long, runs array<int>"), "runs")
    sent = docs.sparkSession.sparkContext.broadcast(collect(runs.select(F.xxhash64("d", "crc").alias("h"))))

    def losing(rows: pa.RecordBatch) -> np.ndarray:
        return contains(sent.value, rows.column("h").to_numpy(zero_copy_only=False).view(np.uint64))

    def travels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "d", "crc", "text"]).filter(pa.array(losing(batch)))

    def stays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(["doc_id", "text"]).filter(pa.array(~losing(batch)))
            for rows in slices(rest, "text"):
                yield _kept(rows.append_column("runs", pa.nulls(rows.num_rows, pa.list_(pa.int32()))), keep_text)

    def loses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                yield _kept(rows, keep_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    keyed = plain.withColumn("crc", F.crc32(F.encode("text", "utf-8"))).withColumn("h", F.xxhash64("d", "crc"))
    moved = keyed.select("doc_id", "d", "crc", "h", "text").mapInArrow(travels, "doc_id long, d long, crc long, text string")
    moved = moved.join(runs, ["d", "crc"], "left").select("doc_id", "text", "runs")
    return keyed.select("doc_id", "h", "text").mapInArrow(stays, schema).unionByName(moved.mapInArrow(loses, schema))


def _kept(rows: pa.RecordBatch, keep_text: bool) -> pa.RecordBatch:
    words = Texts(rows.column("text")).runs(SPACED)
    lists = rows.column("runs")
    change = np.zeros(len(words) + 1, np.int64)
    ends = lists.flatten().to_numpy(zero_copy_only=False)
    if len(ends):
        size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
        ends = ends + np.repeat(words.bounds[:-1], size)
        np.add.at(change, ends[::2], 1)
        np.add.at(change, ends[1::2], -1)
    stays = np.cumsum(change[:-1]) == 0
    left = np.bincount(words.owner[stays], minlength=rows.num_rows)
    begin, length = words.start[stays], (words.end - words.start)[stays] + 1
    out = words.texts.bytes[ranges(begin, length)]
    cut = np.cumsum(length)
    out[cut - 1] = 32
    ends = np.concatenate([[0], cut])[np.concatenate([[0], np.cumsum(left)])]
    data = memoryview(out)
    spans = [data[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    columns = [
        rows.column("doc_id"), pa.array(words.count, pa.int64()), pa.array(words.count - left, pa.int64()),
        pa.array([hashlib.sha256(s).hexdigest() for s in spans]),
    ]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if keep_text:
        columns.append(pa.array([bytes(s).decode() for s in spans]))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names)

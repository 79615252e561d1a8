"""Similarity join of documents on word 5-grams with Bayesian pruning of candidates.

Documents with equal shingle sets form one node. MinHash bands collect candidates; a candidate only has to share one
band key with its bucket's least node, so buckets of any size give one edge for each member. The components of these
edges are cut into tiles of at most 2 x ``BLOCK`` nodes that go to tasks with their shingles. A tile compares
signatures a few values at a time, drops pairs whose posterior probability of reaching the threshold falls below the
tolerance, and verifies the rest exactly on the shingle sets. Tiles return sums and one union edge for each node,
never pairs; distributed union-find over these edges gives the classes.

Results for special rows: a document of fewer than five words has one shingle, all its words; without a word (null,
empty) it is alone, whatever else is empty. Rows that repeat a doc_id are compared by their texts like others. A null
doc_id is kept and counts as the largest. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import components, documents_only, rank_within, store
from creditloom.llm.filters import collect, contains
from creditloom.llm.minhash import MinHash, band_keys, prune
from creditloom.llm.text import SPACED, Texts, mix, run_starts, signed, slices, tidy, window_hashes

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
ROWS, BANDS = 6, 48  # a pair at 0.8 shares no band once in 2 million cases
BLOCK = 256
_LAST = (1 << 63) - 1


class Shingles:
    """Distinct word shingles of each text of a column, sorted within the text; ``kept``: the texts that have any."""

    def __init__(self, column: pa.Array):
        words = Texts(column, lower=True).runs(SPACED)
        h = words.hashes()
        size = np.minimum(words.count, SHINGLE)
        index = np.arange(len(words))
        full = words.bounds[1:][words.owner] - index >= size[words.owner]
        at = np.flatnonzero(full)
        grams = window_hashes(h, SHINGLE)[at]
        short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
        if len(short):
            # a short text's only shingle must not depend on what follows it
            slot = np.searchsorted(at, words.bounds[short])
            for i, k in zip(short.tolist(), slot.tolist()):
                own = h[words.bounds[i] : words.bounds[i + 1]]
                grams[k] = window_hashes(own, len(own))[0] ^ np.uint64(len(own))
        owner = words.owner[at]
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        fresh = np.ones(len(grams), bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        self.grams, owner = grams[fresh], owner[fresh]
        self.starts = run_starts(owner)
        self.kept = owner[self.starts]
        self.sizes = np.diff(np.append(self.starts, len(owner)))

    def nodes(self) -> np.ndarray:
        """A 64-bit hash of each kept text's set."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        return mix(np.add.reduceat(mix(self.grams), self.starts) + self.sizes.astype(np.uint64))


def _signed_documents(docs: DataFrame) -> DataFrame:
    """doc_id, node (null without words) and the node's band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(ROWS * BANDS)
        for batch in batches:
            for rows in slices(batch, "text"):
                s = Shingles(rows.column("text"))
                keys = band_keys(hashes.signatures(s.grams, s.starts), ROWS)
                nodes = np.zeros(rows.num_rows, np.uint64)
                nodes[s.kept] = s.nodes()
                none = np.ones(rows.num_rows, bool)
                none[s.kept] = False
                offsets = np.zeros(rows.num_rows + 1, np.int32)
                offsets[1:] = np.cumsum(~none) * BANDS
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(signed(nodes), mask=none), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(keys.ravel())))],
                    ["doc_id", "node", "keys"],
                )

    return docs.mapInArrow(tidy(run), "doc_id long, node long, keys array<long>")


def _mixed(node: np.ndarray, d: np.ndarray) -> np.ndarray:
    return mix(node.view(np.uint64) ^ mix(d.view(np.uint64)))


def _wanted(reps: DataFrame) -> np.ndarray:
    """Filter of the (node, d) whose shingles are needed; what it lets through more is joined away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(signed(_mixed(batch.column("node").to_numpy(), batch.column("d").to_numpy())))], ["h"])

    return collect(reps.select("node", "d").mapInArrow(tidy(run), "h long"))


def _payloads(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """node, d, shingles and signature of the documents in the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = MinHash(ROWS * BANDS)
        table = sent.value
        for batch in batches:
            for rows in slices(batch, "text"):
                s = Shingles(rows.column("text"))
                nodes = s.nodes()
                d = rows.column("d").to_numpy(zero_copy_only=False)[s.kept]
                mine = np.flatnonzero(contains(table, _mixed(signed(nodes), d)))
                sets = [s.grams[s.starts[i] : s.starts[i] + s.sizes[i]] for i in mine]
                starts = np.cumsum([0, *(len(x) for x in sets)])[:-1]
                found = hashes.signatures(np.concatenate(sets) if sets else np.empty(0, np.uint64), starts[: len(sets)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(nodes[mine])), pa.array(d[mine]), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())],
                    ["node", "d", "shingles", "signature"],
                )

    return docs.select("d", "text").mapInArrow(tidy(run), "node long, d long, shingles binary, signature binary")


def overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sets."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    used = np.unique(np.concatenate([a, b]))
    place = np.zeros(len(sets), np.int64)
    place[used] = np.arange(len(used))
    codes, _ = pd.factorize(np.concatenate([sets[i] for i in used]))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    # only shingles of two sets or more can be common; each of the others would be a column of its own
    often = np.bincount(codes) > 1
    column = np.cumsum(often) - 1
    keep = often[codes]
    owner, codes = owner[keep], column[codes[keep]]
    width = int(often.sum()) // 64 + 1
    bits = np.zeros((len(used), width), np.uint64)
    np.bitwise_or.at(bits, (owner, codes >> 6), np.uint64(1) << (codes & 63).astype(np.uint64))
    out = np.empty(len(a), np.int64)
    step = max(1, (4 << 20) // width)
    for k in range(0, len(a), step):
        x, y = place[a[k : k + step]], place[b[k : k + step]]
        out[k : k + step] = np.bitwise_count(bits[x] & bits[y]).sum(1)
    return out


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least one that the links (a, b) connect it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """Applies ``work`` to each group of rows that come sorted by ``names``; a group may go over several batches."""
    rest: list[pd.DataFrame] = []

    def done(rows: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        parts = [work(part) for _, part in rows.groupby(names, sort=False)]
        if parts:
            yield pa.RecordBatch.from_pandas(pd.concat(parts), preserve_index=False)

    for batch in batches:
        rows = batch.to_pandas()
        if rest:
            rows = pd.concat([*rest, rows], ignore_index=True)
        if not len(rows):
            continue
        open_ = (rows[names] == rows[names].iloc[-1]).all(axis=1)
        rest = [rows[open_]]
        yield from done(rows[~open_])
    if rest:
        yield from done(rest[0])


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of one tile: node, links (documents that it meets here), hub (least node of its component here)."""
    rows = rows.sort_values("node")
    node, side, weight = rows["node"].to_numpy(), rows["side"].to_numpy(), rows["weight"].to_numpy()
    signature = np.stack([np.frombuffer(x, np.uint32) for x in rows["signature"]])
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    size = np.array([len(x) for x in sets])
    # a tile of one block compares all its nodes, a tile of two blocks those of different blocks
    one = (side == 0).all()
    left, right = (np.arange(len(node)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = []
    for i in left:
        j = right[right > i] if one else right
        # no set reaches the threshold with one that is too small
        j = j[np.minimum(size[j], size[i]) >= THRESHOLD * np.maximum(size[j], size[i])]
        found.append(np.stack([np.full(len(j), i), j]))
    a, b = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    alive = prune(signature, signature, a, b, THRESHOLD, TOLERANCE)
    a, b = a[alive], b[alive]
    both = overlaps(sets, a, b)
    linked = both * 10 >= 8 * (size[a] + size[b] - both)
    a, b = a[linked], b[linked]
    links = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
    label = least_linked(len(node), a, b)
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "hub": node[label[some]]})


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from whole_groups(batches, ["root", "low", "high"], _tile)


def join(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of all documents connected by links), n_links (other documents at a Jaccard
    similarity of 0.8 or more, copies included), copy_id (least doc_id of the same shingle set), n_copies."""
    plain = documents_only(docs)
    ordered = plain.withColumn("d", F.coalesce("doc_id", F.lit(_LAST)))
    made = store(_signed_documents(plain), "signed")
    members = made.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "node")
    classes = store(members.where("node is not null").groupBy("node").agg(F.min("d").alias("d"), F.count("*").alias("weight")), "classes")
    keys = made.where("node is not null").select(F.explode("keys").alias("key"), "node")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top")
    edges = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = rank_within(components(edges, "candidates"), ["root"], "blocks").withColumn("block", F.floor(F.col("rank") / BLOCK).cast("int"))
    near = store(near.select("node", "root", "block").join(classes, "node"), "near")
    blocks = near.groupBy("root").agg((F.max("block") + 1).alias("blocks"))
    payload = store(_payloads(ordered, _wanted(near)), "payloads").join(near.drop("weight"), ["node", "d"], "left_semi").dropDuplicates(["node"])
    tiles = (
        near.join(blocks, "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "weight", "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    )
    sent = tiles.join(payload.select("node", "shingles", "signature"), "node").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    linked = store(sent.mapInArrow(tidy(_tiles), "node long, links long, hub long"), "links")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("node").alias("a"), F.col("hub").alias("b")), "classes")
    least = roots.join(classes, "node").groupBy("root").agg(F.min("d").alias("least"))
    known = classes.join(counts, "node", "left").join(roots.join(least, "root"), "node", "left").select(
        "node", F.col("d").alias("first"), "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least", "d").alias("least")
    )
    id_ = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return members.join(known, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(id_("least")).alias("class_id"),
        F.coalesce(F.col("weight") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(id_("first")).alias("copy_id"), F.coalesce("weight", F.lit(1)).alias("n_copies"),
    )

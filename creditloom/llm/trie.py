"""Prefix trie of conversations, by truncation peeling.

A node of depth d is a distinct sequence of first d turns. The trie is taken apart from its greatest depth upwards: at
each depth the conversations that newly end there are merged with the nodes that survive from the depth below, one
grouping discovers the nodes of this depth together with all their sums, and the survivors lose their last turn.

A sequence is known by two 64-bit hashes, each the exclusive or of its turns' hashes tagged with their positions, so
all prefixes come from running aggregates and no text travels. Equal conversations become one sequence with a count.
What a sequence shares with no other is a chain without branches: it is peeled in its row at once, and the rounds, one
grouping with partial aggregation each, run over shared depths only. A hot first turn, conversation or prefix is
summed before its shuffle; a hot conv_id is numbered and hashed in pieces.

Results for special rows: turns of one conv_id are ordered by turn (null first), rows of equal turn by a hash of role
and text; a repeated row is a turn of its own. A null role or text is empty, however long a text is only its hash and
length are kept. Rows without conv_id belong to no conversation. A conversation without turns ends at the root. An
empty table has no node, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import store

_PIECE = 4096  # positions that are hashed one after another in one group
_PACKED = 1 << 16  # bytes of decimal conv_ids in one piece of a digest
_KEY = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, n): place in its conversation from 1, two hashes and the code points of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"), F.length(text).cast("long").alias("n"),
    )
    # ranges of (conv_id, turn) may cut a conversation, so none has to fit into one task
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("row")]
    placed = store(
        turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns"
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("conv_id", "part").agg(F.count("*").alias("size")).select(
        "conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead")
    )
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return placed.withColumn("local", local).join(ahead, ["conv_id", "part"]).select("conv_id", (F.col("ahead") + F.col("local")).alias("pos"), "t1", "t2", "n")


def graft(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like the first of their family: (conv_id of all, their rebuilt numbered turns).

    Conversation c takes the first h = crc32(decimal c) mod ``heads`` turns of conversation c - c mod ``family``, then
    its own turns after its first h.
    """
    head = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % heads).cast("long")
    turns = store(turns, "trie-numbered")
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "t1", "t2", "n")
    base = turns.where(F.col("pos") < heads).groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("base_turns"))
    convs = turns.groupBy("conv_id").agg(F.lit(0).alias("_")).select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    convs = store(convs.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken")), "trie-heads")
    taken = convs.join(first, "base").where("pos <= h").select("conv_id", "pos", "t1", "t2", "n")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "n")
    return convs.select("conv_id"), taken.unionByName(own)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, n, upto): keys of every prefix and the code points up to its last turn."""
    hashed = turns.withColumn("x1", F.xxhash64("pos", "t1", "t2")).withColumn("x2", F.xxhash64("t2", "t1", "pos"))
    hashed = hashed.withColumn("piece", F.expr(f"(pos - 1) div {_PIECE}")).select("conv_id", "piece", "pos", "x1", "x2", "n")
    sums = hashed.groupBy("conv_id", "piece").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.sum("n").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "piece", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"{c}_before") for f, c in ((F.bit_xor, "x1"), (F.bit_xor, "x2"), (F.sum, "n")))
    )
    here = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = hashed.select(
        "conv_id", "piece", "pos", "n", F.bit_xor("x1").over(here).alias("x1"), F.bit_xor("x2").over(here).alias("x2"), F.sum("n").over(here).alias("upto")
    )
    return inner.join(sums, ["conv_id", "piece"]).select(
        "conv_id", F.col("pos").alias("depth"), F.col("x1").bitwiseXOR(F.col("x1_before")).alias("k1"), F.col("x2").bitwiseXOR(F.col("x2_before")).alias("k2"),
        "n", (F.col("upto") + F.col("n_before")).alias("upto"),
    )


def _digests(ends: DataFrame, several: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of every sequence of ``several``, however many end there.

    Ids are packed into pieces by range, so that the one task that must read a sequence's whole list reads few rows.
    """
    ids = ends.join(several.select(*_KEY), _KEY).select(*_KEY, "conv_id")

    def runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list]]:
        """Rows of sorted batches, by sequence; a sequence may come in several parts."""
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            start = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i][:3] != rows[start][:3]:
                    yield rows[start][:3], rows[start:i]
                    start = i

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_KEY, "first", "ids"]
        out, held, key, first = [], [], None, None
        for now, rows in runs(batches, [*_KEY, "conv_id"]):
            if now != key or sum(map(len, held)) > _PACKED:
                if held:
                    out.append((*key, first, ",".join(held)))
                held, key, first = [], now, rows[0][3]
            held.append(",".join(str(r[3]) for r in rows))
            if len(out) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if held:
            out.append((*key, first, ",".join(held)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, state, out = [*_KEY, "sha"], None, None, []
        for now, rows in runs(batches, [*_KEY, "first", "ids"]):
            if now != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            else:
                state.update(b",")
            state.update(",".join(r[4] for r in rows).encode())
        if key is not None:
            out.append((*key, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types[:3], pa.string()])], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    packed = ids.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(pack, "depth long, k1 long, k2 long, first long, ids string")
    packed = store(packed, "trie-ids")
    return packed.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, "depth long, k1 long, k2 long, sha string")


def _peel(entries: DataFrame, depth: int) -> DataFrame | None:
    """Nodes of all depths up to ``depth``, one grouping for each depth, from the greatest upwards.

    ``entries`` (conv_id, at, path, n_convs, n_children, n_leaves, saved) are what comes to a node of depth ``at``: a
    chain that hangs there, or conversations that end there. ``path`` holds the keys of the first ``at`` prefixes.
    """
    levels, survivors = [], None
    for d in range(depth, -1, -1):
        now = entries.where(F.col("at") == d).drop("at")
        if survivors is not None:
            now = now.unionByName(survivors)
        last = F.element_at("path", d) if d else F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("n"))
        grouped = now.withColumn("last", last).groupBy("last").agg(
            F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.first("path").alias("path")
        )
        nodes = store(
            grouped.select(
                F.lit(d).cast("long").alias("depth"), "last.k1", "last.k2", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.col("saved") + (F.col("n_convs") - 1) * F.col("last.n")).alias("saved"), "path",
            ),
            "trie-level",
        )
        levels.append(nodes.select(*_KEY, *_parent(d), "conv_id", "n_convs", "n_children", "n_leaves", "saved"))
        if d:
            # the last turn goes; whatever it was, its node is one child of the shorter sequence
            survivors = nodes.select("conv_id", F.slice("path", 1, d - 1).alias("path"), "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _parent(d: int) -> list[Column]:
    """p1, p2: key of the sequence without its last turn; the root's parent is null."""
    if d == 0:
        return [F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2")]
    if d == 1:
        return [F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")]
    return [F.element_at("path", d - 1)["k1"].alias("p1"), F.element_at("path", d - 1)["k2"].alias("p2")]


def build(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes from all ids (conv_id) and numbered turns (conv_id, pos, t1, t2, n).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = store(_prefixes(turns), "trie-prefixes")
    end = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2", "upto")).alias("e"))
    zero = F.lit(0).cast("long")
    ends = store(convs.join(end, "conv_id", "left").select("conv_id", *(F.coalesce(F.col("e")[c], zero).alias(c) for c in (*_KEY, "upto"))), "trie-ends")
    sequences = store(
        ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.max("upto").alias("total")), "trie-sequences"
    )
    lead = sequences.select("conv_id", F.col("depth").alias("length"), "members", "total")
    chains = store(prefixes.join(lead, "conv_id"), "trie-chains")
    shared = store(chains.groupBy(*_KEY).agg(F.count("*").alias("c")).where("c > 1").select(*_KEY), "trie-shared")
    common = store(chains.join(shared, _KEY, "left_semi").select("conv_id", "depth", "k1", "k2", "n", "upto"), "trie-common")
    paths = common.groupBy("conv_id").agg(
        F.max("depth").alias("at"), F.max("upto").alias("upto"), F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "n"))).alias("p")
    )
    paths = paths.select("conv_id", "at", "upto", F.transform("p", lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["n"].alias("n"))).alias("path"))
    none = F.array().cast("array<struct<k1:bigint,k2:bigint,n:bigint>>")
    chain = (F.col("length") > F.col("at")).cast("long")
    entries = lead.join(paths, "conv_id", "left").select(
        "conv_id", F.coalesce("at", zero).alias("at"), F.coalesce("path", none).alias("path"), "members", "length", F.coalesce("upto", zero).alias("upto"), "total"
    ).select(
        "conv_id", "at", "path", F.col("members").alias("n_convs"), chain.alias("n_children"), chain.alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("total") - F.col("upto"))).alias("saved"),
    )
    entries = store(entries.sortWithinPartitions("at"), "trie-entries")
    deepest = entries.agg(F.max("at")).first()[0]
    if deepest is None:
        return _finish(entries.select("conv_id", *(zero.alias(c) for c in (*_KEY, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"))), ends, sequences)
    peeled = store(_peel(entries, deepest), "trie-peeled")
    tails = chains.join(entries.select("conv_id", "at"), "conv_id").where("depth > at")
    tails = tails.select(
        *_KEY, "at", "conv_id", F.col("members").alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("members") - 1) * (F.col("total") - F.col("upto") + F.col("n"))).alias("saved"),
    )
    # the key of the node that a chain hangs on: undo the chain's first turn by looking up the depth before it
    hook = common.join(entries.select("conv_id", "at"), "conv_id").where("depth = at").select("conv_id", F.col("k1").alias("p1"), F.col("k2").alias("p2"))
    tails = store(tails, "trie-tails")
    tops = tails.where("depth = at + 1").join(hook, "conv_id", "left").select(*_KEY, F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2"), *_SUMS)
    hanging = store(peeled.select(*_KEY, "p1", "p2", *_SUMS).unionByName(tops), "trie-hanging")
    above = peeled.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = hanging.join(above, ["depth", "p1", "p2"], "left").select(*_KEY, "parent_conv_id", *_SUMS)
    inner = tails.where("depth > at + 1").select(*_KEY, F.col("conv_id").alias("parent_conv_id"), *_SUMS)
    return _finish(nodes.unionByName(inner), ends, sequences)


_SUMS = ["conv_id", "n_convs", "n_children", "n_leaves", "saved"]


def _finish(nodes: DataFrame, ends: DataFrame, sequences: DataFrame) -> DataFrame:
    one = sequences.where("members = 1").select(*_KEY, F.sha2(F.encode(F.col("conv_id").cast("string"), "utf-8"), 256).alias("sha"))
    digests = one.unionByName(_digests(ends, sequences.where("members > 1")))
    return nodes.join(digests, _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the conversations as they are."""
    turns = store(numbered_turns(conversations), "trie-numbered")
    return build(turns.select("conv_id").distinct(), turns)


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the conversations rebuilt by :func:`graft`."""
    return build(*graft(numbered_turns(conversations)))

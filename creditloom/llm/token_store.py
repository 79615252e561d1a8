"""Token ids in shards with a minimal perfect hash index over the document keys.

Shards are Parquet rows ("blocks") of raw little-endian ids: documents in ascending doc_id order, each followed by
the end id, with the documents' ids and lengths beside the payload. The index is partitioned by key hash; each part
is a minimal perfect hash function (levels of bit arrays in which every key that meets no other gets its bit; the
rank of that bit is the key's slot), and by slot a stored 32-bit fingerprint, the block and the place in it. A
lookup reads one part: constant time, and a key that was never stored is recognised by its fingerprint but for one
in four billion.

Results for special rows: a null text is an empty one, so it is the end id alone. A null doc_id comes first in
order and has the key ''. Rows that repeat a doc_id stand one after another; they are told apart by ``copy``
(0, 1, 2 ...). An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import documents_only, rank_within
from creditloom.llm.text import mix, slices
from creditloom.llm.tokens import encoder
from creditloom.runtime import work_path

PART_KEYS = 100_000
_SPREAD = 2.0  # bits of a level for each key that is left


# --- shards ------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the documents' ids in ascending doc_id order as blocks of a few megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, block = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, total = encode.encode(rows.column("text"), end)
                narrow = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
                ends = np.array([0, rows.num_rows], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([narrow], pa.int32()),
                        pa.ListArray.from_arrays(ends, rows.column("doc_id")),
                        pa.ListArray.from_arrays(ends, pa.array(total, pa.int64())),
                        pa.array([ids.astype(f"<u{narrow}").tobytes()], pa.binary()),
                    ],
                    ["part", "block", "width", "doc_ids", "lengths", "payload"],
                )
                block += 1

    # a doc_id with very many rows spreads over several ranges
    ordered = documents_only(docs).withColumn("turn", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn").drop("turn")
    schema = "part int, block int, width int, doc_ids array<long>, lengths array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{path}/shards")


def block_starts(shards: DataFrame) -> DataFrame:
    """part, block, start (ids before the block), first_row (documents before it).

    Sums within the parts first; the running total over parts has one row for each write task.
    """
    sizes = shards.select("part", "block", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"), F.size("doc_ids").cast("long").alias("m"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("part_row")
    )
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n"), F.coalesce(F.sum("m").over(inside), F.lit(0)).alias("m")
    )
    return sizes.join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("n")).alias("start"), (F.col("part_row") + F.col("m")).alias("first_row")
    )


def read_payloads(shards: DataFrame) -> DataFrame:
    """For each stored document, from the payload: part, block, slot, at (ids before it in the block), n_tokens,
    ids_crc32. Map-only; the payloads do not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                lengths = row["lengths"].values.to_numpy(zero_copy_only=False)
                ids = np.frombuffer(row["payload"].as_buffer(), f"<u{row['width'].as_py()}").astype("<u4")
                raw = memoryview(ids).cast("B")
                at = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), lengths.tolist())]
                m = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, row["part"].as_py()), pa.int32()), pa.array(np.full(m, row["block"].as_py()), pa.int32()),
                        pa.array(np.arange(m), pa.int32()), pa.array(at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    ["part", "block", "slot", "at", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "block", "width", "lengths", "payload").mapInArrow(
        run, "part int, block int, slot int, at long, n_tokens long, ids_crc32 long"
    )


# --- minimal perfect hash ----------------------------------------------------------------------


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h1 + h2 * np.uint64(level + 1)) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels, slot of each key) for keys that are distinct as pairs of hashes."""
    sizes: list[int] = []
    bits: list[np.ndarray] = []
    where = np.empty(len(h1), np.int64)
    left, base = np.arange(len(h1)), 0
    while len(left):
        size = max(8, int(_SPREAD * len(left)))
        at = _place(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size)[at] == 1
        level = np.zeros(size, bool)
        level[at[alone]] = True
        where[left[alone]] = base + at[alone]
        sizes.append(size)
        bits.append(level)
        base += size
        left = left[~alone]
    every = np.concatenate(bits) if bits else np.zeros(0, bool)
    return sizes, every, (np.cumsum(every) - 1)[where] if len(where) else where


def find(h1: np.ndarray, h2: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 for some of the keys that were not stored, any slot for the others."""
    rank = np.cumsum(bits) - 1
    out = np.full(len(h1), -1, np.int64)
    left, base = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = base + _place(h1[left], h2[left], level, size)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, base = left[~hit], base + size
    return out


def _hashes(key: str, copy: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key, copy).alias("h1"), F.xxhash64(F.lit(2), copy, key).alias("h2")


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (mix(h2 ^ (h1 >> np.uint64(7))) >> np.uint64(32)).astype(np.uint32)


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def write_index(shards: DataFrame, path: str, part_keys: int = PART_KEYS) -> None:
    """Write the index of all stored documents, by key and copy."""
    rows = shards.select("part", "block", F.posexplode("doc_ids").alias("slot", "doc_id")).join(block_starts(shards), ["part", "block"])
    rows = rows.select("part", "block", "slot", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), (F.col("first_row") + F.col("slot")).alias("row"))
    first = rows.groupBy("key").agg(F.min("row").alias("first"))
    keyed = rows.join(first, "key").withColumn("copy", F.col("row") - F.col("first"))
    parts = max(1, -(-shards.agg(F.sum(F.size("doc_ids"))).first()[0] // part_keys)) if not shards.isEmpty() else 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = _unsigned(pdf["h1"]), _unsigned(pdf["h2"])
        sizes, bits, slot = build(h1, h2)
        order = np.argsort(slot)
        return pd.DataFrame(
            {
                "p": [pdf["p"].iloc[0]], "parts": [parts], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()],
                "fingerprints": [_fingerprint(h1, h2)[order].tobytes()],
                **{c: [pdf[c].to_numpy(np.int32)[order].tobytes()] for c in ("part", "block", "slot")},
            }
        )

    keyed.select(*_hashes("key", "copy"), "part", "block", "slot").withColumn("p", F.pmod("h1", F.lit(parts)).cast("long")).groupBy("p").applyInPandas(
        run, "p long, parts long, sizes array<long>, bits binary, fingerprints binary, part binary, block binary, slot binary"
    ).write.parquet(f"{path}/index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """part, block and slot of each distinct (key, copy); keys that are not stored are left out."""
    head = index.select("parts").first()
    parts = head["parts"] if head else 1

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = asked[["key", "copy"]].assign(part=0, block=0, slot=0)
        if not len(rows) or not len(asked):
            return out.iloc[:0]
        row = rows.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
        h1, h2 = _unsigned(asked["h1"]), _unsigned(asked["h2"])
        at = find(h1, h2, sizes, bits)
        good = at >= 0
        good[good] = np.frombuffer(row["fingerprints"], np.uint32)[at[good]] == _fingerprint(h1, h2)[good]
        out = out[good]
        return out.assign(**{c: np.frombuffer(row[c], np.int32)[at[good]] for c in ("part", "block", "slot")})

    asked = keys.select("key", "copy", *_hashes("key", "copy")).distinct().withColumn("p", F.pmod("h1", F.lit(parts)).cast("long"))
    return asked.groupBy("p").cogroup(index.groupBy("p")).applyInPandas(run, "key string, copy long, part int, block int, slot int")


def round_trip(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write the store, then look up every document by its key and read it: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = work_path(spark, "tokens")
    write_shards(docs, path, tokenizer, end)
    shards = spark.read.parquet(f"{path}/shards")
    write_index(shards, path)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id")).withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keys = rank_within(keys, ["key"], "keys").withColumnRenamed("rank", "copy")
    found = lookup(keys, spark.read.parquet(f"{path}/index"))
    read = read_payloads(shards).join(block_starts(shards), ["part", "block"])
    return found.join(read, ["part", "block", "slot"]).select(
        F.when(F.col("key") != "", F.col("key").cast("long")).alias("doc_id"), (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )

"""A blocked Bloom filter of fixed size, built by Spark from a column of 64-bit hashes and broadcast.

Its size (``WORDS`` 64-bit words, 32 MB) does not depend on the data. It only spares later steps rows that cannot
matter: every caller compares exactly afterwards, so what the filter lets through by mistake changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.text import mix, run_starts, signed, tidy

WORDS = 1 << 22


def _bits(h: np.ndarray) -> np.ndarray:
    """Four bits of a 64-bit word."""
    one, six = np.uint64(1), np.uint64(63)
    bits = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        bits |= one << ((h >> np.uint64(shift)) & six)
    return bits


def _word(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % WORDS


def collect(hashes: DataFrame) -> np.ndarray:
    """Filter of the values of the only column of ``hashes``; bits meet per word before they reach the driver."""
    name = hashes.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _parts(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    return _joined(hashes.select(name).mapInArrow(tidy(run), "word long, bits long"))


def _parts(h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_word(h)), pa.array(signed(_bits(h)))], ["word", "bits"])


def _joined(parts: DataFrame) -> np.ndarray:
    table = parts.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def contains(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = _bits(h)
    return (table[_word(h)] & bits) == bits


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each key, and the 32 bits by which keys of one bucket are told apart there."""
    return keys % np.uint64(buckets), keys >> np.uint64(32)


def labels(bucket: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mix(bucket << np.uint64(32) | rest)


def packed(keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys of one slice as a row for each bucket; a key goes out once, or twice if it comes more than once."""
    bucket, rest = dealt(keys, buckets)
    cut = np.sort(bucket << np.uint64(32) | rest)
    first = run_starts(cut)
    out = np.repeat(cut[first], 1 + (np.diff(np.append(first, len(cut))) > 1))
    bucket, out = (out >> np.uint64(32)).astype(np.int64), out.astype(np.uint32)
    starts = run_starts(bucket)
    ends = np.append(starts[1:], len(out))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int64()), pa.array([out[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["bucket", "keys"]
    )


def repeated(rows: DataFrame) -> np.ndarray:
    """Filter (of ``labels``) of the keys that come twice in ``packed`` rows.

    A key is cut to its bucket and 32 bits. Buckets follow the shuffle partitions, so the share of keys that meet
    another's by mistake stays the same as both grow; these go on to the callers' exact comparison like others.
    """

    def shared(table: pa.Table) -> pa.Table:
        keys = np.sort(np.frombuffer(b"".join(x.as_buffer() for x in table.column("keys")), np.uint32))
        first = run_starts(keys)
        rest = keys[first[np.diff(np.append(first, len(keys))) > 1]].astype(np.uint64)
        return pa.Table.from_batches([_parts(labels(np.uint64(table.column("bucket")[0].as_py()), rest))])

    return _joined(rows.groupBy("bucket").applyInArrow(shared, "word long, bits long"))

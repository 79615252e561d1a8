"""Best-fit packing planned on the histogram of lengths.

Documents become pieces of at most ``size`` tokens. Only how many pieces there are of each length (``size`` numbers
at most) reaches the driver, which plans best-fit decreasing over counts: groups of equal sequences take as many
equal pieces at once as they can. Pieces then get their rank within their length and join the planned slot that
covers that rank.

Results for special rows: a null or empty text is the end id alone. Rows that repeat a doc_id are packed one by one,
each with its own pieces; a null doc_id stays null. An empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditloom.llm.common import documents_only, store
from creditloom.llm.text import slices, tidy
from creditloom.llm.tokens import encoder

SIZE = 1024


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) for so many pieces of each length.

    Best-fit decreasing: a piece goes to the fullest sequence with room for it. Sequences that hold the same
    lengths are one group with consecutive numbers, so the work follows the number of lengths, not of pieces.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free tokens: (first sequence, number)
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length
        while left:
            while free <= size and not room[free]:
                free += 1
            at = min(free, size)
            each = at // length
            # the fullest sequence with room takes pieces until it has none for this length, then the next one does
            first, number = room[at].pop() if room[at] else (opened, -(-left // each))
            if first == opened:
                opened += number
            whole = min(number, left // each)
            last = left - whole * each if whole < number and left < (whole + 1) * each else 0
            for sequences, start, share in ((whole, first, each), (1 if last else 0, first + whole, last)):
                if sequences:
                    for k in range(share):
                        slots.append((length, rank + k * sequences, sequences, start, size - at + k * length))
                    rank += sequences * share
                    room[at - share * length].append((start, sequences))
            left -= whole * each + last
            used = whole + (1 if last else 0)
            if used < number:
                room[at].append((first + used, number - used))
    return slots


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids: little-endian 32-bit), and the place among the equally long
    pieces of its task (part, local). Only the first piece of a document is shorter than ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        met = np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, total = encode.encode(rows.column("text"), end)
                number = -(-total // size)
                owner = np.repeat(np.arange(len(total)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                head = (total - size * (number - 1))[owner]
                length = np.where(piece == 0, head, size)
                start = np.where(piece == 0, 0, head + size * (piece - 1))
                order = np.argsort(length, kind="stable")
                run_first = np.searchsorted(length[order], length[order])
                local = np.empty(len(owner), np.int64)
                local[order] = np.arange(len(owner)) - run_first
                local += met[length]
                met += np.bincount(length, minlength=size + 1)
                raw = memoryview(ids.astype("<u4")).cast("B")
                cuts = np.concatenate([[0], np.cumsum(length)]).tolist()
                spans = [raw[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]
                columns = [
                    rows.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                    pa.array(np.full(len(owner), part), pa.int32()), pa.array(local, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                if keep_ids:
                    columns.append(pa.array([bytes(s) for s in spans], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
    return documents_only(docs).mapInArrow(tidy(run), schema + (", ids binary" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, end: int, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """Pieces with the sequence they stand in and their offset there.

    Columns doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset. Concatenating a sequence's pieces
    by offset gives its tokens without gaps.
    """
    spark = docs.sparkSession
    made = store(pieces(docs, tokenizer, end, size, keep_ids), "pieces")
    counts = made.groupBy("part", "length").agg((F.max("local") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # one row for each step of the plan, whose number depends on ``size`` alone
    slots = spark.createDataFrame(plan(histogram, size), "length long, rank_from long, n long, sequence_from long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = made.join(offsets, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    rank = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(slots), "length").where((rank >= 0) & (rank < F.col("n")))
        .withColumn("sequence_id", F.col("sequence_from") + rank)
        .select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), "sequence_id", "offset")
    )

"""Fuzzy line deduplication: one line stays of every group of nearly equal lines.

Lines of at least ``min_words`` words take part, lower-cased (ASCII); with 1, as the query and the pipeline have it, all
that are not blank. Shingles are all runs of ``characters`` code points (the query and the pipeline have 5), or where
that is 0, of eight bytes of the line's UTF-8. The only shingle of a shorter line is its whole text, so it equals its
exact repeats and no other line: these are found by the line's hash alone. Signatures are MinHash over shingles; lines
that agree in a whole band are candidates. One scan computes hashes, signatures and places; band keys travel packed, with
32 bits of their line, and lines of a common key meet in the task of the key's bucket. Pairs whose signatures differ too
much to reach the threshold are dropped (``DIFFER``). A second scan fetches the bodies of the lines that are left.
Candidates are verified by exact Jaccard similarity, and distributed union-find joins what passes. The first line of each
component, by doc_id and place, stays where it is; all others are removed, exact repeats included.

Keys of up to ``SMALL`` lines give all pairs of them. Those of larger keys are tested against three hubs, so they give three
pairs for each member. Where members of such a key are still in different components then, its lines go to tasks in tiles
of about 2 x ``BLOCK`` lines, which compare all of them exactly and return one union edge for each line at most, never
pairs; keys that have the same lines are compared once.

Results for special rows: a null text stays null and an empty one empty (no lines are removed); lines of fewer words stay;
a null doc_id counts as the largest; rows that repeat a doc_id and its text are one document, with other texts they are
ordered by crc32. An empty table gives an empty result. Other columns are handed through in a struct, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.common import components, store
from creditloom.llm.filters import collect, contains, dealt
from creditloom.llm.minhash import Sketch, band_keys, sketch_bits
from creditloom.llm.ngram_join import least_linked, overlaps, whole_groups
from creditloom.llm.text import SPACED, Spans, Texts, mix, ranges, run_starts, signed, slices, tidy

MIN_WORDS = 5
BYTES = 8
THRESHOLD = 0.8
ROWS, BANDS = 6, 23  # a pair at 0.8 shares no band once in 1,090 cases
DIFFER = 30  # of 128 bits of the sketches; more differ at 0.8 once in 380,000 cases
SMALL = 16
BLOCK = 256
PAIR, LINE, GONE, MEMBER = range(4)
_COLUMNS = ("kind", "key", "line", "other", "x0", "x1", "d", "mark", "spot")
SLICE = 1 << 20
PART = 1 << 16
_LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _heads(data: np.ndarray) -> np.ndarray:
    """Where the code points of ``data`` begin, and its text ends."""
    return np.append(np.flatnonzero((data[:-8] & 0xC0) != 0x80), len(data) - 8)


def _runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, characters: int, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Values of all shingles of the spans of ``data`` (eight bytes longer than its text), and how many each span has.

    Runs of up to eight bytes are their own value, longer ones a 64-bit hash."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    if not characters:
        number = np.maximum(end - start - BYTES + 1, 0)
        return eight[ranges(start, number)], number
    heads = _heads(data) if heads is None else heads
    first = np.searchsorted(heads, start)
    number = np.maximum(np.searchsorted(heads, end) - first - characters + 1, 0)
    at = ranges(first, number)
    place = heads[at]
    at += characters
    size = heads[at]
    size -= place
    most = size.max(initial=0)
    out = eight[place]
    out &= _MASK[np.minimum(size, 8)] if most > characters else _MASK[min(characters, 8)]
    todo, done = np.flatnonzero(size > 8) if most > 8 else np.empty(0, np.int64), 8
    while len(todo):
        out[todo] = mix((out[todo] + np.uint64(done)) * _ODD) ^ (eight[place[todo] + done] & _MASK[np.minimum(size[todo] - done, 8)])
        out[todo] = mix(out[todo])
        done += 8
        todo = todo[size[todo] > done]
    return out, number


class Lines:
    """The lines of a slice that take part, their hashes, and the first place of each distinct line."""

    def __init__(self, column: pa.Array, min_words: int, characters: int):
        self.characters = characters
        self.texts = Texts(column, lower=True)
        every = self.texts.lines()
        if min_words == 1:  # a line is in as soon as one byte of it is no space
            seen = np.concatenate([[0], np.cumsum(SPACED[self.texts.bytes[: self.texts.n]], dtype=np.int64)])
            count = np.minimum(seen[every.end] - seen[every.start], 1)
        else:
            words = self.texts.runs(SPACED)
            count = np.searchsorted(words.start, every.end) - np.searchsorted(words.start, every.start)
        at = np.flatnonzero(count >= min_words)
        self.index = at - every.bounds[every.owner[at]]
        self.spans = Spans(self.texts, every.start[at], every.end[at], every.owner[at])
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """A 64-bit hash of each line: a sum over its eight-byte words, each mixed with its place."""
        data, size = self.texts.bytes, self.spans.end - self.spans.start
        eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        number = np.maximum(size + 7 >> 3, 1)
        if not len(size):
            return np.empty(0, np.uint64)
        k = ranges(np.zeros(len(size), np.int64), number) << 3
        word = eight[np.repeat(self.spans.start, number) + k]
        word &= _MASK[np.minimum(np.repeat(size, number) - k, 8)]
        word += (k.view(np.uint64) + np.uint64(1)) * _ODD
        return mix(np.add.reduceat(mix(word), np.cumsum(number) - number) + size.view(np.uint64) * _ODD)

    def keys(self, at: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the lines ``at`` that are no shorter than a shingle, their band keys and the bits of their sketches."""
        length = self.spans.end[at] - self.spans.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        heads = _heads(self.texts.bytes) if self.characters else None
        full, drawn = np.zeros(len(at), bool), [np.empty((0, sketch.size), np.uint64)]
        # lines of similar length, in parts that stay in a core's cache
        cuts = np.flatnonzero(np.diff((np.cumsum(length) - length) // PART, prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(at))):
            some = at[low:high]
            values, number = _runs(self.texts.bytes, self.spans.start[some], self.spans.end[some], self.characters, heads)
            full[low:high] = number > 0
            drawn.append(sketch.values(mix(values * _ODD), number[number > 0]))
        made = np.concatenate(drawn)
        return at[full], band_keys(made, ROWS), sketch_bits(made)


def _dealt_rows(kind: int, buckets: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """``rows`` packed by bucket; buckets of the kinds follow each other."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, rows = bucket[order].astype(np.int64) + kind * buckets, rows[order]
    starts = run_starts(bucket)
    ends = np.append(starts[1:], len(rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[starts], pa.int64()), pa.array([rows[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary())], ["bucket", "rows"]
    )


def _firsts(line: np.ndarray, d: np.ndarray, mark: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each line, and all its other places (the same place may come twice)."""
    order = np.lexsort((index, mark, d, line))
    starts = run_starts(line[order])
    first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    other = (d[order] != d[first]) | (mark[order] != mark[first]) | (index[order] != index[first])
    return order[starts], order[other]


def _pairs(coded: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of lines (a, b) with a common key: all of a key of up to ``SMALL`` lines, of others those with three hubs.
    Then the members (key, line) of these others. ``coded``: 32 bits of a key and 32 of a line."""
    coded = np.sort(coded)
    coded = coded[run_starts(coded)]
    starts = run_starts(coded >> np.uint64(32))
    size = np.diff(np.append(starts, len(coded)))
    line = coded & _LOW
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for n in range(2, SMALL + 1):
        rows = line[starts[size == n][:, None] + np.arange(n)]
        x, y = np.triu_indices(n, 1)
        a.append(rows[:, y].ravel())  # lines ascend within a key
        b.append(rows[:, x].ravel())
    large = np.flatnonzero(size > SMALL)
    member = line[ranges(starts[large], size[large])]
    key = np.repeat((np.uint64(bucket) << np.uint64(32)) | (coded[starts[large]] >> np.uint64(32)), size[large])
    if len(large):
        begin = np.cumsum(size[large]) - size[large]
        for salt in range(3):
            order = member << np.uint64(32) if not salt else mix(member + np.uint64(salt)) & ~_LOW
            hub = np.repeat(np.minimum.reduceat(order | member, begin) & _LOW, size[large])
            own = hub != member
            a.append(np.maximum(hub, member)[own])
            b.append(np.minimum(hub, member)[own])
    return np.concatenate(a), np.concatenate(b), key, member


def _scanned(docs: DataFrame, min_words: int, characters: int) -> DataFrame:
    """All that one scan of the texts finds, by kind.

    PAIR: line, other (32 bits of two lines that share a band key). MEMBER: key, line (32 bits) of keys with many lines.
    LINE: line, x0, x1 (bits of its sketch) and its first place d, mark, spot. GONE: d, mark, spot of a later place.
    They travel packed, a row for each slice and bucket: keys of one bucket meet, and the first places of a line."""
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = np.uint64(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(ROWS * BANDS)
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                lines = Lines(rows.column("text"), min_words, characters)
                owner, line, index = lines.spans.owner, lines.hash, lines.index
                d, mark = (rows.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("d", "mark"))
                first, other = _firsts(line, d, mark, index)
                at, keys, bits = lines.keys(first, sketch)
                bucket, rest = dealt(keys.ravel(), buckets)
                yield _dealt_rows(PAIR, buckets, bucket, rest << np.uint64(32) | np.repeat(line[at] & _LOW, BANDS))
                drawn = np.zeros((len(line), 2), np.int64)
                drawn[at] = bits
                places = np.column_stack([signed(line[first]), drawn[first], d[first], mark[first], index[first]])
                yield _dealt_rows(LINE, buckets, line[first] % number, places)
                yield _dealt_rows(GONE, buckets, mark[other].view(np.uint64) % number, np.column_stack([d[other], mark[other], index[other]]))

    def meet(table: pa.Table) -> pa.Table:
        kind, bucket = divmod(table.column("bucket")[0].as_py(), buckets)
        data = b"".join(x.as_buffer() for x in table.column("rows"))
        if kind == PAIR:
            a, b, key, member = _pairs(np.frombuffer(data, np.uint64), bucket)
            return pa.concat_tables([_kind(PAIR, line=signed(a), other=signed(b)), _kind(MEMBER, key=signed(key), line=signed(member))])
        if kind == GONE:
            d, mark, spot = np.frombuffer(data, np.int64).reshape(-1, 3).T
            return _kind(GONE, d=d, mark=mark, spot=spot)
        line, x0, x1, d, mark, spot = np.frombuffer(data, np.int64).reshape(-1, 6).T
        first, other = _firsts(line, d, mark, spot)
        return pa.concat_tables([
            _kind(LINE, line=line[first], x0=x0[first], x1=x1[first], d=d[first], mark=mark[first], spot=spot[first]),
            _kind(GONE, d=d[other], mark=mark[other], spot=spot[other]),
        ])

    packed = docs.select("d", "text", "mark").mapInArrow(tidy(run), "bucket long, rows binary")
    return store(packed.groupBy("bucket").applyInArrow(meet, ", ".join(f"{c} long" for c in _COLUMNS)), "lines")


def _kind(kind: int, **columns: np.ndarray) -> pa.Table:
    rows = len(next(iter(columns.values())))
    made = {"kind": pa.array(np.full(rows, kind, np.int64))} | {c: pa.array(np.ascontiguousarray(x)) for c, x in columns.items()}
    return pa.table({c: made.get(c, pa.nulls(rows, pa.int64())) for c in _COLUMNS})


def _bodies(docs: DataFrame, wanted: np.ndarray, min_words: int, characters: int) -> DataFrame:
    """line, body of the lines in the filter ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                lines = Lines(rows.column("text"), min_words, characters)
                at = np.flatnonzero(contains(sent.value, lines.hash))
                at = at[np.unique(lines.hash[at], return_index=True)[1]]
                data, spans = memoryview(lines.texts.bytes), lines.spans
                bodies = [bytes(data[spans.start[i] : spans.end[i]]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(signed(lines.hash[at])), pa.array(bodies, pa.binary())], ["line", "body"])

    return docs.select("text").mapInArrow(tidy(run), "line long, body binary").dropDuplicates(["line"])


def _grams(body: bytes, characters: int) -> np.ndarray:
    return _gram_sets([body], characters)[0]


def _gram_sets(bodies: list[bytes], characters: int) -> list[np.ndarray]:
    """The sorted shingles of each line."""
    ends = np.cumsum([len(x) for x in bodies], dtype=np.int64)
    out: list[np.ndarray] = []
    low = 0
    while low < len(bodies):
        begin = int(ends[low]) - len(bodies[low])
        high = max(low + 1, int(np.searchsorted(ends, begin + 4 * PART)))
        data = np.frombuffer(b"".join(bodies[low:high]) + bytes(8), np.uint8)
        last = ends[low:high] - begin
        values, number = _runs(data, np.append(0, last[:-1]), last, characters)
        for x in np.split(values, np.cumsum(number)[:-1]):
            x.sort()
            out.append(x[run_starts(x)])
        low = high
    return out


def _verified(pairs: DataFrame, bodies: DataFrame, characters: int) -> DataFrame:
    """Union edges of the pairs (a, b) whose shingle sets reach the threshold: one for each line of a batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "x", SLICE):
                a, b = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                # rows come in order of b, whose line is often the same
                new = np.append(True, b[1:] != b[:-1])
                column = rows.column("y")
                left = _gram_sets(rows.column("x").to_pylist(), characters)
                right = _gram_sets([column[i].as_py() for i in np.flatnonzero(new).tolist()], characters)
                good = np.zeros(len(a), bool)
                for i, (p, j) in enumerate(zip(left, (np.cumsum(new) - 1).tolist())):
                    q = right[j]
                    if min(len(p), len(q)) * 10 >= 8 * max(len(p), len(q)):
                        z = np.concatenate([p, q])
                        z.sort(kind="stable")  # merges the two
                        both = int(np.count_nonzero(z[1:] == z[:-1]))
                        good[i] = both * 10 >= 8 * (len(z) - both)
                line, place = np.unique(np.stack([a[good], b[good]]), return_inverse=True)
                place = place.reshape(2, -1)
                least = least_linked(len(line), place[0], place[1])
                moved = np.flatnonzero(least != np.arange(len(line)))
                yield pa.RecordBatch.from_arrays([pa.array(line[moved]), pa.array(line[least[moved]])], ["a", "b"])

    x = bodies.select(F.col("line").alias("a"), F.col("body").alias("x"))
    y = bodies.select(F.col("line").alias("b"), F.col("body").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _tile(rows: pd.DataFrame, characters: int) -> pd.DataFrame:
    """Union edges between the lines of one tile that reach the threshold and have different roots."""
    line, root, side = rows["line"].to_numpy(), rows["root"].to_numpy(), rows["side"].to_numpy()
    bits = rows[["x0", "x1"]].to_numpy().astype(np.uint64)  # bitwise_count takes the absolute value of signed numbers
    sets = _gram_sets(rows["body"].tolist(), characters)
    size = np.array([len(x) for x in sets])
    # a tile of one block compares all its lines, a tile of two blocks those of different blocks
    one = (side == 0).all()
    left, right = (np.arange(len(line)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = [np.empty((2, 0), np.int64)]
    for i in left:
        j = right[right > i] if one else right
        j = j[(root[j] != root[i]) & (np.minimum(size[j], size[i]) * 10 >= 8 * np.maximum(size[j], size[i]))]
        j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(1) <= DIFFER]
        found.append(np.stack([np.full(len(j), i), j]))
    a, b = np.concatenate(found, 1)
    both = overlaps(sets, a, b)
    linked = both * 10 >= 8 * (size[a] + size[b] - both)
    least = least_linked(len(line), a[linked], b[linked])
    moved = np.flatnonzero(least != np.arange(len(line)))
    return pd.DataFrame({"a": line[moved], "b": line[least[moved]]})


def _tiles(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[pa.RecordBatch]:
    yield from whole_groups(batches, ["key", "low", "high"], partial(_tile, characters=characters))


def near_lines(docs: DataFrame, min_words: int = MIN_WORDS, characters: int = 0, scanned: DataFrame | None = None) -> DataFrame:
    """(node, root) of the distinct lines that are nearly equal to another one."""
    scanned = _scanned(docs, min_words, characters) if scanned is None else scanned
    lines = scanned.where(F.col("kind") == LINE).select(F.expr(f"line & {int(_LOW)}").alias("short"), "line", "x0", "x1")
    x, y = (lines.select(F.col("short").alias(k), F.col("line").alias(f"line_{k}"), F.col("x0").alias(f"{k}0"), F.col("x1").alias(f"{k}1")) for k in "ab")
    pairs = scanned.where(F.col("kind") == PAIR).select(F.col("line").alias("a"), F.col("other").alias("b")).distinct().join(x, "a").join(y, "b")
    pairs = pairs.where(F.expr(f"line_a <> line_b and bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= {DIFFER}"))
    pairs = store(pairs.select(F.greatest("line_a", "line_b").alias("a"), F.least("line_a", "line_b").alias("b")), "pairs")
    members = scanned.where(F.col("kind") == MEMBER).select("key", F.col("line").alias("short")).join(lines, "short").drop("short")
    members = store(members, "members")
    wanted = collect(pairs.select(F.explode(F.array("a", "b")).alias("line")).unionByName(members.select("line")))
    bodies = store(_bodies(docs, wanted, min_words, characters), "bodies")
    roots = store(components(store(_verified(pairs, bodies, characters), "pairs"), "stars"), "roots")
    if members.isEmpty():
        return roots
    placed = members.join(roots.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line"))
    mixed = placed.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), *(F.expr(f"bit_xor(xxhash64(line, {i}))").alias(f"s{i}") for i in range(2))
    )
    # keys of the same lines are one
    mixed = mixed.where("low < high").groupBy("n", "s0", "s1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    # lines are hashes, so their remainders make blocks of nearly equal size without a ranking
    dealt_out = placed.join(mixed, "key").withColumn("mine", F.expr("pmod(line, blocks)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt_out.select(
        "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "line", "root", "x0", "x1"
    )
    sent = tiles.join(bodies, "line").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = store(sent.mapInArrow(tidy(partial(_tiles, characters=characters)), "a long, b long"), "pairs")
    if more.isEmpty():
        return roots
    return store(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "stars"), "roots")


def _mark(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.isNull(), text)


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS, characters: int = 0) -> DataFrame:
    """Every document (struct ``doc``) with ``n_lines``, ``n_removed`` and ``kept``, its text without the removed lines."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows of one doc_id are told apart by a 64-bit hash of their text, salted by whether there is an id at all
    plain = plain.select(F.coalesce("doc_id", F.lit(_LAST)).alias("d"), "text", _mark(F.col("doc_id"), F.col("text")).alias("mark"))
    scanned = _scanned(plain, min_words, characters)
    roots = near_lines(plain, min_words, characters, scanned).select(F.col("node").alias("line"), "root")
    # of each line one place is left by now; of each component one line is
    spot = F.struct("d", "mark", "spot")
    kinds = scanned.where(F.col("kind") == LINE).select("line", "d", "mark", "spot").join(roots, "line")
    late = kinds.join(kinds.groupBy("root").agg(F.min(spot).alias("keeper")), "root").where(spot != F.col("keeper"))
    gone = scanned.where(F.col("kind") == GONE).select("d", "mark", "spot").unionByName(late.select("d", "mark", "spot"))
    gone = gone.groupBy("d", "mark").agg(F.collect_set("spot").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                text, gone = rows.column("text"), rows.column("gone")
                number = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
                removed = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
                hit = np.flatnonzero(removed.to_numpy(zero_copy_only=False))
                mask = np.zeros(rows.num_rows, bool)
                mask[hit] = True
                new = []
                for i in hit.tolist():
                    out = set(gone[i].as_py())
                    new.append("\n".join(x for k, x in enumerate(text[i].as_py().split("\n")) if k not in out))
                kept = pc.replace_with_mask(text, pa.array(mask), pa.array(new, pa.string()))
                yield pa.RecordBatch.from_arrays([rows.column("doc"), number, removed, kept], ["doc", "n_lines", "n_removed", "kept"])

    keyed = docs.select(
        F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), _mark(F.col("doc_id"), F.col("text").cast("string")).alias("mark")
    )
    schema = T.StructType().add("doc", docs.schema, False).add("n_lines", "long").add("n_removed", "long").add("kept", "string")
    # a text goes through the shuffle once, as part of its row, and is not sorted
    joined = keyed.join(gone.hint("shuffle_hash"), ["d", "mark"], "left").select("doc", F.col("doc")["text"].cast("string").alias("text"), "gone")
    return joined.mapInArrow(tidy(run), schema)

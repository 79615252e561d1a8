"""Quality rules: base counts of each text, and logistic regressions on hashed word and character n-grams.

Two models, ``quality`` and ``toxic``, are trained on labelled documents, calibrated by Platt's method on a part of
the sample kept apart, and applied in Arrow batches against fixed thresholds. Features: presence of word 1- and
2-grams (lower-cased runs of ASCII letters, digits and non-ASCII characters) and of the byte 4- and 6-grams that begin
a word, and shares of all byte 3- and 4-grams.
Presence features of fewer than ``LEAST`` documents of the sample are left out. Training uses at most about ``SAMPLE``
labelled documents, drawn by a hash of doc_id over the whole table.

Results for special rows: a null or empty text has zero counts and fails the base rules. Rows that repeat a doc_id are
judged one by one. Labels that are null or whose document is missing are not used; without labels of both kinds a
model passes everything. Other columns of documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import documents_only
from creditloom.llm.linear import Rows, fit, logistic, platt, sigmoid
from creditloom.llm.text import ALNUM, SPACED, Texts, mix, run_starts, slices, window_hashes

SAMPLE = 6000
LEAST = 5
WORD_BITS, CHAR_BITS = 18, 15
CHAR_SIZES = (3, 4)
PREFIXES = (4, 6)  # bytes
WIDTH = (1 << WORD_BITS) + (len(CHAR_SIZES) << CHAR_BITS)
MIN_WORDS = 50
REPEAT_PERCENT = 50
KEEP_QUALITY, DROP_TOXIC = 0.5, 0.5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    texts = Texts(column)
    words = texts.runs(SPACED)
    data = texts.bytes[: texts.n]
    total = lambda mark: np.concatenate([[0], np.cumsum(mark)])
    characters = total(SPACED[data] & ((data & 0xC0) != 0x80))
    symbols = total(_SYMBOLS[data])
    lines = texts.lines()
    worded = np.flatnonzero(np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start))
    own = mix(lines.hashes()[worded] ^ mix(lines.owner[worded].astype(np.uint64)))
    dup = np.bincount(lines.owner[worded], minlength=len(column)) - np.bincount(lines.owner[worded][np.unique(own, return_index=True)[1]], minlength=len(column))
    h, first = words.windows(words.hashes(), 3)
    h = mix(h ^ mix(words.owner[first].astype(np.uint64)))
    order = np.argsort(h)
    starts = run_starts(h[order])
    size = np.diff(np.append(starts, len(h)))
    twice = first[order[np.repeat(size > 1, size)]]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + 3, -1)
    repeat = np.bincount(words.owner[np.cumsum(change[:-1]) > 0], minlength=len(column))
    return {
        "n_words": words.count, "word_chars": np.diff(characters[texts.at]), "n_symbols": np.diff(symbols[texts.at]),
        "n_dup_lines": dup, "n_repeat_words": repeat,
    }


def _word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the distinct word 1- and 2-grams and word beginnings, ordered by text."""
    words = Texts(column, lower=True).runs(ALNUM)
    h = words.hashes()
    two, first = words.windows(h, 2)
    owners, features = [words.owner, words.owner[first]], [h, two]
    eight = np.ndarray((words.texts.n,), "<u8", words.texts.bytes, 0, (1,))
    for n in PREFIXES:
        at = np.flatnonzero(words.end - words.start >= n)
        owners.append(words.owner[at])
        features.append(mix((eight[words.start[at]] & np.uint64((1 << 8 * n) - 1)) * np.uint64(2 * n + 1)))
    owner = np.concatenate(owners)
    feature = np.concatenate(features) >> np.uint64(64 - WORD_BITS)
    both = np.unique((owner.astype(np.uint64) << np.uint64(WORD_BITS)) | feature)
    return (both >> np.uint64(WORD_BITS)).astype(np.int64), (both & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)


def _char_features(texts: Texts) -> Iterator[tuple[np.ndarray, int]]:
    four = np.ndarray((texts.n,), "<u4", texts.bytes, 0, (1,))
    for k, n in enumerate(CHAR_SIZES):
        code = four & np.uint32((1 << 8 * n) - 1) if n < 4 else four
        yield ((code * np.uint32(2654435761)) >> np.uint32(32 - CHAR_BITS)).astype(np.int64) + (1 << WORD_BITS) + (k << CHAR_BITS), n


def _features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    owner, words = _word_features(column)
    bounds = np.searchsorted(owner, np.arange(len(column) + 1))
    texts = Texts(column)
    orders = list(_char_features(texts))
    out = []
    for i, (a, b) in enumerate(zip(texts.at.tolist(), texts.at[1:].tolist())):
        mine = words[bounds[i] : bounds[i + 1]]
        index, value = [mine], [np.ones(len(mine))]
        for feature, n in orders:
            found, count = np.unique(feature[a : max(a, b - n + 1)], return_counts=True)
            index.append(found)
            value.append(20.0 * count / max(1, count.sum()))
        out.append((np.concatenate(index).astype(np.int32), np.concatenate(value).astype(np.float32)))
    return out


class Model:
    """Weights (feature, model), intercepts and calibration of ``quality`` and ``toxic``."""

    def __init__(self, fitted: dict[str, tuple[np.ndarray, float, float, float]]):
        self.names = list(fitted)
        self.weights = [fitted[n][0] for n in self.names]
        self.bias = [fitted[n][1:] for n in self.names]

    def probabilities(self, column: pa.Array) -> dict[str, np.ndarray]:
        owner, words = _word_features(column)
        texts = Texts(column)
        orders = [(np.append(feature, 0), n) for feature, n in _char_features(texts)]
        out = {}
        for name, w, (b, scale, shift) in zip(self.names, self.weights, self.bias):
            margin = np.bincount(owner, w[words], len(column)) + b
            for feature, n in orders:
                first, last = texts.at[:-1], np.maximum(texts.at[1:] - n + 1, texts.at[:-1])
                some = np.flatnonzero(last > first)
                if len(some):
                    sums = np.add.reduceat(w[feature], np.stack([first[some], last[some]], 1).ravel(), dtype=np.float64)[::2]
                    margin[some] += 20.0 * sums / (last - first)[some]
            out[name] = sigmoid(scale * margin + shift)
        return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit and calibrate both models on at most about ``sample`` labelled documents, one task for each model."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    count = marks.count()
    if not count:
        return Model({})
    # about ``sample`` rows of three numbers, whatever the number of labels
    drawn = marks.where(draw < min(1.0, sample / count))
    text = documents_only(docs).join(F.broadcast(drawn), "doc_id").where("text is not null and text <> ''")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                made = _features(rows.column("text"))
                index, value = [x.tobytes() for x, _ in made], [x.tobytes() for _, x in made]
                for name in ("quality", "toxic"):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(made)), rows.column("doc_id"), rows.column(name), pa.array(index, pa.binary()), pa.array(value, pa.binary())],
                        ["model", "doc_id", "y", "index", "value"],
                    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y"].notna() & (pdf["index"].map(len) > 0)].sort_values("doc_id")
        y = np.where(pdf["y"].to_numpy() == 1, 1.0, -1.0)
        if len(set(y)) < 2:
            return pd.DataFrame({"model": ["none"], "weights": [None], "bias": [0.0], "scale": [1.0], "shift": [0.0]})
        index, value = [np.frombuffer(x, np.int32) for x in pdf["index"]], [np.frombuffer(x, np.float32) for x in pdf["value"]]
        apart = np.arange(len(y)) % 5 == 0
        pick = lambda mask: Rows([index[i] for i in np.flatnonzero(mask)], [value[i] for i in np.flatnonzero(mask)], WIDTH)
        rows, rest = pick(~apart), pick(apart)
        often = np.bincount(rows.index, minlength=WIDTH) >= LEAST
        rows.keep(often)
        w, b = fit(rows, y[~apart], logistic, penalty=1.0)
        w = w * often
        scale, shift = platt(rest.times(w) + b, y[apart])
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "weights": [w.astype(np.float32).tobytes()], "bias": [b], "scale": [scale], "shift": [shift]})

    fitted = (
        text.mapInArrow(features, "model string, doc_id long, y int, index binary, value binary")
        .groupBy("model").applyInPandas(one, "model string, weights binary, bias double, scale double, shift double").collect()
    )
    return Model({r["model"]: (np.frombuffer(r["weights"], np.float32), r["bias"], r["scale"], r["shift"]) for r in sorted(fitted, key=lambda r: r["model"]) if r["weights"]})


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, p_quality and p_toxic (null where there is no such model). Map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                made = base_counts(rows.column("text"))
                failed = (made["n_words"] < MIN_WORDS) | (100 * made["n_repeat_words"] > REPEAT_PERCENT * made["n_words"])
                p = sent.value.probabilities(rows.column("text"))
                kept = ~failed
                if "quality" in p:
                    kept &= p["quality"] >= KEEP_QUALITY
                if "toxic" in p:
                    kept &= p["toxic"] < DROP_TOXIC
                columns = {"doc_id": rows.column("doc_id"), **{k: pa.array(v, pa.int64()) for k, v in made.items()}, "base_failed": pa.array(failed), "kept": pa.array(kept)}
                for name in ("quality", "toxic"):
                    columns[f"p_{name}"] = pa.array(p[name], pa.float64()) if name in p else pa.nulls(rows.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, p_quality double, p_toxic double"
    )
    return documents_only(docs).mapInArrow(run, schema)

"""Language identification in two steps: the family first, then linear support vector machines between the languages
of the family, one for each pair.

Features are hashed byte n-grams (2, 3, 4) of the lower-cased text with everything but letters turned into spaces, as
shares of the text's n-grams. All machines are linear, so a text's score is the mean of its n-grams' weights.
Training uses at most about ``SAMPLE`` documents of each language, drawn by a hash of doc_id over the whole table from
those whose crc32(doc_id) modulo 5 is not 0; only text and lang are read there, only text in prediction.

Results for special rows: a null text, or one without a letter, is ``und`` with score 0; so is everything if no
document has a language. A null doc_id is neither held out nor trained on. Rows that repeat a doc_id are predicted one
by one. Other columns are handed through in a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.llm.linear import Rows, fit, sigmoid, squared_hinge
from creditloom.llm.text import LOWER, Texts, slices, tidy

SAMPLE = 600
ORDERS = (2, 3, 4)
BITS = 14
WIDTH = len(ORDERS) << BITS
SLOPE = 3.0

# Families of language codes; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr"],
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTERS = LOWER.copy()
_LETTERS[:128] = [c if 97 <= c <= 122 else 32 for c in LOWER[:128]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def _ngrams(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: feature of every place, and each text's bounds among the places."""
    data = _LETTERS[texts.bytes]
    data[texts.n :] = 0
    four = np.ndarray((max(0, len(data) - 3),), "<u4", data, 0, (1,))[: texts.n]
    for k, n in enumerate(ORDERS):
        code = four & np.uint32((1 << 8 * n) - 1) if n < 4 else four.copy()
        feature = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32) + (k << BITS)
        yield feature, n


def _features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares, for each text."""
    texts = Texts(column)
    orders = list(_ngrams(texts))
    out = []
    for a, b in zip(texts.at.tolist(), texts.at[1:].tolist()):
        index, share = [], []
        for feature, n in orders:
            found, count = np.unique(feature[a : max(a, b - n + 1)], return_counts=True)
            index.append(found)
            share.append(count / max(1, count.sum()))
        out.append((np.concatenate(index).astype(np.int32), np.concatenate(share).astype(np.float32)))
    return out


def scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """Mean weights over each text's n-grams, summed over the orders: one row for each text."""
    docs = len(texts.at) - 1
    out = np.zeros((docs, weights.shape[1]), np.float64)
    for feature, n in _ngrams(texts):
        first, last = texts.at[:-1], np.maximum(texts.at[1:] - n + 1, texts.at[:-1])
        some = np.flatnonzero(last > first)
        if not len(some):
            continue
        cuts = np.stack([first[some], last[some]], 1).ravel()
        padded = np.append(feature, 0)
        for m in range(weights.shape[1]):
            sums = np.add.reduceat(weights[:, m][padded], cuts, dtype=np.float64)[::2]
            out[some, m] += sums / (last - first)[some]
    return out


class Model:
    """Languages by family, and the machines: ('family', f) says f or not; ('pair', a, b) is positive for a."""

    def __init__(self, languages: list[str], machines: dict[tuple, tuple[np.ndarray, float]]):
        self.families: dict[str, list[str]] = {}
        for code in languages:
            self.families.setdefault(_FAMILY.get(code, code), []).append(code)
        self.names = list(machines)
        self.weights = np.stack([machines[m][0] for m in self.names], 1).astype(np.float32) if machines else np.zeros((WIDTH, 0), np.float32)
        self.bias = np.array([machines[m][1] for m in self.names])

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = Texts(column)
        n = len(column)
        at = {name: k for k, name in enumerate(self.names)}
        chance = sigmoid(SLOPE * (scores(texts, self.weights) + self.bias)) if self.names else np.zeros((n, 0))
        if not self.families:
            return ["und"] * n, np.zeros(n)
        families = list(self.families)
        family = np.ones((n, 1)) if len(families) == 1 else np.stack([chance[:, at["family", f]] for f in families], 1)
        family = family / np.maximum(family.sum(1, keepdims=True), 1e-12)
        choice = family.argmax(1)
        label = np.empty(n, object)
        score = family.max(1)
        for k, f in enumerate(families):
            mine = np.flatnonzero(choice == k)
            codes = self.families[f]
            votes, sure = np.zeros((len(mine), len(codes))), np.ones((len(mine), len(codes)))
            for i, j in combinations(range(len(codes)), 2):
                p = chance[mine, at["pair", codes[i], codes[j]]]
                # a whole vote for the winner; the probabilities settle ties
                votes[:, i] += (p >= 0.5) + p / 1e3
                votes[:, j] += (p < 0.5) + (1 - p) / 1e3
                sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
            best = votes.argmax(1)
            label[mine] = np.array(codes, object)[best]
            score[mine] *= sure[np.arange(len(mine)), best]
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(65, 91), *range(97, 123)]] = True
        seen = np.concatenate([[0], np.cumsum(ascii_letter[texts.bytes[: texts.n]])])
        for i in np.flatnonzero(seen[texts.at[1:]] == seen[texts.at[:-1]]).tolist():
            if not any(c.isalpha() for c in column[i].as_py() or ""):
                label[i], score[i] = "und", 0.0
        return label.tolist(), score


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit all machines on at most about ``sample`` documents of each language; one task for each machine."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    source = source.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in source.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    families: dict[str, list[str]] = {}
    for code in languages:
        families.setdefault(_FAMILY.get(code, code), []).append(code)
    tasks = [("family", f) for f in families] if len(families) > 1 else []
    tasks += [("pair", a, b) for codes in families.values() for a, b in combinations(codes, 2)]
    if not tasks:
        return Model(languages, {})
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*(F.lit(x) for code, n in counts.items() for x in (code, min(1.0, sample / n))))
    drawn = source.where(draw < F.element_at(share, F.col("lang")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                made = _features(rows.column("text"))
                out: dict[str, list] = {"task": [], "sign": [], "index": [], "value": []}
                for code, (index, value) in zip(rows.column("lang").to_pylist(), made):
                    for k, task in enumerate(tasks):
                        if task[0] == "family" or code in task[1:]:
                            out["task"].append(k)
                            out["sign"].append(1 if (code in families[task[1]] if task[0] == "family" else code == task[1]) else -1)
                            out["index"].append(index.tobytes())
                            out["value"].append(value.tobytes())
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds)], list(out))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["index"].map(len) > 0]
        rows = Rows([np.frombuffer(x, np.int32) for x in pdf["index"]], [np.frombuffer(x, np.float32) for x in pdf["value"]], WIDTH)
        y = pdf["sign"].to_numpy(np.float64)
        w, b = fit(rows, y, squared_hinge, penalty=len(y) * 1e-5) if len(y) else (np.zeros(WIDTH), 0.0)
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) if len(y) else -1], "weights": [w.astype(np.float32).tobytes()], "bias": [b]})

    fitted = (
        drawn.select("text", "lang").mapInArrow(tidy(features), "task int, sign int, index binary, value binary")
        .groupBy("task").applyInPandas(one, "task int, weights binary, bias double").collect()
    )
    # one row of fixed size for each machine
    machines = {tasks[r["task"]]: (np.frombuffer(r["weights"], np.float32), r["bias"]) for r in fitted if r["task"] >= 0}
    return Model(languages, {t: machines.get(t, (np.zeros(WIDTH, np.float32), 0.0)) for t in tasks})


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every document (struct ``doc``) with ``held_out``, ``lang_pred`` and ``score``. Map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                label, score = sent.value.predict(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc"), rows.column("held_out"), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc", "held_out", "lang_pred", "score"]
                )

    pair = docs.select(F.struct("*").alias("doc"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType().add("doc", docs.schema, False).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    return pair.mapInArrow(tidy(run), schema)

"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Texts and templates are words (digits, letters, non-ASCII characters, lower-cased) in 5-word shingles; a shorter
template's only shingle is all its words. Templates are grouped by size: for those of T/2 + 1 to T shingles, windows of
T shingles (plus a step, where the step is more than one) overlap so that every stretch of T lies whole in one of them.
A band is one MinHash value. Where 0.8 of a template's shingles stand together, window and template have a similarity
of at least a third, so that ``BANDS`` bands miss it once in 30 million cases.

A template is found at a word where the next 1.25 t shingles hold at least 0.8 of its t distinct ones, t being their
number. The templates are a parameter of bounded size, sent to the tasks. Results for special rows: null and empty texts
hold nothing; templates without words are left out; rows that repeat a doc_id are scanned one by one. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import documents_only
from creditloom.llm.minhash import MinHash, narrow
from creditloom.llm.text import ALNUM, Texts, run_starts, slices, window_hashes

SHINGLE = 5
CONTAINMENT = 0.8
REACH = 1.25
BANDS = 43

# Notices that name a license, as authors write them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    ),
}


def _shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each word on, the word's text and its index there (whole shingles only)."""
    words = Texts(texts, lower=True).runs(ALNUM)
    h = words.hashes()
    index = np.arange(len(words))
    at = np.flatnonzero(words.bounds[1:][words.owner] - index >= size)
    return window_hashes(h, size)[at], words.owner[at], at - words.bounds[words.owner[at]]


class Template:
    def __init__(self, name: str, text: str):
        self.name = name
        count = len(Texts(pa.array([text]), lower=True).runs(ALNUM))
        self.size = min(SHINGLE, count)
        self.shingles = np.unique(_shingles(pa.array([text]), self.size)[0]) if count else np.empty(0, np.uint64)
        self.reach = math.ceil(REACH * len(self.shingles))
        self.least = math.ceil(CONTAINMENT * len(self.shingles) - 1e-9)
        self.top = 1 << max(0, len(self.shingles) - 1).bit_length()  # its size class


class Scanner:
    """Band tables of a set of templates."""

    def __init__(self, templates: dict[str, str]):
        made = [Template(n, t) for n, t in sorted(templates.items())]
        self.templates = [t for t in made if len(t.shingles)]
        self.hashes = MinHash(BANDS)
        # by shingle size and class: members, and for each band a small bitmap and the templates of each value
        self.classes: dict[tuple[int, int], list[int]] = {}
        for i, t in enumerate(self.templates):
            self.classes.setdefault((t.size, t.top), []).append(i)
        self.least = {i: self.hashes.signatures(t.shingles, np.array([0]))[0] for i, t in enumerate(self.templates)}

    def candidates(self, h: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """For each template of this shingle size, shingle places around which it may stand."""
        out: dict[int, list[np.ndarray]] = {}
        classes = {top: members for (s, top), members in self.classes.items() if s == size}
        x = narrow(h)
        buffer = np.empty_like(x)
        for k in range(BANDS):
            value = self.hashes.values(k, x, buffer)
            low, width, step = value, 1, 1
            for power in range(max(classes, default=0).bit_length()):
                top = 1 << power
                if top > 8:
                    # windows of nine steps, each an eighth of the class
                    value = np.minimum.reduceat(value, np.arange(0, len(value), 2)) if len(value) else value
                    step = top // 8
                    low = _sliding(value, 9)
                elif width < top:
                    low, width = _pairwise(low, width), top
                for i in classes.get(top, ()):
                    at = np.flatnonzero(low == self.least[i][k])
                    if len(at):
                        out.setdefault(i, []).append(at * step)
        return {i: np.unique(np.concatenate(x)) for i, x in out.items()}

    def scan(self, texts: pa.Array) -> list[tuple[np.ndarray, ...]]:
        """(text, template, containment, first word, places) of the templates found in each text."""
        found = []
        for size in sorted({t.size for t in self.templates}):
            h, owner, index = _shingles(texts, size)
            for i, at in self.candidates(h, size).items():
                t = self.templates[i]
                span = 1 if t.top <= 8 else t.top // 8 * 9
                # every start from which a stretch may reach into the window
                mark = np.zeros(len(h) + 1, np.int64)
                np.add.at(mark, np.maximum(at - t.reach + 1, 0), 1)
                np.add.at(mark, np.minimum(at + max(span, t.top), len(h)), -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                start = start[np.isin(h[start], t.shingles)]
                if not len(start):
                    continue
                # only places of the template's own shingles matter: at most ``reach`` from each start
                mine = np.flatnonzero(np.isin(h, t.shingles))
                which = np.searchsorted(t.shingles, h[mine])
                first = np.searchsorted(mine, start)
                held = np.zeros((len(start), len(t.shingles)), bool)
                for ahead in range(t.reach):
                    k = first + ahead
                    ok = k < len(mine)
                    ok[ok] = (mine[k[ok]] < start[ok] + t.reach) & (owner[mine[k[ok]]] == owner[start[ok]])
                    if not ok.any():
                        break
                    held[np.flatnonzero(ok), which[k[ok]]] = True
                count = held.sum(1)
                good = count >= t.least
                start, count = start[good], count[good]
                if not len(start):
                    continue
                runs = run_starts(owner[start])
                found.append(
                    (owner[start][runs], np.full(len(runs), i), np.maximum.reduceat(count, runs) / len(t.shingles), index[start][runs], np.diff(np.append(runs, len(start))))
                )
        return found


def _pairwise(low: np.ndarray, width: int) -> np.ndarray:
    """Minima over windows twice as wide."""
    out = low.copy()
    if len(low) > width:
        np.minimum(low[:-width], low[width:], out=out[:-width])
    return out


def _sliding(value: np.ndarray, n: int) -> np.ndarray:
    out = value.copy()
    for k in range(1, min(n, len(value))):
        np.minimum(out[:-k], value[k:], out=out[:-k])
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (the best of the document), first_word (where it is first found) and n_starts
    (words from which it is found), a row for each license of each document that has any. Map-only."""
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        names = pa.array([t.name for t in scanner.templates], pa.string())
        for batch in batches:
            for rows in slices(batch, "text"):
                for owner, which, best, first, n in scanner.scan(rows.column("text")):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").take(pa.array(owner)), names.take(pa.array(which)), pa.array(best, pa.float64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                        ["doc_id", "license", "containment", "first_word", "n_starts"],
                    )

    return documents_only(docs).mapInArrow(run, "doc_id long, license string, containment double, first_word long, n_starts long")

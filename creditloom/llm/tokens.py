"""Token ids of texts by a tokenizer file, for use inside tasks.

In the vocabularies used here a lone white-space character between two others always begins a new piece (and, but
for a space, is one by itself), so the pieces between them can be encoded on their own. Pieces repeat: every worker
keeps the ids of those it has met in a table sorted by the pieces' hash, and only new pieces reach the tokenizer.

Special tokens that a text holds literally have their own ids, as in the tokenizer's plain ``encode``. They are looked
for in the text as it is, before lower-casing; what lies between them is encoded like texts of their own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from creditloom.llm.text import Spans, Texts, ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_KEPT = 1_000_000  # pieces that a worker remembers (about 40 MB); beyond, it starts anew
_SPACE = np.zeros(256, bool)
_SPACE[:0x21] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b" \t\n\r")] = True
# first bytes of characters among which are white space; next to these nothing is split
_WIDE2 = np.zeros(256, bool)
_WIDE2[0xC2] = True
_WIDE3 = np.zeros(256, bool)
_WIDE3[[0xE1, 0xE2, 0xE3]] = True


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(not t.special or t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: only special tokens that stand for themselves can be cut out of texts")
        self.special = {t.content: i for i, t in added.items()}
        # of tokens that begin at one place the longest counts
        self.literal = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        letters = [chr(c) for c in range(65, 91)]
        alike = [self._ids(x) == self._ids(x.lower()) for x in letters]
        self.lower = all(alike)  # the vocabulary does not tell A from a
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.hash, self.proof = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.uint32)

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each followed by ``end``, and how many each text has."""
        docs = len(column)
        column, owner, after = self._cut(column, end)
        texts = Texts(column, self.lower)
        pieces = _pieces(texts)
        first, length, pool = self._lookup(pieces)
        ids = np.empty(int(length.sum()) + len(column), np.uint32)
        total = np.bincount(pieces.owner, weights=length, minlength=len(column)).astype(np.int64) + 1
        last = np.cumsum(total) - 1
        ids[last] = after
        keep = np.ones(len(ids), bool)
        keep[last] = False
        ids[keep] = pool[ranges(first, length)]
        return ids, np.bincount(owner, weights=total, minlength=docs).astype(np.int64)

    def _cut(self, column: pa.Array, end: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts cut at literal special tokens, the text that each part is of, and the id that follows it."""
        docs = len(column)
        hit = np.zeros(docs, bool)
        for token in self.special:
            hit |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        number = np.ones(docs, np.int64)
        after, parts, at = [], [], 0
        for i in np.flatnonzero(hit).tolist():
            found = self.literal.split(column[i].as_py())
            number[i] = len(found) // 2 + 1
            after += [np.full(i - at, end, np.uint32), np.array([*(self.special[t] for t in found[1::2]), end], np.uint32)]
            parts += [column.slice(at, i - at), pa.array(found[::2], column.type)]
            at = i + 1
        after.append(np.full(docs - at, end, np.uint32))
        parts.append(column.slice(at))
        return pa.concat_arrays(parts), np.repeat(np.arange(docs), number), np.concatenate(after)

    def _lookup(self, pieces: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece, where its ids begin in the returned pool, and their number."""
        codes, found = pd.factorize(pieces.hashes())
        sample = np.empty(len(found), np.int64)
        sample[codes[::-1]] = np.arange(len(codes))[::-1]
        proof = pieces.end[sample] - pieces.start[sample]
        data = pieces.texts.bytes
        proof = proof.astype(np.uint64) << np.uint64(56)
        if len(found):
            proof ^= np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))[pieces.start[sample]]
            short = (pieces.end[sample] - pieces.start[sample]) < 8
            proof[short] = (pieces.end[sample] - pieces.start[sample])[short]
        at = np.searchsorted(self.hash, found)
        known = at < len(self.hash)
        known[known] = (self.hash[at[known]] == found[known]) & (self.proof[at[known]] == proof[known])
        first, length = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        first[known], length[known] = self.first[at[known]], self.length[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            parts, sizes = [], []
            # what looks like a special token here has become so by lower-casing
            self.tokenizer.encode_special_tokens = True
            for k in range(0, len(fresh), 20_000):
                words = [pieces.string(i) for i in sample[fresh[k : k + 20_000]]]
                for code in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
                    ids = code.ids
                    parts.extend(ids)
                    sizes.append(len(ids))
            self.tokenizer.encode_special_tokens = False
            length[fresh] = sizes
            first[fresh] = len(self.pool) + np.cumsum(length[fresh]) - length[fresh]
            self.pool = np.concatenate([self.pool, np.array(parts, np.uint32)])
            self._remember(found[fresh], proof[fresh], first[fresh], length[fresh])
        pool = self.pool
        if len(self.hash) > _KEPT:
            self._forget()
        return first[codes], length[codes], pool

    def _remember(self, h: np.ndarray, proof: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        every = np.concatenate([self.hash, h])
        order = np.argsort(every, kind="stable")
        self.hash = every[order]
        self.proof = np.concatenate([self.proof, proof])[order]
        self.first = np.concatenate([self.first, first])[order]
        self.length = np.concatenate([self.length, length])[order]


def _pieces(texts: Texts) -> Spans:
    """Spans that cover every text; each can be encoded on its own."""
    n = texts.n
    data = texts.bytes[:n]
    lone = np.zeros(n, bool)
    if n > 2:
        space = _SPACE[data]
        lone[1:-1] = ~space[:-2] & ~space[2:]
        lone &= _BREAK[data]
        lone[texts.at[:-1][texts.at[:-1] < n]] = False
        lone[texts.at[1:][texts.at[1:] > 0] - 1] = False
        at = np.flatnonzero(lone)
        after = data[at + 1]
        wide = _WIDE2[after] | _WIDE3[after] | _WIDE2[data[np.maximum(at - 2, 0)]] | _WIDE3[data[np.maximum(at - 3, 0)]]
        at = at[~wide]
    else:
        at = np.empty(0, np.int64)
    opens = np.zeros(n, bool)
    opens[at] = True
    opens[at[data[at] != 0x20] + 1] = True
    opens[texts.at[:-1][np.diff(texts.at) > 0]] = True
    starts = np.flatnonzero(opens)
    return Spans(texts, starts, np.append(starts[1:], n)[: len(starts)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it stays for the worker's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

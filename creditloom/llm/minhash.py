"""MinHash signatures of shingle sets, band keys, and the Bayesian rule for giving up on a pair."""

from __future__ import annotations

import math

import numpy as np

from creditloom.llm.text import mix


_CACHED = 1 << 15


class MinHash:
    """``size`` hash functions x -> a * x + b on 32-bit shingle hashes; a signature is the minimum of each."""

    def __init__(self, size: int, seed: int = 1):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.a = (seeds[:size] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.b = (seeds[size:] >> np.uint64(32)).astype(np.uint32)

    def values(self, k: int, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        np.multiply(x, self.a[k], out=out)
        out += self.b[k]
        return out

    def signatures(self, shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row for each set; set i is shingles[starts[i] : starts[i + 1]] (the last to the end), none is empty."""
        out = np.empty((len(starts), len(self.a)), np.uint32)
        if not len(starts):
            return out
        x = narrow(shingles)
        # blocks of whole sets that stay in a core's cache while all functions pass over them
        cuts = np.flatnonzero(np.diff(starts // _CACHED, prepend=-1))
        for first, last in zip(cuts, np.append(cuts[1:], len(starts))):
            low, high = starts[first], starts[last] if last < len(starts) else len(x)
            part, inner = x[low:high], starts[first:last] - low
            buffer = np.empty_like(part)
            for k in range(len(self.a)):
                out[first:last, k] = np.minimum.reduceat(self.values(k, part, buffer), inner)
        return out


class Sketch:
    """``size`` MinHash values of a set in a few passes over it (fast similarity sketching of Dahlgaard, Knudsen and Thorup).

    A round throws every shingle into one of ``size`` bins; a bin keeps the least value of the first round that reaches it.
    Round ``size`` + i fills bin i. Bins of two sets are equal with the probability of their Jaccard similarity, as with a
    hash function for each value, but a set of n shingles takes some size * ln(size) / n rounds instead of ``size``."""

    _EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, size: int, seed: int = 1):
        self.size = size
        self.odd = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)

    def values(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        """One row of 64-bit values for each set; set i has the next number[i] > 0 shingles of ``x`` (well mixed 64-bit hashes).

        All sets share the rounds, so sets of similar size should come together."""
        out = np.full((len(number), self.size), self._EMPTY, np.uint64)
        if not len(number):
            return out
        flat, half, size = out.reshape(-1), np.uint64(32), np.uint64(self.size)
        base = np.repeat(np.arange(len(number)) * self.size, number)
        todo = np.arange(len(number))
        for r in range(2 * self.size):
            h = x * self.odd[r]
            h >>= half
            h *= size
            if r < self.size:
                at = (h >> half).view(np.int64)
                at += base
            else:
                at = base + (r - self.size)
            h &= np.uint64(0xFFFFFFFF)
            if r:
                h |= np.uint64(r << 32)
            np.minimum.at(flat, at, h)
            left = (out[todo] == self._EMPTY).any(1)
            if not left.any():
                break
            if left.mean() < 0.8:
                open_ = np.repeat(left, number[todo])
                x, base, todo = x[open_], base[open_], todo[left]
        return out


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 values, as two 64-bit numbers."""
    return np.packbits(((values[:, :128] >> np.uint64(16)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64).reshape(-1, 2)


def narrow(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` values; equal keys of different bands are told apart."""
    bands = signatures.shape[1] // rows
    out = np.empty((len(signatures), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(signatures), k + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k * rows + r])
        out[:, k] = h
    return out


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest equal values among ``n`` that leave a pair alive: with a uniform prior, the posterior probability of
    reaching ``threshold`` is P(Bin(n + 1, threshold) <= matches)."""
    total = 0.0
    for m in range(n + 2):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n + 1


def prune(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 32) -> np.ndarray:
    """Which pairs (left[a], right[b]) of signatures stay alive when their values are compared ``step`` by ``step``."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    size = left.shape[1]
    for k in range(0, size, step):
        end = min(size, k + step)
        for part in range(0, len(alive), 1 << 16):
            x = alive[part : part + (1 << 16)]
            matches[x] += (left[a[x], k:end] == right[b[x], k:end]).sum(1)
        alive = alive[matches[alive] >= least_matches(end, threshold, tolerance)]
    return alive

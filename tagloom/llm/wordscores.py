"""Scores of texts built from scores of their distinct words, which are computed once and kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .common import ship

ship(__name__)

#: Odd multiplier of the rolling hash of byte strings, and its final mixer.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


class WordScores:
    """Rows of `width` numbers for words, from score(list of words); forgets everything beyond `most` words."""

    def __init__(self, score: Callable[[list[bytes]], np.ndarray], width: int, most: int = 400_000) -> None:
        self.score, self.most = score, most
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((1024, width), dtype=np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.most:
            self.index.clear()
        new = list(set(words).difference(self.index))
        if new:
            start = len(self.index)
            if start + len(new) > len(self.rows):
                grown = np.zeros((max(2 * len(self.rows), start + len(new)), self.rows.shape[1]), dtype=np.float32)
                grown[:start] = self.rows[:start]
                self.rows = grown
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.rows[start + i : start + i + len(part)] = self.score(part)
            self.index.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def padded(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as a matrix of bytes, zeros after their ends, and their lengths (all at most width)."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width) if words else np.zeros((0, width), np.uint8), lengths


def substring_hash(prefix: np.ndarray, powers: np.ndarray, start: int, end: int) -> np.ndarray:
    """Hash of bytes [start, end) of each row, from prefix hashes."""
    return mixed(prefix[:, end] - prefix[:, start] * powers[end - start], end - start)


def mixed(raw: np.ndarray, length: int) -> np.ndarray:
    h = (raw + np.uint64(length)) * MIX
    return h ^ (h >> np.uint64(32))


def prefix_hashes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width = matrix.shape
    out, powers = np.zeros((n, width + 1), dtype=np.uint64), np.ones(width + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out[:, i + 1] = out[:, i] * BASE + matrix[:, i] + np.uint64(1)
            powers[i + 1] = powers[i] * BASE
    return out, powers


def hash_of(piece: bytes) -> int:
    """The same hash of one byte string."""
    raw = 0
    for b in piece:
        raw = (raw * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
    h = ((raw + len(piece)) * int(MIX)) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 32)


class Lookup:
    """Positions of hashes in a fixed set, -1 for others."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.sorted = hashes[self.order]
        bits = max(8, int(len(hashes)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        # Where the hashes with each first bits begin, by counting.
        self.first = np.zeros((1 << bits) + 1, dtype=np.int32)
        np.cumsum(np.bincount((self.sorted >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        top = (h >> self.shift).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(h.shape, -1, dtype=np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.sorted[at[live]] == h[live]
            out[live[hit]] = self.order[at[live[hit]]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

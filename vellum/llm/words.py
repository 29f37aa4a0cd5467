"""Hashes of words and of word shingles, for batches of texts, without a Python object a word."""

from __future__ import annotations

import functools

import numpy as np

#: White space as str.split() knows it: in ASCII by byte, beyond it by character.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
WIDE_SPACE = [c for c in map(chr, range(128, 0x3001)) if c.isspace()]
BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _letters() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the white-space separated words of all texts, words of each).

    A word's hash is a polynomial in its bytes modulo 2^64, taken from running sums and then mixed.
    """
    raw = []
    for t in texts:
        if not t.isascii() and any(c in t for c in WIDE_SPACE):
            t = " ".join(t.split())
        raw.append(t.encode("utf-8", "surrogatepass"))
    size = np.array([len(r) + 1 for r in raw], np.int64)
    data = np.frombuffer(b" ".join([*raw, b""]) if raw else b"", np.uint8)
    raw = []
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~ASCII_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.append(0, edge)
    begin, end = edge[::2], edge[1::2]  # the last byte is a space
    up = _powers(BASE, len(data))
    total = np.cumsum(np.append(np.uint64(0), _letters()[data] * up), dtype=np.uint64)
    down = _powers(pow(BASE, -1, 1 << 64), len(data))
    return mixed((total[end] - total[begin]) * down[begin]), np.diff(np.searchsorted(begin, np.append(0, np.cumsum(size))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of k words, runs of each text); a text of fewer words, if any, is one run."""
    total = len(hashes)
    begin = np.cumsum(n) - n
    left = np.repeat(begin + n, n) - np.arange(total)  # words from each to its text's end
    h = np.zeros(total, np.uint64)
    for j in range(k):
        part = np.full(total, j + 1, np.uint64)
        if j < total:
            part[: total - j] = np.where(left[: total - j] > j, hashes[j:], np.uint64(j + 1))
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + part)
    keep = (left >= k) | (np.repeat(n, n) < k) & (left == np.repeat(n, n))
    return h[keep], np.where(n > 0, np.maximum(n - k + 1, 1), 0)

"""Merge tables of byte-level BPE vocabularies as flat arrays."""

from __future__ import annotations

import base64
import functools
import json

import numpy as np

NO_RANK = 1 << 30


def displaced(pairs: dict[tuple[int, int], int], n_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs sparse rows over each other: the rank of (a, b) is ranks[d[a] + b] where owner[d[a] + b] is a."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), r in pairs.items():
        rows.setdefault(a, []).append((b, r))
    span = 1 << max(10, (3 * len(pairs)).bit_length())
    d = np.zeros(n_ids, np.int32)
    owner = np.full(span + n_ids, -1, np.int32)
    ranks = np.full(span + n_ids, NO_RANK, np.int32)
    rng = np.random.default_rng(7)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        bs = np.array([b for b, _ in row])
        while True:
            at = int(rng.integers(span))
            if (owner[at + bs] == -1).all():
                break
        d[a] = at
        owner[at + bs] = a
        ranks[at + bs] = [r for _, r in row]
    return d, owner, ranks


@functools.cache
def byte_letters() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def from_json(path: str):
    """(byte -> id, displaced pair table) of a tokenizers file; a merge's rank is its new symbol's id."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab, letters = model["vocab"], byte_letters()
    pairs = {}
    last = -1
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        new = vocab[a + b]
        assert new > last, "ranks must follow ids"
        pairs[vocab[a], vocab[b]] = last = new
    byte_ids = np.zeros(256, np.int32)
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    return byte_ids, displaced(pairs, max(vocab.values()) + 1)


def load_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


@functools.cache
def token_bytes(path: str) -> np.ndarray:
    """The bytes of each id, as an object array."""
    ranks = load_ranks(path)
    out = np.empty(max(ranks.values()) + 1, object)
    for t, r in ranks.items():
        out[r] = t
    return out


@functools.cache
def from_ranks(path: str):
    """(token bytes by id, byte -> id, displaced pair table) of a ranks file: each split of a token has its rank."""
    ranks = load_ranks(path)
    tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
    pairs = {}
    for t, r in ranks.items():
        tokens[r] = t
        for i in range(1, len(t)):
            a, b = ranks.get(t[:i]), ranks.get(t[i:])
            if a is not None and b is not None:
                pairs[a, b] = r
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    return tokens, byte_ids, displaced(pairs, len(tokens))

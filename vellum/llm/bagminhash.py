"""BagMinHash: signatures of multisets that agree in a component with the weighted Jaccard similarity.

Multiplicities are discretised at the integers and covered by intervals (0,1], (1,2], (2,4],
(4,8], ... For every element and interval a Poisson process, seeded by the two, throws points of
rate one per unit of weight; a point in the part above an element's multiplicity is dropped. So an
element of greater multiplicity sees the points of a smaller one and more. Each point goes to a
random component, which keeps its earliest. Processes run only to a horizon after which no
component can change.
"""

from __future__ import annotations

import numpy as np

from vellum.llm.words import mixed


def _uniform(seed: np.ndarray, salt: int) -> np.ndarray:
    x = mixed(seed + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def multisets(elements: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, multiplicity) of the distinct elements of each text; fewer than 2^16 texts."""
    keyed = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48)) | (elements >> np.uint64(16))
    keyed.sort()
    first = np.flatnonzero(np.append(True, keyed[1:] != keyed[:-1])) if len(keyed) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(keyed)))
    keyed = keyed[first]
    return (keyed >> np.uint64(48)).astype(np.int64), keyed & np.uint64((1 << 48) - 1), count


def signatures(elements: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """A row of m points (as the bits of their times) for each text; all ones for texts without elements."""
    doc, element, count = multisets(elements, n)
    total = np.bincount(doc, count, len(n))
    low, sets = 0, []
    while True:
        lo, hi = (0, 1) if low == 0 else (1 << (low - 1), 1 << low)
        inside = count > lo
        if not inside.any():
            break
        d, e, c = doc[inside], element[inside], count[inside]
        sets.append((d, mixed(e * np.uint64(0xD6E8FEB86659FD93) + np.uint64(low)), np.full(len(d), float(hi - lo)), np.minimum(1.0, (c - lo) / (hi - lo))))
        low += 1
    out = np.full((len(n), m), np.inf)
    if sets:
        d, seed, rate, part = (np.concatenate(x) for x in zip(*sets, strict=True))
        horizon = m * (np.log(m) + 3) / np.maximum(total, 1)
        turn = np.zeros(len(d), np.uint64)
        time = -np.log(_uniform(seed, 1)) / rate
        flat = out.reshape(-1)
        ready = np.flatnonzero(time <= horizon[d])
        while True:
            while len(ready):
                s = mixed(seed[ready] + turn[ready])
                keep = part[ready] >= 1.0
                partial = ~keep
                if partial.any():
                    keep[partial] = _uniform(s[partial], 3) <= part[ready][partial]
                at = d[ready] * m + (mixed(s + np.uint64(77)) % np.uint64(m)).astype(np.int64)
                np.minimum.at(flat, at[keep], time[ready][keep])
                turn[ready] += np.uint64(1)
                time[ready] += -np.log(_uniform(mixed(seed[ready] + turn[ready]), 2)) / rate[ready]
                ready = ready[time[ready] <= horizon[d[ready]]]
            unfilled = np.isinf(out).any(1) & (total > 0)
            if not unfilled.any():
                break
            horizon[unfilled] *= 2
            going = unfilled[d]
            d, seed, rate, part, turn, time = (x[going] for x in (d, seed, rate, part, turn, time))
            ready = np.flatnonzero(time <= horizon[d])
    return out.view(np.uint64)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each run of `rows` components, different from band to band."""
    out = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        h = np.full(len(sig), b + 1, np.uint64)
        for j in range(rows):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + j])
        out[:, b] = h
    return out

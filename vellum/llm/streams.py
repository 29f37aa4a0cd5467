"""Groups of a sorted stream of batches, for mapInPandas behind repartition and sortWithinPartitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame, bool]]:
    """(key, rows, first) for stretches of equal keys within each batch; first: the key was not seen just before."""
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b[k].to_numpy() for k in keys]
        change = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        cuts = [*np.flatnonzero(change).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[x] for c in cols)
            yield key, b.iloc[x:y], key != last
            last = key


def groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, all its rows), for keys known to have boundedly many rows."""
    held: list[pd.DataFrame] = []
    at: tuple = ()
    for key, rows, first in runs(batches, keys):
        if first and held:
            yield at, pd.concat(held) if len(held) > 1 else held[0]
            held = []
        at = key
        held.append(rows)
    if held:
        yield at, pd.concat(held) if len(held) > 1 else held[0]

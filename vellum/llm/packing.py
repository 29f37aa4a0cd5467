"""Best-fit packing of token sequences by a configuration linear program.

Documents are tokenized and cut into pieces in one pass, written once. The histogram of piece
lengths (at most `capacity` entries) goes to the driver. There the linear program over configurations
- multisets of lengths that fit one sequence - is solved by multiplicative weights on the prices of
lengths, with a knapsack dynamic program that finds the best configurations of a round. It is rounded
by whole uses of configurations that the knapsack finds at these prices, so that every piece, at every
size of table, has its place from one. Pieces are numbered within their length from counts by (task,
length), so no length meets in one task, and their number picks their place.

Null and empty texts are the end token alone. Repeated rows are packed each, and rows without an id.
Documents over the capacity are cut into full pieces, the first of which may be shorter; a text of any
length is tokenized whole. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import segments, token_count
from vellum.llm.durable import checkpointed
from vellum.llm.mapping import over_texts

#: Rounds of multiplicative weights, and the weight of a round.
ROUNDS, STEP = 40, 0.5
#: In rounding a price counts more the longer its length, by these powers; the better result is taken.
BENT = (0.05, 0.5)


def encoding(path: str) -> Callable[[list[str]], Iterator[bytes]]:
    """A function from texts to their ids, as little-endian unsigned 32-bit integers; it keeps those of the words it has met."""
    words = token_count.Words(path)
    known: list[bytes] = []

    def encode(texts: list[str]) -> Iterator[bytes]:
        for s in segments.slices(texts):
            numbers = [words.numbers.of(t) for t in texts[s]]
            for ids, n in words.learnt():
                flat = ids.astype("<u4").tobytes()
                at = (4 * np.cumsum(np.append(0, n))).tolist()
                known.extend(flat[a:b] for a, b in zip(at, at[1:], strict=False))
            get = known.__getitem__
            for own in numbers:
                yield b"".join(map(get, np.frombuffer(own, "<u4").tolist()))
            if words.full():
                known.clear()

    return encode


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(path)  # what it keeps ends with the task
        end = np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            out = []
            for key, ids in zip(b["doc_id"], encode(b["text"].fillna("").tolist()), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((key, i, x, y - x, zlib.crc32(ids[4 * x : 4 * y]), seen[y - x]))
                    seen[y - x] += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
            yield frame.assign(doc_id=pd.Series([x[0] for x in out], dtype=object), part=part)  # as numbers, ids beside a null are rounded

    return run


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity: the best price of lengths (ascending) that fit, and the last of them taken (-1: none)."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        got = price[: upto[c]] + best[c - lengths[: upto[c]]]
        j = int(got.argmax())
        if got[j] > best[c - 1]:
            best[c], took[c] = got[j], j
        else:
            best[c] = best[c - 1]
    return best, took


def _with(j: int, took: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration that holds length j: index -> copies."""
    out, room = {j: 1}, capacity - int(lengths[j])
    while room > 0:
        if (k := int(took[room])) < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


def prices(lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(price of each length, lower bound on the sequences) of the configuration program, by multiplicative weights.

    Prices start in proportion to length. In each round a knapsack finds the best configurations, one with each length;
    those of the best price cover their lengths, and the price of a length falls by a factor for what is covered of it,
    beside the others. Prices over that of the best configuration are a solution of the dual program, whose value no
    packing can go below; the round with the greatest value gives the result.
    """
    start, cover = np.log(lengths / capacity), np.zeros(len(lengths))
    bound, found = 0.0, lengths / capacity
    for _ in range(ROUNDS):
        price = np.exp(start - STEP * (cover - cover.mean()))
        best, took = _knapsack(lengths, price, capacity)
        if (value := (price * need).sum() / best[capacity]) > bound:
            bound, found = value, price / best[capacity]
        got = np.zeros(len(lengths))
        for j in np.flatnonzero(price + best[capacity - lengths] >= best[capacity] * (1 - 1e-3)):
            for k, copies in _with(int(j), took, lengths, capacity).items():
                got[k] += copies * need[j]
        cover += (got / need) / max((got / need).max(), 1e-9)
    return found, bound


def _rounded(lengths: np.ndarray, need: np.ndarray, price: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of configurations: the longest length left goes with the best rest by price, as often as there are copies.

    A knapsack's table serves until a configuration asks for more copies than are left; where it asks so at once, the
    copies are cut to those left and the room goes to the longest that fit.
    """
    left = need.astype(np.int64)
    out: list[tuple[dict[int, int], int]] = []
    while left.any():
        at = np.flatnonzero(left)
        own = lengths[at]
        _, took = _knapsack(own, price[at], capacity)
        fresh, j = True, len(own) - 1
        while j >= 0:
            if not left[at[j]]:
                j -= 1
                continue
            conf = _with(j, took, own, capacity)
            times = min(int(left[at[k]]) // copies for k, copies in conf.items())
            if not times:
                if not fresh:
                    break
                conf, times = {k: min(copies, int(left[at[k]])) for k, copies in conf.items()}, 1
                room = capacity - sum(int(own[k]) * copies for k, copies in conf.items())
                for k in range(int(np.searchsorted(own, room, side="right")) - 1, -1, -1):
                    if more := min(room // int(own[k]), int(left[at[k]]) - conf.get(k, 0)):
                        conf[k] = conf.get(k, 0) + more
                        room -= more * int(own[k])
            out.append(({int(own[k]): copies for k, copies in conf.items()}, times))
            for k, copies in conf.items():
                left[at[k]] -= copies * times
            fresh = False
    return out


def configurations(hist: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(length -> copies, times) so that each length is used exactly hist[length] times."""
    full = hist.get(capacity, 0)
    out = [({capacity: 1}, int(full))] if full else []
    lengths = np.array(sorted(n for n, times in hist.items() if times and n < capacity), np.int64)
    if not len(lengths):
        return out
    need = np.array([hist[n] for n in lengths.tolist()], float)
    price, _ = prices(lengths, need, capacity)
    tries = [_rounded(lengths, need, price * (lengths / capacity) ** bent, capacity) for bent in BENT]
    return out + min(tries, key=lambda confs: sum(times for _, times in confs))


def _places(confs: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each configuration's share of its pieces begins, copies in one, first sequence, offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    base, seen = 0, dict.fromkeys(range(1, capacity + 1), 0)
    for conf, times in confs:
        offset = 0
        for n, copies in conf.items():
            rows.setdefault(n, []).append((seen[n], copies, base, offset))
            seen[n] += copies * times
            offset += n * copies
        base += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, part int"
    pieces = checkpointed(over_texts(docs.select("doc_id", "text"), _pieces(path, capacity, end_id), schema))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(configurations(hist, capacity), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, nth, begin = (b.column(c).to_numpy() for c in ("length", "nth", "first"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n, rows in pd.Series(length).groupby(length).indices.items():
                begins, copies, base, offset = places[n]
                i = nth[rows] + begin[rows]
                k = np.searchsorted(begins, i, side="right") - 1
                at = i - begins[k]
                seq[rows] = base[k] + at // copies[k]
                off[rows] = offset[k] + at % copies[k] * n
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(seq), pa.array(off)], [*kept, "sequence_id", "offset"])

    return pieces.join(first, ["part", "length"]).mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")

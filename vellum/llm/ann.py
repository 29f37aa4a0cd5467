"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact cosine.

Unit vectors are hashed in `TABLES` tables by `HASHES` random projections each, cut into slots of
`WIDTH`. A query looks into its own bucket and those next to it in the order in which they are
expected to hold neighbours: perturbations of least expected squared distance to the slots' edges
(one order of ranks for all queries, applied to each query's own distances). Buckets of more than
`CHUNK` vectors are split, and queries sent to every part. Each part's exact best go on; the best of
all are the result. A query that finds fewer than k is compared with all vectors, in blocks. Every row
is indexed; the projections are random and need no fitting.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id. Vectors meet only those of their own length. Equal rows of one id count once. Ties go
to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import streams
from vellum.llm.durable import stored
from vellum.llm.words import mixed

TABLES, HASHES, WIDTH, PROBES = 3, 4, 1.3, 64
CHUNK = 4096
SEED = 5


@functools.cache
def projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + size)
    return rng.normal(size=(size, TABLES * HASHES)), rng.uniform(0, 1, TABLES * HASHES)


@functools.cache
def probe_sets() -> list[tuple[int, ...]]:
    """Sets of ranks (0 nearest edge ... 2 * HASHES - 1 farthest) by expected squared distance, the empty set first."""
    m = 2 * HASHES
    half = HASHES
    expected = [(j * (j + 1)) / (4 * (half + 1) * (half + 2)) if j <= half else 1 - (m + 1 - j) / (half + 1) + (m + 1 - j) * (m + 2 - j) / (4 * (half + 1) * (half + 2)) for j in range(1, m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(expected[0], (0,))]
    while heap and len(out) < PROBES:
        _, s = heapq.heappop(heap)
        if all(m - 1 - j not in s for j in s):  # not both edges of one slot
            out.append(s)
        if (top := s[-1]) + 1 < m:
            for t in ((*s[:-1], top + 1), (*s, top + 1)):
                heapq.heappush(heap, (sum(expected[j] for j in t), t))
    return out


def _keys(slots: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row's slots: (..., TABLES, HASHES) whole numbers."""
    h = np.broadcast_to(np.arange(1, TABLES + 1, dtype=np.uint64), slots.shape[:-1]).copy()
    for j in range(HASHES):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + slots[..., j].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _placed(vectors: np.ndarray) -> np.ndarray:
    a, b = projections(vectors.shape[1])
    unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return (unit @ a / WIDTH + b).reshape(len(vectors), TABLES, HASHES)


def buckets(vectors: np.ndarray) -> np.ndarray:
    return _keys(np.floor(_placed(vectors)))


def probes(vectors: np.ndarray) -> np.ndarray:
    """(vectors, TABLES * PROBES) keys."""
    at = _placed(vectors)
    slot = np.floor(at)
    down = at - slot
    edge = np.concatenate([down, 1 - down], 2)  # to the lower and the upper edge
    rank = np.argsort(edge, axis=2, kind="stable")
    out = []
    for s in probe_sets():
        moved = slot.copy()
        for j in s:
            which = rank[:, :, j]
            np.put_along_axis(moved, (which % HASHES)[..., None], np.take_along_axis(moved, (which % HASHES)[..., None], 2) + np.where(which < HASHES, -1, 1)[..., None], 2)
        out.append(_keys(moved))
    return np.concatenate(out, 1)


def _hashed(find):
    """(key, size, id) of each key of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, rows in b.groupby(b["vector"].map(len)).indices.items():
                for part in np.array_split(rows, -(-len(rows) // 2048)):
                    keys = find(np.stack(b["vector"].to_numpy()[part]).astype(np.float64))
                    yield pd.DataFrame({"key": keys.ravel(), "size": np.int32(size), "id": np.repeat(b["id"].to_numpy()[part], keys.shape[1])})

    return run


def _reranked(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list = []
        ready = None
        for _, rows, first in streams.runs(batches, ["key", "size", "chunk"]):
            if first:
                parts, ready = [], None
            kind = rows["kind"].to_numpy()
            if (kind == 0).any():
                parts.append(rows[kind == 0])
            asked = rows[kind == 1]
            if not len(asked) or not parts:
                continue
            if ready is None:
                held = pd.concat(parts)
                data, ids = np.stack(held["vector"].to_numpy()).astype(np.float64), held["id"].to_numpy()
                ready = data, ids, np.sqrt((data * data).sum(1))
            data, ids, norm = ready
            out = []
            for own, q in zip(asked["id"], asked["vector"], strict=True):
                q = np.asarray(q, np.float64)
                score = (data * q).sum(1) / (np.sqrt((q * q).sum()) * norm)
                other = np.flatnonzero(ids != own)
                if len(other):
                    top = other[np.lexsort((ids[other], -score[other]))[:k]]
                    out.append((np.full(len(top), own), ids[top], score[top]))
            if out:
                yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from key, size, chunk, kind (0: candidate, 1: query), id, vector."""
    found = rows.repartition("key", "size", "chunk").sortWithinPartitions("key", "size", "chunk", "kind", "id").mapInPandas(_reranked(k), "query_id bigint, vec_id bigint, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _dealt(df: DataFrame, kind: int) -> DataFrame:
    return df.select("key", "size", "chunk", F.lit(kind).alias("kind"), "id", "vector")


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of all, by blocks of about `CHUNK` vectors."""
    blocks = max(1, -(-vectors.count() // CHUNK))
    data = vectors.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = queries.distinct().withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    one = lambda df: df.withColumn("key", F.lit(0).cast("bigint")).withColumn("size", F.size("vector"))
    return _best(_dealt(one(data), 0).unionByName(_dealt(one(asked), 1)), k)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) of the k nearest found; both tables hold id and vector (doubles).

    A query whose buckets hold fewer than k candidates is compared with all vectors.
    """
    queries = queries.distinct()
    index = vectors.mapInPandas(_hashed(buckets), "key bigint, size int, id bigint")
    chunks = index.groupBy("key", "size").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # vectors join once it is known which buckets there are; a big bucket's chunks are dealt by id
    data = index.join(chunks, ["key", "size"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).join(vectors, "id")
    asked = queries.mapInPandas(_hashed(probes), "key bigint, size int, id bigint").distinct().join(chunks, ["key", "size"])
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(queries, "id")
    found = stored(_best(_dealt(data.where(F.size("vector") == F.col("size")), 0).unionByName(_dealt(asked.where(F.size("vector") == F.col("size")), 1)), k))
    few = queries.join(found.where(F.col("rank") == k).select(F.col("query_id").alias("id")), "id", "left_anti")
    if few.isEmpty():
        return found
    return found.join(few.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact(vectors, few, k))


def sound(embeddings: DataFrame) -> DataFrame:
    """id and vector (doubles) of the rows that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return embeddings.where(ok).where(fine).select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))

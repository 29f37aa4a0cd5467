"""Exact top-k inner products by Fagin's threshold algorithm, block by block.

Rows are dealt into blocks of about `BLOCK` vectors by a hash of their id, and every query is sent
to every block. A block sorts its vectors along each dimension once. A query goes down those lists
together - from the top where its component is positive, from the bottom where it is negative -
scores what it meets, and stops when even the values at its depth could not make a score equal to
its kth best. The blocks' best are merged. A task holds one block; queries stream past it.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id. Vectors meet only those of their own length. Equal rows of one id count once. Ties go to the
smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import streams

BLOCK = 4096
FIRST_STEP = 32


def best(order: np.ndarray, values: np.ndarray, data: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best, best first. order, values: rows and components along each dimension, ascending."""
    n = len(data)
    use = np.flatnonzero(query)
    up = query[use] > 0
    weight = query[use]
    seen = np.zeros(n, bool)
    top_ids, top_scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_STEP
    while depth < n:
        to = min(n, depth + step)
        if len(use):
            down = order[use[up], n - to : n - depth]
            rise = order[use[~up], depth:to]
            mark = np.zeros(n, bool)
            mark[down.ravel()] = mark[rise.ravel()] = True
            met = np.flatnonzero(mark & ~seen)
        else:
            met = np.arange(depth, to)
        seen[met] = True
        met = met[ids[met] != own]
        top_ids = np.concatenate([top_ids, ids[met]])
        top_scores = np.concatenate([top_scores, data[met] @ query])
        keep = np.lexsort((top_ids, -top_scores))[:k]
        top_ids, top_scores = top_ids[keep], top_scores[keep]
        depth, step = to, step * 2
        if depth < n and len(use) and len(top_ids) == k:
            edge = np.where(up, values[use, n - 1 - depth], values[use, depth])
            if int(edge @ weight) < top_scores[-1]:
                break
    return top_ids, top_scores


def _searched(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list = []
        ready = None
        for _, rows, first in streams.runs(batches, ["block", "size"]):
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
                data, ids = np.stack(held["vector"].to_numpy()).astype(np.int64), held["id"].to_numpy()
                order = np.argsort(data.T, axis=1, kind="stable")
                ready = order, np.take_along_axis(data.T, order, 1), data, ids
            out = []
            for own, q in zip(asked["id"], asked["vector"], strict=True):
                found, scores = best(*ready, np.asarray(q, np.int64), own, k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": scores}))
            yield pd.concat(out)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score; both tables hold id and vector (whole numbers)."""
    blocks = max(1, -(-vectors.count() // BLOCK))
    data = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "vector")
    asked = queries.distinct().select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.lit(1).alias("kind"), "id", "vector")
    rows = data.unionByName(asked).withColumn("size", F.size("vector"))
    found = rows.repartition("block", "size").sortWithinPartitions("block", "size", "kind", "id").mapInPandas(_searched(k), "query_id bigint, vec_id bigint, score bigint").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(embeddings: DataFrame) -> DataFrame:
    """id and floor(1024 * x) of each component, for vectors that take part."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(ok).where(sound).select(F.col("vec_id").cast("bigint").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))

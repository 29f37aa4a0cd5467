"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams (hashed), a window of words the
mean of its words, and a softmax over a linear layer gives the window's probability; embeddings
and layer are trained jointly in numpy. A document is as toxic as its most toxic window, in
training too: there each document stands for its window that scores highest so far. Because the
model is linear behind the averages, scoring looks up one number for each word.

Training reads at most `SAMPLE` labelled documents of each class, the first by a hash of their id,
each whole and one at a time: a fixed bound on rows, whatever the input.
Scoring reads every text whole. Null and empty texts score 0.0; without labels of both classes so
does everything. A document labelled twice counts as toxic if either label says so. Repeated rows
are scored each, and of those with one id the sample takes the greatest text; other columns are not read. An empty table gives no
rows, and the score of a text, of any length, does not depend on the other rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import segments
from vellum.llm.durable import tidied
from vellum.llm.mapping import give_back

BUCKETS = 1 << 17
SIZE = 8
WINDOW = 32
SAMPLE = 3000
EPOCHS = 14
#: Of the adaptive step: its size, and what counts as squared gradients seen before the first.
RATE, START = 1.0, 1e-3
FOLDS = 5
#: Words whose n-grams are found at once in training.
GRAM_SLICE = 20_000
TRIM = ".,;:!?\"'()[]{}*&%$#@~|<>-_"


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' grams one after another, their number for each): the whole word and its 3- to 5-grams."""
    marked = [f"<{w.lower().strip(TRIM)}>" for w in words]
    size = np.array([len(w) for w in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), size)
    begin = np.cumsum(size) - size
    place = (np.arange(len(code)) - begin[of]).astype(np.uint64)
    whole = np.add.reduceat((code + np.uint64(1)) * _mixed(place + np.uint64(17)), begin)
    owner, hashes = [np.arange(len(words))], [_mixed(whole)]
    for n in (3, 4, 5):
        if len(code) >= n:
            h = np.zeros(len(code) - n + 1, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + code[j : len(code) - n + 1 + j] + np.uint64(n)
            inside = of[: len(h)] == of[n - 1 :]
            owner.append(of[: len(h)][inside])
            hashes.append(_mixed(h[inside]))
    owner_all, hash_all = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner_all, kind="stable")
    return (hash_all[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(owner_all, minlength=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def windows(text: str) -> list[list[str]]:
    words = text.split()
    return [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]


def train(samples: Iterable[tuple[int, list[list[str]]]], seed: int = 11) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) from (label, windows) pairs; words become numbers as they come, so that the texts need not be held."""
    index: dict[str, int] = {}
    numbers, sizes, labels, counts = [], [], [], []
    for y, ws in samples:
        if ws:
            numbers.append(np.array([index.setdefault(w, len(index)) for win in ws for w in win], np.int32))
            sizes.append(np.array([len(win) for win in ws]))
            labels.append(y)
            counts.append(len(ws))
    if len({*labels}) < 2:
        return np.zeros(BUCKETS), -np.inf
    rng = np.random.default_rng(seed)
    flat, size, label = np.concatenate(numbers), np.concatenate(sizes), np.array(labels, float)
    numbers, sizes = [], []
    doc = np.repeat(np.arange(len(label)), counts)
    begin = np.cumsum(size) - size
    words = [*index]
    index = {}
    parts = [grams(words[i : i + GRAM_SLICE]) for i in range(0, len(words), GRAM_SLICE)]
    bag, bag_size = np.concatenate([b.astype(np.int32) for b, _ in parts]), np.concatenate([n for _, n in parts])
    words, parts = [], []
    bag_begin = np.cumsum(bag_size) - bag_size
    embed, layer, bias = rng.normal(0, 0.01, (BUCKETS, SIZE)), rng.normal(0, 1, (SIZE, 2)), np.zeros(2)
    seen_embed, seen_layer, seen_bias = np.full((BUCKETS, SIZE), START), np.full((SIZE, 2), 1e-2), np.full(2, 1e-2)
    share = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    for epoch in range(EPOCHS):
        if epoch:
            bucket = embed @ (layer[:, 1] - layer[:, 0])
            word = np.concatenate([_sums(bucket, bag, bag_begin, i) for i in range(0, len(bag_size), GRAM_SLICE)]) / bag_size
            score = np.add.reduceat(word[flat], begin) / size
        else:
            score = rng.random(len(size))
        order = np.lexsort((-score, doc))
        chosen = order[np.searchsorted(doc[order], np.arange(len(label)))]
        for at in np.array_split(rng.permutation(len(label)), max(1, len(label) // 128)):
            win = chosen[at]
            n = size[win]
            of = np.repeat(np.arange(len(at)), n)
            word = flat[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[win], n)]
            k = bag_size[word]
            g = bag[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(bag_begin[word], k)]
            part = np.repeat(1 / (n[of] * k), k)
            row = np.repeat(of, k)
            hidden = np.stack([np.bincount(row, embed[g, j] * part, len(at)) for j in range(SIZE)], 1)
            z = hidden @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.stack([1 - label[at], label[at]], 1)) * share[at, None]
            ids, inverse = np.unique(g, return_inverse=True)
            d_embed = np.outer(np.bincount(inverse, part * err[row, 1]), layer[:, 1] - layer[:, 0])
            d_layer, d_bias = hidden.T @ err, err.sum(0)
            seen_embed[ids] += d_embed**2
            embed[ids] -= RATE * d_embed / np.sqrt(seen_embed[ids])
            seen_layer += d_layer**2
            layer -= 0.1 * d_layer / np.sqrt(seen_layer)
            seen_bias += d_bias**2
            bias -= 0.1 * d_bias / np.sqrt(seen_bias)
    return embed @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _sums(value: np.ndarray, bag: np.ndarray, begin: np.ndarray, i: int) -> np.ndarray:
    """The sums of the values of the bags of GRAM_SLICE words from the i-th on."""
    part = begin[i : i + GRAM_SLICE + 1]
    inside = bag[part[0] : part[-1] if len(part) > GRAM_SLICE else len(bag)]
    return np.add.reduceat(value[inside], part[:GRAM_SLICE] - part[0])


class Scorer:
    """Scores texts; keeps the scores of words."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias, self.known, self.bytes = weights, bias, {}, 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([self._of(texts[s]) for s in segments.slices(texts)]) if texts else np.zeros(0)

    def _of(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        if self.bytes > segments.CACHE_BYTES:
            self.known, self.bytes = {}, 0
        fresh = [*(set().union(*words) - self.known.keys())]
        if fresh:
            self.bytes += sum(map(len, fresh)) + len(fresh) * segments.ENTRY_BYTES
            bag, n = grams(fresh)
            mean = np.add.reduceat(self.weights[bag], np.cumsum(n) - n) / n
            self.known.update(zip(fresh, mean.tolist(), strict=True))
        get = self.known.__getitem__
        out = np.zeros(len(texts))
        for i, ws in enumerate(words):
            if ws:
                at = np.arange(0, len(ws), WINDOW)
                total = np.add.reduceat(np.fromiter(map(get, ws), float, len(ws)), at)
                best = (total / np.minimum(WINDOW, len(ws) - at)).max() + self.bias
                out[i] = 0.0 if np.isneginf(best) else 1 / (1 + np.exp(-np.clip(best, -700, 700)))
        return out


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on documents of the training folds."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_class = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    chosen = by_class[0].unionByName(by_class[1]).select(F.col("doc_id").alias("_id"), "toxic")

    # at most 2 * SAMPLE ids are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where(F.col("text").isNotNull())
    # rows may share an id: one each keeps the sample within its bound
    each = sample.select("doc_id", "text", "toxic").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    tidied(docs.sparkSession)
    model = train((int(r["toxic"]), windows(r["text"])) for r in each.orderBy("doc_id").toLocalIterator())
    give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with two columns more, of the names given; docs must not have those."""
    if taken := {c.lower() for c in docs.columns} & {score.lower(), predicted.lower()}:
        raise ValueError(f"docs has {sorted(taken)}; name other columns for the results")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)  # what it keeps ends with the task
        for texts in batches:
            yield pd.Series(scorer(texts.fillna("").tolist()))
        scorer = texts = None
        give_back()

    return docs.withColumn(score, scored(F.col("text"))).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))

"""Token counts by rank-synchronous merging of ragged numpy arrays.

Distinct pre-tokens not met before in a task are held as one flat array of symbols with the
index of the pre-token each belongs to. Every round finds each pre-token's lowest-rank pair and
merges it in all of them at once; what survives is counted. A text's count is the sum over its
pre-tokens. Nothing is shuffled.

Null and empty texts have no tokens and no bytes; repeated rows are counted each; a text of any
length is counted whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import bpe_tables, segments
from vellum.llm.wordnumbers import Numbers

CHUNK_BYTES = 1 << 20
#: What the library calls white space: not the four separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def merge(words: list[bytes], byte_ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols left of all non-empty words, one word after another; their number for each)."""
    d, owner, ranks = table
    none = bpe_tables.NO_RANK
    lengths = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    ids = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    while len(ids):
        slot = d[ids[:-1]] + ids[1:]
        rank = np.append(np.where((owner[slot] == ids[:-1]) & (word[1:] == word[:-1]), ranks[slot], none), none)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(ids)))
        over = low == none
        counts[word[first[over]]] = size[over]
        low = np.repeat(low, size)
        going = low < none
        done.append((word[~going], ids[~going]))
        ids, word, rank, low = ids[going], word[going], rank[going], low[going]
        hit = rank == low
        # of overlapping places the first, third, ... merge
        at = np.arange(len(ids))
        run = at - np.maximum.accumulate(np.where(hit, -1, at)) - 1
        hit &= run % 2 == 0
        ids = np.where(hit, low, ids)
        keep = np.append(True, ~hit[:-1])[: len(ids)]
        ids, word = ids[keep], word[keep]
    if not done:
        return np.zeros(0, np.int32), counts
    of = np.concatenate([w for w, _ in done])
    return np.concatenate([i for _, i in done])[np.argsort(of, kind="stable")], counts


class Words:
    """Splits texts into pre-tokens as the tokenizer of a file does, and merges each distinct one once.

    The file's pre-tokenizer must be the byte-level one, by its own pattern and without a blank put in front; other files are refused.
    """

    def __init__(self, path: str) -> None:
        import json

        import regex

        model = json.load(open(path, encoding="utf-8"))
        pre = model["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("normalizer"):
            raise ValueError(f"{path}: only byte-level tokenizers without a normalizer are counted")
        self.byte_ids, self.table = bpe_tables.from_json(path)
        find = regex.compile(PATTERN).findall
        self.special = special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if special:
            cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split
            # without self: a cycle would keep all words past the task, until Python happens to look for cycles
            self.find = lambda t: [w for i, part in enumerate(cut(t)) for w in ([part] if i % 2 else find(part))] if any(s in t for s in special) else find(t)
        else:
            self.find = find
        self.numbers = Numbers(self.find)

    def learnt(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, their number for each) of the words numbered since the last call, in order, in chunks."""
        chunk: list[str] = []
        n = 0
        for w in [*self.numbers.new(), None]:
            if chunk and (w is None or n > CHUNK_BYTES or w in self.special):
                yield merge([x.encode("utf-8") for x in chunk], self.byte_ids, self.table)
                chunk, n = [], 0
            if w in self.special:
                yield np.array([self.special[w]], np.int32), np.array([1])
            elif w is not None:
                chunk.append(w)
                n += len(w)

    def full(self) -> bool:
        """Whether as much is kept as may be; if so, all is forgotten."""
        if self.numbers.bytes <= segments.CACHE_BYTES:
            return False
        self.numbers = Numbers(self.find)
        return True


def counting(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens that keeps the counts of the words it has met."""
    words = Words(path)
    known = np.zeros(0, np.int64)

    def count(texts: list[str]) -> list[int]:
        nonlocal known
        out: list[int] = []
        for s in segments.slices(texts):
            numbers = [words.numbers.of(t) for t in texts[s]]
            known = np.concatenate([known, *(n for _, n in words.learnt())])
            each = known[np.frombuffer(b"".join(numbers), "<u4")]
            ends = np.cumsum([0, *(len(n) // 4 for n in numbers)])
            total = np.append(0, np.cumsum(each))
            out += (total[ends[1:]] - total[ends[:-1]]).tolist()
            if words.full():
                known = known[:0]
        return out

    return count


def count_tokens(docs: DataFrame, key: str, text: str, path: str, limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of each row, as the tokenizer file at `path` counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counting(path)  # what it keeps ends with the task
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_bytes": b["n_bytes"], "n_tokens": count(b["text"].fillna("").tolist())})

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, n_bytes bigint, n_tokens bigint").withColumnRenamed("key", key).withColumn("over_limit", F.col("n_tokens") > limit)

"""Near-duplicate classes: BagMinHash signatures of five-word shingles, banded, verified, joined up.

Texts of equal words are one from the start. Each distinct text emits one key for each band. In
each band bucket all members are compared with the bucket's hub, the member that meets most others,
then with the hub of what is still apart from it; in buckets that still hold several classes, the
rest are paired in blocks. Every pair that shares a bucket and is not joined yet is decided by the
exact overlap of the shingle multisets, and the classes are the components of the links. Groups of
equal texts and buckets are joined by salts, so that no such group meets in one task.

Words are white-space separated. A text of fewer than five words is one shingle. Null and empty
texts, and those of white space alone, are in no class but their own row's. Rows are told apart by
doc_id and text: rows equal in both are one document, rows of one doc_id with different texts are
different ones. class_id is the smallest doc_id of the class, and null for rows without a doc_id,
which are in no class. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import bagminhash, rows, segments, streams, words
from vellum.llm.components import components
from vellum.llm.durable import checkpointed, stored
from vellum.llm.mapping import over_texts

COMPONENTS, ROWS, SHINGLE = 125, 5, 5
HUB_ROUNDS = 2
BLOCK = 512
SALTS = 16


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in segments.slices(batch["text"].tolist()):
            b = batch.iloc[part]
            h, n = words.hashed(b["text"].tolist())
            b, n = b[n > 0], n[n > 0]
            if not len(n):
                continue
            ends = np.cumsum(n)
            whole = [xxhash.xxh3_128_digest(h[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            sig = bagminhash.signatures(*words.shingles(h, n, SHINGLE), COMPONENTS)
            yield pd.DataFrame({"doc": b["doc"], "same": whole, "bands": [*bagminhash.bands(sig, ROWS).view(np.int64)]})


def _multisets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in segments.slices(batch["text"].tolist()):
            b = batch.iloc[part]
            h, n = words.hashed(b["text"].tolist())
            e, k = words.shingles(h, n, SHINGLE)
            ends = np.cumsum(k)
            yield pd.DataFrame({"id": b["id"], "bag": [np.sort((e[x - y : x] >> np.uint64(32)).astype(np.uint32)).tobytes() for x, y in zip(ends.tolist(), k.tolist(), strict=True)]})


def counted(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    return *np.unique(bag, return_counts=True), len(bag)


def common(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int]) -> float:
    """Weighted Jaccard similarity of two counted multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[2] + b[2] - both)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    return common(counted(a), counted(b))


def _verified(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = None
        for (a, _), part, first in streams.runs(batches, ["a", "salt"]):
            if first:
                hub = None
            out = []
            for b, is_hub, bag in zip(part["b"], part["hub"], part["bag"], strict=True):
                bag = np.frombuffer(bag, np.uint32)
                if is_hub == 0:
                    hub = bag
                elif len(bag) >= threshold * len(hub) and len(hub) >= threshold * len(bag) and overlap(hub, bag) >= threshold:
                    out.append((a, b))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _links(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose multisets overlap enough; a's is sent once for each salt, ahead of the others."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = pairs.select("a", "salt").distinct().join(bags.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("hub"), F.col("a").alias("b"), "bag")
    both = hubs.unionByName(pairs.join(bags.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("hub"), "b", "bag"))
    return both.repartition("a", "salt").sortWithinPartitions("a", "salt", "hub", "b").mapInPandas(_verified(threshold), "a bigint, b bigint")


def _near(threshold: float):
    """Links between members of two blocks of a bucket; a pair is decided in the first bucket that both are in, where its multisets already are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, i, j), rows_ in streams.groups(batches, ["key", "i", "j"]):
            bands = np.stack(rows_["bands"].to_list())
            ids, comp, block = (rows_[c].to_numpy() for c in ("id", "component", "block"))
            each = [counted(np.frombuffer(r, np.uint32)) for r in rows_["bag"]]
            size = np.array([n for _, _, n in each])
            length = np.array([len(u) for u, _, _ in each])
            for x in range(len(ids)):
                ok = (comp != comp[x]) & ((ids > ids[x]) if i == j else (block[x] == i) & (block == j))
                to = np.flatnonzero(ok & (size >= threshold * size[x]) & (size[x] >= threshold * size))
                if len(to):
                    first = (bands[to] == bands[x]).argmax(1)
                    to = to[bands[x][first] == key]
                if len(to):
                    own, many, n = each[x]
                    values, counts = np.concatenate([each[y][0] for y in to]), np.concatenate([each[y][1] for y in to])
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    both = np.where(own[at] == values, np.minimum(many[at], counts), 0)
                    both = np.add.reduceat(both, np.cumsum(length[to]) - length[to])
                    to = to[both >= threshold * (n + size[to] - both)]
                if len(to):
                    yield pd.DataFrame({"a": np.minimum(ids[x], ids[to]), "b": np.maximum(ids[x], ids[to])})

    return run


def _salted(df: DataFrame) -> DataFrame:
    """A copy of each row for every salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(column: str):
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _by_key(texts: DataFrame, threshold: float) -> DataFrame:
    """(doc, component: the smallest doc of its class) of rows doc (a key, not null) and text (not null) that have words."""
    sketch = stored(over_texts(texts, _sketch, "doc bigint, same binary, bands array<bigint>").withColumn("salt", _salt("doc")))
    firsts = _salted(sketch.groupBy("same").agg(F.min("doc").alias("id"), F.max("doc").alias("hi")).where("id < hi").drop("hi"))
    of = stored(sketch.select("doc", "same", "salt").join(firsts, ["same", "salt"], "left").select("doc", F.coalesce("id", "doc").alias("id")))
    reps = sketch.join(of.where("doc = id").select("id").distinct(), F.col("doc") == F.col("id")).select("id", "bands").dropDuplicates(["id"])
    keyed = reps.select("id", F.explode("bands").alias("key")).withColumn("salt", _salt("id"))
    shared = _salted(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(keyed.join(shared, ["key", "salt"]))
    degree = members.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    members = stored(members.join(degree, "id").select("key", "salt", "id", "n", "degree"))
    bags = stored(over_texts(texts.join(degree.select(F.col("id").alias("doc")), "doc").select(F.col("doc").alias("id"), "text"), _multisets, "id bigint, bag binary").dropDuplicates(["id"]))
    links = tested = None
    label = members.select("id").distinct().withColumn("component", F.col("id"))
    for turn in range(HUB_ROUNDS + 1):
        now = members.join(label, "id") if turn else members.withColumn("component", F.col("id"))
        hub = F.max(F.struct("degree", -F.col("id"), "component")).alias("hub")
        apart = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), hub).where("lo < hi")
        if turn < HUB_ROUNDS:
            if turn:  # the hub of what is apart from the first hub's class
                apart = now.join(_salted(apart.select("key", F.col("hub.component").alias("not"))), ["key", "salt"]).where("component <> not").groupBy("key").agg(hub)
            hubs = _salted(apart.select("key", (-F.col("hub.col2")).alias("a"), F.col("hub.component").alias("of")))
            pairs = now.join(hubs, ["key", "salt"]).where("component <> of").select("a", F.col("id").alias("b")).distinct()
            if tested is not None:
                # a pair counts as tested either way round
                pairs = pairs.join(tested, ["a", "b"], "left_anti").join(tested.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
            pairs = checkpointed(pairs)
            tested = pairs if tested is None else tested.unionByName(pairs)
            found = _links(pairs, bags, threshold)
        else:
            left = now.join(_salted(apart.select("key")), ["key", "salt"]).join(reps, "id").join(bags, "id")
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            left = left.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
            left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "component", "block", "bands", "bag")
            found = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_near(threshold), "a bigint, b bigint")
        found = checkpointed(found)
        links = found if links is None else links.unionByName(found)
        merged = components(links)
        label = members.select("id").distinct().join(merged, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return of.distinct().join(merged, "id", "left").select("doc", F.coalesce("component", "id").alias("component"))


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, str, DataFrame, bool]:
    """(docs with a key, its name, (doc: that key, component), whether keys differ from ids)."""
    marked, key, mended = rows.keyed(docs)
    texts = marked.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).alias("doc"), "text")
    return marked, key, _by_key(texts, threshold), mended


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) of every row."""
    marked, key, known, mended = _classed(docs.select("doc_id", "text"), threshold)
    own = F.col("doc_id").cast("bigint")
    if mended:
        ids = marked.select(F.col(key).alias("doc"), own.alias("id")).distinct()
        least = known.join(ids, "doc").groupBy("component").agg(F.min("id").alias("id"))
        known = known.join(least, "component").select("doc", F.col("id").alias("component"))
    return marked.join(known, F.col(key) == F.col("doc"), "left").select("doc_id", F.coalesce("component", own).alias("class_id"))


def keep_first(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of each class, of the smallest key in it; of rows equal in doc_id and text any one. Rows without a doc_id stay, and those without words."""
    marked, key, known, _ = _classed(docs, threshold)
    gone = rows.fresh(marked, "gone")
    later = known.where("doc <> component").select(F.col("doc").alias(gone))
    kept = marked.join(later, F.col(key) == F.col(gone), "left_anti")
    again = marked.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias(gone))
    if again.isEmpty():
        return kept.select(*docs.columns)
    # a key on several rows: all but one go, where the text has words
    repeated = kept.join(again, F.col(key) == F.col(gone), "left_semi")
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*$")
    rest = kept.join(again, F.col(key) == F.col(gone), "left_anti")
    return rest.unionByName(repeated.where(~wordless).dropDuplicates([key])).unionByName(repeated.where(wordless)).select(*docs.columns)

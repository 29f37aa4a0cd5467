"""Rows told apart by more than their id, and names for columns of our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with a key column more, its name, whether any key differs from doc_id).

    The key is doc_id where one text has that id. Where several texts share an id, the key is a hash of both from 2^62 on,
    so that rows are equal in key just where they are in id and text (null texts count as empty). Rows without an id have a
    null key. Ids alone are counted for this; docs is joined only if some id is shared.
    """
    name = fresh(docs, "row_key")
    texts = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    shared = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(texts).alias("lo"), F.max(texts).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select(F.col("doc_id").alias(f"{name}_id"))
    if shared.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("bigint")), name, False
    both: Column = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")))
    marked = docs.join(shared, F.col("doc_id") == F.col(f"{name}_id"), "left")
    key = F.when(F.col(f"{name}_id").isNull(), F.col("doc_id").cast("bigint")).otherwise(both.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    return marked.withColumn(name, key).drop(f"{name}_id"), name, True

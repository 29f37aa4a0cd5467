"""From raw documents to packed sequences: toxic documents go, near copies and recurring passages go, personal data gets pseudonyms.

Null and empty texts are kept: they are not toxic, no near copies and hold no passages, and are packed as the end token
alone. Of rows equal in doc_id and text one stays, where they have words; rows of one doc_id with different texts are
different documents, and rows without a doc_id are only scored, pseudonymised and packed. Texts of any length pass whole.
Every stage but the last keeps the columns it is given, whatever their names, as long as doc_id, text and n_chars are among
them; n_chars follows the text. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import minhash, packing, pii, rows, substring, toxicity
from vellum.llm.durable import stored
from vellum.llm.queries import JSON, PII_KEY
from vellum.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, predicted = rows.fresh(docs, "score"), rows.fresh(docs, "predicted")
    return toxicity.score(docs, model, score, predicted).where(F.col(predicted) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_first(docs).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring.cut(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, JSON)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("substring_dedup", cut_passages), ("pii", pseudonyms), ("packing", pack)]

#: Hashing, training and chaining are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents; each one's output but the last's is written once, for the next to read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs

"""Outputs: Markdown files by job, chunk documents as JSON, archive manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("preprocess", "use_layout", "make_searchable", "gen_toc", "preset")


def write_markdown(docs: DataFrame, path: str) -> None:
    """job_id, md: one folder a job, through Spark's commit protocol."""
    docs.select("job_id", "md").write.partitionBy("job_id").mode("overwrite").text(path)


def chunk_documents(jobs: DataFrame, chunks: DataFrame, unit: str) -> DataFrame:
    """job_id, json: each job's envelope and its chunks in order; a job without chunks has an empty list."""
    fields = F.struct("chunk_id", *[c for c in chunks.columns if c not in ("job_id", "chunk_id")])
    listed = chunks.groupBy("job_id").agg(F.array_sort(F.collect_list(fields)).alias("chunks"))
    joined = jobs.join(listed, "job_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(listed.schema["chunks"].dataType)))
    envelope = F.struct(
        "filename", "file_type", F.col("lang").alias("language"), "created_at", F.lit(unit).alias("unit"), F.size("chunks").alias("chunk_count"), F.struct(*FEATURES).alias("features")
    )
    return joined.select("job_id", F.to_json(F.struct(envelope.alias("document"), "chunks"), {"ignoreNullFields": "false"}).alias("json"))


def archive_manifest(jobs: DataFrame, images: DataFrame) -> DataFrame:
    """job_id, place, entry of each job's archive: Markdown, images by name, the searchable PDF if there is one, chunks."""
    fixed = jobs.select("job_id", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit("converted.md").alias("entry")),
        F.struct(F.lit(2).alias("part"), F.when(F.col("searchable"), "searchable.pdf").alias("entry")),
        F.struct(F.lit(3).alias("part"), F.lit("chunks.json").alias("entry")),
    )).alias("e")).select("job_id", "e.*").where("entry IS NOT NULL")
    pictures = images.select("job_id", F.lit(1).alias("part"), F.concat(F.lit("images/"), base_name(F.col("name"))).alias("entry"))
    return fixed.unionByName(pictures.join(jobs.select("job_id"), "job_id", "left_semi"))


def base_name(name: Column) -> Column:
    """What follows the last slash: no path leads out of a folder."""
    return F.regexp_extract(name, r"([^/]*)/*$", 1)

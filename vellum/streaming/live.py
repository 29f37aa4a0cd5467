"""The live view of pages while a job runs, and their checkpoints, as streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGE_ROW = "job_id string, page int, source string, preview string, word_count int, md string, updated_at timestamp"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; one of this machine only in local mode where spark.checkpoint.dir is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vellum-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def page_rows(spark: SparkSession, path: str, schema: str | StructType = PAGE_ROW, fmt: str = "json", **options: str) -> DataFrame:
    """Page rows as files of them arrive."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def shown(rows: DataFrame) -> DataFrame:
    """Rows with something to show; a missing word count is 0."""
    return rows.where(F.col("preview").isNotNull() & (F.col("preview") != "")).withColumn("word_count", F.coalesce("word_count", F.lit(0)))


def first_of_page(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row a page, later ones within the watermark dropped; state is bounded by it."""
    return rows.withWatermark("updated_at", late).dropDuplicatesWithinWatermark(["job_id", "page"])


def append(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Writes all that is there and returns; run again, it goes on behind what it has written."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def page_checkpoints(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Keeps page rows by job; a batch that is replayed after a failure overwrites its own folder, so nothing is doubled."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def restored(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every page that page_checkpoints kept."""
    kept = spark.read.parquet(path)
    columns = [c for c in kept.columns if c not in ("job_id", "page", "batch")]
    last = kept.groupBy("job_id", "page").agg(F.max_by(F.struct(*columns), F.struct("batch", "updated_at")).alias("r"))
    return last.select("job_id", "page", "r.*")

"""Input files: dispatch by extension, CSV cells, images, PDF through a backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted extensions, longest side of a page image, what a CSV field may hold for nothing.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "gif")
KINDS = ("pdf", "docx", "csv", "xls", "xlsx", *IMAGES)
LONGEST_SIDE = 8000
NOTHING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
PAGES = "path string, page int, text string, error string"


def kind(path: Column) -> Column:
    """pdf, docx, csv, xls, xlsx or image; null for what is not accepted."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*IMAGES), "image").when(suffix.isin(*KINDS), suffix)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, kind of the accepted, non-empty files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.select("path", "length", "content", kind(F.col("path")).alias("kind")).where(F.col("kind").isNotNull() & (F.col("length") > 0))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with its header and inferred types; the marks for nothing are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    cleaned = raw.select(*[F.when(~F.col(f"`{c}`").isin(*NOTHING), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    facts = cleaned.agg(*[F.struct(F.count(f"`{c}`").alias("n"), F.count(F.expr(f"try_cast(`{c}` AS bigint)")).alias("whole"), F.count(F.expr(f"try_cast(`{c}` AS double)")).alias("real")).alias(str(i)) for i, c in enumerate(raw.columns)]).head()
    types = ["double" if not f.n or f.real == f.n and f.whole < f.n else "bigint" if f.whole == f.n else "string" for f in facts]
    return cleaned.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(raw.columns, types, strict=True)])


def capped_size(width: Column, height: Column, longest: int = LONGEST_SIDE) -> tuple[Column, Column]:
    """Whole width and height with the longest side within bounds; smaller pictures keep theirs."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.floor(width * scale)).cast("int"), F.greatest(F.lit(1), F.floor(height * scale)).cast("int")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, capped width and height, channels and raw pixels (BGR, by rows)."""
    i = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    w, h = capped_size(F.col("width"), F.col("height"))
    return i.select(F.col("origin").alias("path"), "width", "height", w.alias("to_width"), h.alias("to_height"), "nChannels", "data")


def pdf_pages(documents: DataFrame, backend: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """Text of every page by a given reader of PDF bytes, as none comes with the standard library; page -1 and its error where that fails."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                page = -1
                try:
                    for page, text in enumerate(backend(content)):
                        yield pd.DataFrame([(path, page, text, None)], columns=["path", "page", "text", "error"])
                except Exception as e:  # noqa: BLE001 - the backend's own errors become rows
                    yield pd.DataFrame([(path, -1, None, f"{type(e).__name__}: {e}")], columns=["path", "page", "text", "error"])

    return documents.select("path", "content").mapInPandas(read, PAGES)

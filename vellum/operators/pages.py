"""Operators on pages: how a page is read, tables that stand for pictures, chunks, contents, looking pages up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import markdown as md

#: Text of a digital page is longer; with no more text than this an image may be the page; the share of the
#: page it then covers at least; the share a table covers at most; a dump of the text in a picture.
DIGITAL_TEXT, IMAGE_TEXT, IMAGE_SHARE, TABLE_SHARE = 20, 200, 0.9, 0.95
DUMP_MARK = "----- Start of picture text -----"
DUMP = r"(?s)\*\*==> picture \[[^\]]*\] intentionally omitted <==\*\*\n\n\*\*----- Start of picture text -----\*\*<br>\n.*?\*\*----- End of picture text -----\*\*<br>\n?"


def dominant_image(images: Column, width: Column, height: Column) -> Column:
    """The first of array<struct<x1, y1, x2, y2, ...>> that covers nearly all of the page; null if none does, or the page has no area."""
    span = lambda low, high, most: F.greatest(F.lit(0.0), F.least(high, most) - F.greatest(low, F.lit(0.0)))
    covers = lambda i: span(i["x1"], i["x2"], width) * span(i["y1"], i["y2"], height) >= IMAGE_SHARE * width * height
    return F.when(width * height > 0, F.get(F.filter(images, covers), F.lit(0)))


def page_route(text: Column, image: Column) -> Column:
    """'digital' for pages with text of their own, 'ocr' for scans: little text, or not much and an image that is the page."""
    length = F.length(md.strip(text))
    return F.when((length > DIGITAL_TEXT) & ~((length <= IMAGE_TEXT) & image.isNotNull()), "digital").otherwise("ocr")


def table_candidates(tables: Column, width: Column, height: Column) -> Column:
    """Those of array<struct<rows, cols, x1, y1, x2, y2, md>> with two rows and columns that are not the page's border."""
    share = lambda t: (t["x2"] - t["x1"]) * (t["y2"] - t["y1"]) / (width * height)
    return F.filter(tables, lambda t: (t["rows"] >= 2) & (t["cols"] >= 2) & (share(t) <= TABLE_SHARE))


def with_tables(text: Column, tables: Column) -> Column:
    """Markdown with the dumps of picture text replaced by the tables (array of Markdown), where it has dumps and no table yet."""
    listed = F.array_join(F.transform(tables, md.strip), "\n\n")
    rest = md.strip(F.regexp_replace(text, DUMP, ""))
    put = (md.table_count(text) == 0) & F.contains(text, F.lit(DUMP_MARK)) & (F.size(tables) > 0)
    return F.when(put, F.when(rest == "", listed).otherwise(F.concat(rest, F.lit("\n\n"), listed))).otherwise(text)


def chunks(docs: DataFrame, size: int = 0, overlap: int = 0) -> DataFrame:
    """job_id, chunk_id, source_page or source_section, text, its counters and image targets, in the order of the document.

    docs: job_id, md, label_col. Documents by 'page' are cut at page markers, others at headings; parts without text are left
    out, and long ones cut into windows if `size` is above 0. Nothing is shuffled.
    """
    cut = lambda number, title, text: F.transform(md.windows(text, size, overlap), lambda w: F.struct(number.cast("int").alias("source_page"), title.cast("string").alias("source_section"), w.alias("text")))
    filled = lambda parts: F.filter(parts, lambda p: p["text"] != "")
    by_page = F.flatten(F.transform(filled(md.pages_of(F.col("md"))), lambda p: cut(p["page"] + 1, F.lit(None), p["text"])))
    by_section = F.flatten(F.transform(filled(md.whole_sections(F.col("md"))), lambda p: cut(F.lit(None), p["title"], p["text"])))
    each = docs.select("job_id", F.posexplode(F.when(F.col("label_col") == "page", by_page).otherwise(by_section)).alias("i", "c"))
    texts = each.select("job_id", (F.col("i") + 1).alias("chunk_id"), "c.*").withColumn("plain", md.strip_markdown(F.col("text")))
    stats = md.text_stats(F.col("plain"))
    return texts.select(
        "job_id", "chunk_id", "source_page", "source_section", "text", stats["word_count"].alias("word_count"), stats["char_count"].alias("char_count"),
        md.image_count(F.col("text")).alias("image_count"), md.table_count(F.col("text")).alias("table_count"), md.image_links(F.col("text")).alias("images"),
    )


def looked_up(asked: DataFrame, combined: DataFrame, live: DataFrame, sidecars: DataFrame) -> DataFrame:
    """job_id, page, state, raw, mean, low: a page of the finished document, else of the run; with its confidence if any.

    asked: job_id, page. combined: job_id, md. live: job_id, page, md. sidecars: job_id, page, mean, low. A page that a
    finished document lacks is '', and one that neither has is 'not_ready'.
    """
    pages = combined.select("job_id", F.explode_outer(md.pages_of(F.col("md"))).alias("p")).select("job_id", F.col("p.page").cast("bigint").alias("page"), F.col("p.text").alias("final"))
    done = combined.select("job_id", F.lit(True).alias("done"))
    running = live.select("job_id", "page", md.strip(F.regexp_replace("md", md.PAGE_MARKER, "")).alias("running"))
    found = asked.join(done, "job_id", "left").join(pages, ["job_id", "page"], "left").join(running, ["job_id", "page"], "left").join(sidecars, ["job_id", "page"], "left")
    raw = F.when(F.col("done"), F.coalesce("final", F.lit(""))).otherwise(F.col("running"))
    return found.select("job_id", "page", F.when(raw.isNull(), "not_ready").otherwise("ready").alias("state"), raw.alias("raw"), F.when(raw.isNotNull(), F.col("mean")).alias("mean"), F.when(raw.isNotNull(), F.col("low")).alias("low"))


def checkpointed_pages(texts: DataFrame, rows: DataFrame, schema: str) -> DataFrame:
    """job_id, page, md, row of pages with both a text <n>.md and a row <n>.row.json that can be read; both tables hold job_id, name, text."""
    number = lambda end: F.regexp_extract("name", rf"^([+-]?\d+){end}$", 1).try_cast("bigint").alias("page")
    parsed = rows.select("job_id", number(r"\.row\.json"), read_json(F.col("text"), schema).alias("row")).where("page IS NOT NULL AND row IS NOT NULL")
    return texts.select("job_id", number(r"\.md"), F.col("text").alias("md")).where("page IS NOT NULL").join(parsed, ["job_id", "page"])


def read_json(text: Column, schema: str) -> Column:
    """A struct of a JSON object; null where there is no text or it is broken."""
    parsed = F.from_json(text, f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    return F.get(F.transform(F.array(parsed), lambda p: F.when(p["_broken"].isNull() & (F.trim(text) != ""), p.dropFields("_broken"))), F.lit(0))

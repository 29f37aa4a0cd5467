"""Operators on OCR words: confidence, assembly, table grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.markdown import cell_escape, html_escape

#: Words below are marked as doubtful; gaps in units of the mean height and width.
LOW_CONFIDENCE = 60
ROW_GAP, COLUMN_GAP = 0.6, 1.5


def valid(words: DataFrame) -> DataFrame:
    return words.where((F.trim("text") != "") & (F.col("conf") >= 0))


def confidence(words: DataFrame) -> DataFrame:
    """doc_id, mean_conf (null without words), low_conf_count, n_words.

    The mean is scaled before it is rounded, as SQL does: round(v, 1) goes by the digits of v, which a sum of tenths leaves just
    under a half.
    """
    return words.groupBy("doc_id").agg(
        (F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) * 10) / 10).alias("mean_conf"),
        F.count_if((F.col("conf") >= 0) & (F.col("conf") < LOW_CONFIDENCE)).alias("low_conf_count"),
        F.count_if(F.col("conf") >= 0).alias("n_words"),
    )


def assembled(words: DataFrame, value: str = "text", line_end: str = "\n", between: str = "\n\n", around: tuple[str, str] = ("", "")) -> DataFrame:
    """doc_id, text: words by `ord` joined into lines, lines by number into paragraphs (block, par), those in the order they begin.

    One shuffle, by document, serves all three.
    """
    listed = lambda column, end, order: F.expr(f"listagg({column}, {_quoted(end)}) WITHIN GROUP (ORDER BY {order})")
    lines = words.repartition("doc_id").groupBy("doc_id", "block", "par", "line").agg(listed(value, " ", "ord").alias("l"), F.min("ord").alias("seen"))
    paragraphs = lines.groupBy("doc_id", "block", "par").agg(listed("l", line_end, "line").alias("p"), F.min("seen").alias("seen"))
    whole = paragraphs.withColumn("p", F.concat(F.lit(around[0]), "p", F.lit(around[1])))
    return whole.groupBy("doc_id").agg(listed("p", between, "seen").alias("text"))


def assembled_html(words: DataFrame) -> DataFrame:
    """doc_id, text: escaped words, doubtful ones marked, a <p> a paragraph and a <br> between lines."""
    return assembled(marked_html(words), "html", "<br>", "", ("<p>", "</p>"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\n", "\\n") + "'"


def marked_html(words: DataFrame) -> DataFrame:
    """Words escaped, doubtful ones in a span with their confidence."""
    escaped = html_escape(F.col("text"))
    title = F.concat(F.rint("conf").cast("int").cast("string"), F.lit("% confidence"))
    return words.withColumn("html", F.when(F.col("conf") < LOW_CONFIDENCE, F.concat(F.lit('<span class="lc" title="'), title, F.lit('">'), escaped, F.lit("</span>"))).otherwise(escaped))


def badge(mean) :
    return F.when(mean.isNull(), None).when(mean >= 85, "good").when(mean >= 70, "ok").otherwise("poor")


def rows_of(words: DataFrame) -> DataFrame:
    """words with `row`: a new one where y rises by more than 0.6 mean heights."""
    page = Window.partitionBy("doc_id")
    down = page.orderBy("y", "line", "word")
    gap = F.col("y") - F.lag("y").over(down)
    return words.withColumn("_h", F.avg("height").over(page)).withColumn("_new", F.when(gap > ROW_GAP * F.col("_h"), 1).otherwise(0)).withColumn("row", F.sum("_new").over(down)).drop("_h", "_new")


def columns_of(words: DataFrame) -> DataFrame:
    """doc_id, col, anchor: clusters of x apart by more than 1.5 mean widths, and their mean x."""
    page = Window.partitionBy("doc_id")
    across = page.orderBy("x", "line", "word")
    gap = F.col("x") - F.lag("x").over(across)
    cut = words.withColumn("_w", F.avg("width").over(page)).withColumn("_new", F.when(gap > COLUMN_GAP * F.col("_w"), 1).otherwise(0)).withColumn("col", F.sum("_new").over(across))
    return cut.groupBy("doc_id", "col").agg(F.avg("x").alias("anchor"))


def _placed(words: DataFrame) -> DataFrame:
    """words with `row`, `own`: their cluster of x, and `col`: the column of the nearest anchor, the first of equals.

    Clusters and anchors rise together, so the nearest anchor is that of the own cluster or of a neighbour. One shuffle, by page.
    """
    page = Window.partitionBy("doc_id")
    down, across = page.orderBy("y", "line", "word"), page.orderBy("x", "line", "word")
    fell, went = F.col("y") - F.lag("y").over(down), F.col("x") - F.lag("x").over(across)
    sized = words.where("doc_id IS NOT NULL").withColumns({"_h": F.avg("height").over(page), "_w": F.avg("width").over(page)})
    rows = sized.withColumn("_new", F.when(fell > ROW_GAP * F.col("_h"), 1).otherwise(0)).withColumn("row", F.sum("_new").over(down))
    own = rows.withColumn("_new", F.when(went > COLUMN_GAP * F.col("_w"), 1).otherwise(0)).withColumn("own", F.sum("_new").over(across))
    beside = lambda n: page.orderBy("own").rangeBetween(n, n)
    at = own.withColumn("_at", F.avg("x").over(beside(0)))
    at = at.withColumns({"_before": F.max("_at").over(beside(-1)), "_behind": F.max("_at").over(beside(1))})
    far = lambda name: F.abs(F.col(name) - F.col("x"))
    near = F.when(far("_before") <= F.least(far("_at"), far("_behind")), F.col("own") - 1).when(far("_behind") < far("_at"), F.col("own") + 1).otherwise(F.col("own"))
    return at.withColumn("col", near).drop("_h", "_w", "_new", "_at", "_before", "_behind")


def _cells(words: DataFrame, *more: Column) -> DataFrame:
    return _placed(words).groupBy("doc_id", "row", "col").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY x, line, word)").alias("text"), *more)


def cells(words: DataFrame) -> DataFrame:
    """doc_id, row, col, text: each word in the column of the nearest anchor, the first of equals; words in x order."""
    return _cells(words)


def table_markdown(words: DataFrame) -> DataFrame:
    """doc_id, md: words as a pipe table, its first row the header; null under four words, two rows or two columns."""
    grid = _cells(words, F.max("own").alias("last"), F.count("*").alias("n")).withColumn("text", cell_escape(F.col("text")))
    rows = grid.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("found"), F.max("last").alias("last"), F.sum("n").alias("n"))
    rows = rows.withColumn("n_cols", (F.max("last").over(Window.partitionBy("doc_id")) + 1).cast("int"))
    filled = F.transform(F.sequence(F.lit(0).cast("bigint"), (F.col("n_cols") - 1).cast("bigint")), lambda c: F.coalesce(F.element_at("found", c), F.lit("")))
    rule = F.concat(F.lit("\n| "), F.array_join(F.array_repeat(F.lit("---"), F.col("n_cols")), " | "), F.lit(" |"))
    line = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"), F.when(F.col("row") == 0, rule).otherwise(""))
    tables = rows.withColumn("line", line).groupBy("doc_id").agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY row)").alias("md"), F.count("*").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.sum("n").alias("n_words"))
    return tables.select("doc_id", F.when((F.col("n_words") >= 4) & (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2), F.col("md")).alias("md"))

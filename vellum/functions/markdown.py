"""Column functions on Markdown text. Patterns agree with Python's `re` under the flags (?dmU)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as an image, a table row, a separator row, a formula, a marker, a heading.
SPACE = r"[\s\x1c-\x1f]"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
IMAGE_TARGET = r"!\[[^\]]*\]\(([^)]+)\)"
TABLE_ROW = rf"^{SPACE}*\|.*\|{SPACE}*$"
TABLE_SEPARATOR = rf"^{SPACE}*\|?[\s\x1c-\x1f:-]+\|[\s\x1c-\x1f:|-]+$"
SYNTAX = r"[#>*_`~-]"
BLOCK_FORMULA = r"(?s)\$\$.*?\$\$"
INLINE_FORMULA = r"(?<!\$)\$[^\$\n]+\$(?!\$)"
PAGE_MARKER = rf"(?U)<!--{SPACE}*page{SPACE}+(\d+){SPACE}*-->"
HEADING = rf"(?dmU)^(#{{1,6}}){SPACE}+(.*)$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Separates parts; no Unicode text carries it.
SENTINEL = ""


def strip(text: Column) -> Column:
    """Like Python's str.strip()."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def strip_markdown(md: Column) -> Column:
    """Without image links, table rows and Markdown punctuation."""
    no_images = F.regexp_replace(md, IMAGE, "")
    no_tables = F.regexp_replace(no_images, rf"(?dmU){TABLE_ROW}", "")
    return F.regexp_replace(no_tables, SYNTAX, "")


def text_stats(plain: Column) -> dict[str, Column]:
    """Counters of text that strip_markdown has been through."""
    return {
        "word_count": F.regexp_count(plain, F.lit(rf"(?U)[^\s\x1c-\x1f]+")),
        "char_count": F.length(plain),
        "char_count_no_spaces": F.length(F.regexp_replace(plain, rf"(?U){SPACE}", "")),
    }


def table_count(md: Column) -> Column:
    """Header rows directly above separator rows."""
    lines = F.split(md, LINE_END)

    def pairs(ls: Column) -> Column:
        above = F.transform(ls, lambda x: x.rlike(rf"(?dU){TABLE_ROW}"))
        below = F.transform(ls, lambda x: x.rlike(rf"(?dU){TABLE_SEPARATOR}"))
        return F.size(F.filter(F.zip_with(above, F.slice(below, 2, F.size(ls)), lambda a, b: a & F.coalesce(b, F.lit(False))), lambda x: x))

    return F.get(F.transform(F.array(lines), pairs), F.lit(0))


def formula_count(md: Column) -> Column:
    return F.regexp_count(md, F.lit(BLOCK_FORMULA)) + F.regexp_count(F.regexp_replace(md, BLOCK_FORMULA, ""), F.lit(INLINE_FORMULA))


def image_count(md: Column) -> Column:
    return F.regexp_count(md, F.lit(IMAGE))


def image_links(md: Column) -> Column:
    return F.regexp_extract_all(md, F.lit(IMAGE_TARGET), F.lit(1))


def page_parts(md: Column) -> Column:
    """array<struct<page, text>> behind page markers; what stands before the first is dropped, the last of a number wins."""
    marked = F.split(F.regexp_replace(md, PAGE_MARKER, f"{SENTINEL}$1{SENTINEL}"), SENTINEL)
    ix = F.sequence(F.lit(1), F.greatest(F.size(marked) - 1, F.lit(1)), F.lit(2))
    parts = F.transform(ix, lambda i: F.struct(F.get(marked, i).cast("int").alias("page"), strip(F.get(marked, i + 1)).alias("text")))
    return F.filter(parts, lambda p: p["page"].isNotNull())


def section_parts(md: Column) -> Column:
    """array<struct<ix, level, title, text>> by headings; an introduction is 'Document', a blank title 'Section n'."""
    pieces = F.split(F.regexp_replace(md, HEADING, f"{SENTINEL}$0"), SENTINEL)
    title = lambda p: strip(F.regexp_extract(p, HEADING, 2))
    headed = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda p, i: F.struct(
            (i + 1).cast("int").alias("ix"),
            F.length(F.regexp_extract(p, HEADING, 1)).alias("level"),
            F.when(title(p) == "", F.concat(F.lit("Section "), (i + 1).cast("string"))).otherwise(title(p)).alias("title"),
            strip(F.regexp_replace(p, r"(?dmU)\A" + HEADING.removeprefix("(?dmU)^"), "")).alias("text"),
        ),
    )
    intro = F.struct(F.lit(0).alias("ix"), F.lit(0).alias("level"), F.lit("Document").alias("title"), strip(F.get(pieces, F.lit(0))).alias("text"))
    has_intro = (strip(F.get(pieces, F.lit(0))) != "") | (F.size(pieces) == 1)
    return F.when(has_intro, F.concat(F.array(intro), headed)).otherwise(headed)


def pages_of(md: Column) -> Column:
    """array<struct<page, text>>, each number once, its last text, in the order of numbers."""
    parts = page_parts(md)
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct(p["page"].alias("page"), (-i).alias("late"), p["text"].alias("text"))))

    def once(rs: Column) -> Column:
        kept = F.filter(rs, lambda r, i: (i == 0) | (F.get(rs, i - 1)["page"] != r["page"]))
        return F.transform(kept, lambda r: F.struct(r["page"].alias("page"), r["text"].alias("text")))

    return F.get(F.transform(F.array(ranked), once), F.lit(0))


def whole_sections(md: Column) -> Column:
    """array<struct<title, text>>: the introduction as 'Document', if there is one, then each section with its heading line."""
    pieces = F.split(F.regexp_replace(md, HEADING, f"{SENTINEL}$0"), SENTINEL)
    title = lambda p: strip(F.regexp_extract(p, HEADING, 2))
    part = lambda t, x: F.struct(t.alias("title"), strip(x).alias("text"))
    headed = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p, i: part(F.when(title(p) == "", F.concat(F.lit("Section "), (i + 1).cast("string"))).otherwise(title(p)), p))
    intro = part(F.lit("Document"), F.get(pieces, F.lit(0)))
    return F.when((intro["text"] != "") | (F.size(pieces) == 1), F.concat(F.array(intro), headed)).otherwise(headed)


def with_contents(md: Column, deepest: int = 3) -> Column:
    """Markdown behind a linked list of its headings; without such headings as it is. Equal anchors are numbered."""
    levels, titles = (F.regexp_extract_all(md, F.lit(HEADING), F.lit(i)) for i in (1, 2))
    each = F.zip_with(levels, titles, lambda a, b: F.struct(F.length(a).alias("level"), strip(b).alias("title")))
    heads = F.filter(each, lambda h: (h["level"] <= deepest) & (h["title"] != ""))
    slugs = F.transform(heads, lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title"), slug(h["title"]).alias("base")))

    def listed(hs: Column) -> Column:
        top = F.array_min(F.transform(hs, lambda h: h["level"]))
        before = lambda h, i: F.size(F.filter(F.slice(hs, F.lit(1), i), lambda g: g["base"] == h["base"]))
        anchor = lambda h, n: F.concat(h["base"], F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(""))
        line = lambda h, i: F.concat(F.repeat(F.lit("  "), h["level"] - top), F.lit("- ["), h["title"], F.lit("](#"), anchor(h, before(h, i)), F.lit(")"))
        return F.when(F.size(hs) > 0, F.concat(F.lit("## Contents\n\n"), F.array_join(F.transform(hs, line), "\n"), F.lit("\n\n"), md)).otherwise(md)

    return F.get(F.transform(F.array(slugs), listed), F.lit(0))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of `size` characters, each `overlap` into the one before; the text alone if it fits or size is not positive."""
    step = max(1, size - overlap)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step)), lambda i: F.substring(text, i + 1, F.lit(size)))
    return F.when((F.lit(size) <= 0) | (F.length(text) <= size), F.array(text)).otherwise(cut)


def slug(title: Column, separator: str = "-") -> Column:
    """A lower-case anchor of letters, digits and separators; marks are dropped. Text is taken to be composed (NFC)."""
    kept = F.regexp_replace(F.lower(strip(title)), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", "")
    joined = F.regexp_replace(kept, rf"(?U){SPACE}+", separator)
    return F.when(joined == "", "section").otherwise(joined)


def relative_images(md: Column) -> Column:
    """Image targets as images/<file name>."""
    return F.regexp_replace(md, r"!\[([^\]]*)\]\((?:[^)]*[/\\])?([^)/\\]+)[/\\]*\)", r"![$1](images/$2)")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cell_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def page(number: Column, text: Column) -> Column:
    """A page's text behind its marker."""
    return F.concat(F.lit("<!-- page "), number.cast("string"), F.lit(" -->\n\n"), text)


def skipped(number: Column) -> Column:
    """What stands for a page that was given up."""
    return F.concat(F.lit("*[Page "), (number + 1).cast("string"), F.lit(" could not be processed and was skipped.]*"))


def title_of(column: Column) -> Column:
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))


def cells_to_tables(cells: DataFrame, *by: str) -> DataFrame:
    """by, md: pipe tables of (by, row, col, value), row 0 the header; numbers stand right, other columns left, all padded.

    Empty cells may be left out. A header without rows gives *No data*.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    number = F.bool_and(F.when((F.col("row") > 0) & (value != ""), F.col("value").try_cast("double").isNotNull())).alias("number")
    width = F.max(F.length(value) + F.when(F.col("row") == 0, 2).otherwise(0)).alias("width")
    columns = cells.groupBy(*by, "col").agg(number, width, F.max(F.when(F.col("row") == 0, value)).alias("head"))
    shape = columns.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("col", "number", "width", "head"))).alias("shape"))
    rows = cells.where("row > 0").groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", value.alias("value")))).alias("found"))
    padded = lambda c, v: F.when(c["number"], F.lpad(v, c["width"], F.lit(" "))).otherwise(F.rpad(v, c["width"], F.lit(" ")))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    body = rows.join(shape, list(by)).withColumn("line", line(F.transform("shape", lambda c: padded(c, F.coalesce(F.element_at("found", c["col"]), F.lit(""))))))
    lines = body.groupBy(*by).agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY row)").alias("body"))
    rule = F.transform("shape", lambda c: F.when(c["number"], F.concat(F.repeat(F.lit("-"), c["width"] + 1), F.lit(":"))).otherwise(F.concat(F.lit(":"), F.repeat(F.lit("-"), c["width"] + 1))))
    head = F.concat(line(F.transform("shape", lambda c: padded(c, F.coalesce(c["head"], F.lit(""))))), F.lit("\n|"), F.array_join(rule, "|"), F.lit("|\n"))
    return shape.join(lines, list(by), "left").select(*by, F.when(F.col("body").isNull(), "*No data*").otherwise(F.concat(head, "body")).alias("md"))

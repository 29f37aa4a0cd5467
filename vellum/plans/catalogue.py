"""Every query on the reference tables, with the SQL that checks it.

Queries on documents run on Markdown derived from them (`fixtures.md_docs`) or on synthetic words
(`fixtures.ocr_words`); those on jobs, pages and boxes run on stand-ins among the other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import markdown as md
from vellum.operators import jobs, layout, ocr, pages
from vellum.plans import conversion, documents  # noqa: F401 - enter their queries
from vellum.plans.fixtures import MD_DUCK, WORDS_DUCK, md_docs, ocr_words, table
from vellum.plans.registry import QUERIES, SQL, big, query

M = f"WITH m AS ({MD_DUCK}) "
W = f"WITH w AS ({WORDS_DUCK}) "
#: The Markdown rules as DuckDB writes them.
PLAIN = r"regexp_replace(regexp_replace(regexp_replace({0}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?m)^\s*\|.*\|\s*$', '', 'g'), '[#>*_`~-]', '', 'g')"
STATS = r"len(regexp_extract_all(plain, '\S+')) AS word_count, length(plain) AS char_count, length(regexp_replace(plain, '\s', '', 'g')) AS char_count_no_spaces"
IMAGES = r"len(regexp_extract_all({0}, '!\[[^\]]*\]\([^)]*\)'))"
NO_BLOCKS = r"regexp_replace({0}, '(?s)\$\$.*?\$\$', '', 'g')"
FORMULAS = r"len(regexp_extract_all({0}, '(?s)\$\$.*?\$\$')) + len(regexp_extract_all(regexp_replace(" + NO_BLOCKS + r", '\${{2,}}', chr(1), 'g'), '\$[^\$\n\x01]+\$'))"
TABLES = r"len(list_filter(range(1, len(string_split({0}, chr(10)))), lambda i: regexp_matches(string_split({0}, chr(10))[i], '^\s*\|.*\|\s*$') AND regexp_matches(string_split({0}, chr(10))[i + 1], '^\s*\|?[\s:-]+\|[\s:|-]+$')))"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _counted(docs: DataFrame, text: str) -> DataFrame:
    """docs with `plain` once, so that no counter repeats its patterns."""
    return docs.withColumn("plain", md.strip_markdown(F.col(text)))


@query(f"SELECT doc_id, {STATS} FROM (SELECT doc_id, {PLAIN.format('text')} AS plain FROM documents) t")
def text_stats(spark, d):
    return _counted(table(spark, d, "documents"), "text").select("doc_id", *big(**md.text_stats(F.col("plain"))))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(char_count) AS BIGINT) AS chars FROM (SELECT lang, {STATS} FROM (SELECT lang, {PLAIN.format('text')} AS plain FROM documents) t) u GROUP BY lang")
def text_stats_by_lang(spark, d):
    s = md.text_stats(F.col("plain"))
    return _counted(table(spark, d, "documents"), "text").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(s["word_count"]).alias("words"), F.sum(s["char_count"]).alias("chars"))


def _md_stats(docs: DataFrame) -> DataFrame:
    counters = big(**md.text_stats(F.col("plain")), image_count=md.image_count(F.col("md")), table_count=md.table_count(F.col("md")), formula_count=md.formula_count(F.col("md")))
    return _counted(docs, "md").select("doc_id", *counters)


MD_STATS = f"SELECT doc_id, {STATS}, {IMAGES.format('md')} AS image_count, {TABLES.format('md')} AS table_count, {FORMULAS.format('md')} AS formula_count FROM (SELECT doc_id, md, {PLAIN.format('md')} AS plain FROM m) t"


@query(M + MD_STATS)
def md_stats(spark, d):
    return _md_stats(md_docs(spark, d))


@query(M + f"SELECT doc_id, CAST({TABLES.format('md')} AS BIGINT) AS tables FROM m")
def table_count(spark, d):
    return md_docs(spark, d).select("doc_id", *big(tables=md.table_count(F.col("md"))))


@query(M + f"SELECT doc_id, CAST({FORMULAS.format('md')} AS BIGINT) AS formulas FROM m")
def formula_count(spark, d):
    return md_docs(spark, d).select("doc_id", *big(formulas=md.formula_count(F.col("md"))))


@query(M + r"SELECT doc_id, unnest(regexp_extract_all(md, '!\[[^\]]*\]\(([^)]+)\)', 1)) AS image FROM m")
def image_links(spark, d):
    return md_docs(spark, d).select("doc_id", F.explode(md.image_links(F.col("md"))).alias("image"))


@query(M + "SELECT CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(char_count) AS BIGINT) AS chars, CAST(sum(image_count) AS BIGINT) AS images, CAST(sum(table_count) AS BIGINT) AS tables, CAST(sum(formula_count) AS BIGINT) AS formulas FROM (" + MD_STATS + ") t")
def doc_totals(spark, d):
    return _md_stats(md_docs(spark, d)).agg(*[F.coalesce(F.sum(f"{a}_count"), F.lit(0)).alias(b) for a, b in (("word", "words"), ("char", "chars"), ("image", "images"), ("table", "tables"), ("formula", "formulas"))])


@query("SELECT coalesce(lang, 'TOTAL') AS label, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang)")
def totals_rollup(spark, d):
    return table(spark, d, "documents").rollup("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).select(F.when(F.col("lang").isNull(), "TOTAL").otherwise(F.col("lang")).alias("label"), "docs", "chars")


#: Page numbers repeat, so that the last of a number counts.
REPEATED = ", r AS (SELECT doc_id, regexp_replace(md, '<!-- page [4-9] -->', '<!-- page 2 -->', 'g') AS md FROM m)"
PAGES = M + REPEATED + r", s AS (SELECT doc_id, string_split(regexp_replace(md, '<!--\s*page\s+(\d+)\s*-->', chr(2) || '\1' || chr(2), 'g'), chr(2)) AS p FROM r), every AS (SELECT doc_id, i, CAST(p[2 * i] AS INTEGER) AS page, " + TRIM.format("p[2 * i + 1]") + " AS text FROM (SELECT doc_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM s) t), pages AS (SELECT doc_id, page, arg_max(text, i) AS text FROM every GROUP BY doc_id, page) "


def _repeated(spark, d) -> DataFrame:
    return md_docs(spark, d).withColumn("md", F.regexp_replace("md", "<!-- page [4-9] -->", "<!-- page 2 -->"))


def _pages(spark, d) -> DataFrame:
    return _repeated(spark, d).select("doc_id", F.explode(md.pages_of(F.col("md"))).alias("p")).select("doc_id", "p.page", "p.text")


@query(PAGES + "SELECT doc_id, page, text FROM pages")
def split_pages(spark, d):
    return _pages(spark, d)


@query(PAGES + "SELECT doc_id, string_agg('<!-- page ' || page || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS md FROM pages GROUP BY doc_id")
def pages_join(spark, d):
    joined = F.array_join(F.transform(md.pages_of(F.col("md")), lambda p: md.page(p["page"], p["text"])), "\n\n")
    return _repeated(spark, d).select("doc_id", joined.alias("md")).where("md <> ''")


@query(PAGES + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS chunk_id, page + 1 AS source_page, text, {STATS}, {IMAGES.format('text')} AS image_count FROM (SELECT *, {PLAIN.format('text')} AS plain FROM pages WHERE text <> '') t")
def chunks_page(spark, d):
    from pyspark.sql import Window

    kept = _counted(_pages(spark, d).where("text <> ''"), "text")
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).cast("bigint").alias("chunk_id"), (F.col("page") + 1).alias("source_page"), "text", *big(**md.text_stats(F.col("plain")), image_count=md.image_count(F.col("text"))))


SECTIONS = M + r", s AS (SELECT doc_id, string_split(regexp_replace(md, '(?m)^(#{1,6})\s+(.*)$', chr(2) || '\1' || chr(3) || '\2' || chr(3), 'g'), chr(2)) AS p FROM m), e AS (SELECT doc_id, p, unnest(range(0, len(p))) AS ix FROM s), sections AS (SELECT doc_id, CAST(ix AS INTEGER) AS ix, CASE WHEN ix = 0 THEN 0 ELSE CAST(length(split_part(p[ix + 1], chr(3), 1)) AS INTEGER) END AS level, CASE WHEN ix = 0 THEN 'Document' WHEN trim(split_part(p[ix + 1], chr(3), 2)) = '' THEN 'Section ' || ix ELSE " + TRIM.format("split_part(p[ix + 1], chr(3), 2)") + " END AS title, " + TRIM.format("CASE WHEN ix = 0 THEN p[1] ELSE split_part(p[ix + 1], chr(3), 3) END") + " AS text FROM e WHERE ix > 0 OR trim(p[1], ' ' || chr(10)) <> '' OR len(p) = 1) "


def _sections(spark, d) -> DataFrame:
    return md_docs(spark, d).select("doc_id", F.explode(md.section_parts(F.col("md"))).alias("s")).select("doc_id", "s.ix", "s.level", "s.title", "s.text")


@query(SECTIONS + "SELECT doc_id, ix, level, title, text FROM sections")
def split_sections(spark, d):
    return _sections(spark, d)


SLUG = r"CASE WHEN regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g') = '' THEN 'section' ELSE regexp_replace(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '\s+', '-', 'g') END"


@query(f"SELECT doc_id, {SLUG.format('t')} AS slug FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents) u")
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", md.slug(F.get(F.split("text", "\n"), F.lit(0))).alias("slug"))


TOC = SECTIONS + f", h AS (SELECT doc_id, ix, level, title, {SLUG.format('title')} AS base FROM (SELECT e.doc_id, e.ix, CAST(length(split_part(p[e.ix + 1], chr(3), 1)) AS INTEGER) AS level, {TRIM.format('split_part(p[e.ix + 1], chr(3), 2)')} AS title FROM e) q WHERE ix > 0 AND level <= 3 AND title <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY ix) - 1 AS k, min(level) OVER (PARTITION BY doc_id) AS top FROM h), c AS (SELECT doc_id, '## Contents' || chr(10) || chr(10) || string_agg(repeat('  ', level - top) || '- [' || title || '](#' || base || CASE WHEN k > 0 THEN '_' || k ELSE '' END || ')', chr(10) ORDER BY ix) AS toc FROM n GROUP BY doc_id) SELECT doc_id, coalesce(toc || chr(10) || chr(10), '') || md AS md FROM m LEFT JOIN c USING (doc_id)"


@query(TOC)
def toc(spark, d):
    return md_docs(spark, d).select("doc_id", md.with_contents(F.col("md")).alias("md"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_id, substr(text, CAST(i AS INTEGER) + 1, 500) AS text FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 500 THEN [0] ELSE range(0, length(text), 400) END) AS i FROM documents) t")
def chunks_windowed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(md.windows(F.col("text"), 500, 100)).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("bigint").alias("chunk_id"), "text")


@query(r"SELECT doc_id, regexp_replace(t, '!\[([^\]]*)\]\((?:[^)]*[/\\])?([^)/\\]+)[/\\]*\)', '![\1](images/\2)', 'g') AS md FROM (SELECT doc_id, text || ' ![f](/tmp/x/fig_' || doc_id || '.png)' AS t FROM documents) u")
def image_src_rewrite(spark, d):
    return table(spark, d, "documents").select("doc_id", md.relative_images(F.concat(F.col("text"), F.lit(" ![f](/tmp/x/fig_"), F.col("doc_id").cast("string"), F.lit(".png)"))).alias("md"))


@query(W + "SELECT doc_id, round(avg(CASE WHEN conf >= 0 THEN conf END), 1) AS mean_conf, count(*) FILTER (WHERE conf >= 0 AND conf < 60) AS low_conf_count, count(*) FILTER (WHERE conf >= 0) AS n_words FROM w GROUP BY doc_id")
def conf_page(spark, d):
    return ocr.confidence(ocr_words(spark, d))


@query(W + "SELECT doc_id, CASE WHEN c >= 85 THEN 'good' WHEN c >= 70 THEN 'ok' ELSE 'poor' END AS badge FROM (SELECT doc_id, round(avg(conf), 1) AS c FROM w WHERE conf >= 0 GROUP BY doc_id) t")
def conf_badge(spark, d):
    return ocr.confidence(ocr_words(spark, d)).where("mean_conf IS NOT NULL").select("doc_id", ocr.badge(F.col("mean_conf")).alias("badge"))


ASSEMBLE = "SELECT doc_id, string_agg(p, {2} ORDER BY seen) AS text FROM (SELECT doc_id, min(seen) AS seen, {3} || string_agg(l, {1} ORDER BY line) || {4} AS p FROM (SELECT doc_id, block, par, line, min(ord) AS seen, string_agg({0}, ' ' ORDER BY word) AS l FROM w WHERE conf >= 0 GROUP BY doc_id, block, par, line) t GROUP BY doc_id, block, par) u GROUP BY doc_id"


@query(W + ASSEMBLE.format("text", "chr(10)", "chr(10) || chr(10)", "''", "''"))
def conf_assemble(spark, d):
    return ocr.assembled(ocr.valid(ocr_words(spark, d)))


ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(W + ASSEMBLE.format(f"CASE WHEN conf < 60 THEN '<span class=\"lc\" title=\"' || CAST(round_even(conf, 0) AS INTEGER) || '% confidence\">' || {ESCAPED} || '</span>' ELSE {ESCAPED} END", "'<br>'", "''", "'<p>'", "'</p>'"))
def conf_html(spark, d):
    return ocr.assembled_html(ocr.valid(ocr_words(spark, d)))


GRID = "WITH w AS (SELECT * FROM (" + WORDS_DUCK + ") a WHERE doc_id % 7 = 0 OR true), r0 AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, line, word) AS g, x - lag(x) OVER (PARTITION BY doc_id ORDER BY x, line, word) AS gx, avg(height) OVER (PARTITION BY doc_id) AS h, avg(width) OVER (PARTITION BY doc_id) AS wd FROM w), r AS (SELECT *, sum(CASE WHEN g > 0.6 * h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, line, word) AS row, sum(CASE WHEN gx > 1.5 * wd THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x, line, word) AS col FROM r0) "
GRID = GRID.replace(" WHERE doc_id % 7 = 0 OR true", "")


@query(GRID + "SELECT doc_id, CAST(row AS BIGINT) AS row, count(*) AS n_words FROM r GROUP BY doc_id, row")
def grid_rows(spark, d):
    return ocr.rows_of(ocr_words(spark, d)).groupBy("doc_id", "row").agg(F.count("*").alias("n_words"))


@query(GRID + "SELECT doc_id, CAST(col AS BIGINT) AS col, round(avg(x), 6) AS anchor FROM r GROUP BY doc_id, col")
def grid_columns(spark, d):
    return ocr.columns_of(ocr_words(spark, d)).withColumn("anchor", F.round("anchor", 6))


@query(GRID + ", a AS (SELECT doc_id, list({'col': col, 'x': ax}) AS anchors FROM (SELECT doc_id, CAST(col AS BIGINT) AS col, avg(x) AS ax FROM r GROUP BY doc_id, col) q GROUP BY doc_id), c AS (SELECT r.doc_id, CAST(r.row AS BIGINT) AS row, list_min(list_transform(a.anchors, lambda k: {'d': abs(k.x - r.x), 'col': k.col})).col AS col, r.x, r.line, r.word, r.text FROM r JOIN a USING (doc_id)) SELECT doc_id, row, col, string_agg(text, ' ' ORDER BY x, line, word) AS text FROM c GROUP BY doc_id, row, col")
def grid_cells(spark, d):
    return ocr.cells(ocr_words(spark, d))


def _boxes(spark, d) -> DataFrame:
    c = F.col
    items = table(spark, d, "lineitem")
    label = F.element_at(F.array(*map(F.lit, ("text", "table", "paragraph_title", "image", "formula", "doc_title"))), (F.pmod(c("l_partkey"), F.lit(6)) + 1).cast("int"))
    return items.select(c("l_orderkey").alias("page"), c("l_linenumber").alias("ord"), label.alias("label"), c("l_tax").alias("score"), (1000 * c("l_discount")).alias("x1"), (10 * c("l_quantity")).alias("y1"), (1000 * c("l_discount") + 80).alias("x2"), (10 * c("l_quantity") + 20 + 100 * c("l_tax")).alias("y2"))


BOXES = "WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ord, ['text', 'table', 'paragraph_title', 'image', 'formula', 'doc_title'][l_partkey % 6 + 1] AS label, l_tax AS score, 1000 * l_discount AS x1, 10 * l_quantity AS y1, 1000 * l_discount + 80 AS x2, 10 * l_quantity + 20 + 100 * l_tax AS y2 FROM lineitem) "


@query(BOXES + ", o AS (SELECT *, greatest(8.0, 0.5 * avg(y2 - y1) OVER (PARTITION BY page)) AS band FROM b) SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY round_even(y1 / band, 0), x1, ord) AS place FROM o")
def reading_order(spark, d):
    return layout.in_reading_order(_boxes(spark, d), "page").select("page", "ord", F.col("place").cast("bigint").alias("place"))


@query(BOXES + "SELECT page, count(*) FILTER (WHERE label = 'table') AS tables, count(*) FILTER (WHERE label = 'image') AS figures, count(*) FILTER (WHERE label = 'formula') AS formulas, count(*) FILTER (WHERE label IN ('doc_title', 'paragraph_title')) AS titles FROM b GROUP BY page")
def layout_route(spark, d):
    r = layout.route(F.col("label"))
    return _boxes(spark, d).groupBy("page").agg(F.count_if(r == "table").alias("tables"), F.count_if(r == "figure").alias("figures"), F.count_if(r == "formula").alias("formulas"), F.count_if(r.isin("doc_title", "title")).alias("titles"))


@query()
def nms_dedup(spark, d):
    return layout.without_overlaps(_boxes(spark, d), "page")


@query("SELECT j.user_id AS job_id, coalesce(p.status, 'queued') AS status, CAST(coalesce(e.pages_done, p.done, 0) AS BIGINT) AS done, e.pages_done IS NOT NULL AS has_error FROM (SELECT DISTINCT user_id FROM events) j LEFT JOIN (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS status, arg_max(CAST(floor(value) AS BIGINT), row(ts, event_id)) AS done FROM events WHERE event_type <> 'error' GROUP BY user_id) p USING (user_id) LEFT JOIN (SELECT user_id, max(CAST(floor(value) AS BIGINT)) AS pages_done FROM events WHERE event_type = 'error' GROUP BY user_id) e USING (user_id)")
def status_join(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "job_id")
    whole = F.floor("value").cast("bigint")
    progress = e.where("event_type <> 'error'").select("job_id", F.col("event_type").alias("status"), whole.alias("done"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    errors = e.where("event_type = 'error'").groupBy("job_id").agg(F.max(whole).alias("pages_done"))
    return jobs.status(e.select("job_id").distinct(), progress, errors)


@query("SELECT o_orderkey AS job_id FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 10")
def recent_jobs(spark, d):
    return jobs.recent(table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))).select("job_id")


@query("SELECT job_id FROM (SELECT o_orderkey AS job_id, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) t WHERE n > 10 AND o_orderstatus <> 'P'")
def retention_delete(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), "o_custkey", F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return jobs.expired(o, "o_custkey", F.col("o_orderstatus") == "P").select("job_id")


@query("SELECT job_id, page, CASE WHEN n >= 2 THEN 'skip' ELSE 'plain' END AS plan FROM (SELECT user_id AS job_id, CAST(floor(value) AS BIGINT) % 5 AS page, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL) t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.user_id = t.job_id AND CAST(floor(e.value) AS BIGINT) % 5 = t.page)")
def poison_plan(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), (F.floor("value").cast("bigint") % 5).alias("page"), "event_type")
    return jobs.page_plan(e.where("event_type = 'error'"), e.where("event_type = 'purchase'")).select("job_id", "page", "plan")


@query("SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS page FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_linenumber = l.l_linenumber AND x.l_returnflag = 'R')")
def resume_plan(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("page"), "l_returnflag")
    return pages.join(pages.where("l_returnflag = 'R'").select("job_id", "page"), ["job_id", "page"], "left_anti").select("job_id", "page")


@query("SELECT o_orderkey AS job_id, string_agg(m, chr(10) || chr(10) ORDER BY l_linenumber) AS md, count(*) AS done, greatest(0, least(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 9 ELSE 8 END, 8) - o_custkey % 4) AS total, count(*) < greatest(0, least(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 9 ELSE 8 END, 8) - o_custkey % 4) AS can_resume FROM orders JOIN (SELECT l_orderkey, l_linenumber, max(l_returnflag || l_linestatus) AS m FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey, o_custkey")
def salvage(spark, d):
    c = F.col
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("job_id"), c("l_linenumber").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("md"))
    asked = table(spark, d, "orders").select(
        c("o_orderkey").alias("job_id"), F.when(c("o_orderstatus") != "P", "pdf").otherwise("png").alias("file_type"), (c("o_custkey") % 4).alias("start_page"),
        F.when(c("o_custkey") % 3 > 0, c("o_custkey") % 9).alias("end_page"), F.lit(8).alias("page_count"),
    )
    return jobs.salvaged(asked, lines.groupBy("job_id", "page").agg(F.max("md").alias("md")))


@query("SELECT o_orderkey AS job_id, o_orderstatus <> 'O' AND o_custkey % 20 < o_orderkey % 20 AS can_resume, CASE WHEN o_orderstatus = 'P' THEN 'running' WHEN NOT (o_orderstatus <> 'O' AND o_custkey % 20 < o_orderkey % 20) THEN 'not_resumable' ELSE 'resuming' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'error' ELSE 'crashed' END AS crash FROM orders")
def can_resume(spark, d):
    c = F.col
    ok = jobs.can_resume(F.when(c("o_orderstatus") != "O", "pdf").otherwise("png"), F.lit(True), c("o_custkey") % 20, c("o_orderkey") % 20)
    return table(spark, d, "orders").select(c("o_orderkey").alias("job_id"), ok.alias("can_resume"), jobs.resume_state(F.lit(True), c("o_orderstatus") == "P", ok).alias("state"), jobs.crash_state(c("o_orderkey") % 3, c("o_orderkey") % 3 == 1).alias("crash"))


SPECS = "SELECT p_partkey AS id, a || b || c AS spec FROM (SELECT p_partkey, ['', '0', '3', '7', '49', '60', 'x', '1 ', ' +5', '1_0'][p_partkey % 10 + 1] AS a, ['', '-', '-', ' - ', '--'][p_partkey // 10 % 5 + 1] AS b, ['', '9', '2', '999', 'abc', '1-2', ' 20 '][p_partkey // 50 % 7 + 1] AS c FROM part) t"
RANGE = f"""
WITH s AS ({SPECS}), t AS (SELECT id, spec, trim(spec) AS x, instr(trim(spec), '-') AS dash FROM s),
n AS (SELECT *, CASE WHEN dash = 0 THEN x ELSE substr(x, 1, dash - 1) END AS a, CASE WHEN dash = 0 THEN x ELSE substr(x, dash + 1) END AS b FROM t),
v AS (SELECT *, CASE WHEN spec = '' THEN 1 WHEN dash > 0 AND a = '' THEN 1 WHEN regexp_full_match(a, '\\s*[+-]?\\d+(_\\d+)*\\s*') THEN CAST(replace(trim(a), '_', '') AS BIGINT) END AS low,
  CASE WHEN spec = '' THEN 50 WHEN dash > 0 AND b = '' THEN 50 WHEN regexp_full_match(b, '\\s*[+-]?\\d+(_\\d+)*\\s*') THEN CAST(replace(trim(b), '_', '') AS BIGINT) END AS high FROM n)
SELECT id, spec, coalesce(greatest(1, low) <= least(50, high) AND low IS NOT NULL AND high IS NOT NULL, false) AS valid,
  CASE WHEN low IS NOT NULL AND high IS NOT NULL AND greatest(1, low) <= least(50, high) THEN CAST(greatest(1, low) AS INTEGER) END AS first_page,
  CASE WHEN low IS NOT NULL AND high IS NOT NULL AND greatest(1, low) <= least(50, high) THEN CAST(least(50, high) AS INTEGER) END AS last_page FROM v"""


@query(RANGE)
def page_range(spark, d):
    one = lambda of, by, *values: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("p_partkey") / by) % of + 1).cast("int"))
    spec = F.concat(one(10, 1, "", "0", "3", "7", "49", "60", "x", "1 ", " +5", "1_0"), one(5, 10, "", "-", "-", " - ", "--"), one(7, 50, "", "9", "2", "999", "abc", "1-2", " 20 "))
    first, last, valid = jobs.page_range(F.col("spec"), F.lit(50))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), spec.alias("spec")).select("id", "spec", first.alias("first_page"), last.alias("last_page"), valid.alias("valid"))


#: Text of many lengths, and an image of many sizes on a page of 600 by 800 points.
ROUTED = "SELECT page_id, left(regexp_replace(html, '<[^>]*>', '', 'g'), CAST(page_id * 13 % 400 AS INTEGER)) AS t, 560.0::DOUBLE + page_id % 50 - (page_id % 30 - 10) AS w, 780.0::DOUBLE AS h FROM pages"


@query(f"SELECT page_id, CASE WHEN length({TRIM.format('t')}) > 20 AND NOT (length({TRIM.format('t')}) <= 200 AND greatest(0, least(page_id % 30 - 10 + w, 600) - greatest(0, page_id % 30 - 10)) * h >= 0.9 * 600 * 800) THEN 'digital' ELSE 'ocr' END AS route FROM ({ROUTED}) q")
def page_route(spark, d):
    left = (F.col("page_id") % 30 - 10).cast("double")
    image = F.struct(left.alias("x1"), F.lit(0.0).alias("y1"), (560.0 + F.col("page_id") % 50).alias("x2"), F.lit(780.0).alias("y2"))
    text = F.substring(F.regexp_replace("html", "<[^>]*>", ""), F.lit(1), (F.col("page_id") * 13 % 400).cast("int"))
    return table(spark, d, "pages").select("page_id", pages.page_route(text, pages.dominant_image(F.array(image), F.lit(600.0), F.lit(800.0))).alias("route"))


@query("SELECT o_orderkey AS job_id, printf('%02d_%s', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), regexp_replace('scan.' || o_orderpriority || '.pdf', '\\.[^.]+$', '')) AS folder FROM orders")
def batch_manifest(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.format_string("%02d_%s", n, md.stem(F.concat(F.lit("scan."), "o_orderpriority", F.lit(".pdf")))).alias("folder"))


@query("SELECT c_custkey AS job_id, p.* FROM (SELECT c_custkey, ['standard', 'research', 'policy', 'meeting'][c_custkey % 4 + 1] AS preset FROM customer) c JOIN (VALUES ('standard', false, true, false, false), ('research', true, true, true, false), ('policy', true, true, false, true), ('meeting', true, true, false, true)) p(preset, use_layout, preprocess, make_searchable, gen_toc) USING (preset)")
def preset_expand(spark, d):
    presets = spark.createDataFrame(jobs.PRESETS, "preset string, use_layout boolean, preprocess boolean, make_searchable boolean, gen_toc boolean")
    named = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.element_at(F.array(*[F.lit(p[0]) for p in jobs.PRESETS]), (F.col("c_custkey") % 4 + 1).cast("int")).alias("preset"))
    return named.join(F.broadcast(presets), "preset")  # four rows, fixed


@query("SELECT o_orderkey AS job_id, CASE WHEN o_custkey <= 20 THEN o_custkey WHEN o_custkey <= 200 THEN 20 ELSE 10 END AS cap FROM orders")
def extraction_cap(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), jobs.extraction_cap(F.col("o_custkey")).alias("cap"))


@query("SELECT r.r_name AS sheet, '## ' || r.r_name || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n.n_nationkey || ' | ' || replace(n.n_name, '|', chr(92) || '|') || ' |', chr(10) ORDER BY n.n_nationkey) AS md FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")
def sheet_sections(spark, d):
    cells = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), md.cell_escape(F.col("n_name")), F.lit(" |"))
    body = cells.withColumn("row", row).groupBy(F.col("r_name").alias("sheet")).agg(F.expr("listagg(row, '\\n') WITHIN GROUP (ORDER BY n_nationkey)").alias("rows"))
    return body.select("sheet", F.concat(F.lit("## "), "sheet", F.lit("\n\n| n_nationkey | n_name |\n|---|---|\n"), "rows").alias("md"))


@query("SELECT page_id, word_count FROM (SELECT page_id, left(html, 200) AS preview, coalesce(CASE WHEN page_id % 3 > 0 THEN len(string_split(html, ' ')) END, 0) AS word_count FROM pages) t WHERE preview <> ''")
def compare_list(spark, d):
    p = table(spark, d, "pages").select("page_id", F.substring("html", 1, 200).alias("preview"), F.when(F.col("page_id") % 3 > 0, F.size(F.split("html", " "))).alias("n"))
    return p.where(F.col("preview").isNotNull() & (F.col("preview") != "")).select("page_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("word_count"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '(?i)<li[ >]')) AS items, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS titles FROM pages")
def html_structure(spark, d):
    return table(spark, d, "pages").select("page_id", *big(items=F.regexp_count("html", F.lit("(?i)<li[ >]")), titles=F.regexp_count("html", F.lit("(?i)<h1[ >]"))))


documents.enter()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Queries on whole documents, pages and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import markdown as md
from vellum.operators import jobs, layout, pages
from vellum.plans.fixtures import MD_DUCK, md_docs, table
from vellum.plans.registry import big, query

#: Boxes with what was read in them, on pages of 1,000 by 520 points.
READ = """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ord, ['text', 'table', 'paragraph_title', 'image', 'formula', 'doc_title', 'formula_number'][l_partkey % 7 + 1] AS label,
  l_partkey * 7 % 970 AS x1, l_partkey * 13 % 515 AS y1, l_partkey * 7 % 970 + l_suppkey % 90 AS x2, l_partkey * 13 % 515 + 20 + l_partkey % 9 AS y2,
  CASE WHEN l_partkey % 11 > 0 THEN ' region ' || l_partkey || ' ' ELSE '  ' END AS text, CASE WHEN l_partkey % 5 = 0 THEN '| t' || l_partkey || ' |' END AS t, CASE WHEN l_partkey % 3 = 0 THEN '| g' || l_partkey || ' |' END AS g FROM lineitem),
  o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y1 / greatest(8.0, 0.5 * h), 0), x1, ord) AS place FROM (SELECT *, avg(y2 - y1) OVER (PARTITION BY page) AS h FROM b) q),
  c AS (SELECT *, nullif(trim(text), '') AS read, coalesce(t, g) AS grid, CASE WHEN label = 'image' THEN row_number() OVER (PARTITION BY page, label ORDER BY place) END AS fig FROM o
    WHERE least(1000, round_even(x2, 0)) - least(1000, greatest(0, round_even(x1, 0))) >= 4 AND least(520, round_even(y2, 0)) - least(520, greatest(0, round_even(y1, 0))) >= 4),
  p AS (SELECT *, CASE WHEN label = 'table' THEN coalesce(grid, read) WHEN label = 'image' THEN printf('![](images/page_%04d_fig_%d.png)', page, fig) WHEN label = 'doc_title' THEN '# ' || read WHEN label = 'paragraph_title' THEN '## ' || read ELSE read END AS part FROM c)
SELECT page, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY place), '') AS md, count(*) FILTER (WHERE label = 'table' AND grid IS NOT NULL) AS table_count, count(*) FILTER (WHERE label = 'image') AS image_count,
  count(*) FILTER (WHERE label LIKE 'formula%' AND part IS NOT NULL) AS formula_count FROM p GROUP BY page"""


@query(READ)
def layout_page(spark, d):
    c = F.col
    label = F.element_at(F.array(*map(F.lit, ("text", "table", "paragraph_title", "image", "formula", "doc_title", "formula_number"))), (c("l_partkey") % 7 + 1).cast("int"))
    key = c("l_partkey").cast("string")
    boxes = table(spark, d, "lineitem").select(
        c("l_orderkey").alias("page"), c("l_linenumber").alias("ord"), label.alias("label"), (c("l_partkey") * 7 % 970).alias("x1"), (c("l_partkey") * 13 % 515).alias("y1"),
        (c("l_partkey") * 7 % 970 + c("l_suppkey") % 90).alias("x2"), (c("l_partkey") * 13 % 515 + 20 + c("l_partkey") % 9).alias("y2"),
        F.when(c("l_partkey") % 11 > 0, F.concat(F.lit(" region "), key, F.lit(" "))).otherwise("  ").alias("text"),
        F.when(c("l_partkey") % 5 == 0, F.concat(F.lit("| t"), key, F.lit(" |"))).alias("table"), F.when(c("l_partkey") % 3 == 0, F.concat(F.lit("| g"), key, F.lit(" |"))).alias("grid"),
        F.lit(1000).alias("width"), F.lit(520).alias("height"),
    )
    return layout.page_markdown(boxes, "page")


DUMPED = "'**==> picture [1 x 2] intentionally omitted <==**' || chr(10) || chr(10) || '**----- Start of picture text -----**<br>' || chr(10) || 'a<br>b' || chr(10) || '**----- End of picture text -----**<br>' || chr(10)"


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 4 > 0 AND p_size * 30 <= 0.95 * 1400 AND p_partkey % 2 = 0
  THEN CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || chr(10) || chr(10) END || '| ' || p_brand || ' |' || chr(10) || '|---|'
  ELSE CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || chr(10) END || CASE WHEN p_partkey % 3 > 0 THEN {DUMPED} ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN '| a | b |' || chr(10) || '|---|---|' ELSE '' END END AS md FROM part""")
def picture_tables(spark, d):
    c = F.col
    dump = "**==> picture [1 x 2] intentionally omitted <==**\n\n**----- Start of picture text -----**<br>\na<br>b\n**----- End of picture text -----**<br>\n"
    k = c("p_partkey")
    text = F.concat(
        F.when(k % 5 == 0, "").otherwise(F.concat("p_name", F.lit("\n"))), F.when(k % 3 > 0, dump).otherwise(""), F.when(k % 3 == 2, "| a | b |\n|---|---|").otherwise(""),
    )
    found = F.struct(
        F.when(k % 4 > 0, 2).otherwise(1).alias("rows"), F.when(k % 2 == 0, 3).otherwise(1).alias("cols"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"),
        c("p_size").cast("double").alias("x2"), F.lit(30.0).alias("y2"), F.concat(F.lit(" | "), "p_brand", F.lit(" |\n|---| ")).alias("md"),
    )
    kept = pages.table_candidates(F.array(found), F.lit(1400.0), F.lit(1.0))
    return table(spark, d, "part").select("p_partkey", pages.with_tables(text, F.transform(kept, lambda t: t["md"])).alias("md"))


def _chunk_sql(parts: str, key: str, source: str) -> str:
    from vellum.plans.catalogue import IMAGES, PLAIN, STATS, TABLES

    return f"""{parts}, w AS (SELECT doc_id, {key} AS k, {source}, unnest(CASE WHEN length(text) <= 600 THEN [0] ELSE range(0, length(text), 500) END) AS i, text AS whole FROM parts WHERE text <> ''),
  x AS (SELECT doc_id, source_page, source_section, k, i, substr(whole, CAST(i AS INTEGER) + 1, 600) AS text FROM w)
SELECT doc_id AS job_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS chunk_id, source_page, source_section, text, {STATS.replace(', length(regexp_replace(plain, ' + chr(39) + chr(92) + 's' + chr(39) + ", '', 'g')) AS char_count_no_spaces", '')},
  {IMAGES.format('text')} AS image_count, {TABLES.format('text')} AS table_count, array_to_string(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), ' ') AS images FROM (SELECT *, {PLAIN.format('text')} AS plain FROM x) y"""


def _chunked(docs):
    out = pages.chunks(docs, 600, 100)
    return out.select("job_id", "source_page", "source_section", "text", *big(**{n: F.col(n) for n in ("chunk_id", "word_count", "char_count", "image_count", "table_count")}), F.array_join("images", " ").alias("images"))


def chunk_documents_page(spark, d):
    return _chunked(md_docs(spark, d).select(F.col("doc_id").alias("job_id"), "md", F.lit("page").alias("label_col")))


def chunk_documents_section(spark, d):
    return _chunked(md_docs(spark, d).select(F.col("doc_id").alias("job_id"), "md", F.lit("section").alias("label_col")))


def enter() -> None:
    """Enters the queries whose SQL uses the catalogue's."""
    from vellum.plans.catalogue import M, TRIM

    split = r"string_split(regexp_replace(md, '<!--\s*page\s+(\d+)\s*-->', chr(2) || '\1' || chr(2), 'g'), chr(2))"
    by_page = M + f", s AS (SELECT doc_id, {split} AS p FROM m), parts AS (SELECT doc_id, CAST(p[2 * i] AS INTEGER) AS page, {TRIM.format('p[2 * i + 1]')} AS text FROM (SELECT doc_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM s) t)"
    query(_chunk_sql(by_page, "page", "page + 1 AS source_page, CAST(NULL AS VARCHAR) AS source_section"))(chunk_documents_page)
    heads = r"string_split(regexp_replace(md, '(?m)^(#{1,6})\s+(.*)$', chr(2) || '\0', 'g'), chr(2))"
    title = TRIM.format(r"regexp_extract(x, '(?m)^(#{1,6})\s+(.*)$', 2)")
    by_head = M + f", s AS (SELECT doc_id, {heads} AS p FROM m), e AS (SELECT doc_id, unnest(range(0, len(p))) AS k, unnest(p) AS x FROM s), parts AS (SELECT doc_id, k, CASE WHEN k = 0 THEN 'Document' WHEN {title} = '' THEN 'Section ' || k ELSE {title} END AS section, {TRIM.format('x')} AS text FROM e)"
    query(_chunk_sql(by_head, "k", "CAST(NULL AS INTEGER) AS source_page, section AS source_section"))(chunk_documents_section)


@query("""WITH f AS (SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS page, max(l_returnflag) AS r, max(l_linestatus) AS s FROM lineitem GROUP BY ALL)
  SELECT job_id, page, 'page ' || page || s AS md, CAST(page * 10 AS INTEGER) AS words FROM f WHERE r <> 'R' AND page <> 3 AND s <> 'O'""")
def checkpoint_join(spark, d):
    """Texts of all pages but those with R; rows of all but page 3, broken where the status is O; names that are no numbers besides."""
    f = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page")).agg(F.max("l_returnflag").alias("r"), F.max("l_linestatus").alias("s"))
    texts = f.where("r <> 'R'").select("job_id", F.format_string("%d.md", "page").alias("name"), F.format_string("page %d%s", "page", "s").alias("text"))
    texts = texts.unionByName(f.where("page = 1").select("job_id", F.lit("notes.md").alias("name"), F.lit("n").alias("text")))
    rows = f.where("page <> 3").select("job_id", F.format_string("%d.row.json", "page").alias("name"), F.when(F.col("s") == "O", '{"page": 1, "word_c').otherwise(F.format_string('{"page": %d, "word_count": %d}', "page", F.col("page") * 10)).alias("text"))
    found = pages.checkpointed_pages(texts, rows.unionByName(f.where("page = 1").select("job_id", F.lit("x.row.json").alias("name"), F.lit("{}").alias("text"))), "page int, word_count int")
    return found.select("job_id", "page", "md", F.col("row.word_count").alias("words"))


@query(f"""WITH m AS ({MD_DUCK}), done AS (SELECT doc_id, md FROM m WHERE doc_id % 3 > 0), a AS (SELECT doc_id, unnest([0, 1, 5]) AS page FROM documents),
  s AS (SELECT doc_id, string_split(regexp_replace(md, '<!--\\s*page\\s+(\\d+)\\s*-->', chr(2) || '\\1' || chr(2), 'g'), chr(2)) AS p FROM done),
  f AS (SELECT doc_id, CAST(p[2 * i] AS BIGINT) AS page, regexp_replace(p[2 * i + 1], '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT doc_id, p, unnest(range(1, (len(p) - 1) // 2 + 1)) AS i FROM s) q)
  SELECT a.doc_id AS job_id, CAST(a.page AS BIGINT) AS page, CASE WHEN a.doc_id % 3 > 0 THEN coalesce(t, '') WHEN a.page < 2 THEN 'live ' || a.page END AS raw,
    CASE WHEN a.doc_id % 3 > 0 OR a.page < 2 THEN 'ready' ELSE 'not_ready' END AS state, CASE WHEN a.page = 1 THEN 88.5::DOUBLE END AS mean FROM a LEFT JOIN f ON f.doc_id = a.doc_id AND f.page = a.page""")
def page_lookup(spark, d):
    docs = md_docs(spark, d).select(F.col("doc_id").alias("job_id"), "md")
    asked = docs.select("job_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 1, 5)])).alias("page"))
    live = docs.where("job_id % 3 = 0").select("job_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (0, 1)])).alias("page"))
    live = live.withColumn("md", md.page(F.col("page"), F.format_string("live %d\n", "page")))
    sidecars = docs.select("job_id", F.lit(1).cast("bigint").alias("page"), F.lit(88.5).alias("mean"), F.lit(2).alias("low"))
    return pages.looked_up(asked, docs.where("job_id % 3 > 0"), live, sidecars).select("job_id", "page", "state", "raw", "mean")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 3 = 0 THEN 'eng' ELSE 'ben+eng' END AS lang, CASE WHEN o_custkey % 4 = 0 THEN 150 ELSE 300 END AS dpi, o_custkey % 5 = 0 AS use_layout, o_custkey % 5 <> 1 AS preprocess,
  false AS make_searchable, false AS gen_toc, CASE WHEN o_custkey % 2 = 0 THEN 'policy' END AS preset, 0 AS start_page, CAST(NULL AS INTEGER) AS end_page, CAST(NULL AS VARCHAR) AS batch_id, 'a.pdf' AS filename, 'pdf' AS file_type, o_orderpriority AS created_at FROM orders""")
def job_defaults(spark, d):
    k = F.col("o_custkey")
    asked = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("a.pdf").alias("filename"), F.lit("pdf").alias("file_type"), F.col("o_orderpriority").alias("created_at"), F.when(k % 3 == 0, "eng").alias("lang"),
        F.when(k % 4 == 0, 150).alias("dpi"), F.when(k % 5 == 0, True).alias("use_layout"), F.when(k % 5 == 1, False).alias("preprocess"), F.when(k % 2 == 0, "policy").alias("preset"),
    )
    return jobs.with_defaults(asked)


@query("""WITH p(preset, use_layout, preprocess, make_searchable, gen_toc) AS (VALUES ('standard', false, true, false, false), ('research', true, true, true, false), ('policy', true, true, false, true), ('meeting', true, true, false, true)),
  c AS (SELECT c_custkey, ['standard', 'research', 'policy', 'meeting', 'other'][c_custkey % 5 + 1] AS preset, CASE WHEN c_custkey % 3 = 0 THEN 'premium' ELSE 'free' END AS plan FROM customer)
  SELECT c_custkey AS job_id, c.preset, c.plan, p.use_layout AND plan = 'premium' AS use_layout, p.preprocess, p.make_searchable AND plan = 'premium' AS make_searchable, p.gen_toc FROM c JOIN p ON p.preset = CASE WHEN c.preset = 'other' THEN 'standard' ELSE c.preset END""")
def preset_plan(spark, d):
    presets = spark.createDataFrame(jobs.PRESETS, "preset string, use_layout boolean, preprocess boolean, make_searchable boolean, gen_toc boolean")
    preset = F.element_at(F.array(*map(F.lit, ("standard", "research", "policy", "meeting", "other"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return jobs.with_presets(table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), preset.alias("preset"), F.when(F.col("c_custkey") % 3 == 0, "premium").otherwise("free").alias("plan")), presets)


BATCHES = "SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 6 > 0 THEN 'b' || o_custkey END AS batch_id, 'scan.' || o_orderpriority || '.pdf' AS filename, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders"


def _batches(spark, d):
    o = table(spark, d, "orders")
    batch = F.when(F.col("o_custkey") % 6 > 0, F.concat(F.lit("b"), F.col("o_custkey").cast("string")))
    return o.select(F.col("o_orderkey").alias("job_id"), batch.alias("batch_id"), F.concat(F.lit("scan."), "o_orderpriority", F.lit(".pdf")).alias("filename"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


@query(f"""WITH j AS ({BATCHES}), f AS (SELECT batch_id, job_id, printf('%02d_%s', row_number() OVER (PARTITION BY batch_id ORDER BY created_at, job_id), regexp_replace(filename, '\\.[^.]+$', '')) AS folder FROM j WHERE batch_id IS NOT NULL AND o_orderstatus = 'F')
  SELECT batch_id, job_id, folder || '/converted.md' AS entry FROM f UNION ALL SELECT batch_id, job_id, folder || '/images/fig_' || l_linenumber || '.png' FROM f JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R') l ON l_orderkey = job_id""")
def batch_bundle(spark, d):
    j = _batches(spark, d)
    images = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"), F.format_string("fig_%d.png", "l_linenumber").alias("name")).distinct()
    return jobs.bundle(j, j.where("o_orderstatus = 'F'"), images)


@query(f"SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE s = 'done') AS done, count(*) FILTER (WHERE s IN ('done', 'error', 'crashed')) AS finished FROM (SELECT batch_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'crashed' END AS s FROM ({BATCHES}) j) t GROUP BY batch_id")
def batch_counts(spark, d):
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("crashed")
    return jobs.batch_counts(_batches(spark, d).withColumn("status", state))

"""Sources, sinks, streams, image clean-up and evaluation against files and brute force made here."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.functions import html
from vellum.functions import markdown as md
from vellum.operators import image, metrics
from vellum.plans import catalogue
from vellum.plans.fixtures import ocr_words
from vellum.sources import files, office, sinks
from vellum.streaming import live

DATA = "/root/testdata/sf0.001"
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
R = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
D = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook():
    return zipped(**{
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="B" sheetId="1" r:id="r2"/><sheet name="A" sheetId="2" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {R}><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="/xl/worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si><si><r><t>x</t></r><r><t>|y</t></r></si></sst>",
        "xl/worksheets/one.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>7</v></c></row></sheetData></worksheet>',
        "xl/worksheets/two.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="b"><v>1</v></c><c r="B1"/></row></sheetData></worksheet>',
    })


def document():
    p = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    r = lambda t, props="": f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>'
    body = p(r("Title"), '<w:pStyle w:val="Heading1"/>') + p(r("plain ") + r("bold", "<w:b/>") + r(" not", '<w:b w:val="0"/>')) + p(r("one"), "<w:numPr/>") + p(r("two"), "<w:numPr/>") + p("")
    body += f"<w:tbl><w:tr><w:tc>{p(r('a|b'))}</w:tc><w:tc>{p(r('c'))}</w:tc></w:tr><w:tr><w:tc>{p(r('d'))}</w:tc></w:tr></w:tbl>" + p('<w:r><a:blip r:embed="i1"/></w:r>')
    return zipped(**{
        "word/document.xml": f"<w:document {D}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": f'<Relationships {R}><Relationship Id="i1" Target="media/p.jpeg"/></Relationships>',
        "word/media/p.jpeg": "JPEG",
    })


def test_office_files_and_dispatch(spark, tmp_path):
    for name, content in {"a.XLSX": workbook(), "b.docx": document(), "bad.xlsx": b"no zip", "c.txt": b"x", "empty.docx": b""}.items():
        (tmp_path / name).write_bytes(content)
    found = files.files(spark, f"file://{tmp_path}")
    assert sorted((r["path"].rpartition("/")[2], r["kind"]) for r in found.select("path", "kind").collect()) == [("a.XLSX", "xlsx"), ("b.docx", "docx"), ("bad.xlsx", "xlsx")]
    cells = [(r["sheet_ix"], r["sheet"], r["row"], r["col"], r["value"]) for r in office.xlsx_cells(found.where("kind = 'xlsx'")).collect() if r["error"] is None]
    assert sorted(cells) == [(0, "B", 0, 0, "True"), (1, "A", 0, 0, "name"), (1, "A", 0, 27, "n"), (1, "A", 1, 0, "x|y"), (1, "A", 1, 27, "7")]
    errors = office.xlsx_cells(found.where("kind = 'xlsx'")).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and errors[0]["error"].startswith("BadZipFile")
    doc = office.docx_texts(found.where("kind = 'docx'")).head()
    assert doc["md"] == "# Title\n\nplain **bold** not\n\n* one\n* two\n\n| a\\|b | c |\n| --- | --- |\n| d |  |\n\n![](images/docx_img_1.jpg)"
    assert [(i["name"], bytes(i["content"])) for i in doc["images"]] == [("docx_img_1.jpg", b"JPEG")]


def test_csv_types_and_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,x,s\n1,1.5,"a ""b"""\nNA,2,null\n3,,"c,\nd"\n')
    df = files.csv(spark, f"file://{tmp_path}/t.csv")
    assert df.dtypes == [("n", "bigint"), ("x", "double"), ("s", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, 'a "b"'), (None, 2.0, None), (3, None, "c,\nd")]


def test_tables_of_cells(spark):
    rows = [("s", 0, 0, "n"), ("s", 0, 1, "name"), ("s", 1, 0, "10"), ("s", 2, 1, "a longer one"), ("e", 0, 0, "only"), ("e", 0, 1, None)]
    got = dict(md.cells_to_tables(spark.createDataFrame(rows, "sheet string, row int, col int, value string"), "sheet").collect())
    assert got == {"e": "*No data*", "s": "|   n | name         |\n|----:|:-------------|\n|  10 |              |\n|     | a longer one |"}


@pytest.mark.parametrize("source,want", [
    ("", ""), (None, ""), ("<h2>A <b>b</b></h2><p>x_y<br>z</p>", "## A **b**\n\nx\\_y  \nz"), ("<ul><li>a<ul><li>b</li></ul></li><li>c</ul>", "* a\n  * b\n* c"),
    ("<ol><li>a<li>b</ol>", "1. a\n2. b"), ('<a href="u">t</a> <a>n</a> <img src="i" alt="k">', "[t](u) n ![k](i)"), ("<script>var a='</p>'</script><p>k", "k"),
    ("<table><tr><th>a<th>b<tr><td>1|2</table>", "| a | b |\n| --- | --- |\n| 1\\|2 |  |"), ("<pre>a\n  b_c</pre>", "```\na\n  b_c\n```"), ("</p></div>a &amp; b", "a & b"),
])
def test_html(source, want):
    assert html.to_markdown(source) == want


def test_deep_html():
    assert html.to_markdown("<div>" * 20_000 + "x") == "x"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    pairs = [("the cat sat", "the bat sat down"), ("", ""), ("", "x"), ("a b a", ""), ("é ü", "e ü"), ("a  b", "b a"), ("x" * 400, "y"), (" ".join(map(str, range(3000))), " ".join(map(str, range(5, 3000))))]
    df = spark.createDataFrame(pairs, "a string, b string").select(metrics.cer(F.col("a"), F.col("b")), metrics.wer(F.col("a"), F.col("b")))
    rate = lambda a, b: edits(a, b) / len(a) if a else float(bool(b))
    for (a, b), (c, w) in zip(pairs[:-1], df.collect()[:-1], strict=True):
        assert (round(c, 9), round(w, 9)) == (round(rate(a, b), 9), round(rate(a.split(), b.split()), 9))
    assert df.collect()[-1][1] == 5 / 3000
    got = spark.createDataFrame([(" é \n x ",), (None,)], "t string").select(metrics.normalized(F.col("t"))).collect()
    assert [r[0] for r in got] == ["é x", None]


def test_word_error_rate_query(spark):
    assert catalogue.queries()["word_error_rate"](spark, DATA).where("wer < 0 OR wer > 1 OR wer IS NULL").count() == 0


def test_words_are_told_apart_and_counted_in_lines_of_any_length(spark):
    import random

    rng = random.Random(5)
    edits = lambda a, b: metrics.edits(a.split(), b.split())
    assert [edits(a, b) for a, b in (("", ""), ("a", ""), ("", "a b"), ("a b c", "a c"), ("a b", "b a"), ("a x c d", "a y c"))] == [0, 1, 2, 1, 2, 2]
    for n, kinds in ((9, 3), (64, 5), (65, 40), (130, 200)):
        a, b = ([rng.randrange(kinds) for _ in range(n - rng.randrange(4))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, v in enumerate(a):
            new = [i + 1]
            for j, w in enumerate(b):
                new.append(min(row[j] + (v != w), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert metrics.edits(a[:], b[:]) == metrics.edits(b[:], a[:]) == row[-1]
    # a word before, and every hundredth another: a table of 20,000 by 20,000 places
    words_ = [str(i) for i in range(20000)]
    other = ["new"] + [w if i % 100 else "x" + w for i, w in enumerate(words_)]
    rows = [(" ".join(words_), " ".join(other)), ("a  b ", "b"), ("", None), ("a", None), (None, "a"), (" ", "a")]
    got = spark.createDataFrame(rows, "a string, b string").select(metrics.wer(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [201 / 20000, 0.5, 1.0, None, None, 1.0]


def test_lines_are_rated_where_they_stand_and_ids_on_several_rows_together(spark, tmp_path):
    query = catalogue.queries()["word_error_rate"]
    plan = query(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "listagg" not in plan and plan.count("Generate ") == 2  # lines only, here and of shared ids; no rows of words
    docs = [(1, "a b\nc", ""), (2, "a b\n\nc  d", ""), (1, "e f g\nh\ni", ""), (None, "a", ""), (3, None, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    words = ocr_words(spark, str(tmp_path)).where("conf >= 0").groupBy("doc_id", "line").agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= 60).alias("sure"))
    want = {(r["doc_id"], r["line"]): (r["n"] - r["sure"]) / r["n"] for r in words.collect()}
    got = query(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["line"]): r["wer"] for r in got} == want


def test_live_view_and_checkpoints(spark, tmp_path):
    row = lambda page, preview, t, n=None: json.dumps({"job_id": "j", "page": page, "preview": preview, "word_count": n, "updated_at": f"2024-01-01T00:00:0{t}Z"})
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(row(0, "zero", 0) + "\n" + row(1, "", 1))
    paths = [f"file://{tmp_path}/{x}" for x in ("out", "m1", "kept", "m2")]
    run = lambda: (live.append(live.shown(live.page_rows(spark, f"file://{src}")), *paths[:2]), live.page_checkpoints(live.page_rows(spark, f"file://{src}"), *paths[2:]))
    run()
    run()
    assert [(r["page"], r["word_count"]) for r in spark.read.parquet(paths[0]).collect()] == [(0, 0)]
    (src / "b.json").write_text(row(1, "one", 2, 4))
    run()
    assert sorted((r["page"], r["preview"], r["word_count"]) for r in live.restored(spark, paths[2]).collect()) == [(0, "zero", None), (1, "one", 4)]


def test_live_feed_of_a_folder(spark, tmp_path):
    spark.createDataFrame([(i, "u", f"<p>{i}</p>" if i % 3 else "") for i in range(9)], "page_id bigint, url string, html string").repartition(3).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = catalogue.queries()["live_feed"](spark, f"file://{tmp_path}").collect()
    assert sorted((r["page"], r["preview"], r["word_count"]) for r in got) == [(i, f"<p>{i}</p>", 0) for i in range(9) if i % 3]


def test_mean_confidence_rounds_as_sql(spark):
    import duckdb

    from vellum.operators import ocr

    # the sum of these tenths is just under a half; SQL scales it before it rounds
    confs = [52.5, 17.6, 55.6, 65.8, 64.0, 49.9, 91.5, 34.9, 77.5, 72.7, 12.4, 99.8]
    words = spark.createDataFrame([(1, c) for c in confs] + [(2, -1.0)], "doc_id int, conf double").coalesce(1)
    want = duckdb.sql(f"SELECT round(avg(c), 1) FROM (SELECT unnest({confs}::DOUBLE[]) AS c) t").fetchall()[0][0]
    assert [r["mean_conf"] for r in ocr.confidence(words).sort("doc_id").collect()] == [want, None]


def test_chunk_documents(spark):
    jobs = spark.createDataFrame([(1, "f.pdf", "pdf", "bn", None, True, False, False, False, None), (2, "g", "csv", None, None, None, None, None, None, None)], "job_id int, filename string, file_type string, lang string, created_at string, preprocess boolean, use_layout boolean, make_searchable boolean, gen_toc boolean, preset string")
    chunks = spark.createDataFrame([(1, 2, "খ"), (1, 1, "ক")], "job_id int, chunk_id int, text string")
    got = {r["job_id"]: json.loads(r["json"]) for r in sinks.chunk_documents(jobs, chunks, "page").collect()}
    assert got[1]["chunks"] == [{"chunk_id": 1, "text": "ক"}, {"chunk_id": 2, "text": "খ"}] and got[1]["document"]["chunk_count"] == 2
    assert got[2]["chunks"] == [] and got[2]["document"]["language"] is None


def test_table_from_words(spark):
    words = [(1, 0, 0, "a", 90.0, 0, 0, 10, 10), (1, 0, 1, "b|", 90.0, 100, 1, 10, 10), (1, 1, 0, "c", 90.0, 2, 30, 10, 10), (1, 1, 1, "d", 90.0, 101, 30, 10, 10), (1, 2, 0, "e", 90.0, 100, 60, 10, 10), (2, 0, 0, "x", 90.0, 0, 0, 10, 10)]
    from vellum.operators import ocr

    df = spark.createDataFrame(words, "doc_id long, line long, word long, text string, conf double, x long, y long, width long, height long")
    assert dict(ocr.table_markdown(df).collect()) == {1: "| a | b\\| |\n| --- | --- |\n| c | d |\n|  | e |", 2: None}


def test_skew_and_shadow():
    page = np.full((240, 320), 255, np.uint8)
    page[30:210:20, 30:290] = 0
    page[31:211:20, 30:290] = 0
    assert image.skew(page) == 0.0 and image.skew(np.full((50, 50), 255, np.uint8)) == 0.0
    for angle in (-6.0, 4.0):
        turned = image.rotated(page, angle)
        assert abs(image.skew(turned) + angle) <= 0.5
        fixed, by = image.enhanced(turned, contrast=False)
        assert abs(by + angle) <= 0.5 and abs(image.skew(fixed)) <= 0.5
    shaded = (page * np.linspace(0.4, 1, 320)[None, :]).astype(np.uint8)
    clean = image.without_shadow(shaded)
    assert clean[5:20, 40:280].min() > 200 and clean[30, 60:260].max() < 120

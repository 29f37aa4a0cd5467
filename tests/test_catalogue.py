"""Every catalogue query against its SQL in DuckDB at the smallest scale."""

import duckdb
import pytest

from vellum.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalogue.SQL])
def test_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalogue.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)


def test_overlaps_against_plain_python(spark):
    import random

    from vellum.operators import layout

    rng = random.Random(3)
    rows = []
    for page in range(40):
        for o in range(8):
            x, y = rng.randrange(40), rng.randrange(40)
            rows.append((page, o, "text", rng.choice([0.2, 0.5, 0.9]), float(x), float(y), float(x + rng.randrange(10, 40)), float(y + rng.randrange(10, 40))))
    df = spark.createDataFrame(rows, "page int, ord int, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["page"], r["ord"]) for r in layout.without_overlaps(df, "page").collect()}

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        return w * h / ((a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h)

    want = set()
    for page in range(40):
        kept = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[3], r[1])):
            if all(iou(r, k) <= 0.6 for k in kept):
                kept.append(r)
        want |= {(k[0], k[1]) for k in kept}
    assert got == want


def test_text_queries_stay_in_the_jvm(spark):
    for name in ("md_stats", "split_sections", "toc", "conf_page", "grid_cells"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_grids_read_words_once_and_compare_no_more_than_neighbouring_anchors(spark):
    for name in ("grid_cells", "table_markdown"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1 and "Join" not in plan and "anchors" not in plan, name


def test_boxes_of_one_place_make_one_page_in_whatever_order_they_come(spark):
    from vellum.operators import layout

    # parts 32,010 apart share x1 and, in bands of 10 to 14, the band: the SQL's order leaves those of one line number open
    rows = [(1, 1, "text", x1, y1, x1 + w, y1 + 20, t, None, g, 1000, 520) for x1, y1, w, t, g in ((7, 2, 50, "a", None), (7, 3, 50, "b", None), (7, 2, 50, "c", None), (7, 2, 60, "a", None))]
    rows += [(1, 1, "table", 7, 2, 57, 22, "a", None, g, 1000, 520) for g in ("| d |", "| e |")]
    names = "page long, ord int, label string, x1 long, y1 long, x2 long, y2 long, text string, table string, grid string, width int, height int"
    made = [tuple(layout.page_markdown(spark.createDataFrame(x, names).repartition(n), "page").head()) for x, n in ((rows, 1), (rows[::-1], 1), (rows[3:] + rows[:3], 4))]
    assert made[0] == made[1] == made[2] and made[0][2] == 2 and sorted(made[0][1].split("\n\n")) == ["a", "a", "b", "c", "| d |", "| e |"]


def test_edges(spark):
    from pyspark.sql import functions as F

    from vellum.functions import markdown as md

    rows = [("",), ("a\n|---|\n",), ("#\nTitle",), ("$$ $x$ $$ and $y$",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(md.table_count(F.col("t")), md.formula_count(F.col("t")), F.size(md.windows(F.col("t"), 2, 1))).collect()
    assert [tuple(r) for r in got[:4]] == [(0, 0, 1), (0, 0, 8), (0, 0, 7), (0, 2, 17)]
    assert spark.createDataFrame([("#\nTitle",)], "t string").select(md.section_parts(F.col("t"))[0]["title"]).head()[0] == "Title"

"""The pipeline's stages one after another on the smallest tables."""

import numpy as np


def test_stages(spark, tmp_path):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(c.STAGES) - 1:
            assert docs.columns == columns
            assert 0.5 * before <= docs.count() <= before
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert np.isin(packed.doc_id, spark.read.parquet(str(tmp_path / "pii")).toPandas().doc_id).all()


def test_the_drivers_garbage_is_collected_after_tables_are_written(spark, monkeypatch):
    from types import SimpleNamespace as Names

    from vellum.llm import durable

    done = []
    driver = Names(_jvm=Names(java=Names(lang=Names(System=Names(gc=lambda: done.append("gc"))))))
    monkeypatch.setattr(durable, "_last", float("-inf"))
    durable.tidied(driver)
    durable.tidied(driver)  # too soon
    assert done == ["gc"]
    monkeypatch.setattr(durable, "tidied", done.append)
    assert durable.stored(spark.range(3)).count() == durable.checkpointed(spark.range(3)).count() == 3
    assert len(done) == 3


def test_the_driver_returns_memory_freed_outside_its_heap(spark, monkeypatch):
    import re

    from vellum.llm import durable

    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held():
        with open(f"/proc/{pid}/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024

    monkeypatch.setattr(durable, "give_back", lambda: None)
    packers = [spark._jvm.java.util.zip.Deflater() for _ in range(2000)]
    for x in packers[:-1]:  # the last keeps the others' room from going by itself
        x.end()
    for _ in range(4):  # so that the heap is as small as it gets
        spark._jvm.java.lang.System.gc()
    before = held()
    monkeypatch.setattr(durable, "_last", float("-inf"))
    durable.tidied(spark)
    after = held()
    packers[-1].end()
    assert after < before - 50, (before, after)

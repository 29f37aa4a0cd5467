"""Operators on the job log: status, history, resuming, page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 10
#: Options of each preset.
PRESETS = [("standard", False, True, False, False), ("research", True, True, True, False), ("policy", True, True, False, True), ("meeting", True, True, False, True)]

#: The defaults of a job's options, and the states a job ends in.
DEFAULTS = [
    ("lang", "string", "ben+eng"), ("dpi", "int", 300), ("use_layout", "boolean", False), ("preprocess", "boolean", True), ("make_searchable", "boolean", False),
    ("gen_toc", "boolean", False), ("preset", "string", None), ("start_page", "int", 0), ("end_page", "int", None), ("batch_id", "string", None),
]
TERMINAL = ("done", "error", "crashed")


def status(jobs: DataFrame, progress: DataFrame, errors: DataFrame) -> DataFrame:
    """One row a job: latest progress, with defaults, and what the error log says."""
    latest = progress.groupBy("job_id").agg(F.max_by(F.struct("status", "done"), F.struct("updated_at", "seq")).alias("p"))
    return (
        jobs.join(latest, "job_id", "left").join(errors, "job_id", "left")
        .select("job_id", F.coalesce("p.status", F.lit("queued")).alias("status"), F.coalesce("pages_done", "p.done", F.lit(0)).cast("bigint").alias("done"), F.col("pages_done").isNotNull().alias("has_error"))
    )


def recent(jobs: DataFrame, n: int = HISTORY) -> DataFrame:
    return jobs.orderBy(F.coalesce("created_at", F.lit("")).desc(), "job_id").limit(n)


def expired(jobs: DataFrame, by: str, running: Column, n: int = HISTORY) -> DataFrame:
    """What lies past the newest n of each group, but for running jobs."""
    order = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("_n", F.row_number().over(order)).where((F.col("_n") > n) & ~running).drop("_n")


def extraction_cap(total: Column) -> Column:
    return F.when(total <= 20, total).when(total <= 200, 20).otherwise(10)


def page_plan(attempts: DataFrame, done: DataFrame) -> DataFrame:
    """job_id, page, plan: a page in flight at a crash is forced plain once, then skipped."""
    struck = attempts.groupBy("job_id", "page").agg(F.count("*").alias("strikes"))
    return struck.join(done, ["job_id", "page"], "left_anti").withColumn("plan", F.when(F.col("strikes") >= 2, "skip").otherwise("plain"))


def page_range(spec: Column, total: Column) -> tuple[Column, Column, Column]:
    """(first, last, valid) of 'a-b', '-b', 'a-', 'n' or nothing, within 1..total; what is no number, or no page, is not valid."""
    text = F.trim(spec)
    none = spec.isNull() | (spec == "")
    number = lambda c: F.when(c.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("bigint"))
    dash = F.locate("-", text)
    before, after = F.substring(text, F.lit(1), dash - 1), F.substring(text, dash + 1, F.length(text))
    low = F.when(none, 1).when(dash == 0, number(text)).when(before == "", 1).otherwise(number(before))
    high = F.when(none, total).when(dash == 0, number(text)).when(after == "", total).otherwise(number(after))
    first, last = F.greatest(F.lit(1), low), F.least(total, high)
    valid = low.isNotNull() & high.isNotNull() & (first <= last)
    return F.when(valid, first).cast("int"), F.when(valid, last).cast("int"), valid


def with_defaults(asked: DataFrame) -> DataFrame:
    """Jobs as they are entered: what was not chosen has its default."""
    named = {c.lower() for c in asked.columns}
    chosen = lambda name, kind: F.col(name).cast(kind) if name in named else F.lit(None).cast(kind)
    return asked.select(*["job_id", "filename", "file_type", "created_at"], *[(F.coalesce(chosen(n, k), F.lit(v)) if v is not None else chosen(n, k)).alias(n) for n, k, v in DEFAULTS])


def with_presets(jobs: DataFrame, presets: DataFrame) -> DataFrame:
    """The options of each job's preset (unknown ones: the first); layout and searchable copies only on the premium plan."""
    plain = PRESETS[0][0]
    known = jobs.join(F.broadcast(presets.select(F.col("preset").alias("known"))), F.col("preset") == F.col("known"), "left").withColumn("known", F.coalesce("known", F.lit(plain)))
    options = known.join(F.broadcast(presets.withColumnRenamed("preset", "known")), "known").drop("known")
    premium = F.coalesce(F.col("plan") == "premium", F.lit(False))
    return options.withColumn("use_layout", F.col("use_layout") & premium).withColumn("make_searchable", F.col("make_searchable") & premium)


def salvaged(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """job_id, md, done, total, can_resume of PDF jobs with finished pages (job_id, page, md).

    jobs: job_id, file_type, start_page, end_page, page_count; the total is the pages asked for, 0 if the count is not known.
    """
    made = pages.groupBy("job_id").agg(F.expr("listagg(md, '\\n\\n') WITHIN GROUP (ORDER BY page)").alias("md"), F.count("*").alias("done"))
    end = F.least(F.coalesce("end_page", "page_count"), F.col("page_count"))
    total = F.coalesce(F.greatest(F.lit(0), end - F.coalesce("start_page", F.lit(0))), F.lit(0)).cast("bigint")
    found = jobs.where("file_type = 'pdf'").join(made, "job_id").withColumn("total", total)
    return found.select("job_id", "md", "done", "total", (F.col("done") < F.col("total")).alias("can_resume"))


def bundle(jobs: DataFrame, outputs: DataFrame, images: DataFrame) -> DataFrame:
    """batch_id, job_id, entry of each batch's archive: of its finished jobs, by creation, Markdown and images by folder.

    jobs: job_id, batch_id, filename, created_at. outputs: job_id of those with a document. images: job_id, name.
    """
    done = jobs.where("batch_id IS NOT NULL").join(outputs.select("job_id"), "job_id", "left_semi")
    order = Window.partitionBy("batch_id").orderBy(F.coalesce("created_at", F.lit("")), "job_id")
    folders = done.select("batch_id", "job_id", F.format_string("%02d_%s", F.row_number().over(order), F.regexp_replace("filename", r"(?<=.)\.[^.]+$", "")).alias("folder"))
    pictures = images.join(folders, "job_id").select("batch_id", "job_id", F.concat("folder", F.lit("/images/"), "name").alias("entry"))
    return folders.select("batch_id", "job_id", F.concat("folder", F.lit("/converted.md")).alias("entry")).unionByName(pictures)


def batch_counts(jobs: DataFrame) -> DataFrame:
    """batch_id, files, done, finished: finished jobs are those no more work is done on."""
    return jobs.groupBy("batch_id").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status").isin(*TERMINAL)).alias("finished"))


def can_resume(kind: Column, salvaged: Column, done: Column, total: Column) -> Column:
    return (kind == "pdf") & salvaged & (done < total)


def resume_state(exists: Column, running: Column, resumable: Column) -> Column:
    return F.when(~exists, "not_found").when(running, "running").when(~resumable, "not_resumable").otherwise("resuming")


def crash_state(code: Column, has_error: Column) -> Column:
    return F.when(code == 0, "done").when(has_error, "error").otherwise("crashed")


def delete_state(exists: Column, running: Column) -> Column:
    return F.when(running, "running").when(exists, "deleted").otherwise("not_found")


def pages_asked(first: Column, last: Column, total: Column) -> tuple[Column, Column]:
    """(start, end) from 0, the end left out, of pages counted from 1; no first is the beginning, no last the end. May be empty."""
    return F.when(first > 0, first - 1).otherwise(0).cast("bigint"), F.coalesce(F.least(last, total), total).cast("bigint")

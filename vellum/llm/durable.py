"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
import weakref

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from vellum.llm.mapping import give_back

#: Seconds that pass at least between two collections of the driver's garbage.
EVERY = 3.0
_last = float("-inf")
#: Where tables are that `stored` wrote.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset one of this machine, in local mode only."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vellum-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def _trimmed(spark: SparkSession) -> None:
    """Returns what the driver's JVM has freed outside its heap to the system; a JVM that knows no such command is left as it is."""
    with contextlib.suppress(AttributeError, Py4JError):
        jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
        named = jvm.java.lang.Class.forName
        names, kinds, given = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"), array(jvm.Class, 4), array(jvm.Object, 4)
        values = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0))
        for i in range(4):
            kinds[i], given[i] = named(names[i]), values[i]
        # the server's own class is not open to callers, its interface is
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def tidied(spark: SparkSession) -> None:
    """Collects the driver's garbage and returns what was freed to the system.

    Planning leaves much garbage, for which the heap would grow as far as it may, beside the threads and the code of all
    stages so far and what compiling and packing them took outside the heap; and the tables and broadcasts that only garbage still names stay on disk and on executors until then.
    """
    global _last
    if time.monotonic() - _last < EVERY:
        return
    spark._jvm.java.lang.System.gc()
    give_back()
    _trimmed(spark)
    _last = time.monotonic()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once; for tables of few rows and columns."""
    folder(df.sparkSession)
    out = df.checkpoint()
    tidied(df.sparkSession)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df, written once as a table, compressed by column; the table goes when it is `dropped`, or else when the application ends."""
    spark = df.sparkSession
    at = f"{folder(spark).rstrip('/')}/vellum-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    df.write.parquet(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    tidied(spark)
    out = spark.read.schema(df.schema).parquet(at)
    _places[out] = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables from `stored` that nothing will read again, not even to make up for a lost executor."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_places.pop(table))
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(path, True)
        files.cancelDeleteOnExit(path)

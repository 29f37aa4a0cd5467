"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors unless PYTHONPATH already reaches it there.

    Spark's own file server distributes the archive, so nothing is read from a
    driver-local path on an executor.
    """
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or sc.applicationId in _done:
        return
    at = Path(tempfile.mkdtemp()) / "vellum_pkg.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "vellum").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))
    _done.add(sc.applicationId)

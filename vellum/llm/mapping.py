"""Python functions over texts that hold few of them at a time, and leave no memory taken behind."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.llm import segments

Frames = Iterator[pd.DataFrame]


def give_back() -> None:
    """Returns freed memory to the system: a worker waits for its next task beside others and the JVM, with what it has once taken."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def over_texts(docs: DataFrame, run: Callable[[Frames], Frames], schema: str) -> DataFrame:
    """mapInPandas, but in frames of about SLICE_CHARS bytes of `text`, one row at least, instead of a fixed number of rows.

    A batch of long texts stays in Arrow's compact form; only a slice of it becomes Python strings. Whole numbers of a
    slice that has nulls among them are Python's, so that none is rounded.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Frames:
        for b in batches:
            place = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // segments.SLICE_CHARS
            cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])).tolist() if b.num_rows else []
            for at, to in zip(cuts, [*cuts[1:], b.num_rows], strict=True):
                yield b.slice(at, to - at).to_pandas(integer_object_nulls=True)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(sliced(batches)):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)
        out = None
        give_back()

    return docs.mapInArrow(mapped, schema)

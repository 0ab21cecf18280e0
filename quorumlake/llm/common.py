"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
#: carriage return. bytes.split() of Python splits at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch sent to Python: texts may be long, so batches stay small. A single
#: longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: What a Python worker keeps from task to task (see kept), and the function of map_arrow it serves.
_KEPT: dict[str, Any] = {}
_SERVED: list[str] = [""]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def kept(name: str, make: Callable[[], Any]) -> Any:
    """make(), once in a worker for all tasks of one function of map_arrow."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _serve(name: str) -> None:
    """Spark's workers outlive stages, and their memory counts as their executor's. One that turns to
    another function first gives back what those before it kept, and buffers they no longer use."""
    if _SERVED[0] != name:
        _SERVED[0] = name
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn for each Arrow batch of at most BATCH_ROWS rows and about BATCH_BYTES. Only the session's
    settings for the batch size are set to these bounds; fn runs in tasks and gets one batch at a time.
    A worker holds no more than one function's kept objects."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    name = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _serve(name)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
                del batch, out
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo 5, is 0.
    Null where the id is null; learn_from() leaves those rows out and they count as not held out."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0

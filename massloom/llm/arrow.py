"""One way to run numpy code over Arrow batches and keep the caller's columns."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from massloom.session import bounded_batches


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names, whatever their case; the operator's own column replaces them."""
    taken = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in taken]
    return df.select(*(f"`{c}`" for c in keep)) if len(keep) < len(df.columns) else df


def add_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """Append ``fields``, computed batch by batch.

    ``make`` runs once in each task and returns the function of a batch, so that
    models and caches are loaded once per task. Columns of clashing names are replaced.
    """
    bounded_batches(df.sparkSession)
    names = [f.name for f in fields]
    df = without(df, names)
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            made = step(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(made[n] for n in names)], names=[*batch.schema.names, *names])
        del step
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give free memory back to the system at a task's end; workers wait for their next task with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

"""Running plain Python over Arrow batches, a bounded number of rows and characters at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ravenna.session import ship_package

#: Rows and UTF-8 bytes that one call of a batch function gets; a longer text comes alone.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices bounded by SLICE_ROWS and, unless a single text is longer, SLICE_BYTES."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or total + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text: str = "text") -> DataFrame:
    """mapInArrow with `make()` called once for each task; its result turns a slice into a batch of `schema`."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for part in slices(batches, text):
            out = step(part)
            if out.num_rows:
                yield out
            del out, part
        del step
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory back that a task held: a worker is used again, beside an executor that counts its memory too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # the C library of most Linux systems
        trim(0)


def small_file(path: str, limit: int = 32 << 20) -> bytes:
    """A vocabulary file, read on the driver to be broadcast; larger ones than `limit` bytes are refused."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} has more than {limit} bytes, too many to broadcast")
    return data

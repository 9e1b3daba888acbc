"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafseason.sources.scratch import delete, materialise, release, shared_dir, write_table
from leafseason.workers import ship

__all__ = ["batches_by_bytes", "bounded", "delete", "hand_back", "held_out", "lean", "materialise", "once", "parse_size", "release", "shared_dir", "ship", "small_batches", "tasks_for", "text_bytes", "total_bytes", "write_table"]

def once(key: tuple, make: Callable[[], Any]) -> Any:
    """make(), kept for the life of a worker process; works for functions sent by value too."""
    kept = sys.__dict__.setdefault("_leafseason_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def hand_back() -> None:
    """Return memory that this process's allocators hold free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(once(("libc",), lambda: ctypes.CDLL(None)), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], each: int = 16 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, handing free memory back after each `each` bytes of batches and at the end.

    Spark uses its Python workers again, so what one stage leaves in a worker's allocators would count in all later ones.
    """

    def handing_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            held = 0
            for batch in batches:
                held += batch.nbytes
                yield batch
                del batch
                if held >= each:
                    hand_back()
                    held = 0

        try:
            yield from run(counted())
        finally:
            hand_back()

    return handing_back


def parse_size(text: str) -> int:
    """Bytes in a size as Spark writes it: a number and b, k, kb, m, mb, g, gb, t, tb, p or pb; bytes without a unit."""
    number = text.strip().lower().rstrip("bkmgtp")
    unit = text.strip().lower()[len(number) :].removesuffix("b")
    return int(number) << (10 * " kmgtp".index(unit or " "))


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let no Arrow batch to Python exceed size bytes by more than a row.

    The session's own setting is lowered if it is larger, and stays so: results are computed when the caller asks for them.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(name, None)
    if not said or not 0 < parse_size(said) <= size:
        spark.conf.set(name, f"{size}b")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows, which must be of bounded size; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def total_bytes(docs: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def tasks_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions for size bytes, of about `each` bytes, but no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text, which is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def batches_by_bytes(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches so that a slice's texts stay near limit bytes; a single longer text is a slice of its own."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(name).cast(pa.large_binary())), 0))
        if not len(sizes):
            continue
        at = 0
        total = np.cumsum(sizes)
        while at < len(sizes):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


import pyarrow.compute  # noqa: E402,F401  binds pa.compute

ship(__name__)

"""Shared helpers: Arrow maps over documents, bounded batches, digests."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veritab.session import scratch_folder

BATCH_BYTES = "4m"


def ready(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, and this package importable in Python workers of a local run.

    On a cluster the package travels with `--py-files`; the path added here is then
    simply one that does not exist on the workers.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("67108864b", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back.

    Unlike a checkpoint, the table carries no constraints of the plan that made it; in a
    loop of joins those multiply, and planning takes longer each round.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_KEPT: dict[str, tuple[object, object]] = {}


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task; of one kind at a time, as workers serve all operators of a job."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT.clear()
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def release(kind: str | None = None) -> None:
    """Forget what operators of other kinds have left in this worker process."""
    others = [k for k in _KEPT if k != kind]
    for other in others:
        del _KEPT[other]
    if others:
        gc.collect()


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, keeps: str | None = None) -> DataFrame:
    """`mapInArrow` with a function of one batch; `keeps` is the kind of what it keeps in the worker."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keeps)
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; NULL becomes the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of a string column; NULL becomes the empty text."""
    return [x or "" for x in column.to_pylist()]


def by_bytes(pieces: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """Consecutive pieces in groups of about `most` bytes; a longer piece is a group of its own."""
    group: list[bytes] = []
    size = 0
    for piece in pieces:
        if group and size + len(piece) > most:
            yield group
            group, size = [], 0
        group.append(piece)
        size += len(piece)
    if group:
        yield group


def words_of(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes in a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = is_word[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)

"""Operator 5: token ids in files coded by a static range asymmetric numeral system.

Writing.  Documents are dealt by ranges of their id and sorted, so the files hold all
ids in ascending order.  A task gathers the ids of about `SEGMENT` tokens into a
segment: one frequency table for the segment, and blocks of `BLOCK` tokens that can be
decoded apart from each other.  A block interleaves `LANES` coder states over one
stream of 32-bit words; its final states and its place in the stream are its
checkpoint, and a CRC-32 guards its words and states together with the segment's table and size.  A segment is one row of the files, with
the ids and lengths of its documents, or parts of documents.

Reading.  Segments are decoded in parallel, all blocks of a segment together; lanes
refill from the stream by prefix sums of the lanes that run low.  A block with a
wrong checksum raises an error.

Defined results: NULL and empty texts hold the end id only; rows that repeat an id
stay apart; rows with a NULL id come first; equal ids are ordered by their text;
other columns are ignored; an empty table gives files without segments.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm.common import ready, release
from veritab.llm.tokencounts import encoder

SEGMENT = 1 << 21
#: Ids below this are counted in an array.
COUNTED = 1 << 20
BLOCK = 1 << 16
LANES = 64
#: The frequencies of a table add up to two to this power, and states stay above the lower bound.
SCALE = 18
LOWER = 31


def counted(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in use, their counts and the rank of each token; small ids, as those of a vocabulary are, need no sort."""
    top = int(tokens.max())
    if top >= COUNTED:
        symbols, ranks, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        return symbols, counts, ranks.reshape(-1)
    each = np.bincount(tokens)
    symbols = np.flatnonzero(each)
    place = np.zeros(top + 1, dtype=np.int64)
    place[symbols] = np.arange(len(symbols))
    return symbols, each[symbols], place[tokens]


def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Scaled frequencies of the symbols in use: at least one each, in proportion to the counts."""
    scaled = np.maximum(1, counts * ((1 << SCALE) - len(counts)) // counts.sum())
    scaled[np.argmax(counts)] += (1 << SCALE) - scaled.sum()
    return scaled.astype("<u4")


@dataclass
class Coded:
    """One coded segment; the arrays hold a value for each block, the states one for each lane."""

    symbols: np.ndarray
    frequencies: np.ndarray
    size: int
    words: list[np.ndarray]
    states: np.ndarray
    checks: list[int]


def shape(size: int) -> tuple[int, int]:
    """Blocks of a segment, and the tokens of each lane."""
    blocks = -(-size // BLOCK)
    return blocks, -(-size // (blocks * LANES))


def encode(tokens: np.ndarray) -> Coded:
    """Codes a segment of at least one token; the last block is filled up with the first symbol."""
    symbols, counts, found = counted(tokens)
    symbols, frequencies = symbols.astype("<u4"), frequency_table(counts)
    blocks, steps = shape(len(tokens))
    ranks = np.zeros(blocks * steps * LANES, dtype=np.int64)
    ranks[: len(tokens)] = found
    ranks = ranks.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, -1)
    freq = frequencies.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    high = freq << np.uint64(LOWER + 32 - SCALE)
    x = np.full(ranks.shape[1], 1 << LOWER, dtype=np.uint64)
    low_words = np.empty(ranks.shape, dtype="<u4")
    written = np.empty(ranks.shape, dtype=bool)
    for step in range(steps - 1, -1, -1):
        rank = ranks[step]
        f = freq[rank]
        full = x >= high[rank]
        written[step] = full
        low_words[step] = x & np.uint64(0xFFFFFFFF)
        x = np.where(full, x >> np.uint64(32), x)
        whole = x // f
        x = (whole << np.uint64(SCALE)) + (x - whole * f) + start[rank]
    low_words, written = (a.reshape(steps, blocks, LANES) for a in (low_words, written))
    words = [low_words[:, b][written[:, b]] for b in range(blocks)]
    states = x.reshape(blocks, LANES)
    head = checksum(symbols, frequencies, np.array([len(tokens)]))
    return Coded(symbols, frequencies, len(tokens), words, states, [checksum(s, w, start=head) for s, w in zip(states, words, strict=True)])


def checksum(*arrays: np.ndarray, start: int = 0) -> int:
    """CRC-32 of arrays after one another, each as eight-byte numbers."""
    for array in arrays:
        start = zlib.crc32(np.ascontiguousarray(array, "<u8").tobytes(), start)
    return start


def decode(coded: Coded) -> np.ndarray:
    """The tokens of a segment; whatever was changed of it is an error."""
    blocks, steps = shape(coded.size)
    if not blocks == len(coded.words) == len(coded.states) == len(coded.checks):
        raise ValueError("the segment does not have as many blocks as its size asks for")
    head = checksum(coded.symbols, coded.frequencies, np.array([coded.size]))
    for block, (words, states, check) in enumerate(zip(coded.words, coded.states, coded.checks, strict=True)):
        if checksum(states, words, start=head) != check:
            raise ValueError(f"block {block} does not match its checksum")
    freq = coded.frequencies.astype(np.uint64)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    rank_of_slot = np.repeat(np.arange(len(freq)), coded.frequencies)
    stream = np.concatenate([*coded.words, np.zeros(1, dtype="<u4")]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum([len(w) for w in coded.words])[:-1]]).astype(np.int64)
    x = coded.states.astype(np.uint64).reshape(-1)
    ranks = np.empty((steps, blocks * LANES), dtype=np.int32)
    slots = np.uint64((1 << SCALE) - 1)
    for step in range(steps):
        slot = x & slots
        rank = rank_of_slot[slot]
        ranks[step] = rank
        x = freq[rank] * (x >> np.uint64(SCALE)) + slot - start[rank]
        empty = (x < np.uint64(1 << LOWER)).reshape(blocks, LANES)
        before = np.cumsum(empty, axis=1)
        lanes = np.flatnonzero(empty)
        x[lanes] = x[lanes] << np.uint64(32) | stream[(at[:, None] + before - 1).reshape(-1)[lanes]]
        at += before[:, -1]
    ranks = ranks.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(-1)
    return coded.symbols[ranks[: coded.size]]


def crc_join(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings after one another; `size` is the length of the second."""
    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for i in range(32):
            if vector >> i & 1:
                total ^= matrix[i]
        return total

    power = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    bits = size * 8
    while bits:
        if bits & 1:
            first = times(power, first)
        power = [times(power, row) for row in power]
        bits >>= 1
    return first ^ second


_FILE = """shard int, segment long, first long, size long, doc_ids array<{kind}>, doc_order array<long>, doc_sizes array<long>, doc_last array<boolean>,
 symbols binary, frequencies binary, block_words array<int>, states binary, checks array<long>, stream binary"""


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Code the ids of all texts, each followed by `end_id`, into Parquet files of segments at `folder`."""
    ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    # the bounds of the ranges come from the ids alone
    sorted_docs = docs.select(id_col, text_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        release("pieces")
        shard = TaskContext.get().partitionId()
        segment, first, order, held = 0, 0, 0, 0
        parts: list[np.ndarray] = []
        entries: list[tuple[object, int, int, bool]] = []
        id_type = None

        def close() -> pa.RecordBatch:
            nonlocal segment, first, held
            coded = encode(np.concatenate(parts))
            columns = [*zip(*entries, strict=True)]
            row = [
                pa.array([shard], pa.int32()), pa.array([segment], pa.int64()), pa.array([first], pa.int64()), pa.array([coded.size], pa.int64()),
                pa.array([list(columns[0])], pa.list_(id_type)), pa.array([list(columns[1])], pa.list_(pa.int64())),
                pa.array([list(columns[2])], pa.list_(pa.int64())), pa.array([list(columns[3])], pa.list_(pa.bool_())),
                pa.array([coded.symbols.tobytes()]), pa.array([coded.frequencies.tobytes()]),
                pa.array([[len(w) for w in coded.words]], pa.list_(pa.int32())), pa.array([coded.states.astype("<u8").tobytes()]),
                pa.array([coded.checks], pa.list_(pa.int64())), pa.array([b"".join(w.tobytes() for w in coded.words)]),
            ]
            segment, first, held = segment + 1, first + coded.size, 0
            parts.clear()
            entries.clear()
            return pa.RecordBatch.from_arrays(row, names=NAMES)

        for batch in batches:
            id_type = batch.schema.field(0).type
            sizes, tokens = encoder(path).ids(batch.column(1), end_id)
            begun = at = 0
            for doc_id, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                while size:
                    part = min(size, SEGMENT - held)
                    size, held, at = size - part, held + part, at + part
                    entries.append((doc_id, order, part, not size))
                    if held == SEGMENT:
                        parts.append(tokens[begun:at])
                        begun = at
                        yield close()
                order += 1
            parts.append(tokens[begun:])
        if held:
            yield close()

    # the task number names the shard, so the files stay as they are once written
    sorted_docs.mapInArrow(run, _FILE.format(kind=kind)).write.option("compression", "uncompressed").parquet(folder)


NAMES = [
    "shard", "segment", "first", "size", "doc_ids", "doc_order", "doc_sizes", "doc_last", "symbols", "frequencies", "block_words", "states", "checks", "stream",
]


def segment_of(row: dict) -> Coded:
    """A segment from its row."""
    stream = np.frombuffer(row["stream"], dtype="<u4")
    return Coded(
        np.frombuffer(row["symbols"], dtype="<u4"), np.frombuffer(row["frequencies"], dtype="<u4"), row["size"],
        np.split(stream, np.cumsum(row["block_words"])[:-1]), np.frombuffer(row["states"], dtype="<u8").reshape(-1, LANES), row["checks"],
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, doc_order, id, part, last, start, ids): the parts of all documents; `start` counts ids within the shard."""
    ready(spark)
    files = spark.read.parquet(folder)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for row in batch.to_pylist():
                tokens = decode(segment_of(row)).astype("<u4")
                cuts = np.cumsum(row["doc_sizes"])
                starts = cuts - row["doc_sizes"]
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc_order"], pa.int64()), pa.array(row["doc_ids"], id_type),
                        pa.array([row["segment"]] * n, pa.int64()), pa.array(row["first"] + starts, pa.int64()),
                        pa.array([tokens[a:b].tobytes() for a, b in zip(starts, cuts, strict=True)], pa.binary()),
                    ],
                    names=["shard", "doc_order", "id", "part", "start", "ids"],
                )

    return files.mapInArrow(run, f"shard int, doc_order long, id {kind}, part long, start long, ids binary")


def describe(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    parts = read(spark, folder).select("shard", "doc_order", "id", "part", "start", (F.octet_length("ids") / 4).cast("long").alias("size"), F.crc32("ids").alias("crc"))
    whole = parts.groupBy("shard", "doc_order").agg(
        F.first("id").alias("id"), F.min("start").alias("start"), F.sum("size").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("part", "size", "crc"))).alias("parts")
    )

    @F.pandas_udf("long")
    def joined(column):
        def one(parts):
            total, rest = int(parts[0]["crc"]), parts[1:]
            for part in rest:
                total = crc_join(total, int(part["crc"]), 4 * int(part["size"]))
            return total

        return column.map(one)

    # one row for each shard, that is, for each task that wrote
    shards = spark.read.parquet(folder).groupBy("shard").agg(F.sum("size").alias("size"))
    bases = shards.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    found = whole.join(bases, "shard")
    return found.select(
        F.col("id").alias(id_col), (F.col("base") + F.col("start")).alias("start"), "n_tokens", joined(F.col("parts")).alias("ids_crc32")
    )

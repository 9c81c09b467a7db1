"""Operator 8: near-duplicates by SimHash, found through pivot distance tables.

Every text gets a 64-bit SimHash of its word shingles.  Equal fingerprints are one
node.  For each node the Hamming distances to 33 reference fingerprints are computed
once: the zero word and eight patterns inside each quarter of the 64 bits.  Two
fingerprints that differ in at most two bits agree in at least two quarters, so there
their distances, less that to the zero word, are the same: those differences are the
join key (six per node).  Of the nodes that share a key, a pair whose largest
coordinate difference exceeds the bound is discarded from the tables alone; the
others are verified.  Nodes of keys with more than `CROWD` members are linked without
pairs, and exactly: two words differ in at most two bits if and only if both are
within one bit of some third word, so each node is sent to its 65 neighbours and a
neighbour, which at most 65 nodes can reach, links what it got.

Defined results: NULL, empty and blank texts have the fingerprint zero, linked like
any other; rows that repeat an id each give a row; rows with a NULL id take part in
linking and never name a component, which is NULL if it holds no other id; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import map_batches, utf8
from veritab.llm.graph import components
from veritab.session import freeze

#: Fingerprints link at this many differing bits or fewer; the keys and neighbours below are made for it.
MAX_BITS = 2
#: Members of a key that are compared in pairs; larger keys link through common neighbours.
CROWD = 64
PATTERNS = 8


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def references() -> list[int]:
    """The zero word, then eight half-filled patterns in each quarter."""
    draw = random.Random(64)
    return [0] + [sum(1 << (16 * quarter + bit) for bit in draw.sample(range(16), 8)) for quarter in range(4) for _ in range(PATTERNS)]


def fingerprint(text: bytes, width: int, seed: int) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        digests = xxhash.xxh64_digest(joined, seed)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - width].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones.astype(np.int64) > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word): the SimHash of every whole text as a signed long."""

    def work(batch: pa.RecordBatch):
        words = [signed(fingerprint(text, width, seed)) for text in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64())], names=[id_col, "word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, word long")


def distance_table(word: Column) -> Column:
    """Hamming distances to all reference fingerprints."""
    return F.array(*[F.bit_count(word.bitwiseXOR(F.lit(signed(r)))).cast("byte") for r in references()])


def _keys(table: Column) -> Column:
    """One key for each two quarters, from the coordinates of both."""
    def own(quarter: int) -> list[Column]:
        return [table[1 + quarter * PATTERNS + i] - table[0] for i in range(PATTERNS)]

    return F.array(*[F.xxhash64(F.lit(10 * a + b), *own(a), *own(b)) for a, b in itertools.combinations(range(4), 2)])


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between the structs `node` with a field `word`, enough of them to reach whatever is linked."""
    keyed = nodes.select("node", distance_table(F.col("node.word")).alias("table")).select("node", "table", F.explode(_keys(F.col("table"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = freeze(keyed.join(sizes, "key"))
    small = shared.where(F.col("members") <= CROWD)
    left = small.select("key", F.col("node").alias("a"), F.col("table").alias("left"))
    right = small.select("key", F.col("node").alias("b"), F.col("table").alias("right"))
    apart = F.array_max(F.zip_with("left", "right", lambda x, y: F.abs(x - y)))
    near = F.bit_count(F.col("a.word").bitwiseXOR(F.col("b.word"))) <= MAX_BITS
    pairs = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (apart <= MAX_BITS) & near).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    meeting = (
        shared.where(F.col("members") > CROWD)
        .select("node")
        .distinct()
        .select("node", F.explode(F.transform(flips, lambda flip: F.col("node.word").bitwiseXOR(flip))).alias("third"))
    )
    met = meeting.groupBy("third").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).where(F.size("all") > 1)
    return pairs.union(met.select("a", F.explode("all").alias("b")).where("a != b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): SimHash in hexadecimal and the smallest id reachable through links."""
    words = freeze(fingerprints(docs, width, seed, id_col, text_col).select(F.col(id_col).alias("id"), "word"))
    nodes = freeze(
        words.groupBy("word").agg(F.min("id").alias("id")).select("word", F.struct(F.col("id").isNull().alias("unnamed"), "id", "word").alias("node"))
    )
    roots = components(links(nodes))
    named = nodes.join(roots, nodes["node"] == roots["v"], "left").select("word", F.coalesce("root.id", "node.id").alias("component_id"))
    return words.join(named, "word").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id"
    )

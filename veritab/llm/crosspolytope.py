"""Operator 7: approximate nearest neighbours by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a Hadamard transform, and
hashed to the signed axis nearest to it.  Every row is indexed in `tables` tables with
rotations of their own; a query looks into the buckets of its `probes` nearest axes of
each table.  Equal vectors are one entry with their smallest ids, so a common vector
is no hot bucket.  Buckets with many entries or queries are split by salts on both
sides, and each part is compared in one matrix product that returns only the nearest
of each query; pairs never become rows.  A query whose buckets hold fewer than it wants,
in a small table or for a rare length, is compared with all entries of its length, in
such parts.  The score is the exact cosine in double
precision on the original vectors.

Defined results: vectors that are NULL, empty, zero, or hold NULL or non-finite
components take no part, nor do rows with a NULL id; vectors are compared with those
of their length only; a row that repeats the query's id is not its neighbour; equal
scores are ordered by id; other columns are ignored; an empty table gives no rows;
vectors of more than 2^18 components raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import map_batches
from veritab.session import freeze

#: Entries or queries of a bucket's part, on average.
PART = 4096


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest entry near one: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    size, half = x.shape[1], 1
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
        half *= 2
    return x / np.sqrt(size)


def axes(vectors: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """(vectors, tables, probes): the nearest signed axes, nearest first; axis i + size is the negative of i."""
    unit = scaled(vectors)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    size = 1 << (vectors.shape[1] - 1).bit_length()
    unit = np.pad(unit, ((0, 0), (0, size - unit.shape[1])))
    found = np.empty((len(vectors), tables, probes), dtype=np.int32)
    for table in range(tables):
        signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, size))
        turned = unit
        for round_signs in signs:
            turned = hadamard(turned * round_signs)
        both = np.concatenate([turned, -turned], axis=1)
        if probes == 1:
            found[:, table, 0] = both.argmax(axis=1)
        else:
            near = np.argpartition(-both, min(probes, 2 * size) - 1, axis=1)[:, :probes]
            found[:, table] = np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable"), axis=1)
    return found


def usable(vector: Column) -> Column:
    """Whether a vector can be compared; never NULL."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def hashed(vectors: DataFrame, tables: int, probes: int, seed: int) -> DataFrame:
    """One row for each table and probe: (ids, vector, size, tab, axis)."""

    def work(batch: pa.RecordBatch):
        column = batch.column(1)
        sizes = np.diff(np.asarray(column.offsets))
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            part = column.take(pa.array(rows))
            found = axes(np.asarray(part.flatten(), dtype=np.float64).reshape(-1, size), tables, min(probes, 2 << int(size - 1).bit_length()), seed)
            coded = found + (np.arange(tables) << 20)[None, :, None] if size <= 1 << 18 else None
            if coded is None:
                raise ValueError("vectors are too long")
            flat = coded.reshape(len(rows), -1).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), part, codes], names=["ids", "vector", "codes"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = map_batches(vectors.select("ids", "vector"), work, f"ids {types['ids']}, vector {types['vector']}, codes array<int>")
    return coded.select("ids", "vector", F.size("vector").alias("size"), F.explode("codes").alias("code"))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, tables: int = 16, probes: int = 8, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, id, score): up to `k` nearest of the rows that `queries` picks, among all other rows."""
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull() & queries).select(F.array(F.col(id_col).cast("long")).alias("ids"), F.col(vector_col).alias("vector"))
    index, looks = hashed(entries, tables, 1, seed), hashed(asked, tables, probes, seed)

    def meetings(index: DataFrame, looks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
        """Entries and queries of each bucket, both cut into parts of bounded size, every part beside every part of the other side."""
        members = index.groupBy(key).agg(F.count("*").alias("n")).join(looks.groupBy(key).agg(F.count("*").alias("q")), key)
        # one row for each bucket: at most `tables` times twice the padded length, whatever the number of vectors
        parts = F.broadcast(members.select(*key, F.ceil(F.col("n") / PART).alias("n_parts"), F.ceil(F.col("q") / PART).alias("q_parts")))
        each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
        own = lambda parts: F.pmod(F.xxhash64("ids"), F.col(parts))
        left = index.join(parts, key).select("ids", "vector", *key, own("n_parts").alias("n_part"), each("q_parts").alias("q_part"))
        right = looks.join(parts, key).select("ids", "vector", *key, own("q_parts").alias("q_part"), each("n_parts").alias("n_part"))
        return left, right, [*key, "n_part", "q_part"]

    def compare(entry: pa.Table, look: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if entry.num_rows and look.num_rows:
            matrix = lambda t: scaled(np.asarray(t.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1))
            a, b = matrix(look), matrix(entry)
            norm_a, norm_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
            ids, asks = entry.column("ids").to_pylist(), look.column("ids").to_pylist()
            few = min(k + 1, len(b))  # one may be the query's own vector
            for start in range(0, len(a), 512):
                rough = a[start : start + 512] @ b.T / norm_b
                # all that are as near as the last one wanted, but for rounding
                least = np.partition(rough, len(b) - few, axis=1)[:, len(b) - few] - 1e-9 * norm_a[start : start + 512]
                for i, near in enumerate(rough >= least[:, None], start):
                    columns = np.flatnonzero(near)
                    exact = (b[columns] * a[i]).sum(axis=1) / (norm_a[i] * norm_b[columns])
                    query = asks[i][0]
                    found = sorted((-s, x) for s, c in zip(exact.tolist(), columns, strict=True) for x in ids[c] if x != query)[:k]
                    out["query_id"] += [query] * len(found)
                    out["id"] += [x for _, x in found]
                    out["score"] += [-s for s, _ in found]
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    def compared(index: DataFrame, looks: DataFrame, key: list[str]) -> DataFrame:
        left, right, split = meetings(index, looks, key)
        found = left.groupBy(split).cogroup(right.groupBy(split)).applyInArrow(compare, "query_id long, id long, score double")
        return found.groupBy("query_id", "id").agg(F.max("score").alias("score"))

    best = freeze(compared(index, looks, ["size", "code"]))
    # queries whose buckets held too few look at all entries of their length
    sized = lambda t: t.select("ids", "vector", F.size("vector").alias("size"))
    there = sized(entries).groupBy("size").agg((F.sum(F.size("ids")) - 1).alias("others"))
    counts = best.groupBy("query_id").agg(F.count("*").alias("found"))
    lacking = freeze(
        sized(asked).join(F.broadcast(there), "size").join(counts, F.get("ids", F.lit(0)) == F.col("query_id"), "left")
        .where(F.coalesce("found", F.lit(0)) < F.least(F.lit(k), "others")).select("ids", "vector", "size")
    )
    if not lacking.isEmpty():
        best = best.unionByName(compared(sized(entries), lacking, ["size"])).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

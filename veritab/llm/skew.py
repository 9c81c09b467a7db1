"""Joins in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
#: A key is heavy from this share of the rows on, so there are at most as many heavy keys as its inverse.
HEAVY = 1 / 1000
#: Tables of fewer rows than this have no heavy keys worth a salt.
LIGHT = 1_000_000


def heavy_keys(rows: DataFrame, on: list[str], salts: int = SALTS) -> DataFrame:
    """The keys with at least `HEAVY` of the rows, none of a NULL key: at most 1000 rows.  Heavier keys have more salts."""
    counts = rows.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_rows"))
    total = rows.agg(F.greatest(F.count("*"), F.lit(LIGHT)).alias("_all"))  # one row
    return counts.join(F.broadcast(total), F.col("_rows") >= F.col("_all") * HEAVY).select(*on, F.least(F.lit(salts), F.ceil(2 * F.col("_rows") / (F.col("_all") * HEAVY))).cast("int").alias("_salts"))


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, heavy: DataFrame | None = None, by: Column | None = None) -> DataFrame:
    """`rows` joined to `table`, whose rows of a heavy key are repeated for each salt.

    Without `heavy`, `rows` is read twice and should be stored.  The salt is a hash of
    all columns, or `by`; it must not change when a task is run again.  `how` is inner
    or left.
    """
    heavy = F.broadcast(heavy_keys(rows, on, salts) if heavy is None else heavy)
    spread = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*rows.columns) if by is None else by, F.col("_salts"))).otherwise(0).cast("int")
    left = rows.join(heavy, on, "left").withColumn("_salt", spread).drop("_salts")
    right = table.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")

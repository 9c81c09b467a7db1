"""Shared inputs of the registered queries.

The driver tables hold no synthetic twin, so rows with an even key play the real
table and rows with an odd key the candidate; every row takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.session import tune


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def parity_side(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "real").otherwise("fake").alias("side")


def r(column: Column | str, digits: int = 9) -> Column:
    """Rounded double, so that the order of a floating sum does not show; no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def big(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("bigint")


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_TEXT = ["l_returnflag", "l_linestatus"]


def order_pair(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        parity_side("o_orderkey"), "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    )


ORDER_PAIR = """(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'fake' END AS side, o_orderkey, o_totalprice,
 o_orderstatus, o_orderpriority FROM orders)"""


def line_pair(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem with NULL discounts on line 7, so that NULL rules take part."""
    return load(spark, folder, "lineitem").select(
        parity_side("l_orderkey"), "l_quantity", "l_extendedprice",
        F.when(F.col("l_linenumber") != 7, F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("l_linenumber"),
    )


LINE_PAIR = """(SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'fake' END AS side, l_quantity, l_extendedprice,
 CASE WHEN l_linenumber <> 7 THEN l_discount END AS l_discount, l_tax, l_returnflag, l_linestatus,
 CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)"""


def uniform_sql(seed: int, key: str) -> str:
    """The draw of `scalars.seeded_uniform` in SQL."""
    return f"(('0x' || substring(md5(concat('{seed}:', {key})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


class Registry:
    """Collects the queries of one area with their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def keep(build):
            self.queries[name] = build
            if sql is not None:
                self.sql[name] = sql
            return build

        return keep

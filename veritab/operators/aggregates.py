"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import named, numeric_of


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and share of each value combination."""
    total = df.count()
    return df.groupBy(*[named(c) for c in columns]).agg(F.count("*").alias("n")).select(
        *[named(c) for c in columns], "n", (F.col("n") / F.lit(total)).alias("share")
    )


def class_share_rows(df: DataFrame, target: str, tag: str | None = None) -> DataFrame:
    """One scored row per class, named `<target>_<value>`, rounded half-even to 2 places."""
    rows = shares(df.filter(named(target).isNotNull()), [target])
    result = rows.select(
        F.concat(F.lit(f"{target}_"), named(target).cast("string")).alias("scorer"), F.bround("share", 2).alias("score")
    )
    return result if tag is None else result.withColumn("tag", F.lit(tag))


def pair_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Joint shares with NULL keys left out of counts and total."""
    return shares(df.filter(named(a).isNotNull() & named(b).isNotNull()), [a, b])


def sample_skewness(column: Column) -> Column:
    """Bias-corrected skewness; 0 for fewer than three values."""
    n = F.count(column).cast("double")
    return F.when(n >= 3, F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(0.0)


def moments(df: DataFrame, columns: list[str], group: list[str] | None = None) -> DataFrame:
    """Min, max, mean, population std and variance, corrected skewness; long form."""
    wide = []
    for i, c in enumerate(columns):
        x = numeric_of(df, c)
        wide += [
            F.count(x).alias(f"n{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"mean{i}"),
            F.stddev_pop(x).alias(f"std{i}"), F.var_pop(x).alias(f"var{i}"), sample_skewness(x).alias(f"skew{i}"),
        ]
    row = df.groupBy(*[named(g) for g in group or []]).agg(*wide)
    fields = {"n": "n", "min": "min", "max": "max", "mean": "mean", "std": "std", "variance": "var", "skewness": "skew"}
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{short}{i}").alias(name) for name, short in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(*[named(g) for g in group or []], F.explode(F.array(*entries)).alias("e")).select(
        *[named(g) for g in group or []], "e.*"
    )


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact median per column, 0 when all values are NULL.

    Large tables go through `ranks.exact_quantiles`, which never holds a column in one task.
    """
    from veritab.operators.ranks import exact_quantiles

    middle = exact_quantiles(df, {c: numeric_of(df, c) for c in columns}, 2)
    rows = [(c, float(middle[c][1]) if middle[c] else 0.0) for c in columns]
    entries = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("median")) for c, m in rows]
    one = df.sparkSession.range(1)
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero, null and numeric shares of all columns in one pass."""
    wide = []
    for i, c in enumerate(columns):
        x = numeric_of(df, c)
        wide += [
            F.avg(F.coalesce(x == 0, F.lit(False)).cast("int")).alias(f"z{i}"),
            F.avg(named(c).isNull().cast("int")).alias(f"u{i}"),
            F.avg(x.isNotNull().cast("int")).alias(f"p{i}"),
        ]
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"z{i}").alias("zero_rate"), F.col(f"u{i}").alias("null_rate"),
            F.col(f"p{i}").alias("parse_rate"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*wide).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def mean_pm_std(df: DataFrame, group: list[Column], value: Column, places: int = 1) -> DataFrame:
    """`mean±std` as text; mean to `places`, sample std to one place less, both half-even."""
    spread = F.bround(F.stddev_samp(value), places - 1)
    text = F.concat(
        F.bround(F.avg(value), places).cast("string"), F.lit("±"), F.coalesce(spread.cast("string"), F.lit("nan"))
    )
    return df.groupBy(*group).agg(text.alias("summary"))


def across_seeds(df: DataFrame, group: list[Column], value: Column) -> DataFrame:
    """Mean and sample std over seeds, NULL and NaN ignored; std 0 for a single seed."""
    clean = F.when(~F.isnan(value), value)
    return df.groupBy(*group).agg(
        F.avg(clean).alias("mean"), F.coalesce(F.stddev_samp(clean), F.lit(0.0)).alias("std")
    )


def pivot_mean(df: DataFrame, index: list[str], column: str, value: str, values: list) -> DataFrame:
    """Mean of `value` by index and column; the column values are stated, so one pass suffices."""
    return df.groupBy(*[named(i) for i in index]).pivot(column, values).agg(F.avg(named(value)))

"""Shared rows, unseen values, drift and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import named
from veritab.operators.ranks import top_values
from veritab.operators.sides import SIDE, melt, text_of


def row_presence(tagged: DataFrame, sides: list[str]) -> DataFrame:
    """One row per distinct data row with a flag `in_<side>`; NULLs compare equal.

    Copies collapse before the shuffle, so a group of copies of any size reaches the
    reducers as one row per map task.
    """
    columns = [named(c) for c in tagged.columns if c != SIDE]
    return tagged.groupBy(*columns).agg(*[F.bool_or(F.col(SIDE) == s).alias(f"in_{s}") for s in sides])


def exact_duplicates(tagged: DataFrame, comparisons: dict[str, tuple[str, str]]) -> DataFrame:
    """Number of distinct rows shared by each named pair of sides, in one pass."""
    sides = sorted({s for members in comparisons.values() for s in members})
    shared = row_presence(tagged, sides).agg(
        *[F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(tag) for tag, (a, b) in comparisons.items()]
    )
    lines = F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(tag).alias("score")) for tag in comparisons])
    return shared.select(F.explode(lines).alias("l")).select("l.tag", "l.score")


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    """union without duplicate rows."""
    return left.unionByName(right).distinct()


def value_counts(df: DataFrame, columns: list[str], by: list[Column] | None = None, null_text: str = "__NA__") -> DataFrame:
    """(column, value, n) of many columns in one aggregation."""
    keep = by or []
    names = df.select(*keep).columns if keep else []
    return melt(df, {c: text_of(c, null_text) for c in columns}, keep).groupBy(*names, "column", "value").agg(
        F.count("*").alias("n")
    )


def vocabulary_counts(pair: DataFrame, columns: list[str], train: str = "real", other: str = "fake") -> DataFrame:
    """Counts of each (column, value) on both sides: the base of every vocabulary question.

    A value unseen in training is one with n_train = 0; no join is needed.
    """
    return melt(pair, {c: text_of(c, "__NA__") for c in columns}, [F.col(SIDE)]).groupBy("column", "value").agg(
        F.count_if(F.col(SIDE) == train).alias("n_train"), F.count_if(F.col(SIDE) == other).alias("n_other")
    )


def oov_summary(pair: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and values unseen in training, per column."""
    unseen = F.col("n_train") == 0
    return vocabulary_counts(pair, columns).groupBy("column").agg(
        F.sum(F.when(unseen, F.col("n_other")).otherwise(0)).alias("oov_count"),
        F.count_if(unseen & (F.col("n_other") > 0)).alias("oov_values"),
        (F.sum(F.when(unseen, F.col("n_other")).otherwise(0)) / F.nullif(F.sum("n_other"), F.lit(0))).alias("oov_rate"),
    )


def oov_top(pair: DataFrame, columns: list[str], k: int = 10, only_unseen: bool = True) -> DataFrame:
    """Most frequent values of the compared side, unseen ones only or all."""
    counts = vocabulary_counts(pair, columns).filter(F.col("n_other") > 0)
    if only_unseen:
        counts = counts.filter(F.col("n_train") == 0)
    return top_values(counts.select("column", "value", F.col("n_other").alias("n")), ["column"], k)


def semi_by_vocabulary(df: DataFrame, column: str, vocabulary: DataFrame, known: bool = True) -> DataFrame:
    """Rows whose value is (not) in the distinct values of `vocabulary`'s same column.

    The size of the vocabulary decides the join at run time.
    """
    values = vocabulary.select(named(column)).distinct()
    return df.join(values, column, "left_semi" if known else "left_anti")


def aligned_frequencies(pair: DataFrame, column: str) -> DataFrame:
    """Share of each value on both sides, 0 where missing; one aggregation."""
    counts = pair.groupBy(text_of(column, "__NA__").alias("value")).agg(
        F.count_if(F.col(SIDE) == "real").alias("n_real"), F.count_if(F.col(SIDE) == "fake").alias("n_fake")
    )
    totals = {r[SIDE]: r["count"] for r in pair.groupBy(SIDE).count().collect()}
    return counts.select(
        "value",
        (F.col("n_real") / F.lit(totals.get("real"))).alias("p_real"),
        (F.col("n_fake") / F.lit(totals.get("fake"))).alias("p_fake"),
    )


def aligned_frequencies_by_join(pair: DataFrame, column: str) -> DataFrame:
    """C1 in its join form, for checks against `aligned_frequencies`."""

    def shares(side: str, output: str) -> DataFrame:
        rows = pair.filter(F.col(SIDE) == side)
        counts = rows.groupBy(text_of(column, "__NA__").alias("value")).count()
        return counts.select("value", (F.col("count") / F.lit(rows.count())).alias(output))

    joined = shares("real", "p_real").join(shares("fake", "p_fake"), "value", "full_outer")
    return joined.na.fill(0.0, ["p_real", "p_fake"])


def group_summary(df: DataFrame, group: list[Column], positive: str, mean: str, category: str, k: int = 5) -> DataFrame:
    """Per label size, share above zero, means, and the k most frequent categories."""
    names = df.select(*group).columns
    numbers = df.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.avg((named(positive) > 0).cast("int")).alias("positive_share"),
        F.avg(named(positive)).alias("positive_mean"),
        F.avg(named(mean)).alias("mean"),
    )
    counts = df.groupBy(*group, named(category).alias("value")).agg(F.count("*").alias("n"))
    best = top_values(counts, names, k).groupBy(*names).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
                lambda e: F.concat_ws(":", e["value"], e["n"].cast("string")),
            ),
            ",",
        ).alias("top")
    )
    return numbers.join(best, names)


def acceptance(raw: DataFrame, accepted: Column, expected: Column, group: list[str]) -> DataFrame:
    """Sampled and accepted rows per run and the rate between them."""
    return raw.groupBy(*group).agg(
        F.count("*").alias("total_sampled"), F.count_if(accepted).alias("total_processed"),
        F.max(expected).alias("total_expected"),
    ).withColumn("rate", F.col("total_processed") / F.col("total_sampled"))

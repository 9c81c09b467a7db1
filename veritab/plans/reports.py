"""Report tables over the ledger and run paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import paths
from veritab.operators.aggregates import mean_pm_std, pivot_mean
from veritab.operators.clean import every_nth

BASELINE = "real_data"


def with_baseline(reports: DataFrame) -> DataFrame:
    """Synthetic rows under their dataset, and the real rows of the first report as one baseline (Q15)."""
    is_real = F.col("tag").startswith("real")
    first = reports.filter(is_real).agg(F.min("dataset").alias("__first"))
    real = reports.filter(is_real).join(F.broadcast(first), F.col("dataset") == F.col("__first")).drop("__first")  # one row
    real = real.withColumn("dataset", F.lit(BASELINE))
    return real.unionByName(reports.filter(F.col("tag") == "fake"))


def dataset_names(reports: DataFrame, limit: int = 10_000) -> list[str]:
    """Column heads of a pivot; one per report file."""
    names = [row[0] for row in reports.select("dataset").distinct().orderBy("dataset").limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"a pivot shows at most {limit} datasets")
    return names


def summary_pivots(reports: DataFrame, datasets: list[str] | None = None) -> dict[str, DataFrame]:
    """Efficacy, histogram, correlation and duplicate tables with one column per dataset."""
    full = with_baseline(reports)
    names = datasets or dataset_names(reports)
    heads = [BASELINE, *names]
    result = {
        "efficacy": pivot_mean(full.filter(F.col("metric") == "efficacy_test"), ["model_name", "scorer"], "dataset", "score", heads),
        "histogram": pivot_mean(full.filter(F.col("metric") == "histogram_intersection"), ["metric"], "dataset", "score", heads),
        "correlation": pivot_mean(full.filter(F.col("metric") == "correlation_accuracy"), ["metric"], "dataset", "score", heads),
    }
    duplicates = reports.filter(F.col("metric") == "exact_duplicates")
    wanted = full.filter((F.col("metric") == "exact_duplicates") & (F.col("dataset") == BASELINE)).unionByName(
        duplicates.filter(F.col("tag") == "fake_train")
    )
    result["duplicates"] = pivot_mean(wanted, ["metric"], "dataset", "score", heads)
    return result


def experiment_dimensions(df: DataFrame, settings: list[paths.Setting], path: str = "fake_path") -> DataFrame:
    """The rows with one more column for each run setting that the caller's patterns read from the path."""
    return df.select(*[F.col(c) for c in df.columns], *paths.read_settings(F.col(path), settings))


# Metrics whose scores are shares and are shown in per cent.
PERCENT_METRICS = ["efficacy_test", "histogram_intersection", "correlation_accuracy", "pairwise_similarity"]


def percent_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.when(F.col("metric").isin(PERCENT_METRICS), F.col("score") * 100).otherwise(F.col("score")))


def paper_table(df: DataFrame, keep: Column, index: list[str], metrics: list[str], order: dict[str, list[str]] | None = None, filler: str = "-") -> DataFrame:
    """Mean and deviation per setting, one column per metric, rows in the stated order.

    `df` holds `metric`, `scorer`, `score` and the setting columns.  Scores of share
    metrics are in per cent.
    """
    named_metric = paths.short_metric_name(F.col("metric"), F.col("scorer"))
    chosen = percent_scores(df.filter(keep)).withColumn("merged", named_metric)
    texts = mean_pm_std(chosen, [*[F.col(c) for c in index], F.col("merged")], F.col("score"))
    wide = texts.groupBy(*index).pivot("merged", metrics).agg(F.first("summary")).na.fill(filler, metrics)
    if order:
        # values that are not listed come last, by name
        listed = {c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) for c, values in order.items()}
        wide = wide.orderBy(*[k for c, at in listed.items() for k in (F.when(at > 0, at).asc_nulls_last(), F.col(c))])
    return wide


def perplexity_curves(logs: DataFrame, step: str, methods: list[str], value: str, every: int = 100) -> DataFrame:
    """One column per method over every n-th step."""
    return every_nth(pivot_mean(logs, [step], "method", value, methods), step, every)

"""Per-column fidelity: one histogram table, many scores."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veritab.functions.binning import histogram_bin
from veritab.functions.scalars import normalize_score, numeric_of
from veritab.operators.associations import coefficient_frame
from veritab.operators.ranks import positional_pairs, running_totals
from veritab.operators.sides import FAKE, REAL, SIDE, ColumnTypes, data_columns, melt, text_of, types_by_dtype

NULL_CATEGORY = "nan"


def fit_ranges(df: DataFrame, numeric: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Minimum and maximum per numeric column, one job."""
    if not numeric:
        return {}
    pieces = []
    for i, name in enumerate(numeric):
        value = numeric_of(df, name)
        pieces += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    row = df.agg(*pieces).first()
    return {name: (row[f"low{i}"], row[f"high{i}"]) for i, name in enumerate(numeric)}


def fit_extents(df: DataFrame, types: ColumnTypes) -> tuple[dict[str, tuple[float | None, float | None]], int]:
    """Ranges of the numeric columns and the estimated number of categories, one job."""
    wide = []
    for i, name in enumerate(types.numeric):
        value = numeric_of(df, name)
        wide += [F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}")]
    wide += [F.approx_count_distinct(text_of(c, NULL_CATEGORY)).alias(f"size{i}") for i, c in enumerate(types.categorical)]
    row = df.agg(*wide).first()
    ranges = {name: (row[f"low{i}"], row[f"high{i}"]) for i, name in enumerate(types.numeric)}
    return ranges, sum(row[f"size{i}"] for i in range(len(types.categorical)))


def histogram_table(
    pair: DataFrame,
    types: ColumnTypes | None = None,
    bins: int = 50,
    fit: DataFrame | None = None,
    sides: tuple[str, ...] = (REAL, FAKE),
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Counts per (column, bin) with one count column `n_<side>` per side.

    Numeric bins come from `bins` edge positions over the range of `fit` (default:
    all sides together); values outside are dropped.  The bin of a categorical
    value is the value itself.  One scan, one shuffle on (column, bin).
    """
    types = types or types_by_dtype(pair)
    if ranges is None:
        ranges = fit_ranges(fit if fit is not None else pair, types.numeric)
    cells: dict[str, Column] = {}
    for name in types.numeric:
        index = histogram_bin(numeric_of(pair, name), *ranges[name], bins)
        cells[name] = F.struct(index.alias("bin"), F.lit(None).cast("string").alias("category"))
    for name in types.categorical:
        cells[name] = F.struct(F.lit(0).alias("bin"), text_of(name, NULL_CATEGORY).alias("category"))
    narrow = melt(pair, cells, [F.col(SIDE)]).filter(F.col("value.bin").isNotNull())
    counts = [F.count_if(F.col(SIDE) == s).alias(f"n_{s}") for s in sides]
    return (
        narrow.groupBy("column", F.col("value.bin").alias("bin"), F.col("value.category").alias("category"))
        .agg(*counts)
        .withColumn("column_type", F.when(F.col("category").isNull(), "numerical").otherwise("categorical"))
    )


def with_masses(histogram: DataFrame, sides: tuple[str, ...] = (REAL, FAKE)) -> DataFrame:
    """Add `p_<side>`: share of the column's binned rows; 0 when a side has none."""
    totals = histogram.groupBy("column").agg(*[F.sum(f"n_{s}").alias(f"t_{s}") for s in sides])
    joined = histogram.join(F.broadcast(totals), "column")  # one row per column of the table
    return joined.select(
        *histogram.columns,
        *[
            F.when(F.col(f"t_{s}") > 0, F.col(f"n_{s}") / F.col(f"t_{s}")).otherwise(0.0).alias(f"p_{s}")
            for s in sides
        ],
    )


def _overlap(p: Column, q: Column) -> Column:
    return F.sum(F.least(p, q))


def _jaccard(p: Column, q: Column) -> Column:
    return F.sum(F.least(p, q)) / F.nullif(F.sum(F.greatest(p, q)), F.lit(0.0))


def _jensen_shannon(p: Column, q: Column) -> Column:
    middle = (p + q) / 2

    def side(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / middle)).otherwise(0.0)

    return F.sqrt(F.greatest(F.sum(side(p) + side(q)) / 2, F.lit(0.0)))


# Scores that are one aggregate over the masses of a column's bins.
MASS_SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "histogram_intersection": _overlap,
    "jaccard_similarity": _jaccard,
    "jensonshannon_distance": _jensen_shannon,
}


def mass_scores(histogram: DataFrame, scores: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Any number of mass scores for every column in one aggregation."""
    p, q = F.col(f"p_{REAL}"), F.col(f"p_{FAKE}")
    wide = with_masses(histogram).groupBy("column", "column_type").agg(
        *[build(p, q).alias(name) for name, build in scores.items()]
    )
    entries = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("score")) for name in scores]
    return wide.select("column", "column_type", F.explode(F.array(*entries)).alias("m")).select(
        "column", "column_type", "m.metric", "m.score", F.col("m.score").alias("normalized_score")
    )


def histogram_intersection(pair: DataFrame, **options) -> DataFrame:
    """H1: sum of the smaller mass over all bins."""
    return column_metric(pair, "histogram_intersection", **options)


def jaccard_similarity(pair: DataFrame, **options) -> DataFrame:
    """H3: sum of smaller masses over sum of larger masses."""
    return column_metric(pair, "jaccard_similarity", **options)


def jensen_shannon_distance(pair: DataFrame, **options) -> DataFrame:
    """H6: square root of the base-2 divergence."""
    return column_metric(pair, "jensonshannon_distance", **options)


def column_metric(pair: DataFrame, metric, **options) -> DataFrame:
    """H8: a metric by name, or a callable (p, q) -> aggregate Column, on every column."""
    if callable(metric):
        name = getattr(metric, "__name__", "custom")
        return mass_scores(histogram_table(pair, **options), {name: metric})
    if metric in MASS_SCORES:
        return mass_scores(histogram_table(pair, **options), {metric: MASS_SCORES[metric]})
    if metric == "wasserstein_distance":
        return wasserstein_distance(pair, **options)
    if metric == "cumulative_difference":
        return cumulative_difference(pair, **options)
    raise ValueError(f"unknown column metric {metric!r}")


def placed_masses(pair: DataFrame, types: ColumnTypes | None = None, bins: int = 50, fit: DataFrame | None = None) -> DataFrame:
    """Masses in bin order with running sums, `place` (bin position), `places` (bins in all), `width`.

    Categories take the position of their text in the sorted vocabulary.
    """
    types = types or types_by_dtype(pair)
    ranges, vocabulary = fit_extents(fit if fit is not None else pair, types)
    histogram = with_masses(histogram_table(pair, types, bins, fit, ranges=ranges)).withColumn("__one", F.lit(1))
    # the estimate only decides how the prefix sums run; both ways are exact
    table = running_totals(
        histogram, ["column"], ["bin", "category"], [f"p_{REAL}", f"p_{FAKE}", "__one"], at_most=len(types.numeric) * bins + 2 * vocabulary
    )
    sizes = histogram.groupBy("column").agg(F.count("*").alias("vocabulary"))
    numeric = F.col("column_type") == "numerical"
    return table.join(F.broadcast(sizes), "column").select(  # one row per column of the table
        "column", "column_type", f"p_{REAL}", f"p_{FAKE}", f"running_p_{REAL}", f"running_p_{FAKE}",
        F.when(numeric, F.col("bin")).otherwise(F.col("running___one") - 1).cast("long").alias("place"),
        F.when(numeric, F.lit(bins - 1)).otherwise(F.col("vocabulary")).cast("long").alias("places"),
        F.when(numeric, F.lit(1.0 / (bins - 1))).otherwise(1.0).alias("width"),
    )


def wasserstein_distance(pair: DataFrame, **options) -> DataFrame:
    """H5: area between the cumulative masses placed at left bin edges; normalised 1-exp(-d).

    Running sums are constant over empty bins, so each bin's gap counts until the
    next bin that holds anything.  Only numeric columns can have empty bins, and
    they have fewer than `bins` rows; each category is followed by the next one.
    """
    placed = placed_masses(pair, **options)
    gap = F.abs(F.col(f"running_p_{REAL}") - F.col(f"running_p_{FAKE}"))
    order = W.partitionBy("column").orderBy("place")
    numeric = placed.filter(F.col("column_type") == "numerical").withColumn(
        "reach", F.coalesce(F.lead("place").over(order) - F.col("place"), F.lit(0))
    )
    categories = placed.filter(F.col("column_type") == "categorical").withColumn(
        "reach", F.when(F.col("place") + 1 < F.col("places"), 1).otherwise(0).cast("long")
    )
    scored = numeric.unionByName(categories).groupBy("column", "column_type").agg(
        F.sum(gap * F.col("reach") * F.col("width")).alias("score")
    )
    return scored.select(
        "column", "column_type", F.lit("wasserstein_distance").alias("metric"), "score",
        normalize_score(F.col("score"), 0.0, math.inf).alias("normalized_score"),
    )


def cumulative_difference(pair: DataFrame, **options) -> DataFrame:
    """H7: signed sum of the differences of the running masses times the bin width.

    A mass at position b takes part in all running sums from b on, which makes the
    double sum one weighted sum.
    """
    difference = F.col(f"p_{REAL}") - F.col(f"p_{FAKE}")
    weight = F.col("places") - F.col("place")
    return placed_masses(pair, **options).groupBy("column", "column_type").agg(
        F.sum(difference * weight * F.col("width")).alias("score")
    ).select(
        "column", "column_type", F.lit("cumulative_difference").alias("metric"), "score",
        F.col("score").alias("normalized_score"),
    )


def column_correlation(pair: DataFrame, types: ColumnTypes | None = None, theils_u: bool = False) -> DataFrame:
    """H4: association of the sorted real with the sorted fake column (sides equally large).

    Numeric: Pearson r, normalised (r+1)/2.  Categorical: bias-corrected Cramer's V
    or Theil's U.
    """
    types = types or types_by_dtype(pair)
    parts = []
    if types.numeric:
        weighted = positional_pairs(pair, types.numeric, lambda c: numeric_of(pair, c), "double")
        n, x, y = F.col("n").cast("double"), F.col("real"), F.col("fake")
        sums = weighted.groupBy("column").agg(
            F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
        )
        centred = weighted.join(F.broadcast(sums.withColumnRenamed("n", "total")), "column")  # one row per column
        dx, dy = x - F.col("sx") / F.col("total"), y - F.col("sy") / F.col("total")
        scored = centred.groupBy("column").agg(
            F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy")
        )
        r = F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))
        r = F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))
        parts.append(
            scored.select(
                "column", F.lit("numerical").alias("column_type"), F.lit("pearson").alias("correlation_metric"),
                r.alias("score"), ((r + 1) / 2).alias("normalized_score"),
            )
        )
    if types.categorical:
        weighted = positional_pairs(pair, types.categorical, lambda c: text_of(c, NULL_CATEGORY), "string")
        table = weighted.groupBy("column", F.col("real").alias("a"), F.col("fake").alias("b")).agg(F.sum("n").alias("n"))
        kind = "theils_u" if theils_u else "cramers_v"
        scored = coefficient_frame(table, ["column"], kind)
        parts.append(
            scored.select(
                "column", F.lit("categorical").alias("column_type"), F.lit(kind).alias("correlation_metric"),
                F.col(kind).alias("score"), F.col(kind).alias("normalized_score"),
            )
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("metric", F.lit("column_correlation"))


def histogram_summary(three: DataFrame, types: ColumnTypes | None = None, bins: int = 50) -> DataFrame:
    """H2: mean intersection of test/train and test/fake and the distance between both score vectors.

    `three` is tagged with the sides `test`, `train` and `fake`.  Each comparison is
    fitted on its own two tables, so each bins the test rows by its own range; both
    share one scan: a row is read once and binned for every comparison it is part of.
    """
    types = types or types_by_dtype(three)
    comparisons = {"real": ("test", "train"), "fake": ("test", "fake")}
    low_high = []
    for tag, members in comparisons.items():
        inside = F.col(SIDE).isin(*members)
        for i, name in enumerate(types.numeric):
            value = F.when(inside, numeric_of(three, name))
            low_high += [F.min(value).alias(f"{tag}_low{i}"), F.max(value).alias(f"{tag}_high{i}")]
    row = three.agg(*low_high).first() if low_high else None
    cells = []
    for tag, members in comparisons.items():
        for i, name in enumerate(types.numeric):
            index = histogram_bin(numeric_of(three, name), row[f"{tag}_low{i}"], row[f"{tag}_high{i}"], bins)
            cells.append((tag, members, name, index, F.lit(None).cast("string")))
        for name in types.categorical:
            cells.append((tag, members, name, F.lit(0), text_of(name, NULL_CATEGORY)))
    entries = [
        F.struct(
            F.lit(tag).alias("tag"), F.lit(name).alias("column"),
            F.when(F.col(SIDE).isin(*members), index).alias("bin"), category.alias("category"),
        )
        for tag, members, name, index, category in cells
    ]
    narrow = three.select(SIDE, F.explode(F.array(*entries)).alias("e")).filter(F.col("e.bin").isNotNull())
    counts = narrow.groupBy("e.tag", "e.column", "e.bin", "e.category").agg(
        F.count_if(F.col(SIDE) == "test").alias("n_real"), F.count_if(F.col(SIDE) != "test").alias("n_fake")
    )
    totals = counts.groupBy("tag", "column").agg(F.sum("n_real").alias("t_real"), F.sum("n_fake").alias("t_fake"))
    scores = (
        counts.join(F.broadcast(totals), ["tag", "column"])  # two rows per column of the table
        .groupBy("tag", "column")
        .agg(F.sum(F.least(F.col("n_real") / F.col("t_real"), F.col("n_fake") / F.col("t_fake"))).alias("score"))
    )
    by_column = scores.groupBy("column").agg(
        F.max(F.when(F.col("tag") == "real", F.col("score"))).alias("real"),
        F.max(F.when(F.col("tag") == "fake", F.col("score"))).alias("fake"),
    )
    summary = by_column.agg(
        F.avg("real").alias("real"), F.avg("fake").alias("fake"),
        F.sqrt(F.sum(F.pow(F.col("real") - F.col("fake"), 2))).alias("distance"),
    )
    lines = F.array(
        F.struct(F.lit("real").alias("tag"), F.lit("mean").alias("scorer"), F.col("real").alias("score")),
        F.struct(F.lit("fake").alias("tag"), F.lit("mean").alias("scorer"), F.col("fake").alias("score")),
        F.struct(F.lit("fake").alias("tag"), F.lit("l2_dist").alias("scorer"), F.col("distance").alias("score")),
    )
    return summary.select(F.explode(lines).alias("l")).select("l.tag", "l.scorer", "l.score")

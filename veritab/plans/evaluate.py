"""One flat record of joint-distribution distance and model quality over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import named
from veritab.operators import kway
from veritab.operators.aggregates import across_seeds
from veritab.operators.clean import keep_known_labels
from veritab.operators.efficacy import grid_search
from veritab.operators.sides import FAKE, REAL, SIDE, types_by_parsing


def evaluate(
    fit: DataFrame, test: DataFrame, synthetic: DataFrame, target: str, key: str, seeds: tuple[int, ...] = (0,), pieces: int = 20,
    subset_limit: int | None = None, ks: tuple[int, ...] = (1, 2, 3, 4, 5), grid: dict | None = None, folds: int = 5,
) -> DataFrame:
    """One row `<k>-way_tvd_mean`, `..._std_across_seeds`, `..._within_subset_std_mean`, `xgb_acc_mean`, ...

    `key` identifies the rows of each table and is no feature.  The encoder is fitted
    and both tables are encoded once for all seeds.
    """
    types = types_by_parsing(fit.drop(key), target)
    needed = {*types.numeric, *types.categorical, target}
    for name, table in (("fit", fit), ("test", test), ("synthetic", synthetic)):
        if needed - set(table.columns):
            raise ValueError(f"{name} lacks columns {sorted(needed - set(table.columns))}")
    encoder = kway.fit_encoder(fit, types, pieces)
    columns = [*types.numeric, *types.categorical]
    chosen = [named(c) for c in [*columns, target, key]]
    pair = test.select(*chosen).withColumn(SIDE, F.lit(REAL)).unionByName(synthetic.select(*chosen).withColumn(SIDE, F.lit(FAKE)))
    codes = kway.encode_quantiles(pair, encoder, [SIDE, named(target), named(key)])
    ks = tuple(k for k in ks if k <= len(columns))
    measured = None
    for seed in seeds:
        subsets = [s for k in ks for s in kway.choose_subsets(columns, k, subset_limit, seed)]
        part = kway.subset_distances(codes.select(SIDE, *[named(c) for c in columns]), subsets).groupBy("k").agg(
            F.avg("tvd").alias("mean"), F.coalesce(F.stddev_samp("tvd"), F.lit(0.0)).alias("std")
        ).withColumn("seed", F.lit(seed))
        measured = part if measured is None else measured.unionByName(part)
    labelled = keep_known_labels(codes, fit, target, "__label_id").persist()
    records = []
    for seed in seeds:
        result = grid_search(
            labelled.filter(F.col(SIDE) == FAKE), labelled.filter(F.col(SIDE) == REAL), columns, "__label_id", [key], seed, grid, folds
        )
        records.append((seed, float(result["acc"]), float(result["auc"])))
    labelled.unpersist()
    scores = measured.sparkSession.createDataFrame(records, "seed int, acc double, auc double")

    summary = across_seeds(measured, [F.col("k")], F.col("mean")).join(
        measured.groupBy("k").agg(F.avg("std").alias("within")), "k"
    )
    wide = summary.groupBy().agg(*[
        F.max(F.when(F.col("k") == k, F.col(source))).alias(f"{k}-way_tvd_{label}")
        for k in ks for source, label in (("mean", "mean"), ("std", "std_across_seeds"), ("within", "within_subset_std_mean"))
    ])
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("acc", "auc")}
    quality = scores.agg(
        *[F.avg(clean[c]).alias(f"xgb_{c}_mean") for c in clean], *[F.coalesce(F.stddev_samp(clean[c]), F.lit(0.0)).alias(f"xgb_{c}_std") for c in clean]
    )
    measured_quality = quality.first().asDict()
    return wide.select(
        "*", *[F.lit(v).cast("double").alias(c) for c, v in measured_quality.items()], F.lit(pieces).alias("n_quantiles"), F.lit(subset_limit).alias("tvd_subset_num"),
        F.array(*[F.lit(s) for s in seeds]).alias("seeds"), F.lit(len(types.numeric)).alias("num_cols_n"), F.lit(len(types.categorical)).alias("cat_cols_n"),
    )

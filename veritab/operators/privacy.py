"""Noisy scaling and the privacy ledger."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import clip, literal_array, named, numeric_of, seeded_uniform

# Integer orders of the divergence.
ORDERS = [*range(2, 11), *range(12, 64)]


# --------------------------------------------------------------- scaling P1-P2
def laplace(scale: float, seed: int, index: int) -> Column:
    """Seeded Laplace noise by inverse distribution; 0 for a zero scale."""
    if scale == 0:
        return F.lit(0.0)
    u = seeded_uniform(seed, F.lit(index)) - 0.5
    return -F.lit(scale) * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def _bounded(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: clip(numeric_of(df, c), float(low), float(high)) for c, (low, high) in bounds.items()}


def private_min_max_scale(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, seed: int = 0) -> DataFrame:
    """Scale by noisy extremes, half of the budget each.

    Q12: values are clamped to the caller's bounds and the sensitivity is their width,
    never the data's own range.  An infinite budget adds no noise.
    """
    values = _bounded(df, bounds)
    wide = []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        scale = 0.0 if math.isinf(epsilon) else (high - low) / (epsilon / 2)
        wide += [
            (F.min(values[c]) + laplace(scale, seed, 2 * i)).alias(f"low{i}"), (F.max(values[c]) + laplace(scale, seed, 2 * i + 1)).alias(f"high{i}"),
        ]
    row = df.agg(*wide).first()
    scaled = {
        c: (values[c] - F.lit(row[f"low{i}"])) / F.lit((row[f"high{i}"] - row[f"low{i}"]) or 1.0) for i, c in enumerate(bounds)
    }
    return df.select([scaled[c].alias(c) if c in scaled else named(c) for c in df.columns])


def private_standardize(df: DataFrame, bounds: dict[str, tuple[float, float]], epsilon: float, seed: int = 0) -> DataFrame:
    """Standardise by noisy mean and population deviation, half of the budget each.

    One row moves the mean by at most width / n and the deviation by at most width / sqrt(n).
    """
    values = _bounded(df, bounds)
    wide = []
    for i, c in enumerate(bounds):
        wide += [F.count(values[c]).alias(f"n{i}"), F.avg(values[c]).alias(f"mean{i}"), F.stddev_pop(values[c]).alias(f"std{i}")]
    row = df.agg(*wide).first()
    noise = []
    for i, (c, (low, high)) in enumerate(bounds.items()):
        n = max(row[f"n{i}"], 1)
        half = epsilon / 2
        noise += [
            laplace(0.0 if math.isinf(epsilon) else (high - low) / n / half, seed, 2 * i).alias(f"a{i}"),
            laplace(0.0 if math.isinf(epsilon) else (high - low) / math.sqrt(n) / half, seed, 2 * i + 1).alias(f"b{i}"),
        ]
    drawn = df.sparkSession.range(1).select(*noise).first()
    scaled = {}
    for i, c in enumerate(bounds):
        mean = (row[f"mean{i}"] or 0.0) + drawn[f"a{i}"]
        deviation = (row[f"std{i}"] or 0.0) + drawn[f"b{i}"]
        scaled[c] = (values[c] - F.lit(mean)) / F.lit(deviation or 1.0)
    return df.select([scaled[c].alias(c) if c in scaled else named(c) for c in df.columns])


# ---------------------------------------------------------------- ledger P3-P5
def binomial_logs(order: int) -> list[float]:
    """ln C(order, i) as a running sum."""
    logs = [0.0]
    for j in range(1, order + 1):
        logs.append(logs[-1] + math.log((order - j + 1) / j))
    return logs


def with_let(value: Column, use) -> Column:
    """`use` applied to a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def order_costs(q: Column, sigma: Column, steps: Column) -> Column:
    """Array over ORDERS of steps x divergence; q=0 costs nothing, sigma=0 is unbounded.

    For the subsampled Gaussian mechanism the moment of order a is a sum over i of
    C(a, i) q^i (1-q)^(a-i) exp((i^2-i) / (2 sigma^2)), added in log space.  All orders of a
    mechanism are computed inside its row: no shuffle, no join.
    """
    table = F.array(*[
        F.struct(F.lit(float(order)).alias("a"), literal_array(binomial_logs(order)).alias("logs")) for order in ORDERS
    ])
    # values outside the sampled case are replaced first, so that no logarithm of zero is taken
    inputs = F.struct(
        F.log(F.when((q > 0) & (q < 1), q).otherwise(0.5)).alias("lq"),
        F.log1p(-F.when((q > 0) & (q < 1), q).otherwise(0.5)).alias("lp"),
        (0.5 / F.pow(F.when(sigma > 0, sigma).otherwise(1.0), 2)).alias("h"),
    )

    def sampled(m: Column, o: Column) -> Column:
        terms = F.transform(o["logs"], lambda b, i: b + i * m["lq"] + (o["a"] - i) * m["lp"] + (i * i - i) * m["h"])
        moment = with_let(terms, lambda t: with_let(
            F.array_max(t), lambda top: top + F.log(F.aggregate(t, F.lit(0.0), lambda total, x: total + F.exp(x - top)))
        ))
        return moment / (o["a"] - 1)

    return with_let(inputs, lambda m: F.transform(
        table,
        lambda o: steps * F.when(q == 0, 0.0).when(sigma == 0, math.inf).when(q == 1, o["a"] * m["h"]).otherwise(sampled(m, o)),
    ))


def epsilon_at(cost: Column, order: Column, delta: Column) -> Column:
    """Budget at one order."""
    return cost - (F.log(delta) + F.log(order)) / (order - 1) + F.log((order - 1) / order)


def privacy_ledger(mechanisms: DataFrame, delta: float, dataset: str = "dataset") -> DataFrame:
    """Composed budget per dataset over mechanisms (dataset, q, sigma, steps).

    Costs add up per order over all mechanisms of a dataset; the smallest budget over the
    orders is reported with its order.
    """
    costs = mechanisms.select(
        named(dataset), order_costs(F.col("q").cast("double"), F.col("sigma").cast("double"), F.col("steps").cast("double")).alias("costs")
    )
    # one partial sum per order inside the map tasks, one row per dataset after them
    summed = costs.groupBy(named(dataset)).agg(*[F.sum(F.get("costs", F.lit(i))).alias(f"c{i}") for i in range(len(ORDERS))])
    orders = literal_array(ORDERS)
    budgets = F.transform(
        F.array(*[F.col(f"c{i}") for i in range(len(ORDERS))]),
        lambda c, i: F.struct(epsilon_at(c, F.get(orders, i), F.lit(delta)).alias("epsilon"), F.get(orders, i).cast("int").alias("order")),
    )
    return summed.select(named(dataset), F.array_min(budgets).alias("best")).select(
        named(dataset), F.col("best.epsilon").alias("epsilon"), F.col("best.order").alias("best_order")
    )


def epsilon_of(q: Column, sigma: Column, steps: Column, delta: Column) -> Column:
    """Budget of a single mechanism as an expression."""
    costs = order_costs(q, sigma, steps)
    orders = literal_array(ORDERS)
    return F.array_min(F.transform(costs, lambda c, i: epsilon_at(c, F.get(orders, i), delta)))


def noise_for_budget(targets: DataFrame, lowest: float = 0.05, highest: float = 1e6, points: int = 64, rounds: int = 3) -> DataFrame:
    """The smallest noise multiplier of a geometric grid that keeps (epsilon, delta) for (q, steps), per row of `targets`.

    All points of the grid are evaluated; the step below the first point that holds is
    divided into a grid again, `rounds` times in all.  A row that no point can meet
    keeps NULL.
    """
    q, steps, delta, goal = (F.col(c).cast("double") for c in ("q", "steps", "delta", "epsilon"))
    frame = targets.select("*", F.lit(float(lowest)).alias("__low"), F.lit(float(highest)).alias("__high"))
    for _ in range(rounds):
        ratio = F.pow(F.col("__high") / F.col("__low"), F.lit(1.0 / points))
        grid = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: F.col("__low") * F.pow(ratio, i))
        held = F.array_min(F.filter(grid, lambda sigma: epsilon_of(q, sigma, steps, delta) <= goal))
        frame = frame.select(*[named(c) for c in targets.columns], held.alias("__high"), ratio.alias("__ratio")).withColumn(
            "__low", F.greatest(F.col("__high") / F.col("__ratio"), F.lit(float(lowest)))
        )
    sigma = F.col("__high")
    return frame.select(*[named(c) for c in targets.columns], sigma.alias("sigma"), F.when(sigma.isNotNull(), epsilon_of(q, sigma, steps, delta)).alias("spent"))


def split_budget(ledger: DataFrame, preprocessing_share: float, epsilon: str = "epsilon") -> DataFrame:
    """P5: budget kept for preprocessing and the remainder for training."""
    part = named(epsilon) * F.lit(preprocessing_share)
    return ledger.withColumn("preprocess_epsilon", part).withColumn("train_epsilon", named(epsilon) - part)

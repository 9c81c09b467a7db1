"""Prefix sums, ranks, quantiles and exact cuts, with hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.functions.binning import quantile_search, right_closed_bin, right_closed_index, with_edge_counts
from veritab.operators import ranks, synth


def test_two_step_prefix_sums_match(spark):
    table = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("n"))
    one = ranks.running_totals(table, ["g"], ["o"], ["n"])
    two = ranks.running_totals(table, ["g"], ["o"], ["n"], rows_per_task=40)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_percent_rank_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 2000, 3000)).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["u"] for r in ranks.percent_rank01(df, "v", "u").collect()}
    assert len(got) == 3000
    order = np.sort(values)
    for i in range(0, 3000, 37):
        low, high = np.searchsorted(order, values[i], "left"), np.searchsorted(order, values[i], "right")
        assert got[i] == pytest.approx(max((low + 1 + high) / 2 / 3000, 1e-6) - 1e-6)


@pytest.mark.parametrize("pieces", [1, 2, 10, 100])
def test_quantiles_at_any_accuracy(spark, pieces):
    rng = np.random.default_rng(pieces)
    a, b = rng.normal(size=777), rng.integers(0, 5, 777).astype(float)
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, None, None)], "a double, b double, c double")
    cells = {c: F.col(c) for c in "abc"}
    for accuracy in (20, 10_000):
        edges = ranks.exact_quantiles(df, cells, pieces, accuracy=accuracy)
        assert edges["a"] == pytest.approx(list(np.quantile(a, np.linspace(0, 1, pieces + 1))))
        assert edges["b"] == pytest.approx(list(np.quantile(b, np.linspace(0, 1, pieces + 1))))
        assert edges["c"] == []


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_cut_sizes_are_exact(spark, bits):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    parts = ranks.cut_by_hash(df, ["id"], 3, lambda n: [("a", F.lit(3)), ("b", F.lit(40)), ("c", n)], strata=["g"], bits=bits)
    sizes = {(r["g"], r["part"]): r["count"] for r in parts.groupBy("g", "part").count().collect()}
    assert sizes == {("hot", "a"): 3, ("hot", "b"): 37, ("hot", "c"): 860, ("cold", "a"): 3, ("cold", "b"): 37, ("cold", "c"): 60}
    assert parts.select("id").distinct().count() == 1000
    again = ranks.cut_by_hash(df.repartition(7), ["id"], 3, lambda n: [("a", F.lit(3))], strata=["g"], bits=bits)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in parts.filter("part = 'a'").collect()}


def test_stratified_split(spark):
    df = spark.range(997).withColumn("y", F.when(F.col("id") % 3 == 0, "p").when(F.col("id") % 97 == 0, None).otherwise("n"))
    parts = synth.stratified_split(df, ["id"], "y", seed=1)
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert sizes == {"test": 200, "val": 80, "train": 717}
    share = parts.groupBy("part").agg(F.avg((F.col("y") == "p").cast("int")).alias("s")).collect()
    assert all(abs(r["s"] - 0.335) < 0.02 for r in share)


def test_closure_at_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 4.0, -1.0, 5.0)] + [(None,)], "x double")
    edges = [0.0, 1.0, 3.0, 4.0]
    found = with_edge_counts(df, {"n": quantile_search(F.col("x"), edges)})
    got = {r["x"]: r["c"] for r in found.select("x", right_closed_index(F.col("n"), 4).alias("c")).collect()}
    assert got == {0.0: 0, 1.0: 0, 2.0: 1, 3.0: 1, 4.0: 2, -1.0: -1, 5.0: -1, None: -1}
    cut = {r["x"]: r["c"] for r in df.select("x", right_closed_bin(F.col("x"), 0.0, 4.0, 5).alias("c")).collect()}
    assert cut == {0.0: 0, 1.0: 0, 2.0: 1, 3.0: 2, 4.0: 3, -1.0: None, 5.0: None, None: None}


def test_carried_over_borders(spark):
    """The last known value per group, where groups and runs without a value span several parts."""
    rows = [(g, i, f"{g}{i}" if i % 97 == 3 else None) for g in "ab" for i in range(400)]
    found = ranks.carried(spark.createDataFrame(rows, "g string, i int, v string").repartition(7), ["g"], ["i"], ["v"]).collect()
    last = {}
    expected = {(g, i): last.setdefault(g, v) if v is None and g in last else last.update({g: v}) or v for g, i, v in sorted(rows, key=lambda r: r[:2])}
    assert {(r.g, r.i): r.v for r in found} == expected and len(found) == 800


def test_hot_value_pairs_and_draws(spark):
    """One value with nine tenths of the rows, on one side only: weights, and parts that stay even."""
    from veritab.operators import synth
    from veritab.operators.sides import tag_sides

    real = spark.range(5000).select(F.when(F.col("id") < 4500, 7.0).otherwise(F.col("id").cast("double")).alias("x"))
    fake = spark.range(5000).select((F.col("id") % 11).cast("double").alias("x"))
    pairs = ranks.positional_pairs(tag_sides(real, fake), ["x"], lambda c: F.col(c), "double").collect()
    left, right = sorted(r.x for r in real.collect()), sorted(r.x for r in fake.collect())
    expected = {}
    for key in zip(left, right):
        expected[key] = expected.get(key, 0) + 1
    assert {(r.real, r.fake): r.n for r in pairs} == expected
    ids = spark.range(3000)
    drawn = synth.empirical_sample(real, "x", ids, ["id"], seed=3)
    u = {r.id: r.u for r in ids.select("id", synth.seeded_uniform(3, F.col("id")).alias("u")).collect()}
    assert {r.id: r.value for r in drawn.collect()} == {i: left[int(x * 5000)] for i, x in u.items()}
    assert synth.empirical_sample(real.limit(0), "x", ids, ["id"]).count() == 0


def test_parts_of_a_two_step_sum_are_bounded(spark, monkeypatch):
    """However small the parts are asked to be, the driver does not hear of more than MOST_PARTS."""
    seen, freeze = [], ranks.freeze

    def watched(df):
        done = freeze(df)
        seen.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(ranks, "freeze", watched)
    table = spark.range(6000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).alias("n"))
    found = ranks.running_totals(table, ["g"], ["id"], ["n"], rows_per_task=10)
    assert found.filter("running_n <> id div 2 + 1").count() == 0 and found.count() == 6000
    assert max(seen) <= 500

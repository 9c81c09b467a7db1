"""Boosted trees against a plain fit, and the grid search on them."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from veritab.operators import boosting, efficacy
from veritab.operators.boosting import Settings


def plain_tree(rows, g, h, settings, borders, level=0):
    """Nested (feature, border, low, high) or the value of a leaf, by trying every border."""
    whole_g, whole_h = g.sum(), h.sum()
    best = (boosting.SMALLEST_GAIN, None, None)
    if level < settings.depth:
        for f in range(rows.shape[1]):
            for border in borders[f]:
                low = rows[:, f] <= border
                if h[low].sum() < settings.least or h[~low].sum() < settings.least:
                    continue
                gain = g[low].sum() ** 2 / (h[low].sum() + settings.penalty) + g[~low].sum() ** 2 / (h[~low].sum() + settings.penalty)
                gain -= whole_g**2 / (whole_h + settings.penalty)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, border)
    if best[1] is None:
        return -settings.rate * whole_g / (whole_h + settings.penalty)
    low = rows[:, best[1]] <= best[2]
    return (best[1], best[2], plain_tree(rows[low], g[low], h[low], settings, borders, level + 1), plain_tree(rows[~low], g[~low], h[~low], settings, borders, level + 1))


def nested(tree, at=0):
    if tree.feature[at] < 0:
        return float(tree.value[at])
    return (int(tree.feature[at]), float(tree.border[at]), nested(tree, tree.left[at]), nested(tree, tree.right[at]))


def flat(tree):
    return [x for part in tree for x in flat(part)] if isinstance(tree, tuple) else [tree]


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("classes", [2, 4])
@pytest.mark.parametrize("depth", [1, 3, 20])
def test_trees_equal_brute_force(classes, depth):
    draw = np.random.default_rng(depth)
    x = draw.integers(0, 9, (150, 3)).astype(float)
    y = ((x[:, 0] + 2 * x[:, 1] + draw.normal(0, 2, 150)) // 7).astype(int) % classes
    weight = draw.integers(1, 4, 150).astype(float)
    settings = Settings(rounds=3, depth=depth, rate=0.3)
    outputs = 1 if classes == 2 else classes
    margin = np.zeros((150, outputs))
    borders = [(v[:-1] + v[1:]) / 2 for v in map(np.unique, x.T)]
    for trees in boosting.boost(x, y, weight, classes, settings):
        p = boosting.probabilities(margin)
        for k, tree in enumerate(trees):
            share, hit = (p[:, 1], y == 1) if outputs == 1 else (p[:, k], y == k)
            expected = plain_tree(x, weight * (share - hit), weight * share * (1 - share) * (1 if outputs == 1 else 2), settings, borders)
            assert flat(nested(tree)) == pytest.approx(flat(expected))
            margin[:, k] += [walk(expected, row) for row in x]
            assert tree(x) == pytest.approx([walk(expected, row) for row in x])


def test_bins_of_many_values():
    values = np.arange(10_000.0)
    borders = boosting.bin_borders(values, np.ones(10_000))
    assert len(borders) == boosting.BINS - 1 and np.ptp(np.bincount(np.searchsorted(borders, values))) <= 40
    assert boosting.bin_borders(np.array([3.0, 1.0, 3.0]), np.ones(3)).tolist() == [2.0]


def test_weighted_auc():
    assert boosting.weighted_auc(np.array([0.1, 0.2, 0.2]), np.array([False, True, False]), np.array([2.0, 1.0, 1.0])) == pytest.approx(2.5 / 3)
    assert np.isnan(boosting.weighted_auc(np.array([0.1]), np.array([True]), np.ones(1)))


@pytest.fixture(scope="module")
def coded(spark):
    i = F.col("id")
    return spark.range(900).select("id", (i % 9).alias("a"), (i * 7 % 5).alias("b"), F.when(i % 9 < 3, 0).when(i * 7 % 5 < 2, 1).otherwise(2).alias("y"))


def test_cells_count_all_rows(coded):
    x, y, fold, weight = boosting.cells(coded, [F.col("a"), F.col("b")], F.col("y"))
    assert len(x) == 45 and weight.sum() == 900 and set(y) == {0, 1, 2} and set(fold) == {0}
    few = boosting.cells(coded, [F.col("a"), F.col("b")], F.col("y"), most_rows=300)
    assert 200 < few[3].sum() < 400


def test_search_picks_the_best_setting(coded):
    """Either-or of two features needs two levels; equal scores go to the smallest model."""
    grid = {"maxIter": [1, 5], "maxDepth": [1, 4], "stepSize": [0.3]}
    crossed = coded.withColumn("y", ((F.col("a") < 3) != (F.col("b") < 2)).cast("int"))
    result = efficacy.grid_search(crossed, crossed, ["a", "b"], "y", ["id"], grid=grid)
    assert (result["acc"], result["auc"], result["best_params"]) == (1.0, 1.0, {"maxIter": 1, "maxDepth": 4, "stepSize": 0.3})
    three = crossed.withColumn("y", F.col("y") + 2 * (F.col("a") == 8).cast("int") - F.col("y") * (F.col("a") == 8).cast("int"))
    result = efficacy.grid_search(three, three, ["a", "b"], "y", ["id"], grid=grid)
    assert result["acc"] == 1.0 and result["best_params"]["maxDepth"] == 4
    assert np.isnan(efficacy.grid_search(coded.filter("y = 1"), coded, ["a"], "y", ["id"], grid=grid)["acc"])


def test_folds_are_left_out(coded):
    """Every setting has a score for each fold, equal to a fit without that fold."""
    block = boosting.cells(efficacy.with_folds(coded, ["id"], "y", 3, 1), [F.col("a"), F.col("b")], F.col("y"), F.col("__fold"))
    rows = {(r.rounds, r.depth, r.fold): r.score for r in boosting.cross_validate(coded, block, 3, [2, 3], [1, 2], [0.3], 3).collect()}
    assert len(rows) == 12
    x, y, fold, weight = block
    inside = fold != 1
    margin = np.zeros((int((~inside).sum()), 3))
    for trees in boosting.boost(x[inside], y[inside], weight[inside], 3, Settings(3, 2, 0.3)):
        margin += np.stack([t(x[~inside]) for t in trees], axis=1)
    hit = margin.argmax(axis=1) == y[~inside]
    assert rows[3, 2, 1] == pytest.approx(weight[~inside][hit].sum() / weight[~inside].sum())


def test_boosted_classes_of_vectors(spark):
    i = F.col("id")
    table = spark.range(400).select((i * 37 % 101).cast("double").alias("m"), (i % 4).cast("string").alias("c"), F.when(i * 37 % 101 < 40, "u").when(i % 4 == 0, "v").otherwise("w").alias("t"))
    scores = {r.scorer: r.score for r in efficacy.efficacy_test(table, table, "t", "xgb", ["accuracy"]).collect()}
    assert scores["accuracy"] == 1.0


def test_boosted_classes_see_all_rows(spark, monkeypatch):
    """The bound on what one task fits leaves no rows out: every one of the 12 kinds of rows is learnt."""
    i = F.col("id")
    table = spark.range(2400).select((i % 12).cast("double").alias("m"), (i * 5 % 12 % 2).cast("string").alias("c"), (i % 12 * 7 % 5 % 3).cast("string").alias("t"))
    monkeypatch.setattr(boosting, "MOST_NUMBERS", 300)
    scores = {r.scorer: r.score for r in efficacy.efficacy_test(table, table, "t", "xgb", ["accuracy"]).collect()}
    assert scores["accuracy"] == 1.0


def test_borders_of_all_values(spark):
    """Many values, few values, heavy values and a constant, equal to the borders of the whole columns at hand."""
    rows = spark.range(5000).select(*[(F.col("id") * 7919 % 5000 / 7).alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                      F.greatest(F.col("id") - 4000, F.lit(0)).cast("double").alias("c"), F.lit(2.0).alias("d")])
    found = boosting.all_borders(boosting.value_counts(rows, [F.col(c) for c in "abcd"]), 4)
    table = rows.toPandas()
    for c, borders in zip("abcd", found, strict=True):
        assert borders.tolist() == boosting.bin_borders(table[c].to_numpy(), np.ones(5000)).tolist()


@pytest.mark.parametrize("classes", [2, 3])
def test_spread_cells_grow_the_same_trees(spark, monkeypatch, classes):
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    i = F.col("id")
    rows = spark.range(3000).select((i * 37 % 1009).alias("a"), (i * i % 7).alias("b"), ((i * 37 % 1009 / 200 + i * i % 7 + i % 3) % classes).cast("int").alias("y"))
    names, settings = [F.col("a"), F.col("b")], Settings(rounds=4, depth=4)
    local = boosting.fit_all(rows, names, F.col("y"), classes, settings)
    spread = boosting.fit_all(rows, names, F.col("y"), classes, settings, most_rows=1)
    x = np.array([[r.a, r.b] for r in rows.select("a", "b").collect()], float)
    assert len(local) == len(spread) == 4
    for ours, theirs in zip(local, spread, strict=True):
        for one, other in zip(ours, theirs, strict=True):
            assert other(x) == pytest.approx(one(x), abs=1e-9)


@pytest.fixture(scope="module")
def valued(spark):
    """A number of many values, one with a heavy value, a text and a target that differs in every row."""
    i = F.col("id")
    return spark.range(4000).select(
        (i * 37 % 60).cast("double").alias("a"), F.when(i % 3 == 0, 5.0).otherwise(i % 40 / 3).alias("b"), (i % 4).cast("string").alias("c"),
        (F.sqrt(i * 37 % 60) * (i % 4 + 1) + F.when(i % 40 > 11, i % 7) + i / 4000).cast("double").alias("y"),
    ).fillna(3.5, ["y"]).withColumn("y", F.col("y") + F.col("a") / 997)


@pytest.mark.parametrize("model", ["tree", "mlp"])
def test_regression_trees_of_cells(valued, monkeypatch, model):
    """Trees of weighted cells give the predictions of Spark's trees of all rows, and read few rows."""
    plain, read = efficacy.estimator, []

    class Noted:
        def __init__(self, *args):
            self.inner = plain(*args)

        def fit(self, rows):
            read.append(rows.count())
            return self.inner.fit(rows)

    monkeypatch.setattr(efficacy, "estimator", Noted)
    ready = efficacy.prepare(valued, valued, "y")
    found = efficacy.fit_predict(ready, model).select("label", "prediction").orderBy("label", "prediction").collect()
    kind = DecisionTreeRegressor(maxDepth=15) if model == "tree" else GBTRegressor(maxIter=20)
    fitted = kind.setParams(featuresCol=efficacy.FEATURES, labelCol=efficacy.LABEL, seed=1000).fit(ready.train)
    expected = fitted.transform(ready.test).select(F.col(efficacy.LABEL).alias("label"), "prediction").orderBy("label", "prediction").collect()
    assert len(found) == 4000 and read[0] <= 120
    assert [r.prediction for r in found] == pytest.approx([r.prediction for r in expected], abs=1e-6)


def test_regression_trees_of_a_large_table(spark):
    """Beyond 10,000 rows Spark draws the rows that its bins are found on; the cells have the same bins."""
    i = F.col("id")
    rows = spark.range(0, 24_000, 1, 3).select((i * 37 % 211 / 7).alias("a"), F.when(i % 3 == 0, 0.0).otherwise(i % 53).alias("b"), (F.sqrt(i * 37 % 211) * (i % 53)).alias("y"))
    ready = efficacy.prepare(rows, rows, "y")
    found = efficacy.fit_predict(ready, "tree").select("label", "prediction").orderBy("label", "prediction").collect()
    fitted = DecisionTreeRegressor(maxDepth=15, featuresCol=efficacy.FEATURES, labelCol=efficacy.LABEL, seed=1000).fit(ready.train)
    expected = fitted.transform(ready.test).select(F.col(efficacy.LABEL).alias("label"), "prediction").orderBy("label", "prediction").collect()
    assert [r.prediction for r in found] == pytest.approx([r.prediction for r in expected], abs=1e-6)


def test_features_scaled_alike_in_wide_tables(valued, monkeypatch):
    compiled = efficacy.prepare(valued, valued, "y").train.select(vector_to_array(efficacy.FEATURES).alias("x"), efficacy.LABEL).orderBy(efficacy.LABEL, "x").collect()
    monkeypatch.setattr(efficacy, "COMPILED_WIDTH", 0)
    assert efficacy.prepare(valued, valued, "y").train.select(vector_to_array(efficacy.FEATURES).alias("x"), efficacy.LABEL).orderBy(efficacy.LABEL, "x").collect() == compiled


def test_macro_auc_of_many_classes(spark):
    """Twenty classes against every pair ranked by itself."""
    draw = np.random.default_rng(2)
    rows = [(float(k % 19), draw.integers(0, 9, 20).astype(float).tolist()) for k in range(200)]  # the last class has no rows
    table = spark.createDataFrame(rows, "label double, probability array<double>")
    found = []
    for one in range(19):
        for other in set(range(19)) - {one}:
            mine, theirs = ([p[one] for y, p in rows if y == c] for c in (one, other))
            found.append(np.mean([(a > b) + (a == b) / 2 for a in mine for b in theirs]))
    assert efficacy.macro_auc(table, 20).first()["auc"] == pytest.approx(np.mean(found))

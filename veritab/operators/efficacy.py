"""Train on the candidate table, test on the real one (L1-L7), with `pyspark.ml`."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import RobustScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.binning import with_edge_counts
from veritab.functions.scalars import literal_array, named, numeric_of
from veritab.operators import boosting
from veritab.operators.clean import drop_infinite, drop_null_target
from veritab.operators.features import fit_features, transform_features
from veritab.operators.ranks import cut_by_hash, running_totals
from veritab.operators.sides import ColumnTypes, text_of, types_by_dtype
from veritab.session import freeze, stored

LABEL, FEATURES, WEIGHT = "__label", "__features", "__weight"
CLASSIFIERS = ["logistic", "tree", "xgb", "mlp"]
REGRESSORS = ["linear", "tree", "mlp"]
#: Features up to which their arithmetic is one expression each, which Spark compiles.
COMPILED_WIDTH = 100
#: Bins of a feature in Spark's trees (its `maxBins`).
TREE_BINS = 32


@dataclass
class Prepared:
    """Feature tables shared by all models of one target.

    `kept` tables are frozen and cheap to read again.  `sizes` are the rows of each class, once counted;
    `cells` are the borders and the weighted cells of regression trees by seed, once made.
    """

    train: DataFrame
    test: DataFrame
    classes: int
    width: int
    task: str
    sizes: dict[float, int] = field(default_factory=dict)
    kept: bool = False
    cells: dict[int, tuple[list[list[float]], DataFrame]] = field(default_factory=dict)


def prepare(real: DataFrame, fake: DataFrame, target: str, types: ColumnTypes | None = None, fit: DataFrame | None = None,
            scale: bool = True) -> Prepared:
    """L1: rows without target leave, infinities become NULL, features are fitted on `fit`.

    Classification standardises numbers, regression leaves them; means fill the holes,
    then every feature is centred on its median and divided by its quartile range, both
    learnt from the training rows.
    """
    if set(real.columns) != set(fake.columns):
        raise ValueError("real and fake must have the same columns")
    types = types or types_by_dtype(real)
    task = "classification" if target in types.categorical else "regression"
    real, fake = (drop_infinite(drop_null_target(t.select(*[named(c) for c in real.columns]), target)) for t in (real, fake))
    others = [c for c in types.numeric if c != target]
    means = fake.agg(*[F.avg(numeric_of(fake, c)).alias(f"m{i}") for i, c in enumerate(others)]).first() if others else None
    filled = {c: (means[f"m{i}"] or 0.0) for i, c in enumerate(others)}

    def fill(table: DataFrame) -> DataFrame:
        return table.select([
            F.coalesce(numeric_of(table, c), F.lit(filled[c])).alias(c) if c in filled
            else (text_of(c, "nan").alias(c) if c in types.categorical else named(c))
            for c in table.columns
        ])

    source = drop_infinite(fit) if fit is not None else real
    space = fit_features(fill(source), types, target, numeric="standard" if task == "classification" else "none")
    if target in space.scale:
        del space.scale[target]
    tables = []
    for table in (fake, real):
        coded = transform_features(fill(table), space, FEATURES, LABEL)
        tables.append(coded.select(F.col(FEATURES), F.col(LABEL).cast("double").alias(LABEL)).filter(F.col(LABEL).isNotNull()))
    train, test = tables
    width = sum(size for c, size, _ in space.layout() if c != target)
    if scale and not train.isEmpty():
        scaler = RobustScaler(inputCol=FEATURES, outputCol="__scaled", withCentering=True, withScaling=True).fit(train)
        # a feature whose quartiles are equal, as a rare category's, is centred only; Spark would make it constant
        middle, spread = scaler.median.toArray().tolist(), [1.0 if s <= 0 else s for s in scaler.range.toArray().tolist()]

        def scaled(table: DataFrame) -> DataFrame:
            x, wide = F.col("__x"), table.select(vector_to_array(FEATURES).alias("__x"), LABEL)
            if width <= COMPILED_WIDTH:
                values = F.array(*[(F.get(x, F.lit(i)) - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(middle, spread, strict=True))])
            else:
                parts = F.arrays_zip(x.alias("x"), literal_array(middle).alias("m"), literal_array(spread).alias("s"))
                values = F.transform(parts, lambda p: (p["x"] - p["m"]) / p["s"])
            return wide.select(array_to_vector(values).alias(FEATURES), LABEL)

        train, test = scaled(train), scaled(test)
    classes = len(space.labels(target)) if task == "classification" else 0
    return Prepared(train, test, classes, width, task)


def class_sizes(train: DataFrame) -> dict[float, int]:
    """Rows per known label, one row per class."""
    return {row[LABEL]: row["count"] for row in train.filter(F.col(LABEL) >= 0).groupBy(LABEL).count().collect()}


def balanced(train: DataFrame, sizes: dict[float, int]) -> DataFrame:
    """Weight n / (k n_c) per class."""
    rows = sum(sizes.values())
    entries = [F.struct(F.lit(c).alias(LABEL), F.lit(rows / (len(sizes) * n)).alias(WEIGHT)) for c, n in sizes.items()]
    weights = train.sparkSession.range(1).select(F.inline(F.array(*entries)))
    return train.join(F.broadcast(weights), LABEL)  # one row per class


def estimator(model: str, task: str, classes: int, width: int, seed: int = 1000, rows: float = math.inf):
    """L2/L3.  `xgb` is fitted by `boosting`; the perceptron regressor is Spark's boosted trees.

    The logistic model has an L2 penalty of 1 beside the summed loss of `rows` weighted rows.
    """
    common = {"featuresCol": FEATURES, "labelCol": LABEL}
    if task == "classification":
        if model == "logistic":
            return LogisticRegression(**common, weightCol=WEIGHT, maxIter=100, regParam=1.0 / rows, standardization=False)
        if model == "tree":
            return DecisionTreeClassifier(**common, weightCol=WEIGHT, maxDepth=15, seed=seed)
        if model == "mlp":
            return MultilayerPerceptronClassifier(**common, layers=[width, 100, max(classes, 2)], maxIter=100, seed=seed)
        raise ValueError(f"unknown classifier {model!r}; choose from {CLASSIFIERS}")
    if model == "linear":
        return LinearRegression(**common)
    if model == "tree":
        return DecisionTreeRegressor(**common, weightCol=WEIGHT, maxBins=TREE_BINS, maxDepth=15, seed=seed)
    if model == "mlp":
        return GBTRegressor(**common, weightCol=WEIGHT, maxBins=TREE_BINS, maxIter=20, seed=seed)
    raise ValueError(f"unknown regressor {model!r}; choose from {REGRESSORS}")


def _boosted(ready: Prepared, train: DataFrame) -> DataFrame:
    """L2: boosted trees of 100 rounds and depth 6, without class weights."""
    def features(table: DataFrame) -> tuple[DataFrame, list[Column]]:
        return table.select(LABEL, vector_to_array(FEATURES).alias("__x")), [F.get("__x", F.lit(i)) for i in range(ready.width)]

    classes = max(ready.classes, 2)
    rows, columns = features(train)
    model = boosting.fit_all(rows, columns, F.col(LABEL), classes, boosting.Settings())
    train.unpersist()
    rows, columns = features(ready.test)
    return boosting.predict(rows, columns, [LABEL], model, classes).withColumnRenamed(LABEL, "label")


def spark_borders(values: np.ndarray, counts: np.ndarray, expected: float, bins: int) -> list[float]:
    """The borders between the bins of a feature by the rule of Spark's trees, from its sorted values and their counts.

    As there, zeros are what the other values leave of the `expected` rows.
    """
    counts, values = counts[values != 0].astype(float), values[values != 0]
    if not len(values):
        return []
    zeros = expected - counts.sum()
    if zeros > np.finfo(float).eps * counts.sum() * 100:
        at = np.searchsorted(values, 0.0)
        values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < bins:
        return middles.tolist()
    stride = expected / bins
    found, running, target = [], counts[0], stride
    for middle, count in zip(middles.tolist(), counts[1:].tolist(), strict=True):
        if abs(running - target) < abs(running + count - target):
            found.append(middle)
            target += stride
        running += count
    return found


def tree_borders(train: DataFrame, width: int, seed: int, bins: int = TREE_BINS) -> list[list[float]]:
    """The borders that Spark's trees of this seed would take for their bins: it finds them on a draw of about 10,000 rows."""
    spark, rows, x = train.sparkSession, train.count(), train.select(FEATURES)
    wanted = max(bins * bins, 10_000)
    if wanted < rows:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        taken = x._jdf.javaRDD().sample(False, wanted / rows, draw)
        x = DataFrame(spark._jsparkSession.createDataFrame(taken, x._jdf.schema()), spark)
    wide = x.select(F.posexplode(vector_to_array(FEATURES)).alias("feature", "value"))
    found = wide.groupBy("feature", "value").agg(F.count("*").alias("n")).toArrow()
    feature, value, n = (found[c].to_numpy() for c in ("feature", "value", "n"))
    order = np.lexsort((value, feature))
    feature, value, n = feature[order], value[order], n[order]
    ends = np.searchsorted(feature, np.arange(width + 1))
    expected = float(rows) if wanted >= rows else wanted / rows * rows
    return [spark_borders(value[a:b], n[a:b], expected, min(bins, rows)) for a, b in zip(ends, ends[1:])]


def _binned(table: DataFrame, borders: list[list[float]]) -> DataFrame:
    """(label, bin number of each feature): the borders below its value."""
    wide = table.select(LABEL, vector_to_array(FEATURES).alias("__x"))
    return with_edge_counts(wide, {f"__b{f}": (F.get("__x", F.lit(f)), own, False) for f, own in enumerate(borders)}).drop("__x")


def _bin_vector(borders: list[list[float]]) -> Column:
    return array_to_vector(F.array(*[F.col(f"__b{f}").cast("double") for f in range(len(borders))]).cast("array<double>")).alias(FEATURES)


def tree_cells(train: DataFrame, width: int, seed: int) -> tuple[list[list[float]], DataFrame]:
    """Borders, and one weighted row for all rows with equal bins: their number and mean label are all that a regression tree reads."""
    borders = tree_borders(train, width, seed) if width else []
    rows = _binned(train, borders)
    found = rows.groupBy(*[F.col(f"__b{f}") for f in range(width)]).agg(F.avg(LABEL).alias(LABEL), F.count("*").cast("double").alias(WEIGHT))
    return borders, stored(found.select(_bin_vector(borders), LABEL, WEIGHT), "tree_cells")


def fit_predict(ready: Prepared, model: str, seed: int = 1000) -> DataFrame:
    """L1: predictions for the real rows: (label, prediction, probability array or NULL).

    A candidate with a single class predicts that class with probability 1.
    """
    if ready.task == "classification":
        ready.sizes = ready.sizes or class_sizes(ready.train)
        if len(ready.sizes) < 2:
            only = next(iter(ready.sizes), 0.0)
            return ready.test.select(
                F.col(LABEL).alias("label"), F.lit(only).alias("prediction"),
                F.array(*[F.lit(1.0 if i == int(only) else 0.0) for i in range(max(ready.classes, 1))]).alias("probability"),
            )
        train = balanced(ready.train, ready.sizes).persist()
        if model == "xgb":
            return _boosted(ready, train)
    else:
        train = ready.train if ready.kept else ready.train.persist()
    test = ready.test
    if ready.task == "regression" and model in ("tree", "mlp"):
        if seed not in ready.cells:
            ready.cells[seed] = tree_cells(train, ready.width, seed)
        borders, fitted_on = ready.cells[seed]
        test = _binned(test, borders).select(_bin_vector(borders), LABEL)
    else:
        fitted_on = train
    rows = float(train.agg(F.sum(WEIGHT)).first()[0]) if model == "logistic" and ready.task == "classification" else math.inf
    fitted = estimator(model, ready.task, ready.classes, ready.width, seed, rows).fit(fitted_on)
    if train is not ready.train or not ready.kept:
        train.unpersist()
    scored = fitted.transform(test)
    if "probability" in scored.columns:
        probability = vector_to_array("probability")
    elif "rawPrediction" in scored.columns:
        probability = vector_to_array("rawPrediction")
    else:
        probability = F.lit(None).cast("array<double>")
    return scored.select(F.col(LABEL).alias("label"), F.col("prediction").cast("double").alias("prediction"), probability.alias("probability"))


# ---------------------------------------------------------------------- scorers L4
def rank_auc(scores: DataFrame, group: list[str] | None = None) -> DataFrame:
    """AUC from (score, positive 0/1) rows per group by rank sums over distinct scores; NULL when one class is missing."""
    group = group or ["__all"]
    table = scores.withColumn("__all", F.lit(1)) if group == ["__all"] else scores
    counts = table.groupBy(*group, "score").agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("q"))
    placed = running_totals(counts, group, ["score"], ["q"])
    wins = F.sum(F.col("p") * (F.col("running_q") - F.col("q") + F.col("q") / 2))
    return placed.groupBy(*group).agg((wins / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def minority_label(predictions: DataFrame) -> float | None:
    """Label with the fewest rows, the smaller label on a tie."""
    row = predictions.groupBy("label").count().orderBy("count", "label").first()
    return None if row is None else row["label"]


def score_predictions(predictions: DataFrame, scorers: list, task: str = "classification", compat_zero: bool = False) -> DataFrame:
    """(scorer, score) for names f1, auc, accuracy, r2 or callables (y_true, y_pred) -> aggregate Column.

    f1 is micro-averaged when labels and predictions show more than two classes, else it
    is that of the minority class.  auc ranks the minority class's probability against
    membership in it (Q5); undefined is NULL, or 0 with `compat_zero`.
    """
    spark = predictions.sparkSession
    y, z = F.col("label"), F.col("prediction")
    wanted = [(s if isinstance(s, str) else getattr(s, "__name__", "custom"), s) for s in scorers]
    minority, classes = None, 0
    if task == "classification" and any(n in ("f1", "auc") for n, _ in wanted):
        # read several times from here on; a model would score all rows again for each
        ranked = any(n == "auc" for n, _ in wanted)
        predictions = stored(predictions.select("label", "prediction", *(["probability"] if ranked else [])), "predictions")
        minority = minority_label(predictions)
        seen = predictions.select(F.explode(F.array("label", "prediction")).alias("c")).distinct()
        classes = seen.limit(3).count()
    wide: list[tuple[str, Column]] = []
    for name, scorer in wanted:
        if callable(scorer):
            wide.append((name, scorer(y, z)))
        elif name == "accuracy" or (name == "f1" and classes > 2):
            wide.append((name, F.avg((y == z).cast("double"))))
        elif name == "f1":
            hit = F.count_if((y == minority) & (z == minority))
            wide.append((name, 2 * hit / F.nullif(F.count_if(y == minority) + F.count_if(z == minority), F.lit(0))))
        elif name == "r2":
            spread = F.var_pop(y) * F.count(y)
            wide.append((name, 1 - F.sum((y - z) * (y - z)) / F.nullif(spread, F.lit(0.0))))
        elif name != "auc":
            raise ValueError(f"unknown scorer {name!r}")
    parts = []
    if wide:
        row = predictions.agg(*[c.cast("double").alias(f"s{i}") for i, (_, c) in enumerate(wide)])
        entries = F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(f"s{i}").alias("score")) for i, (n, _) in enumerate(wide)])
        parts.append(row.select(F.explode(entries).alias("e")).select("e.scorer", "e.score"))
    if any(n == "auc" for n, _ in wanted):
        if classes > 2 or minority is None:
            parts.append(spark.range(1).select(F.lit("auc").alias("scorer"), F.lit(None).cast("double").alias("score")))
        else:
            column = F.get("probability", F.lit(int(minority)))
            rows = predictions.select(column.alias("score"), (y == minority).cast("int").alias("positive")).filter(F.col("score").isNotNull())
            parts.append(rank_auc(rows).select(F.lit("auc").alias("scorer"), F.col("auc").alias("score")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("score", F.coalesce("score", F.lit(0.0))) if compat_zero else result


def macro_auc(predictions: DataFrame, classes: int) -> DataFrame:
    """One-vs-one AUC averaged over class pairs and both directions.

    A row gives its score for each class once.  The rows of every label below a score are
    running sums over the distinct scores of a class, and all pairs are rank sums of them.
    """
    labels = range(classes)
    scores = predictions.select("label", F.posexplode("probability").alias("one", "score")).filter(F.col("one") < classes)
    counts = scores.groupBy("one", "score").agg(*[F.count_if(F.col("label") == float(c)).alias(f"n{c}") for c in labels])
    placed = running_totals(counts, ["one"], ["score"], [f"n{c}" for c in labels])
    own = F.get(F.array(*[F.col(f"n{c}") for c in labels]), F.col("one"))
    wins = [F.sum(own * (F.col(f"running_n{c}") - F.col(f"n{c}") / 2)) for c in labels]
    sums = placed.groupBy("one").agg(F.array(*wins).alias("wins"), F.array(*[F.sum(f"n{c}") for c in labels]).alias("sizes"))
    pairs = sums.select("one", F.get("sizes", F.col("one")).alias("own"), F.posexplode(F.arrays_zip("wins", "sizes")).alias("other", "e"))
    auc = F.col("e.wins") / F.nullif(F.col("own") * F.col("e.sizes"), F.lit(0))
    return pairs.filter("one <> other").agg(F.avg(auc).alias("auc"))


# ---------------------------------------------------------------- efficacy L1, L5, L6
def efficacy_test(
    real: DataFrame, fake: DataFrame, target: str, model: str | None = None, scorers: list | None = None,
    types: ColumnTypes | None = None, fit: DataFrame | None = None, ready: Prepared | None = None,
) -> DataFrame:
    """L1: one row per scorer."""
    ready = ready or prepare(real, fake, target, types, fit)
    model = model or ("logistic" if ready.task == "classification" else "linear")
    scorers = scorers or (["f1"] if ready.task == "classification" else ["r2"])
    scored = score_predictions(fit_predict(ready, model), scorers, ready.task)
    normal = F.col("score") if ready.task == "classification" else F.exp(F.col("score") - 1)
    kind = "categorical" if ready.task == "classification" else "numerical"
    return scored.select(
        F.lit("efficacy_test").alias("metric"), F.lit(model).alias("model_name"), F.lit(target).alias("column_name"),
        F.lit(kind).alias("column_type"), "scorer", "score", normal.alias("normalized_score"),
    )


def efficacy_models(real: DataFrame, fake: DataFrame, target: str, models: list[str], **options) -> DataFrame:
    """Several models on one prepared pair of feature tables."""
    ready = prepare(real, fake, target, options.get("types"), options.get("fit"))
    # frozen, not cached: nothing has to be released after the lazy scores were read
    ready = replace(ready, train=freeze(ready.train), test=freeze(ready.test), kept=True)
    result = None
    for model in models:
        part = efficacy_test(real, fake, target, model, options.get("scorers"), ready=ready)
        result = part if result is None else result.unionByName(part)
    return result


def all_targets_test(real: DataFrame, fake: DataFrame, class_models: list[str], value_models: list[str], types: ColumnTypes | None = None,
                     mean: bool = False) -> DataFrame:
    """Every column in turn as the target; optionally the mean of all normalised scores (Q7)."""
    types = types or types_by_dtype(real)
    result = None
    for target in real.columns:
        models = class_models if target in types.categorical else value_models
        part = efficacy_models(real, fake, target, models, types=types)
        result = part if result is None else result.unionByName(part)
    if mean:
        return result.agg(F.avg("normalized_score").alias("score"))
    return result


# ------------------------------------------------------------------ grid search L7
# The tuned settings.
FULL_GRID = {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 10, 20], "stepSize": [0.01, 0.05, 0.1]}


def with_folds(df: DataFrame, keys: list[str], label: str, folds: int, seed: int) -> DataFrame:
    """Stratified fold number per row, exact per class."""
    parts = cut_by_hash(
        df, keys, seed, lambda n: [(str(i), F.ceil(n * (i + 1) / folds)) for i in range(folds)], strata=[label], output="__fold"
    )
    return parts.withColumn("__fold", F.col("__fold").cast("int"))


def grid_search(
    codes_syn: DataFrame, codes_test: DataFrame, features: list[str], label: str, keys: list[str], seed: int = 0,
    grid: dict[str, list] | None = None, folds: int = 5, most_rows: int = boosting.MOST_ROWS,
) -> dict:
    """Boosted trees over encoded features, tuned by stratified cross-validation on the candidate rows.

    All settings and folds are fitted side by side from the cells of `boosting`.  Two classes
    are tuned by AUC, more by accuracy.  Rows with a negative label leave both sides.  Fewer
    than two classes give NaN and a note.
    """
    train, test = (t.filter(F.col(label) >= 0) for t in (codes_syn, codes_test))
    classes = [row[0] for row in train.select(label).distinct().collect()]
    if len(classes) < 2:
        return {"acc": float("nan"), "auc": float("nan"), "note": "one class only"}
    size = int(max(classes)) + 1
    names = [named(f) for f in features]
    block = boosting.cells(with_folds(train, keys, label, folds, seed).select(*names, named(label), "__fold"), names, named(label), F.col("__fold"), most_rows)
    search = grid or FULL_GRID
    scores = freeze(boosting.cross_validate(train, block, size, search["maxIter"], search["maxDepth"], search["stepSize"], folds))
    # the best mean over the folds; of equal ones the first in the order of the grid
    ranked = scores.groupBy("rounds", "depth", "rate").agg(F.avg(F.when(~F.isnan("score"), F.col("score"))).alias("mean")).collect()
    best = max(ranked, key=lambda r: (-math.inf if r["mean"] is None else round(r["mean"], 12), -r["rate"], -r["depth"], -r["rounds"]))
    model = boosting.fit(train, block, size, boosting.Settings(best["rounds"], best["depth"], best["rate"]))
    scored = boosting.predict(test.withColumn("label", named(label).cast("double")), names, ["label"], model, size).persist()
    accuracy = scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    if size == 2:
        rows = scored.select(F.get("probability", F.lit(1)).alias("score"), F.col("label").cast("int").alias("positive"))
        auc = rank_auc(rows).first()
    else:
        auc = macro_auc(scored, size).first()
    scored.unpersist()
    nan = float("nan")
    return {
        "acc": nan if accuracy is None else accuracy, "auc": nan if auc is None or auc["auc"] is None else auc["auc"],
        "best_params": {"maxIter": best["rounds"], "maxDepth": best["depth"], "stepSize": best["rate"]},
    }

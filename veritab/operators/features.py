"""Feature transforms with inverse (I9-I13), on `pyspark.ml` where it has the stage."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import clip, literal_array, named, numeric_of, seeded_uniform
from veritab.operators.sides import ColumnTypes, text_of, types_by_dtype

NULL_CATEGORY = "nan"


@dataclass
class FeatureSpace:
    """Fitted transform: per column its block in the feature vector."""

    columns: list[str]
    types: ColumnTypes
    target: str | None
    discrete: str
    numeric: str
    indexers: dict[str, StringIndexerModel]
    scale: dict[str, tuple[float, float]]
    integers: set[str]

    def labels(self, column: str) -> list[str]:
        return list(self.indexers[column].labels)

    def is_label_encoded(self, column: str) -> bool:
        return column in self.indexers and (self.discrete == "label" or column == self.target)

    def layout(self) -> list[tuple[str, int, str]]:
        """Blocks in column order: (column, dimensions, activation)."""
        blocks = []
        for c in self.columns:
            if c in self.indexers:
                blocks.append((c, 1 if self.is_label_encoded(c) else len(self.labels(c)), "softmax"))
            else:
                blocks.append((c, 1, "tanh"))
        return blocks


def fit_features(
    df: DataFrame, types: ColumnTypes | None = None, target: str | None = None, discrete: str = "onehot", numeric: str = "none"
) -> FeatureSpace:
    """Vocabularies in sorted order; `standard` uses the population deviation, `minmax` the range."""
    types = types or types_by_dtype(df)
    prepared = df.select(*[text_of(c, NULL_CATEGORY).alias(c) for c in types.categorical])
    indexers = {}
    for c in types.categorical:
        stage = StringIndexer(inputCol=c, outputCol=f"__i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc")
        indexers[c] = stage.fit(prepared)
    scale: dict[str, tuple[float, float]] = {}
    if types.numeric and numeric != "none":
        wide = []
        for i, c in enumerate(types.numeric):
            x = numeric_of(df, c)
            first, second = (F.avg(x), F.stddev_pop(x)) if numeric == "standard" else (F.min(x), F.max(x) - F.min(x))
            wide += [first.cast("double").alias(f"a{i}"), second.cast("double").alias(f"b{i}")]
        row = df.agg(*wide).first()
        scale = {c: (row[f"a{i}"] or 0.0, row[f"b{i}"] or 1.0) for i, c in enumerate(types.numeric)}
    integers = {f.name for f in df.schema if f.dataType.simpleString() in ("int", "bigint", "smallint", "tinyint")}
    return FeatureSpace([c for c in df.columns if c in {*types.numeric, *types.categorical}], types, target, discrete, numeric, indexers, scale, integers)


def transform_features(df: DataFrame, space: FeatureSpace, output: str = "features", label: str | None = None) -> DataFrame:
    """Add the feature vector; an unknown category is an all-zero block.

    With `label`, the target leaves the vector and becomes that column instead.
    """
    staged = df.select(
        "*", *[text_of(c, NULL_CATEGORY).alias(f"__t_{c}") for c in space.types.categorical],
    )
    inputs = []
    for c in space.columns:
        separate = label is not None and c == space.target
        if c in space.indexers:
            model = space.indexers[c].copy({space.indexers[c].inputCol: f"__t_{c}"})
            staged = model.transform(staged)
            if space.is_label_encoded(c):
                staged = staged.withColumn(f"__i_{c}", F.when(named(f"__i_{c}") < len(space.labels(c)), named(f"__i_{c}")).otherwise(-1.0))
                source = f"__i_{c}"
            else:  # the indexer's extra "unknown" slot is the last one, and dropping it leaves zeros
                encoder = OneHotEncoder(inputCols=[f"__i_{c}"], outputCols=[f"__o_{c}"], dropLast=True, handleInvalid="error")
                staged = encoder.fit(staged).transform(staged)
                source = f"__o_{c}"
        else:
            value = numeric_of(df, c)
            if c in space.scale:
                low, width = space.scale[c]
                value = (value - F.lit(low)) / F.lit(width)
            staged = staged.withColumn(f"__n_{c}", value)
            source = f"__n_{c}"
        if separate:
            staged = staged.withColumn(label, named(source))
        else:
            inputs.append(source)
    assembled = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep").transform(staged)
    extra = [label] if label is not None else []
    return assembled.select(*[named(c) for c in df.columns], *[named(c) for c in extra], named(output))


def inverse_features(df: DataFrame, space: FeatureSpace, features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Back to columns; the largest entry of a block names the category, all-zero is NULL."""
    values = df.select(*[named(c) for c in keep or []], vector_to_array(named(features)).alias("__v"))
    restored, place = [], 0
    for c, size, _ in space.layout():
        if c in space.indexers:
            labels = literal_array(space.labels(c), "string")
            if space.is_label_encoded(c):
                value = F.get(labels, F.rint(F.get(F.col("__v"), F.lit(place))).cast("int"))
            else:
                block = F.slice(F.col("__v"), place + 1, size)
                value = F.when(
                    F.array_max(block) > 0, F.get(labels, (F.array_position(block, F.array_max(block)) - 1).cast("int"))
                )
        else:
            value = F.get(F.col("__v"), F.lit(place))
            value = F.when(~F.isnan(value), value)
            if c in space.scale:
                low, width = space.scale[c]
                value = value * F.lit(width) + F.lit(low)
            if c in space.integers:
                value = F.bround(value, 0).cast("bigint")
        restored.append(value.alias(c))
        place += size
    return values.select(*[named(c) for c in keep or []], *restored)


def value_ids(space: FeatureSpace) -> list[tuple[str, str, int, int, int]]:
    """(column, value, column position, discrete counter, value id) of every known category."""
    rows, counter = [], 0
    for position, c in enumerate(space.columns):
        if c in space.indexers:
            rows += [(c, value, position, counter, i) for i, value in enumerate(space.labels(c))]
            counter += 1
    return rows


def value_id(space: FeatureSpace, column: str, value: str) -> dict[str, int]:
    """Raises for an unknown column or value."""
    for c, v, position, counter, i in value_ids(space):
        if c == column and v == value:
            return {"column_id": position, "discrete_column_id": counter, "value_id": i}
    raise ValueError(f"{value!r} is not a known value of {column!r}")


# ----------------------------------------------------------------- mixtures I10
@dataclass
class MixtureSpace:
    model: GaussianMixtureModel
    kept: list[int]
    means: list[float]
    deviations: list[float]


def fit_mixture(df: DataFrame, column: str, components: int = 10, minimum_weight: float = 0.005, seed: int = 1000) -> MixtureSpace:
    """One-dimensional Gaussian mixture; light components are pruned."""
    value = numeric_of(df, column)
    rows = df.filter(value.isNotNull()).select(array_to_vector(F.array(value)).alias("v"))
    model = GaussianMixture(featuresCol="v", k=components, seed=seed, maxIter=50).fit(rows)
    kept = [i for i, w in enumerate(model.weights) if w > minimum_weight]
    gaussians = model.gaussians
    return MixtureSpace(
        model, kept, [float(gaussians[i].mean[0]) for i in kept],
        [max(math.sqrt(float(gaussians[i].cov.toArray()[0][0])), 1e-12) for i in kept],
    )


def encode_mixture(df: DataFrame, column: str, space: MixtureSpace, keys: list[str], seed: int = 0, output: str = "mode") -> DataFrame:
    """Draw a component by its posterior, scale by it, clip to +-0.99; `mode` = (scaled, component).

    The draw is tied to the key columns, so a repeated task draws the same.
    """
    present = df.filter(numeric_of(df, column).isNotNull()).withColumn("__v", array_to_vector(F.array(numeric_of(df, column))))
    model = space.model.copy({space.model.featuresCol: "__v", space.model.probabilityCol: "__p", space.model.predictionCol: "__k"})
    scored = model.transform(present).withColumn("__p", vector_to_array("__p"))
    weights = [F.get(F.col("__p"), F.lit(i)) + 1e-6 for i in space.kept]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    draw = seeded_uniform(seed, *[named(k) for k in keys]) * total
    running, chosen = F.lit(0.0), F.lit(len(space.kept) - 1)
    picks = []
    for i, w in enumerate(weights[:-1]):
        running = running + w
        picks.append(F.when(draw < running, i))
    chosen = F.coalesce(*picks, F.lit(len(space.kept) - 1))
    scored = scored.withColumn("__c", chosen)
    mean = F.get(literal_array(space.means), F.col("__c"))
    deviation = F.get(literal_array(space.deviations), F.col("__c"))
    scaled = clip((numeric_of(df, column) - mean) / (4 * deviation), -0.99, 0.99)
    return scored.select(
        *[named(c) for c in df.columns], F.struct(scaled.alias("scaled"), F.col("__c").alias("component")).alias(output)
    )


def decode_mixture(mode: Column, space: MixtureSpace) -> Column:
    """Scaled value and component back to a number."""
    index = mode["component"]
    return mode["scaled"] * 4 * F.get(literal_array(space.deviations), index) + F.get(literal_array(space.means), index)


# ------------------------------------------------------------ squared image I11
IMAGE_MARGIN = 1e-3


def square_scale(df: DataFrame, ranges: dict[str, tuple[float, float]], side: int, output: str = "image", keep: list[str] | None = None) -> DataFrame:
    """Cells scaled to [-1, 1] and laid out as a side x side grid, zero-padded."""
    room = side * side
    if room < len(ranges) and len(ranges) % side:
        raise ValueError("columns must fit the square or fill whole rows")
    cells = []
    for c, (low, high) in ranges.items():
        low, high = low - IMAGE_MARGIN, high + IMAGE_MARGIN
        cells.append((numeric_of(df, c) - F.lit(low)) / F.lit(high - low) * 2 - 1)
    flat = F.array(*cells, *[F.lit(0.0)] * max(0, room - len(cells)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(max(side, len(cells) // side) - 1)), lambda i: F.slice(F.col("__flat"), i * side + 1, side))
    return df.select(*[named(c) for c in keep or []], flat.alias("__flat")).select(*[named(c) for c in keep or []], rows.alias(output))


def square_unscale(df: DataFrame, ranges: dict[str, tuple[float, float]], discrete: set[str], image: str = "image", keep: list[str] | None = None) -> DataFrame:
    """Grid back to columns; category codes are rounded."""
    flat = F.flatten(named(image))
    values = []
    for i, (c, (low, high)) in enumerate(ranges.items()):
        low, high = low - IMAGE_MARGIN, high + IMAGE_MARGIN
        value = (F.get(flat, F.lit(i)) + 1) / 2 * F.lit(high - low) + F.lit(low)
        values.append((F.bround(value, 0) if c in discrete else value).alias(c))
    return df.select(*[named(c) for c in keep or []], *values)

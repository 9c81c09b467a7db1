"""Column profiles (I6) and plain metadata (K2)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.scalars import named, numeric_of
from veritab.operators.aggregates import sample_skewness
from veritab.operators.ranks import exact_quantiles, running_totals, top_values
from veritab.operators.sides import ColumnTypes, melt, text_of, types_by_dtype, types_by_parsing
from veritab.session import freeze

UNKNOWN = "[UNK]"
MISSING = "Missing"
# Profile limits.
HEAD = 50
EDGE_PIECES = 100
MIXED_THRESHOLD = 0.05
SKEW_LIMIT = 1.0
RATIO_LIMIT = 1000.0
SHIFT = 1e-6


@dataclass
class ColumnProfile:
    """What the driver knows of one column; bounded by HEAD (or the caller's `top_k`) and EDGE_PIECES.

    `tail` says that a category column has more values than `vocabulary`; the others
    follow it in the same order in `TableProfile.codes`.
    """

    name: str
    kind: str
    integer: bool = False
    vocabulary: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    minimum: float = 0.0
    maximum: float = 1.0
    mean: float = 0.0
    skewness: float = 0.0
    needs_log: bool = False
    log_shift: float = SHIFT
    norm_min: float = 0.0
    norm_max: float = 1.0
    edges: list[float] = field(default_factory=list)
    zero_share: float = 0.0
    tail: bool = False
    size: int = 0

    @property
    def ids(self) -> dict[str, int]:
        return {value: i for i, value in enumerate(self.vocabulary)}

    @property
    def missing_id(self) -> int:
        return self.ids.get(MISSING, 0)


@dataclass
class TableProfile:
    """Profiles keyed by lower-cased column name, in column order.

    `values` holds every categorical value with its count (column, value, n) as a table
    of any size; the vocabularies of the columns are its most frequent ones.
    """

    columns: dict[str, ColumnProfile]
    values: DataFrame | None = None
    rows: int = 0
    _codes: DataFrame | None = None

    def codes(self, column: str) -> DataFrame:
        """(value, id, n) of all values of a column: 1, 2, ... by falling count, then by value; 0 is the unknown token."""
        if self._codes is None:
            numbered = self.values.filter(F.col("value") != UNKNOWN).select("*", (-F.col("n")).alias("__order"), F.lit(1).alias("__one"))
            self._codes = freeze(running_totals(numbered, ["column"], ["__order", "value"], ["__one"]).select(
                "column", "value", F.col("running___one").cast("int").alias("id"), "n"
            ))
        return self._codes.filter(F.col("column") == self.of(column).name).select("value", "id", "n")

    def of(self, name: str) -> ColumnProfile:
        return self.columns[name.lower()]


def is_integer_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def log_form(value: Column, info: ColumnProfile) -> Column:
    return F.log(value + F.lit(info.log_shift)) if info.needs_log else value


def build_profile(
    df: DataFrame, types: ColumnTypes | None = None, mixed_threshold: float = MIXED_THRESHOLD, top_k: int | None = None
) -> TableProfile:
    """One pass for the moments, one for the edges, one grouped pass for the vocabularies.

    Categories keep all their values.  With `top_k` only that many do, and the rest is
    the unknown token.
    """
    types = types or types_by_dtype(df)
    infos: dict[str, ColumnProfile] = {}
    wide: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(types.numeric):
        value = numeric_of(df, c)
        wide += [
            F.count(value).alias(f"known{i}"),
            F.count_if(value == 0).alias(f"zeros{i}"),
        ]
        for tag, x in (("a", value), ("b", F.when(value != 0, value))):
            wide += [
                F.count(x).alias(f"{tag}n{i}"), F.min(x).alias(f"{tag}min{i}"), F.max(x).alias(f"{tag}max{i}"),
                F.avg(x).alias(f"{tag}mean{i}"), sample_skewness(x).alias(f"{tag}skew{i}"),
            ]
    for i, c in enumerate(types.categorical):
        wide.append(F.count_if(text_of(c, MISSING) == MISSING).alias(f"missing{i}"))
    row = df.agg(*wide).first()
    rows = row["rows"]

    cells: dict[str, Column] = {}
    for i, c in enumerate(types.numeric):
        zero_like = (row[f"zeros{i}"] + rows - row[f"known{i}"]) / rows if rows else 0.0
        mixed = zero_like > mixed_threshold and row[f"known{i}"] > 0
        tag = "b" if mixed else "a"
        info = ColumnProfile(
            c, "mixed" if mixed else "numerical", is_integer_type(df.schema[c].dataType),
            zero_share=zero_like if mixed else 0.0,
        )
        infos[c.lower()] = info
        if not row[f"{tag}n{i}"]:
            info.edges = [j / EDGE_PIECES for j in range(EDGE_PIECES + 1)]
            continue
        info.minimum, info.maximum = float(row[f"{tag}min{i}"]), float(row[f"{tag}max{i}"])
        info.mean = float(row[f"{tag}mean{i}"])
        skew = row[f"{tag}skew{i}"]
        info.skewness = 0.0 if skew is None or math.isnan(skew) else float(skew)
        wide_range = info.minimum > 0 and info.maximum / info.minimum > RATIO_LIMIT
        info.needs_log = abs(info.skewness) > SKEW_LIMIT or wide_range
        if info.needs_log:
            info.log_shift = abs(min(0.0, info.minimum)) + SHIFT
        cells[c] = numeric_of(df, c)
    logged = [c for c in cells if infos[c.lower()].needs_log]
    if logged:  # the same logarithm as the row expressions, so that the extremes map to exactly 0 and 1
        ends = []
        for i, c in enumerate(logged):
            info = infos[c.lower()]
            ends += [log_form(F.lit(info.minimum), info).alias(f"low{i}"), log_form(F.lit(info.maximum), info).alias(f"high{i}")]
        end = df.sparkSession.range(1).select(*ends).first()
    for c in cells:
        info = infos[c.lower()]
        info.norm_min, info.norm_max = info.minimum, info.maximum
        if info.needs_log:
            info.norm_min, info.norm_max = end[f"low{logged.index(c)}"], end[f"high{logged.index(c)}"]
        if info.norm_max <= info.norm_min:
            info.norm_max = info.norm_min + 1.0
        value = cells[c]
        if info.kind == "mixed":
            value = F.when(value != 0, value)
        cells[c] = (log_form(value, info) - F.lit(info.norm_min)) / F.lit(info.norm_max - info.norm_min)
    for c, edges in exact_quantiles(df, cells, EDGE_PIECES).items():
        distinct = sorted(set(edges))
        if len(distinct) < EDGE_PIECES + 1:  # Q21: any tie falls back to the uniform grid
            distinct = [j / EDGE_PIECES for j in range(EDGE_PIECES + 1)]
        infos[c.lower()].edges = distinct

    counts = None
    if types.categorical:
        counts = melt(df, {c: text_of(c, MISSING) for c in types.categorical}, []).groupBy("column", "value").agg(
            F.count("*").alias("n")
        )
        counts = freeze(counts)
        sizes = {r["column"]: r["count"] for r in counts.filter(F.col("value") != UNKNOWN).groupBy("column").count().collect()}
        best: dict[str, list[tuple[str, int]]] = {c: [] for c in types.categorical}
        for r in top_values(counts, ["column"], (HEAD if top_k is None else top_k) + 1).orderBy("column", "rank").collect():
            best[r["column"]].append((r["value"], r["n"]))
        for i, c in enumerate(types.categorical):
            chosen = [(v, n) for v, n in best[c] if v != UNKNOWN][: HEAD if top_k is None else top_k]
            tail = top_k is None and sizes.get(c, 0) > len(chosen)
            if not tail and row[f"missing{i}"] and MISSING not in [v for v, _ in chosen]:
                chosen = [*chosen, (MISSING, row[f"missing{i}"])]
            mass = [n / rows for _, n in chosen]
            weights = [max(0.0, 1.0 - sum(mass)), *mass]
            total = sum(weights)
            infos[c.lower()] = ColumnProfile(
                c, "categorical", vocabulary=[UNKNOWN, *[v for v, _ in chosen]],
                weights=[w / total for w in weights] if total > 0 else weights,
                tail=tail, size=1 + (sizes[c] if tail else len(chosen)),
            )
    return TableProfile({c.lower(): infos[c.lower()] for c in df.columns if c.lower() in infos}, counts, rows)


PROFILE_SCHEMA = (
    "column string, kind string, integer boolean, vocabulary array<string>, weights array<double>, minimum double, "
    "maximum double, mean double, skewness double, needs_log boolean, log_shift double, norm_min double, norm_max double, "
    "edges array<double>"
)


def profile_frame(spark: SparkSession, profile: TableProfile) -> DataFrame:
    """The profile as a table, one row per column."""
    rows = [
        (
            key, p.kind, p.integer, p.vocabulary, [float(w) for w in p.weights], p.minimum, p.maximum, p.mean, p.skewness,
            p.needs_log, p.log_shift, p.norm_min, p.norm_max, p.edges,
        )
        for key, p in profile.columns.items()
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


@dataclass
class SchemaMetadata:
    """K2: ranges on the driver, categories as a table (column, value) of any size."""

    numeric: dict[str, tuple[float, float, str]]
    categories: DataFrame | None
    sizes: dict[str, int]


def schema_metadata(
    df: DataFrame, categorical: list[str] | None = None, numeric: list[str] | None = None, null_text: str = "?"
) -> SchemaMetadata:
    """K2: declared types, the rest by the 95 % parsing rule; kind `int` when all values are whole."""
    declared_cat, declared_num = set(categorical or []), set(numeric or [])
    open_columns = [c for c in df.columns if c not in declared_cat | declared_num]
    parsed = types_by_parsing(df.select([named(c) for c in open_columns])) if open_columns else ColumnTypes([], [])
    nums = [c for c in df.columns if c in declared_num or c in set(parsed.numeric)]
    cats = [c for c in df.columns if c not in set(nums)]
    ranges: dict[str, tuple[float, float, str]] = {}
    if nums:
        wide = []
        for i, c in enumerate(nums):
            x = numeric_of(df, c)
            off = F.abs(x - F.rint(x)) > 1e-8 + 1e-5 * F.abs(F.rint(x))
            wide += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.bool_or(off).alias(f"off{i}")]
        row = df.agg(*wide).first()
        ranges = {c: (row[f"min{i}"], row[f"max{i}"], "float" if row[f"off{i}"] else "int") for i, c in enumerate(nums)}
    if not cats:
        return SchemaMetadata(ranges, None, {})
    categories = melt(df, {c: text_of(c, null_text) for c in cats}, []).distinct()
    sizes = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
    return SchemaMetadata(ranges, categories, sizes)


def metadata_frame(df: DataFrame, metadata: SchemaMetadata) -> DataFrame:
    """K2 as a table: (name, dtype, min, max, kind, categories = number of values)."""
    rows = [(c, "num", float(lo), float(hi), kind, None) for c, (lo, hi, kind) in metadata.numeric.items()]
    rows += [(c, "cat", None, None, None, int(n)) for c, n in metadata.sizes.items()]
    schema = "name string, dtype string, min double, max double, kind string, categories bigint"
    return df.sparkSession.createDataFrame(rows, schema)

"""Row labels: bins, residuals and category ids per cell, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.binning import is_uniform_grid, with_edge_counts
from veritab.functions.scalars import clip, literal_array, literal_map, lookup, named, numeric_of
from veritab.operators.profile import MISSING, UNKNOWN, ColumnProfile, TableProfile, log_form
from veritab.operators.ranks import attach_by_value

# Filler of unused label slots and the column type ids.
IGNORE = -100
TYPE_IDS = {"numerical": 0, "categorical": 1, "mixed": 2}
TINY = 1e-9


def normalized(value: Column, info: ColumnProfile) -> Column:
    """Value -> (log) -> [0, 1]; the tiny addend keeps Q25."""
    z = (log_form(value, info) - F.lit(info.norm_min)) / F.lit(info.norm_max - info.norm_min + TINY)
    return clip(z, 0.0, 1.0)


def bin_of(z: Column, below: Column | None, info: ColumnProfile) -> Column:
    """Bin of a normalised value; `below` counts the edges up to it where they are no uniform grid."""
    last = len(info.edges) - 2
    if below is None:
        return F.least(F.floor(z * (last + 1)).cast("int"), F.lit(last))
    return F.when(below.isNotNull(), F.greatest(F.least(below - 1, F.lit(last)), F.lit(0)))


def bounds_of(index: Column, info: ColumnProfile) -> tuple[Column, Column]:
    """Lower edge and width of a bin."""
    if is_uniform_grid(info.edges):
        pieces = len(info.edges) - 1
        return index / F.lit(float(pieces)), F.lit(1.0 / pieces)
    edges = literal_array(info.edges)
    lower = F.get(edges, index)
    return lower, F.greatest(F.get(edges, index + 1) - lower, F.lit(TINY))


def label_struct(num_bin, num_res, cat_id, mixed_mask, mixed_bin, mixed_res, type_id) -> Column:
    parts = {
        "num_bin": (num_bin, "int"), "num_res": (num_res, "double"), "cat_id": (cat_id, "int"),
        "mixed_mask": (mixed_mask, "double"), "mixed_bin": (mixed_bin, "int"), "mixed_res": (mixed_res, "double"),
        "col_type_id": (type_id, "int"),
    }
    return F.struct(*[
        (value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name) for name, (value, kind) in parts.items()
    ])


def category_id(text: Column, info: ColumnProfile) -> Column:
    """Exact spelling first, then lower case, else the unknown id; NULL is the missing id."""
    lowered: dict[str, int] = {}
    for value, i in info.ids.items():
        lowered[value.lower()] = i
    found = F.coalesce(
        lookup(literal_map(info.ids), text), lookup(literal_map(lowered), F.lower(text)), F.lit(0)
    )
    return F.when(text.isNull(), F.lit(info.missing_id)).otherwise(found)


def with_category_id(df: DataFrame, text: Column, profile: TableProfile, info: ColumnProfile, output: str) -> DataFrame:
    """`category_id` over all values of a column that has more than the driver knows.

    Frequent values are broadcast and the others joined; texts that have no value of
    their spelling are looked up in lower case, of which the last value counts.
    """
    codes = profile.codes(info.name)
    lowered = codes.groupBy(F.lower("value").alias("__low")).agg(F.max("id").alias("__low_id"), F.sum("n").alias("n"))
    rows = df.withColumn("__text", F.coalesce(text, F.lit(MISSING)))
    exact = attach_by_value(rows, codes.select("value", F.col("id").alias("__exact"), "n"), "__text", "n", profile.rows, ["__exact"])
    known = exact.withColumn("__rest", F.when(F.col("__exact").isNull() & text.isNotNull(), F.lower("__text")))
    # texts that are known need no second look: they travel under themselves, which meets nothing there
    spread = known.withColumn("__rest_key", F.when(F.col("__rest").isNotNull(), F.concat(F.lit("l"), "__rest")).otherwise(F.concat(F.lit("x"), F.xxhash64(*df.columns).cast("string"))))
    second = lowered.select(F.concat(F.lit("l"), "__low").alias("__low"), "__low_id", "n").withColumnRenamed("__low", "value")
    found = attach_by_value(spread, second, "__rest_key", "n", profile.rows, ["__low_id"], "value")
    return found.select(*[named(c) for c in df.columns], F.coalesce("__exact", "__low_id", F.lit(0)).alias(output))


def encode_labels(df: DataFrame, profile: TableProfile, output: str = "labels", keep: list[str] | None = None) -> DataFrame:
    """One label struct per column, in column order, as an array.

    Works in several projections, so that a cell's bin is computed once and used for
    its residual as well.
    """
    keep = list(keep if keep is not None else df.columns)
    kept = [named(c) for c in keep]
    infos = list(profile.columns.values())
    first, second = [], []
    for i, info in enumerate(infos):
        if info.tail:
            df = with_category_id(df, named(info.name).cast("string"), profile, info, f"__wide{i}")
            first.append(F.col(f"__wide{i}").alias(f"__c{i}"))
        elif info.kind == "categorical":
            first.append(category_id(named(info.name).cast("string"), info).alias(f"__c{i}"))
        else:
            value = numeric_of(df, info.name)
            used = F.coalesce(value, F.lit(info.mean)) if info.kind == "numerical" else F.when(value != 0, value)
            first.append(normalized(used, info).alias(f"__z{i}"))
    step = df.select(*kept, *first)
    numbers = {i: info for i, info in enumerate(infos) if info.kind != "categorical"}
    searched = {f"__e{i}": (F.col(f"__z{i}"), info.edges, True) for i, info in numbers.items() if not is_uniform_grid(info.edges)}
    step = with_edge_counts(step, searched)
    step = step.select("*", *[
        bin_of(F.col(f"__z{i}"), F.col(f"__e{i}") if f"__e{i}" in searched else None, info).alias(f"__b{i}")
        for i, info in numbers.items()
    ])
    for i, info in enumerate(infos):
        type_id = TYPE_IDS[info.kind]
        if info.kind == "categorical":
            second.append(label_struct(IGNORE, 0.0, F.col(f"__c{i}"), 0.0, IGNORE, 0.0, type_id))
            continue
        z, index = F.col(f"__z{i}"), F.col(f"__b{i}")
        lower, width = bounds_of(index, info)
        residual = clip((z - lower) / width, 0.0, 1.0)
        if info.kind == "numerical":
            second.append(label_struct(index, residual, IGNORE, 0.0, IGNORE, 0.0, type_id))
        else:
            present = z.isNotNull()
            second.append(label_struct(
                IGNORE, 0.0, IGNORE, present.cast("double"), F.when(present, index).otherwise(IGNORE),
                F.when(present, residual).otherwise(0.0), type_id,
            ))
    return step.select(*kept, F.array(*second).alias(output))


def decode_numeric(index: Column, residual: Column, info: ColumnProfile) -> Column:
    """I8: bin and residual to a value; whole numbers are rounded half-even (Q22)."""
    safe = F.greatest(F.least(index, F.lit(len(info.edges) - 2)), F.lit(0))
    lower, width = bounds_of(safe, info)
    z = clip(lower + residual * width, 0.0, 1.0)
    value = z * F.lit(info.norm_max - info.norm_min) + F.lit(info.norm_min)
    if info.needs_log:
        value = F.exp(value) - F.lit(info.log_shift)
    return F.bround(value, 0) if info.integer else value


def decode_category(index: Column, info: ColumnProfile) -> Column:
    """I8: id to value, an invalid id to the unknown token."""
    return F.coalesce(F.get(literal_array(info.vocabulary, "string"), index), F.lit(info.vocabulary[0]))


def decode_labels(df: DataFrame, profile: TableProfile, labels: str = "labels", keep: list[str] | None = None) -> DataFrame:
    """I8: labels back to typed columns."""
    values = []
    for i, info in enumerate(profile.columns.values()):
        label = F.get(F.col(labels), F.lit(i))
        if info.tail:
            words = profile.codes(info.name).select(F.col("id").alias("value"), F.col("value").alias(f"__word{i}"), "n")
            df = attach_by_value(df.withColumn("__id", label["cat_id"]), words, "__id", "n", profile.rows, [f"__word{i}"]).drop("__id")
            value = F.coalesce(f"__word{i}", F.lit(UNKNOWN))
        elif info.kind == "categorical":
            value = decode_category(label["cat_id"], info)
        elif info.kind == "numerical":
            value = decode_numeric(label["num_bin"], label["num_res"], info)
        else:
            value = F.when(label["mixed_mask"] < 0.5, 0.0).otherwise(
                decode_numeric(label["mixed_bin"], label["mixed_res"], info)
            )
        if info.integer:
            value = value.cast("bigint")
        values.append(value.alias(info.name))
    return df.select(*[named(c) for c in keep or []], *values)

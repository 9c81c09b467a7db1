"""Row cleaning, filters and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.scalars import (
    infinite_to_null, is_numeric_type, literal_map, lookup, missing_text, named, numeric_of,
)
from veritab.operators.ranks import running_totals


LITERAL_LABELS = 1000


def normalize_missing(df: DataFrame) -> DataFrame:
    """B4 for all columns; numbers stay numbers with NULL for "missing"."""
    return df.select(
        [
            missing_text(named(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, T.StringType)
            else named(f.name)
            for f in df.schema
        ]
    )


def has_token(columns: list[str], token: str) -> Column:
    cells = F.array(*[named(c).cast("string") for c in columns])
    return F.exists(cells, lambda cell: F.coalesce(cell == F.lit(token), F.lit(False)))


def drop_rows_with_token(df: DataFrame, columns: list[str], token: str = "[UNK]") -> DataFrame:
    """B5."""
    return df.filter(~has_token(columns, token))


def token_counts(df: DataFrame, columns: list[str], token: str = "[UNK]") -> DataFrame:
    """Rows kept and dropped, in one pass."""
    hit = has_token(columns, token)
    return df.agg(F.count_if(~hit).alias("kept"), F.count_if(hit).alias("dropped"))


def subset_and_cast(df: DataFrame, label: str, allowed: list, text: list[str], numbers: list[str]) -> DataFrame:
    """Keep the allowed labels, cast columns to text or double, lower-case the names."""
    kept = df.filter(named(label).isin(allowed))
    chosen = [named(c).cast("string").alias(c.lower()) for c in text]
    chosen += [numeric_of(df, c).alias(c.lower()) for c in numbers]
    return kept.select(*chosen)


def target_first(df: DataFrame, target: str) -> DataFrame:
    """Label column first; unchanged when there is none."""
    if target not in df.columns:
        return df
    return df.select(named(target), *[named(c) for c in df.columns if c != target])


def nullable_columns(df: DataFrame) -> list[str]:
    """Numeric columns that hold at least one NULL, in one pass."""
    names = [f.name for f in df.schema if is_numeric_type(f.dataType)]
    if not names:
        return []
    row = df.agg(*[F.bool_or(numeric_of(df, c).isNull()).alias(c) for c in names]).first()
    return [c for c in names if row[c]]


def null_sentinel(df: DataFrame, columns: list[str], value: float = -1) -> DataFrame:
    """Fill NULL by the sentinel in the given columns."""
    types = {f.name: f.dataType for f in df.schema}
    chosen = set(columns)
    return df.select(
        [
            F.coalesce(numeric_of(df, c), F.lit(value)).cast(types[c]).alias(c) if c in chosen else named(c)
            for c in df.columns
        ]
    )


def restore_nulls(df: DataFrame, columns: list[str], value: float = -1) -> DataFrame:
    """Sentinel back to NULL."""
    chosen = set(columns)
    return df.select([F.nullif(named(c), F.lit(value)).alias(c) if c in chosen else named(c) for c in df.columns])


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    """B14."""
    return df.filter(named(target).isNotNull())


def drop_infinite(df: DataFrame) -> DataFrame:
    """B15 for all floating columns."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select([infinite_to_null(named(c)).alias(c) if c in floating else named(c) for c in df.columns])


def null_count(columns: list[str]) -> Column:
    """Missing cells of a row."""
    total = F.lit(0)
    for c in columns:
        total = total + named(c).isNull().cast("int")
    return total


def split_complete(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without NULL, rows with at least one)."""
    missing = null_count(columns or df.columns)
    return df.filter(missing == 0), df.filter(missing > 0)


def incomplete_rows(df: DataFrame, columns: list[str] | None = None, token: str = "placeholder") -> DataFrame:
    """Rows with a cell that was never parsed."""
    return df.filter(has_token(columns or df.columns, token))


def keep_known_labels(df: DataFrame, fit: DataFrame, target: str, output: str = "label_id") -> DataFrame:
    """Id of the label in the fit table's sorted labels; rows with unseen labels leave."""
    values = fit.select(F.coalesce(named(target).cast("string"), F.lit("__NA__")).alias("v")).distinct()
    text = F.coalesce(named(target).cast("string"), F.lit("__NA__"))
    labels = sorted((row["v"] for row in values.limit(LITERAL_LABELS + 1).collect()), key=lambda text: text.encode())
    if len(labels) <= LITERAL_LABELS:
        ids = literal_map({v: i for i, v in enumerate(labels)})
        return df.withColumn(output, F.coalesce(lookup(ids, text), F.lit(-1))).filter(F.col(output) >= 0)
    numbered = running_totals(values.withColumn("__all", F.lit(1)).withColumn("__one", F.lit(1)), ["__all"], ["v"], ["__one"])
    table = numbered.select(F.col("v").alias("__text"), (F.col("running___one") - 1).cast("int").alias(output))
    return df.withColumn("__text", text).join(table, "__text").drop("__text")


def dictionary_lookup(text: Column, ids: dict[str, int], default: int = 0, ignore_case: bool = False) -> Column:
    """Id of a value, a second try in lower case when asked, else `default`."""
    found = lookup(literal_map(ids), text)
    if ignore_case:
        lowered: dict[str, int] = {}
        for value, i in ids.items():
            lowered[value.lower()] = i
        found = F.coalesce(found, lookup(literal_map(lowered), F.lower(text)))
    return F.coalesce(found, F.lit(default))


def canonical_spelling(text: Column, values: list[str]) -> Column:
    """Known value with its own spelling, whatever the case of the text; else NULL."""
    spelling = {value.lower(): value for value in values}
    return lookup(literal_map(spelling, "string", "string"), F.lower(text))


def repair_rows(table: DataFrame, profile, dropna: bool = False, integer_round: bool = False) -> DataFrame:
    """Fit produced text rows to a profile (`veritab.operators.profile.TableProfile`).

    Categories regain their known spelling, of all values of the profiled table, and
    unknown ones become NULL; numbers are parsed and take the profiled kind; the text `None` is NULL.  Columns come back
    under the profiled names.  With `dropna`, incomplete rows leave.
    """
    by_lower = {c.lower(): c for c in table.columns}
    if sorted(by_lower) != sorted(profile.columns):
        raise ValueError(f"columns differ from the profile: {sorted(set(by_lower) ^ set(profile.columns))}")
    repaired, found = [], table
    for i, (key, info) in enumerate(profile.columns.items()):
        source = by_lower[key]
        if info.kind == "categorical":
            # every value of the profiled table, by its most frequent spelling
            known = profile.values.where((F.col("column") == info.name) & ~F.col("value").isin("[UNK]", "None"))
            spelled = known.groupBy(F.lower("value").alias(f"__key{i}")).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias(f"__value{i}"))
            found = found.join(spelled, F.lower(named(source).cast("string")) == F.col(f"__key{i}"), "left")
            value = F.col(f"__value{i}")
        else:
            value = numeric_of(table, source)
            if info.integer:
                whole = F.bround(value) if integer_round else value
                value = F.when(whole == F.floor(whole), whole.try_cast("bigint"))
        repaired.append(value.alias(info.name))
    result = found.select(*repaired)
    return result.na.drop() if dropna else result


def first_or_last_by_key(df: DataFrame, keys: list[str], position: str, values: list[str], last: bool = True) -> DataFrame:
    """One row per key holding the values at its first or last position."""
    pick = F.max_by if last else F.min_by
    packed = F.struct(*[named(v) for v in values])
    return df.groupBy(*[named(k) for k in keys]).agg(pick(packed, named(position)).alias("p")).select(
        *[named(k) for k in keys], "p.*"
    )


def every_nth(df: DataFrame, column: str, step: int) -> DataFrame:
    """Rows whose step counter is a multiple of `step`."""
    return df.filter(F.pmod(named(column), F.lit(step)) == 0)


def head_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """E5: first n rows in a stated order."""
    return df.orderBy(*order).limit(n)

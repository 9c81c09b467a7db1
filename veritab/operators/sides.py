"""Tables under comparison as one tagged table, type policies and alignment.

Real and fake rows travel in one DataFrame with a `side` column, so that every
metric is one conditional aggregation and never a join of two frequency tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.scalars import is_numeric_type, named, numeric_of

SIDE = "side"
REAL = "real"
FAKE = "fake"


def tag_sides(real: DataFrame, fake: DataFrame, policy: str = "same") -> DataFrame:
    """Union of both tables with their `side`; columns follow `align_columns`."""
    real, fake = align_columns(real, fake, policy)
    fake = align_types(fake, real)
    return real.withColumn(SIDE, F.lit(REAL)).unionByName(fake.withColumn(SIDE, F.lit(FAKE)))


def on_side(name: str) -> Column:
    return F.col(SIDE) == name


def data_columns(pair: DataFrame) -> list[str]:
    return [name for name in pair.columns if name != SIDE]


def align_columns(real: DataFrame, fake: DataFrame, policy: str = "same") -> tuple[DataFrame, DataFrame]:
    """`same` needs equal names, `shared` keeps the common ones, `subset` needs all of real's."""
    if policy == "same":
        if sorted(real.columns) != sorted(fake.columns):
            raise ValueError(f"column names differ: {sorted(set(real.columns) ^ set(fake.columns))}")
        names = real.columns
    elif policy == "shared":
        names = [name for name in real.columns if name in set(fake.columns)]
    elif policy == "subset":
        missing = sorted(set(real.columns) - set(fake.columns))
        if missing:
            raise ValueError(f"missing columns: {missing}")
        names = real.columns
    else:
        raise ValueError(f"unknown policy {policy!r}")
    chosen = [named(name) for name in names]
    return real.select(chosen), fake.select(chosen)


def align_types(fake: DataFrame, real: DataFrame) -> DataFrame:
    """Cast each column of `fake` to the type it has in `real`."""
    wanted = {field.name: field.dataType for field in real.schema}
    return fake.select(
        [
            named(f.name) if f.name not in wanted or f.dataType == wanted[f.name]
            else named(f.name).try_cast(wanted[f.name]).alias(f.name)
            for f in fake.schema
        ]
    )


def check_flat(df: DataFrame) -> None:
    """Reject nested columns: tables under study are flat."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise ValueError(f"nested columns are not supported: {nested}")


@dataclass(frozen=True)
class ColumnTypes:
    numeric: list[str]
    categorical: list[str]


def types_by_dtype(df: DataFrame, skip: tuple[str, ...] = (SIDE,)) -> ColumnTypes:
    """Policy `dtype`: numeric storage type means numeric."""
    check_flat(df)
    fields = [f for f in df.schema if f.name not in skip]
    timed = (T.TimestampType, T.DateType)
    numeric = [f.name for f in fields if is_numeric_type(f.dataType) or isinstance(f.dataType, timed)]
    return ColumnTypes(numeric, [f.name for f in fields if f.name not in set(numeric)])


def parse_rates(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of values that read as a number, NULL counting as a failure; one job."""
    row = df.agg(*[F.avg(numeric_of(df, c).isNotNull().cast("int")).alias(c) for c in columns]).first()
    return {c: (row[c] or 0.0) for c in columns}


def types_by_parsing(
    df: DataFrame, target: str | None = None, threshold: float = 0.95, strict: bool = False
) -> ColumnTypes:
    """Policies `parse95` (share >= threshold) and `parse80` (`strict`: share > threshold)."""
    check_flat(df)
    columns = [c for c in df.columns if c not in (target, SIDE)]
    rates = parse_rates(df, columns)
    numeric = [c for c in columns if (rates[c] > threshold if strict else rates[c] >= threshold)]
    return ColumnTypes(numeric, [c for c in columns if c not in set(numeric)])


def text_of(name: str, null_text: str) -> Column:
    """Value as text with its own spelling for NULL (Q17: never the string of a cast NULL)."""
    return F.coalesce(named(name).cast("string"), F.lit(null_text))


def melt(df: DataFrame, cells: dict[str, Column], keep: list[Column], name: str = "column", value: str = "value") -> DataFrame:
    """One row per (input row, column): the narrow form all per-column work uses."""
    entries = [F.struct(F.lit(c).alias(name), cell.alias(value)) for c, cell in cells.items()]
    exploded = df.select(*keep, F.explode(F.array(*entries)).alias("cell"))
    kept = [F.col(k) for k in exploded.columns if k != "cell"]
    return exploded.select(*kept, F.col(f"cell.{name}").alias(name), F.col(f"cell.{value}").alias(value))

"""Scalar column functions: cleaning, text case, numbers, seeded randomness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a missing value in cleaned text tables.
MISSING_SPELLINGS = ["?", "na", "nan"]
# Text form of a number as accepted by `to_number`.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def named(name: str) -> Column:
    """Column by exact name, safe for names holding `-`, `/`, `.` or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def to_number(column: Column, dtype: T.DataType | None = None) -> Column:
    """Value as double, NULL when it is not a number; NaN becomes NULL.

    Text must look like a plain decimal number: Java's parser alone would also
    accept spellings such as `12d`.
    """
    if dtype is None or isinstance(dtype, T.StringType):
        text = column.cast("string")
        number = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    elif isinstance(dtype, (T.TimestampType, T.DateType)):
        number = column.cast("timestamp").cast("double")
    else:
        number = column.cast("double")
        if not isinstance(dtype, (T.FloatType, T.DoubleType)):
            return number
    return F.when(~F.isnan(number), number)


def numeric_of(df: DataFrame, name: str) -> Column:
    return to_number(named(name), df.schema[name].dataType)


def strip_blanks(column: Column) -> Column:
    """Remove blanks, tabs and line breaks at both ends."""
    return F.btrim(column, F.lit(" \t\n\r\x0b\x0c"))


def capitalize(column: Column) -> Column:
    """B1: trimmed text, first character upper-case and all others lower-case."""
    text = F.trim(column)
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**31 - 1)))


def hyphenate(column: Column) -> Column:
    """B2: `capitalize`, then each run of blanks becomes one hyphen."""
    return F.regexp_replace(capitalize(column), r"\s+", "-")


def hyphenate_names(df: DataFrame) -> DataFrame:
    """B2: lower-case column names with blanks as hyphens."""
    return df.toDF(*["-".join(name.strip().lower().split()) for name in df.columns])


def strip_chars(column: Column, chars: str = ".") -> Column:
    """Remove leading and trailing characters of the given set."""
    return F.btrim(column, F.lit(chars))


def missing_text(column: Column, dtype: T.DataType) -> Column:
    """NULL and the usual spellings of "unknown" become one lower-case token."""
    if not isinstance(dtype, T.StringType):
        return F.coalesce(column.cast("string"), F.lit("MISSING"))
    text = F.lower(F.trim(F.coalesce(column, F.lit("MISSING"))))
    return F.when(text.isin(MISSING_SPELLINGS), "missing").otherwise(text)


def letter_case(column: Column) -> Column:
    """Name of the case of a word: upper, lower, title, capitalize (else lower).

    A word without letters has no case of its own and counts as lower.
    """
    has_letter = column.rlike(r"\p{L}")
    return (
        F.when(has_letter & (column == F.upper(column)), "upper")
        .when(has_letter & (column == F.lower(column)), "lower")
        .when(column.rlike(r"^\P{L}*\p{Lu}\p{Ll}*(\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$"), "title")
        .when(column.rlike(r"^\p{Lu}") & ~column.rlike(r"^\p{L}+$"), "capitalize")
        .otherwise("lower")
    )


def apply_case(column: Column, case: Column) -> Column:
    return (
        F.when(case == "upper", F.upper(column))
        .when(case == "title", F.initcap(column))
        .when(case == "capitalize", capitalize(column))
        .otherwise(F.lower(column))
    )


def infinite_to_null(column: Column) -> Column:
    """B15."""
    return F.when(F.abs(column) != F.lit(math.inf), column)


def unescape_newlines(column: Column) -> Column:
    """A written-out backslash-n becomes a line break."""
    return F.replace(column, F.lit("\\n"), F.lit("\n"))


def strip_leading_breaks(column: Column) -> Column:
    """Drop leading line breaks of produced text."""
    return F.ltrim(column, F.lit("\r\n"))


def clip(column: Column, low, high) -> Column:
    """Limit to [low, high]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(column.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), column)))


def truncate_digits(column: Column, digits: int) -> Column:
    """Cut (not round) after `digits` decimals, towards minus infinity."""
    scale = 10.0**digits
    return F.floor(column * scale) / scale


def normalize_score(score: Column, low: float, high: float, goal: str = "maximize") -> Column:
    """Map a score in [low, high] to [0, 1]; out-of-range raises at run time."""
    if math.isfinite(low) and math.isfinite(high):
        unit = (score - low) / (high - low)
    elif math.isfinite(high):
        unit = F.exp(score - high)
    elif math.isfinite(low):
        unit = 1 - F.exp(low - score)
    else:
        unit = 1 / (1 + F.exp(-score))
    if goal == "minimize":
        unit = 1 - unit
    checks = []
    if math.isfinite(low):
        checks.append(score < low)
    if math.isfinite(high):
        checks.append(score > high)
    for bad in checks:
        message = F.concat(F.lit("score outside its range: "), score.cast("string"))
        unit = F.when(bad, F.raise_error(message).cast("double")).otherwise(unit)
    return unit


def seeded_hash(seed: int, *columns: Column) -> Column:
    """64-bit hash of the columns under a seed; the same on every run and retry."""
    return F.xxhash64(F.lit(int(seed)).cast("long"), *columns)


def seeded_uniform(seed: int, *columns: Column) -> Column:
    """Uniform number in [0, 1) tied to the given key columns: 52 bits of the MD5 of `seed:key:...`, which any engine can repeat."""
    text = F.concat_ws(":", F.lit(str(int(seed))), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") * F.lit(2.0**-52)


def seeded_normal(seed: int, *columns: Column) -> Column:
    """Standard normal number tied to the given key columns (polar transform)."""
    first = 1 - seeded_uniform(seed * 2 + 1, *columns)
    second = seeded_uniform(seed * 2 + 2, *columns)
    return F.sqrt(-2 * F.log(first)) * F.cos(2 * math.pi * second)


def literal_array(values, dtype: str = "double") -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{dtype}>")


def literal_map(mapping: dict, key: str = "string", value: str = "int") -> Column:
    """Small dictionary as a map literal; an empty one keeps its type."""
    if not mapping:
        return F.expr(f"map_from_arrays(cast(array() as array<{key}>), cast(array() as array<{value}>))")
    return F.map_from_arrays(literal_array(mapping.keys(), key), literal_array(mapping.values(), value))


def lookup(mapping: Column, key: Column) -> Column:
    """Map lookup that yields NULL for an unknown or NULL key."""
    return F.when(key.isNotNull(), F.try_element_at(mapping, key))

"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.scalars import named


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN is a missing value everywhere in this package."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        [F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floating else named(c) for c in df.columns]
    )


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, preview: int | None = None
) -> DataFrame:
    """A1: headered CSV or Parquet, by suffix.  `schema` spares CSV the inference pass; `preview` limits rows."""
    first = path if isinstance(path, str) else path[0]
    if first.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        df = reader.csv(path)
    df = nan_to_null(df)
    return df if preview is None else df.limit(preview)


def read_headerless(spark: SparkSession, path: str | list[str], names: list[str], skip_line: str | None = None) -> DataFrame:
    """A2: CSV without header; text columns under the given names.

    `skip_line` is a pattern of lines to leave out (the remark some test files start
    with), decided line by line so that files stay splittable.
    """
    lines = spark.read.text(path)
    if skip_line is not None:
        lines = lines.filter(~F.col("value").rlike(skip_line))
    lines = lines.filter(F.length(F.trim("value")) > 0)
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = lines.select(F.from_csv("value", _ddl(names), options).alias("r"))
    return parsed.select([F.col("r").getField(name).alias(name) for name in names])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name}` string" for name in names)


def read_tagged(spark: SparkSession, paths: dict[str, str], tag: str = "method", sep: str = "\t") -> DataFrame:
    """A3: several headered logs, each marked with its label; header names are trimmed."""
    result = None
    for label, path in paths.items():
        part = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
        part = part.toDF(*[name.strip() for name in part.columns]).withColumn(tag, F.lit(label))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    if result is None:
        raise ValueError("no paths given")
    return result


def report_name(path: Column) -> Column:
    """Dataset name of a report: the part of its path between `report_` and `.csv`."""
    return F.regexp_extract(F.url_decode(path), r"/report_([^/]*?)\.csv(/|$)", 1)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """A4: all `report_*.csv` files (or folders of CSV parts) with their `dataset` name.

    Reports come with several headers (with and without `bins`), and CSV columns are
    positional; lines are therefore parsed by the header of their own file.  Headers
    are found in the data, and there are as many as layouts, not as files.
    A score that is missing or no number is NULL; its line stays.
    """
    lines = spark.read.text(f"{folder}/report_*.csv").select(
        "value", report_name(F.col("_metadata.file_path")).alias("dataset"), F.col("_metadata.file_path").alias("path")
    )
    is_header = F.col("value").rlike("^real_path,")
    headers = lines.filter(is_header).groupBy("path").agg(F.min("value").alias("header"))
    layouts = [row["header"] for row in headers.select("header").distinct().collect()]
    if not layouts:
        raise ValueError(f"no reports under {folder}")
    body = lines.filter(~is_header & (F.length("value") > 0)).join(headers, "path")
    result = None
    for layout in layouts:
        names = layout.strip().split(",")
        part = body.filter(F.col("header") == layout).select("dataset", F.from_csv("value", _ddl(names)).alias("r"))
        part = part.select("dataset", *[F.col("r").getField(name).alias(name) for name in names])
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    numbers = {"score": "double", "bins": "double", "real_size": "bigint", "fake_size": "bigint"}
    for name, kind in numbers.items():
        if name in result.columns:
            result = result.withColumn(name, F.col(name).try_cast(kind))
    return result


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: Parquet when the path ends so, else headered CSV."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).option("header", True).csv(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[named(c) for c in df.columns])).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row; nested maps and structs allowed."""
    as_json_lines(df).write.mode(mode).text(path)


def write_text_lines(df: DataFrame, column: str, path: str) -> None:
    """Append one text per line; line breaks inside a text are written as backslash-n."""
    text = F.replace(F.replace(named(column), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))
    df.select(text.alias("value")).write.mode("append").text(path)


def append_tables(raw: DataFrame, processed: DataFrame, log: DataFrame, folder: str) -> None:
    """Append raw rows, accepted rows and one log row; nothing is read back."""
    raw.write.mode("append").parquet(f"{folder}/raw.parquet")
    processed.write.mode("append").parquet(f"{folder}/processed.parquet")
    log.write.mode("append").parquet(f"{folder}/log.parquet")


def even_shares(spark: SparkSession, total: int, workers: int) -> DataFrame:
    """A10: rows per worker; the remainder goes to the first ones."""
    base, rest = divmod(total, workers)
    return spark.range(workers).select(
        F.col("id").alias("worker"), (F.lit(base) + (F.col("id") < rest).cast("int")).cast("bigint").alias("rows")
    )


def write_sharded(df: DataFrame, path: str, shards: int) -> None:
    """A10: one job writing `shards` files of about equal size."""
    df.repartition(shards).write.mode("overwrite").parquet(path)

"""Reading and writing tables with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Options that make CSV and JSON round-trip texts with line breaks and quotes.
READ_OPTIONS = {"csv": {"header": "true", "multiLine": "true", "escape": '"'}}


def read_table(
    spark: SparkSession, path: str | list[str], schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read files with a declared schema; nothing is inferred.

    A column the files lack reads as null in parquet and JSON. A CSV file
    must hold the columns of `schema` in its order.
    """
    options = READ_OPTIONS.get(fmt, {})
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def in_file_order(df: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """Add columns that order rows as they lie in the files, and name them.

    Files come in the order of their paths. Only the order of the values means
    anything, and it is the same however the files are split into tasks.
    """
    order = {
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_place": F.monotonically_increasing_id(),
    }
    return df.select("*", *(value.alias(name) for name, value in order.items())), tuple(order)


def without(schema: T.StructType, *names: str) -> T.StructType:
    """The schema of files that omit some columns."""
    return T.StructType([field for field in schema if field.name not in names])


def combine_shapes(frames: Sequence[DataFrame]) -> DataFrame:
    """Union rows by column name; a column a frame omits is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def recreate_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at `path`, or create it, whatever the session's overwrite mode is."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy(*partition_by).parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """One raw JSON body per line, as `body`."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def rows_as_json(df: DataFrame, alias: str = "json") -> DataFrame:
    """Each row as one JSON text, null members kept."""
    row = F.struct(*(F.col(name) for name in df.columns))
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(alias))


def write_rows_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines, null members kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)

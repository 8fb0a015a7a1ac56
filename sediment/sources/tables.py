"""Scans of a published table: its closed window, pages, counts and tallies. Filters and columns reach the files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written


def stratum(rows: DataFrame, date_field: str, start: str, end: str) -> DataFrame:
    """Rows of a half-open window; none at all is an error of the caller's window, seen as an empty result."""
    return rows.where((F.col(date_field) >= F.lit(start).cast(rows.schema[date_field].dataType)) & (F.col(date_field) < F.lit(end).cast(rows.schema[date_field].dataType)))


def page(rows: DataFrame, order: list[str], size: int, offset: int) -> DataFrame:
    """One page in a stable order."""
    return rows.orderBy(*order).offset(offset).limit(size)


def window_counts(rows: DataFrame, date_field: str, start: str, end: str) -> DataFrame:
    """Rows before the window's end and rows in the window, in one pass."""
    kind = rows.schema[date_field].dataType
    before = F.col(date_field) < F.lit(end).cast(kind)
    return rows.agg(F.count(F.when(before, 1)).alias("frozen_past_count"), F.count(F.when(before & (F.col(date_field) >= F.lit(start).cast(kind)), 1)).alias("stratum_count"))


def tallies(rows: DataFrame, dims: list[str], most: int | None = None) -> DataFrame:
    """Rows of each category of each dimension, all dimensions in one pass; ``most`` bounds the categories of one."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("category")) for c in dims])).alias("x")).select("x.*").where("category IS NOT NULL")
    out = long.groupBy("dim", "category").agg(F.count(F.lit(1)).alias("n"))
    if most is None:
        return out
    from pyspark.sql.window import Window

    w = Window.partitionBy("dim").orderBy(F.desc("n"), "category")
    return out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def metadata(rows: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]


def json_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON file as rows; none if there is no file or it isn't JSON throughout."""
    try:
        return written(spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path), "json")
    except (PySparkException, Py4JJavaError):
        return None

"""Registration of a query with its oracle, and the tables as the pipelines see them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import property_map

SECONDS = "yyyy-MM-dd HH:mm:ss"


def query(registry: dict, oracles: dict, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        registry[f.__name__] = f
        oracles[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with properties (map) and millis; ts has no zone and is taken as UTC."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumns({"properties": property_map(F.col("props")), "millis": F.unix_millis(F.col("ts").cast("timestamp"))})


def stamp(column, name: str):
    """A time as text of whole seconds, which both engines spell alike."""
    return F.date_format(column, SECONDS).alias(name)

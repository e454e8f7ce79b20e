"""Time windows and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumble(rows: DataFrame, time: str, size: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = rows.groupBy(F.window(time, size).alias("__w"), *keys).agg(*aggs)
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in out.columns if c != "__w"])


def hop(rows: DataFrame, time: str, size: str, step: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    out = rows.groupBy(F.window(time, size, step).alias("__w"), *keys).agg(*aggs)
    return out.select(F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *[c for c in out.columns if c != "__w"])


def hop_sums(rows: DataFrame, time: str, size_minutes: int, step_minutes: int, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """hop for sums: each step is summed first, and only its sums are copied to the size / step windows that hold it."""
    step, size = step_minutes * 60, size_minutes * 60
    at = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / step) * step
    partial = rows.groupBy(at.alias("__at"), *keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    starts = F.explode(F.sequence(F.col("__at") - (size - step), F.col("__at"), F.lit(step)))
    out = partial.withColumn("__start", starts).groupBy("__start", *keys).agg(*[F.sum(n).alias(n) for n in sums])
    return out.select(F.timestamp_seconds("__start").alias("window_start"), F.timestamp_seconds(F.col("__start") + size).alias("window_end"), *keys, *sums)


def cumulate(rows: DataFrame, time: str, step_minutes: int, keys: Sequence[str], sums: Mapping[str, Column], distincts: Mapping[str, Column]) -> DataFrame:
    """For each day and keys, and each step from their first row to the day's end: sums and distinct counts since the day's start.

    No row is copied to later steps. Sums are added up by step first; a distinct value counts in the step that saw it
    first in its day. Both then run along the steps that have rows (at most 1440 / step_minutes of them a day), and a
    step's values hold for the steps up to the next.
    """
    step = step_minutes * 60
    secs = F.unix_seconds(F.col(time).cast("timestamp"))
    rows = rows.withColumns({"__day": F.date_trunc("day", time), "__end": (F.floor(secs / step) + 1) * step})
    group = ["__day", *keys]
    base = rows.groupBy(*group, "__end").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    for name, value in distincts.items():
        first = rows.where(value.isNotNull()).groupBy(*group, value.alias("__v")).agg(F.min("__end").alias("__end"))
        first = first.groupBy(*group, "__end").agg(F.count("*").alias(name))
        same = [base[c].eqNullSafe(first[c]) for c in [*group, "__end"]]
        base = base.join(first, same, "left").select(base["*"], first[name])
    order = Window.partitionBy(*group).orderBy("__end")
    along = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [*sums, *distincts]
    day_end = F.unix_seconds((F.col("__day") + F.expr("interval 1 day")).cast("timestamp"))
    until = F.coalesce(F.lead("__end").over(order) - step, day_end)
    out = base.select(*group, "__end", until.alias("__until"), *[F.sum(F.coalesce(F.col(n), F.lit(0))).over(along).alias(n) for n in names])
    out = out.withColumn("__end", F.explode(F.sequence(F.col("__end"), F.greatest("__end", "__until"), F.lit(step))))
    return out.select(F.col("__day").alias("window_start"), F.timestamp_seconds("__end").alias("window_end"), *keys, *names)


def top_n(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group. Spark cuts to n a task before the shuffle; order must break ties."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def streaming_top_n(counted: DataFrame, group: Sequence[Column | str], value: str, name: str, n: int) -> DataFrame:
    """Top n of a windowed streaming aggregate, where ranking functions are refused: (value, name) of each group."""
    packed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("name")))), 1, n)
    return counted.groupBy(*group).agg(packed.alias("top"))

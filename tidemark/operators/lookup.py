"""Lookup joins: dimension tables by key, at most one row a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension is broadcast if the plan's statistics bound its bytes by BROADCAST_BYTES, which takes no job, or else if its counted
#: rows are at most BROADCAST_ROWS and by their columns' usual widths within the same bytes. Otherwise the join shuffles
#: (AQE splits hot keys).
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 200_000


def unique_dimension(dim: DataFrame, key: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """One row a key: the least by order (default: all other columns)."""
    rest = [c for c in dim.columns if c not in key]
    least = F.min_by(F.struct(*rest), F.struct(*(order or rest)))
    return dim.groupBy(*key).agg(least.alias("__row")).select(*key, *[F.col(f"__row.`{c}`").alias(c) for c in rest])


def sized(dim: DataFrame, most_rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    if int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes:
        return F.broadcast(dim)
    rows = dim.count()
    return F.broadcast(dim) if rows <= most_rows and rows * dim._jdf.schema().defaultSize() <= most_bytes else dim


def lookup(rows: DataFrame, dim: DataFrame, key: Column, dim_key: str, how: str = "left", check_size: bool = True) -> DataFrame:
    """rows with dim's other columns where dim_key equals key; dim must be unique by dim_key."""
    side = sized(dim) if check_size else dim
    return rows.join(side.withColumnRenamed(dim_key, "__key"), key == F.col("__key"), how).drop("__key")


def retried(rows: DataFrame, dim: DataFrame, pending: DataFrame, key: str, attempts: int = 3) -> DataFrame:
    """rows and pending with dim's columns and attempt: null for rows that go on, else the number of the next try.

    Misses wait for the next round, and after attempts go on without the dimension. pending has rows' columns and attempt.
    """
    todo = rows.withColumn("attempt", F.lit(0)).unionByName(pending)
    found = lookup(todo.withColumn("__k", F.col(key)), dim.withColumn("__hit", F.lit(True)), F.col("__k"), key).drop("__k")
    waits = F.col("__hit").isNull() & (F.col("attempt") < attempts)
    return found.withColumn("attempt", F.when(waits, F.col("attempt") + 1)).drop("__hit")


def with_retry(rows: DataFrame, dim: DataFrame, pending: DataFrame, key: str, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(done, still pending) of one reading of dim; sinks.looked_up is the form for streams, whose dim may change between two."""
    found = retried(rows, dim, pending, key, attempts)
    return found.where("attempt is null").drop("attempt"), found.where("attempt is not null").select(*rows.columns, "attempt")


def flattened_tree(tree: DataFrame, node: str, parent: str, level: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A parent tree as a row a leaf: its ancestors' name columns under names (from the root), and keep of the leaf.

    A node of level i (from 1) has its parent on level i - 1; leaves are on level len(names). One join a level, each
    with the level's nodes only, so upper levels are small sides.
    """
    out = tree.where(F.col(level) == len(names)).select(F.col(parent).alias("__up"), F.col("name").alias(names[-1]), *keep)
    for i in range(len(names) - 1, 0, -1):
        above = tree.where(F.col(level) == i).select(F.col(node).alias("__id"), F.col(parent).alias("__next"), F.col("name").alias(names[i - 1]))
        out = out.join(sized(above), F.col("__up") == F.col("__id")).drop("__up", "__id").withColumnRenamed("__next", "__up")
    return out.select(*names, *keep)

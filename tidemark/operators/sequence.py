"""Sequences within a key: A then B, segments, page dwell, ordered event lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def followed_by(rows: DataFrame, key: Sequence[str], order: Sequence[str], is_a: Column, is_b: Column, time: str, within_seconds: int, keep: Sequence[str]) -> DataFrame:
    """Rows A whose very next row of the key is B less than within_seconds later: key, keep of both as a_ and b_."""
    along = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumn("__next", F.lead(F.struct(is_b.alias("b"), *[F.col(c) for c in keep], F.col(time).alias("__t"))).over(along))
    gap = F.unix_micros(F.col("__next.__t").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    hit = is_a & F.col("__next.b") & (gap < within_seconds * 1_000_000)
    return rows.where(hit).select(*key, *[F.col(c).alias(f"a_{c}") for c in keep], *[F.col(f"__next.{c}").alias(f"b_{c}") for c in keep])


def segments(rows: DataFrame, key: Sequence[str], order: Sequence[str], starts: Column, name: str = "segment") -> DataFrame:
    """rows with the number of segment starts so far, 0 before the first."""
    along = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(along))


def dwell(rows: DataFrame, key: Sequence[str], order: Sequence[str], time: str, page: Column, loads: Column, wakes: Column, closes: Column, launches: Column, idle_seconds: int) -> DataFrame:
    """Stays on pages: key, visit, page, page_start, page_end, n_events.

    A session's first event opens a stay on its page. A loading ends the stay at its own time and opens one on its page;
    a waking opens another on the same page; any other event prolongs the stay. After a closing, or a pause of more than
    idle_seconds, a new session begins. Launches only interrupt pauses. All of it is windows over one sort by key and order.
    """
    along = Window.partitionBy(*key).orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    truth = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({"__t": F.unix_micros(F.col(time).cast("timestamp")), "__loads": truth(loads), "__wakes": truth(wakes), "__closes": truth(closes), "__launches": truth(launches), "__page": page})
    paused = truth(F.col("__t") - F.lag("__t").over(along) > idle_seconds * 1_000_000) | truth(F.lag("__closes").over(along))
    rows = rows.withColumn("__session", F.sum(F.when(paused, 1).otherwise(0)).over(upto)).where(~F.col("__launches"))
    rows = rows.withColumn("__fresh", ~F.lag("__session").over(along).eqNullSafe(F.col("__session")))
    rows = rows.withColumn("__moves", F.col("__loads") & ~F.col("__fresh"))
    rows = segments(rows, key, order, F.col("__fresh") | F.col("__loads") | F.col("__wakes"), "visit")
    opened = F.last(F.when(F.col("__fresh") | F.col("__loads"), F.struct("__page")), ignorenulls=True).over(upto)["__page"]
    rows = rows.withColumns({"__on": opened, "__next": F.lead(F.when(F.col("__moves"), F.col(time))).over(along)})
    ends = F.max(F.greatest(F.col(time), F.col("__next")))
    return rows.groupBy(*key, "visit").agg(F.min_by("__on", F.struct(*order)).alias("page"), F.min_by(time, F.struct(*order)).alias("page_start"), ends.alias("page_end"), F.count("*").alias("n_events"))


def fold_steps(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with passed: how many steps have been passed in order, by each row and with it, starting over after the last.

    rows hold hits (the places in the sequence that the row's event has, or null), n_steps, and start (steps passed
    before all rows, or null). A key's rows are streamed in order: what is held is one number, however many rows it has.
    """
    keys = list(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, before = None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            # Where the key changes: by whole columns. The fold itself goes over plain integers.
            new = np.zeros(b.num_rows, dtype=bool)
            for c in keys:
                codes = b.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = [b.column(c)[0].as_py() for c in keys]
            new[0] = first != last
            last = [b.column(c)[b.num_rows - 1].as_py() for c in keys]
            hits = b.column("hits")
            ends, places = hits.offsets.to_numpy().tolist(), hits.values.to_numpy().tolist()
            size, start = b.column("n_steps").to_numpy().tolist(), pc.fill_null(b.column("start"), 0).to_numpy().tolist()
            out = np.zeros(b.num_rows, dtype=np.int64)
            todo = np.flatnonzero(new | (np.diff(hits.offsets.to_numpy()) > 0))
            for i, opens in zip(todo.tolist(), new[todo].tolist(), strict=True):
                if opens:
                    at = start[i]
                lo, hi = ends[i], ends[i + 1]
                if lo < hi and at % size[i] in places[lo:hi]:
                    at += 1
                out[i] = at
            # Rows between two that count have what the one before them has.
            place = np.zeros(b.num_rows, dtype=np.int64)
            place[todo] = todo
            np.maximum.accumulate(place, out=place)
            carried = out[place]
            if len(todo) == 0 or todo[0] > 0:
                carried[: todo[0] if len(todo) else None] = before
            before = int(carried[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(carried)], names=[*b.schema.names, "passed"])

    schema = StructType([*rows.schema.fields, StructField("passed", LongType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def sequence_progress(rows: DataFrame, key: Sequence[str], order: Sequence[str], symbol: Column, steps: Sequence[str]) -> DataFrame:
    """key, completed: how often steps were passed in order (gaps allowed, starting over after the last).

    Events that are no step are left out before the shuffle.
    """
    places = F.create_map(*[x for s in dict.fromkeys(steps) for x in (F.lit(s), F.array(*[F.lit(i) for i, t in enumerate(steps) if t == s]))])
    hits = rows.select(*key, *order, places[symbol].alias("hits"), F.lit(len(steps)).alias("n_steps"), F.lit(None).cast("long").alias("start")).where("hits is not null")
    return fold_steps(hits, key, order).groupBy(*key).agg(F.floor(F.max("passed") / len(steps)).cast("long").alias("completed"))

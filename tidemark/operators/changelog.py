"""Change feeds: envelopes {before, after, op}, folds to the latest row, signed deltas and retractions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Change kinds of rows that are taken away.
DELETIONS = ("d", "-D")


def parse_envelope(feed: DataFrame, value: str, row_schema: str) -> DataFrame:
    """JSON text to before, after (structs) and op (r, c, u, d)."""
    return feed.select("*", F.from_json(value, f"before struct<{row_schema}>, after struct<{row_schema}>, op string").alias("__e")).select("*", "__e.before", "__e.after", "__e.op").drop("__e")


def after_images(feed: DataFrame) -> DataFrame:
    """The rows after each change; deletions have none."""
    return feed.where(F.col("after").isNotNull()).select("after.*")


def latest(feed: DataFrame, key: Sequence[str], order: Sequence[str], op: str | None = None) -> DataFrame:
    """The last row of each key by order; keys whose last op is d (or -D) are gone.

    One partially aggregated max_by instead of a window: no sort, and a hot key is combined before the shuffle.
    """
    rest = [c for c in feed.columns if c not in key]
    rows = feed.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, *[F.col(f"__last.`{c}`").alias(c) for c in rest])
    return rows if op is None else rows.where(~F.col(op).isin(*DELETIONS))


def additions(feed: DataFrame, kind: str = "kind") -> DataFrame:
    """Only +I and +U rows: what an append-only sum over a changelog may count."""
    return feed.where(F.col(kind).isin("+I", "+U"))


def signed_delta(valid: Mapping[str, Column], measure: Mapping[str, Column]) -> Column:
    """after's measure where valid, less before's where valid; absent images count 0."""
    part = lambda side: F.coalesce(F.when(valid[side], measure[side]), F.lit(0))
    return part("after") - part("before")


def state_deltas(rows: DataFrame, key: Sequence[str], order: Sequence[str], measures: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """rows with a delta for each measure, from a feed of after images: name: (value, kind), kind being 'adds' (value less the
    key's value before), 'cancels' (less the value before) or null (0)."""
    along = Window.partitionBy(*key).orderBy(*order)
    for name, (value, kind) in measures.items():
        before = F.coalesce(F.lag(value).over(along), F.lit(0))
        rows = rows.withColumn(name, F.when(kind == "adds", value - before).when(kind == "cancels", -before).otherwise(F.lit(0)))
    return rows


def running_total(rows: DataFrame, stretch: Column, order: Sequence[str], totals: Mapping[str, str]) -> DataFrame:
    """rows with running totals over all of them, name: column to add up, in the order of (stretch, order).

    stretch cuts the order into pieces, such as minutes. Each piece is summed by itself; one row a piece runs through one
    task, and the rows within a piece through that piece's, so no task sees all rows. Cut finely: a year has half a
    million minutes, which one task takes with ease.
    """
    rows = rows.withColumn("__stretch", stretch)
    pieces = rows.groupBy("__stretch").agg(*[F.sum(c).alias(f"__s_{n}") for n, c in totals.items()])
    before = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__stretch", *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__s_{n}") for n in totals])
    within = Window.partitionBy("__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", *[F.sum(c).over(within).alias(f"__w_{n}") for n, c in totals.items()]).join(pieces, "__stretch")
    return out.select(*[c for c in rows.columns if c != "__stretch"], *[(F.col(f"__w_{n}") + F.col(f"__s_{n}")).alias(n) for n in totals])


def _versions(rows: DataFrame, key: Sequence[str], order: str, op: str | None) -> DataFrame:
    """rows with __from and __until: the order at which each came into force, and at which the next of its key did (null: still in force)."""
    along = Window.partitionBy(*key).orderBy(order)
    out = rows.withColumns({"__from": F.col(order), "__until": F.lead(order).over(along)})
    return out if op is None else out.where(~F.coalesce(F.col(op).isin(*DELETIONS), F.lit(False)))


def join_changes(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_key: Sequence[str], right_key: Sequence[str], order: tuple[str, str], op: tuple[str | None, str | None] = (None, None), how: str = "inner") -> DataFrame:
    """The change feed of the join of two change feeds: at, kind (+I, -U, +U, -D), and both sides' columns.

    A feed holds all versions of its rows, by key; order is a time that both sides share, unique within a key. Each version is in
    force until the next of its key. Two versions are joined where both are in force: what they give begins then, and is
    retracted as the first of them ends. A pair that is followed at once by one of the same keys is an update. With
    how='left', a version also stands alone, with nulls, while no row of the right has its join columns. All is windows and
    equality joins; streaming.stateful.changelog_join is the form for streams.
    """
    mine = left.columns
    a = _versions(left, left_key, order[0], op[0])
    b = _versions(right, right_key, order[1], op[1])
    both = F.lit(True)
    for x, y in on:
        both = both & (F.col(x) == F.col(y))
    meets = lambda f1, u1, f2, u2: (f2.isNull() | u1.isNull() | (f2 < u1)) & (f1.isNull() | u2.isNull() | (f1 < u2))
    right_side = b.withColumnsRenamed({"__from": "__f2", "__until": "__u2"})
    near = both & meets(F.col("__from"), F.col("__until"), F.col("__f2"), F.col("__u2"))
    # greatest and least pass over nulls: no beginning, no end.
    spans = [F.greatest("__from", "__f2").alias("__a"), F.least("__until", "__u2").alias("__z")]
    joined = a.join(right_side, near).select(*mine, *right.columns, *spans)
    if how == "left":
        # When a key of the right has no rows: by the running number of versions in force.
        keys = [y for _, y in on]
        ends = b.select(*keys, F.inline(F.array(F.struct(F.col("__from").alias("t"), F.lit(1).alias("d")), F.struct(F.col("__until").alias("t"), F.lit(-1).alias("d")))))
        ends = ends.where(F.col("t").isNotNull()).groupBy(*keys, "t").agg(F.sum("d").alias("d"))
        along = Window.partitionBy(*keys).orderBy("t")
        ends = ends.select(*keys, "t", F.sum("d").over(along).alias("n"), F.lead("t").over(along).alias("next"), F.lag("t").over(along).isNull().alias("opens"))
        gap = F.struct(F.col("t").alias("__f2"), F.col("next").alias("__u2"), (F.col("n") == 0).alias("gap"))
        before = F.struct(F.lit(None).cast(b.schema["__from"].dataType).alias("__f2"), F.col("t").alias("__u2"), F.col("opens").alias("gap"))
        gaps = ends.select(*[F.col(y).alias(f"__k{i}") for i, y in enumerate(keys)], F.inline(F.array(before, gap))).where("gap").drop("gap")
        same = F.lit(True)
        for i, (x, _) in enumerate(on):
            same = same & (F.col(x) == F.col(f"__k{i}"))
        alone = a.join(gaps, same, "left").where(meets(F.col("__from"), F.col("__until"), F.col("__f2"), F.col("__u2")))
        joined = joined.unionByName(alone.select(*mine, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields], *spans))
    pair = Window.partitionBy(*left_key, *right_key).orderBy("__a")
    joined = joined.withColumns({"__after": F.coalesce(F.lag("__z").over(pair) == F.col("__a"), F.lit(False)), "__then": F.coalesce(F.lead("__a").over(pair) == F.col("__z"), F.lit(False))})
    adds = F.struct(F.col("__a").alias("at"), F.when(F.col("__after"), "+U").otherwise("+I").alias("kind"))
    takes = F.struct(F.col("__z").alias("at"), F.when(F.col("__then"), "-U").otherwise("-D").alias("kind"))
    return joined.select(*mine, *right.columns, F.inline(F.array(adds, takes))).where(F.col("at").isNotNull()).select("at", "kind", *mine, *right.columns)

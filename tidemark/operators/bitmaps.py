"""Sets of 64-bit ids as compressed bitmaps: containers of WIDTH ids, sparse ones as lists of places, dense ones as bits.

A set is a row a container, so one of a billion ids is some 30,000 rows of at most 4 KB, wherever its ids lie; it can also stand in one column of a row,
such as a rule's. Membership is a join by container and the test of one bit: no member becomes a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import sized

#: Ids a container, as in Spark's own bitmap functions, and the most that are listed one by one (at 2 bytes, half of the bits' size).
WIDTH, SPARSE = 32768, 1024
CONTAINER = "bucket bigint, n int, places array<smallint>, bits binary"


def bucket_of_id(user: Column) -> Column:
    return F.shiftright(user.cast("long"), 15)


def place_of_id(user: Column) -> Column:
    return user.cast("long").bitwiseAND(F.lit(WIDTH - 1)).cast("int")


def containers(members: DataFrame, user: str, by: Sequence[str] = ()) -> DataFrame:
    """by, bucket, n, places (of sparse containers), bits (of dense ones): the distinct ids of each set, which by names.

    Bits are combined in each task before the shuffle, so a set's size doesn't matter to it; null ids are in no set.
    """
    rows = members.where(F.col(user).isNotNull()).select(*by, bucket_of_id(F.col(user)).alias("bucket"), place_of_id(F.col(user)).alias("__place"))
    full = rows.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("__place").alias("bits")).withColumn("n", F.bitmap_count("bits").cast("int"))
    sparse = F.col("n") <= SPARSE
    return full.select(*by, "bucket", "n", F.when(sparse, _places_of("bits")).alias("places"), F.when(~sparse, F.col("bits")).alias("bits"))


def _byte(bits: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, at + 1, F.lit(1))), 16, 10).cast("int")


def _places_of(bits: str) -> Column:
    """The places of the bits that are set, as a list: of the bytes that have any."""
    held = lambda i: F.sequence(i * 8, i * 8 + 7)
    every = F.sequence(F.lit(0), F.lit(WIDTH // 8 - 1))
    used = F.filter(every, lambda i: F.substring(F.col(bits), i + 1, F.lit(1)) != F.lit(b"\0"))
    inside = F.flatten(F.transform(used, held))
    return F.filter(inside, lambda p: _is_set(F.col(bits), p)).cast("array<smallint>")


def _is_set(bits: Column, place: Column) -> Column:
    byte = _byte(bits, F.floor(place / 8).cast("int"))
    return F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))).cast("int").bitwiseAND(F.lit(1)) == 1


def holds(place: Column, places: Column, bits: Column) -> Column:
    """Whether a container has the place; false where there is no container."""
    return F.coalesce(F.when(bits.isNotNull(), _is_set(bits, place)).otherwise(F.array_contains(places, place.cast("smallint"))), F.lit(False))


def members_only(rows: DataFrame, user: str, sets: DataFrame, by: Sequence[str] = (), flag: str | None = None) -> DataFrame:
    """rows whose user is in the set of their by columns (with flag: rows of which it is true must be, others stay).

    sets: containers. They are broadcast while small, and otherwise meet the rows by set and container.
    """
    own = sized(sets.select(*by, F.col("bucket").alias("__bucket"), F.col("places").alias("__places"), F.col("bits").alias("__bits")))
    found = rows.withColumn("__bucket", bucket_of_id(F.col(user))).join(own, [*by, "__bucket"], "left")
    inside = holds(place_of_id(F.col(user)), F.col("__places"), F.col("__bits"))
    return found.where(inside if flag is None else ~F.col(flag) | inside).select(*[F.col(f"`{c}`") for c in rows.columns])


def as_column(sets: DataFrame, by: Sequence[str], name: str = "target_users") -> DataFrame:
    """by, name: each set's containers in one column, as a rule's row holds its audience."""
    return sets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "places", "bits"))).alias(name))


def from_column(rows: DataFrame, by: Sequence[str], name: str = "target_users") -> DataFrame:
    """The containers of sets that stand in a column."""
    return rows.select(*by, F.inline(name))


def size(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sets.groupBy(*by).agg(F.sum("n").alias("n"))


def both(one: DataFrame, two: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The containers of what is in both of two sets: by the sparser of each two containers, or by their bits."""
    a, b = (x.select(*by, "bucket", F.col("places").alias(f"__p{i}"), F.col("bits").alias(f"__b{i}")) for i, x in enumerate((one, two)))
    met = a.join(b, [*by, "bucket"])
    sparse = F.when(F.col("__p0").isNotNull(), F.filter("__p0", lambda p: holds(p.cast("int"), F.col("__p1"), F.col("__b1"))))
    sparse = sparse.when(F.col("__p1").isNotNull(), F.filter("__p1", lambda p: _is_set(F.col("__b0"), p.cast("int"))))
    met = met.withColumns({"places": sparse, "__dense": F.col("__b0").isNotNull() & F.col("__b1").isNotNull()})
    few = met.where(~F.col("__dense") & (F.size("places") > 0)).select(*by, "bucket", F.size("places").alias("n"), "places", F.lit(None).cast("binary").alias("bits"))
    stacked = met.where("__dense").select(*by, "bucket", F.explode(F.array("__b0", "__b1")).alias("bits"))
    dense = stacked.groupBy(*by, "bucket").agg(F.expr("bitmap_and_agg(bits)").alias("bits")).withColumn("n", F.bitmap_count("bits").cast("int")).where("n > 0")
    return few.unionByName(dense.select(*by, "bucket", "n", F.lit(None).cast("array<smallint>").alias("places"), "bits"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: str | None = None
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and all runs in one process (tests) a folder of this machine is made.
    """
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tidemark-")
    return _own_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again.

    The files outlive lost executors. discard() removes those that nothing reads any more; what a result reads stays
    until the owner of the shared folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """The rows of written() tables of one schema, as one scan however many they are."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[_paths[t] for t in tables])


def discard(*tables: DataFrame) -> None:
    """Removes written() tables whose readers have all been written themselves."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def named(column: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def as_rows(df: DataFrame) -> DataFrame:
    """df with all its columns in one struct, row: no name of theirs can clash with one that an operator adds.

    Spark reads only the fields that are used.
    """
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("row"))


def of_row(column: str) -> Column:
    return F.col("row").getField(column)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """array<string> of the maximal runs without white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def lines_of(text: Column) -> Column:
    """array<string>: text split at each newline; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)

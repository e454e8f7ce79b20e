"""Readers: files, Kafka, JDBC, partitioned tables, change feeds, synthetic streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampType

from tidemark.functions import from_server_time
from tidemark.operators.changelog import additions, parse_envelope

EVENT_SCHEMA = "username string, session_id string, eventId string, actionTime bigint, lat double, lng double, release_channel string, device_type string, properties map<string,string>"
RULE_EVENT_SCHEMA = "user_id bigint, event_time bigint, event_id string, properties map<string,string>"


def kafka_text(spark: SparkSession, servers: str, topic: str, starting: str = "latest", stream: bool = True) -> DataFrame:
    """value as text. Offsets come from the checkpoint, and from starting without one. Needs Spark's Kafka package."""
    reader = spark.readStream if stream else spark.read
    rows = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return rows.select(F.col("value").cast("string").alias("value"))


def json_rows(text: DataFrame, schema: str | StructType, value: str = "value") -> DataFrame:
    """JSON texts to columns; a missing field is null, and an unreadable text a row of nulls."""
    return text.select(F.from_json(value, schema).alias("r")).select("r.*")


def with_event_time(rows: DataFrame, millis: str, name: str = "row_time", delay: str = "0 seconds") -> DataFrame:
    return rows.withColumn(name, F.timestamp_millis(millis)).withWatermark(name, delay)


def json_files(spark: SparkSession, path: str, schema: str | StructType, stream: bool = True, files_a_batch: int | None = None) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).schema(schema)
    if stream and files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.json(path)


def parquet_files(spark: SparkSession, path: str, stream: bool = False, schema: StructType | None = None, files_a_batch: int | None = None) -> DataFrame:
    if not stream:
        return spark.read.parquet(path)
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(path)


def change_feed(text: DataFrame, row_schema: str, value: str = "value", server_zone: str | None = None) -> DataFrame:
    """Envelopes {before, after, op} from JSON texts. server_zone: the zone of the database's times, which become instants."""
    rows = parse_envelope(text, value, row_schema).select("before", "after", "op")
    if server_zone is None:
        return rows
    times = [f.name for f in rows.schema["after"].dataType.fields if f.dataType == TimestampType()]
    moved = {}
    for side in ("before", "after"):
        moved[side] = F.col(side)
        for name in times:
            moved[side] = moved[side].withField(name, from_server_time(F.col(side)[name], server_zone))
    return rows.withColumns({k: F.when(F.col(k).isNotNull(), v) for k, v in moved.items()})


def redeclared(changes: DataFrame, time: str, delay: str = "0 seconds", kind: str = "kind") -> DataFrame:
    """A changelog's additions as rows with an event time of their own."""
    return additions(changes, kind).drop(kind).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def as_view(rows: DataFrame, name: str) -> DataFrame:
    """rows, which SQL texts of the session then know by name."""
    rows.createOrReplaceTempView(name)
    return rows


def described(rows: DataFrame) -> DataFrame:
    """name, type, nullable of each column."""
    return rows.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in rows.schema.fields], "name string, type string, nullable boolean")


def one_stream(*streams: DataFrame, tag: str = "source") -> DataFrame:
    """Streams of different columns as one: tag (the stream's number) and value (the row as JSON text)."""
    tagged = [s.select(F.lit(i).alias(tag), F.to_json(F.struct("*")).alias("value")) for i, s in enumerate(streams)]
    return reduce(DataFrame.unionByName, tagged)


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """With key and bounds, the table is read in ranges of the key by as many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def table_partition(spark: SparkSession, name: str, dt: str) -> DataFrame:
    """One day of a partitioned table; only its files are read."""
    return spark.table(name).where(F.col("dt") == dt)


def synthetic_events(spark: SparkSession, rows_a_second: int = 10, users: int = 100, kinds: tuple[str, ...] = ("view", "click", "purchase")) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.pmod(F.xxhash64("value"), F.lit(len(kinds))) + 1).cast("int"))
    return rate.select((F.pmod(F.xxhash64(F.lit(1), "value"), F.lit(users))).alias("user_id"), F.col("timestamp").alias("ts"), kind.alias("event_type"), F.col("value").alias("event_id"))

"""Writers for batches and micro-batches: append, upsert by key, several sinks of one read, tables, Kafka, JDBC, console."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.changelog import DELETIONS, latest
from tidemark.operators.lookup import retried

Writer = Callable[[DataFrame, int], None]


def append_parquet(path: str, partition_by: Sequence[str] = ()) -> Writer:
    """Each batch has its own folder and overwrites it, so a batch that is run again leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/batch={number}")

    return write


def olap_parquet(path: str, time: str, day: str = "dt") -> Writer:
    """append_parquet in a folder a day of time, so that a query of some days reads only theirs."""
    write = append_parquet(path, [day])
    return lambda batch, number: write(batch.withColumn(day, F.to_date(time)), number)


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("__bucket")


def upsert_parquet(path: str, key: Sequence[str], order: Sequence[str], buckets: int = 16, op: str | None = None, remembered: int = 100, bucket_by: Sequence[str] | None = None, keep: Column | None = None) -> Writer:
    """A table of the latest row a key, in buckets by the key's hash, as versions: a batch writes anew the buckets that it touches.

    Each version lists where every bucket's newest rows are, and none is written over: a batch that is run again starts
    from the same version and writes the same. read_upserted reads the last whole one.

    op names a column of change kinds: a key whose latest row has d or -D is gone for readers. Its deletion stays in the
    table unseen, so that an older row that comes late does not bring the key back, until the bucket is written more than
    remembered batches later. bucket_by: columns of the key that alone decide its bucket. keep: rows of which this is false are left
    out when their bucket is written.
    """
    by = list(bucket_by or key)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if op is None else batch.withColumns({"__gone": F.coalesce(F.col(op).isin(*DELETIONS), F.lit(False)), "__at": F.lit(number).cast("long")})
        columns, schema = rows.columns, rows.schema
        rows = held = rows.withColumn("__bucket", bucket_of(by, buckets)).persist()
        try:
            touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most buckets
            at = _places(spark, path, number)
            if old := [f"{path}/rows={v}/__bucket={b}" for b, v in at.items() if b in touched]:
                before = spark.read.option("basePath", path).schema(schema).parquet(*old).select(*columns)
                rows = rows.unionByName(before.withColumn("__bucket", bucket_of(by, buckets)))
            out = latest(rows, ["__bucket", *key], order).select(*columns, "__bucket")
            if op is not None:
                out = out.where(~F.col("__gone") | (F.col("__at") >= number - remembered))
            if keep is not None:
                out = out.where(keep)
            out.repartition(buckets, "__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/rows={number}")
            # A bucket of which nothing is left has no folder.
            left = _buckets_at(spark, f"{path}/rows={number}")
        finally:
            held.unpersist()
        now = [{"bucket": b, "at": v} for b, v in at.items() if b not in touched] + [{"bucket": b, "at": number} for b in left]
        places = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(now)), "array<struct<bucket int, at bigint>>")))
        places.coalesce(1).write.mode("overwrite").parquet(f"{path}/places/version={number}")

    return write


def _buckets_at(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(n.removeprefix("__bucket=")) for n in names if n.startswith("__bucket=")]


def _places(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """Of an upserted table: the batch that has written each bucket last."""
    places = read_version(spark, f"{path}/places", below)
    return {} if places is None else {r["bucket"]: r["at"] for r in places.collect()}


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    whole = [p for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in whole)


def _last_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    found = [v for v in _versions(spark, path) if below is None or v < below]
    return found[-1] if found else None


def read_upserted(spark: SparkSession, path: str, below: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
    """The table that upsert_parquet keeps at path, or the last version of one that is written anew each batch.

    below: as it was before that batch, and None if it had no rows then. buckets: of these only.
    """
    at = _places(spark, path, below)
    if files := [f"{path}/rows={v}/__bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]:
        rows = spark.read.option("basePath", path).parquet(*files).drop("rows", "__bucket")
        return rows.where("not __gone").drop("__gone", "__at") if "__gone" in rows.columns else rows
    if at or below is not None:
        return None
    if (rows := read_version(spark, path)) is None:
        raise FileNotFoundError(f"{path} has no whole version")
    return rows


def read_version(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The last whole version (before below) of a table that is written anew each batch; None if there is none."""
    version = _last_version(spark, path, below)
    return None if version is None else spark.read.parquet(f"{path}/version={version}")


def keep_recent(path: str, time: str, seconds: int, by: Sequence[str] = (), idle_seconds: int | None = None) -> Writer:
    """A table of the rows of the last seconds before the newest row, as versions: state that expires.

    by: columns, such as the user, whose own newest row counts: one user's pause or haste does not age another's rows. With
    idle_seconds, rows of whom nothing has come for so long before the newest row of all go too. read_upserted reads it,
    and operators.rules.replay gives its rows to rules that have just come into force. Only what is recent is carried
    from a version to the next.
    """
    ago = lambda t, s: t - F.make_dt_interval(secs=F.lit(s))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _last_version(spark, path, number)
        rows = batch if before is None else spark.read.parquet(f"{path}/version={before}").unionByName(batch)
        columns = rows.columns
        # A partial maximum by key, joined back; without keys it is one row.
        newest = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.max(time).alias("__newest"))
        same = F.lit(True)
        for c in by:
            same = same & rows[c].eqNullSafe(newest[f"__{c}"])
        out = rows.join(newest if by else F.broadcast(newest), same).where(F.col(time) > ago(F.col("__newest"), seconds))
        if idle_seconds is not None:
            last = F.broadcast(rows.agg(F.max(time).alias("__last")))
            out = out.join(last, F.lit(True)).where(F.col("__newest") > ago(F.col("__last"), idle_seconds))
        out.select(*columns).write.mode("overwrite").parquet(f"{path}/version={number}")

    return write


def looked_up(path: str, dim: Callable[[], DataFrame], key: str, then: Writer, attempts: int = 3) -> Writer:
    """Rows joined to dim() by key, given to then; rows without a match wait in the table at path and are tried again.

    After attempts they go on with nulls. A batch's outcome is written first, as a version, and all else reads it: dim is
    read once a batch, so no row can be both pending and done. A batch that is run again starts from the version before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _last_version(spark, path, number)
        if before is None:
            pending = batch.limit(0).withColumn("attempt", F.lit(0))
        else:
            pending = spark.read.parquet(f"{path}/version={before}").where("attempt is not null").select(*batch.columns, "attempt")
        retried(batch, dim(), pending, key, attempts).write.mode("overwrite").parquet(f"{path}/version={number}")
        then(spark.read.parquet(f"{path}/version={number}").where("attempt is null").drop("attempt"), number)

    return write


def to_all(*writers: Writer) -> Writer:
    """Several sinks of one read: the batch is kept while they write."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for one in writers:
                one(batch, number)
        finally:
            batch.unpersist()

    return write


def with_retries(writer: Writer, attempts: int = 5, pause_seconds: float = 0.2) -> Writer:
    def write(batch: DataFrame, number: int) -> None:
        for left in range(attempts - 1, -1, -1):
            try:
                return writer(batch, number)
            except Exception:
                if not left:
                    raise
                time.sleep(pause_seconds)

    return write


def jdbc(url: str, table: str, batch_rows: int = 1000, **options: str) -> Writer:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).option("batchsize", batch_rows).options(**options).save()

    return write


def jdbc_upsert(url: str, table: str, staging: str, key: Sequence[str], order: Sequence[str], batch_rows: int = 1000, **options: str) -> Writer:
    """Rows into a table with a primary key: each batch's latest row a key goes to staging, and from there by one statement.

    The statement is one transaction, so a batch that is run again changes nothing. MySQL has a form of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).select(*batch.columns).write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", staging).option("batchsize", batch_rows).options(**options).save()
        spark, mysql = batch.sparkSession, url.startswith("jdbc:mysql:")
        quoted = [f"`{c}`" if mysql else f'"{c}"' for c in batch.columns]
        rest = [q for c, q in zip(batch.columns, quoted, strict=True) if c not in key]
        same = [q for c, q in zip(batch.columns, quoted, strict=True) if c in key]
        names, own, change = ", ".join(quoted), ", ".join(f"s.{q}" for q in quoted), ", ".join(f"{q} = s.{q}" for q in rest)
        if mysql:
            sql = f"insert into {table} ({names}) select {own} from {staging} s on duplicate key update {change or f'{same[0]} = s.{same[0]}'}"
        else:
            update = f" when matched then update set {change}" if change else ""
            sql = f"merge into {table} t using {staging} s on {' and '.join(f't.{q} = s.{q}' for q in same)}{update} when not matched then insert ({names}) values ({own})"
        properties = spark._jvm.java.util.Properties()
        for name in ("user", "password"):
            if name in options:
                properties.setProperty(name, options[name])
        connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            connection.createStatement().execute(sql)
        finally:
            connection.close()

    return write


def insert_into(table: str) -> Writer:
    """Rows into a catalog table, by the columns' names."""
    return lambda batch, number: batch.sparkSession.sql(f"insert into {table} by name select * from {{batch}}", batch=batch) and None


def printed(write: Callable[[str], None] = print) -> Writer:
    """Every row as a line of JSON on the driver, which holds one partition at a time."""

    def out(batch: DataFrame, number: int) -> None:
        for r in batch.select(F.to_json(F.struct("*"))).toLocalIterator():
            write(r[0])

    return out


def kafka(servers: str, topic: str) -> Writer:
    """Rows as JSON texts, at least once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()

    return write


def start(rows: DataFrame, writer: Writer, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Runs rows into writer, a batch each time that every (such as '200 milliseconds') has passed; without every, what is
    there now is taken and the query ends."""
    out = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(writer)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

"""Engines over micro-batches: marketing rules that come and go, and reports over the newest rows of several streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import in_window
from tidemark.operators import rules as R
from tidemark.operators.lookup import sized
from tidemark.operators.windows import top_n
from tidemark.sinks import Writer, bucket_of, keep_recent, read_upserted, read_version, upsert_parquet
from tidemark.sources import json_rows

Table = Callable[[], DataFrame] | None
_SEEN = "rule_id string, ids map<string,bigint>"


def rule_engine(path: str, rules: Callable[[], Sequence[R.Rule]], then: Writer, replay_seconds: int = 120, profile: Table = None, audience: Table = None, seeds: Table = None, buckets: int = 16) -> Writer:
    """A writer that gives the matches of each batch of events (user_id, event_id, event_type, ts, properties) to then.

    rules() is asked once a batch for the rules in force (see active_rules and parse_rule). Counts are kept by rule, condition and user.
    What a condition is, rules.condition_ids says: an updated rule keeps the counts of the conditions that it still has, in whatever
    order, and a condition that is new to it, or back again, starts at 0. A rule that was not in force in the batch
    before is first given the events of the last replay_seconds before the batch's newest; a rule that is gone loses its counts.

    Counts (in buckets by user, of which a batch reads and writes those that it touches), recent events and the conditions
    seen are written as versions at path before then is called: a batch that is run again starts from the versions before it, and an
    engine that starts anew goes on from the last ones.
    """
    remember = keep_recent(f"{path}/recent", "ts", replay_seconds)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.select(F.col("user_id").cast("long").alias("user_id"), "event_id", "event_type", "ts", "properties")
        active = list(rules())
        seen = read_version(spark, f"{path}/rules", number)
        known = {} if seen is None else {r["rule_id"]: r["ids"] for r in seen.collect()}
        since = {r.rule_id: {i: known.get(r.rule_id, {}).get(i, number) for i in [*R.condition_ids(r), *filter(None, [R.sequence_id(r)])]} for r in active}
        recent = read_version(spark, f"{path}/recent", number)
        old, new = [r for r in active if r.rule_id in known], [r for r in active if r.rule_id not in known]
        tables = [t() if t else None for t in (profile, audience, seeds)]
        parts = []
        if old:
            touched = batch.select(bucket_of(["user_id"], buckets)).distinct().collect()  # at most buckets
            state = read_upserted(spark, f"{path}/state", number, [r[0] for r in touched])
            parts.append(R.progress(batch, old, *tables, state=state, since=since))
        if new:
            parts.append(R.progress(batch if recent is None else recent.unionByName(batch), new, *tables, since=since))
        if parts:
            found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            found.write.mode("overwrite").parquet(f"{path}/progress/version={number}")
            found = spark.read.parquet(f"{path}/progress/version={number}")
            now = R.left_by(found).where(F.size("counts") > 0).withColumn("at", F.lit(number).cast("long"))
            alive = F.arrays_overlap(F.map_keys("counts"), F.lit([f"{i}@{n}" for ids in since.values() for i, n in ids.items()]).cast("array<string>"))
            upsert_parquet(f"{path}/state", ["rule_id", "user_id"], ["at"], buckets, bucket_by=["user_id"], keep=alive)(now, number)
        remember(batch, number)
        R.as_rows(spark, [{"rule_id": r, "ids": ids} for r, ids in since.items()], _SEEN).coalesce(1).write.mode("overwrite").parquet(f"{path}/rules/version={number}")
        if parts:
            then(R.matches(found), number)

    return write


def paid_topn(items: DataFrame, orders: DataFrame, start: Column | str, end: Column | str, statuses: Sequence[int], n: int) -> DataFrame:
    """brand, product_id, amount, rn: the n products of each brand with the largest sums paid in start <= payment_time < end.

    items: id, order_id, product_id, brand, price, quantity. orders: id, status, payment_time. The paid orders are
    broadcast while they are small; ties go to the smaller product_id.
    """
    paid = orders.where(F.col("status").isin(list(statuses)) & in_window(F.col("payment_time"), start, end)).select(F.col("id").alias("order_id"))
    sums = items.join(sized(paid), "order_id").groupBy("brand", "product_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("amount"))
    return top_n(sums, ["brand"], [F.desc("amount"), F.asc("product_id")], n)


def report_each_batch(path: str, tables: Mapping[int, tuple[str, Sequence[str], Sequence[str]]], report: Callable[..., DataFrame], then: Writer, clock: Callable[[], datetime]) -> Writer:
    """A writer for sources.one_stream: the newest row a key of each stream is kept, and a report of all of them given to then.

    tables: by the stream's number: its rows' schema, key and order. report gets the tables in that order, and clock()'s
    time. Started with every='1 minute', it is a report of each minute that has rows: a stream on which nothing comes starts no
    batch. stateful.top_n_by_clock goes on by the clock.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, []
        for tag, (schema, key, order) in sorted(tables.items()):
            rows = json_rows(batch.where(F.col("source") == tag), schema)
            upsert_parquet(f"{path}/{tag}", key, order)(rows, number)
            try:
                kept.append(read_upserted(spark, f"{path}/{tag}"))
            except FileNotFoundError:  # nothing has come yet
                kept.append(rows.limit(0))
        then(report(*kept, clock()), number)

    return write

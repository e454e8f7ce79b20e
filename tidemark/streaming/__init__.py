"""Streaming forms: windowed aggregates that streams accept, and keyed state for sequences, dwell and enrichment."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal
from queue import Empty, SimpleQueue
from threading import Thread

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.windows import streaming_top_n
from tidemark.sinks import Writer, read_version


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk with incremental checkpoints, for state beyond the executors' memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def pv_uv(rows: DataFrame, time: str, size: str, user: str) -> DataFrame:
    """Exact PV and UV by window, as two aggregates: by (window, user), then by window. rows need a watermark."""
    by_user = rows.groupBy(F.window(time, size).alias("w"), user).agg(F.count("*").alias("n"))
    out = by_user.groupBy(F.window(F.window_time("w"), size).alias("w")).agg(F.sum("n").alias("pv"), F.count("*").alias("uv"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "pv", "uv")


def top_pages(rows: DataFrame, time: str, size: str, group: str, item: str, n: int) -> DataFrame:
    counted = rows.groupBy(F.window(time, size).alias("w"), group, item).agg(F.count("*").alias("pv"))
    top = streaming_top_n(counted, [F.window(F.window_time("w"), size).alias("w"), group], "pv", item, n)
    out = top.select("w", group, F.posexplode("top").alias("at", "t"))
    return out.select(F.col("w.start").alias("window_start"), group, F.col("t.name").alias(item), (-F.col("t.v")).alias("pv"), (F.col("at") + 1).alias("rn"))


def early_fire(rows: DataFrame, time: str, size: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """A long window whose running result is given at each trigger: start it with output mode update."""
    return rows.groupBy(F.window(time, size).alias("w"), *keys).agg(*aggs)


def sequence_matches(rows: DataFrame, steps: Sequence[str], times: int, fire: str, forget_seconds: int | None = None) -> DataFrame:
    """user_id, ts of each fire event at which a user has passed steps in order at least times.

    rows: user_id, ts, event_id, event_type. The state of a user is how far they are; a batch's events are taken in order. With
    forget_seconds (rows need a watermark) a user starts over after a pause that is longer, and the state goes with it.
    """
    steps, pause = list(steps), None if forget_seconds is None else forget_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, last = state.get if state.exists else (0, None)
        events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for ts, kind in zip(events["ts"], events["event_type"], strict=True):
            micros = ts.value // 1000
            if pause is not None and last is not None and micros - last > pause:
                at = 0
            last = micros
            if kind == steps[at % len(steps)]:
                at += 1
            if kind == fire and at // len(steps) >= times:
                out.append(ts)
        state.update((at, last))
        if pause is not None:
            state.setTimeoutTimestamp(max((last + pause) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ts": out})

    timeout = GroupStateTimeout.NoTimeout if forget_seconds is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp", "at long, last long", "append", timeout)


def show_then_click(rows: DataFrame, show: str, click: str, within_seconds: int) -> DataFrame:
    """user_id, show_ts, click_ts of shows whose very next event is a click less than within_seconds later.

    rows hold shows and clicks only. The state of a user is the show that waits; event time ends the waiting.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, kind in zip(events["ts"], events["event_type"], strict=True):
            micros = ts.value // 1000
            if kind == click and waiting is not None and micros - waiting < within_seconds * 1_000_000:
                out.append((pd.Timestamp(waiting, unit="us"), ts))
            waiting = micros if kind == show else None
        if waiting is None:
            if state.exists:
                state.remove()
        else:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(waiting // 1000 + within_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "show_ts": [a for a, _ in out], "click_ts": [b for _, b in out]})

    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, show_ts timestamp, click_ts timestamp", "waiting long", "append", GroupStateTimeout.EventTimeTimeout)


def page_dwell(rows: DataFrame, idle_seconds: int) -> DataFrame:
    """user_id, page, page_start, page_end, n_events of each stay on a page (see operators.sequence.dwell), once it has ended.

    rows: user_id, ts, event_id, page, kind (load, wake, close, launch, or anything else). A stay ends with the next
    loading, at its time, with a waking, with a closing, and when event time has passed the user's last event by
    idle_seconds; then the user's state goes.
    """
    idle = idle_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        page, start, end, n, last = state.get if state.exists else (None, None, None, 0, None)
        out = []

        def ended(upto: int) -> None:
            out.append((key[0], page, pd.Timestamp(start, unit="us"), pd.Timestamp(max(end, upto), unit="us"), n))

        if state.hasTimedOut:
            if n:
                ended(end)
            state.remove()
        else:
            events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, own, kind in zip(events["ts"], events["page"], events["kind"], strict=True):
                micros = ts.value // 1000
                if n and micros - last > idle:
                    ended(end)
                    n = 0
                last = micros
                if kind == "launch":
                    continue
                if not n:
                    page, start, end, n = own, micros, micros, 1
                elif kind == "load":
                    ended(micros)
                    page, start, end, n = own, micros, micros, 1
                elif kind == "wake":
                    ended(end)
                    start, end, n = micros, micros, 1
                else:
                    end, n = micros, n + 1
                if kind == "close":
                    ended(end)
                    n = 0
            state.update((page, start, end, n, last))
            state.setTimeoutTimestamp(max((last + idle) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: [x[i] for x in out] for i, c in enumerate(("user_id", "page", "page_start", "page_end", "n_events"))})

    result = "user_id long, page string, page_start timestamp, page_end timestamp, n_events long"
    return rows.groupBy("user_id").applyInPandasWithState(run, result, "page string, start long, end long, n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def play_segments(rows: DataFrame, idle_seconds: int) -> DataFrame:
    """user_id, segment, seg_start, seg_end, n of each stretch of playing, once it has ended.

    rows: user_id, ts, event_id, resumes (whether the event opens a stretch), with a watermark. segment is the number of the
    user's resumings so far, 0 before the first, as in operators.sequence.segments. A stretch ends with the next resuming, and when event time has
    passed the user's last event by idle_seconds; what comes after such a pause without a resuming is another row of the
    same segment. The user's number is kept.
    """
    idle = idle_seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, start, end, n = state.get if state.exists else (0, None, None, 0)
        out = []

        def ended() -> None:
            if n:
                out.append((key[0], segment, pd.Timestamp(start, unit="us"), pd.Timestamp(end, unit="us"), n))

        if state.hasTimedOut:
            ended()
            state.update((segment, None, None, 0))
        else:
            events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
            for ts, resumes in zip(events["ts"], events["resumes"], strict=True):
                micros = ts.value // 1000
                if resumes or (n and micros - end > idle):
                    ended()
                    segment, start, n = segment + bool(resumes), micros, 0
                start, end, n = start if n else micros, micros, n + 1
            state.update((segment, start, end, n))
            state.setTimeoutTimestamp(max((end + idle) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({c: [x[i] for x in out] for i, c in enumerate(("user_id", "segment", "seg_start", "seg_end", "n"))})

    result = "user_id long, segment long, seg_start timestamp, seg_end timestamp, n long"
    return rows.groupBy("user_id").applyInPandasWithState(run, result, "segment long, start long, end long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def keyed_deltas(rows: DataFrame, forget: str | None = None) -> DataFrame:
    """id, seq, delta of each change of a feed of after images (id, seq, amount as decimal, kind), from the id's state before.

    kind is 'adds' (amount less the amount before), 'cancels' (less the amount before) or null (0), as in
    operators.changelog.state_deltas. A change that is older than the last one of its id gives nothing. With forget ('15 days'), an id that has not
    changed for so long of processing time is forgotten, and counts anew. running_sums adds the deltas up.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, before = state.get if state.exists else (None, "0")
        out, before = [], Decimal(before)
        changes = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, amount, kind in zip(changes["seq"], changes["amount"], changes["kind"], strict=True):
            if last is not None and seq <= last:
                continue
            now = Decimal(0) if amount is None else Decimal(amount)
            out.append((key[0], seq, now - before if kind == "adds" else -before if kind == "cancels" else Decimal(0)))
            last, before = seq, now
        if last is not None:
            state.update((int(last), str(before)))
        if forget is not None:
            state.setTimeoutDuration(forget)
        yield pd.DataFrame({c: [x[i] for x in out] for i, c in enumerate(("id", "seq", "delta"))})

    given = rows.select(F.col("id").cast("long").alias("id"), F.col("seq").cast("long").alias("seq"), F.col("amount").cast("decimal(38,6)").cast("string").alias("amount"), "kind")
    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return given.groupBy("id").applyInPandasWithState(run, "id long, seq long, delta decimal(38,6)", "last long, before string", "update", timeout)


def stream_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_time: str, right_time: str, ttl: str, how: str = "inner") -> DataFrame:
    """Rows of two streams (with watermarks) of equal keys whose times lie at most ttl apart: state older than that goes.

    The columns of the two must differ in name. For left joins, a row without a partner comes once its ttl has passed.
    """
    span = F.expr(f"interval {ttl}")
    near = (F.col(right_time) >= F.col(left_time) - span) & (F.col(right_time) <= F.col(left_time) + span)
    for a, b in keys:
        near = near & (F.col(a) == F.col(b))
    return left.join(right, near, how)


def running_sums(deltas: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Running totals over a whole stream: start it with output mode update."""
    return deltas.agg(*[F.sum(c).alias(n) for n, c in totals.items()])


def enriched(rows: DataFrame, column: str, fetch: Callable[[str], str | None], name: str, threads: int = 8, cache: DataFrame | None = None, timeout_seconds: float | None = None) -> DataFrame:
    """rows with fetch(column) as name: each distinct value is fetched once, threads at a time, and joined back.

    cache (column, name) holds known answers. A fetch that fails, or takes longer than timeout_seconds from its own start, gives null,
    and the next value takes its place. For
    micro-batches, call it in the writer, or see cached_enrichment.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[str | None] = [None] * len(batch)
            answers: SimpleQueue[tuple[int, float, str | None]] = SimpleQueue()

            def run(place: int, value: str, answers: SimpleQueue = answers) -> None:
                try:
                    answer = fetch(value)
                except Exception:
                    answer = None
                answers.put((place, time.monotonic(), answer))

            todo, began = deque(enumerate(batch[column])), {}
            while todo or began:
                while todo and len(began) < threads:
                    place, value = todo.popleft()
                    began[place] = time.monotonic()
                    Thread(target=run, args=(place, value), daemon=True).start()
                # Until one answers, or the time of the first to have begun is over. One that hangs is left behind.
                left = None if timeout_seconds is None else max(0.0, min(began.values()) + timeout_seconds - time.monotonic())
                try:
                    place, at, answer = answers.get(timeout=left)
                except Empty:
                    began = {p: t for p, t in began.items() if t + timeout_seconds > time.monotonic()}
                    continue
                start = began.pop(place, None)
                if start is not None and (timeout_seconds is None or at - start <= timeout_seconds):
                    found[place] = answer
            batch[name] = found
            yield batch

    todo = rows.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    if cache is not None:
        todo = todo.join(cache.select(column), column, "left_anti")
    answers = todo.mapInPandas(ask, f"`{column}` string, `{name}` string")
    if cache is not None:
        answers = answers.unionByName(cache.select(column, name))
    return rows.join(answers, column, "left")


def cached_enrichment(path: str, column: str, fetch: Callable[[str], str | None], name: str, time: str, ttl_seconds: int, then: Writer, **how) -> Writer:
    """A writer that gives rows with fetch(column) as name to then, and keeps the answers in a table at path.

    An answer is kept for ttl_seconds of the rows' time after it was last used or fetched. A batch's answers are written first,
    as a version, and its rows read them there; a batch that is run again starts from the version before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = read_version(spark, path, number)
        known = spark.createDataFrame([], f"`{column}` string, `{name}` string, used timestamp") if old is None else old
        newest = batch.agg(F.max(time)).first()[0]
        if newest is not None:
            known = known.where(F.col("used") >= F.lit(newest) - F.make_dt_interval(secs=F.lit(ttl_seconds)))
        used = batch.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(column)).agg(F.max(F.col(time).cast("timestamp")).alias("now"))
        answers = enriched(used, column, fetch, name, cache=known.select(column, name), **how)
        answers = answers.withColumnRenamed("now", "used").persist()  # it is read twice, and asked once
        try:
            kept = known.join(answers.select(column), column, "left_anti").unionByName(answers)
            kept.write.mode("overwrite").parquet(f"{path}/version={number}")
        finally:
            answers.unpersist()
        then(batch.join(spark.read.parquet(f"{path}/version={number}").drop("used"), column, "left"), number)

    return write

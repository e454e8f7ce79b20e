"""Operators over keyed state in the store: joins of change feeds, reports by the clock, and windows that run along.

State is kept a key and an entry at a time (value and map state): a batch writes the entries that it changes, whatever
else a key has. All need RocksDB state (use_rocksdb); without it the query ends with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence
from decimal import Decimal
from threading import Thread
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.changelog import DELETIONS
from tidemark.sinks import Writer

Frames = Iterator[pd.DataFrame]
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    """Texts and nulls as plain objects: what goes back to Spark must be one piece a column."""
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    plain = lambda values: all(x is None or isinstance(x, str) for x in values)
    return pd.DataFrame({n: pd.Series(v, dtype=object) if plain(v) else v for n, v in columns.items()})


class _ChangelogJoin(StatefulProcessor):
    """The rows of both sides with one join key, and what a change of one of them does to the joined rows."""

    names = ("kind", "l", "r")

    def __init__(self, how: str, ttl_ms: int | None):
        self.how, self.ttl_ms = how, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # By the side's own key: its newest row as text (null once deleted), and that row's place in the order.
        self.sides = [handle.getMapState(name, "pk string", "row string, seq long", self.ttl_ms) for name in ("left", "right")]

    def handleInputRows(self, key: Any, rows: Frames, timerValues: TimerValues) -> Frames:
        out: list[tuple] = []
        changes = [c for batch in rows for c in zip(batch["side"], batch["seq"], batch["pk"], batch["gone"], batch["row"], strict=True)]
        for side, seq, pk, gone, row in sorted(changes, key=lambda c: (c[1], c[0], c[2])):
            known = self.sides[side].getValue((pk,)) if self.sides[side].containsKey((pk,)) else None
            if known is not None and seq < known[1]:
                continue  # older than what is known
            self.sides[side].updateValue((pk,), (None if gone else row, int(seq)))
            before = None if known is None else known[0]
            out += self._changed(side, pk, before, None if gone else row)
        yield _frame(out, self.names)

    def _changed(self, side: int, pk: str, before: str | None, now: str | None) -> Iterator[tuple]:
        other = [row for _, (row, _) in self.sides[1 - side].iterator() if row is not None] if self.sides[1 - side].exists() else []
        pair = (lambda kind, mine, theirs: (kind, mine, theirs)) if side == 0 else (lambda kind, mine, theirs: (kind, theirs, mine))
        if side == 0 and self.how == "left" and not other:
            other = [None]
        # A left row that has no partner but this one stands alone before it comes, and after it goes.
        alone = side == 1 and self.how == "left" and (before is None) != (now is None) and not any(row is not None for k, (row, _) in self._entries(1) if k[0] != pk)
        for theirs in other:
            if before is not None:
                yield pair("-U" if now is not None else "-D", before, theirs)
            elif now is not None and alone:
                yield ("-D", theirs, None)
            if now is not None:
                yield pair("+U" if before is not None else "+I", now, theirs)
            elif before is not None and alone:
                yield ("+I", theirs, None)

    def _entries(self, side: int) -> list:
        return list(self.sides[side].iterator()) if self.sides[side].exists() else []

    def close(self) -> None:
        pass


def changelog_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_key: Sequence[str], right_key: Sequence[str], seq: tuple[str, str], op: tuple[str | None, str | None] = (None, None), how: str = "inner", ttl_ms: int | None = None) -> DataFrame:
    """The change feed of the join of two change feeds: kind (+I, -U, +U, -D), and both sides' columns.

    Each feed holds rows by its key; a later one (by seq, a whole number) replaces an earlier one, and one whose op is d or -D
    takes it away. A change gives what it takes from the joined rows, then what it adds; rows that come late and are
    older than what is known give nothing. With how='left', a left row without partners has nulls until one comes.
    State is kept a row at a time. A row that has not changed for ttl_ms of processing time is forgotten, without a
    retraction; such a query goes on by the clock, so start it with every=..., as without it it would not end. Rows whose join columns hold null have no partners. A row must not change its join columns; if it does, send
    its deletion under the old ones first. The two sides' columns must differ in name.
    """

    def side(rows: DataFrame, number: int, columns: list[str], key: Sequence[str]) -> DataFrame:
        joined = F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"})
        null = F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1
        pk = F.to_json(F.struct(*key), {**_JSON, "ignoreNullFields": "false"})
        gone = F.coalesce(F.col(op[number]).isin(*DELETIONS), F.lit(False)) if op[number] else F.lit(False)
        out = rows.select(F.when(null, F.concat(F.lit("null"), pk)).otherwise(joined).alias("k"), null.alias("no_key"), F.lit(number).alias("side"), pk.alias("pk"), F.col(seq[number]).cast("long").alias("seq"), gone.alias("gone"), F.to_json(F.struct(*rows.columns), _JSON).alias("row"))
        return (out if number == 0 and how == "left" else out.where("not no_key")).drop("no_key")

    both = side(left, 0, [a for a, _ in on], left_key).unionByName(side(right, 1, [b for _, b in on], right_key))
    found = both.groupBy("k").transformWithStateInPandas(_ChangelogJoin(how, ttl_ms), "kind string, l string, r string", "update", "none" if ttl_ms is None else "processingTime")
    found = found.select("kind", F.from_json("l", left.schema, _JSON).alias("l"), F.from_json("r", right.schema, _JSON).alias("r"))
    return found.select("kind", "l.*", "r.*")


class _TimedTopN(StatefulProcessor):
    def __init__(self, n: int, every_ms: int, group: str, item: str):
        self.n, self.every_ms, self.group, self.item = n, every_ms, group, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "item string", "amount string")
        self.next = handle.getValueState("next", "at long")

    def _wait(self, after: int) -> None:
        at = (after // self.every_ms + 1) * self.every_ms
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key: Any, rows: Frames, timerValues: TimerValues) -> Frames:
        change: dict[str, Decimal] = {}
        for batch in rows:
            for item, amount in zip(batch["item"], batch["amount"], strict=True):
                change[item] = change.get(item, Decimal(0)) + Decimal(amount)
        for item, amount in change.items():
            known = Decimal(self.sums.getValue((item,))[0]) if self.sums.containsKey((item,)) else Decimal(0)
            if known + amount:
                self.sums.updateValue((item,), (str(known + amount),))
            elif self.sums.containsKey((item,)):
                self.sums.removeKey((item,))
        if not self.next.exists():
            self._wait(timerValues.getCurrentProcessingTimeInMs())
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Frames:
        known = [(i, Decimal(a)) for (i,), (a,) in self.sums.iterator()] if self.sums.exists() else []
        best = heapq.nsmallest(self.n, known, key=lambda x: (-x[1], x[0]))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        if known:
            self._wait(timerValues.getCurrentProcessingTimeInMs())
        else:
            self.next.clear()
        yield _frame([(at, key[0], i, str(a), rn) for rn, (i, a) in enumerate(best, 1)], ("report_time", self.group, self.item, "amount", "rn"))

    def close(self) -> None:
        pass


def top_n_by_clock(rows: DataFrame, group: str, item: str, amount: Column, n: int, every_ms: int = 60_000) -> DataFrame:
    """report_time, group, item, amount, rn: every every_ms of the clock, the n items of each group with the largest sums so far.

    Each group has a timer that sets itself again, so a stream without new rows goes on reporting; start it with every=... A retracted row is given
    with its amount negated. Ties go to the smaller item, as text.
    """
    given = rows.select(F.col(group).cast("string").alias(group), F.col(item).cast("string").alias("item"), amount.cast("decimal(38,6)").cast("string").alias("amount"))
    out = f"report_time timestamp, `{group}` string, `{item}` string, amount string, rn int"
    return given.groupBy(group).transformWithStateInPandas(_TimedTopN(n, every_ms, group, item), out, "update", "processingTime").withColumn("amount", F.col("amount").cast("decimal(38,6)"))


class _Along(StatefulProcessor):
    """Something that is given at each end of a step, from a key's first row until finished, as event time passes it."""

    step_ms: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at long")

    def _wait(self, at: int) -> None:
        """The step that ends at `at` is to be closed next, unless an earlier one is."""
        if self.next.exists():
            known = self.next.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Frames:
        at, now, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        self.next.clear()
        while at is not None and at <= now:
            at = self._closed(key, at, out)
        if at is not None:
            self._wait(at)
        yield _frame(out, self.names)

    names: Sequence[str]

    def _closed(self, key: Any, at: int, out: list[tuple]) -> int | None:
        """Closes the step that ends at `at`: adds rows to out, and gives the end of the next, or None after the last."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Cumulate(_Along):
    def __init__(self, step_ms: int, keys: Sequence[str], sums: Sequence[str], distincts: Sequence[str]):
        self.step_ms, self.keys, self.sums, self.distincts = step_ms, list(keys), list(sums), list(distincts)
        self.values = [*self.sums, *self.distincts]
        self.names = ["window_start", "window_end", *self.keys, *self.values]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getMapState("seen", "which int, value string", "first long")  # the end of the step that saw it first
        self.steps = handle.getMapState("steps", "at long", "added array<long>")  # of steps that are not closed
        self.total = handle.getValueState("total", "total array<long>")

    def handleInputRows(self, key: Any, rows: Frames, timerValues: TimerValues) -> Frames:
        added: dict[int, list[int]] = {}
        blank = lambda: [0] * len(self.values)
        firsts: dict[tuple[int, str], int] = {}
        for batch in rows:
            for at, *values in zip(batch["step_end"], *(batch[f"value{i}"] for i in range(len(self.values))), strict=True):
                here = added.setdefault(int(at), blank())
                for i, v in enumerate(values[: len(self.sums)]):
                    here[i] += 0 if pd.isna(v) else int(v)
                for i, v in enumerate(values[len(self.sums) :]):
                    if v is not None and v == v:
                        firsts[i, v] = min(int(at), firsts.get((i, v), int(at)))
        for (i, v), at in firsts.items():
            known = self.seen.getValue((i, v))[0] if self.seen.containsKey((i, v)) else None
            if known is not None and known <= at:
                continue
            self.seen.updateValue((i, v), (at,))
            added[at][len(self.sums) + i] += 1
            if known is not None:  # its step is later, so not closed yet either
                added.setdefault(known, blank())[len(self.sums) + i] -= 1
        for at, more in added.items():
            known = list(self.steps.getValue((at,))[0]) if self.steps.containsKey((at,)) else blank()
            self.steps.updateValue((at,), ([a + b for a, b in zip(known, more, strict=True)],))
        if added:
            self._wait(min(added))
        yield from ()

    def _closed(self, key: Any, at: int, out: list[tuple]) -> int | None:
        total = list(self.total.get()[0]) if self.total.exists() else [0] * len(self.values)
        if self.steps.containsKey((at,)):
            total = [a + b for a, b in zip(total, self.steps.getValue((at,))[0], strict=True)]
            self.steps.removeKey((at,))
            self.total.update((total,))
        day = int(key[0])
        out.append((pd.Timestamp(day, unit="ms"), pd.Timestamp(at, unit="ms"), *key[1 : 1 + len(self.keys)], *total))
        if at < day + 86_400_000:
            return at + self.step_ms
        for state in (self.seen, self.steps, self.total):
            state.clear()
        return None


def cumulate_stream(rows: DataFrame, time: str, step_minutes: int, keys: Sequence[str], sums: Mapping[str, Column], distincts: Mapping[str, Column], shards: int = 8) -> DataFrame:
    """window_start, window_end, keys, sums, distincts: for each step since the day's start, a row of each shard, once event time has
    passed the step. Give them to in_whole_windows, which adds the shards up: the result equals operators.windows.cumulate.

    rows need a watermark. A day's rows of keys are dealt to shards by their distinct values (rows of several distincts by
    the first, which then each shard counts for itself: give values of one such as the user, or parts of it), so one
    busy key is the work of many tasks. The state of a shard is each value's first step, the open steps, and the totals.
    Sums are whole numbers; days are those of UTC.
    """
    step, millis = step_minutes * 60_000, F.unix_millis(F.col(time).cast("timestamp"))
    deal = F.pmod(F.xxhash64(*([next(iter(distincts.values()))] if distincts else [F.col(time)])), F.lit(shards))
    # Spark gives the processor no names that begin with an underscore.
    values = [F.coalesce(c.cast("long"), F.lit(0)) for c in sums.values()] + [c.cast("string") for c in distincts.values()]
    values = [c.alias(f"value{i}") for i, c in enumerate(values)]
    given = rows.select(F.col(time), (millis - F.pmod(millis, F.lit(86_400_000))).alias("day_ms"), *keys, deal.alias("shard"), ((F.floor(millis / step) + 1) * step).alias("step_end"), *values)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(["window_start timestamp", "window_end timestamp", *[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` long" for n in (*sums, *distincts)]])
    return given.groupBy("day_ms", *keys, "shard").transformWithStateInPandas(_Cumulate(step, keys, list(sums), list(distincts)), out, "append", "eventTime")


def in_whole_windows(keys: Sequence[str], names: Sequence[str], then: Writer) -> Writer:
    """A writer for cumulate_stream and hop_stream: their shards' rows added up, a row a window and keys, given to then.

    All shards close a window in the batch in which event time passes it, so a batch holds whole windows; what is asked of
    one window, such as its top n, can be asked of the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        then(batch.groupBy("window_start", "window_end", *keys).agg(*[F.sum(n).alias(n) for n in names]), number)

    return write


class _Hop(_Along):
    def __init__(self, size_ms: int, step_ms: int, keys: Sequence[str], names: Sequence[str]):
        self.size_ms, self.step_ms, self.keys, self.sums = size_ms, step_ms, list(keys), list(names)
        self.names = ["window_start", "window_end", *self.keys, *self.sums]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.panes = handle.getMapState("panes", "at long", "sums array<long>")  # by the end of each pane; the last is the rows' number
        self.total = handle.getValueState("total", "total array<long>")

    def handleInputRows(self, key: Any, rows: Frames, timerValues: TimerValues) -> Frames:
        added: dict[int, list[int]] = {}
        for batch in rows:
            for at, *values in zip(batch["step_end"], *(batch[f"value{i}"] for i in range(len(self.sums))), strict=True):
                here = added.setdefault(int(at), [0] * (len(self.sums) + 1))
                for i, v in enumerate([*values, 1]):
                    here[i] += int(v)
        for at, more in added.items():
            known = list(self.panes.getValue((at,))[0]) if self.panes.containsKey((at,)) else [0] * len(more)
            self.panes.updateValue((at,), ([a + b for a, b in zip(known, more, strict=True)],))
        if added:
            self._wait(min(added))
        yield from ()

    def _closed(self, key: Any, at: int, out: list[tuple]) -> int | None:
        """The window that ends at `at` has gained the pane that ends with it, and what the last one lost is gone."""
        total = list(self.total.get()[0]) if self.total.exists() else [0] * (len(self.sums) + 1)
        if self.panes.containsKey((at,)):
            total = [a + b for a, b in zip(total, self.panes.getValue((at,))[0], strict=True)]
        if total[-1]:
            out.append((pd.Timestamp(at - self.size_ms, unit="ms"), pd.Timestamp(at, unit="ms"), *key[: len(self.keys)], *total[:-1]))
        oldest = at - self.size_ms + self.step_ms
        if self.panes.containsKey((oldest,)):
            total = [a - b for a, b in zip(total, self.panes.getValue((oldest,))[0], strict=True)]
            self.panes.removeKey((oldest,))
        if total[-1]:
            self.total.update((total,))
            return at + self.step_ms
        self.total.clear()
        later = [k[0] for k in self.panes.keys()] if self.panes.exists() else []
        return min(later, default=None)


def hop_stream(rows: DataFrame, time: str, size_minutes: int, step_minutes: int, keys: Sequence[str], sums: Mapping[str, Column], shards: int = 1) -> DataFrame:
    """window_start, window_end, keys, sums of each sliding window that has rows, a row of each shard, once event time has passed it.

    rows need a watermark. The state of a key is a sum a step (pane) of the open windows and one running total: a window's end adds
    its newest pane and takes its oldest away, so no row is copied to the windows that hold it. With shards, give the
    result to in_whole_windows. Sums are whole numbers.
    """
    step, millis = step_minutes * 60_000, F.unix_millis(F.col(time).cast("timestamp"))
    values = [F.coalesce(c.cast("long"), F.lit(0)).alias(f"value{i}") for i, c in enumerate(sums.values())]
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(shards)).alias("shard")
    given = rows.withColumn("__deal", deal).select(F.col(time), *keys, F.col("__deal").alias("shard"), ((F.floor(millis / step) + 1) * step).alias("step_end"), *values)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(["window_start timestamp", "window_end timestamp", *[f"`{k}` {kinds[k]}" for k in keys], *[f"`{n}` long" for n in sums]])
    return given.groupBy(*keys, "shard").transformWithStateInPandas(_Hop(size_minutes * 60_000, step, keys, list(sums)), out, "append", "eventTime")


class _Cached(StatefulProcessor):
    def __init__(self, fetch: Callable[[str], str | None], ttl_ms: int, timeout_seconds: float | None, names: Sequence[str]):
        self.fetch, self.ttl_ms, self.timeout_seconds, self.names = fetch, ttl_ms, timeout_seconds, list(names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "answer string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Frames, timerValues: TimerValues) -> Frames:
        texts = [t for batch in rows for t in batch["row"]]
        if key[0] is None:
            answer = None
        elif self.answer.exists():
            answer = self.answer.get()[0]
            self.answer.update((answer,))  # its time begins anew
        else:
            got, answer = fetched(self.fetch, key[0], self.timeout_seconds)
            if got:
                self.answer.update((answer,))
        yield _frame([(t, answer) for t in texts], self.names)

    def close(self) -> None:
        pass


def fetched(fetch: Callable[[str], str | None], value: str, timeout_seconds: float | None) -> tuple[bool, str | None]:
    """(whether it came in time and without an error, the answer)"""
    found: list[str | None] = []
    asks = Thread(target=lambda: found.append(fetch(value)), daemon=True)
    asks.start()
    asks.join(timeout_seconds)
    return bool(found), found[0] if found else None


def cached_answers(rows: DataFrame, column: str, fetch: Callable[[str], str | None], name: str, ttl_ms: int, timeout_seconds: float | None = None) -> DataFrame:
    """rows with fetch(column) as name. An answer is kept in the state store for ttl_ms of processing time after it was last used.

    A batch writes the answers that it uses, whatever else is kept; the store lets go of the others. A key's rows in a batch ask once, and a fetch that fails
    or takes longer than timeout_seconds gives null, and is asked again the next time. Each task asks for one key after another:
    streaming.enriched asks for several at once, where no cache is wanted. Start it with every=...
    """
    given = rows.select(F.col(column).cast("string").alias("asked"), F.to_json(F.struct(*rows.columns), _JSON).alias("row"))
    out = given.groupBy("asked").transformWithStateInPandas(_Cached(fetch, ttl_ms, timeout_seconds, ["row", "answer"]), "row string, answer string", "update", "processingTime")
    return out.select(F.from_json("row", rows.schema, _JSON).alias("row"), F.col("answer").alias(name)).select("row.*", name)

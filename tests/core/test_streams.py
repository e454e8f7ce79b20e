"""Streams over several micro-batches against batches: changing rules, change feeds, timers, windows, segments, deltas."""

import itertools
import time
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.core.test_core import collected, event_stream, in_batches, values  # noqa: F401 - event_stream is a fixture
from tidemark import functions as fn
from tidemark import sinks, sources, streaming
from tidemark.operators import bitmaps, changelog, rules, sequence, windows
from tidemark.operators.rules import Condition, Rule
from tidemark.streaming import engine, stateful


@pytest.fixture
def rocksdb(spark):
    streaming.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


# Rules that change


def _events(spark, rows):
    """(user, event, second) as events; their numbers are their places."""
    df = spark.createDataFrame([(u, i, k, t) for i, (u, k, t) in enumerate(rows)], "user_id long, event_id long, event_type string, s int")
    return df.select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts"), F.create_map(F.lit("k"), F.lit("1")).alias("properties"))


def _engine(spark, tmp_path, steps, replay=0, seeds=None):
    """The matches (rule, user, second) of each step (rules in force, events), with a new engine for each."""
    out = []
    for number, (active, rows) in enumerate(steps):
        got = []
        then = lambda df, n: got.extend((r.rule_id, r.user_id, int(r.match_time.timestamp())) for r in df.collect())  # noqa: B023, E731
        engine.rule_engine(str(tmp_path / "engine"), lambda: active, then, replay, seeds=seeds, buckets=4)(_events(spark, rows), number)  # noqa: B023
        out.append(sorted(got))
    return out


def test_an_updated_rule_counts_only_what_happened(spark, tmp_path):
    a = Rule("r", Condition("x"), [Condition("a", 3)])
    b = Rule("r", Condition("x"), [Condition("b", 3)])
    steps = [([a], [(1, "a", 1), (1, "a", 2), (1, "a", 3)]), ([b], [(1, "x", 4)]), ([b], [(1, "b", 5), (1, "b", 6), (1, "b", 7), (1, "x", 8)])]
    assert _engine(spark, tmp_path, steps) == [[], [], [("r", 1, 8)]]


def test_moved_conditions_and_new_thresholds_keep_their_counts(spark, tmp_path):
    a, b, c = Condition("a", 2, flag="1"), Condition("b", 1, flag="2"), Condition("c", 1, flag="3")
    rule = lambda *counted: Rule("r", Condition("x"), list(counted))
    steps = [
        ([rule(a, b)], [(1, "a", 1), (1, "a", 2), (1, "b", 3), (2, "a", 4), (2, "b", 5)]),
        ([rule(b, a)], [(1, "x", 6), (2, "x", 7)]),  # in another order
        ([rule(c, b, a)], [(1, "x", 8)]),  # one is new, and starts at 0
        ([rule(a)], [(1, "x", 9), (2, "a", 10), (2, "x", 11)]),  # shortened
        ([rule(Condition("a", 4, flag="1"))], [(1, "x", 12), (1, "a", 13), (1, "a", 14), (1, "x", 15)]),  # another threshold
        ([rule(a, b)], [(1, "x", 16), (1, "b", 17), (1, "x", 18)]),  # back again: from 0
    ]
    assert _engine(spark, tmp_path, steps) == [[], [("r", 1, 6)], [], [("r", 1, 9), ("r", 2, 11)], [("r", 1, 15)], [("r", 1, 18)]]


def test_another_sequence_starts_over(spark, tmp_path):
    rule = lambda *steps: Rule("r", Condition("x"), sequence=steps)
    steps = [([rule("a", "b")], [(1, "a", 1)]), ([rule("c", "b")], [(1, "b", 2), (1, "x", 3)]), ([rule("c", "b")], [(1, "c", 4), (1, "b", 5), (1, "x", 6)])]
    assert _engine(spark, tmp_path, steps) == [[], [], [("r", 1, 6)]]


def test_seeds_of_one_flag_add_up(spark, tmp_path):
    seeds = lambda: spark.createDataFrame([("r", "1", 1, 1), ("r", "1", 1, 1)], "rule_id string, flag_id string, user_id long, cnt long")
    steps = [([Rule("r", Condition("x"), [Condition("a", 3)])], [(1, "x", 1), (1, "a", 2), (1, "x", 3)])]
    assert _engine(spark, tmp_path, steps, seeds=seeds) == [[("r", 1, 3)]]


def _brute_engine(steps, replay):
    """What rules that change must fire: counts by (rule, condition, user), one event after another."""
    counts, passed, known, recent, out = defaultdict(Counter), defaultdict(Counter), {}, [], []
    for active, rows in steps:
        now = [(t, i, u, k) for i, (u, k, t) in enumerate(rows)]
        found = []
        for gone in [x for x in counts if x not in {(r.rule_id, i) for r in active for i in rules.condition_ids(r)}]:
            del counts[gone]
        for gone in [x for x in passed if x not in {(r.rule_id, r.sequence) for r in active}]:
            del passed[gone]
        for r in active:
            for t, _, u, k in sorted(now if r.rule_id in known else recent + now):
                for i, c in zip(rules.condition_ids(r), r.counted, strict=True):
                    counts[r.rule_id, i][u] += k == c.event
                if r.sequence and k == r.sequence[passed[r.rule_id, r.sequence][u] % len(r.sequence)]:
                    passed[r.rule_id, r.sequence][u] += 1
                met = all(counts[r.rule_id, i][u] >= c.least for i, c in zip(rules.condition_ids(r), r.counted, strict=True))
                if k == r.fire.event and met and (not r.sequence or passed[r.rule_id, r.sequence][u] // len(r.sequence) >= r.times):
                    found.append((r.rule_id, u, t))
        known = {r.rule_id for r in active}
        recent = [(t, i - len(rows), u, k) for t, i, u, k in recent + now]
        newest = max((e[0] for e in recent), default=0)
        recent = [e for e in recent if e[0] > newest - replay]
        out.append(sorted(found))
    return out


def test_changing_rules_equal_a_count_by_hand(spark, tmp_path):
    """Rules come, change in each way, go and come back, over six batches of users' events."""
    import random

    rng, t = random.Random(7), itertools.count(1)
    batch = lambda: [(rng.randrange(6), rng.choice("abcx"), next(t)) for _ in range(60)]
    one = [Rule("one", Condition("x"), [Condition("a", 3, flag="1"), Condition("b", 9, flag="2")])]
    moved = [Rule("one", Condition("x"), [Condition("b", 4, flag="2"), Condition("c", 2, flag="3"), Condition("a", 3, flag="1")])]
    other = [Rule("one", Condition("b"), [Condition("c", 6, flag="1")])]
    order = [Rule("order", Condition("x"), sequence=("a", "b", "a"), times=2)]
    order2 = [Rule("order", Condition("c"), [Condition("a", 2)], sequence=("b", "c"), times=1)]
    late = [Rule("late", Condition("c"), [Condition("a", 2)])]
    steps = [(one + order, batch()), (moved + order, batch()), (moved + order2 + late, batch()), (other + late, batch()), (one + order2, batch()), (one + order2 + late, batch())]
    got = _engine(spark, tmp_path, steps, replay=30)
    assert got == _brute_engine(steps, 30) and {x[0] for found in got for x in found} == {"one", "order", "late"}


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    import glob

    rule = [Rule("r", Condition("x"), [Condition("a", 1)])]
    many = [(u, "a", u) for u in range(40)]
    assert _engine(spark, tmp_path, [(rule, many), (rule, [(7, "a", 50)]), (rule, [(7, "x", 51), (8, "x", 52)])]) == [[], [], [("r", 7, 51), ("r", 8, 52)]]
    written = lambda n: len(glob.glob(f"{tmp_path}/engine/state/rows={n}/__bucket=*"))
    assert written(0) == 4 and written(1) == 1


def test_rules_read_the_events_that_they_name(spark, sf):
    """The types of events reach the scan, and a rule without counts shuffles nothing."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("properties", fn.property_map(F.col("props")))
    plan = rules.evaluate(rows, Rule("r", Condition("purchase", properties=[("k", "=", ["7"])])))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in plan.replace("In(event_type, [purchase])", "EqualTo(event_type,purchase)")
    assert "hashpartitioning" not in plan
    plan = rules.evaluate(rows, Rule("r", Condition("purchase"), [Condition("click", 2)]))._jdf.queryExecution().executedPlan().toString()
    assert "In(event_type, [click,purchase])" in plan and plan.count("hashpartitioning") == 1


def test_many_profile_conditions_are_one_plan(spark):
    profile = spark.createDataFrame([(u, str(u % 5), u) for u in range(50)], "user_id long, job string, age long")
    made = lambda n: [Rule(f"r{i}", Condition("x"), profile=[("job", "in", [str(i % 5), "9"]), ("age", ">=", [i])]) for i in range(n)]
    rows = _events(spark, [(u, "x", u) for u in range(50)])
    got = {(r.rule_id, r.user_id) for r in rules.evaluate_all(rows, made(40), profile).collect()}
    assert got == {(f"r{i}", u) for i in range(40) for u in range(50) if u % 5 == i % 5 and u >= i}
    nodes = lambda n: rules.evaluate_all(rows, made(n), profile)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert nodes(3) == nodes(30)


def test_fold_of_steps_over_small_batches(spark):
    """Users' steps cut into Arrow batches of a few rows; rows that are no step carry on what was passed."""
    rows = [(u, i, "abx"[(i * (u + 2) + u) % 3]) for u in range(7) for i in range(23)]
    df = spark.createDataFrame(rows, "u long, i int, k string").withColumns({"n_steps": F.lit(2), "start": F.when(F.col("u") == 3, 5).cast("long"), "hits": F.when(F.col("k") == "a", F.array(F.lit(0))).when(F.col("k") == "b", F.array(F.lit(1)))})
    want = {}
    for u in range(7):
        at = 5 if u == 3 else 0
        for _, i, k in [r for r in rows if r[0] == u]:
            at += k == "ab"[at % 2]
            want[u, i] = at
    for size in (1, 4, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {(r.u, r.i): r.passed for r in sequence.fold_steps(df, ["u"], ["i"]).collect()} == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Change feeds

ORDER, ITEM = "oid int, status string, amount decimal(10,2), oseq long, oop string", "iid int, item_oid int, brand string, iseq long, iop string"


def _latest_join(spark, orders, items, how):
    a = changelog.latest(spark.createDataFrame(orders, ORDER), ["oid"], ["oseq"], "oop")
    b = changelog.latest(spark.createDataFrame(items, ITEM), ["iid"], ["iseq"], "iop")
    return Counter(map(tuple, a.join(b, F.col("oid") == F.col("item_oid"), how).select("oid", "status", "amount", "iid", "brand").collect()))


FEED = [  # orders, items of each batch
    ([(1, "new", Decimal("5.25"), 1, "c"), (2, "new", None, 1, "c"), (3, "new", Decimal(1), 1, "c")], [(10, 1, "a", 1, "c")]),
    ([(1, "paid", Decimal("5.25"), 2, "u")], [(20, 2, "b", 1, "c"), (21, 2, "c", 1, "c")]),
    ([], [(20, 2, "B", 2, "u"), (21, 2, "c", 2, "d"), (40, 4, "z", 1, "c"), (50, None, "n", 1, "c")]),
    ([(2, "gone", None, 2, "d"), (4, "new", Decimal(9), 1, "c"), (1, "late", None, 1, "u"), (None, "nobody", None, 1, "c")], [(10, 1, "a", 3, "d")]),
    ([(2, "back", Decimal(7), 3, "c"), (4, "paid", Decimal(9), 2, "u"), (4, "sent", Decimal(9), 3, "u")], [(10, 1, "late", 2, "u"), (31, 3, "x", 1, "c"), (31, 3, "y", 2, "u")]),
]


def _feeds(spark, tmp_path, feed):
    """Streams of the two feeds, a file a batch and side."""
    out = []
    for side, (name, schema) in enumerate((("orders", ORDER), ("items", ITEM))):
        path = str(tmp_path / name)
        for rows in feed:
            spark.createDataFrame(rows[side], schema).coalesce(1).write.mode("append").parquet(path)
            time.sleep(0.01)
        out.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    return out


@pytest.mark.parametrize("how", ["inner", "left"])
def test_changelog_join_equals_the_join_of_the_latest_rows(spark, rocksdb, tmp_path, how):
    orders, items = _feeds(spark, tmp_path, FEED)
    feed = stateful.changelog_join(orders, items, [("oid", "item_oid")], ["oid"], ["iid"], ("oseq", "iseq"), ("oop", "iop"), how)
    folded, kinds, seen = Counter(), set(), []

    def fold(batch, number):
        for r in batch.select("kind", "oid", "status", "amount", "iid", "brand").collect():
            folded[tuple(r)[1:]] += 1 if r.kind in ("+I", "+U") else -1
            kinds.add(r.kind)
        assert min(folded.values(), default=0) >= 0
        known = FEED[: number + 1]
        assert +folded == _latest_join(spark, [o for b in known for o in b[0]], [i for b in known for i in b[1]], how)
        seen.append(number)

    assert sinks.start(feed, fold, str(tmp_path / "check")).awaitTermination(300)
    assert seen == list(range(len(FEED))) and kinds == {"+I", "-U", "+U", "-D"}


def test_changelog_join_forgets(spark, rocksdb, tmp_path):
    """An order that is older than the time to live has no state left: its late item finds nothing."""
    feed = [([(1, "new", None, 1, "c")], []), ([], [(10, 1, "a", 1, "c")])]
    for ttl, n in ((3_600_000, 1), (1000, 0)):
        orders, items = _feeds(spark, tmp_path / str(ttl), feed)
        got, batches = [], []

        def note(batch, number, ttl=ttl, got=got, batches=batches):
            got.extend(batch.collect())
            batches.append(number)
            if ttl < 5000 and not number:
                time.sleep(2.5 * ttl / 1000)

        joined = stateful.changelog_join(orders, items, [("oid", "item_oid")], ["oid"], ["iid"], ("oseq", "iseq"), ttl_ms=ttl)
        q = sinks.start(joined, note, str(tmp_path / f"check{ttl}"), every="100 milliseconds")
        try:
            for _ in range(120):
                time.sleep(0.5)
                if len(batches) >= 3:
                    break
        finally:
            q.stop()
        assert len(batches) >= 3 and len(got) == n


@pytest.mark.parametrize("how", ["inner", "left"])
def test_changes_of_a_join_fold_to_the_join_at_any_time(spark, how):
    """The batch form: folded up to each time, it is the join of the rows in force by then."""
    import random

    rng = random.Random(11)
    when = lambda n: sorted(rng.sample(range(40), n))
    orders = [(o, f"s{t}", None, t, rng.choice("ccd")) for o in range(4) for t in when(4)] + [(None, "n", None, 3, "c")]
    items = [(i, i % 5, f"b{t}", t, rng.choice("cccd")) for i in range(9) for t in when(4)] + [(99, None, "n", 1, "c")]
    a, b = spark.createDataFrame(orders, ORDER), spark.createDataFrame(items, ITEM)
    feed = changelog.join_changes(a, b, [("oid", "item_oid")], ["oid"], ["iid"], ("oseq", "iseq"), ("oop", "iop"), how).collect()
    assert {r.kind for r in feed} == {"+I", "-U", "+U", "-D"}
    for t in range(0, 41, 4):
        folded = Counter()
        for r in feed:
            if r["at"] <= t:
                folded[r.oid, r.status, r.amount, r.iid, r.brand] += 1 if r.kind[0] == "+" else -1
        assert +folded == _latest_join(spark, [o for o in orders if o[3] <= t], [i for i in items if i[3] <= t], how) and min(folded.values(), default=0) >= 0


def test_deltas_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(i % 5, i, f"{i * 7 % 13}.50", ("adds", "adds", "cancels", None)[i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, seq long, a string, kind string").select("id", "seq", F.col("a").cast("decimal(18,2)").alias("amount"), "kind")
    path = str(tmp_path / "in")
    for lo in range(0, 40, 10):
        df.where((F.col("seq") >= lo) & (F.col("seq") < lo + 10)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = collected(spark, streaming.keyed_deltas(stream), "deltas", tmp_path, "update")
    want = changelog.state_deltas(df, ["id"], ["seq"], {"delta": (F.col("amount"), F.col("kind"))})
    assert sorted((r.id, r.seq, float(r.delta)) for r in got.collect()) == sorted((r.id, r.seq, float(r.delta)) for r in want.collect())
    summed = got.agg(F.sum("delta")).first()[0]
    assert summed == want.agg(F.sum("delta")).first()[0] and spark.table("deltas").count() == 40


def test_deleted_keys_are_gone(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda number, *rows: sinks.upsert_parquet(path, ["k"], ["seq"], buckets=4, op="op", remembered=3)(spark.createDataFrame(list(rows), "k int, seq int, op string, v string"), number)
    left = lambda: {r.k: r.v for r in sinks.read_upserted(spark, path).collect()}
    write(0, (1, 1, "c", "a"), (2, 1, "c", "b"), (3, 1, "r", "c"))
    for _ in range(2):  # a batch that is run again changes nothing
        write(1, (1, 3, "d", None), (2, 2, "u", "B"))
        assert left() == {2: "B", 3: "c"}
    write(2, (1, 2, "u", "late"), (3, 2, "-D", None))
    assert left() == {2: "B"}
    assert sinks.read_upserted(spark, path).columns == ["k", "seq", "op", "v"]
    write(3, (1, 4, "c", "again"), (3, 3, "+I", "new"))
    assert left() == {1: "again", 2: "B", 3: "new"}
    write(4, (2, 3, "d", None))
    write(9, (2, 1, "u", "far too late"))  # the deletion is no longer remembered
    assert left() == {1: "again", 3: "new"} or left() == {1: "again", 2: "far too late", 3: "new"}
    write(10, (1, 5, "d", None), (2, 9, "d", None), (3, 9, "d", None))
    assert left() == {}


# Timers and windows


def test_timers_report_while_nothing_comes(spark, rocksdb, tmp_path):
    rows = [("a", 1, "2.50"), ("a", 2, "9"), ("a", 3, "9"), ("a", 2, "-8"), ("b", 7, "1"), ("c", 8, "5"), ("c", 8, "-5")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "brand string, product int, amount string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("brand string, product int, amount string").parquet(path)
    reports = []
    top = stateful.top_n_by_clock(stream, "brand", "product", F.col("amount"), 2, every_ms=2000)
    q = sinks.start(top, lambda b, n: reports.extend(map(tuple, b.collect())), str(tmp_path / "check"), every="500 milliseconds", mode="update")
    try:
        for _ in range(240):
            time.sleep(0.5)
            if len({r[0] for r in reports}) >= 3:
                break
    finally:
        q.stop()
    by_time = defaultdict(list)
    for at, *row in reports:
        assert at.timestamp() % 2 == 0
        by_time[at].append((row[0], row[1], float(row[2]), row[3]))
    want = [("a", "1", 2.5, 2), ("a", "3", 9.0, 1), ("b", "7", 1.0, 1)]
    # The first may have come when not all brands had been read; the later ones come without any new row.
    assert len(by_time) >= 3 and all(sorted(by_time[at]) == want for at in sorted(by_time)[1:3])


def _windows(df, *columns):
    return values(df.select(F.unix_seconds(F.col("window_start").cast("timestamp")).alias("a"), F.unix_seconds(F.col("window_end").cast("timestamp")).alias("z"), *columns).toPandas())


def _by_window(spark, stream, keys, names, tmp_path):
    """Everything that in_whole_windows gives, and how often each window and keys came."""
    out = str(tmp_path / "out")
    assert sinks.start(stream, stateful.in_whole_windows(keys, names, sinks.append_parquet(out)), str(tmp_path / "check")).awaitTermination(600)
    return spark.read.parquet(out).drop("batch")


def test_cumulate_stream_equals_cumulate(spark, rocksdb, event_stream, tmp_path):  # noqa: F811
    """Three batches; rows come in any order within two days, the last ones late for most of their day's steps."""
    rows, _ = event_stream
    first = rows.agg(F.min("ts")).first()[0]
    rows = rows.where(F.col("ts") < F.lit(first) + F.expr("interval 3 days")).persist()
    path = str(tmp_path / "in")
    last = rows.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).first()[0]
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    rows.limit(1).select(*[F.lit(last).alias(c) if c == "ts" else F.lit("far").alias(c) if c == "event_type" else F.col(c) for c in rows.columns]).coalesce(1).write.mode("append").parquet(path)
    stream = sources.parquet_files(spark, path, stream=True, files_a_batch=1).withWatermark("ts", "4 days")
    sums, distincts = {"pv": F.when(F.col("event_type") == "view", 1)}, {"uv": F.col("user_id"), "new": F.when(F.col("user_id") % 4 == 0, F.col("user_id"))}
    shards = stateful.cumulate_stream(stream, "ts", 60, ["event_type"], sums, distincts, shards=3)
    got = _by_window(spark, shards, ["event_type"], ["pv", "uv", "new"], tmp_path).where("event_type <> 'far'")
    want = windows.cumulate(rows, "ts", 60, ["event_type"], sums, distincts)
    columns = ["event_type", "pv", "uv", "new"]
    assert _windows(got, *columns) == _windows(want.withColumn("pv", F.coalesce("pv", F.lit(0))), *columns) and want.count() > 100


def test_sliding_top_n_on_a_stream_equals_the_batch(spark, rocksdb, event_stream, tmp_path):  # noqa: F811
    rows, _ = event_stream
    rows = rows.where("event_type = 'view'").withColumn("item", F.get_json_object("props", "$.k").cast("long") % 7)
    stream = in_batches(spark, rows, tmp_path, 3).withWatermark("ts", "1 hour")
    shards = stateful.hop_stream(stream, "ts", 12 * 60, 120, ["event_type", "item"], {"pv": F.lit(1)}, shards=2)
    got = _by_window(spark, shards, ["event_type", "item"], ["pv"], tmp_path).where("window_end < '2024-12-01'")
    want = windows.hop_sums(rows, "ts", 12 * 60, 120, ["event_type", "item"], {"pv": F.lit(1)})
    columns = ["event_type", "item", "pv"]
    assert _windows(got, *columns) == _windows(want, *columns) and want.count() > 100
    best = lambda df: windows.top_n(df, ["window_start", "event_type"], [F.desc("pv"), F.asc("item")], 2)
    assert _windows(best(got), *columns, "rn") == _windows(best(want), *columns, "rn")


def test_play_segments_of_a_stream_equal_the_batch(spark, event_stream, tmp_path):  # noqa: F811
    rows, _ = event_stream
    stream = in_batches(spark, rows, tmp_path, 4).withWatermark("ts", "0 seconds").withColumn("resumes", F.col("event_type") == "purchase")
    got = collected(spark, streaming.play_segments(stream, 100 * 86400), "segments", tmp_path).where("user_id >= 0")
    want = sequence.segments(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase").groupBy("user_id", "segment").agg(F.min("ts").alias("seg_start"), F.max("ts").alias("seg_end"), F.count("*").alias("n"))
    columns = ["user_id", "segment", "seg_start", "seg_end", "n"]
    assert values(got.select(columns).toPandas()) == values(want.select(columns).toPandas()) and want.count() > 100


def test_a_pause_ends_a_segment(spark, tmp_path):
    at = [(1, 0, True), (1, 60, False), (1, 4000, False), (1, 4060, True)]
    rows = spark.createDataFrame([(u, i, s, r) for i, (u, s, r) in enumerate(at)], "user_id long, event_id long, s int, resumes boolean")
    rows = rows.select("user_id", "event_id", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"), "resumes")
    for n in (1, 4):
        stream = in_batches(spark, rows, tmp_path / str(n), n).withWatermark("ts", "0 seconds")
        got = collected(spark, streaming.play_segments(stream, 600), f"pause{n}", tmp_path).where("user_id = 1")
        assert sorted((r.segment, int(r.seg_start.timestamp()) % 10**6, int(r.seg_end.timestamp()) % 10**6, r.n) for r in got.collect()) == [(1, 0, 60, 2), (1, 4000, 4000, 1), (2, 4060, 4060, 1)]


def test_each_fetch_has_its_own_deadline(spark):
    """Two slow fetches at once are both late; one that hangs holds up no other, and each begins when there is room."""
    waits = {"slow": 1.0, "slower": 0.9, "hangs": 30.0}
    slow = lambda w: time.sleep(waits.get(w, 0.02)) or w + "!"
    names = ["slow", "slower", "hangs", *[f"w{i}" for i in range(30)]]
    rows = spark.createDataFrame([(w,) for w in names], "w string").coalesce(1)
    began = time.monotonic()
    got = {r.w: r.s for r in streaming.enriched(rows, "w", slow, "s", threads=3, timeout_seconds=0.5).collect()}
    assert got == {w: None if w in waits else w + "!" for w in names} and time.monotonic() - began < 15


def test_answers_are_kept_while_they_are_used(spark, rocksdb, tmp_path):
    """Batches of words; an answer that is used within its time is asked for once, one that is not is asked for again."""
    log, path = tmp_path / "asked", str(tmp_path / "in")

    def fetch(w):
        with open(log, "a") as f:
            f.write(w + "\n")
        if w == "bad":
            raise ValueError(w)
        return w + "!"

    def more(*words):
        spark.createDataFrame([(w, Decimal("1.50")) for w in words], "w string, v decimal(10,2)").coalesce(1).write.mode("append").parquet(path)

    def until(n):
        for _ in range(240):
            time.sleep(0.25)
            if len(got) >= n:
                return
        raise AssertionError(got)

    more("a", "b", "a", None, "bad")
    got = []
    stream = spark.readStream.schema("w string, v decimal(10,2)").parquet(path)
    answers = stateful.cached_answers(stream, "w", fetch, "s", ttl_ms=25_000, timeout_seconds=5)
    q = sinks.start(answers, lambda b, n: got.extend(map(tuple, b.collect())), str(tmp_path / "check"), every="200 milliseconds", mode="update")
    try:
        until(5)
        began, n = time.monotonic(), 0
        while time.monotonic() - began < 27:  # a goes on being used, b does not
            time.sleep(1)
            more("a", "bad")
            n += 1
            until(5 + 2 * n)
        more("a", "b")
        until(7 + 2 * n)
    finally:
        q.stop()
    v = Decimal("1.50")
    assert Counter(got) == Counter({("a", v, "a!"): 3 + n, ("b", v, "b!"): 2, (None, v, None): 1, ("bad", v, None): 1 + n})
    assert Counter(log.read_text().split()) == Counter({"a": 1, "b": 2, "bad": 1 + n})


def test_bitmaps_of_ids(spark):
    """Sparse and dense containers, negative and very large ids, repeated ids and nulls; also as a column of a row."""
    import random

    rng = random.Random(1)
    ids = [("s", x) for x in rng.sample(range(-200_000, 10**12), 300)] + [("s", x) for x in range(70_000, 120_000, 3)] * 2
    ids += [("t", x) for x in range(60_000, 140_000, 7)] + [("t", 5), ("t", 2**62), ("t", None), ("t", -1), ("t", -(2**63))]
    sets = bitmaps.containers(spark.createDataFrame(ids, "rule_id string, user_id long"), "user_id", ["rule_id"]).persist()
    members = {r: {u for k, u in ids if k == r and u is not None} for r in "st"}
    kinds = {(r.places is None, r.bits is None) for r in sets.collect()}
    assert kinds == {(True, False), (False, True)} and {r.rule_id: r.n for r in bitmaps.size(sets, ["rule_id"]).collect()} == {k: len(v) for k, v in members.items()}
    asked = [(r, u, f) for r in "stz" for u in [5, 6, -1, 2**62, -(2**63), None, *range(69_990, 75_000), *[u for _, u in ids[:300]]] for f in (True, False)]
    rows = spark.createDataFrame(asked, "rule_id string, user_id long, f boolean")
    inside = lambda r, u: u in members.get(r, ())
    column = bitmaps.from_column(bitmaps.as_column(sets, ["rule_id"]), ["rule_id"])
    got = bitmaps.members_only(rows, "user_id", column, ["rule_id"])
    assert Counter(map(tuple, got.collect())) == Counter(x for x in asked if inside(*x[:2]))
    got = bitmaps.members_only(rows, "user_id", sets, ["rule_id"], "f")
    assert Counter(map(tuple, got.collect())) == Counter(x for x in asked if not x[2] or inside(*x[:2]))
    one, two = (sets.where(F.col("rule_id") == r).drop("rule_id") for r in "st")
    shared = members["s"] & members["t"]
    both = bitmaps.both(one, two).persist()
    everyone = spark.createDataFrame([(u,) for u in members["s"] | members["t"]], "user_id long")
    assert {r.user_id for r in bitmaps.members_only(everyone, "user_id", both).collect()} == shared and bitmaps.size(both).first().n == len(shared)


class _Recorded:
    """Stands for a reader or writer: it notes what it is told, and gives rows of the connector's schema."""

    def __init__(self, rows):
        self.rows, self.told = rows, {}

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, name, value):
        self.told[name] = value
        return self

    def options(self, **more):
        self.told |= more
        return self

    def load(self):
        return self.rows


def test_kafka_adapters_by_a_stand_in(spark, tmp_path, monkeypatch):
    """Options and schemas, over files in place of the connector, which is not at hand."""
    from types import SimpleNamespace

    messages = spark.createDataFrame([(bytearray(b"k"), bytearray(b'{"a":1,"b":"x"}'), "t", 0, 5), (None, bytearray(b"no json"), "t", 0, 6)], "key binary, value binary, topic string, partition int, offset long")
    for given, starting in ((None, "latest"), ("earliest", "earliest")):
        reader = _Recorded(messages)
        session = SimpleNamespace(readStream=reader, read=reader)
        how = {} if given is None else {"starting": given}
        rows = sources.kafka_text(session, "h:9092", "t", **how)
        assert (reader.told["format"], reader.told["kafka.bootstrap.servers"], reader.told["subscribe"], reader.told["startingOffsets"]) == ("kafka", "h:9092", "t", starting)
        assert [tuple(r) for r in sources.json_rows(rows, "a int, b string").select("a", "b").collect()] == [(1, "x"), (None, None)]


def test_kafka_writer_by_a_stand_in(spark):
    """The rows as JSON texts in a column named value, to the topic that is asked for, saved once a batch."""
    saved = []

    class Writer(_Recorded):
        def save(self):
            saved.append((self.told, [r.value for r in self.rows.collect()]))

    class Batch:
        def __init__(self, rows):
            self.rows, self.write = rows, Writer(rows)

        def select(self, *columns):
            return Batch(self.rows.select(*columns))

    sinks.kafka("h:9092", "out")(Batch(spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")), 0)
    assert saved == [({"format": "kafka", "kafka.bootstrap.servers": "h:9092", "topic": "out"}, ['{"a":1,"b":"x"}', '{"a":2}'])]


def test_recent_rows_of_each_user(spark, tmp_path):
    """A user's rows age by the user's own newest row; after a long idleness they go."""
    path = str(tmp_path / "recent")
    write = sinks.keep_recent(path, "ts", 60, by=["u"], idle_seconds=1000)
    steps = [([(1, 0), (1, 50), (2, 10), (None, 5)], {(1, 0), (1, 50), (2, 10), (None, 5)}), ([(1, 500)], {(1, 500), (2, 10), (None, 5)}), ([], {(1, 500), (2, 10), (None, 5)}), ([(2, 40), (1, 1020)], {(1, 1020), (2, 10), (2, 40)})]
    for number, (rows, want) in enumerate(steps):
        for _ in range(2 if number == 1 else 1):
            write(spark.createDataFrame(rows, "u int, s int").withColumn("ts", F.timestamp_seconds("s")), number)
            assert {(r.u, r.s) for r in sinks.read_upserted(spark, path).collect()} == want

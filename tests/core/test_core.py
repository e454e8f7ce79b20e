"""Functions, operators, queries against their SQL, and parity of streams with batches."""

import glob
import os
import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import sinks, sources, streaming
from tidemark.operators import changelog, lookup, rules, sequence, windows
from tidemark.plans import ORACLE_SQL, QUERIES
from tidemark.streaming import engine


def values(df):
    rows = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r) for r in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    r = one(
        spark,
        fn.time_bucket(F.lit(1670596213000), 60),
        fn.text_time_bucket(F.lit("2022-12-09 14:30:13.000"), 10),
        fn.geohash(F.lit(57.64911), F.lit(10.40744)),
        fn.geohash(F.lit(90.0), F.lit(180.0)),
        fn.geohash(F.lit(None).cast("double"), F.lit(0.0)),
        fn.geohash(F.lit(91.0), F.lit(0.0)),
        fn.url_prefix(F.lit("http://a/b/c?x")),
        fn.url_prefix(F.lit("none")),
        fn.reversed_key(F.lit(7)),
        fn.parse_time_or(F.lit("  ")).cast("string"),
    )
    assert tuple(r) == ("2022-12-09 14:00:00.000", "2022-12-09 14:30:00.000", "u4pru", "zzzzz", None, None, "http://a/b/", None, "3999999999", "9999-12-31 23:59:59")


def test_compare(spark):
    c = lambda v, op, x, **k: fn.compare(F.lit(v), op, x, **k)
    checks = [c("30", "=", [30]), c("30", ">", [29]), c(30, ">=", [30]), c(30, "<", [30]), c(30, "<=", [30]), c(30, "between", [30, 40]), c("x", ">", [1]), c(None, "=", ["a"]), c("a", "in", ["a", "b"]), c("a", "like", ["a"])]
    assert list(one(spark, *checks)) == [True, True, True, False, True, True, False, False, True, False]
    with pytest.raises(ValueError):
        c("a", "in", ["a"], strict=True)
    with pytest.raises(ValueError):
        c("a", "between", [1])


def test_video_segments_split_on_resume(spark):
    at = [("play", 1), ("hb", 2), ("hb", 3), ("hb", 4), ("pause", 5), ("resume", 20), ("hb", 25), ("hb", 30), ("stop", 32)]
    df = spark.createDataFrame([(1, k, t) for k, t in at], "u int, kind string, t int")
    out = sequence.segments(df, ["u"], ["t"], F.col("kind") == "resume").groupBy("segment").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    assert sorted(map(tuple, out.collect())) == [(0, 1, 5), (1, 20, 32)]


def test_changelog_sum_counts_additions_only(spark):
    df = spark.createDataFrame([("-U", 5000), ("+U", 8000), ("+I", 1000)], "kind string, amount int")
    assert changelog.additions(df).agg(F.sum("amount")).first()[0] == 9000


def test_lookup_retry(spark):
    rows, none = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([], "k int, attempt int")
    dim = spark.createDataFrame([(1, "a")], "k int, v string")
    done, again = lookup.with_retry(rows, dim, none, "k")
    assert [tuple(r) for r in done.collect()] == [(1, "a")] and [tuple(r) for r in again.collect()] == [(2, 1)]
    done, again = lookup.with_retry(rows.limit(0), dim, spark.createDataFrame([(2, 3)], "k int, attempt int"), "k")
    assert [tuple(r) for r in done.collect()] == [(2, None)] and not again.count()


def test_replay_and_repeated_steps(spark):
    ev = spark.createDataFrame([(1, 10), (1, 100)], "user_id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    since = spark.createDataFrame([("r", 110)], "rule_id string, s int").select("rule_id", F.timestamp_seconds("s").alias("since"))
    assert [r.s for r in rules.replay(ev, since, 1).collect()] == [100]
    seq = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabaab")], "u int, t int, k string")
    assert sequence.sequence_progress(seq, ["u"], ["t"], F.col("k"), ["a", "a", "b"]).first().completed == 2


@pytest.fixture(scope="module")
def event_stream(spark, sf, tmp_path_factory):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props")
    path = str(tmp_path_factory.mktemp("events") / "rows")
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    # A last event far later closes every window that parity compares.
    far = rows.agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), F.lit("{}").alias("props"))
    far.write.mode("append").parquet(path)
    return rows, sources.parquet_files(spark, path, stream=True).withWatermark("ts", "60 days")


def collected(spark, stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name)


def test_stream_pv_uv_equals_batch(spark, event_stream, tmp_path):
    rows, stream = event_stream
    got = collected(spark, streaming.pv_uv(stream, "ts", "5 minutes", "user_id"), "pvuv", tmp_path)
    want = windows.tumble(rows, "ts", "5 minutes", [], [F.count("*").alias("pv"), F.countDistinct("user_id").alias("uv")])
    assert sorted(map(tuple, got.select("window_start", "pv", "uv").collect())) == sorted(map(tuple, want.select("window_start", "pv", "uv").collect()))


def test_stream_top_pages(spark, event_stream, tmp_path):
    rows, stream = event_stream
    got = collected(spark, streaming.top_pages(stream, "ts", "1 day", "event_type", "user_id", 3), "top", tmp_path)
    counted = windows.tumble(rows, "ts", "1 day", ["event_type", "user_id"], [F.count("*").alias("pv")])
    want = windows.top_n(counted, ["window_start", "event_type"], [F.desc("pv"), F.asc("user_id")], 3)
    columns = ["window_start", "event_type", "user_id", "pv", "rn"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_stream_sequence_equals_batch(spark, event_stream, tmp_path):
    rows, _ = event_stream
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = sources.parquet_files(spark, path, stream=True)
    got = collected(spark, streaming.sequence_matches(stream, ["view", "click", "purchase"], 1, "purchase"), "seq", tmp_path)
    rule = rules.Rule("r", rules.Condition("purchase"), sequence=["view", "click", "purchase"])
    want = rules.evaluate(rows.withColumn("properties", fn.property_map(F.col("props"))), rule).select("user_id", "match_time")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_show_then_click_equals_batch(spark, event_stream, tmp_path):
    rows, _ = event_stream
    rows = rows.where(F.col("event_type").isin("view", "click"))
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    stream = sources.parquet_files(spark, path, stream=True).withWatermark("ts", "1 day")
    got = collected(spark, streaming.show_then_click(stream, "view", "click", 86400), "cep", tmp_path)
    want = sequence.followed_by(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", "ts", 86400, ["ts"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


KINDS = {"load": "view", "wake": "purchase", "close": "error", "launch": "signup"}


def _is(kind):
    return {k: F.col("event_type") == v for k, v in KINDS.items()}[kind]


def test_stream_page_dwell_equals_batch(spark, event_stream, tmp_path):
    rows, _ = event_stream
    page = F.get_json_object("props", "$.k")
    kind = F.when(_is("load"), "load").when(_is("wake"), "wake").when(_is("close"), "close").when(_is("launch"), "launch").otherwise("other")
    stream = in_batches(spark, rows, tmp_path, 3).withWatermark("ts", "0 seconds")
    stream = stream.select("user_id", "ts", "event_id", page.alias("page"), kind.alias("kind"))
    got = collected(spark, streaming.page_dwell(stream, 6 * 3600), "dwell", tmp_path).where("user_id >= 0")
    want = sequence.dwell(rows, ["user_id"], ["ts", "event_id"], "ts", page, _is("load"), _is("wake"), _is("close"), _is("launch"), 6 * 3600)
    columns = ["user_id", "page", "page_start", "page_end", "n_events"]
    assert values(got.select(columns).toPandas()) == values(want.select(columns).toPandas()) and want.count()


def in_batches(spark, rows, tmp_path, n):
    """A stream of rows in n micro-batches by time, and of one far later row that ends what waits."""
    path = str(tmp_path / "batches")
    far = rows.select(*[(F.max("ts") + F.expr("interval 400 days")).alias(c) if c == "ts" else F.lit(-1).cast("long").alias(c) if c in ("event_id", "user_id") else F.max(c).alias(c) for c in rows.columns])
    numbered = rows.withColumn("n", F.ntile(n).over(Window.orderBy("ts"))).persist()
    for i in range(1, n + 1):  # files are read in the order in which they were written
        numbered.where(F.col("n") == i).drop("n").coalesce(1).write.mode("append").parquet(path)
    far.coalesce(1).write.mode("append").parquet(path)
    return sources.parquet_files(spark, path, stream=True, files_a_batch=1)


#: Published golden rows of page stays. Arrival, time, event, page; the first two came out of order.
GOLDEN = [
    (1, 1675407922100, "page_load", "index"),
    (2, 1675407922000, "scroll", "index"),
    (3, 1675407923000, "click", "index"),
    (4, 1675407924000, "page_load", "page08"),
    (5, 1675407925000, "click", "page08"),
    (6, 1675407926000, "click", "page08"),
    (7, 1675407927000, "put_back", "page08"),
    (8, 1675407935000, "wake_up", None),
    (9, 1675407937000, "click", "page08"),
    (10, 1675407938000, "click", "page08"),
    (11, 1675407940000, "app_close", "page08"),
]
#: Page, start, end and number of events of the stays on them.
GOLDEN_STAYS = [
    ("index", 1675407922100, 1675407924000, 3),
    ("page08", 1675407924000, 1675407927000, 4),
    ("page08", 1675407935000, 1675407940000, 4),
]


def _stays(spark, rows):
    df = spark.createDataFrame([(3, n, t, k, p) for n, t, k, p in rows], "u int, n int, t long, kind string, page string").withColumn("ts", F.timestamp_millis("t"))
    kind = F.col("kind")
    out = sequence.dwell(df, ["u"], ["n"], "ts", F.col("page"), kind == "page_load", kind == "wake_up", kind == "app_close", kind == "app_launch", 10)
    return [tuple(r) for r in out.orderBy("visit").select("page", F.unix_millis("page_start"), F.unix_millis("page_end"), "n_events").collect()]


def test_dwell_golden_rows(spark):
    assert _stays(spark, GOLDEN) == GOLDEN_STAYS
    # A launch is on no page, but keeps a session from ending; a page may have no address; after a closing all is new.
    rows = [(1, 0, "app_launch", None), (2, 3000, "click", "a"), (3, 9000, "app_launch", None), (4, 18000, "click", "b"), (5, 20000, "page_load", None), (6, 21000, "app_close", "x"), (7, 22000, "click", "c"), (8, 40000, "wake_up", "d")]
    assert _stays(spark, rows) == [("a", 3000, 20000, 2), (None, 20000, 21000, 2), ("c", 22000, 22000, 1), ("d", 40000, 40000, 1)]


def test_cumulate_has_every_later_step(spark):
    rows = [("a", 60, 1), ("a", 22 * 60, 2), ("b", 180, 1), (None, 86400 + 86000, 1)]
    df = spark.createDataFrame(rows, "k string, s int, u int").withColumn("ts", F.timestamp_seconds("s"))
    out = windows.cumulate(df, "ts", 5, ["k"], {"n": F.lit(1)}, {"users": F.col("u")})
    got = {(r.k, r.e // 300): (r.n, r.users) for r in out.select("k", F.unix_seconds("window_end").alias("e"), "n", "users").collect()}
    want = {("a", i): (1, 1) if i < 5 else (2, 2) for i in range(1, 289)} | {("b", i): (1, 1) for i in range(1, 289)} | {(None, i): (1, 1) for i in range(288 + 287, 577)}
    assert got == want


def test_hop_of_sums_equals_hop(spark, event_stream):
    rows, _ = event_stream
    one = windows.hop(rows, "ts", "1 hour", "10 minutes", ["event_type"], [F.count("*").alias("n"), F.sum("user_id").alias("s")])
    two = windows.hop_sums(rows, "ts", 60, 10, ["event_type"], {"n": F.lit(1), "s": F.col("user_id")})
    assert values(one.toPandas()) == values(two.toPandas())


def test_rule_json(spark):
    given = '{"rule_id": "r", "static_profile": [{"tag_name": "age", "compare_op": ">", "compare_value": 30}], "dynamic_profile": [{"flag_id": 2, "event_id": "w", "event_cnt": 3, "end_time": " "}], "fire_event": {"event_id": "x", "properties": [{"property_name": "p1", "compare_op": "=", "compare_value": "v1"}]}}'
    want = rules.Rule("r", rules.Condition("x", properties=[("p1", "=", ["v1"])]), [rules.Condition("w", 3, flag="2")], profile=[("age", ">", ["30"])])
    assert rules.parse_rule("counts", given) == want
    assert rules.parse_rule("history", given, history_end="2024-01-01 00:00:00").cutoff == "2024-01-01 00:00:00"
    assert rules.parse_rule("event", '{"rule_id": "r2", "event_id": "p"}') == rules.Rule("r2", rules.Condition("p", properties=[]), [], profile=[])
    seq = rules.parse_rule("sequence", '{"rule_id": "s", "offline_profile": [{"tag_name": "job", "compare_type": "in", "tag_value": ["a", "b"]}], "online_profile": {"event_seq": ["k", "b", "c"], "seq_count": 3}, "fire_event": {"event_id": "share", "pro_name": "m", "pro_value": "qq"}}', has_audience=True)
    assert (seq.sequence, seq.times, seq.profile, seq.fire.properties, seq.has_audience) == (("k", "b", "c"), 3, [("job", "in", ["a", "b"])], [("m", "=", ["qq"])], True)
    for model, text in (("groovy", given), ("counts", given.replace('">"', '"like"'))):
        with pytest.raises(ValueError):
            rules.parse_rule(model, text)
    found = spark.createDataFrame([("r", 1, 5)], "rule_id string, user_id long, s int").withColumn("match_time", F.timestamp_seconds("s"))
    assert rules.match_message(found, "event_time").first().value == '{"rule_id":"r","user_id":1,"event_time":5000}'


def test_compare_as_data_equals_compare(spark):
    cases = [("30", "=", ["30"]), ("30", ">", ["29"]), ("30", ">=", ["30"]), ("30", "<", ["30"]), ("30", "<=", ["30"]), ("30", "between", ["30", "40"]), ("x", ">", ["1"]), ("", "=", ["a"]), ("a", "in", ["a", "b"]), ("a", "like", ["a"])]
    df = spark.createDataFrame(cases, "tag string, op string, v array<string>").select(fn.compare_data(F.col("tag"), F.col("op"), F.col("v")).alias("x"))
    assert [r.x for r in df.collect()] == list(one(spark, *[fn.compare(F.lit(t), o, v) for t, o, v in cases]))


def test_rule_of_several_counts_until_a_time(spark):
    at = [(1, "w", 10), (1, "w", 20), (1, "v", 30), (1, "x", 40), (2, "w", 10), (2, "v", 30), (2, "w", 50), (2, "x", 60)]
    ev = spark.createDataFrame([(u, i, k, t) for i, (u, k, t) in enumerate(at)], "user_id long, event_id long, event_type string, s int").select("user_id", "event_id", "event_type", F.timestamp_seconds("s").alias("ts"), F.create_map(F.lit("k"), F.lit("1")).alias("properties"))
    fired = lambda until: sorted(r.user_id for r in rules.evaluate(ev, rules.Rule("r", rules.Condition("x"), [rules.Condition("w", 2, flag="1", until=until), rules.Condition("v", 1, flag="2")])).collect())
    assert fired(None) == [1, 2] and fired("1970-01-01 00:00:49") == [1]


def test_rule_engine_equals_batch(spark, sf, tmp_path):
    """Three batches by two engines (the second starts anew), one of them run twice; a rule that comes later replays, one that goes is silent."""
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), fn.property_map(F.col("props")).alias("properties"))
    rows = rows.withColumn("n", F.ntile(3).over(Window.orderBy("ts", "event_id"))).persist()
    batches = [rows.where(F.col("n") == i).drop("n") for i in (1, 2, 3)]
    count = rules.Rule("count", rules.Condition("purchase"), [rules.Condition("view", 2, [("k", "<", [70])]), rules.Condition("click", 1, flag="2")])
    order = rules.Rule("order", rules.Condition("purchase"), sequence=("view", "click"), times=1)
    late = rules.Rule("late", rules.Condition("click"), [rules.Condition("view", 2)])
    inside = [[count, order], [count, order, late], [count, late]]
    active, path, out, replay = [], str(tmp_path / "state"), str(tmp_path / "out"), 2 * 86400
    for number, batch in enumerate(batches):
        if number != 1:
            write = engine.rule_engine(path, lambda: active, sinks.append_parquet(out), replay)
        active[:] = inside[number]
        for _ in range(2 if number == 1 else 1):
            write(batch, number)
    got = values(spark.read.parquet(out).select("rule_id", "user_id", "match_time").toPandas())
    newest = batches[0].agg(F.max("ts")).first()[0]
    recent = batches[0].where(F.col("ts") > F.lit(newest) - F.expr(f"interval {replay} seconds"))
    parts = [rules.evaluate(rows.drop("n"), count), rules.evaluate(batches[0].unionByName(batches[1]), order), rules.evaluate(recent.unionByName(batches[1]).unionByName(batches[2]), late)]
    want = sorted(x for p in parts for x in values(p.select("rule_id", "user_id", "match_time").toPandas()))
    assert got == want and {x[1] for x in got} == {"count", "order", "late"}


def test_report_over_two_streams(spark, tmp_path):
    """Items wait for their orders; a paid order counts in its own minute only, and an item's newest row only."""
    from datetime import datetime

    item, order = "id int, order_id int, product_id int, brand string, price decimal(10,2), quantity int, seq int", "id int, status int, payment_time string, seq int"
    now, out = [datetime(2024, 1, 1, 10, 1)], str(tmp_path / "out")
    report = lambda items, orders, at: engine.paid_topn(items, orders, f"{at:%Y-%m-%d %H:%M:00}", f"{at:%Y-%m-%d %H:%M:59.999999}", (1, 2, 3), 2)
    write = engine.report_each_batch(str(tmp_path / "t"), {0: (item, ["id"], ["seq"]), 1: (order, ["id"], ["seq"])}, report, sinks.append_parquet(out), lambda: now[0])
    items = lambda *r: spark.createDataFrame(list(r), "id int, order_id int, product_id int, brand string, price string, quantity int, seq int")
    orders = lambda *r: spark.createDataFrame(list(r), order)
    got = lambda n: sorted((r.brand, r.product_id, str(r.amount), r.rn) for r in spark.read.parquet(f"{out}/batch={n}").collect())
    write(sources.one_stream(items((1, 1, 7, "a", "2.50", 2, 1), (2, 2, 8, "a", "1.00", 1, 1), (3, 1, 9, "a", "1.00", 3, 1))), 0)
    assert got(0) == []
    write(sources.one_stream(items((2, 2, 8, "a", "1.00", 9, 2)), orders((1, 1, "2024-01-01 10:01:05", 1), (2, 0, None, 1))), 1)
    assert got(1) == [("a", 7, "5.00", 1), ("a", 9, "3.00", 2)]
    now[0] = datetime(2024, 1, 1, 10, 2)
    write(sources.one_stream(items(), orders((2, 3, "2024-01-01 10:02:00", 2))), 2)
    assert got(2) == [("a", 8, "9.00", 1)]


def test_stream_of_several_batches_keeps_its_state(spark, event_stream, tmp_path):
    rows, _ = event_stream
    stream = in_batches(spark, rows, tmp_path, 4)
    got = collected(spark, streaming.sequence_matches(stream, ["view", "click", "purchase"], 1, "purchase"), "seq4", tmp_path).where("user_id >= 0")
    rule = rules.Rule("r", rules.Condition("purchase"), sequence=["view", "click", "purchase"])
    want = rules.evaluate(rows.withColumn("properties", fn.property_map(F.col("props"))), rule).select("user_id", "match_time")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_sequence_forgets(spark, tmp_path):
    """The second user's first step is two days old by the time of the second, and forgotten."""
    at = [(1, "a", 0), (2, "a", 0), (1, "b", 3600), (3, "c", 86400), (4, "c", 2 * 86400), (2, "b", 3 * 86400)]
    rows = spark.createDataFrame([(u, i, k, t) for i, (u, k, t) in enumerate(at)], "user_id long, event_id long, event_type string, s int").select("user_id", F.timestamp_seconds(F.col("s") + 1_000_000_000).alias("ts"), "event_id", "event_type")
    for forget, users in ((None, [1, 2]), (86400, [1])):
        stream = in_batches(spark, rows, tmp_path / str(forget), 6).withWatermark("ts", "0 seconds")
        got = collected(spark, streaming.sequence_matches(stream, ["a", "b"], 1, "b", forget), f"forget{forget}", tmp_path)
        assert sorted(r.user_id for r in got.collect()) == users


def test_dimensions_are_broadcast_within_bytes(spark, sf):
    small = spark.read.parquet(f"{sf}/nation.parquet")
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(lookup.sized(small)) and hinted(lookup.sized(small, most_bytes=5000))
    assert not hinted(lookup.sized(small, most_rows=3, most_bytes=300)) and not hinted(lookup.sized(small, most_rows=100, most_bytes=300))


def test_stream_show_then_click_over_batches(spark, event_stream, tmp_path):
    rows, _ = event_stream
    rows = rows.where(F.col("event_type").isin("view", "click"))
    stream = in_batches(spark, rows, tmp_path, 4).withWatermark("ts", "0 seconds")
    got = collected(spark, streaming.show_then_click(stream, "view", "click", 86400), "cep4", tmp_path)
    want = sequence.followed_by(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click", "ts", 86400, ["ts"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_stream_join_and_running_sums(spark, sf, tmp_path):
    orders = spark.read.parquet(f"{sf}/orders.parquet").limit(50).select(F.col("o_orderkey").alias("oid"), F.col("o_orderdate").cast("timestamp").alias("ot"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    items = orders.where("oid % 2 = 0").select(F.col("oid").alias("iid"), (F.col("ot") + F.when(F.col("oid") % 4 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 20 days"))).alias("it"))
    streams = []
    for name, df in (("orders", orders), ("items", items)):
        path, time = str(tmp_path / name), df.columns[1]
        df.write.parquet(path)
        far = df.agg((F.max(time) + F.expr("interval 900 days")).alias(time)).select(*[F.col(c) if c == time else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        far.write.mode("append").parquet(path)
        streams.append(sources.parquet_files(spark, path, stream=True).withWatermark(time, "3000 days"))
    got = collected(spark, streaming.stream_join(*streams, [("oid", "iid")], "ot", "it", "15 days"), "joined", tmp_path).where("oid is not null")
    assert sorted(r.oid for r in got.collect()) == sorted(r.iid for r in items.where("iid % 4 = 0").collect()) and got.count()
    path = str(tmp_path / "orders")
    q = streaming.running_sums(sources.parquet_files(spark, path, stream=True, files_a_batch=1), {"total": "amount"}).writeStream.format("memory").queryName("sums").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert max(r.total for r in spark.table("sums").where("total is not null").collect()) == orders.agg(F.sum("amount")).first()[0]


def test_early_fire_gives_running_results(spark, event_stream, tmp_path):
    rows, _ = event_stream
    stream = in_batches(spark, rows, tmp_path, 3).withWatermark("ts", "0 seconds")
    got = collected(spark, streaming.early_fire(stream, "ts", "3650 days", ["event_type"], [F.count("*").alias("n")]), "early", tmp_path, "update")
    last = got.where("w.start < '2030-01-01'").groupBy("event_type").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    per_type = {r.event_type: r["count"] for r in rows.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in last.collect()}.items() >= {k: v for k, v in per_type.items() if k != rows.agg(F.max("event_type")).first()[0]}.items()
    assert all(r.times >= 3 for r in last.collect())


def test_rocksdb_state(spark, event_stream, tmp_path):
    rows, _ = event_stream
    name = "spark.sql.streaming.stateStore.providerClass"
    try:
        streaming.use_rocksdb(spark)
        assert "RocksDB" in spark.conf.get(name)
        got = collected(spark, streaming.sequence_matches(in_batches(spark, rows, tmp_path, 2), ["view", "click"], 1, "click"), "rocks", tmp_path)
        assert got.count()
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


def test_synthetic_events(spark, tmp_path):
    q = sources.synthetic_events(spark, 50, users=5).writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path)).start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("made").count() > 20:
                break
    finally:
        q.stop()
    r = spark.table("made").agg(F.count("*").alias("n"), F.min("user_id").alias("a"), F.max("user_id").alias("b"), F.collect_set("event_type").alias("k")).first()
    assert r.n > 20 and 0 <= r.a <= r.b < 5 and set(r.k) <= {"view", "click", "purchase"}


def test_json_files_with_event_time(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"eventId": "x", "actionTime": 1670596213000}\n{"eventId": "y"}\n')
    rows = sources.with_event_time(sources.json_files(spark, str(tmp_path / "*.json"), sources.EVENT_SCHEMA), "actionTime")
    got = {r.eventId: r for r in collected(spark, rows, "json", tmp_path / "c").collect()}
    assert str(got["x"].row_time) == "2022-12-09 14:30:13" and got["y"].row_time is None and got["x"].properties is None
    text = sources.one_stream(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("z",)], "b string"))
    assert sorted(map(tuple, text.collect())) == [(0, '{"a":1}'), (1, '{"b":"z"}')]


def test_change_feed_of_a_server_in_another_zone(spark):
    text = spark.createDataFrame([('{"before":null,"after":{"id":1,"t":"2023-06-01 08:00:00"},"op":"c"}',)], "value string")
    r = sources.change_feed(text, "id bigint, t timestamp", server_zone="Asia/Shanghai").select("before", F.col("after.t").cast("string").alias("t")).first()
    assert r.before is None and r.t == "2023-06-01 00:00:00"


def test_redeclared_views_and_descriptions(spark):
    rows = spark.createDataFrame([("+I", 1, "2024-01-01 00:00:00"), ("-U", 1, "2024-01-01 00:00:00"), ("+U", 2, "2024-01-02 00:00:00")], "kind string, v int, t string")
    out = sources.as_view(sources.redeclared(rows, "t"), "redeclared")
    assert spark.sql("select sum(v) from redeclared").first()[0] == 3
    assert sorted(map(tuple, sources.described(out).collect())) == [("t", "timestamp", True), ("v", "int", True)]


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = lambda *r: spark.createDataFrame(list(r), "id int, seq int, name string")
    sinks.jdbc(url, "log", **driver)(rows((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), 0)
    assert sorted(r.ID for r in sources.jdbc_table(spark, url, "log", "ID", (1, 3), 2, **driver).select(F.col("id").alias("ID")).collect()) == [1, 2, 3]
    sinks.jdbc(url, "target", **driver)(rows((1, 1, "a")), 0)
    write = sinks.jdbc_upsert(url, "target", "staging", ["id"], ["seq"], **driver)
    for _ in range(2):  # a batch that is run again changes nothing
        write(rows((1, 2, "b"), (1, 3, "c"), (2, 1, "d")), 1)
        assert sorted(map(tuple, sources.jdbc_table(spark, url, "target", **driver).collect())) == [(1, 3, "c"), (2, 1, "d")]


def test_tables_and_console(spark, tmp_path):
    batch = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "v int, t string").withColumn("t", F.col("t").cast("timestamp"))
    sinks.olap_parquet(str(tmp_path / "olap"), "t")(batch, 0)
    assert [(r.v, str(r.dt)) for r in spark.read.parquet(str(tmp_path / "olap")).where("dt = date'2024-01-02'").collect()] == [(2, "2024-01-02")]
    spark.sql(f"create table by_name (t timestamp, v int) using parquet location '{tmp_path}/by_name'")
    try:
        sinks.insert_into("by_name")(batch, 0)
        assert sorted(r.v for r in spark.table("by_name").collect()) == [1, 2]
        spark.sql(f"create table days (v int, dt string) using parquet partitioned by (dt) location '{tmp_path}/days'")
        sinks.insert_into("days")(batch.select("v", F.date_format("t", "yyyy-MM-dd").alias("dt")), 0)
        assert [r.v for r in sources.table_partition(spark, "days", "2024-01-02").collect()] == [2]
    finally:
        spark.sql("drop table if exists by_name")
        spark.sql("drop table if exists days")
    seen = []
    sinks.printed(seen.append)(batch.select("v"), 0)
    assert sorted(seen) == ['{"v":1}', '{"v":2}']
    out = []
    stream_path = str(tmp_path / "s")
    batch.write.parquet(stream_path)
    q = sinks.start(sources.parquet_files(spark, stream_path, stream=True), lambda b, n: out.extend(r.v for r in b.collect()), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(out) == [1, 2]


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    write = sinks.upsert_parquet(path, ["k"], ["seq"], buckets=8)
    write(spark.createDataFrame([(i, 1) for i in range(100)], "k int, seq int"), 0)
    write(spark.createDataFrame([(7, 2)], "k int, seq int"), 1)
    assert len(glob.glob(f"{path}/rows=1/__bucket=*")) == 1
    got = {r.k: r.seq for r in sinks.read_upserted(spark, path).collect()}
    assert got == {i: 2 if i == 7 else 1 for i in range(100)}


def test_enrichment_with_timeout_and_expiring_cache(spark, tmp_path):
    slow = lambda w: time.sleep(3) or w if w == "slow" else w + "!"
    rows = spark.createDataFrame([("a",), ("slow",)], "w string")
    assert {r.w: r.s for r in streaming.enriched(rows, "w", slow, "s", timeout_seconds=0.5).collect()} == {"a": "a!", "slow": None}
    log = tmp_path / "asked"

    def fetch(w):
        with open(log, "a") as f:
            f.write(w + "\n")
        return w + "?"

    out = str(tmp_path / "out")
    write = streaming.cached_enrichment(str(tmp_path / "cache"), "w", fetch, "s", "ts", 60, sinks.append_parquet(out))
    batch = lambda *r: spark.createDataFrame(list(r), "w string, t int").withColumn("ts", F.timestamp_seconds("t"))
    write(batch(("a", 0), ("b", 0)), 0)
    write(batch(("a", 50)), 1)  # known, and used again
    write(batch(("a", 100), ("b", 100)), 2)  # b has expired
    assert sorted(log.read_text().split()) == ["a", "b", "b"]
    assert sorted((r.w, r.s) for r in spark.read.parquet(out).collect()) == [("a", "a?")] * 3 + [("b", "b?")] * 2


def test_lifecycle_by_operation_only(spark):
    feed = spark.createDataFrame([("a", 1, "c", 0), ("b", 1, "c", 2), ("b", 2, "d", 2), ("c", 1, "u", 2)], "rule_id string, seq int, op string, online_status int")
    assert sorted(r.rule_id for r in rules.active_rules(feed, respect_status=False).collect()) == ["a", "c"]
    assert [r.rule_id for r in rules.active_rules(feed).collect()] == ["c"]


def test_time_predicates(spark):
    at = F.lit("2024-05-01 10:00:00").cast("timestamp")
    checks = [fn.on_day(at, "2024-05-01"), fn.on_day(at, "2024-05-02"), fn.on_day(fn.processing_time()), fn.in_window(at, "2024-05-01 10:00:00", "2024-05-01 11:00:00"), fn.in_window(at, "2024-05-01 09:00:00", "2024-05-01 10:00:00")]
    assert list(one(spark, *checks)) == [True, False, True, True, False]
    assert list(one(spark, fn.null_of(), fn.patched_json(F.lit('{"a":1,"b":"x"}'), "a", F.lit("2")), fn.patched_json(F.lit("bad"), "a", F.lit("2")))) == [None, '{"b":"x","a":"2"}', None]


def test_recent_rows_expire(spark, tmp_path):
    path = str(tmp_path / "recent")
    write = sinks.keep_recent(path, "ts", 60)
    for number, seconds in enumerate(([0, 50], [70, 100], [], [155])):
        write(spark.createDataFrame([(s,) for s in seconds], "s int").withColumn("ts", F.timestamp_seconds("s")), number)
        kept = sorted(r.s for r in sinks.read_upserted(spark, path).collect())
        assert kept == [[0, 50], [50, 70, 100], [50, 70, 100], [100, 155]][number]


def test_stream_lookup_retry(spark, tmp_path):
    path, out, known = str(tmp_path / "pending"), str(tmp_path / "out"), {1: "a"}
    write = sinks.looked_up(path, lambda: spark.createDataFrame(list(known.items()), "k int, v string"), "k", sinks.append_parquet(out), 2)
    done = lambda: sorted((r.k, r.v) for r in spark.read.parquet(out).collect())
    batch = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k int")
    write(batch(1, 2, 3), 0)
    assert done() == [(1, "a")]
    known[2] = "b"
    for _ in range(2):  # a batch that is run again changes nothing
        write(batch(), 1)
        assert done() == [(1, "a"), (2, "b")]
    write(batch(), 2)
    assert done() == [(1, "a"), (2, "b"), (3, None)]


def test_upsert_and_enrichment(spark, tmp_path):
    path = str(tmp_path / "t")
    write = sinks.to_all(sinks.with_retries(sinks.upsert_parquet(path, ["k"], ["seq"])), sinks.append_parquet(str(tmp_path / "log")))
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, seq int, v string"), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        write(spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, seq int, v string"), 1)
    assert sorted((r.k, r.v) for r in sinks.read_upserted(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "d")]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    rows = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "w string")
    cache = spark.createDataFrame([("y", "known")], "w string, s string")
    got = streaming.enriched(rows, "w", lambda w: w + w if w == "x" else 1 / 0, "s", cache=cache)
    assert sorted(((r.w, r.s) for r in got.collect()), key=str) == sorted([("x", "xx"), ("y", "known"), ("x", "xx"), (None, None)], key=str)


def test_json_envelopes(spark):
    text = spark.createDataFrame([('{"before":null,"after":{"id":1,"amount":5.25},"op":"c"}',), ("bad",)], "value string")
    rows = sources.change_feed(text, "id bigint, amount decimal(10,2)")
    assert [str(r.amount) for r in changelog.after_images(rows).collect()] == ["5.25"]
    assert pd.isna(sources.json_rows(text, "op string, nothing int").first().nothing)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

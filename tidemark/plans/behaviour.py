"""Traffic, funnels, segments, dimensions: queries over events, pages and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import first_match, geohash, reversed_key, time_bucket, url_prefix
from tidemark.operators.lookup import lookup, unique_dimension
from tidemark.operators.sequence import dwell, followed_by, segments
from tidemark.operators.windows import cumulate, hop_sums, top_n, tumble
from tidemark.plans.registry import events, query, stamp, table

QUERIES: dict = {}
ORACLES: dict = {}

_T = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(QUERIES, ORACLES, f"""
select {_T.format("w")} as window_start, {_T.format("w + interval 5 minute")} as window_end, pv, uv, buyers from (
select time_bucket(interval 5 minute, ts) as w, sum(case when event_type = 'view' then 1 else 0 end)::bigint as pv,
       count(distinct user_id) as uv, count(distinct case when event_type = 'purchase' then user_id end) as buyers from events group by 1)""")
def pvuv_tumble_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("pv"), F.countDistinct("user_id").alias("uv"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers")]
    out = tumble(events(spark, sf_dir), "ts", "5 minutes", [], aggs)
    return out.select(stamp("window_start", "window_start"), stamp("window_end", "window_end"), "pv", "uv", "buyers")


@query(QUERIES, ORACLES, f"""
with e as (select date_trunc('day', ts)::timestamp as d, time_bucket(interval 5 minute, ts) + interval 5 minute as w, user_id, event_type from events),
s as (select d, d + to_minutes(5 * i::int) as w from (select distinct d from e), range(1, 289) r(i))
select {_T.format("s.d")} as window_start, {_T.format("s.w")} as window_end, sum(case when event_type = 'view' then 1 else 0 end)::bigint as pv, count(distinct user_id) as uv
from s join e on e.d = s.d and e.w <= s.w group by s.d, s.w""")
def pvuv_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    out = cumulate(rows, "ts", 5, [], {"pv": F.when(F.col("event_type") == "view", 1).otherwise(0)}, {"uv": F.col("user_id")})
    return out.select(stamp("window_start", "window_start"), stamp("window_end", "window_end"), "pv", "uv")


@query(QUERIES, ORACLES, f"""
with e as (select date_trunc('day', ts)::timestamp as d, time_bucket(interval 5 minute, ts) + interval 5 minute as w, user_id,
     case when json_extract_string(props, '$.k') ~ '^1' then 'one' when json_extract_string(props, '$.k') ~ '^[23]' then 'two' end as promo, user_id % 10 as province, user_id % 4 = 0 as is_new from events),
f as (select * from e where promo is not null),
s as (select d, d + to_minutes(5 * i::int) as w, promo, province from (select distinct d, promo, province from f), range(1, 289) r(i))
select {_T.format("s.d")} as window_start, {_T.format("s.w")} as window_end, s.promo, s.province, count(*)::bigint as pv, count(distinct user_id) as uv,
       count(distinct case when is_new then user_id end) as uv_new
from s join f on f.d = s.d and f.w <= s.w and f.promo = s.promo and f.province = s.province group by s.d, s.w, s.promo, s.province""")
def promo_cumulate_new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("properties")["k"]
    promo = F.when(k.rlike("^1"), "one").when(k.rlike("^[23]"), "two")
    rows = events(spark, sf_dir).withColumns({"promo": promo, "province": F.col("user_id") % 10}).where(k.rlike("^1") | k.rlike("^[23]"))
    user, new = F.col("user_id"), F.when(F.col("user_id") % 4 == 0, F.col("user_id"))
    out = cumulate(rows, "ts", 5, ["promo", "province"], {"pv": F.lit(1)}, {"uv": user, "uv_new": new})
    return out.select(stamp("window_start", "window_start"), stamp("window_end", "window_end"), "promo", "province", "pv", "uv", "uv_new")


@query(QUERIES, ORACLES, f"""
with g as (select time_bucket(interval 5 minute, ts) as w, event_type as page_type, json_extract_string(props, '$.k') as page_url, count(*) as pv, count(distinct user_id) as uv from events group by all),
r as (select *, row_number() over (partition by w, page_type order by pv desc, page_url) as rn from g)
select {_T.format("w")} as window_start, page_type, page_url, pv, uv, rn::int as rn from r where rn <= 10""")
def top10_pages_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumns({"page_type": F.col("event_type"), "page_url": F.col("properties")["k"]})
    counted = tumble(rows, "ts", "5 minutes", ["page_type", "page_url"], [F.count("*").alias("pv"), F.countDistinct("user_id").alias("uv")])
    out = top_n(counted, ["window_start", "page_type"], [F.desc("pv"), F.asc("page_url")], 10)
    return out.select(stamp("window_start", "window_start"), "page_type", "page_url", "pv", "uv", "rn")


@query(QUERIES, ORACLES, f"""
with i as (select time_bucket(interval 1 minute, ts) - to_minutes(m::int) as w, json_extract_string(props, '$.k')::bigint as item from events, range(60) r(m) where event_type = 'view'),
g as (select w, item, count(*) as pv from i group by all),
j as (select g.w, coalesce(p.p_brand, 'none') as category, g.item, g.pv from g left join part p on p.p_partkey = g.item),
r as (select *, row_number() over (partition by w, category order by pv desc, item) as rn from j)
select {_T.format("w")} as window_start, category, item, pv, rn::int as rn from r where rn <= 10""")
def hot_items_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.col("properties")["k"].try_cast("long")
    rows = events(spark, sf_dir).where("event_type = 'view'").withColumn("item", item).where(F.col("item").isNotNull())
    counted = hop_sums(rows, "ts", 60, 1, ["item"], {"pv": F.lit(1)})
    dim = unique_dimension(table(spark, sf_dir, "part").select(reversed_key(F.col("p_partkey")).alias("key"), "p_brand"), ["key"])
    found = lookup(counted, dim, reversed_key(F.col("item")), "key").withColumn("category", F.coalesce("p_brand", F.lit("none")))
    out = top_n(found, ["window_start", "category"], [F.desc("pv"), F.asc("item")], 10)
    return out.select(stamp("window_start", "window_start"), "category", "item", "pv", "rn")


@query(QUERIES, ORACLES, """
select strftime(time_bucket(interval 5 minute, ts), '%Y-%m-%d %H:%M:%S.%g') as t5, strftime(time_bucket(interval 10 minute, ts), '%Y-%m-%d %H:%M:%S.%g') as t10,
       strftime(time_bucket(interval 30 minute, ts), '%Y-%m-%d %H:%M:%S.%g') as t30, strftime(time_bucket(interval 60 minute, ts), '%Y-%m-%d %H:%M:%S.%g') as t60,
       event_type, case when user_id < 50 then 0 else 1 end as is_newuser, count(*) as pv from events group by all""")
def traffic_time_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    buckets = [time_bucket(F.col("millis"), m).alias(f"t{m}") for m in (5, 10, 30, 60)]
    return rows.groupBy(*buckets, "event_type", F.when(F.col("user_id") < 50, 0).otherwise(1).alias("is_newuser")).agg(F.count("*").alias("pv"))


@query(QUERIES, ORACLES, f"""
with g as (select user_id, time_bucket(interval 1 day, ts) as w, min(ts) as first_ts, max(case when event_type = 'click' then json_extract_string(props, '$.k')::bigint end) as res_cnt,
       coalesce(sum(case when event_type = 'view' then 1 end), 0)::bigint as clicks from events where event_type in ('signup', 'click', 'view') group by all)
select user_id, {_T.format("w")} as window_start, {_T.format("first_ts")} as first_time, res_cnt, clicks from g""")
def search_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type").isin("signup", "click", "view"))
    res = F.when(F.col("event_type") == "click", F.col("properties")["k"].try_cast("long"))
    aggs = [F.min("ts").alias("first"), F.max(res).alias("res_cnt"), F.coalesce(F.sum(F.when(F.col("event_type") == "view", 1)), F.lit(0)).alias("clicks")]
    out = tumble(rows, "ts", "1 day", ["user_id"], aggs)
    return out.select("user_id", stamp("window_start", "window_start"), stamp("first", "first_time"), "res_cnt", "clicks")


@query(QUERIES, ORACLES, """
with g as (select user_id % 7 as region_id, sum(case when event_type = 'view' then 1 else 0 end)::bigint as shows, sum(case when event_type = 'click' then 1 else 0 end)::bigint as clicks
from events where event_type in ('view', 'click') group by 1)
select g.*, n.n_name as region from g left join nation n on n.n_nationkey = g.region_id""")
def recommend_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    one = lambda t: F.sum(F.when(F.col("event_type") == t, 1).otherwise(0))
    out = rows.groupBy((F.col("user_id") % 7).alias("region_id")).agg(one("view").alias("shows"), one("click").alias("clicks"))
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("region"))
    return lookup(out, unique_dimension(dim, ["key"]), F.col("region_id"), "key")


@query(QUERIES, ORACLES, f"""
with f as (select * from events where event_type in ('view', 'click', 'purchase')),
s as (select *, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as seg from f)
select user_id, seg::bigint as segment, {_T.format("min(ts)")} as seg_start, {_T.format("max(ts)")} as seg_end, count(*) as n from s group by user_id, seg""")
def video_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click", "purchase"))
    out = segments(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    out = out.groupBy("user_id", "segment").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return out.select("user_id", "segment", stamp("a", "seg_start"), stamp("b", "seg_end"), "n")


@query(QUERIES, ORACLES, f"""
with recursive f as (select user_id, ts, event_type as k, json_extract_string(props, '$.k') as url, row_number() over (partition by user_id order by ts, event_id) as rn from events),
s(user_id, rn, ts, k, live, page, start, old_page, old_start) as (
  select user_id, rn, ts, k, k not in ('signup', 'error'), case when k <> 'signup' then url end, case when k <> 'signup' then ts end, null::varchar, null::timestamp from f where rn = 1
  union all
  select f.user_id, f.rn, f.ts, f.k,
    case when f.k = 'signup' then on_page else f.k <> 'error' end,
    case when on_page and f.k <> 'view' then s.page when f.k <> 'signup' then f.url end,
    case when on_page and f.k not in ('view', 'purchase') then s.start when f.k <> 'signup' then f.ts end,
    case when on_page and f.k = 'view' then s.page end, case when on_page and f.k = 'view' then s.start end
  from (select *, rn + 1 as next from s) s join f on f.user_id = s.user_id and f.rn = s.next, lateral (select s.live and f.ts - s.ts <= interval 6 hour as on_page)),
spans as (select user_id, page, start, ts as upto, 1 as n from s where k <> 'signup' union all select user_id, old_page, old_start, ts, 0 from s where old_start is not null)
select user_id, page, {_T.format("start")} as page_start, {_T.format("max(upto)")} as page_end, sum(n)::bigint as n_events from spans group by user_id, page, start""")
def page_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    out = dwell(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "ts", F.col("properties")["k"], kind == "view", kind == "purchase", kind == "error", kind == "signup", 6 * 3600)
    return out.select("user_id", "page", stamp("page_start", "page_start"), stamp("page_end", "page_end"), "n_events")


@query(QUERIES, ORACLES, f"""
with f as (select * from events where event_type in ('view', 'click')),
l as (select *, lead(event_type) over o as t2, lead(ts) over o as ts2, lead(event_id) over o as id2 from f window o as (partition by user_id order by ts, event_id))
select user_id, event_id as a_event_id, {_T.format("ts")} as a_time, id2 as b_event_id, {_T.format("ts2")} as b_time from l
where event_type = 'view' and t2 = 'click' and ts2 - ts < interval 6 hour""")
def ad_show_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    etype = F.col("event_type")
    rows = events(spark, sf_dir).where(etype.isin("view", "click"))
    out = followed_by(rows, ["user_id"], ["ts", "event_id"], etype == "view", etype == "click", "ts", 6 * 3600, ["event_id", "ts"])
    return out.select("user_id", "a_event_id", stamp("a_ts", "a_time"), "b_event_id", stamp("b_ts", "b_time"))


@query(QUERIES, ORACLES, """
select e.event_id, e.user_id, e.event_type, c.c_name as username, c.c_mktsegment as job, n.n_name as province, r.r_name as region
from events e left join customer c on c.c_custkey = e.user_id left join nation n on n.n_nationkey = c.c_nationkey left join region r on r.r_regionkey = n.n_regionkey""")
def dwd_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("job"), F.col("c_nationkey").alias("nation")).alias("u"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("province"), "n_regionkey")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    out = lookup(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), unique_dimension(users, ["key"]), F.col("user_id"), "key")
    out = lookup(out, unique_dimension(nations, ["key"]), F.col("u.nation"), "key")
    out = lookup(out, unique_dimension(regions, ["key"]), F.col("n_regionkey"), "key")
    return out.select("event_id", "user_id", "event_type", F.col("u.name").alias("username"), F.col("u.job").alias("job"), "province", "region")


_BITS = " || ".join(
    "substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + "
    + " + ".join(f"(({'x' if i % 2 == 0 else 'y'} >> {(12 if i % 2 == 0 else 11) - i // 2}) & 1) * {1 << (4 - i % 5)}" for i in range(5 * c, 5 * c + 5))
    + ")::int, 1)"
    for c in range(5)
)


@query(QUERIES, ORACLES, f"""
with a as (select c.c_custkey, n.n_name as province, r.r_name as region, (c.c_custkey % 179)::double - 89.5 as lat, (c.c_custkey % 359)::double - 179.5 as lng
from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey),
b as (select *, floor((lng + 180.0) / 360.0 * 8192)::bigint as x, floor((lat + 90.0) / 180.0 * 4096)::bigint as y from a),
g as (select reverse({_BITS}) as geohash, province, region, row_number() over (partition by reverse({_BITS}) order by province, c_custkey) as rn from b)
select geohash, province, region from g where rn = 1""")
def geo_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lng = (F.col("c_custkey") % 179).cast("double") - 89.5, (F.col("c_custkey") % 359).cast("double") - 179.5
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    areas = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    areas = areas.select(F.reverse(geohash(lat, lng)).alias("geohash"), F.col("n_name").alias("province"), F.col("r_name").alias("region"), "c_custkey")
    return top_n(areas.where(F.length(F.trim("geohash")) == 5), ["geohash"], [F.asc("province"), F.asc("c_custkey")], 1).select("geohash", "province", "region")


@query(QUERIES, ORACLES, """select page_id, nullif(regexp_extract(url, '^(.*/)', 1), '') as url_prefix, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') as host from pages""")
def page_url_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", url_prefix(F.col("url")).alias("url_prefix"), first_match(F.col("url"), "^https?://([^/]+)").alias("host"))

"""Widening by computed keys, trees, changelog joins, running totals, texts, and all rules at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geohash, in_window, on_day, packed_text, patched_json, reversed_key, to_json_text, unpacked_text, url_prefix
from tidemark.operators.changelog import join_changes, latest, running_total, state_deltas
from tidemark.operators.lookup import flattened_tree, lookup, sized, unique_dimension
from tidemark.operators.rules import evaluate_all, parse_rule
from tidemark.operators.windows import top_n
from tidemark.plans import behaviour
from tidemark.plans import rules as rule_plans
from tidemark.plans.registry import events, query, stamp, table

QUERIES: dict = {}
ORACLES: dict = {}


@query(QUERIES, ORACLES, f"""
with geo as ({behaviour.ORACLES["geo_dimension"]}),
a as (select e.event_id, (user_id % 179)::double - 89.5 as lat, (user_id % 359)::double - 179.5 as lng, regexp_extract(p.url, '^(.*/)', 1) as prefix from events e left join pages p on p.page_id = e.event_id % 200),
b as (select *, floor((lng + 180.0) / 360.0 * 8192)::bigint as x, floor((lat + 90.0) / 180.0 * 4096)::bigint as y from a),
pg as (select regexp_extract(url, '^(.*/)', 1) as prefix, 'svc-' || min(page_id) as page_service from pages group by 1)
select b.event_id, geo.province, geo.region, pg.page_service from b left join geo on geo.geohash = reverse({behaviour._BITS}) left join pg on pg.prefix = b.prefix""")
def dwd_geo_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the area of their reversed geohash and the service of their address's prefix."""
    pages = table(spark, sf_dir, "pages")
    urls = pages.select(F.col("page_id").alias("key"), "url")
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 179).cast("double") - 89.5).alias("lat"), ((F.col("user_id") % 359).cast("double") - 179.5).alias("lng"))
    rows = lookup(rows, urls, F.col("event_id") % 200, "key")
    services = pages.groupBy(url_prefix(F.col("url")).alias("key")).agg(F.concat(F.lit("svc-"), F.min("page_id")).alias("page_service"))
    rows = lookup(rows, behaviour.geo_dimension(spark, sf_dir), F.reverse(geohash(F.col("lat"), F.col("lng"))), "geohash")
    return lookup(rows, services, url_prefix(F.col("url")), "key").select("event_id", "province", "region", "page_service")


@query(QUERIES, ORACLES, f"""
with m as ({behaviour.ORACLES["ad_show_click"]})
select m.*, c.c_name as username, c.c_mktsegment as job from m left join customer c on c.c_custkey = m.user_id""")
def ad_click_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shows that were clicked, and only then the lookup: as many of them as there are matches."""
    dim = table(spark, sf_dir, "customer").select(reversed_key(F.col("c_custkey")).alias("key"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("job"))
    return lookup(behaviour.ad_show_click(spark, sf_dir), unique_dimension(dim, ["key"]), reversed_key(F.col("user_id")), "key")


_TREE = """with tree as (
select 'r' || r_regionkey as id, null::varchar as parent, 1 as level, r_name as name from region
union all select 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name from nation
union all select distinct 's' || c_nationkey || c_mktsegment, 'n' || c_nationkey, 3, c_mktsegment from customer
union all select 'c' || c_custkey, 's' || c_nationkey || c_mktsegment, 4, c_name from customer)"""


@query(QUERIES, ORACLES, _TREE + """
select a.name as region, b.name as nation, c.name as segment, d.name as customer, d.id from tree d join tree c on c.id = d.parent and c.level = 3
join tree b on b.id = c.parent and b.level = 2 join tree a on a.id = b.parent and a.level = 1 where d.level = 4""")
def area_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    node = lambda df, id_, parent, level, name: df.select(id_.alias("id"), parent.alias("parent"), F.lit(level).alias("level"), F.col(name).alias("name"))
    text = lambda *parts: F.concat(*[F.lit(p) if len(p) == 1 else F.col(p) for p in parts])
    segment = text("s", "c_nationkey", "c_mktsegment")
    tree = node(region, text("r", "r_regionkey"), F.lit(None).cast("string"), 1, "r_name").unionByName(node(nation, text("n", "n_nationkey"), text("r", "n_regionkey"), 2, "n_name"))
    tree = tree.unionByName(node(customer, segment, text("n", "c_nationkey"), 3, "c_mktsegment").distinct()).unionByName(node(customer, text("c", "c_custkey"), segment, 4, "c_name"))
    return flattened_tree(tree, "id", "parent", "level", ["region", "nation", "segment", "customer"], ["id"])


@query(QUERIES, ORACLES, """
with od as (select * from orders where o_orderdate is not null and (o_orderstatus = 'F' and o_orderpriority like '1%') or (o_orderstatus = 'O' and o_orderpriority like '2%') or (o_orderstatus = 'P' and o_orderpriority like '3%'))
select o_orderkey as oid, o_orderstatus as status, l_linenumber as line, l_partkey as pid from od left join (select * from lineitem where l_quantity > 45 qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey desc) = 1) on l_orderkey = o_orderkey""")
def paid_orders_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join of two changelogs' latest rows, after a filter of nested conditions; orders without items keep nulls."""
    is_ = lambda status, priority: (F.col("o_orderstatus") == status) & F.col("o_orderpriority").startswith(priority)
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderdate").isNotNull() & is_("F", "1")) | is_("O", "2") | is_("P", "3"))
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_partkey")
    items = latest(items.withColumn("seq", F.lit(0)), ["l_orderkey", "l_linenumber"], ["seq", "l_partkey"])
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(F.col("o_orderkey").alias("oid"), F.col("o_orderstatus").alias("status"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("pid"))


@query(QUERIES, ORACLES, """
with d as (select date_trunc('day', max(o_orderdate)) as day from orders),
i as (select p_brand as brand, l_partkey as product_id, round(l_quantity * l_extendedprice, 2)::decimal(18,2) as amount, o_orderdate::date = d.day::date as today
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey, d
where o_orderstatus in ('F', 'O') and o_orderdate >= d.day - interval 30 day and o_orderdate < d.day + interval 1 day),
g as (select brand, product_id, sum(amount) as total, coalesce(sum(amount) filter (where today), 0)::decimal(28,2) as today from i group by all),
r as (select *, row_number() over (partition by brand order by total desc, product_id) as rn from g)
select brand, product_id, total::varchar as total, today::varchar as today, rn::int as rn from r where rn <= 2""")
def brand_topn_paid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items against the orders' state: of those paid in the half-open window of 30 days to the newest, the best two a brand."""
    orders = table(spark, sf_dir, "orders")
    day = orders.agg(F.date_trunc("day", F.max("o_orderdate")).alias("d")).first()["d"]
    day = F.lit(day).cast("timestamp")
    paid = orders.where(F.col("o_orderstatus").isin("F", "O") & in_window(F.col("o_orderdate"), day - F.expr("interval 30 days"), day + F.expr("interval 1 day")))
    paid = paid.select(F.col("o_orderkey").alias("l_orderkey"), on_day(F.col("o_orderdate"), F.to_date(day)).alias("is_today"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).cast("decimal(18,2)").alias("amount"))
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand"))
    rows = lookup(items.join(sized(paid), "l_orderkey"), unique_dimension(brands, ["key"]), F.col("l_partkey"), "key", how="inner")
    today = F.coalesce(F.sum(F.when(F.col("is_today"), F.col("amount"))), F.lit(0)).cast("decimal(28,2)")
    sums = rows.groupBy("brand", F.col("l_partkey").alias("product_id")).agg(F.sum("amount").alias("total"), today.cast("string").alias("today"))
    return top_n(sums, ["brand"], [F.desc("total"), F.asc("product_id")], 2).withColumn("total", F.col("total").cast("string"))


@query(QUERIES, ORACLES, """
with f as (select o_orderkey as id, 0 as seq, o_orderdate as t, o_totalprice::decimal(18,2) as amount, 'O' as status from orders
union all select o_orderkey, 1, o_orderdate + interval 1 hour, (o_totalprice * 2)::decimal(18,2), o_orderstatus from orders),
d as (select *, case status when 'O' then amount - coalesce(lag(amount) over o, 0) when 'F' then -coalesce(lag(amount) over o, 0) else 0 end as delta from f window o as (partition by id order by seq))
select id, seq, delta::decimal(20,2)::varchar as delta, sum(delta) over (order by t, id, seq rows unbounded preceding)::decimal(28,2)::varchar as total from d""")
def running_open_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each change of an order adds to the open amount, from the order's state before, and the running total of all."""
    orders = table(spark, sf_dir, "orders")
    change = lambda seq, hours, amount, status: F.struct(F.lit(seq).alias("seq"), (F.col("o_orderdate").cast("timestamp") + F.expr(f"interval {hours} hours")).alias("t"), amount.cast("decimal(18,2)").alias("amount"), status.alias("status"))
    feed = orders.select(F.col("o_orderkey").alias("id"), F.inline(F.array(change(0, 0, F.col("o_totalprice"), F.lit("O")), change(1, 1, F.col("o_totalprice") * 2, F.col("o_orderstatus")))))
    kind = F.when(F.col("status") == "O", "adds").when(F.col("status") == "F", "cancels")
    rows = state_deltas(feed, ["id"], ["seq"], {"delta": (F.col("amount"), kind)})
    out = running_total(rows, F.date_trunc("minute", "t"), ["t", "id", "seq"], {"total": "delta"})
    return out.select("id", "seq", F.col("delta").cast("decimal(20,2)").cast("string").alias("delta"), F.col("total").cast("decimal(28,2)").cast("string").alias("total"))


_ORDER_FEED = """select o_orderkey as oid, o_orderdate as t, 'O' as status, 'c' as op from orders
union all select o_orderkey, o_orderdate + interval 30 day, o_orderstatus, 'u' from orders
union all select o_orderkey, o_orderdate + interval 60 day, o_orderstatus, 'd' from orders where o_orderstatus = 'P'"""
_ITEM_FEED = """select l_orderkey as oid, l_linenumber as line, l_shipdate as t, max(l_partkey) as pid, case when max(l_returnflag) = 'R' then 'd' else 'u' end as op from lineitem group by 1, 2, 3"""


@query(QUERIES, ORACLES, f"""
with o as (select *, lead(t) over (partition by oid order by t) as u from ({_ORDER_FEED})), i as (select *, lead(t) over (partition by oid, line order by t) as u from ({_ITEM_FEED})),
p as (select *, row_number() over (partition by oid order by t) as n from (select oid, t from o union select oid, t from i)),
s as (select p.oid, p.n, p.t, o.status, o.t as ov from p join o on o.oid = p.oid and o.t <= p.t and (o.u is null or p.t < o.u) and o.op <> 'd'),
x as (select s.*, i.line, i.pid, i.t as iv from s left join i on i.oid = s.oid and i.t <= s.t and (i.u is null or s.t < i.u) and i.op <> 'd'),
c as (select p.t, case when a.oid is not null then a end as cur, b as old from p left join x b on b.oid = p.oid and b.n + 1 = p.n left join x a on a.oid = p.oid and a.n = p.n and coalesce(a.line, -1) = coalesce(b.line, -1) where b.oid is not null
      union all select p.t, a, null from p join x a on a.oid = p.oid and a.n = p.n left join x b on b.oid = p.oid and b.n + 1 = p.n and coalesce(a.line, -1) = coalesce(b.line, -1) where b.oid is null),
k as (select t, cur, old, cur is not null and old is not null as upd from c where cur is null or old is null or cur.ov <> old.ov or cur.iv <> old.iv)
select strftime(t, '%Y-%m-%d %H:%M:%S') as "at", case when upd then '+U' else '+I' end as kind, cur.oid as oid, cur.status as status, cur.line as line, cur.pid as pid from k where cur is not null
union all select strftime(t, '%Y-%m-%d %H:%M:%S'), case when upd then '-U' else '-D' end, old.oid, old.status, old.line, old.pid from k where old is not null""")
def order_item_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of the left join of the orders' and the items' change feeds: updates, deletions, orders without items."""
    version = lambda days, status, op: F.struct((F.col("o_orderdate") + F.expr(f"interval {days} days")).alias("ot"), status.alias("status"), op.alias("o_op"))
    last = F.when(F.col("o_orderstatus") == "P", version(60, F.col("o_orderstatus"), F.lit("d")))
    versions = F.array_compact(F.array(version(0, F.lit("O"), F.lit("c")), version(30, F.col("o_orderstatus"), F.lit("u")), last))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.inline(versions))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_oid"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("it"))
    items = items.agg(F.max("l_partkey").alias("pid"), F.when(F.max("l_returnflag") == "R", "d").otherwise("u").alias("i_op"))
    changes = join_changes(orders, items, [("oid", "item_oid")], ["oid"], ["item_oid", "line"], ("ot", "it"), ("o_op", "i_op"), "left")
    return changes.select(stamp("at", "at"), "kind", "oid", "status", "line", "pid")


@query(QUERIES, ORACLES, """
select event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' as map_json, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' as row_json,
       '{"k":"' || json_extract_string(props, '$.k') || '","source":"app"}' as patched, event_type as part_one, user_id::varchar as part_two from events""")
def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps and rows as JSON texts, a patched JSON object, and texts packed in one and taken apart."""
    parts = unpacked_text(packed_text(F.col("event_type"), F.col("user_id")), "one", "two")
    rows = events(spark, sf_dir)
    return rows.select("event_id", to_json_text(F.col("properties")).alias("map_json"), to_json_text(F.struct("event_id", "event_type")).alias("row_json"), patched_json(F.col("props"), "source", F.lit("app")).alias("patched"), parts["one"].alias("part_one"), parts["two"].alias("part_two"))


#: (model, parameters, audience, end of the history) as a rule table holds them.
RULE_TABLE = [
    ("event", {"rule_id": "r-event", "fire_event": {"event_id": "purchase", "properties": [{"property_name": "k", "compare_op": "=", "compare_value": "7"}]}}, False, None),
    ("counts", {"rule_id": "r-count", "dynamic_profile": [{"flag_id": 1, "event_id": "click", "event_cnt": 3}], "fire_event": {"event_id": "click"}}, False, None),
    ("counts", {"rule_id": "r-profile", "static_profile": [{"tag_name": "balance", "compare_op": "between", "compare_value": [0, 9000]}], "dynamic_profile": [{"flag_id": 1, "event_id": "view", "event_cnt": 2}, {"flag_id": 2, "event_id": "click", "event_cnt": 1, "end_time": "2024-01-20 00:00:00"}], "fire_event": {"event_id": "purchase"}}, True, None),
    ("history", {"rule_id": "r-history", "dynamic_profile": [{"flag_id": 1, "event_id": "click", "event_cnt": 8}], "fire_event": {"event_id": "purchase"}}, False, "2024-01-15 00:00:00"),
    ("sequence", {"rule_id": "r-sequence", "online_profile": {"event_seq": ["view", "click", "purchase"], "seq_count": 2}, "fire_event": {"event_id": "purchase"}}, False, None),
    ("past", {"rule_id": "r-past", "offline_profile": [], "online_history_profile": {"event_id": "click", "min_count": 7, "c_id": 1}, "fire_event_id": "signup"}, False, None),
]


@query(QUERIES, ORACLES, f"""
with e as (select * from ({rule_plans.ORACLES["rule_event"]})), c as (select * from ({rule_plans.ORACLES["rule_count"]})),
h as (select * from ({rule_plans.ORACLES["rule_history_count"]})), q as (select * from ({rule_plans.ORACLES["rule_sequence"]})),
p as (with m as (select * from events where user_id in (select c_custkey from customer where c_custkey % 3 <> 0 and c_acctbal between 0 and 9000)),
  r as (select *, sum(case when event_type = 'view' then 1 else 0 end) over o as n1, sum(case when event_type = 'click' and ts <= timestamp '2024-01-20' then 1 else 0 end) over o as n2 from m window o as (partition by user_id order by ts, event_id rows unbounded preceding))
  select 'r-profile' as rule_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as match_time from r where event_type = 'purchase' and n1 >= 2 and n2 >= 1),
o as (select 'r-past' as rule_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as match_time from events where event_type = 'signup'
  and user_id in (select user_id from events where event_type = 'click' and ts <= timestamp '2024-01-15 00:00:00' group by 1 having count(*) >= 7))
select * from e union all select * from c union all select * from h union all select * from q union all select * from p union all select * from o""")
def rules_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models at once: one pass over the events, one shuffle of those that some rule names."""
    rows, customer, cutoff = events(spark, sf_dir), table(spark, sf_dir, "customer"), "2024-01-15 00:00:00"
    rules = [parse_rule(model, json.dumps(given), audience, end) for model, given, audience, end in RULE_TABLE]
    profile = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
    audience = customer.where("c_custkey % 3 <> 0").select(F.lit("r-profile").alias("rule_id"), F.col("c_custkey").alias("user_id"))
    before = rows.where((F.col("event_type") == "click") & (F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz"))).groupBy("user_id").agg(F.count("*").alias("cnt"))
    seeds = before.select(F.explode(F.array(F.lit("r-history"), F.lit("r-past"))).alias("rule_id"), F.lit("1").alias("flag_id"), "user_id", "cnt")
    found = evaluate_all(rows, rules, profile, audience, seeds)
    return found.select("rule_id", "user_id", stamp("match_time", "match_time"))

"""Orders: wide details, settlements, rankings by brand, change feeds, profiles and audiences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.changelog import additions, after_images, latest, signed_delta
from tidemark.operators.lookup import lookup, unique_dimension
from tidemark.operators.windows import top_n, tumble
from tidemark.plans.registry import query, stamp, table

QUERIES: dict = {}
ORACLES: dict = {}
_MONEY = "decimal(18,2)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("amount", F.col("o_totalprice").cast(_MONEY))


@query(QUERIES, ORACLES, """
select o_orderkey, l_linenumber, o_custkey, o_orderstatus, l_partkey, l_quantity, round(l_quantity * l_extendedprice, 2)::decimal(18,2)::varchar as line_amount
from lineitem join orders on l_orderkey = o_orderkey""")
def order_item_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both sides grow with the data: a shuffled join, whose hot keys Spark splits.
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).cast(_MONEY).cast("string")
    return rows.select("o_orderkey", "l_linenumber", "o_custkey", "o_orderstatus", "l_partkey", "l_quantity", amount.alias("line_amount"))


@query(QUERIES, ORACLES, """
select strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') as day, count(*) as n_orders, sum(o_totalprice::decimal(18,2))::varchar as total,
 count(*) filter (where o_orderstatus = 'O') as n_open, coalesce(sum(o_totalprice::decimal(18,2)) filter (where o_orderstatus = 'O'), 0)::decimal(28,2)::varchar as open_amount,
 count(*) filter (where o_orderstatus = 'F') as n_done, coalesce(sum(o_totalprice::decimal(18,2)) filter (where o_orderstatus = 'F'), 0)::decimal(28,2)::varchar as done_amount,
 count(*) filter (where o_orderstatus = 'P') as n_part, coalesce(sum(o_totalprice::decimal(18,2)) filter (where o_orderstatus = 'P'), 0)::decimal(28,2)::varchar as part_amount,
 count(distinct o_custkey) as n_customers, count(*) filter (where o_orderpriority like '1%') as n_urgent, max(o_totalprice::decimal(18,2))::varchar as largest
from orders group by 1""")
def order_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)

    def measures(status: str, name: str):
        own = F.col("o_orderstatus") == status
        return [F.count(F.when(own, 1)).alias(f"n_{name}"), F.coalesce(F.sum(F.when(own, F.col("amount"))), F.lit(0)).cast("decimal(28,2)").cast("string").alias(f"{name}_amount")]

    aggs = [F.count("*").alias("n_orders"), F.sum("amount").cast("string").alias("total"), *measures("O", "open"), *measures("F", "done"), *measures("P", "part"), F.countDistinct("o_custkey").alias("n_customers"), F.count(F.when(F.col("o_orderpriority").startswith("1"), 1)).alias("n_urgent"), F.max("amount").cast("string").alias("largest")]
    out = tumble(rows, "o_orderdate", "1 day", [], aggs)
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *[c for c in out.columns if not c.startswith("window_")])


def _paid_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).cast(_MONEY).alias("amount"))
    paid = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    rows = items.join(paid, F.col("l_orderkey") == F.col("o_orderkey"))
    brands = unique_dimension(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("brand")), ["key"])
    return lookup(rows, brands, F.col("l_partkey"), "key").where(F.col("brand").isNotNull())


_ITEMS = """with i as (select p_brand as brand, l_partkey as product_id, o_orderdate, round(l_quantity * l_extendedprice, 2)::decimal(18,2) as amount
from lineitem join orders on l_orderkey = o_orderkey join part on p_partkey = l_partkey where o_orderstatus = 'F')"""


@query(QUERIES, ORACLES, _ITEMS + """, g as (select brand, product_id, sum(amount) as total from i group by all),
r as (select *, row_number() over (partition by brand order by total desc, product_id) as rn from g)
select brand, product_id, total::varchar as total, rn::int as rn from r where rn <= 2""")
def brand_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _paid_items(spark, sf_dir).groupBy("brand", F.col("l_partkey").alias("product_id")).agg(F.sum("amount").alias("total"))
    return top_n(sums, ["brand"], [F.desc("total"), F.asc("product_id")], 2).withColumn("total", F.col("total").cast("string"))


@query(QUERIES, ORACLES, _ITEMS + """, g as (select time_bucket(interval 5 minute, o_orderdate) as w, brand, product_id, sum(amount) as total from i group by all),
r as (select *, row_number() over (partition by w, brand order by total desc, product_id) as rn from g)
select strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, brand, product_id, total::varchar as total from r where rn = 1""")
def brand_top1_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = tumble(_paid_items(spark, sf_dir).withColumnRenamed("l_partkey", "product_id"), "o_orderdate", "5 minutes", ["brand", "product_id"], [F.sum("amount").alias("total")])
    out = top_n(sums, ["window_start", "brand"], [F.desc("total"), F.asc("product_id")], 1)
    return out.select(stamp("window_start", "window_start"), "brand", "product_id", F.col("total").cast("string").alias("total"))


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a change feed: each is created open, then takes its status; every seventh is deleted."""
    row = F.struct(F.col("o_orderkey").alias("id"), F.col("amount"), F.lit("O").alias("status"))
    now = F.struct(F.col("o_orderkey").alias("id"), F.col("amount"), F.col("o_orderstatus").alias("status"))
    none = F.lit(None).cast("struct<id:bigint,amount:decimal(18,2),status:string>")
    made = lambda seq, op, before, after: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
    changes = F.array(made(0, "c", none, row), made(1, "u", row, now))
    gone = F.when(F.col("o_orderkey") % 7 == 0, F.array(made(2, "d", now, none))).otherwise(F.array().cast("array<struct<seq:int,op:string,before:struct<id:bigint,amount:decimal(18,2),status:string>,after:struct<id:bigint,amount:decimal(18,2),status:string>>>"))
    return _orders(spark, sf_dir).select(F.inline(F.concat(changes, gone)))


@query(QUERIES, ORACLES, """
select o_orderstatus as metric, (case when sum(case when o_orderkey % 7 <> 0 then 1 else 0 end) is null then 0 else sum(case when o_orderkey % 7 <> 0 then 1 else 0 end) end)::bigint as n,
       coalesce(sum(o_totalprice::decimal(18,2)) filter (where o_orderkey % 7 <> 0), 0)::decimal(28,2)::varchar as amount
from orders group by 1""")
def order_delta_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and amounts by status, as sums of signed deltas of a change feed."""
    feed = order_feed(spark, sf_dir)
    statuses = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("metric")).distinct()
    rows = feed.select("before", "after", F.explode(F.array_compact(F.array_distinct(F.array("before.status", "after.status")))).alias("metric"))
    valid = {s: F.col(f"{s}.status") == F.col("metric") for s in ("before", "after")}
    n = signed_delta(valid, {s: F.lit(1) for s in valid})
    amount = signed_delta(valid, {s: F.col(f"{s}.amount") for s in valid})
    sums = rows.groupBy("metric").agg(F.sum(n).cast("long").alias("n"), F.sum(amount).cast("decimal(28,2)").cast("string").alias("amount"))
    return statuses.join(sums, "metric", "left")


@query(QUERIES, ORACLES, """select o_orderkey as id, o_totalprice::decimal(18,2)::varchar as amount, o_orderstatus as status from orders where o_orderkey % 7 <> 0""")
def changelog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = order_feed(spark, sf_dir).select(F.coalesce("after.id", "before.id").alias("id"), "seq", "op", "after")
    return latest(feed, ["id"], ["seq"], "op").select("id", F.col("after.amount").cast("string").alias("amount"), F.col("after.status").alias("status"))


@query(QUERIES, ORACLES, """select count(*) as n, sum(o_totalprice::decimal(18,2))::varchar as amount from (select o_totalprice from orders union all select o_totalprice from orders)""")
def changelog_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+I and +U rows only: what an append-only sum over a changelog counts; retractions are left out."""
    feed = order_feed(spark, sf_dir)
    kinds = feed.select(F.explode(F.expr("case op when 'c' then array(struct('+I' as kind, after as row)) when 'u' then array(struct('-U' as kind, before as row), struct('+U' as kind, after as row)) else array(struct('-D' as kind, before as row)) end")).alias("c"))
    return additions(kinds.select("c.kind", "c.row")).agg(F.count("*").alias("n"), F.sum("row.amount").cast("string").alias("amount"))


@query(QUERIES, ORACLES, """select status, count(*) as n from (select 'O' as status from orders union all select o_orderstatus from orders) group by 1""")
def changelog_after_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after_images(order_feed(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))


@query(QUERIES, ORACLES, """
with a as (select o_custkey as user_id, count(*) as tag0201, max(o_totalprice::decimal(18,2))::varchar as tag0202 from orders group by 1),
b as (select user_id, count(*) as tag0301 from events group by 1)
select c_custkey as user_id, c_mktsegment as tag0101, c_nationkey as tag0102, a.tag0201, a.tag0202, b.tag0301
from customer left join a on a.user_id = c_custkey left join b on b.user_id = c_custkey""")
def profile_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tag0101"), F.col("c_nationkey").alias("tag0102"))
    two = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("tag0201"), F.max("amount").cast("string").alias("tag0202"))
    three = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("tag0301"))
    return one.join(two, "user_id", "left").join(three, "user_id", "left")


@query(QUERIES, ORACLES, """
select c_custkey as user_id from customer where c_acctbal > 1000 and c_acctbal <= 8000 and list_contains(string_split(lower(c_mktsegment), ' '), 'building')
intersect select o_custkey from orders where o_orderstatus = 'F' group by 1 having count(*) >= 2""")
def audience_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions import all_of, compare, has_word

    profile = table(spark, sf_dir, "customer")
    fit = profile.where(all_of([compare(F.col("c_acctbal"), ">", [1000]), compare(F.col("c_acctbal"), "<=", [8000]), has_word(F.col("c_mktsegment"), "building")])).select(F.col("c_custkey").alias("user_id"))
    often = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n")).where("n >= 2").select("user_id")
    return fit.intersect(often)


@query(QUERIES, ORACLES, """with a as (select distinct o_custkey as user_id from orders where o_orderstatus = 'F'), b as (select c_custkey as user_id from customer where c_acctbal > 0)
select (user_id // 32768)::bigint as bucket, count(*) as n from (select * from a intersect select * from b) group by 1""")
def audience_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of an intersection of audiences kept as bitmaps of 32768 users."""
    def bitmaps(users: DataFrame) -> DataFrame:
        # Spark numbers buckets of ids from 1 and places from the id's own bucket.
        return users.groupBy(F.floor(F.col("user_id") / 32768).alias("bucket")).agg(F.bitmap_construct_agg(F.col("user_id") % 32768).alias("bits"))

    a = bitmaps(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")))
    b = bitmaps(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id")))
    # An audience without the bucket has no bits there: only buckets of both can have members.
    both = a.unionByName(b).groupBy("bucket").agg(F.count("*").alias("sides"), F.expr("bitmap_and_agg(bits)").alias("bits")).where("sides = 2")
    return both.select("bucket", F.bitmap_count("bits").alias("n")).where("n > 0")

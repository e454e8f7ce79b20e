"""Rule queries over events: event triggers, counts, several counts, history, sequences, the rule table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.bitmaps import as_column, containers, from_column
from tidemark.operators.rules import Condition, Rule, active_rules, evaluate, evaluate_all
from tidemark.operators.sequence import sequence_progress
from tidemark.plans.registry import events, query, stamp, table

QUERIES: dict = {}
ORACLES: dict = {}
_T = "strftime(ts, '%Y-%m-%d %H:%M:%S') as match_time"


def _matches(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "user_id", stamp("match_time", "match_time"))


@query(QUERIES, ORACLES, f"select 'r-event' as rule_id, user_id, {_T} from events where event_type = 'purchase' and json_extract_string(props, '$.k') = '7'")
def rule_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(evaluate(events(spark, sf_dir), Rule("r-event", Condition("purchase", properties=[("k", "=", ["7"])]))))


@query(QUERIES, ORACLES, f"""
with r as (select *, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events)
select 'r-count' as rule_id, user_id, {_T} from r where event_type = 'click' and n >= 3""")
def rule_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(evaluate(events(spark, sf_dir), Rule("r-count", Condition("click"), counted=[Condition("click", 3)])))


@query(QUERIES, ORACLES, f"""
with aud as (select c_custkey as user_id from customer where c_custkey % 3 <> 0),
prof as (select c_custkey as user_id from customer where c_acctbal >= 0 and c_acctbal <= 9000),
e as (select * from events where user_id in (select user_id from aud) and user_id in (select user_id from prof)),
r as (select *, sum(case when event_type = 'view' and json_extract_string(props, '$.k')::double between 10 and 60 then 1 else 0 end) over o as n1,
  sum(case when event_type = 'click' then 1 else 0 end) over o as n2 from e window o as (partition by user_id order by ts, event_id rows unbounded preceding))
select 'r-multi' as rule_id, user_id, {_T} from r where event_type = 'purchase' and n1 >= 2 and n2 >= 1""")
def rule_multi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    profile = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
    audience = customer.where("c_custkey % 3 <> 0").select(F.lit("r-multi").alias("rule_id"), F.col("c_custkey").alias("user_id"))
    counted = [Condition("view", 2, [("k", "between", [10, 60])], "1"), Condition("click", 1, flag="2")]
    rule = Rule("r-multi", Condition("purchase"), counted, profile=[("balance", "between", [0, 9000])], has_audience=True)
    return _matches(evaluate(events(spark, sf_dir), rule, profile, audience))


@query(QUERIES, ORACLES, f"""
with s as (select user_id, count(*) as cnt from events where event_type = 'click' and ts <= timestamp '2024-01-15 00:00:00' group by 1),
r as (select *, sum(case when event_type = 'click' and ts > timestamp '2024-01-15 00:00:00' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events)
select 'r-history' as rule_id, r.user_id, {_T} from r left join s on s.user_id = r.user_id
where event_type = 'purchase' and ts > timestamp '2024-01-15 00:00:00' and n + coalesce(s.cnt, 0) >= 8""")
def rule_history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cutoff = events(spark, sf_dir), "2024-01-15 00:00:00"
    before = rows.where((F.col("event_type") == "click") & (F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz")))
    seeds = before.groupBy("user_id").agg(F.count("*").alias("cnt")).select(F.lit("r-history").alias("rule_id"), F.lit("1").alias("flag_id"), "user_id", "cnt")
    return _matches(evaluate(rows, Rule("r-history", Condition("purchase"), [Condition("click", 8)], cutoff=cutoff), seeds=seeds))


_FOLD = """
with recursive f as (select user_id, ts, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('view', 'click', 'purchase')),
s(user_id, rn, ts, event_type, pos) as (
  select user_id, rn, ts, event_type, case when event_type = 'view' then 1 else 0 end from f where rn = 1
  union all select f.user_id, f.rn, f.ts, f.event_type, s.pos + case when f.event_type = case s.pos % 3 when 0 then 'view' when 1 then 'click' else 'purchase' end then 1 else 0 end
  from s join f on f.user_id = s.user_id and f.rn = s.rn + 1)
"""


@query(QUERIES, ORACLES, _FOLD + f"select 'r-sequence' as rule_id, user_id, {_T} from s where event_type = 'purchase' and pos // 3 >= 2")
def rule_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(evaluate(events(spark, sf_dir), Rule("r-sequence", Condition("purchase"), sequence=["view", "click", "purchase"], times=2)))


@query(QUERIES, ORACLES, _FOLD + "select user_id, (max(pos) // 3)::bigint as completed from s group by 1")
def sequence_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_progress(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"), ["view", "click", "purchase"])


@query(QUERIES, ORACLES, """
with f as (select 'rule-' || (event_id % 50) as rule_id, event_id as seq, case when event_type = 'error' then 'd' else 'u' end as op, (user_id % 3)::int as online_status from events),
r as (select *, row_number() over (partition by rule_id order by seq desc) as rn from f)
select rule_id, seq from r where rn = 1 and op <> 'd' and online_status = 2""")
def rule_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = table(spark, sf_dir, "events").select(F.concat(F.lit("rule-"), F.col("event_id") % 50).alias("rule_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"), (F.col("user_id") % 3).cast("int").alias("online_status"))
    return active_rules(feed).select("rule_id", "seq")


@query(QUERIES, ORACLES, f"""
with r as (select *, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as n from events)
select 'r-third' as rule_id, user_id, {_T} from r where event_type = 'purchase' and n >= 2 and user_id in (select c_custkey from customer where c_custkey % 3 <> 0)
union all select 'r-owed' as rule_id, user_id, {_T} from r where event_type = 'signup' and user_id in (select c_custkey from customer where c_acctbal > 0)
union all select 'r-open' as rule_id, user_id, {_T} from r where event_type = 'error' and n >= 5""")
def rule_audience_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose audiences stand as compressed bitmaps in their rows."""
    member = F.array_compact(F.array(F.when(F.col("c_custkey") % 3 != 0, "r-third"), F.when(F.col("c_acctbal") > 0, "r-owed")))
    members = table(spark, sf_dir, "customer").select(F.explode(member).alias("rule_id"), F.col("c_custkey").alias("user_id"))
    rule_rows = as_column(containers(members, "user_id", ["rule_id"]), ["rule_id"])
    known = [Rule("r-third", Condition("purchase"), [Condition("click", 2)], has_audience=True), Rule("r-owed", Condition("signup"), has_audience=True), Rule("r-open", Condition("error"), [Condition("click", 5)])]
    return _matches(evaluate_all(events(spark, sf_dir), known, audience=from_column(rule_rows, ["rule_id"])))

"""Marketing rules over an event stream: rule models, the rule table, audiences, counted and ordered conditions, matches.

Rules are data. All rules are evaluated in one pass: their triggers (which event plays which part in which rule) are joined to
the events by event type, and what follows is keyed by (rule, user).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import all_of, compare, compare_data, property_or_blank
from tidemark.operators.bitmaps import members_only
from tidemark.operators.changelog import latest
from tidemark.operators.lookup import sized
from tidemark.operators.sequence import fold_steps

Check = tuple[str, str, Sequence]


@dataclass(frozen=True)
class Condition:
    """An event to be counted: its id, and comparisons of its properties; least: the count that satisfies.

    Events later than until ('yyyy-MM-dd HH:mm:ss') are not counted.
    """

    event: str
    least: int = 1
    properties: Sequence[Check] = ()
    flag: str = "1"
    until: str | None = None

    def holds(self, event: Column, properties: Column) -> Column:
        checks = [compare(property_or_blank(properties, k), op, v) for k, op, v in self.properties]
        return (event == self.event) & all_of(checks)


@dataclass(frozen=True)
class Rule:
    """fire: the event that matches. counted: conditions that must hold by then, the firing event included.
    sequence: events to be passed in order at least times. Only events after cutoff are counted and fire; seeds hold what was before."""

    rule_id: str
    fire: Condition
    counted: Sequence[Condition] = ()
    sequence: Sequence[str] = ()
    times: int = 1
    profile: Sequence[Check] = ()
    has_audience: bool = False
    cutoff: str | None = None


# The names in the JSON below are those that rules are written with.


def _values(value: object) -> list[str]:
    return [str(v) for v in (value if isinstance(value, list) else [value])]


def _profile(listed: list[dict]) -> list[Check]:
    """Conditions as {tag_name, compare_op, compare_value} or {tag_name, compare_type, tag_value}."""
    return [(c["tag_name"], c.get("compare_op") or c["compare_type"], _values(c["compare_value"] if "compare_value" in c else c["tag_value"])) for c in listed]


def _fire(given: dict) -> Condition:
    """fire_event as {event_id, properties: [..]} or {event_id, pro_name, pro_value}, or fire_event_id."""
    event = given.get("fire_event") or {"event_id": given.get("fire_event_id") or given["event_id"]}
    checks = [(p["property_name"], p["compare_op"], _values(p["compare_value"])) for p in event.get("properties", ())]
    if "pro_name" in event:
        checks.append((event["pro_name"], "=", _values(event["pro_value"])))
    return Condition(event["event_id"], properties=checks)


def _counted(given: dict) -> list[Condition]:
    out = [Condition(c["event_id"], int(c["event_cnt"]), flag=str(c["flag_id"]), until=(c.get("end_time") or "").strip() or None) for c in given.get("dynamic_profile", ())]
    online = given.get("online_profile", {})
    if "event_count" in online:
        out.append(Condition(online["event_id"], int(online["event_count"])))
    return out


def _counts_model(given: dict, **more) -> Rule:
    return Rule(given["rule_id"], _fire(given), _counted(given), profile=_profile(given.get("static_profile") or given.get("offline_profile") or []), **more)


def _sequence_model(given: dict, **more) -> Rule:
    rule, online = _counts_model(given, **more), given["online_profile"]
    return Rule(rule.rule_id, rule.fire, rule.counted, tuple(online["event_seq"]), int(online["seq_count"]), rule.profile, **more)


def _history_model(given: dict, **more) -> Rule:
    """Counts before the cutoff come from seeds, later ones from the stream."""
    return _counts_model(given, cutoff=given.get("dynamic_profile_history_query_end"), **more)


def _past_model(given: dict, **more) -> Rule:
    """A count in the past alone: all of it comes from seeds. min_count within start_time and end_time, flag c_id."""
    past = given["online_history_profile"]
    counted = [Condition(past["event_id"], int(past["min_count"]), flag=str(past["c_id"]), until="0001-01-01 00:00:00")]
    return Rule(given["rule_id"], _fire(given), counted, profile=_profile(given.get("offline_profile") or []), **more)


#: Named models: what a rule's parameters mean. A new one is registered here in code; no code is run from the rule table.
MODELS: dict[str, Callable[..., Rule]] = {"counts": _counts_model, "event": _counts_model, "sequence": _sequence_model, "history": _history_model, "past": _past_model}


def parse_rule(model: str, parameters: str, has_audience: bool = False, history_end: str | None = None) -> Rule:
    """A rule of the rule table from its model's name and its JSON parameters; an unknown model or operator is a ValueError."""
    if model not in MODELS:
        raise ValueError(f"rule model {model!r} is not one of {sorted(MODELS)}")
    given = json.loads(parameters)
    if history_end is not None:
        given["dynamic_profile_history_query_end"] = history_end
    rule = MODELS[model](given, has_audience=has_audience)
    for _, op, values in [*rule.profile, *(p for c in (rule.fire, *rule.counted) for p in c.properties)]:
        compare(F.lit(""), op, values, known=True)
    return rule


def active_rules(feed: DataFrame, respect_status: bool = True, online: int = 2) -> DataFrame:
    """The rules in force after a change feed (rule_id, seq, op, online_status, ...)."""
    rules = latest(feed, ["rule_id"], ["seq"], "op")
    return rules.where(F.col("online_status") == online) if respect_status else rules


_CHECKS = "array<struct<name:string,op:string,given:array<string>>>"
_COUNT, _STEP, _FIRE = 0, 1, 2  # in the order in which one event's parts count
_ORDER = ("ts", "event_id", "part", "number")
_TRIGGERS = f"event string, part int, number int, checks {_CHECKS}, hits array<int>, until string, rule_id string, least array<int>, flags array<string>, ids array<string>, steps_id string, n_steps int, times int, cutoff string, has_audience boolean, has_profile boolean"


def as_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows that the driver holds, as a literal of the plan: no worker is asked for them."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _checks(listed: Sequence[Check]) -> list[dict]:
    return [{"name": k, "op": op, "given": _values(list(v))} for k, op, v in listed]


def _digest(*parts: object) -> str:
    return hashlib.md5(json.dumps(parts).encode(), usedforsecurity=False).hexdigest()[:16]


def condition_ids(rule: Rule) -> list[str]:
    """What the counts of a rule's conditions are kept under: the flag, and what it counts.

    A condition that is moved, or gets another least, goes on counting. One that counts other events, or is a second of
    the same flag, is another.
    """
    seen: dict[str, int] = {}
    out = []
    for c in rule.counted:
        name = f"{c.flag}|{_digest(c.event, _checks(c.properties), c.until, rule.cutoff)}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}|{seen[name]}")
    return out


def sequence_id(rule: Rule) -> str | None:
    """What the steps that a rule's users have passed are kept under."""
    return f"steps|{_digest(*rule.sequence)}" if rule.sequence else None


def event_types(rules: Sequence[Rule]) -> list[str]:
    return sorted({e for r in rules for e in (r.fire.event, *r.sequence, *(c.event for c in r.counted))})


Since = Mapping[str, Mapping[str, int]]


def triggers(spark: SparkSession, rules: Sequence[Rule], since: Since | None = None) -> DataFrame:
    """A row for each part that an event plays in a rule; as many as the rules have conditions and steps, all told.

    since: by rule, the time from which each of its condition_ids counts, which then is part of what counts are kept under.
    """
    rows = []
    for r in rules:
        name = lambda i: i if i is None or since is None else f"{i}@{since[r.rule_id][i]}"  # noqa: B023, E731
        common = {"rule_id": r.rule_id, "least": [c.least for c in r.counted], "flags": [c.flag for c in r.counted], "ids": [name(i) for i in condition_ids(r)], "steps_id": name(sequence_id(r)), "n_steps": len(r.sequence), "times": r.times, "cutoff": r.cutoff, "has_audience": r.has_audience, "has_profile": bool(r.profile)}
        part = lambda event, kind, number, checks=(), hits=None, until=None: rows.append({"event": event, "part": kind, "number": number, "checks": _checks(checks), "hits": hits, "until": until, **common})  # noqa: B023, E731
        for i, c in enumerate(r.counted):
            part(c.event, _COUNT, i, c.properties, until=c.until)
        for e in dict.fromkeys(r.sequence):
            part(e, _STEP, -1, hits=[i for i, x in enumerate(r.sequence) if x == e])
        part(r.fire.event, _FIRE, -1, r.fire.properties)
    return as_rows(spark, rows, _TRIGGERS)


def _fitting(profile: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, user_id of the users whose profile fits the rule's conditions, which are data: the plan is the same for any number."""
    tags = sorted({tag for r in rules for tag, _, _ in r.profile})
    known = F.create_map(*[x for t in tags for x in (F.lit(t), F.col(t).cast("string"))])
    given = F.from_json(F.lit(json.dumps([{"rule_id": r.rule_id, "checks": _checks(r.profile)} for r in rules])), f"array<struct<rule_id:string,checks:{_CHECKS}>>")
    fits = F.filter(given, lambda r: F.forall(r["checks"], lambda c: compare_data(F.element_at("__tags", c["name"]), c["op"], c["given"])))
    return profile.select("user_id", known.alias("__tags")).select("user_id", F.explode(F.transform(fits, lambda r: r["rule_id"])).alias("rule_id")).distinct()


def _only(rows: DataFrame, flag: str, allowed: DataFrame) -> DataFrame:
    """rows of which those with the flag are among allowed: (rule_id, user_id), or containers of bitmaps by rule_id (operators.bitmaps)."""
    if "bucket" in allowed.columns:
        return members_only(rows, "user_id", allowed, ["rule_id"], flag)
    marked = allowed.select("rule_id", "user_id").distinct().withColumn("__in", F.lit(True))
    return rows.join(sized(marked), ["rule_id", "user_id"], "left").where(~F.col(flag) | F.col("__in").isNotNull()).drop("__in")


def progress(events: DataFrame, rules: Sequence[Rule], profile: DataFrame | None = None, audience: DataFrame | None = None, seeds: DataFrame | None = None, state: DataFrame | None = None, since: Since | None = None) -> DataFrame:
    """Every part that an event plays in a rule, and whether the rule fires; with since, also what it has counted for the user by then.

    events: user_id, event_id, event_type, ts, properties. Only those of types that some rule names are read. counts is a map by
    condition_ids and sequence_id (see triggers), and includes the event itself; seeds (rule_id, flag_id, user_id, cnt) count what came
    up to the cutoff. state (rule_id, user_id, counts) is what earlier events left (see left_by); of it, only what the
    rules' conditions still count goes on. Events that play a part are shuffled, once, by rule and user.
    """
    rows = events.select("user_id", "event_id", "event_type", "ts", "properties").where(F.col("event_type").isin(event_types(rules)))
    rows = rows.join(F.broadcast(triggers(events.sparkSession, rules, since)), F.col("event_type") == F.col("event"))
    if any(c.properties for r in rules for c in (r.fire, *r.counted)):
        rows = rows.where(F.forall("checks", lambda c: compare_data(F.coalesce(F.col("properties")[c["name"]], F.lit("")), c["op"], c["given"])))
    if any(r.cutoff or c.until for r in rules for c in (r.fire, *r.counted)):
        at = F.col("ts").cast("timestamp")
        live = (F.col("cutoff").isNull() | (at > F.to_timestamp("cutoff"))) & (F.col("until").isNull() | (at <= F.to_timestamp("until")))
        rows = rows.where((F.col("part") == _STEP) | live)
    rows = rows.drop("event", "event_type", "properties", "checks", "cutoff", "until")
    if any(r.has_audience for r in rules):
        rows = _only(rows, "has_audience", audience)
    if with_profile := [r for r in rules if r.profile]:
        rows = _only(rows, "has_profile", _fitting(profile, with_profile))
    most = max((len(r.counted) for r in rules), default=0)
    key, order = ["rule_id", "user_id"], list(_ORDER)
    if seeds is not None:
        by_flag = seeds.groupBy(*key, "flag_id").agg(F.sum("cnt").alias("cnt"))
        by_flag = by_flag.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("flag_id", "cnt"))).alias("__seeds"))
        rows = rows.join(sized(by_flag), key, "left")
    if state is not None:
        rows = rows.join(state.select(*key, F.col("counts").alias("__counts")), key, "left")
    before = lambda name: F.coalesce(F.col("__counts")[name], F.lit(0)) if state is not None else F.lit(0)
    along = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [(F.sum(F.when(F.col("number") == i, 1).otherwise(0)).over(along) + before(F.get("ids", F.lit(i)))).alias(f"__c{i}") for i in range(most)]
    rows = rows.select("*", *counts)
    met = [F.lit(True)]
    for i in range(most):
        total = F.col(f"__c{i}")
        if seeds is not None:
            total = total + F.coalesce(F.col("__seeds")[F.get("flags", F.lit(i))], F.lit(0))
        met.append((F.size("least") <= i) | (total >= F.get("least", F.lit(i))))
    # What is counted goes on only where it is to be kept.
    kept = [] if since is None else ["ids", "steps_id", F.array(*[F.col(f"__c{i}").cast("long") for i in range(most)]).cast("array<bigint>").alias("__counted")]
    rows = rows.select(*key, *order, "hits", "n_steps", "times", all_of(met).alias("met"), *kept, before(F.col("steps_id")).cast("long").alias("start"))
    rows = fold_steps(rows, key, order) if any(r.sequence for r in rules) else rows.withColumn("passed", F.lit(0).cast("long"))
    done = (F.col("n_steps") == 0) | (F.floor(F.col("passed") / F.greatest("n_steps", F.lit(1))) >= F.col("times"))
    fires = ((F.col("part") == _FIRE) & F.col("met") & done).alias("fires")
    if since is None:
        return rows.select(*key, *order, fires)
    by_id = F.map_from_arrays("ids", F.slice("__counted", F.lit(1), F.size("ids")))
    counts = F.when(F.col("n_steps") > 0, F.map_concat(by_id, F.create_map(F.coalesce("steps_id", F.lit("")), F.col("passed")))).otherwise(by_id)
    return rows.select(*key, *order, counts.alias("counts"), fires)


def matches(rows: DataFrame) -> DataFrame:
    """rule_id, user_id, match_time of the firing events of progress()."""
    return rows.where("fires").select("rule_id", "user_id", F.col("ts").alias("match_time"))


def left_by(rows: DataFrame) -> DataFrame:
    """rule_id, user_id, counts after all events of progress()."""
    return rows.groupBy("rule_id", "user_id").agg(F.max_by("counts", F.struct(*_ORDER)).alias("counts"))


def evaluate_all(events: DataFrame, rules: Sequence[Rule], profile: DataFrame | None = None, audience: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """rule_id, user_id, match_time of each event at which a rule's conditions all hold, for all rules in one pass."""
    return matches(progress(events, rules, profile, audience, seeds))


def evaluate(events: DataFrame, rule: Rule, profile: DataFrame | None = None, audience: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    return evaluate_all(events, [rule], profile, audience, seeds)


def match_message(found: DataFrame, time_name: str = "match_time") -> DataFrame:
    """Matches as JSON texts {rule_id, user_id, time_name}, the time in epoch milliseconds."""
    millis = F.unix_millis(F.col("match_time").cast("timestamp")).alias(time_name)
    return found.select(F.to_json(F.struct("rule_id", "user_id", millis)).alias("value"))


def replay(events: DataFrame, rules_since: DataFrame, minutes: int) -> DataFrame:
    """Recent events for rules that have just come into force: (rule_id, since) x events of the last minutes before it.

    Both sides are cut into stretches of so many minutes and joined by them, so that no event meets a rule whose time is far from its own.
    """
    width = minutes * 60
    bucket = lambda t: F.floor(F.unix_seconds(F.col(t).cast("timestamp")) / width)
    near = rules_since.withColumn("__b", F.explode(F.array(bucket("since") - 1, bucket("since"))))
    within = (F.col("ts") > F.col("since") - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= F.col("since"))
    return events.withColumn("__b", bucket("ts")).join(near, "__b").where(within).drop("__b")

"""Registered queries by name, and DuckDB SQL for them."""

from tidemark.plans.behaviour import ORACLES as _behaviour_sql
from tidemark.plans.behaviour import QUERIES as _behaviour
from tidemark.plans.enrich import ORACLES as _enrich_sql
from tidemark.plans.enrich import QUERIES as _enrich
from tidemark.plans.orders import ORACLES as _orders_sql
from tidemark.plans.orders import QUERIES as _orders
from tidemark.plans.rules import ORACLES as _rules_sql
from tidemark.plans.rules import QUERIES as _rules

QUERIES = {**_behaviour, **_orders, **_rules, **_enrich}
ORACLE_SQL = {**_behaviour_sql, **_orders_sql, **_rules_sql, **_enrich_sql}

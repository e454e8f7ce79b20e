"""Quality rules: a short-circuit cascade over native columns, ordered by rejections per cost.

A rule is a test of metrics, which are made of parts (words, lines, sorted windows). On a sample, one job counts
which rules reject which rows, and the work that each part and each rule has there (characters, words, lines), of which UNIT_COSTS gives the time. The cascade takes next the rule with
the most rejections, among the rows that are left, per second, where only parts that no earlier rule has made cost
anything. It is a chain of stages: a stage makes the parts that its rule needs, and its filter ends the rows that the
rule rejects, so that no later part is made for them. The order changes the cost and never the verdict. The report needs
every metric of every row; there the cascade names the rule that rejects, as one CASE expression.

Everything is DataFrame expressions. Edge cases: a null text has no words; a text without words has zeros in every
metric and fails the word-count rule. Texts of any length are read whole. Rows are independent of each other, so
repeated ids or rows each get their verdict. The filter keeps a row's columns in a struct of its own, and the report
reads no column but the two named, so their names can't clash with the metrics'. An empty table gives an empty result,
with the rules in the order given.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, as_rows, lines_of, named, of_row, words_of

#: Windows are packed into one long as hash bits above and place below; longer texts sort (hash, place) structs.
PLACE_BITS = 21

_WINDOWS = f"""
case when size(__tm_w) < 3 then array()
     else sort_array(transform(sequence(0, size(__tm_w) - 3), i ->
          shiftleft(shiftright(xxhash64(__tm_w[i], __tm_w[i + 1], __tm_w[i + 2]), {PLACE_BITS}), {PLACE_BITS}) | i)) end
"""
_MASK = (1 << PLACE_BITS) - 1


def _same(a: str, b: str) -> str:
    """SQL: the packed windows a and b hold the same three words."""
    at = lambda x, k: f"__tm_w[cast({x} & {_MASK} as int) + {k}]"
    return f"(shiftright({a}, {PLACE_BITS}) = shiftright({b}, {PLACE_BITS}) and " + " and ".join(f"{at(a, k)} = {at(b, k)}" for k in range(3)) + ")"


_REPEATED = f"""
size(array_distinct(flatten(transform(
    filter(__tm_s, (x, j) -> (j > 0 and {_same("x", "__tm_s[j - 1]")}) or (j < size(__tm_s) - 1 and {_same("x", "__tm_s[j + 1]")})),
    x -> array(cast(x & {_MASK} as int), cast(x & {_MASK} as int) + 1, cast(x & {_MASK} as int) + 2)))))
"""
_LONG = """
size(array_distinct(flatten(transform(
    filter(__tm_g, (x, j) -> (j > 0 and x.h = __tm_g[j - 1].h) or (j < size(__tm_g) - 1 and x.h = __tm_g[j + 1].h)),
    x -> array(x.i, x.i + 1, x.i + 2)))))
"""


@dataclass(frozen=True)
class Rule:
    """rejects: SQL over the metrics of with_metrics (with the prefix __tm_)."""

    name: str
    rejects: str


#: Fixed thresholds, in integers so that no rounding decides.
RULES = (
    Rule("too_few_words", "__tm_n_words < 50"),
    Rule("repeated_windows", "100 * __tm_n_repeat_words > 50 * __tm_n_words"),
    Rule("symbols", "10 * __tm_n_symbols > __tm_n_words"),
    Rule("word_length", "__tm_word_chars < 2 * __tm_n_words or __tm_word_chars > 15 * __tm_n_words"),
    Rule("repeated_lines", "__tm_n_dup_lines > 3 and 10 * __tm_n_dup_lines > 3 * __tm_n_lines"),
    Rule("few_letters", "10 * __tm_n_letters < 6 * __tm_word_chars"),
)


def _short() -> str:
    return f"size(__tm_w) < {1 << PLACE_BITS}"


def _parts(text: Column) -> dict[str, Column]:
    """The columns that metrics are made of, each after those it needs."""
    return {
        "__tm_w": words_of(text),
        "__tm_l": F.filter(lines_of(text), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        "__tm_s": F.expr(f"case when {_short()} then {_WINDOWS} else array() end"),
        "__tm_g": F.expr(f"case when {_short()} then array() when size(__tm_w) < 3 then array() else sort_array(transform(sequence(0, size(__tm_w) - 3), i -> struct(xxhash64(__tm_w[i], __tm_w[i + 1], __tm_w[i + 2]) as h, i as i))) end"),
    }


def _metrics(text: Column) -> dict[str, tuple[Column, tuple[str, ...]]]:
    """name: (metric, the parts it needs)"""
    length_without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return {
        "__tm_n_words": (F.size("__tm_w").cast("long"), ("__tm_w",)),
        "__tm_word_chars": (F.length(F.translate(text, SPACE, "")).cast("long"), ()),
        "__tm_n_symbols": (length_without("#*$%&|<>").cast("long"), ()),
        "__tm_n_lines": (F.size("__tm_l").cast("long"), ("__tm_l",)),
        "__tm_n_dup_lines": ((F.size("__tm_l") - F.size(F.array_distinct("__tm_l"))).cast("long"), ("__tm_l",)),
        "__tm_n_repeat_words": (F.expr(f"case when {_short()} then {_REPEATED} else {_LONG} end").cast("long"), ("__tm_w", "__tm_s", "__tm_g")),
        "__tm_n_letters": (F.length(F.regexp_replace(text, "[^\\p{L}]+", "")).cast("long"), ()),
    }


def _once(column: Column) -> Column:
    """Parts must be computed once a row, and after the filters before them: a predicate that Spark moves below their projection
    would put their expressions into the lambdas above and compute them for each word. Spark moves nothing over columns
    that are not deterministic in name; this condition always holds."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def with_metrics(docs: DataFrame, text_col: str = "text", only: set[str] | None = None, text: Column | None = None) -> DataFrame:
    """docs with the metrics as __tm_ columns, and their parts; only: those metrics, and what docs lacks of their parts."""
    text = F.coalesce(named(text_col) if text is None else text, F.lit(""))
    metrics = {k: v for k, v in _metrics(text).items() if only is None or k in only}
    needed = {p for _, parts in metrics.values() for p in parts} - set(docs.columns)
    parts = {k: _once(v) for k, v in _parts(text).items() if k in needed}
    for level in (("__tm_w", "__tm_l"), ("__tm_s", "__tm_g")):
        if own := {k: v for k, v in parts.items() if k in level}:
            docs = docs.withColumns(own)
    return docs.withColumns({k: m for k, (m, _) in metrics.items()})


def _used(rule: Rule) -> frozenset[str]:
    return frozenset(re.findall(r"__tm_\w+", rule.rejects))


def _parts_of(rule: Rule) -> frozenset[str]:
    every = _metrics(F.lit(""))
    return frozenset(p for m in _used(rule) for p in every[m][1])


#: Nanoseconds of a core for a unit of work, by part and by metric, as measured on one core over texts of sf0.1: chars, words and
#: lines of the texts, long_words those of texts beyond the packed windows. What is not listed takes next to none.
UNIT_COSTS = {
    "__tm_w": ("chars", 37),
    "__tm_l": ("chars", 7),
    "__tm_s": ("words", 520),
    "__tm_g": ("long_words", 600),
    "__tm_word_chars": ("chars", 35),
    "__tm_n_symbols": ("chars", 33),
    "__tm_n_letters": ("chars", 30),
    "__tm_n_repeat_words": ("words", 555),
    "__tm_n_dup_lines": ("lines", 200),
}


def costs(work: Mapping[str, float], rules: Sequence[Rule]) -> tuple[dict[str, float], dict[str, float]]:
    """Seconds of each part, and of each rule without its parts, for so many chars, words, lines and long_words."""

    def seconds(name: str) -> float:
        unit, cost = UNIT_COSTS.get(name, ("chars", 0))
        return max(work[unit] * cost * 1e-9, 1e-9)

    of_part = {p: seconds(p) for r in rules for p in _parts_of(r)}
    return of_part, {r.name: sum(seconds(m) for m in _used(r)) for r in rules}


def ordered_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, seed: int = 7, text: Column | None = None) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected of the rows that it is asked for) on a sample of about sample_rows rows, in the order to ask them.

    Selectivity and the work that costs follow from are counted in one job over the sample, so one table gives one order.
    """
    rows = docs.count()
    if not rows:
        return [(rule, 0.0, 0.0) for rule in rules]
    sample = docs.select((named(text_col) if text is None else text).alias("text"))
    if rows > sample_rows:
        sample = sample.sample(False, min(1.0, 1.2 * sample_rows / rows), seed)
    verdicts = [F.expr(f"coalesce({r.rejects}, false)").cast("int").alias(f"r{i}") for i, r in enumerate(rules)]
    units = {"chars": F.length("text"), "words": F.col("__tm_n_words"), "lines": F.col("__tm_n_lines"), "long_words": F.when(F.expr(f"not {_short()}"), F.col("__tm_n_words"))}
    measured = with_metrics(sample).select(*verdicts, *[c.alias(n) for n, c in units.items()])
    found = measured.groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count("*").alias("n"), *[F.sum(u).alias(u) for u in units]).collect()  # at most 2 ** rules rows
    work = {u: float(sum(p[u] or 0 for p in found)) for u in units}
    return arranged(rules, [(tuple(p)[: len(rules)], p["n"]) for p in found], *costs(work, rules))


def arranged(rules: Sequence[Rule], patterns: list[tuple[tuple[int, ...], int]], of_part: Mapping[str, float], of_rule: Mapping[str, float]) -> list[tuple[Rule, float, float]]:
    """The rules, each next one having the most rejections a second; ties stay in the order given.

    patterns: verdicts of all rules, and the number of rows that have them.
    """
    out, left, made = [], list(range(len(rules))), set()
    while left:
        total = sum(n for _, n in patterns)
        found = []
        for i in left:
            seconds = of_rule[rules[i].name] + sum(of_part[p] for p in _parts_of(rules[i]) - made)
            found.append((i, seconds, sum(n for v, n in patterns if v[i]) / total if total else 0.0))
        # Where nothing more is rejected, the cheaper rule comes first.
        i, seconds, share = min(found, key=lambda x: (-x[2] / x[1], x[1] if not x[2] else 0, x[0]))
        out.append((rules[i], seconds, share))
        left.remove(i)
        made |= _parts_of(rules[i])
        patterns = [(v, n) for v, n in patterns if not v[i]]
    return out


def cascade(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = F
    for rule in rules:
        out = out.when(F.expr(rule.rejects), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sample) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by of each row."""
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    order = [x[0] for x in ordered_rules(rows, **sample)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = F.expr(f"({RULES[0].rejects}) or ({RULES[1].rejects})")
    rows = with_metrics(rows).select("doc_id", *[F.col(f"__tm_{n}").alias(n) for n in names], base.alias("base_failed"), cascade(order).alias("rejected_by"))
    return rows.select(F.col("doc_id").alias(id_col), *names, "base_failed", (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")


def staged(rows: DataFrame, order: Sequence[Rule], text: Column) -> DataFrame:
    """rows, and the parts so far, that no rule rejects: each rule's parts are made for the rows that the rules before it left."""
    for rule in order:
        rows = with_metrics(rows, only=set(_used(rule)), text=text)
        rows = rows.where(~F.coalesce(F.expr(rule.rejects), F.lit(False))).drop(*_used(rule))
    return rows


def keep_good(docs: DataFrame, text_col: str = "text", **sample) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns."""
    rows, text = as_rows(docs), of_row(text_col)
    order = [x[0] for x in ordered_rules(rows, text=text, **sample)]
    return staged(rows, order, text).select(*[of_row(c).alias(c) for c in docs.columns])

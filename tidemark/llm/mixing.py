"""Mixing sources to target weights: budgets down a domain-language-source tree, token prefixes of seeded epochs.

1. Every leaf (domain, language, source) is counted: documents and tokens. Its capacity is max_epochs times its tokens,
   a node's capacity that of its leaves.
2. The budget goes down the tree. At each node the children share by weight; a child whose capacity is less than its
   share gets its capacity, and what it lacks goes to its siblings by weight. As a node's share is cut to the capacity
   below it, only what the siblings can't take is missing at the parent, whose own siblings then share it.
3. A leaf with budget b over t tokens gives each document floor(b / t) times, and once more the documents at the front
   of the next epoch: those whose tokens, added up in the seeded order (one for all epochs), stay within what is left of b.
   The cut is found without sorting a leaf: its documents fall into about sqrt(n) buckets by their place in the order;
   running sums over buckets find the one with the cut, and running sums over that bucket's documents find the cut.
   With pass_on, what a leaf falls short by (less than the document at its cut) goes to a sibling, which is cut again, and what
   siblings leave to those of their ancestors: the whole falls short by less than one document.
   Each document then decides for itself by comparing its place with its leaf's cut, so no text moves; only beyond
   BROADCAST_LEAVES leaves do texts move to their leaf's cut, a leaf's dealt over SALTS tasks by their places.

Edge cases: a null domain, language or source is a leaf value of its own. A null or empty text has no tokens: it is
given floor(b / t) times like its leaf's others, and lies in a prefix if the documents before it do; a leaf without
any tokens gives each document once. Rows that repeat an id (or have none) are documents of their own, told apart by
their text; equal rows are taken or left together. Extra columns stay as they are, whatever their names: they move in
one struct. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, named, of_row, words_of, written

#: Leaves are broadcast up to this number, and joined by a salted shuffle beyond it.
BROADCAST_LEAVES, SALTS = 20_000, 64
LEVELS = ("__tm_domain", "__tm_lang", "__tm_source")


def source_domain(source: Column) -> Column:
    """Default domain of a source: one of four, by its name's checksum."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(source.cast("binary")), F.lit(4)))


def fill(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, budget, weight, capacity): adds share, the budget poured over them.

    In the order of capacity by weight, a child is full if what is left for it and its later siblings, by weight,
    is at least its capacity; the level of the others is what is left after the full ones by their weight.
    """
    group = Window.partitionBy(*parent)
    before = group.orderBy("__tm_ratio", "__tm_own").rowsBetween(Window.unboundedPreceding, -1)
    out = children.withColumn("__tm_ratio", F.when(F.col("__tm_weight") > 0, F.col("__tm_capacity") / F.col("__tm_weight")).otherwise(float("inf")))
    out = out.withColumn("__tm_left", F.col("__tm_budget") - F.coalesce(F.sum("__tm_capacity").over(before), F.lit(0)))
    out = out.withColumn("__tm_rest", F.sum("__tm_weight").over(group) - F.coalesce(F.sum("__tm_weight").over(before), F.lit(0.0)))
    out = out.withColumn("__tm_full", (F.col("__tm_weight") > 0) & (F.col("__tm_ratio") * F.col("__tm_rest") <= F.col("__tm_left")))
    full = F.col("__tm_full")
    out = out.withColumn("__tm_open", F.sum(F.when(full, 0.0).otherwise(F.col("__tm_weight"))).over(group))
    out = out.withColumn("__tm_over", F.col("__tm_budget") - F.sum(F.when(full, F.col("__tm_capacity")).otherwise(0)).over(group))
    share = F.when(full, F.col("__tm_capacity")).when(F.col("__tm_open") > 0, F.least("__tm_capacity", F.floor(F.col("__tm_over") * F.col("__tm_weight") / F.col("__tm_open")))).otherwise(0)
    return out.withColumn("__tm_share", F.greatest(share, F.lit(0)).cast("long"))


def leaf_budgets(leaves: DataFrame, budget: int, weights: Mapping[str, float], max_epochs: int) -> DataFrame:
    """leaves (levels, __tm_tokens) with __tm_budget. weights: by "domain", "domain/lang" or "domain/lang/source"; 1 if absent."""
    nodes, given = leaves.withColumn("__tm_capacity", (F.col("__tm_tokens") * max_epochs).cast("long")), None
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    for depth in range(1, len(LEVELS) + 1):
        above, here = list(LEVELS[: depth - 1]), list(LEVELS[:depth])
        children = nodes.groupBy(*here).agg(F.sum("__tm_capacity").alias("__tm_capacity"))
        path = F.concat_ws("/", *[F.coalesce(c, F.lit("null")) for c in here])
        weight = F.coalesce(table[path], F.lit(1.0)) if table is not None else F.lit(1.0)
        children = children.withColumns({"__tm_weight": weight.cast("double"), "__tm_own": path, "__tm_root": F.lit(0)})
        if given is None:
            children = children.withColumn("__tm_budget", F.lit(budget).cast("long"))
        else:
            children = children.join(given, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in above]).drop(*[f"{c}_" for c in above])
        filled = fill(children, ["__tm_root", *above])
        given = filled.select(*[F.col(c).alias(f"{c}_") for c in here], F.col("__tm_share").alias("__tm_budget"))
    return leaves.join(given, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in LEVELS]).drop(*[f"{c}_" for c in LEVELS])


def _with_leaf(df: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """df with table's columns, by leaf: broadcast while there are few leaves, else dealt over SALTS tasks by the places."""
    own = table.select(*[F.col(c).alias(f"{c}_") for c in LEVELS], *[c for c in table.columns if c not in LEVELS])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in LEVELS])
    if few:
        own = F.broadcast(own)
    elif "__tm_place" in df.columns:
        df = df.withColumn("__tm_salt", F.pmod(F.col("__tm_place"), F.lit(SALTS)).cast("int"))
        own = own.withColumn("__tm_salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = same & (F.col("__tm_salt") == F.col("__tm_salt_"))
    return df.join(own, same, how).drop(*[f"{c}_" for c in LEVELS], "__tm_salt", "__tm_salt_")


def _cuts(sizes: DataFrame, leaves: DataFrame, few: bool) -> DataFrame:
    """leaves (levels, __tm_docs, __tm_tokens, __tm_budget) with __tm_epochs, __tm_first_out (the first place beyond the prefix) and __tm_given (tokens)."""
    tokens = F.greatest("__tm_tokens", F.lit(1))
    epochs = F.when(F.col("__tm_tokens") == 0, 1).otherwise(F.floor(F.col("__tm_budget") / tokens)).cast("int")
    budgets = leaves.withColumns({"__tm_epochs": epochs, "__tm_more": F.when(F.col("__tm_tokens") == 0, 0).otherwise(F.col("__tm_budget") % tokens), "__tm_buckets": F.ceil(F.sqrt("__tm_docs")).cast("long")})
    budgets = written(budgets, "mix-budgets")
    own = budgets.select(*LEVELS, "__tm_more", "__tm_buckets")
    # The place's upper bits, scaled to the leaf's buckets, keep the order of the places.
    bucket = F.shiftright((F.shiftrightunsigned(F.col("__tm_place").bitwiseXOR(F.lit(-(1 << 63))), 33) * F.col("__tm_buckets")), 31)
    placed = _with_leaf(sizes, own, few).withColumn("__tm_bucket", bucket)
    summed = placed.groupBy(*LEVELS, "__tm_bucket", "__tm_more").agg(F.sum("__tm_size").alias("__tm_sum"))
    upto = Window.partitionBy(*LEVELS).orderBy("__tm_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = summed.withColumn("__tm_after", F.sum("__tm_sum").over(upto))
    crossed = runs.where("__tm_after > __tm_more").groupBy(*LEVELS).agg(F.min_by(F.struct(F.col("__tm_bucket").alias("bucket"), (F.col("__tm_after") - F.col("__tm_sum")).alias("before")), "__tm_bucket").alias("__tm_cut"))
    crossed = written(crossed, "mix-cuts")
    inside = _with_leaf(placed, crossed, few).where("__tm_bucket = __tm_cut.bucket")
    # Equal places (equal rows) go together: their sizes are added before the running sum.
    inside = inside.groupBy(*LEVELS, "__tm_more", "__tm_cut", "__tm_place").agg(F.sum("__tm_size").alias("__tm_size"))
    along = Window.partitionBy(*LEVELS).orderBy("__tm_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("__tm_after", F.col("__tm_cut.before") + F.sum("__tm_size").over(along))
    out = F.col("__tm_after") > F.col("__tm_more")
    last = inside.groupBy(*LEVELS).agg(F.min(F.when(out, F.col("__tm_place"))).alias("__tm_first_out"), F.coalesce(F.max(F.when(~out, F.col("__tm_after"))), F.max("__tm_cut.before")).alias("__tm_taken"))
    last = written(last, "mix-last")
    found = _with_leaf(budgets, last, few, "left").withColumn("__tm_given", F.when(F.col("__tm_tokens") == 0, 0).otherwise(F.col("__tm_epochs") * F.col("__tm_tokens") + F.coalesce("__tm_taken", F.lit(0))))
    found = written(found.select(*leaves.columns, "__tm_epochs", "__tm_first_out", "__tm_given"), "mix-places")
    discard(budgets, crossed, last)
    return found


def _passed_on(sizes: DataFrame, cuts: DataFrame, budget: int, max_epochs: int, few: bool) -> DataFrame:
    """cuts after what leaves fell short of went to siblings, and what these left to the siblings of their ancestors.

    At each level from the lowest, one leaf of each group, that with the most room, is given all that the group lacks,
    and is cut again. So each group falls short by less than one document, unless no leaf of it has room for that.
    """
    for depth in range(len(LEVELS) - 1, -1, -1):
        group = Window.partitionBy(F.lit(0), *LEVELS[:depth])
        room = F.col("__tm_tokens") * max_epochs - F.col("__tm_given")
        lacking = (F.sum("__tm_budget").over(group) if depth else F.lit(budget)) - F.sum("__tm_given").over(group)
        first = F.row_number().over(group.orderBy(F.desc(room), *[F.asc_nulls_first(c) for c in LEVELS])) == 1
        ranked = cuts.withColumns({"__tm_lacking": lacking, "__tm_takes": first}).withColumn("__tm_takes", F.col("__tm_takes") & (F.col("__tm_lacking") > 0) & (room > 0))
        ranked = written(ranked, "mix-lacking")
        again = ranked.where("__tm_takes").withColumns({"__tm_own": F.col("__tm_budget"), "__tm_budget": F.col("__tm_given") + F.least("__tm_lacking", room)})
        again = _cuts(sizes, again.select(*LEVELS, "__tm_docs", "__tm_tokens", "__tm_budget", "__tm_own"), few)
        # A group's budget stays the sum of its leaves' own.
        again = again.select(*LEVELS, "__tm_docs", "__tm_tokens", F.col("__tm_own").alias("__tm_budget"), "__tm_epochs", "__tm_first_out", "__tm_given")
        before, cuts = cuts, written(ranked.where("not __tm_takes").select(again.columns).unionByName(again), "mix-places")
        discard(before, ranked)
    return cuts


def mix(docs: DataFrame, tokens_share: float = 0.8, weights: Mapping[str, float] | None = None, max_epochs: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None, pass_on: bool = False) -> DataFrame:
    """row (docs' columns), copies (how many times it is given; rows of 0 copies are left out), domain, lang, source.

    The budget is tokens_share of all tokens, a token being a word. Levels' weights: see leaf_budgets. A leaf's prefix ends before
    the document that would pass its budget; with pass_on, what it falls short by is passed on (see _passed_on).
    """
    source = named(source_col).cast("string")
    leaf = [(source_domain(source) if domain is None else domain).alias(LEVELS[0]), named(lang_col).cast("string").alias(LEVELS[1]), source.alias(LEVELS[2])]
    place = F.xxhash64(F.lit(seed), named(id_col), F.xxhash64(named(text_col))).alias("__tm_place")
    # All columns of docs lie in one struct, so none can clash with those added here.
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), *leaf, place)
    sizes = written(rows.select(*LEVELS, "__tm_place", F.size(words_of(of_row(text_col))).cast("long").alias("__tm_size")), "mix-sizes")

    leaves = sizes.groupBy(*LEVELS).agg(F.count("*").alias("__tm_docs"), F.sum("__tm_size").alias("__tm_tokens"))
    leaves = written(leaves, "mix-leaves")
    counted = leaves.agg(F.sum("__tm_tokens").alias("tokens"), F.count("*").alias("leaves")).first()
    budget, few = int((counted["tokens"] or 0) * tokens_share), counted["leaves"] <= BROADCAST_LEAVES
    cuts = _cuts(sizes, leaf_budgets(leaves, budget, weights or {}, max_epochs), few)
    if pass_on:
        cuts = _passed_on(sizes, cuts, budget, max_epochs, few)
    discard(sizes, leaves)
    # Without a cut, the leaf's next epoch fits as a whole only if it has no tokens left to give.
    more = F.when(F.col("__tm_first_out").isNotNull() & (F.col("__tm_place") < F.col("__tm_first_out")), 1).otherwise(0)
    out = _with_leaf(rows, cuts.select(*LEVELS, "__tm_epochs", "__tm_first_out"), few).withColumn("copies", F.col("__tm_epochs") + more).where("copies > 0")
    return out.select("row", "copies", *[F.col(c).alias(c.removeprefix("__tm_")) for c in LEVELS])


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs' columns; a row for each copy."""
    copies = mix(docs, **how).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return copies.select(*[of_row(c).alias(c) for c in docs.columns])


def mix_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """id, domain, lang, source, copies of each row that is given at least once."""
    return mix(docs, id_col=id_col, **how).select(of_row(id_col).alias(id_col), "domain", "lang", "source", "copies")

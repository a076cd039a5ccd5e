"""Prompt and answer examples: checks, masking, padding, statistics and leakage control."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarit.plans.scale import broadcast_if_small, cut

# Ignored target, padding id, end mark, start mark.
IGNORED, PAD, END, START = -100, 0, 3, 2


def shared_names(pools: DataFrame) -> DataFrame:
    """name of pools (pool, split, name) that stands both in a train and in a test pool."""
    return pools.where("split = 'train'").select("name").intersect(pools.where("split = 'test'").select("name"))


def contained_names(pools: DataFrame) -> DataFrame:
    """pool, short, long: names of one pool that are part of another. Candidates meet in the longer name's substrings."""
    names = pools.select("pool", "name").distinct()
    n = F.length("name")
    parts = names.select("pool", F.col("name").alias("long"), F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("name"), i, k)))))).alias("short"))
    return parts.where("short <> long").join(names.select("pool", F.col("name").alias("short")), ["pool", "short"])


def small_pools(pools: DataFrame, least: int = 3) -> DataFrame:
    return pools.groupBy("pool").agg(F.count_distinct("name").alias("n")).where(F.col("n") < least)


def mention_order(prompt: Column, entities: Column) -> Column:
    """The entities in the order in which the prompt first names them; those it doesn't name are left out."""
    placed = F.transform(entities, lambda e: F.struct(F.instr(prompt, e).alias("at"), e.alias("entity")))
    return F.transform(F.array_sort(F.filter(placed, lambda s: s["at"] > 0)), lambda s: s["entity"])


def mask_targets(prompt: Column, answer: Column) -> tuple[Column, Column]:
    """input_ids and target_ids of prompt and answer ids: targets of the prompt are ignored, the end mark is learned."""
    ids = F.concat(prompt, answer, F.array(F.lit(END)))
    n = F.size(prompt)
    return F.slice(ids, 1, F.size(ids) - 1), F.concat(F.array_repeat(F.lit(IGNORED), n - 1), F.slice(ids, n + 1, F.size(answer) + 1))


def examples(df: DataFrame, longest: int = 128, strict: bool = True) -> DataFrame:
    """df (prompt_ids, answer_ids) with input_ids, target_ids, prompt_len, n_supervised.

    An empty side, a start mark or too many tokens is an error; with strict False such rows are left out."""
    empty = (F.coalesce(F.size("prompt_ids"), F.lit(0)) <= 0) | (F.coalesce(F.size("answer_ids"), F.lit(0)) <= 0)
    start = F.array_contains("prompt_ids", START) | F.array_contains("answer_ids", START)
    long = F.size("prompt_ids") + F.size("answer_ids") > longest
    fault = F.when(empty, "empty side").when(start, "start mark").when(long, "too long")
    if strict:
        df = df.where(F.coalesce(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("example: "), fault))).cast("boolean"), F.lit(True)))
    else:
        df = df.where(fault.isNull())
    inputs, targets = mask_targets(F.col("prompt_ids"), F.col("answer_ids"))
    return df.select("*", inputs.alias("input_ids"), targets.alias("target_ids"), F.size("prompt_ids").alias("prompt_len"), (F.size("answer_ids") + 1).alias("n_supervised"))


def collate(df: DataFrame) -> DataFrame:
    """df (batch, input_ids, target_ids) padded on the right to the longest row of each batch."""
    width = df.groupBy("batch").agg(F.max(F.size("input_ids")).alias("_width"))
    pad = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("_width") - F.size(c)))
    return df.join(width, "batch").withColumns({"input_ids": pad("input_ids", PAD), "target_ids": pad("target_ids", IGNORED)}).drop("_width")


def describe(df: DataFrame) -> DataFrame:
    """One row: examples, mean and greatest length, supervised tokens."""
    n = F.size("input_ids")
    return df.agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.max(n).alias("max_length"), F.coalesce(F.sum("n_supervised"), F.lit(0)).alias("supervised"))


def unblocked(df: DataFrame, blocked: DataFrame, key: str = "prompt") -> DataFrame:
    """df without rows whose key stands in the blocked table; null keys stay."""
    return df.join(blocked.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def split_statistics(df: DataFrame) -> DataFrame:
    """split, n, distinct prompts, share of the best fixed answer position among rows with one, the greatest answer
    share, and mean, 95th nearest-rank and greatest prompt length in words."""
    words = F.size(F.filter(F.split("prompt", " "), lambda w: w != ""))
    one = df.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("prompts"), F.count_if(F.col("answer_position") >= 0).alias("scored"), F.round(F.avg(words), 6).alias("mean_words"), F.max(words).alias("max_words"))
    lengths = df.groupBy("split", words.alias("_words")).agg(F.count("*").alias("_k")).where("_words is not null")
    upto = F.sum("_k").over(Window.partitionBy("split").orderBy("_words"))
    ranked = lengths.withColumn("_upto", upto).withColumn("_all", F.sum("_k").over(Window.partitionBy("split")))
    nearest = ranked.where(F.col("_upto") > F.floor(0.95 * (F.col("_all") - 1))).groupBy("split").agg(F.min("_words").alias("p95_words"))
    place = df.where("answer_position >= 0").groupBy("split", "answer_position").agg(F.count("*").alias("k")).groupBy("split").agg(F.max("k").alias("best"))
    answer = df.groupBy("split", "answer").agg(F.count("*").alias("k")).groupBy("split").agg(F.max("k").alias("often"))
    out = one.join(nearest, "split", "left").join(place, "split", "left").join(answer, "split")
    return out.select("split", "n", "prompts", F.round(F.col("best") / F.col("scored"), 6).alias("best_position"), F.round(F.col("often") / F.col("n"), 6).alias("best_answer"), "mean_words", "p95_words", "max_words")


def split_histograms(df: DataFrame, *columns: str) -> DataFrame:
    """split, column, value, n of the given columns' values."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return df.select("split", pairs).groupBy("split", "x.column", "x.value").agg(F.count("*").alias("n"))


def unknown_strings(strings: DataFrame, unknown: int = 1) -> DataFrame:
    """Rows of (string, ids) whose ids hold the unknown one."""
    return strings.where(F.array_contains("ids", unknown))


@dataclass(frozen=True)
class Grammar:
    """Sentence patterns of a language; a, b: entities, adj: adjective, noun, value, unit: of a dimension."""

    premise: str
    value: str
    two: str
    superlative: str
    pair: str
    middle: str
    both: str
    equal: str
    stop: str = "।"


HINDI = Grammar("{a} तो {b} से {adj} है", "{a} की {noun} {value} {unit} है", "बताइए, दोनों में {adj} कौन है?", "बताइए, इनमें सबसे {adj} कौन है?", "बताइए, {a} और {b} में {adj} कौन है?", "बताइए, बीच वाला कौन है?", "{a} और {b}", "बराबर")
# Family, its name, number of entities, whether it states values, its weight in training (0: held out).
FAMILIES = [(0, "pair_direct", 2, False, 15), (1, "chain_smallest", 3, False, 25), (2, "chain_largest", 3, False, 25), (3, "chain_pair_relation", 3, False, 0), (4, "numeric_extreme", 3, True, 23), (5, "numeric_equal", 2, True, 12), (6, "chain_middle", 3, False, 0)]
#: Least difference of two values of an example.
GAP = 3


def weighted_choice(unit: Column, weights: dict[int, int]) -> Column:
    """The key whose stretch of the weights' sum a number of [0, 1) falls into."""
    total, upto, out = sum(weights.values()), 0, None
    for key in sorted(weights):
        upto += weights[key]
        hit = unit < upto / total
        out = F.when(hit, key) if out is None else out.when(hit, key)
    return out


def filled(pattern: str, **parts: Column | str) -> Column:
    """A pattern with columns in place of its names."""
    pieces = re.split(r"\{(\w+)\}", pattern)
    return F.concat(*(parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)))


def generated(dims: DataFrame, names: DataFrame, candidates: int, weights: dict[int, int] | None = None, grammar: Grammar = HINDI, seed: int = 1337) -> DataFrame:
    """`candidates` draws of examples for each split: template, dim, ask, prompt, answer, entities in order of mention, candidates,
    order_names (greatest first, null where all are equal), value_map, pair, answer_index and answer_position (-1 where the answer
    is no entity).

    dims: dim, pool, big, small, noun, unit, low, high (of values); names: pool, split, name. Every draw follows from its
    number by hash. A dimension whose pool has fewer than three names of a split gives no draw for it. The names of a
    split and pool are numbered, so drawing is a join by number."""
    weights = weights or {f[0]: f[4] for f in FAMILIES if f[4]}
    u = lambda k, *more: F.pmod(F.xxhash64(F.lit(seed), "split", "i", F.lit(k), *more), F.lit(1 << 40)) / float(1 << 40)
    numbered = names.where("name is not null").select("pool", "split", "name").distinct().withColumn("k", F.row_number().over(Window.partitionBy("pool", "split").orderBy("name")) - 1)
    sizes = numbered.groupBy("pool", "split").agg(F.count("*").cast("int").alias("n")).where("n >= 3")
    kinds = dims.join(sizes, "pool").withColumn("d", F.row_number().over(Window.partitionBy("split").orderBy("dim", "pool")) - 1)
    kinds = cut(kinds.select("split", "d", "n", F.struct("dim", "big", "small", "noun", "unit", "low", "high", "pool").alias("x")))
    splits = kinds.groupBy("split").agg(F.count("*").cast("int").alias("_kinds"))  # a row for each split
    draws = dims.sparkSession.range(candidates).withColumnRenamed("id", "i").crossJoin(F.broadcast(splits))
    rows = draws.withColumn("template", weighted_choice(u(0), weights)).withColumn("d", F.floor(u(1) * F.col("_kinds")).cast("int"))
    rows = rows.join(broadcast_if_small(kinds), ["split", "d"])
    n = F.col("n")
    # three different numbers: each further one is counted among those that are left
    i0, j1, j2 = (F.floor(u(k) * (n - k + 2)).cast("int") for k in (2, 3, 4))
    rows = rows.withColumn("_i0", i0).withColumn("_j1", j1).withColumn("_i1", F.col("_j1") + (F.col("_j1") >= F.col("_i0")).cast("int"))
    low, high = F.least("_i0", "_i1"), F.greatest("_i0", "_i1")
    rows = rows.withColumn("_j2", j2).withColumn("_k2", F.col("_j2") + (F.col("_j2") >= low).cast("int")).withColumn("_i2", F.col("_k2") + (F.col("_k2") >= high).cast("int"))
    rows = rows.select("split", "i", "template", "x", F.col("x.pool").alias("pool"), "_i0", "_i1", "_i2")
    known = broadcast_if_small(cut(numbered))
    for k in range(3):
        rows = rows.join(known.withColumnsRenamed({"k": f"_i{k}", "name": f"e{k}"}), ["pool", "split", f"_i{k}"])
    numeric, three = F.col("template").isin(4, 5), ~F.col("template").isin(0, 5)
    # values apart by GAP at least: what the gaps leave is cut at two places
    span = F.col("x.high") - F.col("x.low") - 2 * GAP
    cuts = F.sort_array(F.array(*(F.floor(u(k) * (span + 1)).cast("int") for k in (5, 6, 7))))
    rows = rows.withColumn("_v", F.transform(cuts, lambda v, k: v + F.col("x.low") + k * GAP))  # ascending
    value = lambda k: F.when(F.col("template") == 5, F.get("_v", F.lit(0))).otherwise(F.get("_v", F.lit(2 - k))).cast("string")
    ask = F.when(F.col("template") == 1, "small").when(F.col("template") == 2, "big").when(F.col("template") == 6, "middle").when(u(8) < 0.5, "big").otherwise("small")
    rows = rows.withColumn("ask", ask).withColumn("_big", u(9) < 0.5)
    adj = F.when(F.col("ask") == "big", F.col("x.big")).otherwise(F.col("x.small"))
    word = F.when(F.col("_big"), F.col("x.big")).otherwise(F.col("x.small"))
    link = lambda a, b: F.when(F.col("_big"), filled(grammar.premise, a=F.col(a), b=F.col(b), adj=word)).otherwise(filled(grammar.premise, a=F.col(b), b=F.col(a), adj=word))
    stated = lambda k: filled(grammar.value, a=F.col(f"e{k}"), noun=F.col("x.noun"), value=value(k), unit=F.col("x.unit"))
    clauses = F.when(F.col("template") == 0, F.array(link("e0", "e1"))).when(F.col("template") == 5, F.array(stated(0), stated(1))).when(numeric, F.array(stated(0), stated(1), stated(2))).otherwise(F.array(link("e0", "e1"), link("e1", "e2")))
    rows = rows.withColumn("_clauses", F.transform(F.array_sort(F.transform(clauses, lambda c: F.struct(F.xxhash64(F.lit(seed), "split", "i", c).alias("h"), c.alias("c")))), lambda s: s["c"]))
    pair = F.when(u(10) < 0.5, F.array("e0", "e2")).otherwise(F.array("e2", "e0"))
    rows = rows.withColumn("pair", F.when(F.col("template") == 3, pair))
    question = F.when(F.col("template").isin(0, 5), filled(grammar.two, adj=adj)).when(F.col("template") == 3, filled(grammar.pair, a=F.get("pair", F.lit(0)), b=F.get("pair", F.lit(1)), adj=adj)).when(F.col("template") == 6, F.lit(grammar.middle)).otherwise(filled(grammar.superlative, adj=adj))
    told = F.when(F.col("template") == 3, F.array(filled(grammar.both, a=F.get("_clauses", F.lit(0)), b=F.get("_clauses", F.lit(1))))).otherwise(F.col("_clauses"))
    last = F.when(three, F.col("e2")).otherwise(F.col("e1"))
    answer = F.when(F.col("template") == 5, grammar.equal).when(F.col("template") == 6, F.col("e1")).when(F.col("ask") == "big", F.col("e0")).otherwise(last)
    rows = rows.withColumn("prompt", F.concat_ws(" ", F.transform(told, lambda c: F.concat(c, F.lit(grammar.stop))), question)).withColumn("answer", answer)
    order = F.when(three, F.array("e0", "e1", "e2")).otherwise(F.array("e0", "e1"))
    rows = rows.withColumn("_order", order).withColumn("entities", mention_order(F.col("prompt"), F.col("_order")))
    options = F.when(F.col("template") == 5, F.array_append("entities", F.lit(grammar.equal))).otherwise(F.col("entities"))
    values = F.when(numeric, F.map_from_arrays("_order", F.transform("_order", lambda e, k: F.when(F.col("template") == 5, F.get("_v", F.lit(0))).otherwise(F.get("_v", 2 - k)).cast("int"))))
    out = rows.withColumn("candidates", options).withColumn("order_names", F.when(F.col("template") != 5, F.col("_order"))).withColumn("value_map", values)
    return out.select("split", "i", "template", F.col("x.dim").alias("dim"), "ask", "prompt", "answer", "entities", "candidates", "order_names", "value_map", "pair", (F.array_position("candidates", F.col("answer")) - 1).cast("int").alias("answer_index"), (F.array_position("entities", F.col("answer")) - 1).cast("int").alias("answer_position"))


def taken(drawn: DataFrame, n: int, blocked: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """The n draws of each split that a generator keeps, with k from 0 on: prompts of the blocked table never, with unique
    each prompt once, and answer positions of a template in turns as far as the draws have them.

    A draw's turn is its number among those of its template and position, so what is over of one position comes after
    all turns that others have."""
    rows = drawn if blocked is None else unblocked(drawn, blocked)
    if unique:
        rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("split", "prompt").orderBy("i"))).where("_copy = 1").drop("_copy")
    share = rows.groupBy("split", "template").agg(F.count("*").alias("_size"))
    all_ = share.groupBy("split").agg(F.sum("_size").alias("_all"))
    quota = share.join(all_, "split").withColumn("_quota", F.ceil(F.col("_size") * n / F.col("_all")))
    turn = F.row_number().over(Window.partitionBy("split", "template", "answer_position").orderBy("i"))
    rows = rows.withColumn("_turn", turn).join(F.broadcast(quota.select("split", "template", "_quota")), ["split", "template"])  # a row for each template
    place = F.row_number().over(Window.partitionBy("split", "template").orderBy("_turn", "answer_position", "i"))
    rows = rows.withColumn("_place", place).where(F.col("_place") <= F.col("_quota"))
    k = F.row_number().over(Window.partitionBy("split").orderBy("_place", "template", "i")) - 1
    return rows.withColumn("k", k).where(F.col("k") < n).drop("_turn", "_quota", "_place", "i")

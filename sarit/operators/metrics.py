"""Metrics of language models and of generated text, from tables of what a model put out."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from sarit.functions import text as T


def packed_perplexity(nats: DataFrame) -> DataFrame:
    """One row of (nats): tokens, cross entropy, perplexity; the exponent is at most 30."""
    out = nats.agg(F.count("nats").alias("tokens"), F.avg("nats").alias("ce"))
    return out.select("tokens", F.round("ce", 6).alias("cross_entropy"), F.round(F.exp(F.least("ce", F.lit(30.0))), 6).alias("perplexity"))


def bits_per_byte(nats: DataFrame, n_bytes: DataFrame) -> DataFrame:
    """One row: nats of text tokens (is_end false) in bits, for each byte (n_bytes: one row)."""
    total = nats.where("not is_end").agg((F.sum("nats") / math.log(2)).alias("bits"))
    return total.crossJoin(n_bytes).select(F.round(F.col("bits") / F.col("n_bytes"), 6).alias("bits_per_byte"))


def sequence_score(nats: DataFrame, start: int) -> DataFrame:
    """id, log likelihood of the tokens from place `start` on, and its mean a token."""
    span = F.when(F.col("place") >= start, -F.col("nats"))
    return nats.groupBy("id").agg(F.round(F.sum(span), 6).alias("log_likelihood"), F.round(F.avg(span), 6).alias("mean_log_likelihood"))


def unigram_baseline(train: DataFrame, test: DataFrame, size: int) -> DataFrame:
    """One row: cross entropy and perplexity of test counts (token, n) under add-one shares of train counts."""
    total = train.agg(F.sum("n").alias("_all"))  # one row
    known = test.join(train.select("token", F.col("n").alias("seen")), "token", "left").crossJoin(F.broadcast(total))
    nats = -F.log((F.coalesce("seen", F.lit(0)) + 1) / (F.coalesce("_all", F.lit(0)) + size))
    out = known.agg((F.sum(nats * F.col("n")) / F.sum("n")).alias("ce"))
    return out.select(F.round("ce", 6).alias("cross_entropy"), F.round(F.exp(F.least("ce", F.lit(30.0))), 6).alias("perplexity"))


def ngrams(items: Column, n: int) -> Column:
    """The n-grams of an array, as arrays."""
    last = F.size(items) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def distinct_share(df: DataFrame, items: str, n: int) -> DataFrame:
    """One row: distinct-n over all rows' n-grams, 0 without any, and the repetition rate, 1 - distinct-n, likewise."""
    grams = df.select(F.explode(ngrams(F.col(items), n)).alias("g")).groupBy("g").agg(F.count("*").alias("k"))
    out = grams.agg(F.count("*").alias("kinds"), F.coalesce(F.sum("k"), F.lit(0)).alias("all"))
    share = F.when(F.col("all") > 0, F.col("kinds") / F.col("all"))
    return out.select(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("distinct"), F.round(F.coalesce(1 - share, F.lit(0.0)), 6).alias("repetition"))


def top_ngrams(df: DataFrame, items: str, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams, joined by blanks, ties by n-gram."""
    grams = df.select(F.explode(ngrams(F.col(items), n)).alias("g")).groupBy(F.array_join("g", " ").alias("ngram")).agg(F.count("*").alias("n"))
    return grams.orderBy(F.desc("n"), "ngram").limit(k)


def longest_run(df: DataFrame, key: str, items: str) -> DataFrame:
    """key, run: the longest run of one item, 0 for an empty array."""
    return df.select(key, run_length(F.col(items)).cast("bigint").alias("run"))


def intl_tokens(text: Column) -> Column:
    """Tokens of a text as the published BLEU tool's international tokenization has them: punctuation apart from what is
    no number, symbols apart from everything."""
    for pattern, to in ((r"(\P{N})(\p{P})", "$1 $2 "), (r"(\p{P})(\P{N})", " $1 $2"), (r"(\p{S})", " $1 ")):
        text = F.regexp_replace(text, pattern, to)
    return T.words(text)


def characters(text: Column) -> Column:
    """A text's characters, white space left out."""
    return F.filter(F.split(F.regexp_replace(text, T.WHITE, ""), ""), lambda x: x != "")


def chrf_words(text: Column) -> Column:
    """Words with one ASCII punctuation mark at the end, else at the beginning, as a token of its own."""
    mark = r"[!-/:-@\[-`{-~]"
    apart = F.transform(T.words(text), lambda w: F.when(F.length(w) == 1, F.array(w)).when(F.right(w, F.lit(1)).rlike(mark), F.array(F.substring(w, F.lit(1), F.length(w) - 1), F.right(w, F.lit(1)))).when(F.left(w, F.lit(1)).rlike(mark), F.array(F.left(w, F.lit(1)), F.substring(w, F.lit(2), F.length(w)))).otherwise(F.array(w)))
    return F.flatten(apart)


@F.arrow_udf(ArrayType(StructType([StructField("kind", IntegerType())] + [StructField(c, LongType()) for c in ("hyp", "ref", "matches", "answered")])))
def _shared(kinds: pa.Array, orders: pa.Array, hypotheses: pa.Array, references: pa.Array) -> pa.Array:
    """For each order up to the given one: n-grams of the hypothesis, of the reference, of both (clipped), and again of the
    hypothesis, 0 if the reference has none."""
    rows = []
    for kind, most, hypothesis, reference in zip(kinds.to_pylist(), orders.to_pylist(), hypotheses.to_pylist(), references.to_pylist(), strict=True):
        row = []
        for n in range(1, most + 1):
            h, r = (Counter(zip(*(items[k:] for k in range(n)), strict=False)) for items in (hypothesis or [], reference or []))
            row.append({"kind": kind + n, "hyp": h.total(), "ref": r.total(), "matches": (h & r).total(), "answered": h.total() if r else 0})
        rows.append(row)
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.int32()), ("hyp", pa.int64()), ("ref", pa.int64()), ("matches", pa.int64()), ("answered", pa.int64())])))


def clipped(df: DataFrame, hypothesis: Column, reference: Column, orders: int, *by: str, kind: int = 0) -> DataFrame:
    """by, kind (plus the order), matches, hyp, ref, answered: n-grams added up over the pairs of each group. A pair is counted in
    its row, so what is shuffled are sums."""
    found = F.explode(_shared(F.lit(kind), F.lit(orders), hypothesis, reference)).alias("x")
    return df.select(*by, found).select(*by, "x.*").groupBy(*by, "kind").agg(*(F.sum(c).alias(c) for c in ("matches", "hyp", "ref", "answered")))


def bleu(df: DataFrame, hypothesis: Column, reference: Column, *by: str) -> DataFrame:
    """by, bleu: corpus BLEU-4 in percent of token arrays with brevity penalty; without a match of some order the
    precision of that order is half of one in the next power of two (exponential smoothing), without n-grams of some
    order the score is 0."""
    orders = clipped(df, hypothesis, reference, 4, *by)
    at = lambda c, n: F.max(F.when(F.col("kind") == n, F.col(c)))
    wide = orders.groupBy(*by).agg(*(at(c, n).alias(f"{c}{n}") for c in ("matches", "hyp", "ref") for n in range(1, 5)))
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        none = F.col(f"matches{n}") == 0
        zeros = zeros + none.cast("int")
        logs = logs + F.log(F.when(none, 1 / F.pow(F.lit(2.0), zeros)).otherwise(F.col(f"matches{n}")) / F.col(f"hyp{n}"))
    any_ = F.col("matches1") + F.col("matches2") + F.col("matches3") + F.col("matches4")
    penalty = F.when(F.col("hyp1") >= F.col("ref1"), 1.0).otherwise(F.exp(1 - F.col("ref1") / F.col("hyp1")))
    return wide.select(*by, F.round(F.when((F.col("hyp4") > 0) & (any_ > 0), 100 * F.exp(logs / 4) * penalty).otherwise(0.0), 6).alias("bleu"))


def chrf(df: DataFrame, *by: str, most: int = 6, words: int = 2, beta: float = 2.0) -> DataFrame:
    """by, chrf: corpus chrF++ in percent: precision and recall are averaged over the character and word orders that both
    sides have, F-beta is taken of the averages. A pair without n-grams in the reference counts none of its own."""
    h, r = F.col("hypothesis"), F.col("reference")
    parts = [clipped(df, characters(h), characters(r), most, *by), clipped(df, chrf_words(h), chrf_words(r), words, *by, kind=100)]
    orders = parts[0].unionByName(parts[1]).where("answered > 0 and ref > 0")
    means = orders.groupBy(*by).agg(F.avg(F.col("matches") / F.col("answered")).alias("p"), F.avg(F.col("matches") / F.col("ref")).alias("r"))
    score = F.when(F.col("p") + F.col("r") > 0, (1 + beta**2) * F.col("p") * F.col("r") / (beta**2 * F.col("p") + F.col("r"))).otherwise(0.0)
    out = means.select(*by, F.round(100 * score, 6).alias("chrf"))
    return df.select(*by).distinct().join(out, list(by), "left").fillna(0.0, ["chrf"]) if by else df.agg(F.count("*").alias("_n")).join(out, how="left").select(F.coalesce("chrf", F.lit(0.0)).alias("chrf"))


def _longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: a set bit of row is a column whose length grows there."""
    places: dict[str, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for x in a:
        match = row & places.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(b) - row.bit_count()


@F.arrow_udf(StructType([StructField(c, DoubleType()) for c in ("p", "r", "f")]))
def rouge_l(hypothesis: pa.Array, reference: pa.Array) -> pa.Array:
    """Precision, recall and F1 of the longest common subsequence of white-space tokens; 0 where a side is null or empty."""
    rows = []
    for h, r in zip(hypothesis.to_pylist(), reference.to_pylist(), strict=True):
        a, b = (h or "").split(), (r or "").split()
        n = _longest_common(a, b) if a and b else 0
        rows.append((n / len(a), n / len(b), 2 * n / (len(a) + len(b))) if n else (0.0, 0.0, 0.0))
    return pa.StructArray.from_arrays([pa.array([x[i] for x in rows], pa.float64()) for i in range(3)], ["p", "r", "f"])


def generation_summary(df: DataFrame, setting: str) -> DataFrame:
    """For each setting of (setting, hypothesis, reference): n, bleu, chrf, mean ROUGE-L, distinct-1 and -2, repetition of
    4-grams, the longest run of one word, mean words. Words stand for ids; n-grams don't reach over a text's end."""
    rows = df.withColumn("_words", F.coalesce(T.words(F.col("hypothesis")), F.array().cast("array<string>")))
    plain = rows.groupBy(setting).agg(F.count("*").alias("n"), F.round(F.avg(rouge_l("hypothesis", "reference")["f"]), 6).alias("rouge_l"), F.round(F.avg(F.size("_words")), 6).alias("words"), F.max(run_length(F.col("_words"))).alias("max_run"))
    out = plain.join(bleu(df, intl_tokens(F.col("hypothesis")), intl_tokens(F.col("reference")), setting), setting).join(chrf(df, setting), setting)
    for n, name in ((1, "distinct_1"), (2, "distinct_2"), (4, "distinct_4")):
        grams = rows.select(setting, F.explode(ngrams(F.col("_words"), n)).alias("g")).groupBy(setting, "g").agg(F.count("*").alias("k"))
        out = out.join(grams.groupBy(setting).agg((F.count("*") / F.sum("k")).alias(name)), setting, "left")
    return out.select(setting, "n", "bleu", "chrf", "rouge_l", F.round(F.coalesce("distinct_1", F.lit(0.0)), 6).alias("distinct_1"), F.round(F.coalesce("distinct_2", F.lit(0.0)), 6).alias("distinct_2"), F.round(F.coalesce(1 - F.col("distinct_4"), F.lit(0.0)), 6).alias("repetition_4"), "max_run", "words")


def run_length(items: Column) -> Column:
    """The longest run of one item in an array, 0 for an empty one."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(state: Column, x: Column) -> Column:
        run = F.when(state["last"] == x, state["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    return F.aggregate(items.cast("array<string>"), start, step, lambda s: s["most"])


def answer_form(text: Column) -> Column:
    """Answers are compared in NFC with single blanks."""
    return T.norm_key(T.nfc(text))


def answer_scores(df: DataFrame) -> DataFrame:
    """df (gold, generated) with is_exact and is_prefix; a null or empty answer is neither."""
    gold, said = answer_form(F.col("gold")), answer_form(F.col("generated"))
    return df.withColumn("is_exact", F.coalesce((gold == said) & (gold != ""), F.lit(False))).withColumn("is_prefix", F.coalesce(F.startswith(said, gold) & (gold != ""), F.lit(False)))


def ranked(df: DataFrame, n_tokens: str | None = None) -> DataFrame:
    """df (candidates, logprobs) with best and best_normalized: the candidate of greatest total, and of greatest total a
    token (n_tokens: a column of the candidates' numbers of tokens; without one, a character); the first of equals. Null
    where scores or candidates are missing or of unlike number."""
    ok = F.size("candidates") == F.size("logprobs")
    pick = lambda score: F.get("candidates", F.array_position(score, F.array_max(score)).cast("int") - 1)
    size = (lambda i: F.get(n_tokens, i)) if n_tokens else (lambda i: F.length(F.get("candidates", i)))
    each = F.transform("logprobs", lambda s, i: s / F.greatest(size(i), F.lit(1)))
    return df.withColumn("best", F.when(ok, pick(F.col("logprobs")))).withColumn("best_normalized", F.when(ok, pick(each)))


def accuracy(df: DataFrame, *flags: str, by: str = "template") -> DataFrame:
    """Rows for all and for each value of `by`: n and the mean of each flag, null flags as false."""
    means = [F.round(F.avg(F.coalesce(F.col(f).cast("int"), F.lit(0))), 6).alias(f) for f in flags]
    return df.rollup(by).agg(F.count("*").alias("n"), *means)


def baselines(df: DataFrame) -> DataFrame:
    """One row of (candidates, answer, answer_position): expected share of guessing, of the best fixed position (of all
    rows and of those with one), of the most frequent answer."""
    one = df.agg(F.count("*").alias("n"), F.avg(1 / F.size("candidates")).alias("random"), F.count_if(F.col("answer_position") >= 0).alias("scored"))
    place = df.where("answer_position >= 0").groupBy("answer_position").agg(F.count("*").alias("k")).agg(F.max("k").alias("best"))
    answer = df.groupBy("answer").agg(F.count("*").alias("k")).agg(F.max("k").alias("often"))
    out = one.crossJoin(place).crossJoin(answer)  # one row each
    return out.select(F.round("random", 6).alias("random"), F.round(F.col("best") / F.col("n"), 6).alias("position_of_all"), F.round(F.col("best") / F.col("scored"), 6).alias("position_of_scored"), F.round(F.col("often") / F.col("n"), 6).alias("majority"))


def attention_heads(cells: DataFrame) -> DataFrame:
    """layer, head and six statistics of attention weights (seq, layer, head, t, j, w): entropy and its share of the
    greatest, distance and its share, weight on the previous token and on the first; means over rows, then sequences."""
    rows = cells.groupBy("seq", "layer", "head", "t").agg(
        F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log("w")).otherwise(0.0)).alias("entropy"),
        F.sum(F.col("w") * (F.col("t") - F.col("j"))).alias("distance"),
        F.sum(F.when(F.col("j") == F.col("t") - 1, F.col("w")).otherwise(0.0)).alias("previous"),
        F.sum(F.when(F.col("j") == 0, F.col("w")).otherwise(0.0)).alias("sink"),
    )
    later = F.col("t") >= 1
    one = rows.groupBy("seq", "layer", "head").agg(
        F.avg("entropy").alias("entropy"),
        F.avg(F.when(later, F.col("entropy") / F.log(F.col("t") + 1))).alias("normalized_entropy"),
        F.avg("distance").alias("mean_distance"),
        F.avg(F.when(later, F.col("distance") / F.col("t"))).alias("normalized_distance"),
        F.avg(F.when(later, F.col("previous"))).alias("previous_token_rate"),
        F.avg(F.when(later, F.col("sink"))).alias("sink_rate"),
    )
    names = ("entropy", "normalized_entropy", "mean_distance", "normalized_distance", "previous_token_rate", "sink_rate")
    return one.groupBy("layer", "head").agg(*(F.round(F.avg(c), 6).alias(c) for c in names))


# Limits of the classes of heads.
SINK, NEAR, PREVIOUS, SPREAD = 0.3, 0.15, 0.3, 0.4


def head_class() -> Column:
    """sink before local/positional before content-based before mixed."""
    local = (F.col("normalized_distance") < NEAR) & (F.col("previous_token_rate") > PREVIOUS)
    return F.when(F.col("sink_rate") > SINK, "sink").when(local, "local/positional").when(F.col("normalized_entropy") > SPREAD, "content-based").otherwise("mixed")


def exact_mean(column: str) -> Column:
    """The mean at six places, half up, the same in any order of the rows: values are added up as decimals, where a sum of
    doubles may fall short of a half. Of doubles where a value is no such decimal (NaN, infinite, 1e10 and more)."""
    value = F.col(column).try_cast("decimal(28,18)")
    return F.when(F.count(value) == F.count(column), F.round(F.avg(value), 6).cast("double")).otherwise(F.round(F.avg(column), 6))


def layer_means(heads: DataFrame, *columns: str) -> DataFrame:
    """layer (null: overall) and the means of the columns; those of rounded values often lie half way between two places."""
    return heads.rollup("layer").agg(*(exact_mean(c).alias(c) for c in columns))


def deltas(before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    """layer, head and after - before of each column."""
    joined = before.alias("x").join(after.alias("y"), ["layer", "head"])
    return joined.select("layer", "head", *(F.round(F.col(f"y.{c}") - F.col(f"x.{c}"), 6).alias(c) for c in columns))


def largest_change(delta: DataFrame, column: str) -> DataFrame:
    """The head with the greatest absolute change, the first of equals."""
    return delta.orderBy(F.desc(F.abs(column)), "layer", "head").limit(1).select("layer", "head", column)


def teacher_forced(df: DataFrame) -> DataFrame:
    """One row of (targets, predictions): share of supervised places (target not ignored) that are predicted."""
    pairs = df.select(F.explode(F.arrays_zip("targets", "predictions")).alias("p")).where(F.col("p.targets") != -100)
    return pairs.agg(F.count("*").alias("supervised"), F.round(F.avg((F.col("p.targets") == F.col("p.predictions")).cast("int")), 6).alias("accuracy"))


def resumed(log: DataFrame, step: int, new: DataFrame) -> DataFrame:
    """A log's rows before the step, and the new ones."""
    return log.where(F.col("step") < step).unionByName(new)


def learning_rates(spark: SparkSession, steps: int, warmup: int, peak: float, least: float) -> DataFrame:
    """step, lr: linear warm-up, then a cosine down to the least."""
    share = (F.col("step") - warmup) / max(1, steps - warmup)
    rate = F.when(F.col("step") < warmup, peak * (F.col("step") + 1) / max(1, warmup)).otherwise(least + 0.5 * (1 + F.cos(F.lit(math.pi) * F.least(share, F.lit(1.0)))) * (peak - least))
    return spark.range(steps).select(F.col("id").alias("step"), F.round(rate, 9).alias("lr"))


def parameters(spark: SparkSession, configs: list[tuple]) -> DataFrame:
    """name and parameter counts of decoder configurations (name, vocabulary, width, feed-forward width, layers, context,
    whether attention has biases, whether positions are learned, whether the output shares the embedding)."""
    rows = spark.createDataFrame(configs, "name string, vocab bigint, width bigint, inner bigint, layers bigint, context bigint, bias boolean, learned boolean, tied boolean")
    d, table = F.col("width"), F.col("vocab") * F.col("width")
    attention = 4 * d * d + F.when(F.col("bias"), 4 * d).otherwise(0)
    block = attention + 2 * d * F.col("inner") + F.col("inner") + d + 4 * d
    positions = F.when(F.col("learned"), F.col("context") * d).otherwise(0)
    head = F.when(F.col("tied"), 0).otherwise(table)
    out = rows.select("name", table.alias("embedding"), positions.alias("positions"), (block * F.col("layers")).alias("blocks"), (2 * d).alias("norm"), head.alias("head"))
    return out.withColumn("total", F.col("embedding") + F.col("positions") + F.col("blocks") + F.col("norm") + F.col("head"))


def throughput(steps: DataFrame, tokens: int, planned: int, warmup: int = 5) -> DataFrame:
    """One row of (step, seconds, loss): steps timed, those after the warm-up ones in order of step; seconds a step, tokens
    a second, mean loss, projected hours of the planned steps."""
    timed = steps.crossJoin(F.broadcast(steps.agg(F.min("step").alias("_first")))).where(F.col("step") >= F.col("_first") + warmup)  # one row
    out = timed.agg(F.count("*").alias("steps_timed"), F.avg("seconds").alias("each"), F.avg("loss").alias("loss"))
    return out.select("steps_timed", F.round("each", 6).alias("seconds_per_step"), F.round(tokens / F.col("each"), 4).alias("tokens_per_second"), F.round("loss", 6).alias("mean_loss"), F.round(F.col("each") * planned / 3600, 6).alias("projected_hours"))


def short_sequences(df: DataFrame, ids: str, n: int, longest: int = 64) -> DataFrame:
    """The first n rows in order of pos whose ids are at most `longest`: the limit is the feature."""
    return df.where(F.size(ids) <= longest).orderBy("pos").limit(n)

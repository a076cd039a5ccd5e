"""Sentences, vocabularies, windows and batches of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.functions.hashing import found, word_hashes
from sarit.operators.ngram import running_total
from sarit.plans.arrow import map_text, ragged
from sarit.plans.scale import cut

# What ends a sentence, and the largest piece in bytes.
SENTENCE_END = r"(?<=[।॥?!])[\t-\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+"
MAX_BYTES = 4192
UNKNOWN, END = 1, 3
#: Most words of a vocabulary that go to every executor, by 12 bytes each.
MOST_WORDS = 2_000_000


def sentences(text: Column) -> Column:
    """The pieces of a text after each end mark and white space, trimmed, none empty."""
    trimmed = F.transform(F.split(text, SENTENCE_END), T.strip)
    return F.filter(trimmed, lambda s: s != "")


def packed(text: Column, most: int = MAX_BYTES) -> Column:
    """Sentences of at most `most` bytes; longer ones as greedily packed words, each counted with a blank."""

    def pack(sentence: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("piece"), F.lit(0).alias("size"))

        def add(state: Column, word: Column) -> Column:
            size = F.octet_length(word) + 1
            full = (state["piece"] != "") & (state["size"] + size > most)
            piece = F.when(full | (state["piece"] == ""), word).otherwise(F.concat(state["piece"], F.lit(" "), word))
            return F.struct(F.when(full, F.array_append(state["done"], state["piece"])).otherwise(state["done"]).alias("done"), piece.alias("piece"), F.when(full, size).otherwise(state["size"] + size).alias("size"))

        return F.aggregate(T.words(sentence), start, add, lambda s: F.when(s["piece"] == "", s["done"]).otherwise(F.array_append(s["done"], s["piece"])))

    return F.flatten(F.transform(sentences(text), lambda s: F.when(F.octet_length(s) <= most, F.array(s)).otherwise(pack(s))))


def first_sentence(df: DataFrame, least: int = 8, most: int = 22) -> DataFrame:
    """pos, sentence: the first of so many words in the table, else the first words of its first text."""
    found = df.select("pos", F.posexplode(sentences(F.col("text"))).alias("i", "sentence")).where(T.n_words(F.col("sentence")).between(least, most))
    best = found.agg(F.min_by(F.struct("pos", "sentence"), F.struct("pos", "i")).alias("best"))
    head = df.where(T.n_words(F.col("text")) > 0).agg(F.min_by(F.struct("pos", F.array_join(F.slice(T.words(F.col("text")), 1, most), " ").alias("sentence")), "pos").alias("head"))
    return best.crossJoin(head).select(F.coalesce("best", "head").alias("x")).select("x.pos", "x.sentence")  # one row each


def examples(df: DataFrame, n: int = 5, least: int = 40, most: int = 180) -> DataFrame:
    """pos, sentence: the first sentence of fitting length of each text, of the first n texts that have one."""
    fit = F.filter(sentences(F.col("text")), lambda s: F.length(s).between(least, most))
    return df.select("pos", F.get(fit, F.lit(0)).alias("sentence")).where("sentence is not null").orderBy("pos").limit(n)


def vocabulary(df: DataFrame, reserved: int = 4) -> DataFrame:
    """word, n, token: dense ids by falling frequency, ties by word, after the reserved ones.

    Ids come from counts of each frequency and ranks within one, not from one global sort: a window holds the words of
    one frequency with the same beginning, and the starts are a table of (frequency, beginning)."""
    counts = cut(df.select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    celled = counts.withColumn("cell", F.substring(F.hex(F.encode("word", "utf-8")), 1, 6))
    cells = celled.groupBy("n", "cell").agg(F.count("*").alias("size"))
    by_n = cells.groupBy("n").agg(F.sum("size").alias("all"))
    start = by_n.select("n", F.coalesce(F.sum("all").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = cells.select("n", "cell", F.coalesce(F.sum("size").over(Window.partitionBy("n").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("n", "cell").orderBy("word"))
    out = celled.withColumn("rank", rank).join(inside, ["n", "cell"]).join(start, "n")
    return out.select("word", "n", (F.col("start") + F.col("offset") + F.col("rank") - 1 + reserved).cast("int").alias("token"))


def encode_words(df: DataFrame, vocab: DataFrame, end: int | None = END, most: int = MOST_WORDS) -> DataFrame:
    """pos, ids: the words' ids in order, with the end mark; words that the vocabulary lacks are unknown.

    Words are looked up by 64-bit hash where the text is: the `most` words of least id, which are the most frequent, go to
    the executors. Of a larger vocabulary the rest, rare by then, is joined by hash, and only ids are moved."""
    rows = vocab.select("word", "token")
    head = first_tokens(rows, most).toArrow()  # at most `most` rows
    hashes, _ = word_hashes(head.column("word").to_pylist(), lower=False)
    order = np.argsort(hashes)
    complete = rows.limit(most + 1).count() <= most
    shared = df.sparkSession.sparkContext.broadcast((hashes[order], np.asarray(head.column("token")).astype(np.int32)[order]))
    unknown = UNKNOWN if complete else -1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, token = shared.value
        words, sizes = word_hashes(batch.column("text").fill_null("").to_pylist(), lower=False)
        at, there = found(known, words)
        ids = np.where(there, token[at] if len(token) else unknown, unknown).astype(np.int32)
        columns = [batch.column("pos"), ragged(ids, sizes, pa.int32())]
        if complete:
            return pa.RecordBatch.from_arrays(columns, ["pos", "ids"])
        row = np.repeat(np.arange(len(sizes)), sizes)
        open_ = np.flatnonzero(~there)
        place = open_ - (np.cumsum(sizes) - sizes)[row[open_]]
        n = np.bincount(row[open_], minlength=len(sizes))
        return pa.RecordBatch.from_arrays([*columns, ragged(place, n, pa.int64()), ragged(words[open_].view(np.int64), n, pa.int64())], ["pos", "ids", "places", "words"])

    texts = df.select("pos", "text")
    if complete:
        out = map_text(texts, run, "pos bigint, ids array<int>")
    else:
        coded = cut(map_text(texts, run, "pos bigint, ids array<int>, places array<bigint>, words array<bigint>"))
        rest = map_text(rows.where(F.col("token") >= F.lit(int(np.asarray(head.column("token")).max()) + 1)), _hashed, "word bigint, token int", column="word")
        later = coded.select("pos", F.explode(F.arrays_zip("places", "words")).alias("x")).select("pos", F.col("x.places").alias("place"), F.col("x.words").alias("word")).join(rest, "word")
        later = later.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct(F.col("place").cast("int"), "token"))).alias("later"))
        ids = F.transform("ids", lambda x, i: F.when(x >= 0, x).otherwise(F.coalesce(F.element_at("later", i), F.lit(UNKNOWN))))
        out = coded.select("pos", "ids").join(later, "pos", "left").select("pos", ids.alias("ids"))
    return out.select("pos", F.array_append("ids", F.lit(end)).alias("ids") if end is not None else "ids")


def first_tokens(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the `most` least ids; ids are dense but for the reserved ones, so a filter tells them."""
    low = rows.agg(F.min("token")).first()[0]
    return rows.where(F.col("token") < (0 if low is None else low) + most)


def _hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, _ = word_hashes(batch.column("word").to_pylist(), lower=False)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("token").cast(pa.int32())], ["word", "token"])


def token_frequency(tokens: DataFrame, size: DataFrame) -> DataFrame:
    """token, n for every id of the vocabulary's range (column token of `size`), 0 for ids that don't occur."""
    counts = tokens.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return size.select("token").join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def frequency_summary(frequency: DataFrame, top: int = 1000) -> DataFrame:
    """One row: tokens, ids used, unused, used once, and the share of tokens that the most frequent ids cover."""
    head = frequency.orderBy(F.desc("n"), "token").limit(top).agg(F.sum("n").alias("covered"))
    out = frequency.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("used"), F.count_if(F.col("n") == 0).alias("unused"), F.count_if(F.col("n") == 1).alias("once")).crossJoin(head)  # one row each
    return out.select("tokens", "used", "unused", "once", F.round(F.col("covered") / F.col("tokens"), 6).alias("top_share"))


def top_tokens(frequency: DataFrame, pieces: DataFrame, n: int = 20) -> DataFrame:
    """token, piece, n of the most frequent tokens, ties by id; the limit is the feature."""
    best = frequency.where("n > 0").orderBy(F.desc("n"), "token").limit(n)
    return pieces.join(F.broadcast(best), "token").select("token", "piece", "n")  # n rows


def piece_counts(pieces: DataFrame, by: str, least: int) -> DataFrame:
    """by, tokens, unknown (tokens of pieces rarer than `least`) and vocab_size of counted pieces (by, piece, n)."""
    return pieces.groupBy(by).agg(F.sum("n").alias("tokens"), F.coalesce(F.sum(F.when(F.col("n") < least, F.col("n"))), F.lit(0)).alias("unknown"), F.count_if(F.col("n") >= least).alias("vocab_size"))


def sweep(counts: DataFrame, *vocab: str) -> DataFrame:
    """For each vocabulary of (tokens, words, chars, unknown): tokens, tokens a word (fertility), share of unknown tokens,
    characters a token."""
    return counts.select(*vocab, "tokens", F.round(F.col("tokens") / F.col("words"), 6).alias("fertility"), F.round(F.col("unknown") / F.col("tokens"), 6).alias("unknown_share"), F.round(F.col("chars") / F.col("tokens"), 6).alias("chars_per_token"))


def chopped(words: Column, longest: Column) -> Column:
    """The pieces of at most `longest` characters that words are cut into, from their beginnings on."""
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / longest)), lambda i: F.substring(w, (i * longest + 1).cast("int"), longest.cast("int")))))


def vocabulary_choice(sizes: DataFrame, least: int = 16_000, tolerance: float = 0.05) -> DataFrame:
    """The smallest size of at least `least` whose fertility is within the tolerance of the best of all sizes; without one
    the smallest of at least `least`, without such the smallest. sizes: vocab_size, fertility, a row for each vocabulary."""
    known = sizes.crossJoin(F.broadcast(sizes.agg(F.min("fertility").alias("_best"))))  # one row
    big = F.col("vocab_size") >= least
    smallest = lambda which: F.min(F.when(which, F.col("vocab_size")))
    return known.agg(F.coalesce(smallest(big & (F.col("fertility") <= F.col("_best") * (1 + tolerance))), smallest(big), F.min("vocab_size")).alias("vocab_size"))


def token_shares(tokens: DataFrame, gate: float = 0.20) -> DataFrame:
    """split, tokens, manual tokens, unknown share, manual share and whether it reaches the gate."""
    size = F.size("ids")
    out = tokens.groupBy("split").agg(F.sum(size).alias("tokens"), F.coalesce(F.sum(F.when(F.col("manual"), size)), F.lit(0)).alias("manual_tokens"), F.sum(F.size(F.filter("ids", lambda x: x == UNKNOWN))).alias("unknown"))
    share = F.round(F.col("manual_tokens") / F.col("tokens"), 6)
    return out.select("split", "tokens", "manual_tokens", F.round(F.col("unknown") / F.col("tokens"), 6).alias("unknown_share"), share.alias("manual_share"), (share >= gate).alias("reached"))


def digit_audit(frequency: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row: ASCII and Devanagari digits of a token stream, from the pieces' (token, piece) digits times how often each
    token occurs (token, n), and the script that most digits are in."""
    weighted = frequency.join(pieces.where(F.col("piece").rlike("[0-9०-९]")), "token")
    ascii_, own = (F.coalesce(F.sum(F.length(F.regexp_replace("piece", f"[^{c}]", "")).cast("bigint") * F.col("n")), F.lit(0)) for c in ("0-9", "०-९"))
    return weighted.agg(ascii_.alias("ascii_digits"), own.alias("devanagari_digits")).withColumn("script", F.when(F.col("devanagari_digits") > F.col("ascii_digits"), "devanagari").otherwise("ascii"))


def windows(tokens: DataFrame, size: int) -> DataFrame:
    """window, x, y of the whole token stream in order of pos: x of `size` tokens, y one further, the rest dropped.

    A row is cut into the pieces that lie in each window (and in the one token after it), and only pieces are moved."""
    sized = running_total(tokens.withColumn("_n", F.size("ids").cast("bigint")), "pos", "_n").where("_n > 0")
    total = tokens.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("_all"))  # one row
    end = F.col("before") + F.col("_n")
    first = F.greatest(F.lit(0), F.floor((F.col("before") - 1) / size))  # its token after the end may be the row's first
    pieces = sized.select("before", "_n", "ids", F.explode(F.sequence(first, F.floor((end - 1) / size))).alias("window"))
    start = F.greatest("before", F.col("window") * size)
    stop = F.least(end, (F.col("window") + 1) * size + 1)
    piece = F.slice("ids", (start - F.col("before") + 1).cast("int"), (stop - start).cast("int"))
    pieces = pieces.crossJoin(F.broadcast(total)).where((stop > start) & (F.col("window") < F.floor((F.col("_all") - 1) / size))).select("window", F.struct(start.alias("at"), piece.alias("ids")).alias("piece"))
    whole = pieces.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["ids"])).alias("ids"))
    return whole.select("window", F.slice("ids", 1, size).alias("x"), F.slice("ids", 2, size).alias("y"))


def epoch_order(items: DataFrame, key: str, seed: int, epoch: int) -> Column:
    """The place of an item in an epoch's permutation is that of this hash; nothing is stored, everything derived."""
    return F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(key).cast("string")))


def batches(items: DataFrame, key: str, size: int, seed: int = 1337, epoch: int = 0, keep_rest: bool = False, skip: int = 0) -> DataFrame:
    """items with batch and slot: the permutation of an epoch in batches, from batch `skip` on (resuming).

    Ranks come from 4096 ranges of the hash and ranks within one. An incomplete last batch is dropped unless kept."""
    hashed = items.withColumn("_h", epoch_order(items, key, seed, epoch)).withColumn("_cell", F.substring("_h", 1, 3))
    cells = hashed.groupBy("_cell").agg(F.count("*").alias("_n"))
    start = cells.select("_cell", F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", key)) - 1
    out = hashed.withColumn("_rank", rank).join(F.broadcast(start), "_cell").withColumn("_rank", F.col("_rank") + F.col("_start"))
    out = out.withColumn("batch", F.floor(F.col("_rank") / size)).withColumn("slot", F.pmod("_rank", F.lit(size)).cast("int"))
    whole = F.lit(True) if keep_rest else F.col("batch") < F.floor(F.col("_all") / size)
    return out.where(whole & (F.col("batch") >= skip)).drop("_h", "_cell", "_start", "_all", "_rank")


def prefix_reference(tokens: DataFrame, prefix: int = 64, reference: int = 64) -> DataFrame:
    """pos, prefix, reference of rows with enough tokens for both."""
    return tokens.where(F.size("ids") >= prefix + reference).select("pos", F.slice("ids", 1, prefix).alias("prefix"), F.slice("ids", prefix + 1, reference).alias("reference"))


def scoring_windows(tokens: DataFrame, context: int = 512, stride: int = 256) -> DataFrame:
    """pos, start, ids, first: windows in strides; tokens from `first` (0-based in the window) on are scored there, each
    token of a text exactly once."""
    n = F.size("ids")
    starts = F.when(n <= context, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - context) / stride) * stride).cast("int"), F.lit(stride)))
    rows = tokens.where(n > 0).select("pos", "ids", F.explode(starts).alias("start"))
    return rows.select("pos", "start", F.slice("ids", F.col("start") + 1, context).alias("window"), F.when(F.col("start") == 0, 0).otherwise(context - stride).alias("first"))

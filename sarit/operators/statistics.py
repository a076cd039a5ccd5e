"""Counts of corpora and reports on them: by source, by provenance, by stage, and plans for mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.operators.ngram import running_total

#: Tokens for a word, the low and the high projection.
FERTILITY = (1.4, 2.2)


def sums(text: Column) -> list[Column]:
    """docs, chars, words; a null text is a document without either."""
    return [F.count("*").alias("docs"), F.coalesce(F.sum(F.length(text).cast("bigint")), F.lit(0)).alias("chars"), F.coalesce(F.sum(T.n_words(text)), F.lit(0)).alias("words")]


def by_source(df: DataFrame) -> DataFrame:
    """source, docs, chars, words, largest first."""
    return df.groupBy("source").agg(*sums(F.col("text"))).orderBy(F.desc("words"), "source")


def by_source_once(df: DataFrame) -> DataFrame:
    """by_source() of the first of documents with the same normal form: texts are measured first, and what is compared
    and moved are hashes and numbers."""
    text = F.col("text")
    rows = df.where("text is not null").select("pos", "source", F.md5(T.norm_key(text)).alias("_key"), F.length(text).cast("bigint").alias("chars"), T.n_words(text).alias("words"))
    first = rows.groupBy("_key").agg(F.min_by(F.struct("source", "chars", "words"), "pos").alias("x")).select("x.*")
    return first.groupBy("source").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).orderBy(F.desc("words"), "source")


def with_total(df: DataFrame) -> DataFrame:
    """The same with a row of the total, whose source is null."""
    return df.rollup("source").agg(*sums(F.col("text")))


def token_counts(df: DataFrame) -> DataFrame:
    """source, docs, chars, words, pre-tokens, and the averages a document and a word."""
    text = F.col("text")
    pre = F.coalesce(F.sum(T.n_pre_tokens(text)), F.lit(0)).alias("pretokens")
    out = df.groupBy("source").agg(*sums(text), pre)
    return out.withColumns({"words_per_doc": F.round(F.col("words") / F.col("docs"), 6), "chars_per_word": F.when(F.col("words") > 0, F.round(F.col("chars") / F.col("words"), 6))})


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """by, docs, chars, words of stored partial counts, added up."""
    return parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("docs", "chars", "words")))


def scaled(counts: DataFrame, factor: float) -> DataFrame:
    """Counts times a factor, rounded."""
    return counts.withColumns({c: F.round(F.col(c) * factor).cast("bigint") for c in ("docs", "chars", "words")})


def probed(df: DataFrame, line: Column, probes: int, order: str = "pos") -> DataFrame:
    """One row: docs, chars, words estimated from evenly spaced byte probes: rows stand as lines in order; a probe falls on
    a byte, the line after the one it falls into is read, and totals are scaled by all bytes over those read."""
    sized = running_total(df.withColumn("_bytes", F.octet_length(line).cast("bigint") + 1), order, "_bytes")
    total = sized.agg(F.sum("_bytes").alias("_all"))  # one row
    celled = sized.crossJoin(F.broadcast(total))
    upto = lambda at: F.ceil(at * probes / F.col("_all"))
    hits = celled.withColumn("_hits", upto(F.col("before") + F.col("_bytes")) - upto(F.col("before"))).where("_hits > 0").select(order, "_hits")
    starts = sized.select(order, "before", "_bytes", "text")
    # the line after a hit one begins where that ends
    ends = hits.join(starts.select(order, (F.col("before") + F.col("_bytes")).alias("_end")), order).select("_end", "_hits")
    read = starts.join(ends, starts["before"] == ends["_end"])
    out = read.agg(F.coalesce(F.sum("_hits"), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.length("text") * F.col("_hits")), F.lit(0)).alias("chars"), F.coalesce(F.sum(T.n_words(F.col("text")) * F.col("_hits")), F.lit(0)).alias("words"), F.sum(F.col("_bytes") * F.col("_hits")).alias("_read"))
    factor = F.coalesce(F.col("_all") / F.col("_read"), F.lit(1.0))
    return out.crossJoin(total).select(F.col("docs").alias("probes"), *(F.round(F.col(c) * factor).cast("bigint").alias(f"{c}_estimated") for c in ("docs", "chars", "words")))


def report(tables: dict[str, DataFrame], most: int = 1000) -> str:
    """Small tables of results as a Markdown text, a section for each; of a longer one the first `most` rows, with a note."""
    out = []
    for title, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:most]]
        out += ["", f"More than {most} rows." if len(rows) > most else "", ""]
    return "\n".join(out)


def mix_plan(df: DataFrame, shares: tuple[float, ...] = (0.20, 0.25, 0.30)) -> DataFrame:
    """For each target share of manual words: downloaded words to keep, the sampling ratio, the share reached.

    Keeping m (1 - f) / f of the downloaded words makes m manual words the share f, if there are as many."""
    one = df.agg(F.coalesce(F.sum(F.when(F.col("manual"), T.n_words(F.col("text")))), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(~F.col("manual"), T.n_words(F.col("text")))), F.lit(0)).alias("d"))
    out = one.select("m", "d", F.explode(F.array(*map(F.lit, shares))).alias("target"))
    wanted = F.col("m") * (1 - F.col("target")) / F.col("target")
    out = out.withColumn("wanted", wanted).withColumn("keep", F.least("wanted", F.col("d").cast("double")))
    total = F.col("m") + F.col("keep")
    return out.select(
        "target",
        F.round("keep").cast("bigint").alias("keep_words"),
        F.when(F.col("d") > 0, F.round(F.col("keep") / F.col("d"), 4)).otherwise(0.0).alias("sample_ratio"),
        F.when(total > 0, F.round(F.col("m") / total, 4)).otherwise(0.0).alias("share_reached"),
        (F.col("wanted") > F.col("d")).alias("limited"),
        F.round(total * FERTILITY[0]).cast("bigint").alias("tokens_low"),
        F.round(total * FERTILITY[1]).cast("bigint").alias("tokens_high"),
    )


def retention(before: DataFrame, after: DataFrame, target_tokens: int) -> DataFrame:
    """Documents and words before and after, the share kept, projected tokens and whether these reach the target."""
    a = before.agg(*(c.alias(f"{n}_before") for c, n in zip(sums(F.col("text")), ("docs", "chars", "words"), strict=True)))
    b = after.agg(*(c.alias(f"{n}_after") for c, n in zip(sums(F.col("text")), ("docs", "chars", "words"), strict=True)))
    out = a.crossJoin(b)  # one row each
    low, high = (F.round(F.col("words_after") * f) for f in FERTILITY)
    verdict = F.when(low >= target_tokens, "PASS").when(high >= target_tokens, "BORDERLINE").otherwise("FAIL")
    share = F.when(F.col("docs_before") > 0, F.round(100 * F.col("docs_after") / F.col("docs_before"), 4))
    return out.select("docs_before", "docs_after", "words_before", "words_after", share.alias("docs_percent"), low.cast("bigint").alias("tokens_low"), high.cast("bigint").alias("tokens_high"), verdict.alias("verdict"))


def combine_report(df: DataFrame, registry: DataFrame) -> DataFrame:
    """source, category (uncategorised if the registry has none), docs, words and the share of all documents."""
    known = registry.where("site is not null").groupBy(F.col("site").alias("source")).agg(F.min("category").alias("category"))
    out = df.groupBy("source").agg(F.count("*").alias("docs"), F.coalesce(F.sum(T.n_words(F.col("text"))), F.lit(0)).alias("words"))
    total = out.agg(F.sum("docs").alias("_all"))  # one row
    return out.crossJoin(F.broadcast(total)).join(known, "source", "left").select("source", F.coalesce("category", F.lit("uncategorised")).alias("category"), "docs", "words", F.round(F.col("docs") / F.col("_all"), 4).alias("doc_share"))


def without_documents(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Sites of the registry from which there is no document."""
    return registry.select(F.col("site").alias("source")).where("source is not null").distinct().join(df.select("source"), "source", "left_anti")


def combine_reason(wanted: tuple[str, ...]) -> Column:
    """Why a merged record is dropped before ids are compared, in order: malformed JSON (a column malformed, if it is
    known), empty text, another language, not manual."""
    language = F.lower(F.trim("lang"))
    return F.when(F.col("text").isNull() | (F.trim(F.regexp_replace("text", T.WHITE, " ")) == ""), "empty_text").when(F.coalesce(~language.isin(*wanted), F.lit(True)), "wrong_language").when(~F.col("manual"), "not_manual")


def combine_reasons(df: DataFrame, wanted: tuple[str, ...], key: Column) -> DataFrame:
    """df (pos, text, lang, manual, and malformed if known) with reason, null for what stays: combine_reason(), and last
    duplicate_doc_id for all but the first of those left with the same key. A row without a key has no duplicates."""
    first = F.when(F.col("malformed"), "malformed_json") if "malformed" in df.columns else F.lit(None).cast("string")
    known = df.withColumn("reason", F.coalesce(first, combine_reason(wanted))).withColumn("_key", F.when(F.col("reason").isNull(), key))
    keys = known.where("_key is not null").groupBy("_key").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = known.select("pos", "_key").join(keys, "_key").where("pos > _first").select("pos", F.lit("duplicate_doc_id").alias("_again"))
    return known.drop("_key").join(again, "pos", "left").withColumn("reason", F.coalesce("reason", "_again")).drop("_again")


def split_pivot(df: DataFrame) -> DataFrame:
    """split, docs, words, manual words and their share."""
    manual = F.coalesce(F.sum(F.when(F.col("manual"), T.n_words(F.col("text")))), F.lit(0))
    out = df.groupBy("split").agg(F.count("*").alias("docs"), F.coalesce(F.sum(T.n_words(F.col("text"))), F.lit(0)).alias("words"), manual.alias("manual_words"))
    return out.withColumn("manual_share", F.when(F.col("words") > 0, F.round(F.col("manual_words") / F.col("words"), 6)).otherwise(0.0))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, docs, words of tables, in one job."""
    out = None
    for name, df in stages.items():
        row = df.agg(*sums(F.col("text"))).select(F.lit(name).alias("stage"), "docs", "words")
        out = row if out is None else out.unionAll(row)
    return out


def extrapolated(df: DataFrame, step: int, order: str = "pos") -> DataFrame:
    """docs, chars, words estimated from every step-th document, scaled by step: the evenly spaced probe."""
    probe = df.where(F.pmod(F.col(order), F.lit(step)) == 0)
    return probe.agg(*sums(F.col("text"))).select(*((F.col(c) * step).alias(f"{c}_estimated") for c in ("docs", "chars", "words")))

"""Queries on documents, the registry, the frontier and splits, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.operators import cleaning, frontier, lid, near_dedup, ngram, sampling, statistics
from sarit.operators.quantiles import quantiles
from sarit.plans import scale
from sarit.plans.scale import cut, posix_folder, shared_folder, spread, table
from sarit.sources import html, jsonl
from sarit.sources.documents import documents, fold_hosts, kept_and_dropped, not_empty
from sarit.sources.jsonl import pulled

QUERIES: dict = {}
ORACLE: dict = {}

W = T.WHITE
DOCS = "d AS (SELECT doc_id AS pos, text, coalesce(source, 'unknown') AS source, coalesce(manual, source_type = 'manual', false) AS manual, lang FROM documents)"
FOLDED = f"{DOCS}, f AS (SELECT pos, text, coalesce(r.site, d.source) AS source, manual, lang FROM d LEFT JOIN (SELECT host, min(site) AS site FROM registry WHERE host IS NOT NULL GROUP BY host) r ON d.source = r.host)"
WORDS = f"len(list_filter(regexp_split_to_array(text, '{W}+'), lambda w: w <> ''))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
KEY = f"trim(regexp_replace(text, '{W}+', ' ', 'g'))"
VISIBLE = f"length(regexp_replace(text, '{W}', '', 'g'))"
RATIO = f"CASE WHEN {VISIBLE} > 0 THEN ({VISIBLE} - length(regexp_replace(regexp_replace(text, '{W}', '', 'g'), '[ऀ-ॿ]', '', 'g'))) / {VISIBLE} ELSE 0.0 END"
TERMINAL = f"CASE WHEN len({LINES}) > 0 THEN len(list_filter({LINES}, lambda x: regexp_matches(x, '[।॥?!]$'))) / len({LINES}) ELSE 0.0 END"
REPEATED = f"CASE WHEN len({LINES}) > 0 THEN (len({LINES}) - len(list_filter(list_distinct({LINES}), lambda x: len(list_filter({LINES}, lambda y: y = x)) = 1))) / len({LINES}) ELSE 0.0 END"
BINARY = "(contains(text, 'JFIF') OR contains(text, 'Exif') OR contains(text, '%PDF') OR contains(text, 'Photoshop'))"
# By the bounds of manual and of downloaded sources.
REASON = f"CASE WHEN {BINARY} THEN 'binary_payload' WHEN coalesce({WORDS}, 0) < CASE WHEN manual THEN 10 ELSE 30 END THEN 'too_short' WHEN {WORDS} > 100000 THEN 'too_long' WHEN {RATIO} < CASE WHEN manual THEN 0.70 ELSE 0.75 END THEN 'low_script_ratio' WHEN {TERMINAL} < 0.0 THEN 'low_terminal_punct' WHEN {REPEATED} > CASE WHEN manual THEN 0.30 ELSE 0.25 END THEN 'repetitive_lines' END"
SUMS = f"count(*) AS docs, coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(sum({WORDS}), 0)::BIGINT AS words"
HASH = "(concat('0x', substr(md5(concat('{}:1337:', text)), 1, 15))::BIGINT / pow(2, 60))"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE[key] = sql
        return function

    return add


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", "doc_id", "text"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir)


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_hosts(documents(spark, sf_dir), table(spark, sf_dir, "registry", "site", "host"))


@query(f"WITH {FOLDED}, q AS (SELECT * FROM f WHERE text IS NOT NULL AND {REASON} IS NULL), e AS (SELECT *, row_number() OVER (PARTITION BY md5({KEY}) ORDER BY pos) AS rn FROM q) SELECT source, {SUMS} FROM e WHERE rn = 1 GROUP BY source")
def flagship(spark, d):
    """Documents, characters and words by source after quality filter and exact dedup."""
    good = cleaning.with_reason_by_origin(folded(spark, d).where("text is not null")).where("reason is null")
    return statistics.by_source_once(good)


# Text forms


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_form(spark, d):
    return texts(spark, d).select("doc_id", T.nfc("text").alias("text"))


def scalar(name: str, expression, sql: str) -> None:
    """A query of one text form of every document."""
    query(f"SELECT doc_id, {sql} AS text FROM documents", name)(lambda spark, d: texts(spark, d).select("doc_id", expression(F.col("text")).alias("text")))


scalar("strip_controls", T.strip_controls, rf"regexp_replace(text, '{T.CONTROL}', ' ', 'g')")
scalar("zero_width", T.drop_zero_width, rf"regexp_replace(text, '{T.ZERO_WIDTH}', '', 'g')")
scalar("web_artifacts", lambda c: T.strip_markup(c, handles=False), rf"regexp_replace(text, '(?i){T.MARKUP}', ' ', 'g')")
scalar("foreign_script_strip", T.strip_foreign, "regexp_replace(text, '[A-Za-z]+', ' ', 'g')")
scalar("danda_repair", T.repair_dandas, "regexp_replace(regexp_replace(text, '\\|\\|', '॥', 'g'), '\\|', '।', 'g')")
scalar("collapse_blanks", T.collapse, strip(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"))
scalar("norm_key", T.norm_key, KEY)


@query()
def normalize_text(spark, d):
    """The whole normal form and the texts that it leaves, which are those that aren't empty after it."""
    return not_empty(texts(spark, d).withColumn("text", T.normalized(F.col("text"))))


# Places before a word are looked at by a blank put before the text, since this SQL knows no lookbehind.
UNHASHED = rf"substr(regexp_replace(' ' || {{}}, '([^\p{{{{L}}}}\p{{{{N}}}}_])#([\p{{{{L}}}}\p{{{{N}}}}_])', '\1\2', 'g'), 2)"
PASSES = "text"
for part in ("<[^>]+>", "&#[0-9]+;", "&[a-zA-Z]+;", rf"(?i)(?:https?://|www\.){T.INK}+", rf"{T.INK}+@{T.INK}+\.{T.INK}+"):
    PASSES = f"regexp_replace({PASSES}, '{part}', ' ', 'g')"
PASSES = rf"substr(regexp_replace(' ' || {PASSES}, '([^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_]+', '\1 ', 'g'), 2)"


@query(f"SELECT doc_id, {UNHASHED.format('text')} AS text FROM documents")
def hash_signs(spark, d):
    return texts(spark, d).select("doc_id", T.drop_hash_signs(F.col("text")).alias("text"))


@query("SELECT doc_id, " + UNHASHED.format("t") + f" AS text FROM (SELECT doc_id, {PASSES} AS t FROM documents)")
def normalize_in_passes(spark, d):
    """Markup stripped in passes, the form of manual sources; hash signs dropped."""
    return texts(spark, d).select("doc_id", T.drop_hash_signs(T.strip_markup_in_passes(F.col("text"))).alias("text"))


COLLAPSED = strip(r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"SELECT count(*) FILTER ({COLLAPSED} <> '') AS kept, count(*) FILTER (coalesce({COLLAPSED}, '') = '') AS dropped FROM documents")
def empty_counts(spark, d):
    """Texts that are left after blanks are collapsed, and those that are empty or missing then."""
    return kept_and_dropped(texts(spark, d).withColumn("text", T.collapse(F.col("text"))))


@query(rf"SELECT doc_id, {WORDS}::BIGINT AS words, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, len(regexp_extract_all(text, '{T.NAIVE_TOKEN}'))::BIGINT AS naive_tokens, len(regexp_extract_all(text, '{T.PRE_TOKEN}'))::BIGINT AS pretokens FROM documents WHERE text IS NOT NULL")
def text_counts(spark, d):
    text = F.col("text")
    return texts(spark, d).where("text is not null").select("doc_id", T.n_words(text).alias("words"), F.length(text).cast("bigint").alias("chars"), F.octet_length(text).cast("bigint").alias("bytes"), T.n_naive_tokens(text).alias("naive_tokens"), T.n_pre_tokens(text).alias("pretokens"))


@query("SELECT doc_id, translate(doc_id::VARCHAR, '0123456789', '०१२३४५६७८९') AS rendered FROM documents")
def digit_rendering(spark, d):
    return table(spark, d, "documents", "doc_id").select("doc_id", T.render_digits(F.col("doc_id"), "devanagari").alias("rendered"))


@query(f"WITH {FOLDED} SELECT pos, source, manual FROM f")
def provenance(spark, d):
    return folded(spark, d).select("pos", "source", "manual")


# Cleaning


@query(f"SELECT doc_id, round({RATIO}, 6) AS script_ratio, round({TERMINAL}, 6) AS terminal_share, round({REPEATED}, 6) AS repeated_share, {BINARY} AS looks_binary FROM documents WHERE text IS NOT NULL")
def line_metrics(spark, d):
    text = F.col("text")
    return texts(spark, d).where("text is not null").select("doc_id", F.round(T.script_ratio(text), 6).alias("script_ratio"), F.round(T.terminal_share(text), 6).alias("terminal_share"), F.round(T.repeated_line_share(text), 6).alias("repeated_share"), T.looks_binary(text).alias("looks_binary"))


@query(f"WITH {DOCS} SELECT pos, {REASON} AS reason FROM d")
def quality_reasons(spark, d):
    return cleaning.with_reason_by_origin(docs(spark, d)).select("pos", "reason")


@query(f"WITH {DOCS} SELECT {REASON} AS reason, count(*) AS n FROM d GROUP BY 1")
def quality_histogram(spark, d):
    return cleaning.with_reason_by_origin(docs(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


REPEATS = f"l AS (SELECT DISTINCT pos, source, unnest({LINES}) AS line FROM d), c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT source, count(*) AS docs FROM d GROUP BY source)"


@query(f"WITH {DOCS}, {REPEATS} SELECT c.source, line, n FROM c JOIN s ON c.source = s.source WHERE n > 0.02 * docs")
def boilerplate_lines(spark, d):
    return cleaning.boilerplate(docs(spark, d))


KEPT = f"array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT coalesce(list_contains(lines, {strip('x')}), false)), chr(10))"
SQUEEZED = strip(r"regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g')")


@query(f"WITH {DOCS}, {REPEATS}, b AS (SELECT c.source, list(line) AS lines FROM c JOIN s ON c.source = s.source WHERE n > 0.02 * docs GROUP BY c.source), k AS (SELECT pos, {KEPT} AS t FROM d LEFT JOIN b ON d.source = b.source WHERE text IS NOT NULL), r AS (SELECT pos, {SQUEEZED} AS text FROM k) SELECT pos, text FROM r WHERE text <> ''")
def boilerplate_strip(spark, d):
    return cleaning.strip_boilerplate(docs(spark, d)).select("pos", "text")


@query(f"WITH {DOCS} SELECT min(pos) AS pos FROM d WHERE text IS NOT NULL GROUP BY md5({KEY})")
def exact_dedup(spark, d):
    return cleaning.first_positions(docs(spark, d))


@query(f"WITH {DOCS} SELECT min(pos) AS first, count(*) AS copies FROM d WHERE text IS NOT NULL GROUP BY md5({KEY}) HAVING count(*) > 1")
def dup_groups(spark, d):
    return cleaning.dup_groups(docs(spark, d))


@query("SELECT min(doc_id) AS pos FROM documents WHERE nullif(url, '') IS NOT NULL GROUP BY url UNION ALL SELECT doc_id FROM documents WHERE nullif(url, '') IS NULL")
def url_dedup(spark, d):
    """Merged records are told apart by their address where they have one; rows without stay."""
    return cleaning.id_dedup(documents(spark, d, "url"), "url").select("pos")


LID = f"""w AS (SELECT DISTINCT lang AS label, lower(word) AS word FROM common_words),
t AS (SELECT pos, unnest(list_filter(regexp_split_to_array(lower(text), '{W}+'), lambda w: w <> '')) AS word FROM d),
h AS (SELECT pos, label, count(*) AS n FROM t JOIN w USING (word) GROUP BY pos, label),
r AS (SELECT pos, label, n, sum(n) OVER (PARTITION BY pos) AS total, row_number() OVER (PARTITION BY pos ORDER BY n DESC, label) AS rn FROM h),
s AS (SELECT pos, label, n / total AS prob FROM r WHERE rn = 1)"""


@query(f"WITH {DOCS}, {LID} SELECT pos, label, round(prob, 6) AS prob FROM s")
def lid_scores(spark, d):
    return cleaning.language_scores(docs(spark, d), table(spark, d, "common_words")).select("pos", "label", F.round("prob", 6).alias("prob"))


@query(f"WITH {DOCS}, {LID} SELECT d.pos, label FROM d JOIN s ON d.pos = s.pos WHERE label = lower(lang) AND prob >= 0.6")
def lid_keep(spark, d):
    return cleaning.language_filter(docs(spark, d), table(spark, d, "common_words"), F.lower("lang")).select("pos", "label")


@query(f"WITH {DOCS}, {LID} SELECT label, count(*) AS n FROM d JOIN s ON d.pos = s.pos WHERE NOT coalesce(label = lower(lang) AND prob >= 0.6, false) GROUP BY label ORDER BY n DESC, label LIMIT 5")
def lid_dropped_top5(spark, d):
    scored = cleaning.with_language(docs(spark, d), table(spark, d, "common_words")).where("label is not null")
    return cleaning.top(scored.where(~F.coalesce((F.col("label") == F.lower("lang")) & (F.col("prob") >= 0.6), F.lit(False))), "label")


PADDED = f"concat(' ', trim(regexp_replace(lower(text), '{W}+', ' ', 'g')), ' ')"
GRAMS3 = "unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
LID_MODEL = f"""la AS (SELECT lower(trim(lang)) AS label, {PADDED} AS t FROM lang_samples WHERE text IS NOT NULL AND trim(lang) <> ''),
lb AS (SELECT label, {GRAMS3} AS g FROM la), lc AS (SELECT label, g, count(*) AS n FROM lb GROUP BY ALL),
lk AS (SELECT count(DISTINCT g) AS kinds FROM lc), lt AS (SELECT label, sum(n) + kinds AS total FROM lc, lk GROUP BY label, kinds),
da AS (SELECT pos, {PADDED} AS t FROM d WHERE text IS NOT NULL), db AS (SELECT pos, {GRAMS3} AS g FROM da WHERE trim(t) <> ''),
dc AS (SELECT pos, g, count(*) AS n FROM db GROUP BY ALL),
ds AS (SELECT pos, lt.label, sum(dc.n * ln((coalesce(lc.n, 0) + 1) / total)) AS lp FROM dc CROSS JOIN lt LEFT JOIN lc ON lc.label = lt.label AND lc.g = dc.g GROUP BY pos, lt.label),
dm AS (SELECT pos, max(lp) AS best FROM ds GROUP BY pos),
lid AS (SELECT ds.pos, min(label) FILTER (lp = best) AS label, 1 / sum(exp(lp - best)) AS prob FROM ds JOIN dm ON ds.pos = dm.pos GROUP BY ds.pos)"""


@query(f"WITH {DOCS}, {LID_MODEL} SELECT pos, label, round(prob, 6) AS prob FROM lid")
def lid_model_scores(spark, d):
    """The likeliest language by the character model fitted on the trusted samples."""
    model = lid.Model(table(spark, d, "lang_samples", "sample_id", "lang", "text"))
    return lid.with_language(docs(spark, d), model).where("label is not null").select("pos", "label", F.round("prob", 6).alias("prob"))


@query(f"WITH {DOCS}, {LID_MODEL} SELECT d.pos, label FROM d JOIN lid ON d.pos = lid.pos WHERE label = lower(trim(lang)) AND prob >= 0.6")
def lid_model_keep(spark, d):
    model = lid.Model(table(spark, d, "lang_samples", "sample_id", "lang", "text"))
    return lid.keep(docs(spark, d), model, F.lower(F.trim("lang"))).select("pos", "label")


# Classes of texts whose runs of five words agree to 0.8: all pairs by their shared runs, then the least pos reachable.
NEAR = f"""nw AS (SELECT pos, list_filter(regexp_split_to_array(lower(text), '{W}+'), lambda w: w <> '') AS w FROM d WHERE text IS NOT NULL),
ns AS (SELECT pos, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM nw),
nf AS (SELECT s, min(pos) AS first, len(s) AS n FROM ns GROUP BY s), nm AS (SELECT pos, first FROM ns JOIN nf USING (s)),
nu AS (SELECT first AS pos, n, unnest(s) AS x FROM nf),
np AS (SELECT a.pos AS low, b.pos AS high FROM nu a JOIN nu b ON a.x = b.x AND a.pos < b.pos GROUP BY a.pos, b.pos, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
ne AS (SELECT low, high FROM np UNION ALL SELECT high, low FROM np),
nr AS (SELECT first AS pos, first AS class FROM nf UNION SELECT ne.high, nr.class FROM nr JOIN ne ON ne.low = nr.pos WHERE nr.class < ne.high),
nc AS (SELECT pos, min(class) AS class FROM nr GROUP BY pos), near AS (SELECT nm.pos, nc.class FROM nm JOIN nc ON nm.first = nc.pos)"""


@query(f"WITH RECURSIVE {DOCS}, {NEAR} SELECT pos, class AS canonical FROM near WHERE class < pos")
def near_dup_ids(spark, d):
    """Every document of a class of near duplicates but its first, which is the class's id."""
    return near_dedup.class_duplicates(docs(spark, d))


@query(f"WITH RECURSIVE {DOCS}, {NEAR} SELECT pos FROM d WHERE pos NOT IN (SELECT pos FROM near WHERE class < pos)")
def near_dedup_keep(spark, d):
    return near_dedup.first_of_classes(docs(spark, d)).select("pos")


@query(f"WITH {DOCS}, {NEAR[: NEAR.index('ne AS')].rstrip().rstrip(',')}, m AS (SELECT nm.pos, coalesce(min(low), first) AS canonical FROM nm LEFT JOIN np ON np.high = nm.first GROUP BY nm.pos, first) SELECT pos, canonical FROM m WHERE canonical < pos")
def near_dup_marked(spark, d):
    """Every document near to one of lower pos, whether that stays or not, and the least such pos."""
    return near_dedup.marked(docs(spark, d))


@query()
def near_dedup_greedy(spark, d):
    """pos, kept of every document with a text: dropped only if near to a kept one."""
    return near_dedup.greedy(docs(spark, d))


# The n-gram model

TOKENS = f"list_filter(regexp_split_to_array(text, '{W}+'), lambda w: w <> '')"
MODEL = f"""tr AS (SELECT pos, {TOKENS} AS tokens FROM d WHERE text IS NOT NULL),
u AS (SELECT unnest(tokens) AS word FROM tr), uni AS (SELECT word, count(*) AS n FROM u GROUP BY word),
p AS (SELECT unnest(list_zip(tokens[:-2], tokens[2:])) AS x FROM tr WHERE len(tokens) > 1),
bi AS (SELECT x[1] AS a, x[2] AS b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1),
tot AS (SELECT sum(n) AS total, count(*) AS kinds FROM uni)"""
SCORES = f"""{MODEL}, s1 AS (SELECT pos, tokens FROM tr),
s2 AS (SELECT pos, unnest(tokens) AS word, unnest(range(1, len(tokens) + 1)) AS i, tokens FROM s1),
s3 AS (SELECT pos, word, CASE WHEN i > 1 THEN tokens[i - 1] END AS before FROM s2),
s4 AS (SELECT pos, CASE WHEN bi.n IS NOT NULL THEN ln(bi.n / f.n) ELSE ln(0.4) + ln((coalesce(g.n, 0) + 1) / (total + kinds)) END AS lp
       FROM s3 LEFT JOIN bi ON bi.a = before AND bi.b = s3.word LEFT JOIN uni f ON f.word = before LEFT JOIN uni g ON g.word = s3.word CROSS JOIN tot),
s AS (SELECT pos, exp(-sum(lp) / count(*)) AS perplexity FROM s4 GROUP BY pos)"""


@query(f"WITH {DOCS}, {MODEL} SELECT word, n FROM uni")
def ngram_unigrams(spark, d):
    return ngram.unigrams(docs(spark, d))


@query(f"WITH {DOCS}, {MODEL} SELECT a AS first, b AS second, n FROM bi")
def ngram_bigrams(spark, d):
    return ngram.bigrams(docs(spark, d))


@query(f"WITH {DOCS}, tr AS (SELECT {TOKENS} AS t FROM d WHERE text IS NOT NULL), g AS (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS words FROM tr WHERE len(t) >= 3) SELECT words, count(*) AS n FROM g GROUP BY words HAVING count(*) > 1")
def ngram_trigrams(spark, d):
    return ngram.ngrams(docs(spark, d), 3, 1).select(F.array_join("words", " ").alias("words"), "n")


def scores(spark, d, where: str = "true"):
    """Perplexities of all texts under the model of the texts that meet the condition."""
    df = docs(spark, d)
    return ngram.Model(ngram.training_documents(df.where(where))).scores(df)


@query(f"WITH {DOCS}, {SCORES} SELECT pos, round(perplexity, 4) AS perplexity FROM s UNION ALL SELECT pos, 'inf'::DOUBLE FROM s1 WHERE len(tokens) = 0")
def perplexity_scores(spark, d):
    return scores(spark, d).select("pos", F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {DOCS}, {SCORES.replace('unnest(tokens) AS word FROM tr)', 'unnest(tokens) AS word FROM tr WHERE manual)').replace('FROM tr WHERE len(tokens) > 1)', 'FROM tr WHERE manual AND len(tokens) > 1)').replace('SELECT pos, ' + TOKENS + ' AS tokens FROM d', 'SELECT pos, manual, ' + TOKENS + ' AS tokens FROM d')} SELECT pos, round(perplexity, 4) AS perplexity FROM s UNION ALL SELECT pos, 'inf'::DOUBLE FROM s1 WHERE len(tokens) = 0")
def perplexity_by_manual(spark, d):
    """All texts under the model of the manual ones."""
    return scores(spark, d, "manual").select("pos", F.round("perplexity", 4).alias("perplexity"))


@query(f"WITH {DOCS}, {SCORES} SELECT round(quantile_cont(perplexity, 0.95), 4) AS cutoff FROM s")
def perplexity_cutoff(spark, d):
    return spark.createDataFrame([(ngram.cutoff(cut(scores(spark, d))),)], "cutoff double").select(F.round("cutoff", 4).alias("cutoff"))


@query(f"WITH {DOCS}, {SCORES}, c AS (SELECT quantile_cont(perplexity, 0.95) AS cutoff FROM s) SELECT pos FROM s, c WHERE perplexity <= cutoff * (1 + 1e-12)")
def perplexity_keep(spark, d):
    return ngram.perplexity_filter(docs(spark, d)).select("pos")


@query(f"WITH {DOCS}, {SCORES} SELECT pos FROM s WHERE perplexity <= 500")
def perplexity_under(spark, d):
    """Kept by an absolute perplexity."""
    return ngram.perplexity_filter(docs(spark, d), params=ngram.PerplexityParams(max_perplexity=500.0)).select("pos")


@query(f"WITH {DOCS}, {SCORES} SELECT round(quantile_cont(perplexity, 0.05), 4) AS p5, round(quantile_cont(perplexity, 0.25), 4) AS p25, round(quantile_cont(perplexity, 0.5), 4) AS p50, round(quantile_cont(perplexity, 0.75), 4) AS p75, round(quantile_cont(perplexity, 0.95), 4) AS p95 FROM s")
def perplexity_quantiles(spark, d):
    names = ("p5", "p25", "p50", "p75", "p95")
    found = quantiles(scores(spark, d), "perplexity", [0.05, 0.25, 0.5, 0.75, 0.95])
    return spark.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in names)).select(*(F.round(n, 4).alias(n) for n in names))


# Statistics


@query(f"WITH {FOLDED} SELECT source, {SUMS} FROM f GROUP BY source")
def doc_stats_by_source(spark, d):
    return statistics.by_source(folded(spark, d))


@query(f"WITH {FOLDED} SELECT source, {SUMS} FROM f GROUP BY ROLLUP (source)")
def doc_stats_rollup(spark, d):
    return statistics.with_total(folded(spark, d))


@query(f"WITH {FOLDED}, c AS (SELECT source, {SUMS}, coalesce(sum(len(regexp_extract_all(text, '{T.PRE_TOKEN}'))), 0)::BIGINT AS pretokens FROM f GROUP BY source) SELECT *, round(words / docs, 6) AS words_per_doc, CASE WHEN words > 0 THEN round(chars / words, 6) END AS chars_per_word FROM c")
def corpus_counts(spark, d):
    return statistics.token_counts(folded(spark, d))


@query(f"WITH {DOCS}, a AS (SELECT coalesce(sum({WORDS}) FILTER (manual), 0) AS m, coalesce(sum({WORDS}) FILTER (NOT manual), 0) AS dl FROM d), t AS (SELECT *, unnest([0.2::DOUBLE, 0.25::DOUBLE, 0.3::DOUBLE]) AS target FROM a), k AS (SELECT *, m * (1 - target) / target AS wanted, least(m * (1 - target) / target, dl) AS keep FROM t) SELECT target, round(keep)::BIGINT AS keep_words, CASE WHEN dl > 0 THEN round(keep / dl, 4) ELSE 0 END AS sample_ratio, CASE WHEN m + keep > 0 THEN round(m / (m + keep), 4) ELSE 0 END AS share_reached, wanted > dl AS limited, round((m + keep) * 1.4::DOUBLE)::BIGINT AS tokens_low, round((m + keep) * 2.2::DOUBLE)::BIGINT AS tokens_high FROM k")
def mix_plan(spark, d):
    return statistics.mix_plan(docs(spark, d))


@query(f"WITH {DOCS}, a AS (SELECT {REASON} AS reason, text, {WORDS} AS w FROM d), c AS (SELECT count(*) AS docs_before, count(*) FILTER (reason IS NULL) AS docs_after, coalesce(sum(w), 0)::BIGINT AS words_before, coalesce(sum(w) FILTER (reason IS NULL), 0)::BIGINT AS words_after FROM a) SELECT *, round(100 * docs_after / docs_before, 4) AS docs_percent, round(words_after * 1.4::DOUBLE)::BIGINT AS tokens_low, round(words_after * 2.2::DOUBLE)::BIGINT AS tokens_high, CASE WHEN round(words_after * 1.4::DOUBLE) >= 200000 THEN 'PASS' WHEN round(words_after * 2.2::DOUBLE) >= 200000 THEN 'BORDERLINE' ELSE 'FAIL' END AS verdict FROM c")
def retention_report(spark, d):
    df = docs(spark, d)
    return statistics.retention(df, cleaning.with_reason_by_origin(df).where("reason is null"), 200_000)


@query(f"WITH {FOLDED}, c AS (SELECT source, count(*) AS docs, coalesce(sum({WORDS}), 0)::BIGINT AS words FROM f GROUP BY source) SELECT c.source, coalesce(r.category, 'uncategorised') AS category, docs, words, round(docs / sum(docs) OVER (), 4) AS doc_share FROM c LEFT JOIN (SELECT site, min(category) AS category FROM registry GROUP BY site) r ON c.source = r.site")
def combine_report(spark, d):
    return statistics.combine_report(folded(spark, d), table(spark, d, "registry", "site", "category"))


@query(f"WITH {FOLDED} SELECT DISTINCT site AS source FROM registry WHERE site IS NOT NULL AND site NOT IN (SELECT source FROM f)")
def registry_without_documents(spark, d):
    """Sites from which there is no document, a host counting as its site."""
    return statistics.without_documents(folded(spark, d), table(spark, d, "registry", "site"))


@query(f"WITH {FOLDED} SELECT DISTINCT site AS source FROM registry WHERE site IS NOT NULL AND site NOT IN (SELECT source FROM f WHERE manual AND text IS NOT NULL AND {WORDS} >= 600)")
def registry_without_long_documents(spark, d):
    """Sites from which there is no manual document of 600 words or more."""
    long = folded(spark, d).where("manual").where(T.n_words(F.col("text")) >= 600)
    return statistics.without_documents(long, table(spark, d, "registry", "site"))


REASONS = f"r AS (SELECT pos, CASE WHEN text IS NULL OR trim(regexp_replace(text, '{W}', ' ', 'g')) = '' THEN 'empty_text' WHEN coalesce(lower(trim(lang)) NOT IN ('hi', 'hindi', 'ne', 'nepali'), true) THEN 'wrong_language' WHEN NOT manual THEN 'not_manual' END AS reason, md5({KEY}) AS key FROM d), rr AS (SELECT pos, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY CASE WHEN reason IS NULL THEN key ELSE pos::VARCHAR END ORDER BY pos) > 1 THEN 'duplicate_doc_id' END) AS reason FROM r)"


@query(f"WITH {DOCS}, {REASONS} SELECT reason, count(*) AS n FROM rr GROUP BY reason")
def combine_drop_reasons(spark, d):
    """The id of a record is the hash of its text."""
    known = statistics.combine_reasons(docs(spark, d), ("hi", "hindi", "ne", "nepali"), cleaning.exact_key(F.col("text")))
    return known.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {FOLDED} SELECT source, {SUMS} FROM f GROUP BY source")
def counts_merged(spark, d):
    """Partial counts by source, language and origin, stored and added up by source."""
    parts = cut(folded(spark, d).groupBy("source", "lang", "manual").agg(*statistics.sums(F.col("text"))))
    return statistics.merged(parts, "source")


@query(f"WITH {FOLDED}, c AS (SELECT source, {SUMS} FROM f GROUP BY source) SELECT source, round(docs * 2.5::DOUBLE)::BIGINT AS docs, round(chars * 2.5::DOUBLE)::BIGINT AS chars, round(words * 2.5::DOUBLE)::BIGINT AS words FROM c")
def counts_scaled(spark, d):
    return statistics.scaled(statistics.by_source(folded(spark, d)), 2.5)


@query(f"WITH {DOCS}, q AS (SELECT * FROM d WHERE text IS NOT NULL AND {REASON} IS NULL), e AS (SELECT * FROM q WHERE pos IN (SELECT min(pos) FROM q GROUP BY md5({KEY}))) SELECT 'read' AS stage, count(*) AS docs, coalesce(sum({WORDS}), 0)::BIGINT AS words FROM d UNION ALL SELECT 'quality', count(*), coalesce(sum({WORDS}), 0)::BIGINT FROM q UNION ALL SELECT 'exact_dedup', count(*), coalesce(sum({WORDS}), 0)::BIGINT FROM e")
def pipeline_funnel(spark, d):
    df = docs(spark, d)
    good = cleaning.with_reason_by_origin(df.where("text is not null")).where("reason is null").drop("reason")
    good = cut(good.select("pos", "text"))
    return statistics.funnel({"read": df, "quality": good, "exact_dedup": cleaning.exact_dedup(good)})


@query()
def cleaning_funnel(spark, d):
    """The whole chain: normal form, language, boilerplate of manual sources, quality by origin, exact duplicates, perplexity,
    near duplicates. Texts are stored after the normal form, the quality filter and the perplexity filter."""
    df = docs(spark, d)
    normal = scale.stored(not_empty(df.withColumn("text", T.normalized(F.col("text")))))
    named = cleaning.language_filter(normal, table(spark, d, "common_words"), F.lower("lang")).drop("label", "prob")
    plain = cleaning.strip_manual_boilerplate(named)
    good = scale.stored(cleaning.with_reason_by_origin(plain).where("reason is null").drop("reason"))
    once = cleaning.exact_dedup(good)
    fluent = scale.stored(ngram.perplexity_filter(once).drop("perplexity"))
    return statistics.funnel({"1 read": df, "2 normalized": normal, "3 language": named, "4 boilerplate": plain, "5 quality": good, "6 exact_dedup": once, "7 perplexity": fluent, "8 near_dedup": near_dedup.first_of_classes(fluent)})


@query(f"WITH {DOCS} SELECT count(*) * 10 AS docs_estimated, coalesce(sum(length(text)), 0)::BIGINT * 10 AS chars_estimated, coalesce(sum({WORDS}), 0)::BIGINT * 10 AS words_estimated FROM d WHERE pos % 10 = 0")
def probe_estimate(spark, d):
    """Sampling is the feature: totals estimated from an evenly spaced probe."""
    return statistics.extrapolated(docs(spark, d), 10)


@query(f"WITH {DOCS}, b AS (SELECT pos, text, coalesce(strlen(text), 0) + 1 AS n FROM d), s AS (SELECT pos, text, n, sum(n) OVER (ORDER BY pos) - n AS before, sum(n) OVER () AS total FROM b), h AS (SELECT *, ceil((before + n) * 200 / total) - ceil(before * 200 / total) AS hits FROM s), r AS (SELECT x.n, x.text, y.hits FROM h x JOIN h y ON x.before = y.before + y.n WHERE y.hits > 0), c AS (SELECT coalesce(sum(hits), 0)::BIGINT AS probes, coalesce(sum(length(text) * hits), 0) AS chars, coalesce(sum({WORDS} * hits), 0) AS words, sum(n * hits) AS held FROM r) SELECT probes, round(probes * (SELECT max(total) FROM s) / held)::BIGINT AS docs_estimated, round(chars * (SELECT max(total) FROM s) / held)::BIGINT AS chars_estimated, round(words * (SELECT max(total) FROM s) / held)::BIGINT AS words_estimated FROM c")
def probe_by_bytes(spark, d):
    """Sampling is the feature: totals estimated from 200 evenly spaced byte probes."""
    return statistics.probed(docs(spark, d), F.coalesce("text", F.lit("")), 200)


@query(f"WITH s AS (SELECT split, coalesce(manual, false) AS manual, {WORDS} AS w FROM split_docs), c AS (SELECT split, count(*) AS docs, coalesce(sum(w), 0)::BIGINT AS words, coalesce(sum(w) FILTER (manual), 0)::BIGINT AS manual_words FROM s GROUP BY split) SELECT *, CASE WHEN words > 0 THEN round(manual_words / words, 6) ELSE 0 END AS manual_share FROM c")
def split_summary(spark, d):
    return statistics.split_pivot(table(spark, d, "split_docs", "split", "text", F.coalesce("manual", F.lit(False)).alias("manual")))


# Sampling and splitting


@query(f"WITH {DOCS} SELECT pos FROM d WHERE text IS NOT NULL AND (manual OR {HASH.format('keep')} < 0.5)")
def downsample(spark, d):
    return sampling.downsample(docs(spark, d), sampling.SplitParams(keep=0.5)).select("pos")


@query(f"WITH {DOCS} SELECT pos, CASE WHEN {HASH.format('split')} < 0.8 THEN 'train' WHEN {HASH.format('split')} < 0.9 THEN 'val' ELSE 'test' END AS split FROM d WHERE text IS NOT NULL")
def split_assign(spark, d):
    return sampling.assign_splits(docs(spark, d)).select("pos", "split")


@query(f"WITH {DOCS}, k AS (SELECT *, CASE WHEN {HASH.format('split')} < 0.8 THEN 'train' WHEN {HASH.format('split')} < 0.9 THEN 'val' ELSE 'test' END AS split FROM d WHERE text IS NOT NULL AND (manual OR {HASH.format('keep')} < 0.5)), c AS (SELECT *, CASE WHEN manual AND split = 'train' THEN 2 + ({HASH.format('upsample')} < 0.5)::INT ELSE 1 END AS copies FROM k) SELECT pos, split, unnest(range(copies))::INT AS copy FROM c")
def combine_split(spark, d):
    return sampling.combine_split(docs(spark, d), sampling.SplitParams(keep=0.5, upsample=2.5)).select("pos", "split", "copy")


@query(f"WITH {DOCS}, a AS (SELECT coalesce(sum({WORDS}) FILTER (manual), 0)::BIGINT AS manual_words, coalesce(sum({WORDS}) FILTER (NOT manual), 0)::BIGINT AS downloaded_words FROM d) SELECT manual_words, downloaded_words, round(least(1.0::DOUBLE, manual_words * (1 - 0.22::DOUBLE) / 0.22::DOUBLE / downloaded_words), 6) AS keep, round(manual_words + downloaded_words * least(1.0::DOUBLE, manual_words * (1 - 0.22::DOUBLE) / 0.22::DOUBLE / downloaded_words))::BIGINT AS expected_words FROM a")
def corpus_plan(spark, d):
    return sampling.corpus_plan(docs(spark, d))


@query(f"WITH {DOCS}, a AS (SELECT coalesce(sum({WORDS}) FILTER (manual), 0)::BIGINT AS m, coalesce(sum({WORDS}) FILTER (NOT manual), 0)::BIGINT AS w, coalesce(sum(length(text)), 0) AS ch FROM d), b AS (SELECT *, ch / greatest(m + w, 1) / 3.4::DOUBLE AS fertility FROM a), k AS (SELECT *, CASE WHEN w > 0 THEN least(1.0::DOUBLE, greatest(0, 100000 / (fertility * 0.8::DOUBLE) - m * 1.5::DOUBLE) / w) ELSE 0 END AS keep FROM b), c AS (SELECT *, m * 1.5::DOUBLE + w * keep AS corpus FROM k) SELECT m AS manual_words, w AS downloaded_words, round(fertility, 4) AS fertility, round(keep, 6) AS keep, floor(corpus)::BIGINT AS corpus_words, floor(corpus * 0.8::DOUBLE * fertility)::BIGINT AS train_tokens, round(m * 1.5::DOUBLE / corpus, 4) AS manual_share FROM c")
def corpus_plan_by_tokens(spark, d):
    return sampling.corpus_plan_by_tokens(docs(spark, d), 100_000, upsample=1.5)


@query(f"WITH {DOCS} SELECT pos, source FROM d WHERE {WORDS} >= 128 ORDER BY md5(concat('1337:', text)), pos LIMIT 200")
def eval_subset(spark, d):
    """A frozen sample of 200: sampling is the feature."""
    return sampling.eval_subset(docs(spark, d), 200).select("pos", "source")


@query(f"WITH {DOCS}, s AS (SELECT pos, manual, {WORDS} AS w FROM d WHERE {WORDS} >= 128 ORDER BY md5(concat('1337:', text)), pos LIMIT 200) SELECT count(*) AS docs, sum(w)::BIGINT AS words, count(*) FILTER (manual) AS manual_docs, (SELECT count(*) FROM d WHERE {WORDS} >= 128) AS eligible FROM s")
def eval_subset_info(spark, d):
    df = docs(spark, d)
    chosen = sampling.eval_subset(df, 200).agg(F.count("*").alias("docs"), F.sum(T.n_words(F.col("text"))).alias("words"), F.count_if("manual").alias("manual_docs"))
    return chosen.crossJoin(df.where(T.n_words(F.col("text")) >= 128).agg(F.count("*").alias("eligible")))


@query("SELECT doc_id AS pos FROM documents ORDER BY doc_id LIMIT 100")
def head_limit(spark, d):
    """The first 100 documents: the limit is the feature."""
    return sampling.head(docs(spark, d), 100).select("pos")


@query(f"WITH {DOCS} SELECT pos, {strip('text')} AS text, 'pulled' AS source, false AS manual, 'hi' AS lang FROM d WHERE {strip('text')} <> '' ORDER BY pos LIMIT 500000")
def dataset_pull(spark, d):
    return pulled(docs(spark, d).withColumn("content", F.lit(None).cast("string")), "pulled", "hi")


# Frontier

KINDS = "|".join(frontier.NOT_ARTICLES)
PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"


@query(f"SELECT url, NOT regexp_matches({PATH}, '\\.(?:{KINDS})$') AS is_article, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS url_host FROM frontier WHERE url IS NOT NULL")
def article_urls(spark, d):
    url = F.col("url")
    return table(spark, d, "frontier", "url").where("url is not null").select("url", frontier.is_article(url).alias("is_article"), frontier.host_of(url).alias("url_host"))


@query("SELECT crawl_state, count(*) AS n FROM frontier GROUP BY crawl_state")
def frontier_counts(spark, d):
    return frontier.counts(table(spark, d, "frontier", "crawl_state"))


@query("SELECT DISTINCT url, priority FROM frontier WHERE crawl_state = 'pending' ORDER BY priority, url LIMIT 256")
def frontier_claim(spark, d):
    """A batch of 256: the limit is the feature."""
    return frontier.claimable(table(spark, d, "frontier", "url", "priority", "crawl_state"), 256)


@query("SELECT url, CASE WHEN crawl_state = 'claimed' THEN 'pending' ELSE crawl_state END AS crawl_state FROM frontier")
def frontier_requeue(spark, d):
    return frontier.requeue(table(spark, d, "frontier", "url", "crawl_state"))


@query("WITH old AS (SELECT url, priority, crawl_state FROM frontier WHERE crawl_state <> 'pending'), new AS (SELECT url, min(struct_pack(priority := priority, crawl_state := crawl_state)) AS x FROM frontier WHERE crawl_state = 'pending' AND url IS NOT NULL AND url NOT IN (SELECT url FROM old WHERE url IS NOT NULL) GROUP BY url) SELECT url, priority, crawl_state FROM old UNION ALL SELECT url, x.priority, x.crawl_state FROM new")
def frontier_add(spark, d):
    """Pending URLs as newly found, the others as the frontier so far."""
    rows = table(spark, d, "frontier", "url", "priority", "crawl_state")
    return frontier.add_new(rows.where("crawl_state <> 'pending'"), rows.where("crawl_state = 'pending'"))


@query("WITH r AS (SELECT url, max(n_chars) AS n FROM documents WHERE url IS NOT NULL GROUP BY url) SELECT f.url, CASE WHEN r.url IS NOT NULL THEN 'done' ELSE crawl_state END AS crawl_state, coalesce(r.n, f.n_chars) AS n_chars FROM frontier f LEFT JOIN r ON f.url = r.url")
def frontier_mark(spark, d):
    """URLs of which there is a document are done, with its length."""
    results = table(spark, d, "documents", "url", "n_chars").where("url is not null").groupBy("url").agg(F.max("n_chars").alias("new_chars"), F.lit("done").alias("new_state"))
    return frontier.mark(table(spark, d, "frontier", "url", "crawl_state", "n_chars"), results).select("url", "crawl_state", "n_chars")


CATEGORIES = ["news", "current_affairs", "sports", "literature"]


@query("SELECT site, CASE coalesce(list_position(['news', 'current_affairs', 'sports', 'literature'], category), 0) WHEN 0 THEN 4 ELSE list_position(['news', 'current_affairs', 'sports', 'literature'], category) - 1 END::BIGINT AS priority FROM registry")
def category_priority(spark, d):
    return table(spark, d, "registry", "site", frontier.priority_of(F.col("category"), CATEGORIES).alias("priority"))


DISCOVERED = """c AS (SELECT DISTINCT host AS site, priority AS strategy, url FROM frontier WHERE url IS NOT NULL AND host IS NOT NULL),
l AS (SELECT site, strategy, url, row_number() OVER (PARTITION BY site, strategy ORDER BY url) AS place_no FROM c),
k AS (SELECT * FROM l WHERE place_no <= 200),
f AS (SELECT site, url, min(strategy) AS strategy FROM k GROUP BY ALL), n AS (SELECT site, strategy, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT site, strategy FROM (SELECT site, strategy, coalesce(sum(n) OVER (PARTITION BY site ORDER BY strategy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM n) WHERE b < 50),
r AS (SELECT f.site, url, row_number() OVER (PARTITION BY f.site ORDER BY f.strategy, url) AS rank FROM f JOIN u ON f.site = u.site AND f.strategy = u.strategy)"""


@query(f"WITH {DISCOVERED} SELECT site, url, rank::INT AS rank FROM r WHERE rank <= 200")
def discovery_union(spark, d):
    """Priorities as strategies, URLs in order of their text; the cap of a site is the feature."""
    found = table(spark, d, "frontier").where("host is not null").select(F.col("host").alias("site"), F.col("priority").alias("strategy"), F.lit(0).alias("place"), "url")
    return frontier.discovered(found, 200)


# Pages, sitemaps and files, made of the tables' texts

def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page: its lines as paragraphs of the article, beside navigation and a script."""
    text = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "</p><p>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    html = F.concat(F.lit("<html><body><nav><p>मुख्य पृष्ठ की यह पंक्ति किसी लेख का भाग नहीं है और बहुत लंबी है</p></nav><article><p>"), text, F.lit("</p></article><script>var a = '<p>x</p>';</script></body></html>"))
    return documents(spark, sf_dir).where("text is not null").select("pos", F.col("pos").cast("string").alias("url"), html.alias("html"))


BLOCKS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '{W}+', ' ', 'g'))), lambda b: length(b) >= 40 AND regexp_matches(b, '[ऀ-ॿ]'))"
KEPT_BLOCKS = f"array_to_string(list_filter(list_transform({BLOCKS}, lambda b, i: CASE WHEN list_position({BLOCKS}, b) = i THEN b END), lambda b: b IS NOT NULL), chr(10))"


@query(f"WITH {DOCS}, p AS (SELECT pos, {KEPT_BLOCKS} AS text FROM d WHERE text IS NOT NULL) SELECT pos::VARCHAR AS url, md5({KEY}) AS doc_id, text, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes, 'manual' AS source_type FROM p WHERE length(text) >= 200")
def html_documents(spark, d):
    """Texts of pages: blocks of 40 characters or more with a letter of the script, each once, documents of 200 or more."""
    return html.documents(spread(pages(spark, d))).select("url", "doc_id", "text", "flags.n_chars", "flags.n_bytes", "source_type")


@query("SELECT page_id AS page, title, extract FROM (SELECT doc_id::VARCHAR AS page_id, source AS title, text AS extract FROM documents) WHERE extract <> ''")
def wiki_extracts(spark, d):
    """Plain texts out of a wiki's answers in JSON."""
    page = F.map_from_arrays(F.array(F.col("pos").cast("string")), F.array(F.struct("title", F.col("text").alias("extract"))))
    answers = texts(spark, d).join(table(spark, d, "documents", "doc_id", F.col("source").alias("title")), "doc_id").withColumnRenamed("doc_id", "pos")
    return html.wiki_text(answers.select(F.to_json(F.struct(F.struct(page.alias("pages")).alias("query"))).alias("json")))


@query(f"SELECT url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) LIKE '%.xml' AS nested FROM frontier WHERE url IS NOT NULL AND trim(url) <> ''")
def sitemap_urls(spark, d):
    """Addresses read back out of sitemaps, one a URL of the frontier, with an image's beside it."""
    url = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xml = F.concat(F.lit("<urlset><url><loc> "), url, F.lit(" </loc><image:image><image:loc>http://x/y.jpg</image:loc></image:image></url></urlset>"))
    rows = table(spark, d, "frontier", "url").where("url is not null").select(F.explode(frontier.sitemap_locations(xml)).alias("url"))
    return rows.select("url", frontier.is_nested(F.col("url")).alias("nested"))


@query("SELECT host, 'https://' || host || '/sitemap.xml' AS sitemap FROM registry WHERE host IS NOT NULL")
def robots_sitemaps(spark, d):
    robots = F.concat(F.lit("User-agent: *\nDisallow: /x\nSitemap: https://"), "host", F.lit("/sitemap.xml\r\nCrawl-delay: 1"))
    return table(spark, d, "registry", "host").where("host is not null").select("host", F.explode(frontier.robots_sitemaps(robots)).alias("sitemap"))


@query("SELECT host, CASE WHEN contains(host, 'wikipedia.org') OR contains(host, 'wikisource.org') OR contains(host, 'wikibooks.org') THEN 'https://' || host || '/w/api.php' END AS api FROM (SELECT host FROM registry WHERE host IS NOT NULL UNION ALL SELECT lang || '.wikipedia.org' FROM registry WHERE lang IS NOT NULL)")
def wiki_addresses(spark, d):
    """Addresses of wikis' programming interfaces, for the registry's hosts and its languages' wikis."""
    rows = table(spark, d, "registry", "host", "lang")
    hosts = rows.where("host is not null").select("host").unionAll(rows.where("lang is not null").select(F.concat("lang", F.lit(".wikipedia.org"))))
    return hosts.select("host", frontier.wiki_api(F.concat(F.lit("http://"), "host", F.lit("/"))).alias("api"))


def stored(spark: SparkSession, sf_dir: str, broken: bool = False) -> str:
    """The documents as JSON lines in a new shared folder, a broken line and a blank one beside each fifth if asked."""
    folder = shared_folder(spark)
    rows = documents(spark, sf_dir).select(F.col("pos").cast("string").alias("doc_id"), "text", "source", "manual", "lang")
    if not broken:
        jsonl.write(rows, folder, sort_keys=True)
    else:
        line = F.to_json(F.struct("*"))
        lines = F.when(F.col("doc_id").cast("bigint") % 5 == 0, F.array(line, F.lit('{"text": "broken'), F.lit(" "))).otherwise(F.array(line))
        rows.select(F.explode(lines).alias("value")).write.text(folder)
    return folder


@query(f"WITH {DOCS} SELECT pos::VARCHAR AS doc_id, text, source, manual FROM d")
def jsonl_read(spark, d):
    """Written as JSON lines and read again; malformed and blank lines are skipped."""
    return jsonl.read(spark, stored(spark, d, broken=True)).select("doc_id", "text", "source", "manual")


@query(f"WITH {DOCS} SELECT count(*) + count(*) FILTER (pos % 5 = 0) AS n_lines, count(*) FILTER (pos % 5 = 0) AS n_malformed FROM d")
def jsonl_malformed(spark, d):
    """Lines and malformed ones, counted."""
    return jsonl.malformed_by_file(spark, stored(spark, d, broken=True)).agg(F.sum("n_lines").alias("n_lines"), F.sum("n_malformed").alias("n_malformed"))


@query("SELECT count(*) AS n FROM documents")
def line_count(spark, d):
    return jsonl.line_counts(spark, stored(spark, d)).agg(F.sum("n").alias("n"))


@query(f"WITH {DOCS} SELECT pos::VARCHAR AS doc_id, text, source FROM d")
def shards_read(spark, d):
    """Written as gzip shards of 500 records at most and read whole by file."""
    folder = shared_folder(spark)
    rows = documents(spark, d).select(F.col("pos").cast("string").alias("doc_id"), "text", "source")
    jsonl.write(rows, folder, records=500)
    return jsonl.read_shards(spark, f"{folder}/*.gz").select("doc_id", "text", "source")


@query(f"WITH {DOCS}, n AS (SELECT pos::VARCHAR AS doc_id, text, source, row_number() OVER (ORDER BY pos) - 1 AS r FROM d) SELECT doc_id, text, source, format('shard-{{:05d}}.jsonl.zst', r // 300) AS file, (r % 300)::INT AS line FROM n")
def zstd_shards(spark, d):
    """Written as zstd shards of 300 records in order and read again, with shard and line."""
    folder = posix_folder(spark)
    jsonl.write_shards(documents(spark, d).select("pos", F.col("pos").cast("string").alias("doc_id"), "text", "source"), folder, 300)
    files = jsonl.find_shards(spark, [f"file://{folder}"])
    return jsonl.read_shards(spark, files).select("doc_id", "text", "source", "file", "line")

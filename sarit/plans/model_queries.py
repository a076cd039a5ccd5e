"""Queries on tokens, supervised examples and model outputs, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sarit.functions import text as T
from sarit.operators import metrics, sampling, subwords, supervised, tokens
from sarit.plans.scale import cut, posix_folder, table
from sarit.sources import tokens as token_source
from sarit.sources.documents import documents

QUERIES: dict = {}
ORACLE: dict = {}

W = T.WHITE


def split(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{W}+'), lambda w: w <> '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLE[key] = sql
        return function

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null")


def joined(column: str):
    """An array as text, which every engine compares alike."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


# Sentences

ENDS = r"([।॥?!])[\t-\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+"
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(text, '{ENDS}', '\1' || chr(64976), 'g'), chr(64976)), lambda s: {strip('s')}), lambda s: s <> '')"


@query(f"SELECT doc_id AS pos, unnest({SENTENCES}) AS sentence FROM documents WHERE text IS NOT NULL")
def sentences(spark, d):
    return docs(spark, d).select("pos", F.explode(tokens.sentences(F.col("text"))).alias("sentence"))


# Words of a long sentence are packed one after the other.
PACKED = f"""s AS (SELECT doc_id AS pos, unnest({SENTENCES}) AS s, unnest(range(len({SENTENCES}))) AS k FROM documents WHERE text IS NOT NULL),
r AS (SELECT pos, k, 1 AS j, {split('s')} AS w, []::VARCHAR[] AS done, '' AS piece, 0::BIGINT AS size FROM s WHERE strlen(s) > 512
UNION ALL SELECT pos, k, j + 1, w, CASE WHEN fills THEN list_append(done, piece) ELSE done END, CASE WHEN fills OR piece = '' THEN w[j] ELSE piece || ' ' || w[j] END, CASE WHEN fills THEN 0 ELSE size END + strlen(w[j]) + 1 FROM (SELECT *, piece <> '' AND size + strlen(w[j]) + 1 > 512 AS fills FROM r WHERE j <= len(w))),
f AS (SELECT pos, k, CASE WHEN piece = '' THEN done ELSE list_append(done, piece) END AS pieces FROM r WHERE j = len(w) + 1 UNION ALL SELECT pos, k, [s] FROM s WHERE strlen(s) <= 512),
g AS (SELECT pos, flatten(list(pieces ORDER BY k)) AS pieces FROM f GROUP BY pos)"""


@query(f"WITH RECURSIVE {PACKED} SELECT pos, unnest(range(len(pieces)))::INT AS i, unnest(pieces) AS piece FROM g")
def packed_pieces(spark, d):
    """Sentences and, of those over 512 bytes, packed words."""
    return docs(spark, d).select("pos", F.posexplode(tokens.packed(F.col("text"), 512)).alias("i", "piece"))


@query(f"WITH s AS (SELECT doc_id AS pos, unnest({SENTENCES}) AS sentence, unnest(range(len({SENTENCES}))) AS i FROM documents WHERE text IS NOT NULL) SELECT pos, sentence FROM s WHERE len({split('sentence')}) BETWEEN 8 AND 22 ORDER BY pos, i LIMIT 1")
def first_sentence(spark, d):
    return tokens.first_sentence(docs(spark, d))


@query(f"WITH s AS (SELECT doc_id AS pos, list_filter({SENTENCES}, lambda s: length(s) BETWEEN 40 AND 180)[1] AS sentence FROM documents WHERE text IS NOT NULL) SELECT pos, sentence FROM s WHERE sentence IS NOT NULL ORDER BY pos LIMIT 5")
def token_examples(spark, d):
    """Five examples: the limit is the feature."""
    return tokens.examples(docs(spark, d))


# Vocabularies and token streams

VOCAB = f"w AS (SELECT doc_id AS pos, unnest({split('text')}) AS word, unnest(range(len({split('text')}))) AS i FROM documents WHERE text IS NOT NULL), c AS (SELECT word, count(*) AS n FROM w GROUP BY word), v AS (SELECT word, n, (row_number() OVER (ORDER BY n DESC, word) + 3)::INT AS token FROM c)"
IDS = f"{VOCAB}, e AS (SELECT pos, i, token FROM w JOIN v USING (word)), t AS (SELECT documents.doc_id AS pos, list_append(coalesce(ids, []), 3) AS ids FROM documents LEFT JOIN (SELECT pos, list(token ORDER BY i) AS ids FROM e GROUP BY pos) x ON x.pos = documents.doc_id WHERE text IS NOT NULL)"


@query(f"WITH {VOCAB} SELECT word, n, token FROM v")
def vocabulary(spark, d):
    return tokens.vocabulary(docs(spark, d))


def encoded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vocab = cut(tokens.vocabulary(docs(spark, d)))
    return cut(tokens.encode_words(docs(spark, d), vocab)), vocab


@query(f"WITH {IDS} SELECT pos, array_to_string(ids, ' ') AS ids FROM t")
def encoded_words(spark, d):
    return encoded(spark, d)[0].select("pos", joined("ids"))


TRAIN = "concat('0x', substr(md5(concat('split:1337:', text)), 1, 15))::BIGINT / pow(2, 60) < 0.8"


@query(f"WITH {IDS}, f AS (SELECT unnest(ids) AS token FROM t) SELECT token, count(*) AS n FROM f GROUP BY token")
def token_freq(spark, d):
    ids, vocab = encoded(spark, d)
    return tokens.token_frequency(ids, vocab.select("token").unionAll(spark.createDataFrame([(3,)], "token int")))


@query(f"WITH {IDS}, f AS (SELECT unnest(ids) AS token FROM t JOIN documents ON pos = doc_id WHERE {TRAIN}), r AS (SELECT token FROM v UNION ALL SELECT unnest(range(4)) AS token), k AS (SELECT r.token, count(f.token) AS n FROM r LEFT JOIN f ON r.token = f.token GROUP BY r.token) SELECT sum(n)::BIGINT AS tokens, count(*) FILTER (n > 0) AS used, count(*) FILTER (n = 0) AS unused, count(*) FILTER (n = 1) AS once, round((SELECT sum(n) FROM (SELECT n FROM k ORDER BY n DESC, token LIMIT 1000)) / sum(n), 6) AS top_share FROM k")
def token_freq_summary(spark, d):
    """Of the train split's tokens, by the vocabulary of all documents."""
    ids, vocab = encoded(spark, d)
    train = sampling.assign_splits(docs(spark, d)).where("split = 'train'").select("pos").join(ids, "pos")
    every = vocab.select("token").unionAll(spark.range(4).select(F.col("id").cast("int").alias("token")))
    return tokens.frequency_summary(tokens.token_frequency(train, every))


@query(f"WITH {IDS}, f AS (SELECT unnest(ids) AS token FROM t), k AS (SELECT token, count(*) AS n FROM f GROUP BY token) SELECT k.token, coalesce(word, '</s>') AS piece, k.n FROM k LEFT JOIN v ON k.token = v.token ORDER BY k.n DESC, k.token LIMIT 20")
def top_tokens(spark, d):
    """The 20 most frequent: the limit is the feature."""
    ids, vocab = encoded(spark, d)
    pieces = vocab.select("token", F.col("word").alias("piece")).unionAll(spark.createDataFrame([(3, "</s>")], "token int, piece string"))
    return tokens.top_tokens(tokens.token_frequency(ids, pieces.select("token")), pieces, 20)


LONGEST = (2, 4, 8)
CHOPPED = f"""l AS (SELECT unnest([2, 4, 8]) AS longest), w AS (SELECT doc_id, unnest({split('text')}) AS word FROM documents WHERE text IS NOT NULL),
p AS (SELECT longest, unnest(list_transform(range(0, (length(word) - 1) // longest + 1), lambda i: substr(word, i * longest + 1, longest))) AS piece FROM w, l),
c AS (SELECT longest, piece, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT c.longest, sum(n)::BIGINT AS tokens, (SELECT count(*) FROM w) AS words, coalesce(sum(n) FILTER (n < 2), 0) AS unknown, count(*) FILTER (n >= 2) AS vocab_size, (SELECT sum(length(text)) FROM documents) AS chars FROM c GROUP BY c.longest)"""


def swept(spark: SparkSession, d: str) -> DataFrame:
    """longest, tokens, words, chars, unknown, vocab_size of vocabularies of word pieces of at most 2, 4 and 8 characters
    that occur twice or more, other pieces being unknown."""
    words = docs(spark, d).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    pieces = words.select("times", F.explode(F.array(*map(F.lit, LONGEST))).alias("longest"), "word")
    pieces = pieces.select("times", "longest", F.explode(tokens.chopped(F.array("word"), F.col("longest"))).alias("piece")).groupBy("longest", "piece").agg(F.sum("times").alias("n"))
    whole = docs(spark, d).agg(F.sum(T.n_words(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"))
    return tokens.piece_counts(pieces, "longest", 2).crossJoin(F.broadcast(whole))  # one row


@query(f"WITH {CHOPPED} SELECT longest, vocab_size, tokens, round(tokens / words, 6) AS fertility, round(unknown / tokens, 6) AS unknown_share, round(chars / tokens, 6) AS chars_per_token FROM s")
def vocab_sweep(spark, d):
    return tokens.sweep(swept(spark, d), "longest", "vocab_size")


@query(f"WITH {CHOPPED}, q AS (SELECT vocab_size, round(tokens / words, 6) AS f FROM s), b AS (SELECT *, min(f) OVER () AS best FROM q) SELECT coalesce(min(vocab_size) FILTER (vocab_size >= 300 AND f <= best * 1.05), min(vocab_size) FILTER (vocab_size >= 300), min(vocab_size)) AS vocab_size FROM b")
def vocab_choice(spark, d):
    """The choice among the vocabularies of the sweep."""
    return tokens.vocabulary_choice(tokens.sweep(swept(spark, d), "longest", "vocab_size").select("vocab_size", "fertility"), 300)


@query(f"WITH {VOCAB}, k AS (SELECT doc_id AS pos, text, coalesce(manual, source_type = 'manual', false) AS manual, CASE WHEN {TRAIN} THEN 'train' WHEN {TRAIN.replace('0.8', '0.9')} THEN 'val' ELSE 'test' END AS split FROM documents WHERE text IS NOT NULL), o AS (SELECT split, manual, k.pos, (SELECT count(*) FROM w WHERE w.pos = k.pos) + 1 AS n, (SELECT count(*) FROM w JOIN v USING (word) WHERE w.pos = k.pos AND v.n < 2) AS u FROM k), g AS (SELECT split, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (manual), 0)::BIGINT AS manual_tokens, sum(u) AS unknown FROM o GROUP BY split) SELECT split, tokens, manual_tokens, round(unknown / tokens, 6) AS unknown_share, round(manual_tokens / tokens, 6) AS manual_share, round(manual_tokens / tokens, 6) >= 0.2 AS reached FROM g")
def token_shares(spark, d):
    """By the vocabulary of words that occur twice or more; others are unknown."""
    df = sampling.assign_splits(docs(spark, d))
    vocab = cut(tokens.vocabulary(docs(spark, d)).where("n >= 2"))
    return tokens.token_shares(df.select("pos", "manual", "split").join(tokens.encode_words(df, vocab), "pos"))


@query("WITH c AS (SELECT coalesce(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))), 0)::BIGINT AS ascii_digits, coalesce(sum(length(regexp_replace(text, '[^०-९]', '', 'g'))), 0)::BIGINT AS devanagari_digits FROM documents) SELECT *, CASE WHEN devanagari_digits > ascii_digits THEN 'devanagari' ELSE 'ascii' END AS script FROM c")
def digit_audit(spark, d):
    """By the digits of the vocabulary's words and how often each occurs; the SQL counts them in the texts."""
    ids, vocab = encoded(spark, d)
    return tokens.digit_audit(tokens.token_frequency(ids, vocab), vocab.select("token", F.col("word").alias("piece")))


@query()
def subword_roundtrip(spark, d):
    """pos, n_tokens, n_unknown, same: every text encoded by a public subword vocabulary and decoded again; same tells
    whether that gives the text in the vocabulary's own normal form."""
    return subwords.round_trip(docs(spark, d))


@query()
def subword_sweep(spark, d):
    """Tokens, fertility, unknown share and characters a token under each of the public vocabularies."""
    return subwords.sweep(docs(spark, d))


@query()
def subword_unknown_names(spark, d):
    """Names of the reasoning examples that a public subword vocabulary can't write without an unknown token."""
    names = table(spark, d, "reasoning_examples").select(F.explode("entities").alias("string")).where("string is not null").distinct()
    return supervised.unknown_strings(names.withColumn("ids", subwords.encoded(F.col("string"))), subwords.UNKNOWN).select("string")


STREAM = f"{IDS}, z AS (SELECT pos, unnest(ids) AS token, unnest(range(len(ids))) AS i FROM t), y AS (SELECT token, row_number() OVER (ORDER BY pos, i) - 1 AS \"at\" FROM z), m AS (SELECT count(*) AS total FROM y)"


@query(f"WITH {STREAM}, k AS (SELECT y.\"at\" // 128 AS win, list(token ORDER BY y.\"at\") AS x FROM y GROUP BY y.\"at\" // 128), q AS (SELECT k.win, x, list_append(x[2:], n.first) AS y FROM k JOIN (SELECT win - 1 AS win, x[1] AS first FROM k) n ON k.win = n.win) SELECT win AS \"window\", array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y FROM q, m WHERE win < (total - 1) // 128")
def windows(spark, d):
    return tokens.windows(encoded(spark, d)[0], 128).select("window", joined("x"), joined("y"))


BATCH = "h AS (SELECT doc_id AS pos, md5(concat('{}:', doc_id)) AS h FROM documents), r AS (SELECT pos, row_number() OVER (ORDER BY h, pos) - 1 AS r, count(*) OVER () AS n FROM h)"


@query("WITH " + BATCH.format(1338) + " SELECT pos, (r // 32)::BIGINT AS batch, (r % 32)::INT AS slot FROM r WHERE r // 32 < n // 32 AND r // 32 >= 3")
def epoch_batches(spark, d):
    """The second epoch's batches of 32, resumed at the fourth."""
    return tokens.batches(table(spark, d, "documents", F.col("doc_id").alias("pos")), "pos", 32, epoch=1, skip=3)


@query("WITH " + BATCH.format(1337) + " SELECT pos, (r // 32)::BIGINT AS batch, (r % 32)::INT AS slot FROM r")
def fixed_batches(spark, d):
    return tokens.batches(table(spark, d, "documents", F.col("doc_id").alias("pos")), "pos", 32, keep_rest=True)


@query(f"WITH {IDS}, x AS (SELECT CASE WHEN {TRAIN} THEN 'train' WHEN {TRAIN.replace('0.8', '0.9')} THEN 'val' ELSE 'test' END AS split, unnest(list_transform(ids, lambda i: CASE WHEN i < 16000 THEN i ELSE 1 END)) AS id FROM t JOIN documents ON pos = doc_id) SELECT split, count(*) AS n, sum(id)::BIGINT AS total, count(DISTINCT id) AS kinds FROM x GROUP BY split")
def token_files(spark, d):
    """Ids of a vocabulary of 16,000 written as 16-bit files by split and read again: tokens, their sum, and different ones."""
    folder = posix_folder(spark)
    df = sampling.assign_splits(docs(spark, d))
    vocab = cut(tokens.vocabulary(docs(spark, d)).where("token < 16000"))
    token_source.write(df.select("pos", "split").join(tokens.encode_words(df, vocab), "pos"), folder, {"vocab_size": 16_000})
    ids = token_source.read(spark, f"file://{folder}/*.bin").select(F.regexp_extract("file", r"^(\w+)-", 1).alias("split"), F.explode("ids").alias("id"))
    return ids.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("total"), F.count_distinct("id").alias("kinds"))


@query(f"WITH {IDS} SELECT pos, array_to_string(ids[1:64], ' ') AS prefix, array_to_string(ids[65:128], ' ') AS reference FROM t WHERE len(ids) >= 128")
def prefix_reference(spark, d):
    return tokens.prefix_reference(encoded(spark, d)[0]).select("pos", joined("prefix"), joined("reference"))


@query(f"WITH {IDS}, s AS (SELECT pos, ids, unnest(range(0, CASE WHEN len(ids) <= 64 THEN 1 ELSE ceil((len(ids) - 64) / 32)::BIGINT * 32 + 1 END, 32)) AS start FROM t) SELECT pos, start::INT AS start, array_to_string(ids[start + 1:start + 64], ' ') AS \"window\", CASE WHEN start = 0 THEN 0 ELSE 32 END AS first FROM s")
def scoring_windows(spark, d):
    return tokens.scoring_windows(encoded(spark, d)[0], 64, 32).select("pos", "start", joined("window"), "first")


@query("WITH k AS (SELECT doc_id AS pos, length(text) AS n, unnest(range(3)) AS k FROM documents WHERE length(text) >= 64) SELECT pos, k::INT AS k, floor(concat('0x', substr(md5(concat('1337:', pos, ':', k)), 1, 15))::BIGINT / pow(2, 60) * (n - 64 + 1))::BIGINT AS start FROM k")
def window_starts(spark, d):
    return sampling.window_starts(docs(spark, d).withColumn("n", F.length("text")), "n", 64, 3)


# Supervised examples

TOKEN = "list_transform(string_split({}, ' '), lambda w: (concat('0x', substr(md5(w), 1, 7))::BIGINT % 9996 + 4)::INT)"
ROWS = "r AS (SELECT DISTINCT id, split, prompt, answer, answer_position, template, candidates FROM reasoning_examples)"
SFT = f"{ROWS}, s AS (SELECT id, split, {TOKEN.format('prompt')} AS p, {TOKEN.format('answer')} AS a FROM r WHERE prompt <> '' AND answer <> ''), x AS (SELECT id, split, list_concat(p, a) AS input_ids, list_concat(list_transform(range(len(p) - 1), lambda i: -100), list_append(a, 3)) AS target_ids, len(p)::INT AS prompt_len, (len(a) + 1)::INT AS n_supervised FROM s WHERE len(p) + len(a) <= 128)"


def reasoning(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Examples without full duplicates."""
    return table(spark, d, "reasoning_examples", *columns).distinct()


def word_ids(column: str):
    return F.transform(F.split(column, " "), lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % 9996 + 4).cast("int"))


def supervised_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reasoning(spark, d, "id", "split", "prompt", "answer", "answer_position", "template", "candidates").where("prompt <> '' and answer <> ''")
    return supervised.examples(rows.select("id", "split", word_ids("prompt").alias("prompt_ids"), word_ids("answer").alias("answer_ids")), strict=False)


@query(f"WITH {SFT} SELECT id, array_to_string(input_ids, ' ') AS input_ids, array_to_string(target_ids, ' ') AS target_ids, prompt_len, n_supervised FROM x")
def mask_targets(spark, d):
    return supervised_rows(spark, d).select("id", joined("input_ids"), joined("target_ids"), "prompt_len", "n_supervised")


@query(f"WITH {SFT} SELECT count(*) AS n, round(avg(len(input_ids)), 6) AS mean_length, max(len(input_ids))::INT AS max_length, sum(n_supervised)::BIGINT AS supervised FROM x")
def sft_describe(spark, d):
    return supervised.describe(supervised_rows(spark, d))


@query(f"WITH {SFT}, b AS (SELECT *, split AS batch, max(len(input_ids)) OVER (PARTITION BY split) AS width FROM x) SELECT id, batch, array_to_string(list_concat(input_ids, list_transform(range(width - len(input_ids)), lambda i: 0)), ' ') AS input_ids, array_to_string(list_concat(target_ids, list_transform(range(width - len(target_ids)), lambda i: -100)), ' ') AS target_ids FROM b")
def collate(spark, d):
    """Each split as a batch."""
    return supervised.collate(supervised_rows(spark, d).withColumn("batch", F.col("split"))).select("id", "batch", joined("input_ids"), joined("target_ids"))


@query(f"WITH {ROWS} SELECT id, prompt FROM r WHERE split = 'train' AND (prompt IS NULL OR prompt NOT IN (SELECT prompt FROM r WHERE split <> 'train' AND prompt IS NOT NULL))")
def prompt_blocking(spark, d):
    rows = reasoning(spark, d, "id", "split", "prompt", "answer", "answer_position", "template", "candidates")
    return supervised.unblocked(rows.where("split = 'train'"), rows.where("split <> 'train'")).select("id", "prompt")


WC = "len(list_filter(string_split(prompt, ' '), lambda w: w <> ''))"


@query(f"WITH {ROWS}, o AS (SELECT split, count(*) AS n, count(DISTINCT prompt) AS prompts, count(*) FILTER (answer_position >= 0) AS scored, round(avg({WC}), 6) AS mean_words, max({WC})::INT AS max_words, list_sort(list({WC}))[floor(0.95::DOUBLE * (count(*) - 1))::INT + 1]::INT AS p95_words FROM r GROUP BY split), p AS (SELECT split, max(k) AS best FROM (SELECT split, answer_position, count(*) AS k FROM r WHERE answer_position >= 0 GROUP BY ALL) GROUP BY split), a AS (SELECT split, max(k) AS often FROM (SELECT split, answer, count(*) AS k FROM r GROUP BY ALL) GROUP BY split) SELECT o.split, n, prompts, round(best / scored, 6) AS best_position, round(often / n, 6) AS best_answer, mean_words, p95_words, max_words FROM o LEFT JOIN p ON o.split = p.split JOIN a ON o.split = a.split")
def split_stats(spark, d):
    return supervised.split_statistics(reasoning(spark, d, "id", "split", "prompt", "answer", "answer_position", "template", "candidates"))


@query("WITH r AS (SELECT DISTINCT id, prompt, entities FROM reasoning_examples), e AS (SELECT id, prompt, unnest(entities) AS e FROM r), p AS (SELECT id, e, instr(prompt, e) AS place FROM e WHERE instr(prompt, e) > 0) SELECT r.id, coalesce(o, '') AS mentioned FROM r LEFT JOIN (SELECT id, string_agg(e, ' ' ORDER BY place, e) AS o FROM p GROUP BY id) x ON r.id = x.id")
def mention_order(spark, d):
    return reasoning(spark, d, "id", "prompt", "entities").select("id", F.array_join(supervised.mention_order(F.col("prompt"), F.col("entities")), " ").alias("mentioned"))


POOLS = "n AS (SELECT DISTINCT dim_pool AS pool, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS split, unnest(entities) AS name FROM reasoning_examples)"


def pools(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("split") == "train", "train").otherwise("test")
    return table(spark, d, "reasoning_examples").select(F.col("dim_pool").alias("pool"), side.alias("split"), F.explode("entities").alias("name")).distinct()


@query(f"WITH {POOLS} SELECT name FROM n WHERE split = 'train' INTERSECT SELECT name FROM n WHERE split = 'test'")
def shared_names(spark, d):
    return supervised.shared_names(pools(spark, d))


@query(f"WITH {POOLS}, k AS (SELECT DISTINCT pool, name FROM n) SELECT a.pool, a.name AS short, b.name AS long FROM k a JOIN k b ON a.pool = b.pool AND a.name <> b.name AND contains(b.name, a.name)")
def contained_names(spark, d):
    return supervised.contained_names(pools(spark, d)).select("pool", "short", "long")


@query(f"WITH {POOLS} SELECT pool, count(DISTINCT name) AS n FROM n GROUP BY pool HAVING count(DISTINCT name) < 300")
def small_pools(spark, d):
    return supervised.small_pools(pools(spark, d), 300)


#: Dimensions of generated examples.
DIMS = [("ऊँचाई", "people", "लंबा", "छोटा", "ऊँचाई", "सेंटीमीटर", 120, 200), ("वजन", "objects", "भारी", "हल्का", "वजन", "किलो", 2, 60), ("गति", "vehicles", "तेज़", "धीमा", "गति", "किलोमीटर", 10, 90)]


def drawn(spark: SparkSession, d: str, candidates: int, weights: dict | None = None) -> DataFrame:
    """Draws over the names of the test table, which are parted between the splits by hash."""
    names = table(spark, d, "reasoning_examples").select(F.col("dim_pool").alias("pool"), F.explode("entities").alias("name")).distinct()
    names = names.withColumn("split", F.when(F.pmod(F.xxhash64("name"), F.lit(2)) == 0, "train").otherwise("test"))
    dims = spark.createDataFrame(DIMS, "dim string, pool string, big string, small string, noun string, unit string, low int, high int")
    return supervised.generated(dims, names, candidates, weights)


@query()
def generated_examples(spark, d):
    """Examples of the five families of training and, in the test split, of the two held out; prompts of the test table are
    never used."""
    blocked = table(spark, d, "reasoning_examples", "prompt")
    train = supervised.taken(drawn(spark, d, 2000).where("split = 'train'"), 400, blocked)
    test = supervised.taken(drawn(spark, d, 2000, {3: 50, 6: 50}).where("split = 'test'"), 200, blocked)
    return train.unionByName(test)


@query("WITH r AS (SELECT DISTINCT id, split, template, dim, gender, ask FROM reasoning_examples), l AS (SELECT split, unnest([{'c': 'template', 'v': template::VARCHAR}, {'c': 'dim', 'v': dim}, {'c': 'gender', 'v': gender}, {'c': 'ask', 'v': ask}]) AS x FROM r) SELECT split, x.c AS \"column\", x.v AS value, count(*) AS n FROM l GROUP BY ALL")
def split_histograms(spark, d):
    return supervised.split_histograms(reasoning(spark, d, "id", "split", "template", "dim", "gender", "ask"), "template", "dim", "gender", "ask")


# Metrics

SCORED = f"s AS (SELECT *, trim(regexp_replace(nfc_normalize(gold), '{W}+', ' ', 'g')) AS g, trim(regexp_replace(nfc_normalize(generated), '{W}+', ' ', 'g')) AS h FROM scored_examples), a AS (SELECT *, coalesce(g = h AND g <> '', false) AS is_exact, coalesce(starts_with(h, g) AND g <> '', false) AS is_prefix FROM s)"


@query(f"WITH {SCORED} SELECT score_id, is_exact, is_prefix FROM a")
def answer_scores(spark, d):
    return metrics.answer_scores(table(spark, d, "scored_examples")).select("score_id", "is_exact", "is_prefix")


@query(f"WITH {SCORED} SELECT template, count(*) AS n, round(avg(is_exact::INT), 6) AS is_exact, round(avg(is_prefix::INT), 6) AS is_prefix FROM a GROUP BY ROLLUP (template)")
def accuracy_by_template(spark, d):
    return metrics.accuracy(metrics.answer_scores(table(spark, d, "scored_examples")), "is_exact", "is_prefix")


@query("WITH s AS (SELECT score_id, candidates AS c, logprobs AS l, list_transform(range(1, len(logprobs) + 1), lambda i: logprobs[i] / greatest(length(candidates[i]), 1)) AS m FROM scored_examples) SELECT score_id, CASE WHEN len(c) = len(l) THEN c[list_position(l, list_max(l))] END AS best, CASE WHEN len(c) = len(l) THEN c[list_position(m, list_max(m))] END AS best_normalized FROM s")
def rank_candidates(spark, d):
    return metrics.ranked(table(spark, d, "scored_examples")).select("score_id", "best", "best_normalized")


@query(f"WITH {ROWS}, o AS (SELECT count(*) AS n, avg(1 / len(candidates)) AS random, count(*) FILTER (answer_position >= 0) AS scored FROM r), p AS (SELECT max(k) AS best FROM (SELECT count(*) AS k FROM r WHERE answer_position >= 0 GROUP BY answer_position)), a AS (SELECT max(k) AS often FROM (SELECT count(*) AS k FROM r GROUP BY answer)) SELECT round(random, 6) AS random, round(best / n, 6) AS position_of_all, round(best / scored, 6) AS position_of_scored, round(often / n, 6) AS majority FROM o, p, a")
def reasoning_baselines(spark, d):
    return metrics.baselines(reasoning(spark, d, "id", "split", "prompt", "answer", "answer_position", "template", "candidates"))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scored_examples", F.col("score_id").alias("id"), F.coalesce("generated", F.lit("")).alias("hypothesis"), F.coalesce("gold", F.lit("")).alias("reference"))


def intl(column: str) -> str:
    return split(rf"regexp_replace(regexp_replace(regexp_replace({column}, '(\P{{N}})(\p{{P}})', '\1 \2 ', 'g'), '(\p{{P}})(\P{{N}})', ' \1 \2', 'g'), '(\p{{S}})', ' \1 ', 'g')")


def grams(items: str, n: int) -> str:
    return f"list_transform(range(1, len({items}) - {n} + 2), lambda i: array_to_string({items}[i:i + {n} - 1], chr(31)))"


def clipped(pairs: str, orders: int, name: str, by: str = "1") -> str:
    """SQL of the sums of n-grams of tables of (id, h, r) by order."""
    parts = " UNION ALL ".join(f"SELECT {by} AS grp, id, {n} AS k, {grams('h', n)} AS h, {grams('r', n)} AS r FROM {pairs}" for n in range(1, orders + 1))
    return f"""{name}_g AS ({parts}), {name}_h AS (SELECT grp, id, k, g, count(*) AS c FROM (SELECT grp, id, k, unnest(h) AS g FROM {name}_g) GROUP BY ALL), {name}_r AS (SELECT grp, id, k, g, count(*) AS c FROM (SELECT grp, id, k, unnest(r) AS g FROM {name}_g) GROUP BY ALL),
{name}_m AS (SELECT x.grp, x.k, sum(least(x.c, y.c)) AS m FROM {name}_h x JOIN {name}_r y USING (grp, id, k, g) GROUP BY ALL),
{name} AS (SELECT z.grp, z.k, coalesce(max(m), 0) AS m, sum(len(h)) AS h, sum(len(r)) AS r, sum(CASE WHEN len(r) > 0 THEN len(h) ELSE 0 END) AS a FROM {name}_g z LEFT JOIN {name}_m q ON q.grp = z.grp AND q.k = z.k GROUP BY z.grp, z.k)"""


def bleu_sql(name: str) -> str:
    return f"SELECT grp, round(CASE WHEN min(h) = 0 OR sum(m) = 0 THEN 0 ELSE 100 * exp(sum(ln(CASE WHEN m = 0 THEN 1 / pow(2, zeros) ELSE m END / h)) / 4) * CASE WHEN max(h) FILTER (k = 1) >= max(r) FILTER (k = 1) THEN 1 ELSE exp(1 - max(r) FILTER (k = 1) / max(h) FILTER (k = 1)) END END, 6) AS bleu FROM (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY grp ORDER BY k) AS zeros FROM {name}) GROUP BY grp"


CHRF_WORDS = "flatten(list_transform({}, lambda w: CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(w[-1], '[!-/:-@\\[-`{{-~]') THEN [w[:-2], w[-1]] WHEN regexp_matches(w[1], '[!-/:-@\\[-`{{-~]') THEN [w[1], w[2:]] ELSE [w] END))"
LETTERS = f"list_transform(range(1, length({{0}}) + 1), lambda i: substr({{0}}, i, 1))"
BARE = "regexp_replace({}, '" + W.replace("{", "{{").replace("}", "}}") + "', '', 'g')"


def chrf_sql(chars: str, words: str) -> str:
    return f"SELECT grp, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM (SELECT grp, avg(m / a) FILTER (a > 0 AND r > 0) AS p, avg(m / r) FILTER (a > 0 AND r > 0) AS r FROM (SELECT * FROM {chars} UNION ALL SELECT * FROM {words}) GROUP BY grp)"


PAIRS = "o AS (SELECT score_id AS id, run, coalesce(generated, '') AS h, coalesce(gold, '') AS r FROM scored_examples)"
BLEU_PAIRS = f"bo AS (SELECT id, run, {intl('h')} AS h, {intl('r')} AS r FROM o)"
CHAR_PAIRS = f"co AS (SELECT id, run, {LETTERS.format(BARE.format('h'))} AS h, {LETTERS.format(BARE.format('r'))} AS r FROM o)"
WORD_PAIRS = f"wo AS (SELECT id, run, {CHRF_WORDS.format(split('h'))} AS h, {CHRF_WORDS.format(split('r'))} AS r FROM o)"
# The longest common subsequence word by word: a row of lengths, made new for each word of the hypothesis.
ROUGE = f"""ro AS (SELECT id, run, {split('h')} AS a, {split('r')} AS b FROM o),
rr AS (SELECT id, 0 AS i, a, b, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM ro WHERE len(a) > 0 AND len(b) > 0
UNION ALL SELECT id, i + 1, a, b, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k > 0 AND b[k] = a[i + 1] THEN row[k] + 1 ELSE row[k + 1] END))) FROM rr WHERE i < len(a)),
rl AS (SELECT ro.id, run, coalesce(row[-1], 0) AS n, len(ro.a) AS na, len(ro.b) AS nb FROM ro LEFT JOIN rr ON rr.id = ro.id AND rr.i = len(ro.a)),
rs AS (SELECT id, run, CASE WHEN n > 0 THEN n / na ELSE 0 END AS p, CASE WHEN n > 0 THEN n / nb ELSE 0 END AS r, CASE WHEN n > 0 THEN 2 * n / (na + nb) ELSE 0 END AS f FROM rl)"""


@query(f"WITH {PAIRS}, {BLEU_PAIRS}, {clipped('bo', 4, 'b')} SELECT bleu FROM ({bleu_sql('b')})")
def bleu4(spark, d):
    return metrics.bleu(outputs(spark, d), metrics.intl_tokens(F.col("hypothesis")), metrics.intl_tokens(F.col("reference")))


@query(f"WITH {PAIRS}, {CHAR_PAIRS}, {WORD_PAIRS}, {clipped('co', 6, 'c')}, {clipped('wo', 2, 'w')} SELECT chrf FROM ({chrf_sql('c', 'w')})")
def chrf_pp(spark, d):
    return metrics.chrf(outputs(spark, d))


@query(f"WITH RECURSIVE {PAIRS}, {ROUGE} SELECT count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f FROM rs")
def rouge_l(spark, d):
    scored = outputs(spark, d).select(metrics.rouge_l("hypothesis", "reference").alias("x"))
    return scored.agg(F.count("*").alias("n"), F.round(F.avg("x.p"), 6).alias("precision"), F.round(F.avg("x.r"), 6).alias("recall"), F.round(F.avg("x.f"), 6).alias("f"))


DISTINCT = "(SELECT run, g, count(*) AS n FROM (SELECT run, unnest({}) AS g FROM ro) GROUP BY ALL)"
RUNS = "SELECT run, max(n) AS max_run FROM (SELECT run, id, x, island, count(*) AS n FROM (SELECT run, id, x, i - row_number() OVER (PARTITION BY id, x ORDER BY i) AS island FROM (SELECT run, id, unnest(a) AS x, unnest(range(len(a))) AS i FROM ro)) GROUP BY ALL) GROUP BY run"


@query(f"WITH RECURSIVE {PAIRS}, {BLEU_PAIRS}, {CHAR_PAIRS}, {WORD_PAIRS}, {ROUGE}, {clipped('bo', 4, 'b', 'run')}, {clipped('co', 6, 'c', 'run')}, {clipped('wo', 2, 'w', 'run')}, s AS (SELECT run, count(*) AS n, round(avg(f), 6) AS rouge_l FROM rs GROUP BY run), l AS (SELECT run, round(avg(len(a)), 6) AS words FROM ro GROUP BY run) SELECT s.run, s.n, bleu, chrf, rouge_l, round(coalesce(d1, 0), 6) AS distinct_1, round(coalesce(d2, 0), 6) AS distinct_2, round(coalesce(1 - d4, 0), 6) AS repetition_4, max_run::INT AS max_run, words FROM s JOIN l ON l.run = s.run JOIN ({bleu_sql('b')}) x ON x.grp = s.run JOIN ({chrf_sql('c', 'w')}) y ON y.grp = s.run JOIN ({RUNS}) z ON z.run = s.run LEFT JOIN (SELECT run, count(*) / sum(n) AS d1 FROM {DISTINCT.format('a')} GROUP BY run) u ON u.run = s.run LEFT JOIN (SELECT run, count(*) / sum(n) AS d2 FROM {DISTINCT.format(grams('a', 2))} GROUP BY run) v ON v.run = s.run LEFT JOIN (SELECT run, count(*) / sum(n) AS d4 FROM {DISTINCT.format(grams('a', 4))} GROUP BY run) w4 ON w4.run = s.run")
def generation_summary(spark, d):
    """By run, as the setting."""
    rows = table(spark, d, "scored_examples", "score_id", "run", F.coalesce("generated", F.lit("")).alias("hypothesis"), F.coalesce("gold", F.lit("")).alias("reference"))
    return metrics.generation_summary(rows, "run")


GRAMS = f"t AS (SELECT {split('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS ngram FROM t WHERE len(w) >= 4), c AS (SELECT ngram, count(*) AS n FROM g GROUP BY ngram)"


def word_rows(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("pos", T.words(F.col("text")).alias("items"))


@query(f"WITH {GRAMS} SELECT round(count(*) / sum(n), 6) AS distinct, round(1 - count(*) / sum(n), 6) AS repetition FROM c")
def distinct_and_repetition(spark, d):
    return metrics.distinct_share(word_rows(spark, d), "items", 4)


@query(f"WITH {GRAMS} SELECT ngram, n FROM c ORDER BY n DESC, ngram LIMIT 20")
def top_ngrams(spark, d):
    """The 20 most frequent: the limit is the feature."""
    return metrics.top_ngrams(word_rows(spark, d), "items", 4, 20)


@query(f"WITH w AS (SELECT doc_id AS pos, unnest({split('text')}) AS x, unnest(range(len({split('text')}))) AS i FROM documents WHERE text IS NOT NULL), g AS (SELECT pos, x, i - row_number() OVER (PARTITION BY pos, x ORDER BY i) AS island FROM w), r AS (SELECT pos, max(n) AS run FROM (SELECT pos, x, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY pos) SELECT doc_id AS pos, coalesce(run, 0) AS run FROM documents LEFT JOIN r ON doc_id = pos WHERE text IS NOT NULL")
def max_run(spark, d):
    return metrics.longest_run(word_rows(spark, d), "pos", "items")


@query(f"WITH w AS (SELECT split, unnest({split('text')}) AS token FROM split_docs WHERE text IS NOT NULL), tr AS (SELECT token, count(*) AS n FROM w WHERE split = 'train' GROUP BY token), te AS (SELECT token, count(*) AS n FROM w WHERE split = 'test' GROUP BY token), v AS (SELECT count(DISTINCT token) AS size FROM w), t AS (SELECT sum(n) AS total FROM tr), k AS (SELECT sum(-ln((coalesce(tr.n, 0) + 1) / (total + size)) * te.n) / sum(te.n) AS ce FROM te LEFT JOIN tr ON te.token = tr.token, v, t) SELECT round(ce, 6) AS cross_entropy, round(exp(least(ce, 30)), 6) AS perplexity FROM k")
def unigram_baseline(spark, d):
    words = cut(table(spark, d, "split_docs", "split", F.explode(T.words(F.col("text"))).alias("token")).groupBy("split", "token").agg(F.count("*").alias("n")))
    size = words.select("token").distinct().count()
    return metrics.unigram_baseline(words.where("split = 'train'"), words.where("split = 'test'"), size)


NATS = "e AS (SELECT score_id AS id, -unnest(logprobs) AS nats, unnest(range(len(logprobs))) AS place, len(logprobs) AS n FROM scored_examples WHERE logprobs IS NOT NULL)"


def nats(spark: SparkSession, d: str) -> DataFrame:
    """The outputs' log probabilities as a table of scored places, the last of each row as its end."""
    return table(spark, d, "scored_examples", F.col("score_id").alias("id"), F.posexplode("logprobs").alias("place", "lp"), F.size("logprobs").alias("n")).select("id", "place", (-F.col("lp")).alias("nats"), (F.col("place") == F.col("n") - 1).alias("is_end"))


@query(f"WITH {NATS} SELECT count(nats) AS tokens, round(avg(nats), 6) AS cross_entropy, round(exp(least(avg(nats), 30)), 6) AS perplexity FROM e")
def packed_perplexity(spark, d):
    return metrics.packed_perplexity(nats(spark, d))


@query(f"WITH {NATS}, b AS (SELECT sum(strlen(gold)) AS n_bytes FROM scored_examples) SELECT round((SELECT sum(nats) / ln(2) FROM e WHERE place < n - 1) / n_bytes, 6) AS bits_per_byte FROM b")
def bits_per_byte(spark, d):
    return metrics.bits_per_byte(nats(spark, d), table(spark, d, "scored_examples").agg(F.sum(F.octet_length("gold")).alias("n_bytes")))


@query(f"WITH {NATS} SELECT id, round(sum(-nats) FILTER (place >= 1), 6) AS log_likelihood, round(avg(-nats) FILTER (place >= 1), 6) AS mean_log_likelihood FROM e GROUP BY id")
def sequence_scores(spark, d):
    return metrics.sequence_score(nats(spark, d), 1)


# Attention: causal weights of 8 rows made of the embeddings' absolute values

CELLS = "c0 AS (SELECT vec_id AS seq, vec_id % 3 AS layer, vec_id // 3 % 4 AS head, embedding AS e FROM embeddings), c1 AS (SELECT *, unnest(range(8)) AS t FROM c0), c2 AS (SELECT *, unnest(range(t + 1)) AS j FROM c1), c3 AS (SELECT seq, layer, head, t, j, abs(e[t * 8 + j + 1]::DOUBLE) + 0.001::DOUBLE AS a FROM c2), c4 AS (SELECT seq, layer, head, t, j, a / sum(a) OVER (PARTITION BY seq, t) AS w FROM c3)"
HEADS = """a1 AS (SELECT {} seq, layer, head, t, sum(CASE WHEN w > 0 THEN -w * ln(w) ELSE 0 END) AS en, sum(w * (t - j)) AS di, sum(CASE WHEN j = t - 1 THEN w ELSE 0 END) AS pr, sum(CASE WHEN j = 0 THEN w ELSE 0 END) AS si FROM c4 {} GROUP BY seq, layer, head, t),
a2 AS (SELECT seq, layer, head, avg(en) AS entropy, avg(en / ln(t + 1)) FILTER (t >= 1) AS normalized_entropy, avg(di) AS mean_distance, avg(di / t) FILTER (t >= 1) AS normalized_distance, avg(pr) FILTER (t >= 1) AS previous_token_rate, avg(si) FILTER (t >= 1) AS sink_rate FROM a1 GROUP BY seq, layer, head),
heads AS (SELECT layer, head, round(avg(entropy), 6) AS entropy, round(avg(normalized_entropy), 6) AS normalized_entropy, round(avg(mean_distance), 6) AS mean_distance, round(avg(normalized_distance), 6) AS normalized_distance, round(avg(previous_token_rate), 6) AS previous_token_rate, round(avg(sink_rate), 6) AS sink_rate FROM a2 GROUP BY layer, head)"""
CLASS = "CASE WHEN sink_rate > 0.3 THEN 'sink' WHEN normalized_distance < 0.15 AND previous_token_rate > 0.3 THEN 'local/positional' WHEN normalized_entropy > 0.4 THEN 'content-based' ELSE 'mixed' END"


def attention(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", F.col("vec_id").alias("seq"), F.col("embedding").alias("e"))
    cells = rows.select("seq", (F.col("seq") % 3).alias("layer"), (F.floor(F.col("seq") / 3) % 4).alias("head"), "e", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("t")).withColumn("all", F.aggregate(F.slice("e", F.col("t") * 8 + 1, F.col("t") + 1), F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")) + 0.001))
    return cells.select("seq", "layer", "head", "t", "all", F.posexplode(F.slice("e", F.col("t") * 8 + 1, F.col("t") + 1)).alias("j", "x")).select("seq", "layer", "head", "t", "j", ((F.abs(F.col("x").cast("double")) + 0.001) / F.col("all")).alias("w"))


@query(f"WITH {CELLS}, {HEADS.format('', '')} SELECT * FROM heads")
def attention_heads(spark, d):
    return metrics.attention_heads(attention(spark, d))


@query(f"WITH {CELLS}, {HEADS.format('', '')} SELECT {CLASS} AS class, count(*) AS n FROM heads GROUP BY 1")
def head_taxonomy(spark, d):
    return metrics.attention_heads(attention(spark, d)).groupBy(metrics.head_class().alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, {HEADS.format('', '')} SELECT layer, round(avg(entropy), 6) AS entropy, round(avg(sink_rate), 6) AS sink_rate FROM heads GROUP BY ROLLUP (layer)")
def layer_means(spark, d):
    return metrics.layer_means(metrics.attention_heads(attention(spark, d)), "entropy", "sink_rate")


def both_halves(spark: SparkSession, d: str) -> DataFrame:
    """after - before, with every other dozen of sequences as before, the rest as after."""
    cells = cut(attention(spark, d))
    return metrics.deltas(metrics.attention_heads(cells.where("floor(seq / 12) % 2 = 0")), metrics.attention_heads(cells.where("floor(seq / 12) % 2 = 1")), "entropy", "sink_rate")


def half(n: int) -> str:
    return HEADS.format("", f"WHERE seq // 12 % 2 = {n}").replace("a1 ", f"a1_{n} ").replace("a2 ", f"a2_{n} ").replace("FROM a1_", "FROM a1_").replace("heads AS", f"heads_{n} AS")


DELTA = f"{CELLS}, {half(0)}, {half(1)}, dl AS (SELECT x.layer, x.head, round(y.entropy - x.entropy, 6) AS entropy, round(y.sink_rate - x.sink_rate, 6) AS sink_rate FROM heads_0 x JOIN heads_1 y ON x.layer = y.layer AND x.head = y.head)"


@query(f"WITH {DELTA} SELECT * FROM dl")
def delta_cells(spark, d):
    return both_halves(spark, d)


@query(f"WITH {DELTA} SELECT layer, head, entropy FROM dl ORDER BY abs(entropy) DESC, layer, head LIMIT 1")
def largest_change(spark, d):
    return metrics.largest_change(both_halves(spark, d), "entropy")


@query(f"WITH {SFT}, p AS (SELECT unnest(target_ids) AS t, unnest(list_transform(target_ids, lambda x: CASE WHEN x % 3 = 0 THEN x + 1 ELSE x END)) AS q FROM x) SELECT count(*) AS supervised, round(avg((t = q)::INT), 6) AS accuracy FROM p WHERE t <> -100")
def teacher_forced(spark, d):
    """Predictions that miss every third id."""
    rows = supervised_rows(spark, d).select(F.col("target_ids").alias("targets"), F.transform("target_ids", lambda x: F.when(x % 3 == 0, x + 1).otherwise(x)).alias("predictions"))
    return metrics.teacher_forced(rows)


@query("SELECT doc_id AS step, n_chars AS loss FROM documents WHERE doc_id < 500 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id >= 500")
def log_resume(spark, d):
    """A log cut at step 500 and written on."""
    log = table(spark, d, "documents", F.col("doc_id").alias("step"), F.col("n_chars").alias("loss"))
    return metrics.resumed(log, 500, log.where("step >= 500").withColumn("loss", F.lit(-1).cast("bigint")))


@query("WITH s AS (SELECT unnest(range(1000)) AS step) SELECT step, round(CASE WHEN step < 100 THEN 0.0006::DOUBLE * (step + 1) / 100 ELSE 0.00006::DOUBLE + 0.5 * (1 + cos(pi() * least((step - 100) / 900, 1))) * (0.0006::DOUBLE - 0.00006::DOUBLE) END, 9) AS lr FROM s")
def lr_schedule(spark, d):
    return metrics.learning_rates(spark, 1000, 100, 6e-4, 6e-5)


@query("WITH c(name, v, d, f, l, t, b, p, o) AS (VALUES ('small', 10000, 384, 1536, 8, 256, false, true, true), ('large', 16000, 512, 2048, 12, 512, true, false, false)), k AS (SELECT *, (4 * d * d + CASE WHEN b THEN 4 * d ELSE 0 END + 2 * d * f + f + d + 4 * d) * l AS blocks, CASE WHEN p THEN t * d ELSE 0 END AS positions, CASE WHEN o THEN 0 ELSE v * d END AS head FROM c) SELECT name, (v * d)::BIGINT AS embedding, positions::BIGINT AS positions, blocks::BIGINT AS blocks, (2 * d)::BIGINT AS norm, head::BIGINT AS head, (v * d + positions + blocks + 2 * d + head)::BIGINT AS total FROM k")
def param_budget(spark, d):
    return metrics.parameters(spark, [("small", 10_000, 384, 1536, 8, 256, False, True, True), ("large", 16_000, 512, 2048, 12, 512, True, False, False)])


@query("WITH s AS (SELECT doc_id AS step, 0.1::DOUBLE + (doc_id % 7) / 100 AS seconds, n_chars::DOUBLE AS loss FROM documents), t AS (SELECT * FROM s WHERE step >= (SELECT min(step) FROM s) + 5) SELECT count(*) AS steps_timed, round(avg(seconds), 6) AS seconds_per_step, round(8192 / avg(seconds), 4) AS tokens_per_second, round(avg(loss), 6) AS mean_loss, round(avg(seconds) * 1875 / 3600, 6) AS projected_hours FROM t")
def throughput(spark, d):
    """Of a table of steps, here made of the documents' numbers."""
    steps = table(spark, d, "documents", F.col("doc_id").alias("step"), (F.lit(0.1) + (F.col("doc_id") % 7) / 100).alias("seconds"), F.col("n_chars").cast("double").alias("loss"))
    return metrics.throughput(steps, 8192, 1875)


@query(f"WITH {IDS} SELECT pos, array_to_string(ids, ' ') AS ids FROM t WHERE len(ids) <= 64 ORDER BY pos LIMIT 64")
def short_sequences(spark, d):
    """The first 64 of at most 64 tokens: the limit is the feature."""
    return metrics.short_sequences(encoded(spark, d)[0], "ids", 64, 64).select("pos", joined("ids"))

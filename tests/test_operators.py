"""Operators on small tables, with properties and brute force where there is no SQL."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarit.operators import cleaning, frontier, lid, metrics, near_dedup, ngram, quantiles, sampling, statistics, subwords, supervised, tokens

HI = "सरकारी परियोजना के अनुसार रामपुर में खेत अब भी नदी पर निर्भर हैं।"


def docs(spark, texts, source="a", manual=False):
    return spark.createDataFrame([(i, t, source, manual) for i, t in enumerate(texts)], "pos bigint, text string, source string, manual boolean")


def test_quality_reasons_in_order(spark):
    params = cleaning.QualityParams(min_words=3, max_words=40, max_repeated=0.25)
    texts = ["%PDF x", None, "", "एक दो", "क " * 50, "one two three four", "एक दो तीन\nएक दो तीन", HI]
    got = [r.reason for r in cleaning.with_reason(docs(spark, texts), params).orderBy("pos").collect()]
    assert got == ["binary_payload", "too_short", "too_short", "too_short", "too_long", "low_script_ratio", "repetitive_lines", None]


def test_quality_and_boilerplate_by_origin(spark):
    df = docs(spark, [HI], manual=True).unionByName(docs(spark, [HI]))
    assert [r.reason for r in cleaning.with_reason_by_origin(df).orderBy(F.desc("manual")).collect()] == [None, "too_short"]
    same = docs(spark, [f"notice\ntext {i}" for i in range(60)])
    df = same.withColumn("manual", F.lit(True)).unionByName(same)
    got = cleaning.strip_manual_boilerplate(df).collect()
    assert {(r.manual, r.text) for r in got} == {(m, f"text {i}" if m else f"notice\ntext {i}") for i in range(60) for m in (True, False)}


def test_first_of_copies_and_ids(spark):
    df = docs(spark, ["a  b", "a b", None, "c", "a b "])
    assert [r.pos for r in cleaning.exact_dedup(df).orderBy("pos").collect()] == [0, 3]
    assert [r.pos for r in cleaning.first_positions(df).orderBy("pos").collect()] == [0, 3]
    ids = spark.createDataFrame([(0, "x", None), (1, "x", "u"), (2, "", "u"), (3, None, "u"), (4, None, None), (5, "", None)], "pos bigint, id string, url string")
    assert [r.pos for r in cleaning.id_dedup(ids, "id", "url").orderBy("pos").collect()] == [0, 2, 4, 5]
    assert [tuple(r) for r in cleaning.dup_groups(df).collect()] == [(0, 3)]


def test_boilerplate(spark):
    df = docs(spark, [f"notice\n\ntext {i}" for i in range(100)] + [None, "notice"])
    assert [(r.line, r.n) for r in cleaning.boilerplate(df).collect()] == [("notice", 101)]
    for most in (cleaning.MOST_LINES, 0):
        kept = cleaning.strip_boilerplate(df, most=most).orderBy("pos").collect()
        assert [r.text for r in kept] == [f"text {i}" for i in range(100)]


def test_language_scores(spark):
    words = spark.createDataFrame([("hi", "के"), ("hi", "में"), ("en", "the"), ("en", "of")], "lang string, word string")
    got = {r.pos: (r.label, r.prob) for r in cleaning.language_scores(docs(spark, ["के में the", "The OF", "x", None, "the के"]), words).collect()}
    assert got == {0: ("hi", pytest.approx(2 / 3)), 1: ("en", 1.0), 4: ("en", 0.5)}


def test_languages_by_a_join(spark, monkeypatch):
    words = spark.createDataFrame([("hi", "के"), ("hi", "the"), ("en", "the"), ("en", "of"), (None, "x"), ("en", None)], "lang string, word string")
    df = docs(spark, ["के the", "The OF the", "x", None, "के of", ""])
    want = {(r.pos, r.label, r.prob) for r in cleaning.language_scores(df, words).collect()}
    monkeypatch.setattr(cleaning, "MOST_WORDS", 2)
    assert {(r.pos, r.label, r.prob) for r in cleaning.language_scores(df, words).collect()} == want and len(want) == 3


def test_language_of_the_whole_text(spark):
    words = spark.createDataFrame([("hi", "के"), ("en", "the")], "lang string, word string")
    df = docs(spark, ["के " + "x" * 1000 + " the the the"])
    assert [(r.label, r.prob) for r in cleaning.language_scores(df, words).collect()] == [("en", 0.75)]
    assert cleaning.language_filter(df, words, F.lit("hi")).count() == 0


def test_band_geometry():
    for threshold in (0.5, 0.8, 0.9):
        params = near_dedup.NearDupParams(threshold=threshold)
        bands, rows = near_dedup.geometry(params)
        assert bands * rows <= params.places and 1 - (1 - threshold**rows) ** bands >= params.recall
    assert near_dedup.geometry(near_dedup.NearDupParams()) == (24, 5)


def test_signatures_agree_as_often_as_texts_are_similar():
    """Texts of few and of many shingles; places of the same text without words are all ones."""
    random.seed(8)
    signer = near_dedup.Signer(near_dedup.NearDupParams())
    for n in (9, 60, 2000):
        same = []
        for _ in range(60):
            base = [f"w{random.random()}" for _ in range(n)]
            values, sizes = signer.shingles([" ".join(base), " ".join([*base, "x"])])
            a, b = (set(v.tolist()) for v in np.split(values, np.cumsum(sizes)[:-1]))
            one, two = signer.signatures(values, sizes)
            same.append((one == two).mean() - len(a & b) / len(a | b))
        assert abs(np.mean(same)) < 0.03
    values, sizes = signer.shingles(["", "a b"])
    empty, short = signer.signatures(values, sizes)
    assert set(empty.tolist()) == {(1 << 64) - 1} and len(set(short.tolist())) == 1


def test_shingles_by_brute_force():
    from sarit.functions.hashing import shingles

    texts = ["", "a b", "a b c d e f", "F a b c d e f a b c d e f", "a b"]
    values, sizes = shingles(texts, 5)
    parts = [set(v.tolist()) for v in np.split(values, np.cumsum(sizes)[:-1])]
    words = [t.lower().split() for t in texts]
    runs = [{tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))} for w in words]
    assert [len(p) for p in parts] == [len(r) for r in runs]
    for i in range(len(texts)):
        for k in range(len(texts)):
            assert len(parts[i] & parts[k]) == len(runs[i] & runs[k])


def test_greedy_keeps_the_end_of_a_chain(spark):
    """A is near to B, B to C: B is dropped, C isn't; by tasks and by rounds alike."""
    random.seed(4)
    pairs = {(1, 2), (2, 3), (7, 9)} | {tuple(sorted(random.sample(range(20, 60), 2))) for _ in range(60)}
    df = spark.createDataFrame(sorted(pairs), "low bigint, high bigint")
    want = {}
    for pos in sorted({p for x in pairs for p in x}):
        want[pos] = not any(want[a] for a, b in pairs if b == pos)
    assert (want[1], want[2], want[3]) == (True, False, True)
    for most in (near_dedup.LINKS, 1, 0):
        assert {r.pos: r.kept for r in near_dedup.chosen(df, most).collect()} == want


def test_one_large_bucket(spark, monkeypatch):
    """Many texts of one class and some that only share its bucket; salted."""
    monkeypatch.setattr(near_dedup, "SALTED", 3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]] if i % 2 else [*base, f"y{i}"]) for i in range(40)]
    df = docs(spark, texts)
    assert {r["class"] for r in near_dedup.classes(df).collect()} == {0}


def test_verified_near_duplicates_by_brute_force(spark):
    """All pairs of similarity 0.8 and no others, long texts and words put in at their start among them."""
    random.seed(5)
    texts = [None, "", " ", "x y", "X  y"]
    for i in range(25):
        base = [f"w{i}_{random.randint(0, 900)}" for _ in range(3000 if i == 0 else random.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in random.sample(range(len(copy)), 1 if len(copy) < 80 else random.choice([1, 2, 3])):
                copy[at] = "neu"
            texts.append(" ".join(["first", *copy] if i == 0 else copy))
            base = copy
    sets = {}
    for pos, text in enumerate(texts):
        if text is not None:
            words = text.lower().split()
            k = min(5, len(words))
            sets[pos] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()
    near = {(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9)}
    first = {p: p for p in sets}
    for _ in texts:
        for a, b in near:
            first[a] = first[b] = min(first[a], first[b])
    kept = {}
    for p in sorted(sets):
        kept[p] = not any(kept[a] for a, b in near if b == p)
    df = docs(spark, texts)
    assert {(r.pos, r.canonical) for r in near_dedup.class_duplicates(df).collect()} == {(p, c) for p, c in first.items() if c < p}
    assert {r.pos: r.kept for r in near_dedup.greedy(df).collect()} == kept
    least = {p: min([a for a, b in near if b == p], default=p) for p in sets}
    assert {(r.pos, r.canonical) for r in near_dedup.marked(df).collect()} == {(p, c) for p, c in least.items() if c < p}
    assert len(near) > 20


def test_running_total(spark):
    df = spark.createDataFrame([(i * i * 37, i % 7) for i in range(500)], "pos bigint, n int").repartition(5)
    total = 0
    for r in ngram.running_total(df, "pos", "n", 16).orderBy("pos").collect():
        assert r.before == total
        total += r.n


def test_token_budget_ends_after_the_document_that_reaches_it(spark):
    df = docs(spark, ["a b c", "d e", "f", "g"])
    params = ngram.PerplexityParams(max_tokens=4)
    assert [r.pos for r in ngram.training_documents(df, params).orderBy("pos").collect()] == [0, 1]
    assert [r.pos for r in ngram.training_documents(df, ngram.PerplexityParams(max_docs=3)).orderBy("pos").collect()] == [0, 1, 2]


def test_perplexity_by_hand(spark):
    train = docs(spark, ["a b a b", "a c"])
    got = {r.pos: r.perplexity for r in ngram.Model(train).scores(docs(spark, ["a b", "z", "", None])).collect()}
    first = math.log(0.4) + math.log((3 + 1) / (6 + 3))
    assert got[0] == pytest.approx(math.exp(-(first + math.log(2 / 3)) / 2))
    assert got[1] == pytest.approx(math.exp(-(math.log(0.4) + math.log(1 / 9))))
    assert got[2] == math.inf and 3 not in got


def test_perplexity_of_a_model_in_parts(spark):
    """What of the model goes to the executors doesn't matter, nor does the place of a text."""
    random.seed(6)
    texts = [" ".join(random.choice("abcdefghij") * random.choice([1, 1, 2]) for _ in range(random.randint(0, 30))) for _ in range(60)] + [None, ""]
    df = docs(spark, texts)
    model = ngram.Model(df)
    want = {r.pos: r.perplexity for r in model.scores(df).collect()}
    assert model.complete
    for most in (0, 5, 40):
        part = ngram.Model(df, most=most)
        assert not part.complete
        assert {r.pos: r.perplexity for r in part.scores(df).collect()} == pytest.approx(want)
    unseen = docs(spark, ["zz zz zz a b", "q"])
    assert {r.pos: r.perplexity for r in ngram.Model(df, most=5).scores(unseen).collect()} == pytest.approx({r.pos: r.perplexity for r in model.scores(unseen).collect()})


def test_perplexity_bounds(spark):
    train = docs(spark, ["a b"])
    texts = docs(spark, ["a b " * 150, "a b " * 150 + "z " * 300])
    got = {r.pos: r.perplexity for r in ngram.Model(train).scores(texts).collect()}
    assert got[1] > got[0]
    got = {r.pos: r.perplexity for r in ngram.Model(train, ngram.BOUNDED).scores(texts).collect()}
    assert got[1] == pytest.approx(got[0])
    scores = spark.createDataFrame([(i, float(i % 2)) for i in range(400_000)], "pos bigint, perplexity double")
    assert ngram.cutoff(scores) == 1.0 and ngram.cutoff(scores, ngram.BOUNDED) == 0.0
    assert ngram.cutoff(scores, ngram.PerplexityParams(max_perplexity=7.0)) == 7.0
    params = ngram.PerplexityParams()
    assert params.max_docs is None and params.max_tokens is None and params.max_words is None


def test_perplexity_filter_without_a_model(spark):
    df = docs(spark, ["", " "])
    assert ngram.perplexity_filter(df).count() == 2
    assert ngram.perplexity_filter(docs(spark, ["a b", "", None]), reference=docs(spark, [""])).count() == 1


def test_quantiles(spark):
    random.seed(7)
    for values in ([1.5], [3.0] * 9, [random.gauss(0, 5) for _ in range(500)], [random.choice([1.0, 2.0, 9.0]) for _ in range(200)], [10 ** random.uniform(-3, 6) for _ in range(301)]):
        df = spark.createDataFrame([(v,) for v in [*values, math.inf, math.nan, None]], "x double")
        shares = [0.0, 0.05, 0.5, 0.731, 1.0]
        for most in (quantiles.SORTED, 0):
            assert quantiles.quantiles(df, "x", shares, most) == pytest.approx([float(np.quantile(values, s)) for s in shares])
    assert quantiles.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]
    df = docs(spark, ["x"] * 50)
    assert [r.pos for r in quantiles.first_in_order(df, "pos", 7).orderBy("pos").collect()] == list(range(7))
    assert quantiles.first_in_order(df, "pos", 99).count() == 50


def test_character_model(spark):
    samples = spark.createDataFrame([(0, " HI ", "यह पानी है"), (1, "en", "the water is here"), (2, None, "x"), (3, "en", None)], "sample_id int, lang string, text string")
    model = lid.Model(samples)
    got = {r.pos: (r.label, r.prob) for r in lid.with_language(docs(spark, ["पानी", "the water", "", None, " \n", "q"]), model).collect()}
    assert got[0][0] == "hi" and got[1][0] == "en" and 0.5 < got[1][1] <= 1
    assert got[2] == got[3] == got[4] == (None, None) and got[5][0] in ("en", "hi")
    none = lid.Model(samples.limit(0))
    assert lid.keep(docs(spark, ["a"]), none, F.lit("hi")).count() == 1
    assert lid.keep(docs(spark, ["the water", "पानी"]), model, F.lit("hi")).select("pos").collect() == [(1,)]


def test_splits(spark):
    df = docs(spark, [f"text {i}" for i in range(2000)] + ["text 1"], manual=True)
    out = sampling.assign_splits(df)
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 2001 and 0.76 < sizes["train"] / 2001 < 0.84
    assert out.where("text = 'text 1'").select("split").distinct().count() == 1
    copies = sampling.combine_split(df, sampling.SplitParams(upsample=2.5))
    assert copies.where("split <> 'train' and copy > 0").count() == 0
    assert 2.4 < copies.where("split = 'train'").count() / sizes["train"] < 2.6


def test_packed_sentences(spark):
    text = "एक दो। " + " ".join(["शब्द"] * 40) + "। end"
    got = [r.p for r in docs(spark, [text]).select(F.explode(tokens.packed(F.col("text"), 60)).alias("p")).collect()]
    assert got[0] == "एक दो।" and got[-1] == "end"
    assert " ".join(got).split() == text.split()
    assert all(sum(len(w.encode()) + 1 for w in p.split()) <= 60 for p in got[1:-1])


def test_windows_and_batches(spark):
    random.seed(2)
    ids = [[random.randint(4, 99) for _ in range(random.randint(0, 9))] for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(ids)), "pos bigint, ids array<int>")
    stream = [x for row in ids for x in row]
    got = {r.window: (r.x, r.y) for r in tokens.windows(df, 8).collect()}
    assert got == {i: (stream[8 * i : 8 * i + 8], stream[8 * i + 1 : 8 * i + 9]) for i in range((len(stream) - 1) // 8)}
    items = spark.range(100).withColumnRenamed("id", "key")
    whole = tokens.batches(items, "key", 8)
    assert whole.count() == 96 and whole.select("key").distinct().count() == 96
    assert {tuple(r) for r in tokens.batches(items, "key", 8, skip=5).collect()} == {tuple(r) for r in whole.where("batch >= 5").collect()}
    assert {tuple(r) for r in tokens.batches(items, "key", 8, epoch=1).collect()} != {tuple(r) for r in whole.collect()}


def test_scoring_windows_score_once(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 7, 8, 9, 12, 13, 31)], "pos bigint, ids array<int>")
    for n in (1, 7, 8, 9, 12, 13, 31):
        rows = tokens.scoring_windows(df.where(F.col("pos") == n), 8, 4).collect()
        assert sorted(x for r in rows for x in r.window[r.first :]) == list(range(n))


def test_words_beyond_the_executors(spark):
    df = docs(spark, ["a b c a", "", None, "d a z", "b  b"])
    vocab = tokens.vocabulary(df.where("pos < 3 or pos = 4"))
    want = {r.pos: r.ids for r in tokens.encode_words(df, vocab).collect()}
    assert want[1] == want[2] == [3] and want[3][0] == want[3][2] == tokens.UNKNOWN and want[3][3] == 3
    for most in (0, 1, 2):
        assert {r.pos: r.ids for r in tokens.encode_words(df, vocab, most=max(most, 1)).collect()} == want


def test_chopped_words(spark):
    got = spark.range(1).select(tokens.chopped(F.array(F.lit("abcde"), F.lit("f")), F.lit(2)).alias("x")).first().x
    assert got == ["ab", "cd", "e", "f"]


def test_vocabulary_choice(spark):
    def choice(*rows, **more):
        return tokens.vocabulary_choice(spark.createDataFrame(list(rows), "vocab_size bigint, fertility double"), **more).first().vocab_size

    assert choice((8000, 1.40), (16000, 1.52), (32000, 1.46)) == 32000  # the best of all sizes counts, big or not
    assert choice((8000, 1.71), (16000, 1.52), (32000, 1.49), (64000, 1.47)) == 16000
    assert choice((8000, 1.2), (16000, 1.5), (32000, 1.45)) == 16000  # none within the tolerance: the smallest big one
    assert choice((8000, 1.2), (4000, 1.5)) == 4000  # no big one: the smallest


def test_digits_of_pieces(spark):
    pieces = spark.createDataFrame([(4, "a1"), (5, "२३"), (6, "x")], "token int, piece string")
    frequency = spark.createDataFrame([(4, 10), (5, 6), (6, 99)], "token int, n bigint")
    assert tuple(tokens.digit_audit(frequency, pieces).first()) == (10, 12, "devanagari")
    assert [tuple(r) for r in tokens.top_tokens(frequency, pieces, 2).orderBy("token").collect()] == [(4, "a1", 10), (6, "x", 99)]


@pytest.mark.skipif(not os.path.exists(subwords.PIECES), reason="needs the public vocabularies")
def test_subword_round_trips(spark):
    texts = [HI, "", None, "a  b\tc", "एक\nदो ४५", "🙂 é", " x ", "क़"]
    df = docs(spark, texts)
    for path in subwords.SWEPT:
        rows = {r.pos: r for r in subwords.round_trip(df, path).collect()}
        assert all(r.same and r.n_unknown == 0 for p, r in rows.items() if p != 2) or path == subwords.PIECES
        assert rows[0].same and rows[2].same is None and rows[1].n_tokens == 0
        ids = df.select("pos", subwords.encoded(F.col("text"), path).alias("ids"))
        back = {r.pos: (r.ids, r.text) for r in ids.select("pos", "ids", subwords.decoded(F.col("ids"), path).alias("text")).collect()}
        assert back[0][1] == HI and back[2] == (None, None) and len(back[0][0]) == rows[0].n_tokens
    assert {r.vocabulary for r in subwords.sweep(df).collect()} == {p.rpartition("/")[2] for p in subwords.SWEPT}


def test_masking_and_padding(spark):
    df = spark.createDataFrame([("a", [5, 6, 7], [8]), ("b", [5], [9, 10])], "id string, prompt_ids array<int>, answer_ids array<int>")
    got = {r.id: r for r in supervised.examples(df).collect()}
    assert (got["a"].input_ids, got["a"].target_ids) == ([5, 6, 7, 8], [-100, -100, 8, 3])
    assert (got["b"].input_ids, got["b"].target_ids, got["b"].n_supervised) == ([5, 9, 10], [9, 10, 3], 3)
    padded = {r.id: r for r in supervised.collate(supervised.examples(df).withColumn("batch", F.lit(1))).collect()}
    assert padded["b"].input_ids == [5, 9, 10, 0] and padded["b"].target_ids == [9, 10, 3, -100]
    for bad in (([], [1]), ([2, 5], [6]), ([5] * 90, [6] * 90), (None, [1])):
        rows = spark.createDataFrame([("x", *bad)], df.schema)
        assert supervised.examples(rows, strict=False).count() == 0
        with pytest.raises(Exception, match="example"):
            supervised.examples(rows).collect()


def drawn(spark, n, weights=None):
    dims = spark.createDataFrame([("h", "people", "tall", "short", "height", "cm", 120, 200), ("w", "people", "heavy", "light", "weight", "kg", 5, 60), ("p", "none", "x", "y", "z", "u", 1, 90)], "dim string, pool string, big string, small string, noun string, unit string, low int, high int")
    names = spark.createDataFrame([("people", "train" if i % 2 else "test", f"n{i}q") for i in range(30)], "pool string, split string, name string")
    return supervised.generated(dims, names, n, weights)


def test_generated_examples(spark):
    """Premises or values of every family lead to the answer."""
    every = {f[0]: 1 for f in supervised.FAMILIES}
    rows = drawn(spark, 700, every).collect()
    assert {r.template for r in rows} == set(every) and {r.ask for r in rows} == {"big", "small", "middle"}
    sizes = {f[0]: f[2] for f in supervised.FAMILIES}
    adjectives = {"h": ("tall", "short"), "w": ("heavy", "light")}
    for r in rows:
        assert len(set(r.entities)) == sizes[r.template] and r.candidates[r.answer_index] == r.answer
        assert r.answer_position == (r.entities.index(r.answer) if r.answer in r.entities else -1)
        assert sorted(r.entities, key=r.prompt.index) == r.entities
        big, small = adjectives[r.dim]
        if r.template in (4, 5):
            stated = {e: int(re.search(rf"{e} की \w+ (\d+)", r.prompt).group(1)) for e in r.entities}
            assert stated == r.value_map
            values = sorted(stated.values())
            if r.template == 5:
                assert len(set(values)) == 1 and r.answer == supervised.HINDI.equal
                continue
            assert all(b - a >= supervised.GAP for a, b in zip(values, values[1:], strict=False)) and values[0] >= 5 and values[-1] <= 200
            order = sorted(r.entities, key=lambda e: -stated[e])
        else:
            above = set()
            for a, b, adj in re.findall(r"(n\d+q) तो (n\d+q) से (\w+) है", r.prompt):
                above.add((a, b) if adj == big else (b, a))
            assert len(above) == sizes[r.template] - 1
            order = r.order_names
            assert above == set(zip(order, order[1:], strict=False))
        assert r.answer == {"big": order[0], "small": order[-1], "middle": order[1] if len(order) > 2 else None}[r.ask]
        if r.template == 3:
            assert set(r.pair) == {order[0], order[-1]}


def test_taken_examples(spark):
    draws = drawn(spark, 1500).where("split = 'train'")
    blocked = draws.where("i < 100").select("prompt")
    rows = supervised.taken(draws, 300, blocked).collect()
    assert len(rows) == 300 == len({r.prompt for r in rows}) and sorted(r.k for r in rows) == list(range(300))
    assert not {r.prompt for r in rows} & {r.prompt for r in blocked.collect()}
    assert {r.template for r in rows} == {f[0] for f in supervised.FAMILIES if f[4]}
    for template in (1, 2, 4):
        places = [sum(r.template == template and r.answer_position == k for r in rows) for k in range(3)]
        assert max(places) - min(places) <= 1
    again = supervised.taken(draws.unionByName(draws), 10**6, unique=False)
    assert again.count() == 2 * draws.count()


def test_split_statistics(spark):
    df = spark.createDataFrame([("a", "x " * k, "y", 0) for k in range(1, 42)] + [("a", None, None, -1)], "split string, prompt string, answer string, answer_position int")
    row_ = supervised.split_statistics(df).first()
    lengths = sorted(range(1, 42))
    assert row_.p95_words == lengths[int(0.95 * (len(lengths) - 1))] and row_.max_words == 41 and row_.best_position == 1.0


def test_pools(spark):
    pools = spark.createDataFrame([("p", "train", "ram"), ("p", "test", "rama"), ("p", "test", "ram"), ("q", "train", "x")], "pool string, split string, name string")
    assert [r.name for r in supervised.shared_names(pools).collect()] == ["ram"]
    assert [(r.short, r.long) for r in supervised.contained_names(pools).collect()] == [("ram", "rama")]
    assert [r.pool for r in supervised.small_pools(pools, 2).collect()] == ["q"]


def pair(spark, h, r):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, r, strict=True))], "id bigint, hypothesis string, reference string")


def rouge(spark, h, r, part="f"):
    return pair(spark, h, r).agg(F.avg(metrics.rouge_l("hypothesis", "reference")[part]).alias("x")).first().x


def test_rouge(spark):
    assert rouge(spark, ["a b c d"], ["a b x d"]) == pytest.approx(0.75)
    assert (rouge(spark, ["a b c d"], ["a d"], "p"), rouge(spark, ["a b c d"], ["a d"], "r")) == (0.5, 1.0)
    for text in (HI, "यस नदीबारे मानिसले भने", "the same words"):
        assert rouge(spark, [text], [text]) == 1.0
    assert rouge(spark, [""], ["a"]) == 0.0
    assert rouge(spark, ["a b", "x"], ["a b", "y"]) == pytest.approx(0.5)
    random.seed(3)
    for _ in range(50):
        a, b = ([random.choice("abcd") for _ in range(random.randint(1, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert metrics._longest_common(a, b) == table[-1][-1]


def test_distinct_and_runs(spark):
    def distinct(*rows, n=2):
        df = spark.createDataFrame([([str(x) for x in r],) for r in rows], "items array<string>")
        return tuple(metrics.distinct_share(df, "items", n).first())

    assert distinct([1, 2, 3, 4, 5]) == (1.0, 0.0)
    assert distinct([1] * 5) == (0.25, 0.75)
    assert distinct([1]) == (0.0, 0.0)
    share, repetition = distinct([1, 2] * 4)
    assert share + repetition == pytest.approx(1)
    runs = spark.createDataFrame([(0, [1, 2, 2, 2, 3, 4, 4]), (1, [1, 2, 3]), (2, [])], "id int, items array<int>")
    assert {r.id: r.run for r in metrics.longest_run(runs, "id", "items").collect()} == {0: 3, 1: 1, 2: 0}


def words(name):
    return F.filter(F.split(name, " "), lambda w: w != "")


def test_bleu_and_chrf(spark):
    same = pair(spark, ["the cat sat on the mat"], ["the cat sat on the mat"])
    assert metrics.bleu(same, words("hypothesis"), words("reference")).first().bleu == pytest.approx(100)
    assert metrics.chrf(same).first().chrf == pytest.approx(100)
    h, r = "the cat sat on mat".split(), "the cat sat on the mat".split()
    product = 1.0
    for n in range(1, 5):
        a = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
        b = [tuple(r[i : i + n]) for i in range(len(r) - n + 1)]
        product *= sum(min(a.count(g), b.count(g)) for g in set(a)) / len(a)
    want = 100 * product**0.25 * math.exp(1 - len(r) / len(h))
    got = metrics.bleu(pair(spark, [" ".join(h)], [" ".join(r)]), words("hypothesis"), words("reference")).first().bleu
    assert got == pytest.approx(want, abs=1e-5)
    assert metrics.bleu(pair(spark, ["x"], ["y"]), words("hypothesis"), words("reference")).first().bleu == 0.0
    assert metrics.chrf(pair(spark, ["x"], ["y"])).first().chrf == 0.0


def test_international_tokens(spark):
    df = spark.createDataFrame([("वह गया।", 0), ("a, b.c 3,4 $5", 1), ("", 2)], "t string, i int")
    got = [r.x for r in df.orderBy("i").select(metrics.intl_tokens(F.col("t")).alias("x")).collect()]
    assert got == [["वह", "गया", "।"], ["a", ",", "b", ".", "c", "3,4", "$", "5"], []]
    same = pair(spark, ["क ख ग घ गया।"], ["क ख ग घ गया ।"])
    assert metrics.bleu(same, metrics.intl_tokens(F.col("hypothesis")), metrics.intl_tokens(F.col("reference"))).first().bleu == pytest.approx(100)


def test_chrf_of_unlike_texts(spark):
    """Precision and recall are averaged over the orders, F is taken once."""
    rows = [("the cat sat.", "the cat, sat on"), ("(a b", "a b"), ("x", "")]
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def apart(text):
        out = []
        for w in text.split():
            out += [w] if len(w) == 1 else [w[:-1], w[-1]] if w[-1] in marks else [w[0], w[1:]] if w[0] in marks else [w]
        return out

    p, r = [], []
    for n, of in [(n, lambda t: list(t.replace(" ", ""))) for n in range(1, 7)] + [(n, apart) for n in (1, 2)]:
        hyp = ref = match = 0
        for a, b in rows:
            x, y = (Counter(tuple(of(t)[i : i + n]) for i in range(len(of(t)) - n + 1)) for t in (a, b))
            hyp, ref, match = hyp + (x.total() if y else 0), ref + y.total(), match + (x & y).total()
        if hyp and ref:
            p.append(match / hyp)
            r.append(match / ref)
    p, r = np.mean(p), np.mean(r)
    assert metrics.chrf(pair(spark, *zip(*rows, strict=True))).first().chrf == pytest.approx(100 * 5 * p * r / (4 * p + r), abs=1e-5)


def test_head_classes(spark):
    cells = [(0.31, 0.9, 0.9, 0.0, "sink"), (0.3, 0.1, 0.5, 0.0, "local/positional"), (0.0, 0.15, 0.9, 0.41, "content-based"), (0.0, 0.1, 0.3, 0.4, "mixed"), (0.0, 0.5, 0.9, 0.39, "mixed")]
    df = spark.createDataFrame(cells, "sink_rate double, normalized_distance double, previous_token_rate double, normalized_entropy double, want string")
    assert [r.got for r in df.select(metrics.head_class().alias("got"), "want").collect()] == [c[-1] for c in cells]


def test_layer_means_whatever_the_order(spark):
    """A mean half way between two sixth places, its values in all orders."""
    orders = list(itertools.permutations((0.245221, 0.225884, 0.241545, 0.233148)))
    rows = [(layer, x, math.nan if layer == 1 else None if layer == 2 else 1e300) for layer, order in enumerate(orders) for x in order]
    heads = spark.createDataFrame(rows, "layer int, sink_rate double, odd double").coalesce(1)
    got = {r.layer: r for r in metrics.layer_means(heads, "sink_rate", "odd").collect()}
    assert {layer: r.sink_rate for layer, r in got.items()} == dict.fromkeys([*range(24), None], 0.23645)
    assert math.isnan(got[1].odd) and math.isnan(got[None].odd) and got[2].odd is None and got[0].odd == 1e300


def test_parameters_and_throughput(spark):
    rows = {r.name: r for r in metrics.parameters(spark, [("a", 10, 4, 16, 2, 8, False, True, True), ("b", 10, 4, 16, 2, 8, True, False, False)]).collect()}
    block = 4 * 16 + (4 * 16 + 16) + (16 * 4 + 4) + 2 * 2 * 4
    assert rows["a"].total == 40 + 32 + 2 * block + 8 and rows["b"].total == 40 + 2 * (block + 16) + 8 + 40
    steps = spark.createDataFrame([(i, 9.0 if i < 5 else 0.5, 2.0) for i in range(15)], "step int, seconds double, loss double")
    assert tuple(metrics.throughput(steps, 100, 7200).first()) == (10, 0.5, 200.0, 2.0, 1.0)


def test_ranking_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(["aa", "b"], [-1.0, -1.0]), (["aaaa", "b"], [-2.0, -1.0]), (["a"], None), (["a"], [-1.0, -2.0])], "candidates array<string>, logprobs array<double>")
    assert [(r.best, r.best_normalized) for r in metrics.ranked(df).collect()] == [("aa", "aa"), ("b", "aaaa"), (None, None), (None, None)]
    by_tokens = spark.createDataFrame([(["aaaa", "b"], [-2.0, -1.5], [1, 2])], "candidates array<string>, logprobs array<double>, n array<int>")
    assert metrics.ranked(by_tokens, "n").first().best_normalized == "b"


def test_frontier(spark):
    old = spark.createDataFrame([("u1", 1, "claimed", 5), ("u2", 0, "pending", None)], "url string, priority int, crawl_state string, n_chars bigint")
    new = spark.createDataFrame([("u2", 9, "pending", None), ("u3", 3, "pending", None), ("u3", 2, "pending", None), (None, 0, "pending", None)], old.schema)
    merged = frontier.add_new(old, new)
    assert {(r.url, r.priority) for r in merged.collect()} == {("u1", 1), ("u2", 0), ("u3", 2)}
    assert {r.url: r.crawl_state for r in frontier.requeue(merged).collect()}["u1"] == "pending"
    assert {r.url: r.crawl_state for r in frontier.claim(frontier.requeue(merged), 2).collect()} == {"u1": "claimed", "u2": "claimed", "u3": "pending"}
    results = spark.createDataFrame([("u3", "done", 77)], "url string, new_state string, new_chars bigint")
    assert {(r.url, r.n_chars) for r in frontier.mark(merged, results).where("crawl_state = 'done'").collect()} == {("u3", 77)}


def test_urls(spark):
    df = spark.createDataFrame([("https://U:p@Ex.org:80/a/B.PDF?x=1",), ("http://ex.org/a?f=x.pdf",), ("http://hi.wikipedia.org/wiki/x",), (None,), ("no url",)], "url string")
    got = df.select(frontier.is_article(F.col("url")).alias("a"), frontier.host_of(F.col("url")).alias("h"), frontier.is_wiki(F.col("url")).alias("w")).collect()
    assert [(r.a, r.h) for r in got] == [(False, "ex.org"), (True, "ex.org"), (True, "hi.wikipedia.org"), (False, None), (True, "")]
    assert got[2].w


def test_sitemaps_and_robots(spark):
    xml = '<urlset><url><loc>http://a/1</loc><image:image><image:loc>http://a/i.jpg</image:loc></image:image></url><s:loc><![CDATA[http://a/2?x=1&amp;y=2]]></s:loc><loc> http://a/m.xml.gz </loc></urlset>'
    robots = "User-agent: *\nsitemap: http://a/s.xml\r\nSITEMAP:http://a/t.xml\nDisallow: /"
    row = spark.createDataFrame([(xml, robots)], "xml string, robots string").select(frontier.sitemap_locations(F.col("xml")).alias("x"), frontier.robots_sitemaps(F.col("robots")).alias("r")).first()
    assert row.x == ["http://a/1", "http://a/2?x=1&y=2", "http://a/m.xml.gz"]
    assert row.r == ["http://a/s.xml", "http://a/t.xml"]


def test_discovery_falls_through(spark):
    def found(rows, cap=1000, **more):
        df = spark.createDataFrame(rows, "site string, strategy int, place int, url string")
        return [(r.site, r.url) for r in frontier.discovered(df, cap, **more).orderBy("site", "rank").collect()]

    rows = [("s", 0, i, f"u{i}") for i in range(3)] + [("s", 1, i, f"u{i}") for i in range(60)] + [("s", 2, 0, "late")]
    assert found(rows, 10) == [("s", f"u{i}") for i in range(10)]
    assert ("s", "late") not in found(rows)
    both = [("s", 0, i, f"a{i}") for i in range(30)] + [("s", 1, i, f"b{i}") for i in range(30)] + [("s", 2, 0, "late")]
    assert len(found(both)) == 60  # 30 and 30 are enough together
    assert len(found(both, caps={1: 5})) == 36 and len(found(both, caps={1: 0})) == 31
    wiki = [("hi.wikipedia.org", -1, 0, "w"), ("hi.wikipedia.org", 0, 0, "x"), ("t", -1, 0, "w"), ("t", 0, 0, "x")]
    assert found(wiki) == [("hi.wikipedia.org", "w"), ("t", "x")]
    assert found([("hi.wikipedia.org", 0, 0, "x")]) == [("hi.wikipedia.org", "x")]


def test_combine_reasons_in_order(spark):
    df = spark.createDataFrame([(0, "a", "hi", True, "k"), (1, None, "hi", True, "k"), (2, "a", "en", True, "k"), (3, "a", "hi", False, "k"), (4, "b", "HI ", True, "k"), (5, "c", "hi", True, None), (6, "c", "hi", True, None)], "pos bigint, text string, lang string, manual boolean, id string")
    got = {r.pos: r.reason for r in statistics.combine_reasons(df.withColumn("malformed", F.col("pos") == 6), ("hi",), F.col("id")).collect()}
    assert got == {0: None, 1: "empty_text", 2: "wrong_language", 3: "not_manual", 4: "duplicate_doc_id", 5: None, 6: "malformed_json"}


def test_byte_probes(spark):
    random.seed(2)
    texts = ["x" * random.randint(0, 40) for _ in range(30)]
    lines = [len(t) + 1 for t in texts]
    for probes in (1, 7, 50):
        chosen = []
        for i in range(probes):
            at, n = sum(lines) * i / probes, 0
            for k, size in enumerate(lines):
                if n <= at < n + size and k + 1 < len(lines):
                    chosen.append(k + 1)
                n += size
        row_ = statistics.probed(docs(spark, texts), F.col("text"), probes).first()
        assert row_.probes == len(chosen)
        assert row_.chars_estimated == round(sum(len(texts[k]) for k in chosen) * sum(lines) / sum(lines[k] for k in chosen))


def test_report(spark):
    text = statistics.report({"a": docs(spark, ["x|y", None]).select("pos", "text"), "b": docs(spark, ["t"] * 5).select("pos")}, 3)
    assert "| 0 | x\\|y |" in text and "| 1 |  |" in text and "More than 3 rows." in text


def test_corpus_plan_by_tokens(spark):
    df = docs(spark, ["aa " * 50], manual=True).unionByName(docs(spark, ["aa " * 100]))
    row_ = sampling.corpus_plan_by_tokens(df, 96, fertility=1.0).first()
    assert (row_.keep, row_.corpus_words, row_.train_tokens, row_.manual_share) == (0.7, 120, 96, 0.4167)
    assert sampling.corpus_plan_by_tokens(df, 10**6, fertility=1.0).first().keep == 1.0


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from sarit.plans import scale

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scale.checkpoint_dir(cluster)
    wide = spark.range(3).select(F.repeat(F.lit("x"), 100).alias("x"))
    assert "broadcast" in str(scale.broadcast_if_small(wide)._jdf.queryExecution().logical())
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    assert "broadcast" not in str(scale.broadcast_if_small(wide)._jdf.queryExecution().logical())

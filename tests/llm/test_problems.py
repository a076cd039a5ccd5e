"""Results of the operators against brute force, exact round trips and hand-made cases."""

import base64
import random

import numpy as np
import pytest

from sarit.llm import batches, budget, encode, language, leaks, lookalike, mixing, overlap, quality, repeated_lines, residue
from sarit.plans.scale import table

from .conftest import EN, HI, NE, NOTICE, document, row


def rows(df):
    return {tuple(r) for r in df.collect()}


# 1


def statistics(lines):
    words = quality.Words(frozenset(lookalike.plain_forms(sorted(quality.FUNCTION_WORDS))) | frozenset("के में है the of and it for".split()))
    return dict(zip(quality.STATISTICS, quality.measure([lookalike.plain_forms(["\n".join(lines)])[0].split("\n")], words)[0], strict=True))


@pytest.mark.parametrize(
    "lines",
    [
        ["- समिति;", "- पत्रिका;", "- विद्यालय और खेत;", "- मैदान;"] * 5,
        ["नदी,48%,-,7252,60.8", "खेत,35.8,4.0,8353,21.4", "पुल,-,-,-,4.9"] * 6,
        ["पानी नगर दवा पानी नगर दवा दवा पानी नगर पानी दवा नगर पानी दवा नगर दवा पानी नगर"],
        ["e94e fbe5 1c57 fa56 0788 e1d5 ac2f 7c2e", "435e a351 84e6 f557 0eda e6ca 5a40 87f3"] * 3,
        ["var dghfge = f(41);", "if (x != null) return b;", "<div class='a'>", ".c { margin: 20px }"] * 4,
        ["मभषयसषशघक दखभलदभगक षमछडयगझरबझधव फकभफररधदघसखत झलडढट सचहयथससयकघ"] * 3,
        ["अ स ् प त ा ल य ा त ् र ा १ ९ ४ ; ~ ^"] * 6,
        ["Halfold Brook 39 (76) 4x4 6x5", "Rinstead Moor 17 (56) 4x2 6x4"] * 6,
    ],
)
def test_junk_stands_outside_sentences(lines):
    assert statistics(lines)["outside_share"] > 0.9


@pytest.mark.parametrize(
    "lines",
    [
        [HI, NE, HI],
        ["सुबह से रामपुर तक लोग के साथ पुस्तक का काम बड़ी मेहनत से चल रहा था और किसी ने नहीं पूछा कि क्या हुआ"],
        ["नाटक गाँव के खेत तो अब भी है", "पानी नगर के मन में दीप जले", "दवा राम के मैदान से मत पूछो"] * 4,
        [EN, "Was it not good?", "It was good for the people of the town."],
        [HI + " " + HI + " " + HI, "- नदी", "- खेत", "- पुल"],
        ["छोटा वाक्य है।"],
    ],
)
def test_prose_and_verse_do_not(lines):
    assert statistics(lines)["outside_share"] <= 0.5


def test_tails_follow_the_corpus(spark, folder):
    """A list is a case where text is the rule; where lists are, the sketches' tails don't flag it."""
    text = lambda i: "\n".join(f"{HI} और {chr(0x915 + i % 30)}{chr(0x915 + i // 30)}{'ा' * k} ने कहा था।" for k in range(1 + i % 3))
    list_ = "\n".join(f"• नाटक {chr(0x915 + i % 30)}{chr(0x915 + i // 30)}" for i in range(40))
    docs = [document(i, text(i)) for i in range(60)] + [document(100, list_, "mr")]
    d = folder(documents=docs)
    assert rows(quality.found(spark, d)) == {(100,)}
    table_ = {r.doc_id: r for r in quality.statistics(spark, d).collect()}
    assert "common_word_share" in table_[100].tails and table_[100].common_word_share_zz < -quality.TAIL and table_[100].flagged
    assert sum(r.flagged for r in table_.values()) == 1
    assert {r.statistic for r in quality.quantiles(spark, d).collect()} == set(quality.SKETCHED)
    lists = [document(i, "\n".join(f"• {chr(0x915 + k % 30)}{chr(0x915 + i % 30)}{chr(0x915 + i // 30)} नाटक" for k in range(40))) for i in range(60)]
    d = folder(documents=[*lists, document(100, list_, "hi"), document(101, text(3))])
    table_ = {r.doc_id: r for r in quality.statistics(spark, d).collect()}
    assert table_[100].outside_share > quality.OUTSIDE and not table_[100].flagged
    assert (100,) not in rows(quality.found(spark, d))


def test_flags_without_sketched_values(spark, folder):
    d = folder(documents=[document(1, None), document(2, "")])
    assert not any(r.flagged for r in quality.statistics(spark, d).collect())


# 2


def test_language_of_held_out_samples():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/lang_samples.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the sample table")
    samples = pq.read_table(path).to_pylist()
    train, held = [s for s in samples if s["sample_id"] % 3], [s for s in samples if not s["sample_id"] % 3]
    profiles = language.Profiles({x: [s["text"] for s in train if s["lang"] == x] for x in language.LANGUAGES})
    right = 0
    for s in held:
        _, row_, found, _, letters = language.classify([s["text"]], profiles)
        weight = np.bincount(found[found >= 0], letters[found >= 0], minlength=4)
        right += language.LANGUAGES[int(weight.argmax())] == s["lang"]
    assert right >= 0.95 * len(held)


def test_labels(spark):
    from sarit.llm.labels import label_column

    known = {"hi-IN": "hi", " HINDI ": "hi", "हिन्दी": "hi", "npi": "ne", "ne_NP": "ne", "नेपाली": "ne", "Marathi": "mr", "en-GB": "en", "??": None, "": None, "und": None, "N/A": None, None: None, "unknown": None, "hindustan": None}
    df = spark.createDataFrame([(k,) for k in known], "lang string").select("lang", label_column("lang").alias("code"))
    assert {r.lang: r.code for r in df.collect()} == known


def test_shares_of_a_mixed_text(spark, edge, folder):
    d = folder(documents=[document(1, f"{HI} {HI}\n{EN}", "hi"), document(2, EN, "en"), document(3, HI, None)], lang_samples=table(spark, edge, "lang_samples").toPandas().to_dict("records"), common_words=table(spark, edge, "common_words").toPandas().to_dict("records"))
    assert rows(language.found(spark, d)) == {(1, "en"), (3, "hi")}


# 3


def test_mix_reaches_its_shares(spark, folder):
    random.seed(5)
    split = [row(i, "क" * random.randint(20, 400), "train", random.choice(["a", "a", "a", "b", "c"])) for i in range(3000)]
    targets = [{"source": "a", "target_share": 0.3, "max_repeat": 1}, {"source": "b", "target_share": 0.4, "max_repeat": 3}, {"source": "c", "target_share": 0.3, "max_repeat": 2}]
    d = folder(split_docs=split, mix_targets=targets)
    got = {r.source: r for r in mixing.reached(spark, d).collect()}
    for t in targets:
        r = got[t["source"]]
        assert abs(r.share_reached - t["target_share"]) < 0.005
        assert r.most_copies <= t["max_repeat"]
    assert rows(mixing.mixed(spark, d)) == rows(mixing.mixed(spark, d))


def test_longer_rows_are_likelier(spark):
    data = spark.range(20_000).selectExpr("id as row_id", "'a' as site", "cast(if(id % 2 = 0, 100, 400) as bigint) as n_chars")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    got = {r.n_chars: r.n for r in mixing.mix(data, targets, total=1_000_000.0).groupBy("n_chars").count().withColumnRenamed("count", "n").collect()}
    assert 1.7 < got[400] / got[100] < 2.3  # the square root of 4


def test_certain_rows_leave_the_others_their_chances(spark):
    """A row whose chance would pass 1 is certain, and the others' chances are of what it leaves."""
    data = spark.createDataFrame([(i, "a", 10_000 if i == 0 else 100) for i in range(101)], "row_id bigint, site string, n_chars bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeat int")
    got = mixing.with_chances(mixing.plan(data, targets, 15_000.0), data).first()
    assert (got.longest, got.rest, got.weights) == (100, 5000.0, pytest.approx(100 * 100**1.5))
    for seed in range(4):
        used = {r.row_id: r.copies for r in mixing.mix(data, targets, 15_000.0, seed).collect()}
        assert used[0] == 1 and len(used) == 51


# 4


def test_estimate_against_the_tokenizer():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=budget.VOCABULARY)
    texts = [HI, NE, EN, "", "  two  blanks", "a\nb\tc", "x" * 700, "🙂 é ñ", " ".join([EN, HI] * 40)]
    got = budget.Counter(budget.VOCABULARY)(texts)
    want = [len(model.encode(t)) for t in texts]
    assert got[3] == 0
    assert abs(got.sum() - sum(want)) <= 0.03 * sum(want)


def test_viterbi_against_brute_force():
    random.seed(2)
    pieces = {p.encode(): -random.random() * 5 for p in ("a", "b", "c", "ab", "bc", "abc", "ca", "aab")}
    trie = budget.Trie(pieces)

    def best(s):
        known = {0: (0.0, 0)}
        for j in range(1, len(s) + 1):
            options = [(known[i][0] + pieces[s[i:j]] + budget.EACH, known[i][1] + 1) for i in range(j) if s[i:j] in pieces]
            options += [(known[j - 1][0] + budget.BYTE + budget.EACH, known[j - 1][1] + 1)]
            known[j] = max(options, key=lambda x: x[0])
        return known[len(s)][1]

    words = [bytes(random.choice(b"abcd") for _ in range(random.randint(1, 40))) for _ in range(300)]
    assert trie.counts(words).tolist() == [best(w) for w in words]


# 5


def test_repeated_lines_against_sql(spark, folder):
    import duckdb

    random.seed(3)
    lines = ["Share  this page​ 12", "share this page ३४", "एक दो तीन चार", "दो शब्द", "never twice {}"]
    docs = [document(i, None if i % 11 == 0 else "\n".join(random.choice(lines).format(i) for _ in range(4)), "hi", random.choice(["a", "b", "www.a.example", None])) for i in range(120)]
    d = folder(documents=docs, registry=[{"site": "a", "host": "www.a.example", "root": None, "category": None, "lang": None}])
    c = duckdb.connect()
    for name in ("documents", "registry"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    want = {tuple(x) for x in c.execute(repeated_lines.FOUND_SQL).fetchall()}
    assert want and rows(repeated_lines.found(spark, d)) == want


def test_lines_are_taken_out(spark, folder):
    d = folder(documents=[document(i, f"{HI} {i}\n{NOTICE}") for i in range(10)])
    # the sentence with its number masked is repeated too
    assert {r.text for r in repeated_lines.cleaned(spark, d).collect()} == {""}
    assert {r.site for r in repeated_lines.clusters(spark, d).collect()} == {"alpha"}


def test_results_do_not_depend_on_how_lines_are_sent(spark, folder, edge, monkeypatch):
    """Problems 1, 5 and 10 with the recurrent keys sent to the executors, and with them joined; null sources among them."""
    notice = "अपने दोस्तों के साथ यह लेख आज ही साझा करें और हमारी सदस्यता लें"
    docs = [document(i, f"{notice}\n{HI} और राम {chr(0x915 + i)}{chr(0x930)} ने कहा।") for i in range(20)]
    docs += [document(99, f"{notice}\nAccess denied. You do not have permission to view /20."), document(100, f"{notice}\nAccess denied. You do not have permission to view /21.", source=None), document(101, f"{notice}\n{HI}", source=None), document(102, "\n".join([notice] * 3 + [f"• नाटक {i}" for i in range(40)]), source=None)]
    queries = (quality.statistics, quality.found, repeated_lines.cleaned, repeated_lines.cleaned_of_clusters, residue.reasons)
    for d in (folder(documents=docs), edge):
        want = [sorted(map(repr, q(spark, d).collect())) for q in queries]
        with monkeypatch.context() as m:
            m.setattr(repeated_lines, "MOST_LINES", 0)
            assert [sorted(map(repr, q(spark, d).collect())) for q in queries] == want


def test_near_same_lines_are_clustered(spark, folder):
    """Bylines with other names, dates and numbers are one line; a word more is near; the plain rule finds neither."""
    months = "जानेवारी ऑगस्ट मार्च मई december जुलै".split()
    byline = lambda i: f"संवाददाता: {'कखगघचछजझटठ'[i % 10]}म {'पफबभमयरलवश'[i // 10]}न, नगर डेस्क से विशेष रिपोर्ट {months[i % 6]} {i}"
    base = "हमारी वेबसाइट पर रोज़ नई खबरें पढ़ने के लिए अभी जुड़ें और अपने सभी मित्रों को भी यह अच्छी सूचना ज़रूर दें आज ही"
    longer = lambda i: f"{base} {'कखगघचछजझटठ'[i]}ल"
    prose = lambda i: f"{'कखगघचछजझटठ'[i % 10]}{'पफबभमयरलवश'[i // 10]} नदी के पास {i * 'ब'} खेत"
    docs = [document(i, f"{byline(i)}\n{prose(i)}" + (f"\n{longer(i)}" if i < 4 else f"\n{base}" if i < 7 else "")) for i in range(60)]
    d = folder(documents=docs)
    want = {(i, 0) for i in range(60)} | {(i, 2) for i in range(7)}
    assert {(r.doc_id, r.line_no) for r in repeated_lines.method(spark, d).collect()} == want
    assert rows(repeated_lines.found(spark, d)) == set()
    assert sorted((r.n_documents, r.n_lines) for r in repeated_lines.clusters(spark, d).collect()) == [(7, 5), (60, 1)]
    left = {r.doc_id: r.text for r in repeated_lines.cleaned_of_clusters(spark, d).collect()}
    assert left == {i: prose(i) for i in range(60)}


def test_clusters_against_brute_force(spark, folder):
    """All pairs of lines of one site of a similarity of 0.8 or more, linked; documents counted for each cluster."""
    random.seed(11)
    word = lambda: "".join(random.choice("कखगघचछजझ") for _ in range(3))
    docs = []
    for k in range(6):
        base = [word() for _ in range(random.choice([6, 14, 30, 45]))]
        for _ in range(random.choice([3, 5, 9])):
            line = list(base)
            if random.random() < 0.6:
                line[random.choice([0, len(line) - 1])] = word()
            docs.append(document(len(docs), " ".join(line) + "\n" + " ".join(word() for _ in range(12)), source=random.choice("ab") if k % 2 else "a"))
    d = folder(documents=docs)
    lines = [(x["doc_id"], n, x["source"], t) for x in docs for n, t in enumerate(x["text"].split("\n"))]

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(t) for *_, t in lines]
    group = list(range(len(lines)))
    for _ in lines:
        for i in range(len(lines)):
            for j in range(i):
                if lines[i][2] == lines[j][2] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    group[i] = group[j] = min(group[i], group[j])
    held, total = {}, {}
    for (doc, _, site, _), g in zip(lines, group, strict=True):
        held.setdefault(g, set()).add(doc)
        total.setdefault(site, set()).add(doc)
    want = {(doc, n) for (doc, n, site, _), g in zip(lines, group, strict=True) if len(held[g]) >= 5 and 50 * len(held[g]) > len(total[site])}
    assert want and {(r.doc_id, r.line_no) for r in repeated_lines.method(spark, d).collect()} == want


# 6


def test_distance():
    random.seed(1)
    for _ in range(300):
        a, b = (np.array([random.randint(1, 4) for _ in range(random.randint(0, 12))], np.uint64) for _ in "ab")
        full = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            full, last = [i], full
            for j, y in enumerate(b, 1):
                full.append(min(last[j] + 1, full[-1] + 1, last[j - 1] + (x != y)))
        for most in (0, 1, 3, 6):
            assert overlap.distance(a, b, most) == min(full[-1], most + 1)


def test_distances_of_many_pairs():
    random.seed(12)
    one, two = ([np.array([random.randint(1, 5) for _ in range(random.randint(0, 14))], np.int64) for _ in range(300)] for _ in "ab")
    for most in (0, 1, 2, 5):
        assert overlap.distances(one, two, most).tolist() == [overlap.distance(a, b, most) for a, b in zip(one, two, strict=True)]


def test_bound_of_the_distance():
    import pyarrow as pa

    random.seed(3)
    one = [[random.randint(0, 2**63 - 1) % random.choice([5, 2**40]) for _ in range(random.randint(0, 30))] for _ in range(200)]
    two = [[x for x in a if random.random() < 0.9] + [7] * random.randint(0, 2) for a in one]
    got = overlap.bound(*(pa.array(x, pa.list_(pa.int64())) for x in (one, two)))
    for a, b, n in zip(one, two, got.tolist(), strict=True):
        assert n <= 2 * overlap.distance(np.array(a, np.uint64), np.array(b, np.uint64), 60)


def test_overlaps_against_brute_force(spark, folder, monkeypatch):
    random.seed(4)
    split = []
    for g in range(60):
        base = [f"w{random.randint(0, 300)}" for _ in range(random.choice([3, 8, 9, 10, 18, 19, 27, 60, 120]))]
        for _ in range(3):
            words = list(base)
            for _ in range(random.randint(0, len(base) // 8)):
                i = random.randrange(len(words))
                words[i : i + random.randint(0, 1)] = random.choice([[], ["x"], [f"y{random.randint(0, 99)}"]])
            split.append(row(len(split), random.choice([" ", "  ", ", "]).join(words).upper() if random.random() < 0.3 else " ".join(words), random.choice(["train", "val", "test"])))
    texts = {r["row_id"]: leaks.word_hashes([r["text"]])[0] for r in split}
    want = set()
    for a in split:
        for b in split:
            if a["row_id"] < b["row_id"] and (a["split"] == "train") != (b["split"] == "train"):
                x, y = texts[a["row_id"]], texts[b["row_id"]]
                most = max(len(x), len(y)) // 10
                if len(x) and len(y) and overlap.distance(x, y, most) <= most:
                    want.add((a["row_id"], b["row_id"]))
    d = folder(split_docs=split)
    assert len(want) > 20 and rows(overlap.found(spark, d)) == want
    assert sum(r.n_pairs for r in overlap.report(spark, d).collect()) == len(want)
    links = {r.row_id: r.n_links for r in overlap.members(spark, d).collect()}
    assert all(links[i] == sum(i in p for p in want) for i in texts if len(texts[i]))
    assert sum(r.n_evaluation * r.n_train for r in overlap.classes(spark, d).collect()) == len(want)
    with monkeypatch.context() as m:
        m.setattr(overlap, "SALTED", 1)
        m.setattr(overlap, "WORDS", 50)
        m.setattr(batches, "FEWEST", 64)
        m.setattr(batches, "BITS", 64)  # a full bitmap, which lets all pass
        assert rows(overlap.found(spark, d)) == want


# 7


@pytest.mark.parametrize(("a", "b"), [("क़", "क़"), ("आ", "अा"), ("ऐनक", "एेनक"), ("a b", "a　b"), ("a b", "a b"), ("15", "１５"), ("a,b", "a，b"), ("bap", "bаp"), ("café", "café"), ("है।", "है|"), ("अतः", "अत:"), ("॥", "||"), ("a­b", "ab"), ("﻿a", "a"), ("a\r\nb", "a\nb"), ("Torwick", "Тоrwісk"), ("ो", "ाे")])
def test_same_look(a, b):
    x, y = lookalike.skeletons([a, b])
    assert x == y


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("1", "१"), ("कि", "की"), ("a", "a?"), ("बराबर", "बरावर"), ("है", "है।"), ("के", "कै"), ("a b", "ab"), ("é", "e"), ("²", "2")])
def test_other_look(a, b):
    x, y = lookalike.skeletons([a, b])
    assert x != y


def test_look_pairs(spark, edge):
    got = rows(lookalike.same_look(spark, edge))
    assert ("documents", 14, 20) in got and ("documents", 20, 24) in got and ("documents", 14, 15) not in got
    assert {k for t, k, _ in got if t == "scored_examples"} == {4, 5}


def test_look_classes(spark, edge):
    pairs = [(a, b) for t, a, b in rows(lookalike.same_look(spark, edge)) if t == "documents"]
    got = {r.key: r for r in lookalike.classes(spark, edge).collect()}
    assert pairs and set(got) == {k for p in pairs for k in p}
    assert all(r.n_links == sum(k in p for p in pairs) for k, r in got.items())
    assert all(got[a]["class"] == got[b]["class"] and got[a].string != got[b].string for a, b in pairs)


def test_forms_of_all_texts(spark, edge):
    got = {(r.tbl, r.key, r.field): r.form for r in lookalike.one_form(spark, edge).collect()}
    scored = table(spark, edge, "scored_examples").collect()
    documents = table(spark, edge, "documents").collect()
    want = {("scored_examples", r.score_id, f): r[f] for r in scored for f in ("generated", "gold")}
    want |= {("documents", r.doc_id, "text"): r.text for r in documents}
    assert got == {k: None if t is None else lookalike.skeletons([t])[0] for k, t in want.items()}


# 8


def tiktoken_encoding():
    import tiktoken

    with open(encode.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_tokenizers(spark, edge):
    want = tiktoken_encoding()
    for r in encode.corpus_ids(spark, edge).join(table(spark, edge, "documents", "doc_id", "text").distinct(), "doc_id").collect():
        assert r.ids == want.encode_ordinary(r.text or "")


def test_odd_texts():
    want, own = tiktoken_encoding(), encode.Encoder(encode.VOCABULARY)
    random.seed(6)
    texts = ["".join(random.choice("ab Z'st1é\n\r\t\x85\x1c　कि।😀    'll=<|endoftext|>") for _ in range(random.randint(0, 60))) for _ in range(400)] + ["=" * 3000, "ab" * 2000, " " * 500]
    ids, sizes = own(texts)
    for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert part.tolist() == want.encode_ordinary(text)


def test_more_words_than_are_remembered(monkeypatch):
    want = tiktoken_encoding()
    monkeypatch.setattr(encode, "REMEMBERED", 10)
    own = encode.Encoder(encode.VOCABULARY)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(5)]
    ids, sizes = own(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [want.encode_ordinary(t) for t in texts]


# 9


def test_leaks_against_brute_force(spark, folder):
    random.seed(7)
    word = lambda: random.choice("अ आ इ क ख ग त न प म र ल स".split()) + random.choice("ा ि ी े ो".split()) + str(random.randint(0, 40))
    items = [{"item_id": i, "text": " ".join(word() for _ in range(random.choice([3, 6, 12, 13, 30]))), "lang": "hi", "split": "val"} for i in range(30)]
    docs = []
    for i in range(80):
        words = [word() for _ in range(60)]
        if i % 2:
            source = random.choice(items)["text"].split()
            n = random.choice([11, 12, 14, len(source)])
            start = random.randint(0, max(0, len(source) - n))
            words[20:20] = source[start : start + n]
        docs.append(document(i, random.choice([" ", "\n", ", "]).join(words)))
    d = folder(documents=docs, eval_items=items)
    want = set()
    split = {i["item_id"]: lookalike.word_texts([i["text"]])[0].split() for i in items}
    for x in docs:
        text = f" {' '.join(lookalike.word_texts([x['text']])[0].split())} "
        for item, words in split.items():
            n = min(leaks.PASSAGE, len(words))
            if any(f" {' '.join(words[p : p + n])} " in text for p in range(len(words) - n + 1)):
                want.add((x["doc_id"], item))
    assert want and rows(leaks.leaked(spark, d)) == want
    assert {(r.doc_id, r.item_id) for r in leaks.nearly_leaked(spark, d).collect()} >= want


def test_edited_leaks_against_brute_force(spark, folder):
    """All altered passages of which a window is similar enough are found, and nothing else."""
    from collections import Counter

    random.seed(9)
    word = lambda: random.choice("अआइकखगतनपमरलस") + random.choice("ािीेो") + str(random.randint(0, 30))
    items = [{"item_id": i, "text": " ".join(word() for _ in range(random.choice([4, 9, 12, 20, 39, 60]))), "lang": "hi", "split": "val"} for i in range(24)]
    docs, edited = [], set()
    for i in range(150):
        item = items[i % len(items)]
        copy = item["text"].split()
        for _ in range(1 + i % 4):
            at = random.randrange(len(copy))
            copy[at : at + random.choice([0, 1, 1])] = random.choice([[word()], [word()], []])
        alone = i % 5 == 0
        docs.append(document(i, " ".join(copy if alone else [word() for _ in range(30)] + copy + [word() for _ in range(30)])))
        if i % 4 == 0 and len(item["text"].split()) >= 20:
            edited.add((i, item["item_id"]))
    d = folder(documents=docs, eval_items=items)
    want = dict.fromkeys(rows(leaks.leaked(spark, d)), 1.0)
    exact = set(want)
    for x in docs:
        text = lookalike.word_texts([x["text"]])[0].split()
        for item in items:
            words = lookalike.word_texts([item["text"]])[0].split()
            n = min(len(words), len(text))
            for p in range(len(text) - n + 1):
                a, b = Counter(text[p : p + n]), Counter(words)
                similarity = (a & b).total() / (a | b).total()
                if similarity >= leaks.SIMILAR:
                    key = x["doc_id"], item["item_id"]
                    want[key] = max(want.get(key, 0.0), similarity)
    got = {(r.doc_id, r.item_id): r.similarity for r in leaks.nearly_leaked(spark, d).collect()}
    assert got == pytest.approx(want) and edited <= set(got) and len(set(got) - exact) > 10


def test_blocks_of_words_and_items(spark, edge, monkeypatch):
    whole = rows(leaks.leaked(spark, edge))
    passages = next(leaks._item_blocks(table(spark, edge, "eval_items", "item_id", "text")))
    hashes, _ = leaks.word_hashes([f"{HI} {EN} {HI}"] * 3)
    once = {(n, w, p) for n, ws, ps in leaks._candidates(hashes, passages) for w, p in zip(ws.tolist(), ps.tolist(), strict=True)}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 7)
    assert {(n, w, p) for n, ws, ps in leaks._candidates(hashes, passages) for w, p in zip(ws.tolist(), ps.tolist(), strict=True)} == once
    monkeypatch.setattr(leaks, "WINDOWS", 1)
    assert len(list(leaks._item_blocks(table(spark, edge, "eval_items", "item_id", "text")))) == 3
    assert whole and rows(leaks.leaked(spark, edge)) == whole


def test_blocks_of_segments(monkeypatch):
    profiles = language.Profiles({"hi": [HI], "ne": [NE], "mr": [], "en": [EN]})
    segments = [HI, NE, EN, "x", ""] * 20
    whole = profiles.distances(segments)
    monkeypatch.setattr(language, "BLOCK", 100)
    parts = profiles.distances(segments)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_blocks_find_all_within_the_radius():
    random.seed(8)
    base = np.array([random.getrandbits(64) for _ in range(500)], np.uint64)
    known = leaks.Passages.__new__(leaks.Passages)
    known.prints, known.index = base, []
    for width, block in zip(leaks.BLOCKS, leaks.blocks(base), strict=True):
        order = np.argsort(block, kind="stable")
        seen = np.zeros(1 << width, bool)
        seen[block] = True
        known.index.append((seen, block[order], order))
    near = base.copy()
    for i in range(len(near)):
        for bit in random.sample(range(64), len(leaks.BLOCKS) - 1):
            near[i] ^= np.uint64(1 << bit)
    window, passage = known.candidates(near)
    assert {(i, i) for i in range(len(base))} <= set(zip(window.tolist(), passage.tolist(), strict=True))


# 10


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("शीर्षक यहाँ\nPlease enable JavaScript to view this page. /g6kd7naj1", "error"),
        ("त्रुटि 500: माँगा गया पृष्ठ /pdhp नहीं मिला।", "error"),
        ("सामग्री हेर्न कुकी र स्क्रिप्टलाई अनुमति दिनुहोस्। 5787", "error"),
        (f"{HI} {{{{ category }}}} {HI}", "placeholder"),
        (f"{HI}\n[user.name यहाँ लिखें]", "placeholder"),
        (f"<%= दिनांक %> {HI}", "placeholder"),
        ("Dear [object Object], your parcel for [object Object] is ready.", "failed value"),
        ("Lorem ipsum quasto vester dolor. Vester quasto ipsum lorem nerum velim.", "filler"),
        ("यहाँ आपका पाठ आएगा।\n" * 4, "filler"),
        (HI, None),
        (f"{HI} In such a letter {{{{name}}}} is replaced by the reader's own name.", None),
        (f"पाठ में {{{{नाम}}}} लिखने पर वहाँ पाठक का नाम दिखता है। {HI}", None),
        (f"समुच्चय {{{{x | x > 20}}}} को हल किया था। {HI}", None),
        (f"{HI} {HI} The designer dislikes lorem ipsum and has banned it.", None),
        (f"{HI} सर्वर हर बार 500 संदेश देता था। {HI}", None),
        ("var a = f(41);\nif (x != null) return undefined;", None),
    ],
)
def test_residue(text, reason):
    lines = [x for x in lookalike.plain_forms([text])[0].split("\n") if x.strip()]
    assert residue.evidence(lines) == reason


def test_recurrent_lines_do_not_hide_an_error(spark, folder):
    notice = "अपने दोस्तों के साथ यह लेख आज ही साझा करें और हमारी सदस्यता लें"
    docs = [document(i, f"{notice}\n{HI} और राम {chr(0x915 + i)}{chr(0x930)} ने कहा।") for i in range(20)] + [document(99, f"{notice}\nAccess denied. You do not have permission to view /20."), document(100, f"{notice}\nAccess denied. You do not have permission to view /21.", source=None)]
    d = folder(documents=docs)
    assert rows(residue.found(spark, d)) == {(99,), (100,)}
    assert {(r.source, r.n_excluded) for r in residue.kept(spark, d).collect()} == {("alpha", 1), (None, 1)}

"""Small tables with every kind of trouble, and empty ones."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

HI = "सरकारी परियोजना के अनुसार रामपुर में ८८२१ प्रतिशत खेत अब भी नदी पर निर्भर हैं।"
NE = "यस नदीबारे हाम्रो गाउँका मानिसले भने कि 229 वर्षअघि यहाँ सजिलो बाटो हुने गर्थ्यो।"
EN = "The work on the bridge went on for many months, and the people of the town were glad of it."
NOTICE = "इस लेख को अपने दोस्तों के साथ साझा करें 12"

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("manual", pa.bool_()), ("source_type", pa.string()), ("url", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")), ("site", pa.string()), ("keys", pa.string()), ("flags", pa.int32()), ("look", pa.string()), ("n_tokens", pa.int32()), ("share", pa.float64())]),
    "split_docs": pa.schema([("row_id", pa.int64()), ("text", pa.string()), ("source", pa.string()), ("manual", pa.bool_()), ("lang", pa.string()), ("split", pa.string()), ("evaluation", pa.string()), ("hash", pa.string()), ("site", pa.int64())]),
    "scored_examples": pa.schema([("score_id", pa.int64()), ("generated", pa.string()), ("gold", pa.string()), ("key", pa.string())]),
    "registry": pa.schema([("site", pa.string()), ("host", pa.string()), ("root", pa.string()), ("category", pa.string()), ("lang", pa.string())]),
    "mix_targets": pa.schema([("source", pa.string()), ("target_share", pa.float64()), ("max_repeat", pa.int32())]),
    "eval_items": pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("split", pa.string())]),
    "lang_samples": pa.schema([("sample_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())]),
    "common_words": pa.schema([("lang", pa.string()), ("word", pa.string())]),
}

WHEN = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def document(doc_id, text, lang="hi", source="alpha"):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text), "manual": None, "source_type": None, "url": None, "fetched_at": WHEN, "site": "clash", "keys": "clash", "flags": 1, "look": "clash", "n_tokens": 7, "share": 0.5}


def row(row_id, text, split, source="alpha"):
    return {"row_id": row_id, "text": text, "source": source, "manual": None, "lang": None, "split": split, "evaluation": "clash", "hash": "clash", "site": 3}


def tables():
    long = " ".join(f"शब्द{i % 977} {HI}" for i in range(3000))
    documents = [document(i, f"{HI}\n{NOTICE}\n{NE} {i}") for i in range(1, 9)]
    documents += [
        document(10, None),
        document(11, ""),
        document(12, " \n\t "),
        document(13, long),
        document(14, HI, None, None),
        document(15, HI, "??", "www.alpha.example"),
        document(16, EN, "hi"),
        document(16, EN, "hi"),
        document(17, "\n".join("• नाटक" for _ in range(60)), "hi"),
        document(18, "प्रिय undefined, आपके मैदान की पत्रिका रामपुर में undefined को तैयार है।"),
        document(19, "​‍"),
        document(20, HI.replace("सरकारी", "सरका​री")),
        document(21, "x" * 50_000),
        document(22, None, None, None),
        document(23, "..."),
        document(24, HI.replace("।", "|")),
    ]
    words = [f"w{i}" for i in range(40)]
    split = [row(1, " ".join(words), "train"), row(2, " ".join(words[:-1]), "val"), row(3, " ".join(words), "test"), row(3, " ".join(words), "test"), row(4, None, "train"), row(5, "", "val"), row(6, "one two", "test"), row(7, "One, TWO!", "train"), row(8, "...", "val"), row(9, long, "train"), row(10, long + " x", "val"), row(11, "alone", None), row(12, "abc", "train", None), row(13, "abc", "train", "www.alpha.example"), row(14, "abcd" * 30, "train", "beta")]
    scored = [{"score_id": i, "generated": g, "gold": t, "key": "clash"} for i, (g, t) in enumerate([(None, "a"), ("a", None), ("", ""), ("a", "a"), ("а", "a"), ("a​", "a"), ("​", "‌"), ("A", "a"), ("a?", "a")])]
    samples = [HI, "उस दिन गाँव की नदी में इतना पानी था कि लोग आगे नहीं चल सके।"], [NE, "त्यस दिन गाउँको नदीमा यति पानी थियो कि मानिसहरू अघि बढ्न सकेनन्।"], ["त्या दिवशी गावातील नदीला इतके पाणी होते की लोक पुढे जाऊ शकले नाहीत.", "सरकारी अहवाल नुसार येथील शेत आजही पावसावर अवलंबून आहे आणि लोक वाट पाहत आहेत."], [EN, "On that day there was so much water in the river that the people could not go on."]
    return {
        "documents": documents,
        "split_docs": split,
        "scored_examples": scored,
        "registry": [{"site": "alpha", "host": "www.alpha.example", "root": None, "category": "news", "lang": "hi"}, {"site": None, "host": None, "root": None, "category": None, "lang": None}, {"site": "gamma", "host": None, "root": None, "category": None, "lang": None}],
        "mix_targets": [{"source": "alpha", "target_share": 0.5, "max_repeat": 2}, {"source": "beta", "target_share": 0.4, "max_repeat": None}, {"source": "gamma", "target_share": 0.1, "max_repeat": 3}, {"source": None, "target_share": None, "max_repeat": None}],
        "eval_items": [{"item_id": 1, "text": HI, "lang": "hi", "split": "val"}, {"item_id": 2, "text": None, "lang": None, "split": "test"}, {"item_id": 3, "text": "", "lang": None, "split": "test"}, {"item_id": 4, "text": "The people of the town", "lang": "en", "split": "test"}, {"item_id": 1, "text": HI, "lang": "hi", "split": "val"}, {"item_id": 5, "text": "never seen anywhere", "lang": "en", "split": None}],
        "lang_samples": [{"sample_id": 10 * k + i, "lang": lang, "text": text} for k, (lang, texts) in enumerate(zip(("hi", "ne", "mr", "en"), samples, strict=True)) for i, text in enumerate(texts)] + [{"sample_id": 99, "lang": None, "text": None}],
        "common_words": [{"lang": "hi", "word": w} for w in "के में पर है हैं की अब भी".split()] + [{"lang": "ne", "word": w} for w in "कि यस थियो र छ".split()] + [{"lang": "en", "word": w} for w in "the of and on for it".split()] + [{"lang": None, "word": None}],
    }


def write(folder, rows):
    for name, schema in SCHEMAS.items():
        pq.write_table(pa.Table.from_pylist(rows.get(name, []), schema), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(tmp_path_factory):
    return write(tmp_path_factory.mktemp("edge"), tables())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"), {})


@pytest.fixture
def folder(tmp_path):
    """Writes tables of a test."""
    return lambda **rows: write(tmp_path, rows)

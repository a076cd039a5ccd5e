"""Sources, sinks and streams."""

import gzip
import hashlib
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from sarit.sources import html, jsonl, tokens
from sarit.streaming import frontier as streams


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "doc_id": "1"}\n\nnot json\n{"content": "y"}\n')
    assert jsonl.read(spark, str(tmp_path / "a.jsonl")).count() == 2
    with pytest.raises(Exception, match="MALFORMED|alformed"):
        jsonl.read(spark, str(tmp_path / "a.jsonl"), malformed="fail").collect()
    counted = jsonl.malformed_by_file(spark, str(tmp_path / "a.jsonl")).first()
    assert (counted._file, counted.n_lines, counted.n_malformed) == ("a.jsonl", 3, 1)


def test_listing(spark, tmp_path):
    for name, text in {"a.jsonl": "{}", "b.jsonl": "", "wiki_x.jsonl": "{}", "c.txt": "x"}.items():
        (tmp_path / name).write_text(text)
    got = {r.name: r.reason for r in jsonl.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": None, "b.jsonl": "empty", "wiki_x.jsonl": "wiki", "c.txt": "not_jsonl"}


def test_shards(spark, tmp_path):
    lines = "".join(json.dumps({"doc_id": str(i), "text": f"शब्द {i}"}, ensure_ascii=False) + "\n" for i in range(7000)).encode()
    (tmp_path / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(lines[: len(lines)]))
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(lines))
    (tmp_path / "c.jsonl").write_bytes(lines + b"broken\n")
    got = {r.file: r["count"] for r in jsonl.read_shards(spark, str(tmp_path)).groupBy("file").count().collect()}
    assert got == {"a.jsonl.zst": 7000, "b.jsonl.gz": 7000, "c.jsonl": 7000}


def test_write_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "train" if i % 2 else "val") for i in range(10)], "pos int, text string, split string")
    jsonl.write(df.coalesce(1), str(tmp_path / "out"), by=["split"], records=2, compression="none")
    assert len(list((tmp_path / "out" / "split=val").glob("*.json"))) == 3
    assert spark.read.json(str(tmp_path / "out")).count() == 10
    jsonl.write(df.coalesce(1), str(tmp_path / "sorted"), sort_keys=True, compression="none")
    file = next((tmp_path / "sorted").glob("*.json"))
    assert list(json.loads(file.read_text().splitlines()[0])) == ["pos", "split", "text"]
    mark = jsonl.fingerprints(spark, str(file)).first()
    assert mark.sha256 == hashlib.sha256(file.read_bytes()).hexdigest()
    assert jsonl.line_counts(spark, str(file)).first().n == 10


def test_html(spark):
    sentence = "यह एक लंबा वाक्य है जो लेख का हिस्सा है और जिसमें बहुत से शब्द हैं।"
    page = f"<html><body><nav><p>{sentence} nav</p></nav><article><h1>{sentence} शीर्षक</h1><p>{sentence}<br>दो <b>तीन</b></p><p>छोटा</p><p>{sentence}<br>दो <b>तीन</b></p><script>var a = '<p>{sentence}</p>';</script><ul><li>{sentence} &amp; सूची</ul></article><p>{sentence} outside</p></body></html>"
    got = html.blocks_of(page)
    assert got == [f"{sentence} शीर्षक", f"{sentence} दो तीन", "छोटा", f"{sentence} दो तीन", f"{sentence} & सूची"]
    pages = spark.createDataFrame([("u", page), ("v", None), ("w", "<p>x"), ("x", "")], "url string, html string")
    rows = html.documents(pages, least=100).collect()
    assert [r.url for r in rows] == ["u"]
    assert rows[0].text.split("\n") == [f"{sentence} शीर्षक", f"{sentence} दो तीन", f"{sentence} & सूची"]
    wiki = spark.createDataFrame([(json.dumps({"query": {"pages": {"7": {"title": "T", "extract": "E"}, "8": {"title": "U"}}}}),), ("{",)], "json string")
    assert [tuple(r) for r in html.wiki_text(wiki).collect()] == [("7", "T", "E")]


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [1, 65535, 3]), (0, 0, [9]), (1, 0, [])], "part int, pos int, ids array<int>")
    for r in tokens.content(df).collect():
        (tmp_path / f"{r.part}.bin").write_bytes(bytes(r.content))
    got = tokens.read(spark, str(tmp_path), block=3).orderBy("file", "block").collect()
    assert [(r.file, r.block, list(r.ids)) for r in got] == [("0.bin", 0, [9, 1, 65535]), ("0.bin", 1, [3])]
    with pytest.raises(Exception, match="16 bits"):
        tokens.content(spark.createDataFrame([(0, 0, [65536])], df.schema)).collect()


def test_frontier_stream(spark, tmp_path):
    schema = "url string, priority int, crawl_state string"
    for i, rows in enumerate([[("a", 1, "pending"), ("b", 2, "pending")], [("b", 0, "pending"), ("c", 3, "pending")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert (tmp_path / "out" / f"batch={i}").exists()
    got = {(r.url, r.priority) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 3)}
    again = spark.createDataFrame([("b", 0, "pending"), ("c", 3, "pending")], schema)
    streams.merge_into(str(tmp_path / "out"))(again, 1)  # as after a failure
    assert {(r.url, r.priority) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == got


def test_crawl_events(spark, tmp_path):
    rows = [("u1", "h", "done", 5, "2024-01-01 01:00:00"), ("u1", "h", "done", 5, "2024-01-01 01:00:00"), ("u2", "h", "done", 7, "2024-01-01 05:00:00"), ("u2", "h", "done", 9, "2024-01-01 06:00:00"), ("u3", "h", "done", 1, None)]
    df = spark.createDataFrame(rows, "url string, host string, crawl_state string, n_chars bigint, t string").withColumn("seen_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    query = streams.crawl_events(stream).writeStream.format("memory").queryName("crawl").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.chars > 11) for r in spark.sql("select * from crawl").collect()] == [(2, True)]


def test_zstd_shards_go_on(spark, tmp_path):
    df = spark.createDataFrame([(i, f"शब्द {i}") for i in range(25)], "pos bigint, text string").repartition(4)
    folder = str(tmp_path / "shards")
    assert {(r.file, r.n) for r in jsonl.write_shards(df, folder, 10).collect()} == {("shard-00000.jsonl.zst", 10), ("shard-00001.jsonl.zst", 10), ("shard-00002.jsonl.zst", 5)}
    assert [r.file for r in jsonl.write_shards(df.where("pos < 5"), folder, 10).collect()] == ["shard-00003.jsonl.zst"]
    files = jsonl.find_shards(spark, [str(tmp_path / "none"), str(tmp_path), folder])
    assert [f.rpartition("/")[2] for f in files] == [f"shard-0000{i}.jsonl.zst" for i in range(4)]
    got = jsonl.read_shards(spark, files, "pos bigint, text string").orderBy("file", "line").collect()
    assert [r.pos for r in got] == [*range(25), *range(5)] and got[7].text == "शब्द 7"
    with pytest.raises(FileNotFoundError, match="none"):
        jsonl.find_shards(spark, [str(tmp_path / "none")])


def test_splits_statistics_and_logs(spark, tmp_path):
    from sarit.operators.tokens import sentences

    df = spark.createDataFrame([(0, "एक। दो।", "train"), (1, "तीन।", "val")], "pos bigint, text string, split string")
    jsonl.write_splits(df, str(tmp_path), sentences(F.col("text")))
    assert {(r.split, r.pos) for r in spark.read.json(str(tmp_path / "splits")).collect()} == {("train", 0), ("val", 1)}
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "sentences")).collect()) == ["एक।", "दो।"]
    jsonl.write_statistics(df.groupBy("split").count(), str(tmp_path / "stats"))
    assert len(list((tmp_path / "stats").glob("*.json"))) == 1
    (tmp_path / "a.csv").write_text("step,train_loss,val_loss\n1,2.5,\n2,2.0,2.25\n")
    (tmp_path / "a.jsonl").write_text('{"step": 1, "val_loss": null}\n{"step": 2, "val_loss": 2.25}\n')
    for name in ("a.csv", "a.jsonl"):
        assert [(r.step, r.val_loss) for r in jsonl.validations(jsonl.training_log(spark, str(tmp_path / name))).collect()] == [(2, 2.25)]


def test_registry(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("manual_sites:\n- {name: a, domain: www.a.example, category: news}\n- {name: b}\n- text\n")
    assert {(r.site, r.host, r.category) for r in jsonl.registry(spark, str(tmp_path / "s.yaml")).collect()} == {("a", "www.a.example", "news"), ("b", None, "uncategorised")}
    assert jsonl.registry(spark, str(tmp_path / "none.yaml")).count() == 0


def test_token_files_with_meta(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FILE", 4)
    df = spark.createDataFrame([("train", 2, [7, 8]), ("train", 0, [1, 2, 3]), ("train", 1, [4, 5, 6]), ("val", 3, [9])], "split string, pos bigint, ids array<int>")
    meta = tokens.write(df, str(tmp_path / "bin"), {"vocab_size": 10})
    assert json.loads((tmp_path / "bin" / "meta.json").read_text()) == meta
    assert meta["splits"]["train"]["tokens"] == 8 and meta["splits"]["val"]["files"] == ["val-00000.bin"]
    raw = b"".join((tmp_path / "bin" / f).read_bytes() for f in meta["splits"]["train"]["files"])
    assert [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)] == list(range(1, 9))

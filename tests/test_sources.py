import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers
from lodestone.streaming import incremental


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"id": "x", "text": "hello"}\n\nnot json\n{"body": "b"}\n')
    (tmp_path / "sub" / "b.csv").write_text('id,message\n1,"two\nlines"\n')
    (tmp_path / "sub" / "c.txt").write_text("whole\nfile")
    (tmp_path / "d.md").write_text("  ")
    rows = readers.read_folder(spark, str(tmp_path)).collect()
    texts = sorted(r.text for r in rows if r.text)
    assert texts == ["b", "hello", "two\nlines", "whole\nfile"]
    assert [r.read_error for r in rows if r.read_error] == ["not a JSON object"]
    assert "x" in {r.source_id for r in rows}


def test_json_documents(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "one"}, {"context": "two"}]}]}))
    assert sorted(r.text for r in readers.read_json_documents(spark, str(tmp_path / "q.json")).collect()) == ["one", "two"]


def test_strict_reads(spark, tmp_path):
    (tmp_path / "x.csv").write_text("file,message\na,b\n")
    assert readers.read_csv(spark, str(tmp_path / "x.csv"), ["file", "message"]).count() == 1
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "x.csv"), ["file"])
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "title": "T", "text": "b"}\n{"_id": "2", "title": "", "text": "c"}\n')
    assert sorted(r.text for r in readers.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()) == ["T\n\nb", "c"]


def test_sink_and_inventory(spark, tmp_path):
    df = spark.range(5)
    readers.write_jsonl(df, str(tmp_path / "out"))
    readers.write_jsonl(df, str(tmp_path / "out"), append=True)
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "id long").count() == 10
    assert readers.inventory(spark, str(tmp_path / "out")).where("length(sha256) = 64").count() >= 2


def test_waves_match_the_batch(spark, tmp_path):
    rows = spark.range(100).withColumn("n", F.col("id") * 3)
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    source = lambda: incremental.stream_files(spark, str(tmp_path / "in"), rows.schema, 2)
    for _ in range(2):  # a second run finds nothing new
        incremental.run_waves(source(), lambda d: d.where("n % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("wave").distinct().count() == 3
    assert sorted(r.id for r in got.collect()) == [k for k in range(100) if k * 3 % 2 == 0]


def test_compaction(spark):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 1, "error"), ("b", 2, "error")], "k string, at int, state string")
    got = incremental.compacted(log, "k", F.col("state") == "ok", "at").collect()
    assert sorted((r.k, r.at) for r in got) == [("a", 1), ("b", 2)]


def test_rate(spark, tmp_path):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 20) AS ts FROM range(9)")
    assert sorted((r.n) for r in incremental.rate(df, "ts").collect()) == [3, 3, 3]


def test_folder_reads_json_by_item(spark, tmp_path):
    long = "a sentence of more than forty characters in a field of no known name"
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "text": "one"}, 5, {"other": long, "n": 7}, {"paragraphs": [{"context": "two"}, {"body": "three"}], "text": "outer"}]))
    (tmp_path / "b.json").write_text("{not json")
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"body": "B", "text": " "}]}))
    (tmp_path / "d.jsonl").write_text(json.dumps({"sample_id": 9, "whatever": long}) + "\n\n[1]\n")
    rows = readers.read_folder(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows if r.text) == sorted(["one", long, "two", "three", "B", long])
    assert sorted(r.source_path.rsplit("/", 1)[1] for r in rows if r.read_error) == ["b.json", "d.jsonl"]
    assert {"x", "9"} <= {r.source_id for r in rows}
    assert all(r.source_id for r in rows) and "outer" not in {r.text for r in rows}


def test_text_fields_come_in_order(spark):
    df = spark.createDataFrame([("b", "t", "c"), ("b", " ", "c"), (None, None, "c"), ("", "", "")], "body string, text string, content string")
    assert [r[0] for r in df.select(readers.main_text(df)).collect()] == ["t", "b", "c", None]


def test_articles(spark, tmp_path):
    xml = '<article><front><article-id pub-id-type="doi">d</article-id><article-id pub-id-type="pmc"> pmc7 </article-id><abstract><p>First <b>part</b>.</p></abstract></front><body><sec>Second.</sec></body></article>'
    broken = '<article><article-id pub-id-type="pmc">PMC8</article-id><body>open'
    lines = [{"data": xml}, {"data": ["s", broken]}, {"text": "<a>none</a>"}, {"data": 5}, {"data": ""}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n")
    rows = readers.read_articles(spark, str(tmp_path)).collect()
    assert {r.source_id: r.text for r in rows if r.source_id} == {"PMC7": "First part .\n\nSecond.", "PMC8": broken}
    assert [r.read_error for r in rows if not r.source_id] == ["no PMC id"] * 3

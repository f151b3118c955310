"""Sources, sinks and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators.packing import greedy_bins
from textloom.sources import files, sinks
from textloom.streaming import streams


def test_conversation_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")])], "conv_id long, messages array<struct<role:string,content:string>>")
    path = sinks.publish(df, str(tmp_path), {"seed": 1})
    back = files.read_conversations(spark, path).first()
    assert back["conv_id"] == 1 and back["messages"][1]["content"] == "b" and back["messages"][0]["token_ids"] is None and back["type"] is None
    assert json.loads((tmp_path / "manifest.json").read_text())["rows"] == 1
    for f in (lambda: files.read_conversations(spark, "x.pkl"), lambda: sinks.write_conversations(df, "x.pkl")):
        with pytest.raises(ValueError):
            f()
    assert sinks.preview(df, "conv_id", turns=2).first()["message_1"] == "b"
    assert sinks.sample_name("niah", {"a": 1}) == sinks.sample_name("niah", {"a": 1})
    assert [r["name"] for r in files.discover(spark, str(tmp_path)).collect()] and files.config_beside(path) is None


def test_directory_and_latex(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1")
    (tmp_path / "b.txt").write_bytes(b"caf\xe9")
    (tmp_path / "c.exe").write_bytes(b"\x00")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "z.tex").write_text("late % gone\n")
    (tmp_path / "m.tex").write_text("early\n% gone\n")
    rows = {r["name"]: r for r in files.read_directory(spark, str(tmp_path), (".py", ".txt")).collect()}
    assert set(rows) == {"a.py", "b.txt"} and rows["b.txt"]["text"] == "café" and rows["a.py"]["context"] == "File: a.py\n\nx = 1"
    assert files.read_latex(spark, str(tmp_path)).first()["text"] == "% Content from: m.tex\nearly\n\n% Content from: sub/z.tex\nlate"


def test_json_tables_and_patients(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"columns": ["step", "loss"], "data": [["1", "0.5"], ["2", None]]}))
    rows = files.read_json_tables(spark, str(tmp_path / "t.json"), "loss double, step int, other string").collect()
    assert [(r["step"], r["loss"], r["other"]) for r in rows] == [(1, 0.5, None), (2, None, None)]
    (tmp_path / "p.json").write_text(json.dumps({"patient_01": {"questions": [{"No": 0, "question": "q", "correct": "c"}]}, "patient_02": {"questions": []}}))
    assert [tuple(r) for r in files.read_patients(spark, str(tmp_path / "p.json"), ["patient_01"]).collect()] == [("patient_01", "patient_01_0", "q", "c")]


def test_shards_and_union(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 2).write.parquet(str(tmp_path / f"part{i}.parquet"))
    assert [r["id"] for r in files.read_shards(spark, str(tmp_path), 3).collect()] == [0, 1, 10]
    both = files.union_sources([spark.range(2), spark.range(1).withColumn("x", F.lit(1))])
    assert both.count() == 3 and {r["x"] for r in both.collect()} == {None, 1}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i % 2, i, (i * 7) % 13) for i in range(60)], "shard long, ord long, length long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("shard long, ord long, length long").parquet(src)
    q = streams.pack_stream(stream, "shard", "ord", "length", 16).writeStream.format("memory").queryName("packed").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("SELECT * FROM packed").collect()
    for s in (0, 1):
        own = sorted((r["ord"], r["length"], r["bin"]) for r in rows if r["shard"] == s)
        assert [b for _, _, b in own] == greedy_bins([n for _, n, _ in own], 16, "pad")
    ev = str(tmp_path / "ev")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, id) AS ts, 'a' AS label FROM range(40)").write.parquet(ev)
    s = streams.bucket_counts(spark.readStream.schema("ts timestamp, label string").parquet(ev), "ts", "label", "10 days", "1 day")
    q = s.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["n"] for r in spark.sql("SELECT * FROM buckets").collect()) == 40


def test_sources_by_kind(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a BEG b</p> END")
    got = lambda kind, **kw: files.load_source(spark, kind, str(tmp_path / "p.html"), **kw).first()["text"]
    assert got("page") == "a BEG b\nEND" and got("section", start="BEG", end="END") == "BEG b</p> END"
    with pytest.raises(ValueError):
        got("pdf")
    (tmp_path / "e.json").write_text(json.dumps([{"q": "head"}, {"q": "one"}, {"q": "two"}]))
    assert [r["q"] for r in files.read_examples(spark, str(tmp_path / "e.json"), "struct<q:string>", expect=2).collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        files.read_examples(spark, str(tmp_path / "e.json"), "struct<q:string>", expect=5)


def test_unflatten(spark):
    from textloom.functions.text import conversation_html
    from textloom.operators.explore import unflatten, unflatten_rows

    assert unflatten([("a.b", 1), ("a.c.0", 2), ("a.c.1", 3), ("d", float("nan")), ("e", None)]) == {"a": {"b": 1, "c": [2, 3]}}
    df = spark.createDataFrame([(1, "a.0", "x"), (1, "a.1", "y"), (2, "k", None)], "id long, path string, value string")
    assert {r["id"]: r["json"] for r in unflatten_rows(df, "id", "path", "value").collect()} == {1: '{"a": ["x", "y"]}', 2: "{}"}
    m = spark.createDataFrame([([("user", "a < b"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert m.select(conversation_html("m").alias("h")).first()["h"] == "<p><b>user</b>: a &lt; b</p>\n<p><b>assistant</b>: </p>"

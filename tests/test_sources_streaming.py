"""Readers, writers, the ledger and the streaming forms."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from codegrain.functions.featurize import token_rows
from codegrain.sources import readers as rd
from codegrain.sources import writers as wr
from codegrain.streaming import lexing as st


def test_label_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("raw/py/a__b__c.py", "4:3,9:1"), ("x.py", ""), (None, "1:1"), ("raw/c/f.c", "0:2")], "path string, rle string")
    wr.write_labels(df, str(tmp_path / "labels"))
    (tmp_path / "labels" / "extra.txt").write_text("raw/go/f.go\t1:2\t9\nno tab\nraw/go/g.go\t\n")
    got = {(r["path"], r["rle"], r["lang"]) for r in rd.label_shards(spark, str(tmp_path / "labels")).collect()}
    assert got == {("raw/py/a__b__c.py", "4:3,9:1", "py"), ("raw/c/f.c", "0:2", "c"), ("raw/go/f.go", "1:2\t9", "go")}


def test_items_denylist_popularity_folder(spark, tmp_path):
    item = {"split": "val", "family": "js", "path": "p", "sourceLabels": [{"from": 0, "to": 2, "class": "keyword"}]}
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write(json.dumps(item) + "\n\n" + json.dumps(item | {"split": "train"}) + "\n")
    rows = rd.items(spark, str(tmp_path / "*.jsonl.gz"), ["val"]).collect()
    assert len(rows) == 1 and rows[0]["sourceLabels"][0]["confidence"] is None
    (tmp_path / "exclude.a.sha256").write_text("AB\n\n cd \nab\n")
    assert {r[0] for r in rd.denylist(spark, str(tmp_path / "exclude.*.sha256")).collect()} == {"ab", "cd"}
    (tmp_path / "pop.json").write_text(json.dumps({"languages": [{"family": "a", "pushers": 3}, {"family": "b", "pushers": 9, "supplemental": True}, {"family": "c", "pushers": 1}]}))
    assert [r[0] for r in rd.popularity(spark, str(tmp_path / "pop.json"), 1).collect()] == ["a"]
    (tmp_path / "raw" / "py").mkdir(parents=True)
    (tmp_path / "raw" / "py" / "a.py").write_bytes("é".encode())
    (tmp_path / "raw" / "py" / "b.py").write_bytes(b"\xff\xfe")
    assert [(r["lang"], r["text"]) for r in rd.raw_folder(spark, str(tmp_path / "raw")).collect()] == [("py", "é")]


def test_cache_denylist_and_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "x"), (2, "val", "y"), (3, "val", None), (4, "val", "x")], "id int, split string, text string")
    wr.write_split_cache(df, str(tmp_path / "cache"))
    assert {r[0] for r in rd.split_cache(spark, str(tmp_path / "cache"), "val", ["id"]).collect()} == {2, 3, 4}
    wr.write_denylist(df, "text", str(tmp_path / "deny"))
    assert rd.denylist(spark, str(tmp_path / "deny")).count() == 2
    wr.write_meta(df.agg(F.count("*").alias("n")), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first()["n"] == 4
    wr.publish_gate(2, 185, 95, 100)
    for bad in ((1, 185, 95, 100), (2, 184, 95, 100), (2, 185, 94, 100)):
        with pytest.raises(ValueError):
            wr.publish_gate(*bad)


def test_ledger_skips_and_forgets(tmp_path):
    ran = []
    path = tmp_path / "ledger.json"
    stages = ["a", "b", "c"]
    for stage in stages:
        assert wr.Ledger(path, stages).run(stage, lambda s=stage: ran.append(s))
    assert not wr.Ledger(path, stages).run("b", lambda: ran.append("again"))
    again = wr.Ledger(path, stages)
    again.done.pop("a")
    assert again.run("a", lambda: ran.append("a2")) and again.run("c", lambda: ran.append("c2"))
    assert ran == ["a", "b", "c", "a2", "c2"]
    path.write_text(json.dumps({"format": 0, "completed": {"a": "x"}}))
    assert wr.Ledger(path, stages).run("a", lambda: None)


def test_streamed_counts_equal_the_table(spark, sf_dir, tmp_path):
    files = spark.read.parquet(f"{sf_dir}/files.parquet").select("file_id", "lang", "text")
    files.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = st.stream_files(spark, str(tmp_path / "in"), files.schema)
    counts = st.language_counts(st.stream_tokens(stream, "file_id", "text", "compact_v2", ["kind"], "lang"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    want = st.language_counts(token_rows(files, "file_id", "text", "compact_v2", ["kind"], "lang"))
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, want.collect()))


def test_streamed_windows_cap_and_latest(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = st.stream_files(spark, str(tmp_path / "ev"), events.schema)
    q = st.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("append").format("memory").queryName("win").start()
    q.processAllAvailable()
    q.stop()
    whole = {(r[0], r[2]): r[3] for r in events.groupBy(F.window("ts", "5 minutes"), "event_type").count().select("window.start", "window.end", "event_type", "count").collect()}
    got = {(r[0], r[2]): r[3] for r in spark.table("win").collect()}
    assert got and all(whole[k] == n for k, n in got.items())

    rows = spark.createDataFrame([(i, f"f{i % 3}") for i in range(30)], "id int, fp string")
    rows.repartition(3).write.parquet(str(tmp_path / "fp"))
    q = st.capped(st.stream_files(spark, str(tmp_path / "fp"), rows.schema), "fp", 2).writeStream.outputMode("append").format("memory").queryName("cap").start()
    q.processAllAvailable()
    q.stop()
    assert {r[0]: r[1] for r in spark.table("cap").groupBy("fp").count().collect()} == {"f0": 2, "f1": 2, "f2": 2}

    sink = st.latest_wins(str(tmp_path / "out"), "k", "v")
    batch = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    sink(batch, 0)
    sink(batch, 0)
    assert {tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).select("k", "v").collect()} == {("a", 3), ("b", 2)}

"""Readers, sinks and streams on files made here."""

from __future__ import annotations

import json

import pytest

from siltline.sources import readers as R
from siltline.sources import sinks as S
from siltline.streaming.rollup import current, event_stream, hourly_stream, ingest_captures
from siltline.session import table
from pyspark.sql import functions as F


def test_posts_and_rejects(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.json").write_text("﻿" + json.dumps({"id": "x", "source": {"platform": "p"}, "original_text": "t", "extra": 1}), encoding="utf-8")
    (tmp_path / "2.json").write_text(json.dumps({"job_id": "j"}))
    (tmp_path / "3.json").write_text("{broken")
    (tmp_path / "4.json").write_text(json.dumps({"id": "y"}))
    posts, rejects = R.read_posts(spark, str(tmp_path))
    assert [(r.id, r.source.platform, r.original_text) for r in posts.collect()] == [("x", "p", "t")]
    assert sorted(r.reason for r in rejects.collect()) == ["job manifest", "missing fields", "unreadable"]


def test_jsonl_isolates_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":"1","text":"a"}\n\nnot json\n{"id":"2"}\n[1]\n')
    rows, issues = R.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string, text string")
    assert sorted((r.line_no, r.id, r.text) for r in rows.collect()) == [(1, "1", "a"), (4, "2", None)]
    assert sorted(r.line_no for r in issues.collect()) == [3, 5]


def test_saved_lists(spark, tmp_path):
    (tmp_path / "l.csv").write_text('URL,Saved Date,Title\nhttps://a.example/p/1,2024,"x, y"\n,,none\n')
    items, issues = R.read_saved_list(spark, str(tmp_path / "l.csv"))
    assert [(r.url, r.title, r.saved_at) for r in items.collect()] == [("https://a.example/p/1", "x, y", "2024")]
    assert issues.count() == 1
    (tmp_path / "l.txt").write_text("# comment\nsee https://a.example/x). later\nno link\n")
    items, issues = R.read_saved_list(spark, str(tmp_path / "l.txt"))
    assert [r.url for r in items.collect()] == ["https://a.example/x"] and issues.count() == 1
    (tmp_path / "s.csv").write_text("url,Session-ID\nhttps://a.example,1\n")
    with pytest.raises(ValueError, match="credential"):
        R.read_saved_list(spark, str(tmp_path / "s.csv"))


def test_pages_and_bookmarks(spark):
    html = '<html><head><title>no</title><meta property="og:title" content="T"></head><body><script>var a="</p>"</script><p>One  two</p><div>three<br>four</div><time datetime="2024-01-02">x</time></body></html>'
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    r = df.select(R.page_parts("h").alias("p")).select("p.*").collect()
    assert (r[0].title, r[0].published, r[0].text) == ("T", "2024-01-02", "One two\nthree\nfour\nx") and r[1].text is None
    links = spark.createDataFrame([('<DT><A HREF="https://a.example">A  b</A><DT><A HREF="">c</A>',)], "h string").select(F.explode(R.bookmark_links("h")).alias("x")).select("x.*").collect()
    assert [(x.url, x.title) for x in links] == [("https://a.example", "A b")]


def test_media_index_sees_wrong_names(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "b.jpg").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"y")
    (tmp_path / "c.bin").write_bytes(b"?")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = {r.name: (r.format, r.misnamed, r.size) for r in R.media_index(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", False, 9), "b.jpg": ("png", True, 9), "c.bin": ("unknown", False, 1)}


def test_publish_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a",), ("b",)], "d string")
    assert S.publish_changed(df, path, "d") == 2
    assert S.publish_changed(df, path, "d") == 0
    assert S.publish_changed(spark.createDataFrame([("a",), ("c",)], "d string"), path, "d") == 2
    assert sorted(r.d for r in S.published(spark, path).collect()) == ["a", "c"]
    with pytest.raises(ValueError, match="publication"):
        S.assert_public(spark.createDataFrame([(r"c:\Users\me",)], "d string"))
    assert S.assert_public(df) is df


def test_stream_equals_batch(spark, small, tmp_path):
    q = hourly_stream(event_stream(spark, small)).writeStream.format("memory").queryName("hourly_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {(r.hour, r.event_type): (r.n, r.total) for r in spark.table("hourly_test").collect()}
    want = {(r.hour, r.event_type): (r.n, r.total) for r in table(spark, small, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in got)


def test_intake_keeps_the_latest_row(spark, tmp_path):
    schema = "id string, ingested_at int, text string"
    for n, rows in enumerate([[("a", 1, "old"), ("b", 5, "b")], [("a", 2, "new"), ("b", 3, "late")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest_captures(stream, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.id, r.text) for r in current(spark, str(tmp_path / "store")).collect()}
    assert got == {("a", "new"), ("b", "b")}

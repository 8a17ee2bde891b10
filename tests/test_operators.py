"""Operators against brute force and on awkward tables."""

from __future__ import annotations

import random
import re

import pytest

from siltline.functions import text as T
from siltline.functions import urls as U
from siltline.operators.dedupe import keepers
from siltline.operators.merging import merge_lists
from siltline.operators.questions import THRESHOLD, merge_similar
from pyspark.sql import functions as F

Q = "question_no long, question string, answer string, post_id string, key string, words string"


def _words(t: str | None) -> frozenset:
    return frozenset(w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split() if w not in T.STOP_WORDS)


def _greedy(rows: list[tuple[int, str | None]]) -> dict[int, int]:
    kept: list[tuple[int, frozenset]] = []
    out = {}
    for n, t in sorted(rows):
        w = _words(t)
        for m, x in kept:
            if w == x or (w and x and len(w & x) / len(w | x) >= THRESHOLD):
                out[n] = m
                break
        else:
            kept.append((n, w))
            out[n] = n
    return out


@pytest.mark.parametrize("last", [200_000, 0])  # one task for all pairs, and rounds to the end
def test_similar_questions_as_greedy_brute_force(spark, monkeypatch, last):
    from siltline.operators import questions

    monkeypatch.setattr(questions, "LAST_EDGES", last)
    r = random.Random(5)
    vocab = [f"w{k}" for k in range(14)]
    rows = [(n, " ".join(r.sample(vocab, r.choice([9, 10, 11, 12, 13])))) for n in range(1, 160)] + [(200, None), (201, ""), (202, "what is the"), (203, "w1 w2"), (204, "w2 w1")]
    df = spark.createDataFrame([(n, t, None, None, "clash", "clash") for n, t in rows], Q)
    got = {x.question_no: x.survivor_no for x in merge_similar(df).collect()}
    assert got == _greedy(rows)


def test_similar_questions_of_none(spark):
    assert merge_similar(spark.createDataFrame([], Q)).count() == 0


def test_keeper_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 4), (4, None, 9), (5, None, 9), (6, "b", 1)], "n long, d string, s int")
    assert {(x.n, x.duplicate_of) for x in keepers(df, F.col("d"), "n", [F.col("s")]).collect()} == {(2, 1), (3, 1)}


def test_list_merge_fills_only_empty_fields(spark):
    s = spark.createDataFrame([("u", "", "t"), ("v", "x", None), ("w", "q", "q")], "k string, a string, b string")
    i = spark.createDataFrame([("u", "new", "other"), ("u", None, "z"), ("y", "1", "2"), ("w", "r", "r"), (None, "1", "1")], "k string, a string, b string")
    got = {x.k: (x.a, x.b, x.status) for x in merge_lists(s, i, "k", ["a", "b"]).collect()}
    assert got == {"u": ("new", "t", "updated"), "v": ("x", None, "stored"), "w": ("q", "q", "kept"), "y": ("1", "2", "added")}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://User@Host.Example:8080//a//b/?utm_source=x&b=2&a=1#frag", "https://host.example/a/b?a=1&b=2"),
        ("http://h.example", "http://h.example"), ("ftp://h.example/x", None), ("", None), (None, None), ("https:///nohost", None), ("https://h.example/?REF=1", "https://h.example"),
    ],
)
def test_addresses(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(U.canonical_url(F.col("u")).alias("c")).first().c == want


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, "empty"), (" \n", "empty"), ("one two", "fragmentary"), ("this is plainly readable text", "readable"), ("#@# ## $$ %% **** ab cd ef gh", "garbled"), ("spam " * 12, "garbled"), ("bad � glyph in here now", "garbled"), ("word " * 11 + "this fits fine", "garbled")],
)
def test_quality(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.ocr_quality(F.col("t")).alias("q")).first().q == want


def test_search_gives_every_hit(spark, tmp_path):
    from siltline.plans.posts import q_search

    posts = spark.range(5000, numPartitions=4).selectExpr(
        "id AS row_no", "concat('p', id) AS id", "if(id % 2 = 0, 'A Kafka pipeline.', 'A pipeline.') AS original_text",
        "named_struct('summary', cast(null AS string), 'topics', cast(null AS array<string>)) AS ai_analysis",
    )
    posts.write.parquet(f"{tmp_path}/posts.parquet")
    got = [(r.row_no, r["rank"]) for r in q_search(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(2 * k, k + 1) for k in range(2500)]


def test_every_question_is_ranked(spark):
    import duckdb

    from siltline.plans.questions import ORACLE, QUERIES

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view questions as select * from '{d}/questions.parquet'")
    got = sorted((r.question_no, r["rank"]) for r in QUERIES["sort_questions"](spark, d).collect())
    assert len(got) == 1500 and got == sorted(con.sql(ORACLE["sort_questions"]).fetchall())

"""Every registered core query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from siltline.plans import registered

QUERIES, ORACLE = registered()


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    have = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert have == want


def test_queries_without_sql_are_tested_here():
    assert set(QUERIES) - set(ORACLE) == {"p7_found", "p7_status", "agg_question_merge"}


def test_similar_questions_of_the_tables_as_brute_force(spark, small):
    import pandas as pd

    from tests.test_operators import _greedy

    q = pd.read_parquet(f"{small}/questions.parquet")
    got = {r.question_no: r.survivor_no for r in QUERIES["agg_question_merge"](spark, small).collect()}
    assert got == _greedy(list(zip(q.question_no.tolist(), [t if isinstance(t, str) else None for t in q.question], strict=True)))


def test_every_written_time_has_one_status_and_found_ones_an_instant(spark, small):
    import datetime as dt

    import pandas as pd

    p = pd.read_parquet(f"{small}/posts.parquet")
    found = {(r.row_no, r.field): r.utc_us for r in QUERIES["p7_found"](spark, small).collect()}
    assert len(found) == QUERIES["p7_found"](spark, small).count() > len(p)
    written = {(n, f): s[f] for n, s in zip(p.row_no, p.source, strict=True) for f in ("captured_at", "published_at")}
    assert set(found) <= {k for k, v in written.items() if v and v.strip()}
    # what is written in full, with its offset, must be that instant
    whole = {k: v for k, v in written.items() if v and len(v) >= 25 and v[10:11] == "T" and (v.endswith("+00:00") or v[-6:-5] in "+-")}
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert len(whole) > 5 and all(found[k] == (dt.datetime.fromisoformat(v) - epoch) // dt.timedelta(microseconds=1) for k, v in whole.items())
    status = QUERIES["p7_status"](spark, small).collect()
    assert sum(r.n for r in status) == 2 * len(p) and sum(r.n for r in status if r.instant_status == "unresolvable") <= 2 * len(p) - len(found)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())

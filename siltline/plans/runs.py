"""Queries over the log of enrichment runs and the event stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()


def _r(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_state")


@R.query("SELECT coalesce(status, 'unknown') AS status, count(*) AS n, coalesce(sum(attempts), 0)::BIGINT AS attempts, coalesce(sum(retried), 0)::BIGINT AS retried FROM run_state GROUP BY 1")
def agg_run_counts(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d).groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("long").alias("attempts"), F.coalesce(F.sum("retried"), F.lit(0)).cast("long").alias("retried"))


@R.query("SELECT worker_id, count(*) AS n, count(DISTINCT post_id) AS n_posts, round(coalesce(sum(seconds_taken), 0), 3) AS seconds, round(max(seconds_taken), 3) AS longest FROM run_state GROUP BY 1")
def agg_run_report(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d).groupBy("worker_id").agg(F.count("*").alias("n"), F.countDistinct("post_id").alias("n_posts"), F.round(F.coalesce(F.sum("seconds_taken"), F.lit(0.0)), 3).alias("seconds"), F.round(F.max("seconds_taken"), 3).alias("longest"))


@R.query("SELECT post_id, min(run_no) AS first_run, sum(attempts)::BIGINT AS attempts, count(*) AS runs, max(finished_at) AS last_finished FROM run_state GROUP BY 1")
def agg_state_merge(spark: SparkSession, d: str) -> DataFrame:
    """Totals of resumed runs of each post."""
    return _r(spark, d).groupBy("post_id").agg(F.min("run_no").alias("first_run"), F.sum("attempts").cast("long").alias("attempts"), F.count("*").alias("runs"), F.max("finished_at").alias("last_finished"))


# Parts of messages and the kind of failure that they tell, tested in this order.
FAILURES = {
    "local": ["post directory does not exist", "could not locate"],
    "truncated": ["without finish_reason", "invalid-output", "invalid_output", "unexpected eof", "premature end", "stream ended", "stream closed", "truncated", "incomplete json", "expecting ',' delimiter", "unterminated string", "expecting property name"],
    "permanent": ["401", "403", "unauthorized", "unauthenticated", "forbidden", "invalid api key", "invalid_api_key", "incorrect api key", "no api key", "api key not", "model not found", "does not exist", "unknown model", "no such model", "bad request", "400", "unsupported", "not supported", "billing", "quota exceeded", "payment required"],
    "transient": ["timeout", "timed out", "rate limit", "rate_limit", "too many requests", "429", "500", "502", "503", "504", "529", "overloaded", "capacity", "service unavailable", "connection reset", "connection refused", "connection aborted", "eof occurred", "temporarily unavailable", "try again"],
    "schema": ["validation error", "did not match the expected structure"],
}
# a value that opens like a JSON object and did not parse was cut, whatever else the message says, unless the failure is local
FRAGMENT = r"input_value='?[ \t\n]*\{[ \t]*(?:\\n)?[ \t]*\\?\""
FINAL = ("local", "permanent")
# messages as they are logged, and such messages for each kind, by attempts
_MESSAGES = ["", ": HTTP 503, try again", ": Unterminated string at 12", ": model not found", ": 1 validation error", ": post directory does not exist", ": validation error, input_value='{ \"a"]


def failure_kind(message: Column) -> Column:
    """The kind of a failure by its message: local, truncated, permanent, transient, schema or unknown."""
    low = F.lower(message)
    hit = {k: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in ps]) for k, ps in FAILURES.items()}
    out = F.when(hit["local"], "local").when(message.rlike("(?i)" + FRAGMENT), "truncated")
    for k in list(FAILURES)[1:]:
        out = out.when(hit[k], k)
    return out.otherwise("unknown")


_quoted = lambda p: "'" + p.replace("'", "''") + "'"
_any = lambda k: "(" + " OR ".join(f"contains(lower(m), {_quoted(p)})" for p in FAILURES[k]) + ")"
_FAIL = f"CASE WHEN {_any('local')} THEN 'local' WHEN regexp_matches(m, {_quoted('(?i)' + FRAGMENT)}) THEN 'truncated' " + " ".join(f"WHEN {_any(k)} THEN '{k}'" for k in list(FAILURES)[1:]) + " ELSE 'unknown' END"
_LOGGED = "(SELECT run_no, error_message || [" + ", ".join(map(_quoted, _MESSAGES)) + "][(run_no % 7 + 1)::INTEGER] AS m FROM run_state WHERE error_message IS NOT NULL)"


@R.query(f"SELECT run_no, {_FAIL} AS kind, {_FAIL} NOT IN ('local', 'permanent') AS recoverable FROM {_LOGGED}")
def map_failure_kind(spark: SparkSession, d: str) -> DataFrame:
    """The kind of each logged failure, with details behind the logged messages as providers write them."""
    more = F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("run_no") % 7 + 1).cast("int"))
    r = _r(spark, d).filter("error_message is not null").select("run_no", failure_kind(F.concat("error_message", more)).alias("kind"))
    return r.select("run_no", "kind", (~F.col("kind").isin(*FINAL)).alias("recoverable"))


@R.query("SELECT run_no, least(2 * power(2, attempts - 1), 30)::DOUBLE AS wait_seconds FROM run_state WHERE attempts >= 1 AND retried > 0")
def inc_retry(spark: SparkSession, d: str) -> DataFrame:
    """The wait before the next attempt: doubling, at most 30 seconds."""
    return _r(spark, d).filter("attempts >= 1 and retried > 0").select("run_no", F.least(2 * F.pow(F.lit(2.0), F.col("attempts") - 1), F.lit(30.0)).alias("wait_seconds"))


@R.query("""
SELECT r.run_no FROM run_state r WHERE EXISTS (SELECT 1 FROM run_state o WHERE o.post_id IS NOT DISTINCT FROM r.post_id AND o.worker_id IS NOT DISTINCT FROM r.worker_id AND o.finished_at IS NOT DISTINCT FROM r.finished_at AND o.status IS NOT DISTINCT FROM r.status AND o.attempts IS NOT DISTINCT FROM r.attempts AND o.run_no < r.run_no)""")
def win_keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Log rows that repeat an earlier one."""
    keys = ["post_id", "worker_id", "finished_at", "status", "attempts"]
    x = _r(spark, d).select("run_no", F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]).alias("h"), F.sha1(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])).alias("s"))
    first = x.groupBy("h", "s").agg(F.min("run_no").alias("first"))
    return x.join(first, F.col("run_no") == F.col("first"), "left_anti").select("run_no")


@R.query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def agg_events_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind by hour: the batch form of the streaming rollup."""
    from siltline.streaming.rollup import hourly

    return hourly(table(spark, d, "events"))


@R.query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def smoke_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """A plain aggregation over a wide table: filter and columns are pushed to the scan."""
    f = table(spark, d, "lineitem").filter("l_shipdate <= timestamp'1998-09-02'")
    return f.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@R.query("""
SELECT c.c_custkey, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY 1""")
def smoke_join(spark: SparkSession, d: str) -> DataFrame:
    """A plain join; the orders are summed per customer before they are joined."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey").join(o, "c_custkey")


QUERIES, ORACLE = R.queries, R.oracle

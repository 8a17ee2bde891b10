"""Saved items and results over several runs: merging, upserting, refreshing, budgets, reports.

An item is a row with a key, descriptive fields, a content digest and a state. What is stored wins, what is empty is filled, and a
changed digest brings the content anew; see ``merge_items``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of an item in the order of their rank, the outcomes of a plan, the qualities of a capture.
STATES = ["PENDING", "FAILED", "CAPTURED", "IMPORTED", "ENRICHED"]
OUTCOMES = ["NEW", "CHANGED", "UNCHANGED", "DUPLICATE", "MISSING_CAPTURE", "INVALID", "FAILED"]
QUALITIES = ["text", "text_and_media", "image_only", "document_only", "partial", "metadata_only"]
# Why a collection stops; runs that stop for one of the last three have failed.
STOP_REASONS = ["exhausted", "max_posts", "until_date", "scroll_limit", "layout_changed", "failed"]
FAILED_STOPS = ["scroll_limit", "layout_changed", "failed"]


def said(c: Column) -> Column:
    """The value unless it is null or empty."""
    return F.nullif(c, F.lit(""))


def rank(state: Column) -> Column:
    """The rank of a state; an unknown or missing one is below all."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0))


def merge_items(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str], content: list[str], digest: str = "digest", state: str = "state") -> DataFrame:
    """key, fields, content, digest, state, status (new, merged, stored) of two tables with one row a key.

    A field is filled if it is empty. A digest that the incoming row has and that differs replaces all content and sets
    CAPTURED; then the higher of both states holds.
    """
    s = stored.select(F.col(key), *[F.col(c).alias(f"s_{c}") for c in [*fields, *content, digest, state]], F.lit(True).alias("s_there"))
    i = incoming.select(F.col(key), *[F.col(c).alias(f"i_{c}") for c in [*fields, *content, digest, state]], F.lit(True).alias("i_there"))
    j = s.join(i, key, "full_outer")
    new, known = F.col("s_there").isNull(), F.col("i_there").isNotNull()
    changed = F.coalesce(said(F.col(f"i_{digest}")).isNotNull() & ~F.coalesce(F.col(f"s_{digest}"), F.lit("")).eqNullSafe(F.col(f"i_{digest}")), F.lit(False))
    kept = F.when(changed, "CAPTURED").otherwise(F.col(f"s_{state}"))
    now = F.when(new, F.col(f"i_{state}")).when(rank(F.col(f"i_{state}")) > rank(kept), F.col(f"i_{state}")).otherwise(kept)
    take = lambda c: F.when(new | changed, F.col(f"i_{c}")).otherwise(F.col(f"s_{c}")).alias(c)
    fill = lambda c: F.when(new, F.col(f"i_{c}")).otherwise(F.coalesce(said(F.col(f"s_{c}")), said(F.col(f"i_{c}")), F.col(f"s_{c}"))).alias(c)
    return j.select(key, *map(fill, fields), *map(take, content), take(digest), now.alias(state), F.when(new, "new").when(known, "merged").otherwise("stored").alias("status"))


def fold_items(df: DataFrame, key: str, order: list[str], fields: list[str], latest: list[str]) -> DataFrame:
    """One row of every key of a list with repeats: the first non-empty value of each field, the last of each of ``latest``."""
    first = lambda c: F.min_by(said(F.col(c)), F.when(said(F.col(c)).isNotNull(), F.struct(*order))).alias(c)
    last = lambda c: F.max_by(F.col(c), F.struct(*order)).alias(c)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*map(first, fields), *map(last, latest))


def refreshed(results: DataFrame, posts: DataFrame, key: str, current: list[str]) -> DataFrame:
    """Results that are used again, with the fields in ``current`` as the posts have them now; the analysis stays. Results without a post stay as they are."""
    p = posts.select(key, *[F.col(c).alias(f"p_{c}") for c in current], F.lit(True).alias("p_there"))
    j = results.join(p, key, "left")
    return j.select(*[F.when(F.col("p_there"), F.col(f"p_{c}")).otherwise(F.col(c)).alias(c) if c in current else F.col(c) for c in results.columns])


def added_questions(questions: DataFrame, candidates: DataFrame, group: str = "post_id", key: str = "key") -> DataFrame:
    """Candidates (group, key, text, order) whose key their group doesn't have yet, as medium theory questions; the first of equal ones."""
    fresh = candidates.filter(F.col(key) != "").join(questions.select(group, key).distinct(), [group, key], "left_anti")
    one = fresh.groupBy(group, key).agg(F.min(F.struct("order", "text")).alias("m"))
    return one.select(group, key, F.col("m.order").alias("order"), F.col("m.text").alias("text"), F.lit("theory").alias("type"), F.lit("medium").alias("difficulty"))


def collected(source: DataFrame, known: DataFrame, key: str, order: list[str], budget: int, source_cap: int | None = None) -> DataFrame:
    """The first ``budget`` rows of a source that aren't known yet; ``source_cap`` bounds what the source itself hands out, known rows too."""
    rows = source if source_cap is None else source.orderBy(*order).limit(source_cap)
    return rows.join(known.select(key).distinct(), key, "left_anti").orderBy(*order).limit(budget)


def displayed(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows with ``more``, how many there are beyond them."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(n).crossJoin(total).withColumn("more", F.greatest(F.col("total") - n, F.lit(0))).drop("total")  # total is one row


def tally(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """column, n: rows of each value, zero where there is none."""
    dim = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def planned(items: DataFrame, captures: DataFrame, state: DataFrame, key: str = "key") -> DataFrame:
    """key, outcome of listed items (key, repeat, valid) by their captures (key, digest) and what is stored (key, digest, failed)."""
    c = captures.groupBy(key).agg(F.max("digest").alias("now"), F.lit(True).alias("has"))
    s = state.groupBy(key).agg(F.max("digest").alias("was"), F.max("failed").alias("failed"), F.lit(True).alias("had"))
    j = items.join(c, key, "left").join(s, key, "left")
    out = F.when(~F.col("valid"), "INVALID").when(F.col("repeat"), "DUPLICATE").when(F.col("has").isNull(), "MISSING_CAPTURE").when(F.coalesce("failed", F.lit(False)), "FAILED")
    return j.select(key, out.when(F.col("had").isNull(), "NEW").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CHANGED").alias("outcome"))


def expect_count(df: DataFrame, expected: int) -> DataFrame:
    """``df`` itself, or an error if it hasn't so many rows."""
    n = df.count()
    if n != expected:
        raise ValueError(f"expected {expected} rows, found {n}")
    return df


def violations(df: DataFrame, allowed: dict[str, list[str]], required: list[str]) -> DataFrame:
    """column, problem, n: values outside their list and missing ones, of all columns in one scan."""
    checks = [(c, "not allowed", F.col(c).isNotNull() & ~F.col(c).isin(v)) for c, v in allowed.items()] + [(c, "missing", F.col(c).isNull()) for c in required]
    each = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"))) for c, p, x in checks]))
    return df.select(F.explode(each).alias("i")).groupBy("i.column", "i.problem").agg(F.count("*").alias("n"))


def stop_reason(seen: Column, persisted: Column, budget: int, until: Column, scrolls: Column, scroll_limit: int, broken: Column) -> Column:
    """Why a collection run stopped: what broke it counts first, then its budget, its date, its scroll limit."""
    return F.when(broken, "failed").when(persisted >= budget, "max_posts").when(until, "until_date").when(scrolls >= scroll_limit, "scroll_limit").when(seen == 0, "layout_changed").otherwise("exhausted")

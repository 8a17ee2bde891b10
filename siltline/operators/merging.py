"""Lists and states merged: insert, fill empty fields, keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(stored: Column, incoming: Column) -> Column:
    """The stored value unless it is null or empty."""
    return F.coalesce(F.nullif(F.trim(stored), F.lit("")), incoming)


def merge_lists(stored: DataFrame, incoming: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, fields and status (added, updated, kept, stored only) of a full outer merge; repeats are folded first."""
    fold = lambda df, p: df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(F.nullif(F.trim(f), F.lit(""))).alias(p + f) for f in fields], F.lit(True).alias(p))
    m = fold(stored, "s_").join(fold(incoming, "i_"), key, "full_outer")
    changed = F.lit(False)
    for f in fields:
        changed |= F.col(f"s_{f}").isNull() & F.col(f"i_{f}").isNotNull()
    status = F.when(F.col("s_").isNull(), "added").when(F.col("i_").isNull(), "stored").when(changed, "updated").otherwise("kept")
    return m.select(key, *[filled(F.col(f"s_{f}"), F.col(f"i_{f}")).alias(f) for f in fields], status.alias("status"))


def outcomes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, outcome (NEW, CHANGED, UNCHANGED, MISSING) of two states of a table by digest."""
    b = before.select(key, F.col(digest).alias("was")).groupBy(key).agg(F.max("was").alias("was"), F.lit(True).alias("had"))
    a = after.select(key, F.col(digest).alias("now")).groupBy(key).agg(F.max("now").alias("now"), F.lit(True).alias("has"))
    m = a.join(b, key, "full_outer")
    out = F.when(F.col("had").isNull(), "NEW").when(F.col("has").isNull(), "MISSING").when(F.col("was").eqNullSafe(F.col("now")), "UNCHANGED").otherwise("CHANGED")
    return m.select(key, out.alias("outcome"))


def reusable(work: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """key, reuse: work whose stored digest and version equal the current ones."""
    s = state.select(key, F.col("digest").alias("s_digest"), F.col("version").alias("s_version"))
    m = work.join(s, key, "left")
    return m.select(key, F.coalesce((F.col("digest") == F.col("s_digest")) & (F.col("version") == F.col("s_version")), F.lit(False)).alias("reuse"))

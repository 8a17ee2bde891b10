"""Duplicates grouped by digest; one keeper each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keepers(df: DataFrame, digest: Column, row: str, better: list[Column]) -> DataFrame:
    """row, duplicate_of: every row that isn't the keeper of its digest; null digests are left out.

    The keeper is an aggregate (the greatest of ``better``, then the smallest row), so a digest shared by a third of all
    rows is combined before it is shuffled; the join back is on the digest and splits by adaptive skew handling.
    """
    d = df.select(F.col(row), digest.alias("digest"), *[b.alias(f"b{k}") for k, b in enumerate(better)]).filter("digest is not null")
    best = F.max(F.struct(*[f"b{k}" for k in range(len(better))], (-F.col(row)).alias("m")))
    best = d.groupBy("digest").agg(best.alias("k"), F.count("*").alias("n")).filter("n > 1").select("digest", (-F.col("k.m")).alias("duplicate_of"))
    return d.select(row, "digest").join(best, "digest").filter(F.col(row) != F.col("duplicate_of")).select(row, "duplicate_of")


def first_seen(df: DataFrame, key: str, row: str) -> DataFrame:
    """row: the first row of every key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(row).alias(row)).select(row)

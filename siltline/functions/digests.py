"""Digests of records and of ordered lists, built so that no key gathers its whole list in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1000  # members of a list that are digested together


def record_digest(*fields: Column) -> Column:
    """SHA-256 of fields, each followed by a unit separator; null counts as empty."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(f.cast("string"), F.lit("")), F.lit("\x1f")) for f in fields]), 256)


def list_digests(df: DataFrame, key: str, order: list[str], member: Column, chunk: int = CHUNK) -> DataFrame:
    """key, digest, members: a digest of the members of every key in their order.

    Members are numbered by a range-partitioned sort and counts of partitions, digested in chunks of ``chunk``, and
    the chunks' digests (32 bytes each) are digested again, so that a key with a third of all rows gathers only those.
    """
    from siltline.operators.ranking import ranked_within

    m = ranked_within(df.filter(F.col(key).isNotNull()).select(key, *order, member.alias("d_member")), key, *order)
    m = m.withColumn("d_chunk", F.floor((F.col("rank") - 1) / chunk))
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d_member"))), lambda x: F.coalesce(x["d_member"], F.lit(""))), "")
    chunks = m.groupBy(key, "d_chunk").agg(F.sha2(part, 256).alias("d"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d_chunk", "d"))), lambda x: x["d"]), "")
    return chunks.groupBy(key).agg(F.sha2(whole, 256).alias("digest"), F.sum("n").alias("members"))

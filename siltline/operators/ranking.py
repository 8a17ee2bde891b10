"""Ranks over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.session import checkpointed


def ranked(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Add ``rank``, from 1 in the order of ``keys``: a range-partitioned sort, and the rows of the partitions before.

    The keys must tell all rows apart. Only the number of rows of each partition is summed up in one task.
    """
    # the id holds the partition above bit 33 and the place within it below; kept, as both uses must see the same ranges
    placed = checkpointed(df.orderBy(*keys).withColumn("r_id", F.monotonically_increasing_id()))
    placed = placed.select(*df.columns, F.shiftright("r_id", 33).alias("r_part"), F.col("r_id").bitwiseAND((1 << 33) - 1).alias("r_at"))
    parts = placed.groupBy("r_part").agg(F.count("*").alias("n"))
    before = W.orderBy("r_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("r_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r_before"))
    return placed.join(F.broadcast(offsets), "r_part").select(*df.columns, (F.col("r_before") + F.col("r_at") + 1).alias("rank"))


def ranked_within(df: DataFrame, group: str, *keys: Column | str) -> DataFrame:
    """Add ``rank``, from 1 in the order of ``keys`` within each ``group``, without gathering a group in one task.

    Rows are range-partitioned by group and keys, numbered by a running count within their partition, and the rows that the same
    group has in the partitions before are added: a group spreads over as many partitions as it needs. The keys must tell
    all rows of a group apart.
    """
    names = [k for k in keys]
    placed = checkpointed(df.repartitionByRange(group, *names).sortWithinPartitions(group, *names).withColumn("r_id", F.monotonically_increasing_id()))
    placed = placed.select(*df.columns, F.shiftright("r_id", 33).alias("r_part"), F.col("r_id").bitwiseAND((1 << 33) - 1).alias("r_at"))
    # where a group starts in each partition and how many rows it has there: one row for each group and partition
    spans = placed.groupBy(group, "r_part").agg(F.min("r_at").alias("r_start"), F.count("*").alias("n"))
    before = W.partitionBy(group).orderBy("r_part").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select(F.col(group).alias("r_group"), F.col("r_part").alias("r_p"), "r_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r_before"))
    j = placed.join(spans, (F.col(group).eqNullSafe(F.col("r_group"))) & (F.col("r_part") == F.col("r_p")))
    return j.select(*df.columns, (F.col("r_before") + F.col("r_at") - F.col("r_start") + 1).alias("rank"))

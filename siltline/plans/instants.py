"""Queries of problem 7: written times to UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.operators.instants import post_instants
from siltline.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, field, utc_us of every written time of posts that fixes an instant."""
    out = post_instants(table(spark, sf_dir, "posts"), table(spark, sf_dir, "platforms"))
    return out.filter(F.col("utc_us").isNotNull()).select("row_no", "field", "utc_us")


def p7_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the written times of each field resolve: field, instant_status, n."""
    out = post_instants(table(spark, sf_dir, "posts"), table(spark, sf_dir, "platforms"))
    return out.groupBy("field", "instant_status").agg(F.count("*").alias("n"))


QUERIES = {"p7_found": p7_found, "p7_status": p7_status}
ORACLE: dict[str, str] = {}

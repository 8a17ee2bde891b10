"""Labels of posts consolidated: first spelling wins, identity by normalised label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions import text as T


def exploded(posts: DataFrame, array: str, alias: str = "label") -> DataFrame:
    """row_no, pos, label, key of every non-blank entry of a label array."""
    e = posts.select("row_no", F.posexplode(array).alias("pos", alias))
    return e.filter(F.trim(alias) != "").withColumn("key", T.normalise_label(F.col(alias)))


def post_topics(posts: DataFrame) -> DataFrame:
    """row_no, pos, key, name: the primary topic, then the topics; one row per key, the first spelling kept."""
    both = F.concat(F.array(F.col("classification.primary_topic")), F.coalesce(F.col("ai_analysis.topics"), F.array().cast("array<string>")))
    e = posts.select("row_no", F.posexplode(both).alias("pos", "name")).filter(F.trim("name") != "")
    e = e.withColumn("name", F.trim("name")).withColumn("key", T.normalise_label(F.col("name"))).filter("key <> ''")
    return e.groupBy("row_no", "key").agg(F.min(F.struct("pos", "name")).alias("f")).select("row_no", "f.pos", "key", "f.name")


def consolidate(labels: DataFrame) -> DataFrame:
    """key, name (first seen), n_posts, n_mentions of exploded labels (row_no, pos, label, key)."""
    return labels.groupBy("key").agg(
        F.min(F.struct("row_no", "pos", "label")).getField("label").alias("name"),
        F.countDistinct("row_no").alias("n_posts"),
        F.count("*").alias("n_mentions"),
    )


def siblings(posts: DataFrame, top: int = 6, stride: int = 50) -> DataFrame:
    """row_no, sibling, shared, rank: for every ``stride``-th post, the posts that share most concepts.

    The stated query set is joined to the postings of its own concepts; no group is paired with itself.
    """
    e = posts.select("row_no", F.explode(F.array_distinct("ai_analysis.concepts")).alias("c")).filter(F.trim("c") != "")
    q = e.filter(F.col("row_no") % stride == 0).select(F.col("row_no").alias("q"), "c")
    pairs = q.join(e, "c").filter("q <> row_no").groupBy("q", "row_no").agg(F.count("*").alias("shared"))
    best = pairs.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), "row_no"))), 1, top).alias("b"))
    return best.select(F.col("q").alias("row_no"), F.posexplode("b").alias("r", "x")).select("row_no", F.col("x.row_no").alias("sibling"), (-F.col("x.s")).alias("shared"), (F.col("r") + 1).cast("long").alias("rank"))

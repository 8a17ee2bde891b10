"""Labels placed in a taxonomy, and what is counted by their places: concepts, questions, claims, neighbours, names.

A taxonomy is a table of phrases (phrase, major, sub, ord): a normalised phrase, the subject and subtopic it stands for, and
the order in which they are declared. It is of fixed size and is checked before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T

GENERAL = ("general", 0, 1_000_000)  # where a label goes that no phrase places
MOST_PHRASES = 100_000  # of a taxonomy that is broadcast


def small(df: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; else it is joined as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def classify_labels(labels: DataFrame, taxonomy: DataFrame, label: str = "label") -> DataFrame:
    """label, major, sub, ord, fallback of every different label: the longest phrase that stands in it as whole words, the first of equals.

    A phrase's first word is the join key, so a label meets only phrases that begin with one of its words.
    """
    each = labels.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("key", T.normalise_label(F.col(label)))
    words = each.select(label, "key", F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    t = taxonomy.filter("phrase <> ''").withColumn("w", F.substring_index("phrase", " ", 1))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hits = words.join(small(t), "w").filter(F.contains(pad("key"), pad("phrase")))
    best = hits.groupBy(label).agg(F.min(F.struct((-F.length("phrase")).alias("n"), "ord", "major", "sub")).alias("b")).select(label, "b.*")
    return each.join(best, label, "left").select(label, F.coalesce("major", F.lit(GENERAL[0])).alias("major"), F.coalesce("sub", F.lit(GENERAL[1]).cast("long")).alias("sub"), F.coalesce("ord", F.lit(GENERAL[2]).cast("long")).alias("ord"), F.col("major").isNull().alias("fallback"))


def placed(labels: DataFrame, places: DataFrame, key: str, majors: list[str]) -> DataFrame:
    """key, major, sub, n: where most labels (key, pos, label) of a key go; ties go to the subject declared first, then to what stands first."""
    j = labels.join(places, "label")
    n = j.groupBy(key, "major", "sub").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, majors)), F.col("major")), F.lit(0)), F.lit(len(majors) + 1))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), order.alias("o"), "first", "major", "sub")).alias("b")).select(key, "b.major", "b.sub", (-F.col("b.m")).alias("n"))


def related(nodes: DataFrame, k: int = 6) -> DataFrame:
    """major, sub, other_major, other_sub, rank: up to ``k`` neighbours of every node (major, sub, ord, questions).

    Other nodes of the subject come first, in their order; then nodes with questions of other subjects, those with most
    questions first. The nodes are those of a taxonomy: the pairs of a node with the first ``k`` of each list are few.
    """
    n = nodes.withColumn("place", F.row_number().over(W.partitionBy("major").orderBy("ord", "sub")))
    o = n.select(F.col("major").alias("other_major"), F.col("sub").alias("other_sub"), F.col("place").alias("other_place"), F.col("questions").alias("other_questions"))
    own = n.join(o.filter(F.col("other_place") <= k + 1), F.col("major") == F.col("other_major")).filter("sub <> other_sub").select("major", "sub", "other_major", "other_sub", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("weight"), F.col("other_place").alias("o"))
    size = nodes.groupBy("major").agg(F.sum("questions").alias("weight")).withColumn("m_rank", F.row_number().over(W.orderBy(F.desc("weight"), "major")))
    filled = o.filter("other_questions > 0").join(size.select(F.col("major").alias("other_major"), "weight", "m_rank"), "other_major")
    # of each subject's own list the first k are enough, and of the subjects the first k + 1
    filled = filled.withColumn("f", F.row_number().over(W.partitionBy("other_major").orderBy("other_place"))).filter((F.col("f") <= k) & (F.col("m_rank") <= k + 1))
    foreign = n.join(filled, F.col("major") != F.col("other_major")).select("major", "sub", "other_major", "other_sub", F.lit(1).alias("tier"), F.col("m_rank").cast("long").alias("weight"), F.col("f").alias("o"))
    rank = F.row_number().over(W.partitionBy("major", "sub").orderBy("tier", "weight", "o"))
    return own.unionByName(foreign).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("major", "sub", "other_major", "other_sub", "rank")


def claims(claimed: DataFrame, slides: DataFrame) -> DataFrame:
    """group_id, name, file, slide of claims (group_id, name): one row for each slide (group_id, file, slide, text) of the group that
    names it as whole words, and one row without a file where none does. Equal claims are one."""
    c = claimed.distinct().withColumn("n_key", T.normalise_label(F.col("name"))).filter("n_key <> ''")
    keys = small(c.select("group_id", "n_key").distinct())
    s = slides.select(F.col("group_id"), "file", "slide", T.normalise_label(F.col("text")).alias("t"))
    pad = lambda x: F.concat(F.lit(" "), F.col(x), F.lit(" "))
    found = s.join(keys, "group_id").filter(F.contains(pad("t"), pad("n_key"))).select("group_id", "n_key", "file", "slide").distinct()
    return c.join(found, ["group_id", "n_key"], "left").select("group_id", "name", "file", "slide")


def with_derived(rows: DataFrame, derived: DataFrame, key: str, names: str) -> DataFrame:
    """Rows whose array ``names`` also holds the claimed names (key, name), sorted; without claims it stays as it is."""
    d = derived.groupBy(key).agg(F.collect_set("name").alias("d_names"))
    some = F.coalesce(F.col(names), F.array().cast("array<string>"))
    return rows.join(d, key, "left").withColumn(names, F.when(F.col("d_names").isNull(), F.col(names)).otherwise(F.array_sort(F.array_union(some, F.col("d_names"))))).drop("d_names")


def registered(labels: DataFrame, label: Column, order: list[str], limit: int = 60) -> DataFrame:
    """Add ``slug`` to labels: a dashed name, numbered from 1 where an earlier label has it, past names that are taken anyway.

    A numbered name can meet a label's own name; such a label's number is raised until it is free. Labels with one name are
    ranked in a window; names are short and differ, so no name gathers many.
    """
    base = labels.withColumn("base", T.slug(label, limit=limit))
    base = base.withColumn("k", F.row_number().over(W.partitionBy("base").orderBy(*order)) - 1)
    natural = base.select("base").distinct()
    # numbers that are taken by natural names of the form base-n
    taken = natural.select(F.regexp_extract("base", r"^(.*)-([1-9][0-9]*)$", 1).alias("base"), F.regexp_extract("base", r"^(.*)-([1-9][0-9]*)$", 2).try_cast("int").alias("n")).filter("n is not null")
    taken = taken.groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("taken"))
    j = base.join(taken, "base", "left")
    # the k-th free number: k, raised by one for each taken number that it reaches
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("k"), lambda at, t: F.when(t <= at, at + 1).otherwise(at))
    return j.withColumn("slug", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", free.cast("string")))).drop("base", "k", "taken")

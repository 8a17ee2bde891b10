"""Questions merged: exactly by key, and by similar content words in order of arrival."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.session import checkpointed, discard

THRESHOLD = 0.82
LAST_EDGES = 200_000  # pairs of similar questions that one task decides, a few MB


def keyed(questions: DataFrame) -> DataFrame:
    """question_no, question, answer, key, words of every question."""
    q = F.coalesce(F.col("question"), F.lit(""))
    return questions.select("question_no", "question", "answer", "post_id", T.question_key(q).alias("key"), T.word_set(q).alias("words"))


def exact(questions: DataFrame) -> DataFrame:
    """key, question_no (the first), n_questions, n_posts of questions with equal content words."""
    return keyed(questions).groupBy("key").agg(F.min("question_no").alias("question_no"), F.count("*").alias("n_questions"), F.countDistinct("post_id").alias("n_posts"))


def longest_answers(questions: DataFrame) -> DataFrame:
    """key, question_no, answer_no, n_sources: the first question of a key and the longest answer (the first of equals)."""
    k = keyed(questions)
    size = F.length(F.trim(F.coalesce("answer", F.lit(""))))
    return k.groupBy("key").agg(F.min("question_no").alias("question_no"), F.max(F.struct(size.alias("n"), (-F.col("question_no")).alias("m"))).alias("b"), F.countDistinct("post_id").alias("n_sources")).select("key", "question_no", (-F.col("b.m")).alias("answer_no"), "n_sources")


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (a < b): pairs of distinct word sets with a Jaccard overlap of at least ``threshold``.

    Sets that reach it share one of their rarest ``size - ceil(threshold * size) + 1`` words, so only postings of
    those words meet; every word-set occurs once.
    """
    df = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    ranked = sets.select("id", "words", F.size("words").alias("size"), F.explode("words").alias("w")).join(df, "w")
    ranked = ranked.groupBy("id", "words", "size").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("r"))
    keep = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1
    postings = ranked.select("id", "size", F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("p")).select("id", "size", "p.w")
    a, b = postings.alias("a"), postings.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.col("a.size") >= threshold * F.col("b.size") - 1e-9) & (F.col("b.size") >= threshold * F.col("a.size") - 1e-9)
    met = a.join(b, (F.col("a.w") == F.col("b.w")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    words = lambda side: sets.select(F.col("id").alias(side), F.col("words").alias(f"w_{side}"))
    met = met.join(words("a"), "a").join(words("b"), "b")
    return met.filter(T.jaccard(F.col("w_a"), F.col("w_b")) >= threshold - 1e-12).select("a", "b")


def _absorbed_of(edges: pd.DataFrame) -> pd.DataFrame:
    """The nodes that an earlier kept neighbour absorbs, in order of the nodes."""
    absorbed: set[int] = set()
    for b, before in edges.sort_values("b").groupby("b", sort=False)["a"]:
        if any(a not in absorbed for a in before):
            absorbed.add(b)
    return pd.DataFrame({"id": pd.Series(sorted(absorbed), dtype="int64")})


def absorbed_nodes(pairs: DataFrame) -> DataFrame:
    """id: the nodes of the edges (a, b), a < b, that aren't kept; a node is kept unless an earlier kept one is its neighbour.

    Nodes without an undecided earlier neighbour are kept and absorb their neighbours; these leave with all their edges. A round
    writes what is left of the edges, which shrink each time, and what it absorbed. Once at most LAST_EDGES
    edges are left, one task decides them in order; the result is the same either way.
    """
    edges, parts, kept_tables = pairs, [], []
    while (n := edges.count()) > LAST_EDGES:
        roots = edges.select(F.col("a").alias("id")).distinct().join(edges.select(F.col("b").alias("id")), "id", "left_anti")
        gone = checkpointed(edges.join(roots, edges.a == roots.id, "left_semi").select(F.col("b").alias("id")).distinct())
        parts.append(gone)
        left = edges.join(roots, edges.a == roots.id, "left_anti")
        left = left.join(gone, left.a == gone.id, "left_anti").join(gone, left.b == gone.id, "left_anti")
        left = checkpointed(left)
        for t in kept_tables:
            discard(t)
        kept_tables, edges = [left], left
    if n:
        parts.append(edges.repartition(1).groupBy(F.lit(0).alias("all")).applyInPandas(_absorbed_of, "id long"))
    out = edges.sparkSession.createDataFrame([], "id long")
    for p in parts:
        out = out.unionByName(p.select(F.col("id").cast("long").alias("id")))
    return out


def merge_similar(questions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """question_no, survivor_no: each question with the first kept question that it is like enough.

    Greedy in order of arrival: a question is kept unless an earlier *kept* one is similar. Exact copies are one node. Once
    it is known which questions are absorbed, every absorbed one takes the first kept of its neighbours.
    """
    k = keyed(questions)
    joined = F.array_join("words", " ")
    nodes = checkpointed(k.withColumn("set", joined).groupBy("set").agg(F.min("question_no").alias("id"), F.first("words").alias("words")))
    pairs = checkpointed(similar_pairs(nodes.filter(F.size("words") > 0).select("id", "words"), threshold))
    absorbed = checkpointed(absorbed_nodes(pairs))
    links = pairs.join(absorbed.withColumnRenamed("id", "b"), "b", "left_semi").join(absorbed.withColumnRenamed("id", "a"), "a", "left_anti")
    leaders = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    state = nodes.select("set", "id").join(leaders, "id", "left").select("set", F.coalesce("leader", "id").alias("leader"))
    return k.withColumn("set", joined).join(state, "set").select("question_no", F.col("leader").alias("survivor_no"))

"""Queries over interview questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import questions as Q
from siltline.operators.ranking import ranked, ranked_within
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_WORDS = f"list_filter(string_split(trim(regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_STOP})"
_QKEY = f"array_to_string(list_sort({_WORDS}), ' ')"
_OPEN = "(" + ", ".join(f"'{w}'" for w in T.OPENERS) + ")"


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions")


@R.query(f"SELECT question_no, {_QKEY} AS key FROM questions")
def str_question_key(spark: SparkSession, d: str) -> DataFrame:
    return Q.keyed(_q(spark, d)).select("question_no", "key")


@R.query(f"SELECT question_no, len(list_distinct({_WORDS}))::BIGINT AS n_words FROM questions")
def str_content_words(spark: SparkSession, d: str) -> DataFrame:
    return Q.keyed(_q(spark, d)).select("question_no", F.size("words").cast("long").alias("n_words"))


@R.query(f"SELECT {_QKEY} AS key, min(question_no) AS question_no, count(*) AS n_questions, count(DISTINCT post_id) AS n_posts FROM questions GROUP BY 1")
def agg_question_exact(spark: SparkSession, d: str) -> DataFrame:
    return Q.exact(_q(spark, d))


@R.query(f"""
WITH k AS (SELECT question_no, post_id, {_QKEY} AS key, length(trim(coalesce(answer, ''))) AS n FROM questions)
SELECT key, min(question_no) AS question_no, arg_max(question_no, n * 1000000000 - question_no) AS answer_no, count(DISTINCT post_id) AS n_sources FROM k GROUP BY key""")
def agg_curriculum_merge(spark: SparkSession, d: str) -> DataFrame:
    return Q.longest_answers(_q(spark, d))


@R.query()
def agg_question_merge(spark: SparkSession, d: str) -> DataFrame:
    return Q.merge_similar(_q(spark, d))


@R.query(f"""
SELECT question_no, CASE WHEN s = '' THEN 'question' ELSE s END || '-' || substr(sha1(key), 1, 8) AS slug FROM (
  SELECT question_no, {_QKEY} AS key, regexp_replace(substr(regexp_replace(regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), '-+$', '') AS s FROM questions)""")
def str_question_slug(spark: SparkSession, d: str) -> DataFrame:
    k = Q.keyed(_q(spark, d))
    return k.select("question_no", F.concat_ws("-", T.dashed(F.coalesce("question", F.lit("")), "question", 48), F.substring(F.sha1("key"), 1, 8)).alias("slug"))


@R.query(f"""
WITH w AS (SELECT question_no, question, regexp_extract_all(lower(question), '[\\p{{L}}]{{2,}}') AS ws FROM questions)
SELECT question_no, coalesce(len(list_filter(ws, lambda x: x IN {_OPEN})) > 0 OR (rtrim(question) LIKE '%?' AND len(ws) >= 4), false) AS question_like FROM w""")
def str_question_like(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).select("question_no", F.coalesce(T.is_question_like(F.col("question")), F.lit(False)).alias("question_like"))


@R.query("""
WITH l AS (SELECT unnest(['easy', 'medium', 'hard']) AS difficulty)
SELECT l.difficulty, count(q.question_no) AS n FROM l LEFT JOIN questions q ON q.difficulty = l.difficulty GROUP BY 1""")
def agg_difficulty_counts(spark: SparkSession, d: str) -> DataFrame:
    """Questions of each known difficulty, zero-filled."""
    levels = spark.createDataFrame([("easy",), ("medium",), ("hard",)], "difficulty string")
    n = _q(spark, d).groupBy("difficulty").agg(F.count("*").alias("n"))
    return levels.join(n, "difficulty", "left").select("difficulty", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@R.query("SELECT coalesce(question_type, 'unknown') AS question_type, count(*) AS n FROM questions GROUP BY 1")
def agg_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n"))


@R.query("""
SELECT question_no, CASE WHEN question_type IN ('theory', 'coding', 'scenario', 'architecture') THEN question_type ELSE 'scenario' END AS question_type,
       CASE WHEN difficulty IN ('easy', 'medium', 'hard') THEN difficulty ELSE 'medium' END AS difficulty FROM questions""")
def arr_enum_default(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("question_type").isin("theory", "coding", "scenario", "architecture"), F.col("question_type")).otherwise("scenario")
    return _q(spark, d).select("question_no", kind.alias("question_type"), F.when(F.col("difficulty").isin("easy", "medium", "hard"), F.col("difficulty")).otherwise("medium").alias("difficulty"))


@R.query("""
SELECT question_no, ((rank - 1) // 40 + 1)::BIGINT AS page, greatest(1, ceil(n / 40.0))::BIGINT AS pages FROM (
  SELECT question_no, row_number() OVER (PARTITION BY post_id ORDER BY question, question_no) AS rank, count(*) OVER (PARTITION BY post_id) AS n FROM questions)""")
def win_page_number(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 40 questions of each post, by text."""
    q = _q(spark, d).select("question_no", "post_id", "question")
    n = q.groupBy("post_id").agg(F.count("*").alias("n"))
    r = ranked_within(q, "post_id", F.col("question").asc_nulls_last(), "question_no").join(n.withColumnRenamed("post_id", "p"), F.col("post_id").eqNullSafe(F.col("p")))
    return r.select("question_no", (F.floor((F.col("rank") - 1) / 40) + 1).cast("long").alias("page"), F.greatest(F.lit(1), F.ceil(F.col("n") / 40)).cast("long").alias("pages"))


@R.query("""
SELECT question_no, row_number() OVER (ORDER BY lower(coalesce(question_type, '')), CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 ELSE 3 END, lower(post_id), question, question_no) AS rank
FROM questions""")
def sort_questions(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its rank by type, difficulty, post and text."""
    level = F.coalesce(F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).when(F.col("difficulty") == "hard", 2), F.lit(3))
    q = _q(spark, d).select("question_no", "question", F.lower(F.coalesce("question_type", F.lit(""))).alias("t"), level.alias("l"), F.lower("post_id").alias("p"))
    return ranked(q, "t", "l", F.col("p").asc_nulls_last(), F.col("question").asc_nulls_last(), "question_no").select("question_no", "rank")


@R.query("""
SELECT question_no FROM questions WHERE difficulty = 'hard' AND question_type = 'theory'
  AND contains(lower(coalesce(question, '') || ' ' || coalesce(answer, '')), 'pipeline') AND contains(lower(coalesce(question, '') || ' ' || coalesce(answer, '')), 'row')""")
def q_filter_questions(spark: SparkSession, d: str) -> DataFrame:
    """Hard theory questions that hold all of the typed words."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    return _q(spark, d).filter((F.col("difficulty") == "hard") & (F.col("question_type") == "theory") & F.contains(hay, F.lit("pipeline")) & F.contains(hay, F.lit("row"))).select("question_no")


@R.query("""
SELECT q.question_no, q.post_id FROM questions q WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.id = q.post_id)""")
def join_verify_refs(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose post doesn't exist."""
    return _q(spark, d).select("question_no", "post_id").join(table(spark, d, "posts").select(F.col("id").alias("post_id")).distinct(), "post_id", "left_anti").select("question_no", "post_id")


@R.query(f"""
WITH k AS (SELECT question_no, post_id, {_QKEY} AS key FROM questions)
SELECT question_no FROM (SELECT question_no, row_number() OVER (PARTITION BY post_id, key ORDER BY question_no) AS r FROM k) WHERE r > 1""")
def win_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Questions that repeat an earlier one of their post."""
    k = Q.keyed(_q(spark, d))
    first = k.groupBy("post_id", "key").agg(F.min("question_no").alias("first"))
    return k.join(first, F.col("question_no") == F.col("first"), "left_anti").select("question_no")


QUERIES, ORACLE = R.queries, R.oracle

"""Queries over the labels of posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import labels as L
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TOPICS_SQL = f"""
SELECT row_no, pos, key, name FROM (
  SELECT row_no, pos, trim(v, ' ') AS name, {_KEY.format("trim(v, ' ')")} AS key,
         row_number() OVER (PARTITION BY row_no, {_KEY.format("trim(v, ' ')")} ORDER BY pos) AS r
  FROM (SELECT row_no, unnest(l) AS v, (generate_subscripts(l, 1) - 1)::INTEGER AS pos
        FROM (SELECT row_no, list_concat([classification.primary_topic], coalesce(ai_analysis.topics, []::VARCHAR[])) AS l FROM posts)) e
  WHERE trim(v, ' ') <> '') WHERE r = 1 AND key <> ''"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


@R.query(_TOPICS_SQL)
def agg_post_topics(spark: SparkSession, d: str) -> DataFrame:
    return L.post_topics(_posts(spark, d)).select("row_no", "pos", "key", "name")


_TECH0 = " UNION ALL ".join("SELECT '" + n + "' AS technology, '" + p + "' AS phrase" for n, ps in sorted(T.TECHNOLOGIES.items()) for p in ps)


@R.query(f"""
WITH t AS ({_TOPICS_SQL}), g AS (SELECT key, arg_min(name, row_no * 10000 + pos) AS name, count(DISTINCT row_no) AS n_posts, count(*) AS n_mentions FROM t GROUP BY key), c AS (SELECT DISTINCT row_no, unnest(ai_analysis.concepts) AS c FROM posts),
nc AS (SELECT key, count(DISTINCT c) AS n FROM t JOIN c USING (row_no) WHERE trim(c, ' ') <> '' GROUP BY 1), h AS (SELECT DISTINCT row_no, technology FROM posts, ({_TECH0}) p WHERE contains(lower(original_text), phrase)), nt AS (SELECT key, count(DISTINCT technology) AS n FROM t JOIN h USING (row_no) GROUP BY 1),
q AS (SELECT row_no, count(*) AS n FROM posts JOIN questions ON post_id = posts.id GROUP BY 1), nq AS (SELECT key, sum(n)::BIGINT AS n FROM t JOIN q USING (row_no) GROUP BY 1)
SELECT g.*, coalesce(nc.n, 0) AS n_concepts, coalesce(nt.n, 0) AS n_technologies, coalesce(nq.n, 0) AS n_questions FROM g LEFT JOIN nc USING (key) LEFT JOIN nt USING (key) LEFT JOIN nq USING (key)""")
def agg_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics with their first spelling, posts, and the concepts, technologies and questions of those posts; each is counted on its own, so none multiplies another."""
    p = _posts(spark, d)
    t = L.post_topics(p)
    own = t.select("row_no", "key")
    concepts = p.select("row_no", F.explode("ai_analysis.concepts").alias("v")).filter("trim(v) <> ''").distinct()
    named = p.select("row_no", F.explode(T.technologies(F.col("original_text"))).alias("v"))
    asked = p.select("row_no", "id").join(table(spark, d, "questions").groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("v")), "id").select("row_no", "v")
    parts = [("n_concepts", concepts, F.countDistinct("v")), ("n_technologies", named, F.countDistinct("v")), ("n_questions", asked, F.sum("v"))]
    out = L.consolidate(t.withColumnRenamed("name", "label"))
    for name, rows, count in parts:
        out = out.join(own.join(rows, "row_no").groupBy("key").agg(count.cast("long").alias(name)), "key", "left").na.fill(0, [name])
    return out


@R.query(f"""
WITH t AS ({_TOPICS_SQL}), s AS (SELECT row_no, {_KEY.format("v")} AS sub FROM (SELECT row_no, unnest(ai_analysis.subtopics) AS v FROM posts) WHERE v IS NOT NULL)
SELECT sub, count(*) AS n_mentions, count(DISTINCT t.key) AS n_topics FROM t JOIN s USING (row_no) GROUP BY sub""")
def agg_subtopics(spark: SparkSession, d: str) -> DataFrame:
    """A subtopic counts once for each topic of its post."""
    p = _posts(spark, d)
    s = p.select("row_no", F.explode("ai_analysis.subtopics").alias("v")).filter("v is not null").select("row_no", T.normalise_label(F.col("v")).alias("sub"))
    return L.post_topics(p).join(s, "row_no").groupBy("sub").agg(F.count("*").alias("n_mentions"), F.countDistinct("key").alias("n_topics"))


@R.query(f"""
WITH e AS (SELECT row_no, unnest(ai_analysis.concepts) AS v, generate_subscripts(ai_analysis.concepts, 1) - 1 AS pos FROM posts)
SELECT key, arg_min(v, row_no * 10000 + pos) AS name, count(DISTINCT row_no) AS n_posts, count(*) AS n_mentions
FROM (SELECT row_no, pos, v, {_KEY.format("v")} AS key FROM e WHERE trim(v) <> '') GROUP BY key""")
def agg_concepts(spark: SparkSession, d: str) -> DataFrame:
    return L.consolidate(L.exploded(_posts(spark, d), "ai_analysis.concepts"))


@R.query("""
WITH e AS (SELECT source.platform AS platform, unnest(ai_analysis.topics) AS v FROM posts),
     c AS (SELECT platform, v, count(*) AS n FROM e WHERE trim(v) <> '' AND platform IS NOT NULL GROUP BY 1, 2)
SELECT platform, v AS label, n FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY n DESC, v) AS r FROM c) WHERE r = 1""")
def agg_most_common(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent topic of each platform; ties go to the alphabetically first."""
    e = _posts(spark, d).select(F.col("source.platform").alias("platform"), F.explode("ai_analysis.topics").alias("v")).filter("trim(v) <> '' and platform is not null")
    c = e.groupBy("platform", "v").agg(F.count("*").alias("n"))
    best = c.groupBy("platform").agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b"))
    return best.select("platform", F.col("b.v").alias("label"), (-F.col("b.m")).alias("n"))


@R.query("""
WITH e AS (SELECT 'topics' AS field, unnest(ai_analysis.topics) AS v FROM posts UNION ALL SELECT 'subtopics', unnest(ai_analysis.subtopics) FROM posts UNION ALL SELECT 'concepts', unnest(ai_analysis.concepts) FROM posts)
SELECT field, count(v) AS n_entries, count(DISTINCT v) AS n_distinct FROM e GROUP BY field""")
def agg_knowledge_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries and exactly distinct entries of each label array."""
    p = _posts(spark, d)
    e = [p.select(F.lit(f).alias("field"), F.explode(f"ai_analysis.{f}").alias("v")) for f in ("topics", "subtopics", "concepts")]
    return e[0].unionByName(e[1]).unionByName(e[2]).groupBy("field").agg(F.count("v").alias("n_entries"), F.countDistinct("v").alias("n_distinct"))


@R.query("""
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_posts, coalesce(sum(CASE WHEN classification.interview_relevant THEN 1 ELSE 0 END), 0)::BIGINT AS n_relevant,
       coalesce(sum(CASE WHEN trim(ai_analysis.summary) <> '' THEN 1 ELSE 0 END), 0)::BIGINT AS n_enriched, count(DISTINCT source.platform) AS n_platforms FROM posts""")
def agg_stats(spark: SparkSession, d: str) -> DataFrame:
    yes = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return _posts(spark, d).agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_posts"), yes(F.col("classification.interview_relevant")).alias("n_relevant"), yes(F.trim("ai_analysis.summary") != "").alias("n_enriched"), F.countDistinct("source.platform").alias("n_platforms"))


_TECH = " UNION ALL ".join("SELECT '" + n + "' AS technology, '" + p + "' AS phrase" for n, ps in sorted(T.TECHNOLOGIES.items()) for p in ps)


@R.query(f"""
WITH p AS ({_TECH})
SELECT row_no, technology FROM posts, p WHERE contains(lower(original_text), phrase) GROUP BY row_no, technology""")
def str_detect_technologies(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", F.explode(T.technologies(F.col("original_text"))).alias("technology"))


@R.query(f"""
WITH p AS ({_TECH}), h AS (SELECT DISTINCT doc_id, technology FROM documents, p WHERE contains(lower(text), phrase))
SELECT technology, count(*) AS n_docs, min(doc_id) AS first_doc FROM h GROUP BY technology""")
def agg_technologies(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.explode(T.technologies(F.col("text"))).alias("technology"))
    return h.groupBy("technology").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_KIND = "CASE " + " ".join(f"WHEN contains(lower(original_text), '{m}') THEN '{k}'" for m, k in T.CONTENT_MARKERS) + " WHEN classification.interview_relevant OR len(ai_analysis.topics) > 0 OR len(ai_analysis.concepts) > 0 THEN 'technical' ELSE 'unknown' END"


@R.query(f"SELECT row_no, {_KIND} AS kind FROM posts")
def str_classify_content(spark: SparkSession, d: str) -> DataFrame:
    technical = F.coalesce(F.col("classification.interview_relevant"), F.lit(False)) | (F.coalesce(F.size("ai_analysis.topics"), F.lit(0)) > 0) | (F.coalesce(F.size("ai_analysis.concepts"), F.lit(0)) > 0)
    return _posts(spark, d).select("row_no", T.content_kind(F.col("original_text"), technical).alias("kind"))


@R.query(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM posts) GROUP BY kind")
def agg_content_kinds(spark: SparkSession, d: str) -> DataFrame:
    return str_classify_content(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@R.query("""
WITH e AS (SELECT DISTINCT row_no, c FROM (SELECT row_no, unnest(ai_analysis.concepts) AS c FROM posts) WHERE trim(c) <> ''),
     p AS (SELECT q.row_no, e.row_no AS sibling, count(*) AS shared FROM e q JOIN e ON q.c = e.c AND q.row_no <> e.row_no WHERE q.row_no % 50 = 0 GROUP BY 1, 2)
SELECT row_no, sibling, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY shared DESC, sibling) AS rank FROM p) WHERE rank <= 6""")
def topk_siblings(spark: SparkSession, d: str) -> DataFrame:
    return L.siblings(_posts(spark, d))


@R.query("""
WITH e AS (SELECT DISTINCT row_no, v FROM (SELECT row_no, unnest(ai_analysis.topics) AS v FROM posts) WHERE trim(v) <> ''),
     r AS (SELECT DISTINCT term FROM reference_terms WHERE kind = 'topic')
SELECT v AS label, count(*) AS n FROM e WHERE v NOT IN (SELECT term FROM r) GROUP BY v""")
def join_unmatched_groups(spark: SparkSession, d: str) -> DataFrame:
    """Topics that no reference term is written as."""
    e = _posts(spark, d).select("row_no", F.explode(F.array_distinct("ai_analysis.topics")).alias("label")).filter("trim(label) <> ''")
    terms = table(spark, d, "reference_terms").filter("kind = 'topic'").select(F.col("term").alias("label")).distinct()
    return e.join(terms, "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@R.query("""
WITH e AS (SELECT row_no, 'topic' AS kind, unnest(ai_analysis.topics) AS v FROM posts UNION ALL SELECT row_no, 'subtopic', unnest(ai_analysis.subtopics) FROM posts UNION ALL SELECT row_no, 'concept', unnest(ai_analysis.concepts) FROM posts)
SELECT t.term_id, t.kind, t.term, count(DISTINCT e.row_no) AS n_posts FROM reference_terms t LEFT JOIN e ON e.kind = t.kind AND e.v = t.term GROUP BY 1, 2, 3""")
def agg_unit_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Posts of every reference term, zero for terms that none is labelled with."""
    p = _posts(spark, d)
    e = [p.select("row_no", F.lit(k).alias("kind"), F.explode(f"ai_analysis.{f}").alias("term")) for k, f in (("topic", "topics"), ("subtopic", "subtopics"), ("concept", "concepts"))]
    n = e[0].unionByName(e[1]).unionByName(e[2]).groupBy("kind", "term").agg(F.countDistinct("row_no").alias("n"))
    return table(spark, d, "reference_terms").join(n, ["kind", "term"], "left").select("term_id", "kind", "term", F.coalesce("n", F.lit(0)).cast("long").alias("n_posts"))


QUERIES, ORACLE = R.queries, R.oracle

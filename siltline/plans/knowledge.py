"""Queries over labels in their taxonomy, claims and site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import inventory as I
from siltline.operators import knowledge as K
from siltline.operators import labels as L
from siltline.operators.ranking import ranked
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TAX = f"SELECT DISTINCT {_NORM.format('p')} AS phrase, kind AS major, term_id AS sub, term_id AS ord FROM (SELECT kind, term_id, unnest(list_concat([term], coalesce(aliases, []::VARCHAR[]))) AS p FROM reference_terms) WHERE {_NORM.format('p')} <> ''"
_LABELS = """
SELECT row_no, id, (generate_subscripts(l, 1))::BIGINT AS pos, unnest(l) AS label FROM (SELECT row_no, id, list_concat([classification.primary_topic], coalesce(ai_analysis.topics, []::VARCHAR[]), coalesce(ai_analysis.subtopics, []::VARCHAR[]), coalesce(ai_analysis.concepts, []::VARCHAR[])) AS l FROM posts)"""


def _places_sql(labels: str) -> str:
    return f"""
SELECT label, coalesce(b.major, 'general') AS major, coalesce(b.sub, 0) AS sub, coalesce(b.ord, 1000000) AS ord, b.major IS NULL AS fallback FROM (SELECT DISTINCT label FROM ({labels}) WHERE label IS NOT NULL) l
LEFT JOIN (SELECT label, (min(struct_pack(n := -length(phrase), ord := ord, major := major, sub := sub))) AS b FROM (SELECT DISTINCT label FROM ({labels}) WHERE label IS NOT NULL) JOIN ({_TAX}) t ON contains(' ' || {_NORM.format('label')} || ' ', ' ' || phrase || ' ') GROUP BY 1) USING (label)"""


_PLACES = _places_sql(_LABELS)
_MAJORS = ["topic", "subtopic", "concept"]
_PLACED = f"""
WITH p AS ({_PLACES}), n AS (SELECT row_no, major, sub, count(*) AS n, min(pos) AS first FROM ({_LABELS}) JOIN p USING (label) GROUP BY 1, 2, 3)
SELECT row_no, major, sub, n FROM n QUALIFY row_number() OVER (PARTITION BY row_no ORDER BY n DESC, CASE major WHEN 'topic' THEN 1 WHEN 'subtopic' THEN 2 WHEN 'concept' THEN 3 ELSE 4 END, first) = 1"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


def _taxonomy(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "reference_terms")
    names = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    return t.select(F.explode(names).alias("p"), "kind", "term_id").select(T.normalise_label(F.col("p")).alias("phrase"), F.col("kind").alias("major"), F.col("term_id").alias("sub"), F.col("term_id").alias("ord")).filter("phrase <> ''").distinct()


def _labels(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(f"ai_analysis.{c}"), F.array().cast("array<string>"))
    l = F.concat(F.array("classification.primary_topic"), some("topics"), some("subtopics"), some("concepts"))  # noqa: E741
    return _posts(spark, d).select("row_no", "id", F.posexplode(l).alias("pos", "label")).withColumn("pos", F.col("pos").cast("long") + 1)


def _places(spark: SparkSession, d: str) -> DataFrame:
    return K.classify_labels(_labels(spark, d), _taxonomy(spark, d))


def _post_places(spark: SparkSession, d: str) -> DataFrame:
    return K.placed(_labels(spark, d).select("row_no", "pos", "label"), _places(spark, d), "row_no", _MAJORS)


@R.query(f"SELECT label, major, sub, fallback FROM ({_PLACES})")
def str_classify_label(spark: SparkSession, d: str) -> DataFrame:
    """Where every different label goes: the longest term in it, the first declared of equals."""
    return _places(spark, d).select("label", "major", "sub", "fallback")


@R.query(f"{_PLACED}")
def agg_post_placement(spark: SparkSession, d: str) -> DataFrame:
    """Where most labels of each post go."""
    return _post_places(spark, d)


@R.query(f"""
WITH p AS ({_PLACES}), c AS (SELECT row_no, unnest(ai_analysis.concepts) AS label FROM posts) SELECT p.major, p.sub, {_NORM.format('label')} AS concept, count(DISTINCT row_no) AS n_posts FROM c JOIN p USING (label) WHERE {_NORM.format('label')} <> '' GROUP BY 1, 2, 3""")
def agg_curriculum_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts filed by their own place, with their posts."""
    c = _posts(spark, d).select("row_no", F.explode("ai_analysis.concepts").alias("label")).withColumn("concept", T.normalise_label(F.col("label"))).filter("concept <> ''")
    return c.join(_places(spark, d), "label").groupBy("major", "sub", "concept").agg(F.countDistinct("row_no").alias("n_posts"))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_QKEY = f"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(coalesce(question, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_STOP})), ' ')"
# a merged question goes where its own words say, else where the first capture of the post that had it first goes
_QUESTIONS = f"""
q AS (SELECT *, {_QKEY} AS key FROM questions), m AS (SELECT key, min(struct_pack(n := question_no, t := question, p := post_id)) AS f, count(*) AS slots FROM q GROUP BY 1),
own AS ({_places_sql('SELECT question AS label FROM questions')}), pp AS (SELECT id, min(struct_pack(r := row_no, major := major, sub := sub)) AS b FROM ({_PLACED}) JOIN posts USING (row_no) GROUP BY 1),
mq AS (SELECT key, slots, NOT coalesce(own.fallback, true) AS own, CASE WHEN NOT coalesce(own.fallback, true) THEN own.major ELSE coalesce(pp.b.major, 'general') END AS major, CASE WHEN NOT coalesce(own.fallback, true) THEN own.sub ELSE coalesce(pp.b.sub, 0) END AS sub FROM m LEFT JOIN own ON own.label = m.f.t LEFT JOIN pp ON pp.id = m.f.p)"""


def _merged_questions(spark: SparkSession, d: str) -> DataFrame:
    """key, slots, own, major, sub of every merged question."""
    q = table(spark, d, "questions").select("question_no", "question", "post_id", T.question_key(F.coalesce("question", F.lit(""))).alias("key"))
    m = q.groupBy("key").agg(F.min(F.struct("question_no", "question", "post_id")).alias("f"), F.count("*").alias("slots")).select("key", "slots", F.col("f.question").alias("label"), F.col("f.post_id").alias("id"))
    own = K.classify_labels(q.select(F.col("question").alias("label")), _taxonomy(spark, d)).select("label", F.col("major").alias("o_major"), F.col("sub").alias("o_sub"), "fallback")
    first = _post_places(spark, d).join(_posts(spark, d).select("row_no", "id"), "row_no").groupBy("id").agg(F.min(F.struct("row_no", "major", "sub")).alias("b")).select("id", F.col("b.major").alias("p_major"), F.col("b.sub").alias("p_sub"))
    j = m.join(own, "label", "left").join(first, "id", "left").withColumn("own", ~F.coalesce("fallback", F.lit(True)))
    return j.select("key", "slots", "own", F.when(F.col("own"), F.col("o_major")).otherwise(F.coalesce("p_major", F.lit("general"))).alias("major"), F.when(F.col("own"), F.col("o_sub")).otherwise(F.coalesce("p_sub", F.lit(0))).alias("sub"))


@R.query(f"WITH {_QUESTIONS} SELECT mq.major, mq.sub, count(DISTINCT mq.key) AS n_questions, count(DISTINCT q.post_id) AS n_posts FROM mq JOIN q USING (key) GROUP BY 1, 2")
def agg_curriculum_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Merged questions and their posts by place; places without any are left out."""
    q = table(spark, d, "questions").select("post_id", T.question_key(F.coalesce("question", F.lit(""))).alias("key")).distinct()
    return _merged_questions(spark, d).join(q, "key").groupBy("major", "sub").agg(F.countDistinct("key").alias("n_questions"), F.countDistinct("post_id").alias("n_posts"))


@R.query(f"""
WITH {_QUESTIONS} SELECT (SELECT count(*) FROM posts) AS posts, sum(slots)::BIGINT AS slots, count(*) AS merged, (sum(slots) - count(*))::BIGINT AS merged_away, sum(own::INTEGER)::BIGINT AS own_words, sum((NOT own)::INTEGER)::BIGINT AS inherited FROM mq""")
def agg_curriculum_diag(spark: SparkSession, d: str) -> DataFrame:
    """How questions were merged and placed."""
    m = _merged_questions(spark, d).agg(F.sum("slots").cast("long").alias("slots"), F.count("*").alias("merged"), F.sum(F.when(F.col("own"), 1).otherwise(0)).cast("long").alias("own_words"), F.sum(F.when(F.col("own"), 0).otherwise(1)).cast("long").alias("inherited"))
    return m.crossJoin(_posts(spark, d).agg(F.count("*").alias("posts"))).withColumn("merged_away", F.col("slots") - F.col("merged"))  # one row each


@R.query(f"""
WITH {_QUESTIONS}, n AS (SELECT t.kind AS major, t.term_id AS sub, t.term_id AS ord, count(mq.key) AS questions FROM reference_terms t LEFT JOIN mq ON mq.major = t.kind AND mq.sub = t.term_id GROUP BY 1, 2, 3), s AS (SELECT major, row_number() OVER (ORDER BY sum(questions) DESC, major) AS m_rank FROM n GROUP BY 1),
c AS (SELECT a.major, a.sub, b.major AS other_major, b.sub AS other_sub, 0 AS tier, 0 AS w, b.ord AS o FROM n a JOIN n b ON a.major = b.major AND a.sub <> b.sub UNION ALL SELECT a.major, a.sub, b.major, b.sub, 1, s.m_rank, b.ord FROM n a JOIN n b ON a.major <> b.major AND b.questions > 0 JOIN s ON s.major = b.major)
SELECT major, sub, other_major, other_sub, row_number() OVER (PARTITION BY major, sub ORDER BY tier, w, o) AS rank FROM c QUALIFY rank <= 6""")
def topk_related_subtopics(spark: SparkSession, d: str) -> DataFrame:
    """Six neighbours of every term: of its own kind first, then terms with questions of the kinds with most of them."""
    n = _merged_questions(spark, d).groupBy("major", "sub").agg(F.count("*").alias("q"))
    t = table(spark, d, "reference_terms").select(F.col("kind").alias("major"), F.col("term_id").alias("sub"), F.col("term_id").alias("ord"))
    return K.related(t.join(n, ["major", "sub"], "left").select("major", "sub", "ord", F.coalesce("q", F.lit(0)).cast("long").alias("questions")))


_UNITS = f"SELECT DISTINCT split_part({_NORM.format('term')}, ' ', 1) AS unit, kind AS major, term_id AS sub FROM reference_terms WHERE len(aliases) > 0"


@R.query(f"""
WITH {_QUESTIONS}, u AS ({_UNITS}), n AS (SELECT major, sub, count(*) AS n FROM mq GROUP BY 1, 2)
SELECT coalesce(u.unit, 'unmapped ' || n.major || '/' || n.sub) AS unit, sum(n.n)::BIGINT AS n_questions FROM n LEFT JOIN u ON u.major = n.major AND u.sub = n.sub GROUP BY 1""")
def join_question_topic(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every unit by the places it draws on, many to many; places that no unit draws on are named."""
    t = table(spark, d, "reference_terms").filter(F.size("aliases") > 0)
    units = t.select(F.substring_index(T.normalise_label(F.col("term")), " ", 1).alias("unit"), F.col("kind").alias("major"), F.col("term_id").alias("sub")).distinct()
    n = _merged_questions(spark, d).groupBy("major", "sub").agg(F.count("*").alias("n"))
    j = n.join(units, ["major", "sub"], "left")
    return j.groupBy(F.coalesce("unit", F.concat(F.lit("unmapped "), F.col("major"), F.lit("/"), F.col("sub").cast("string"))).alias("unit")).agg(F.sum("n").cast("long").alias("n_questions"))


_CLAIMED = "SELECT DISTINCT id AS group_id, name FROM (SELECT id, unnest(list_concat(coalesce(ai_analysis.topics, []::VARCHAR[]), coalesce(ai_analysis.concepts, []::VARCHAR[]))) AS name FROM posts)"
_SLIDES = "SELECT post_id AS group_id, regexp_extract(media_path, '([^/]*)$', 1) AS file, seq_no AS slide, extracted_text AS text FROM media_items WHERE coalesce(extracted_text, '') <> ''"
_CLAIMS = f"""
WITH c AS (SELECT group_id, name, {_NORM.format('name')} AS k FROM ({_CLAIMED}) WHERE {_NORM.format('name')} <> ''), s AS (SELECT group_id, file, slide, ' ' || {_NORM.format('text')} || ' ' AS t FROM ({_SLIDES}))
SELECT DISTINCT c.group_id, c.name, s.file, s.slide FROM c LEFT JOIN s ON s.group_id = c.group_id AND contains(s.t, ' ' || c.k || ' ')"""


def _claims(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(f"ai_analysis.{c}"), F.array().cast("array<string>"))
    claimed = _posts(spark, d).select(F.col("id").alias("group_id"), F.explode(F.concat(some("topics"), some("concepts"))).alias("name"))
    slides = table(spark, d, "media_items").filter("coalesce(extracted_text, '') <> ''").select(F.col("post_id").alias("group_id"), I.base_name(F.col("media_path")).alias("file"), F.col("seq_no").alias("slide"), F.col("extracted_text").alias("text"))
    return K.claims(claimed, slides)


@R.query(f"{_CLAIMS}")
def agg_derived_claims(spark: SparkSession, d: str) -> DataFrame:
    """What posts claim to be about, with each slide that says so."""
    return _claims(spark, d)


@R.query(f"SELECT sum((file IS NOT NULL)::INTEGER)::BIGINT AS with_slide, sum((file IS NULL)::INTEGER)::BIGINT AS without_slide, count(DISTINCT group_id) AS posts FROM ({_CLAIMS})")
def agg_claim_counts(spark: SparkSession, d: str) -> DataFrame:
    """Claims with and without a slide behind them."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return _claims(spark, d).agg(n(F.col("file").isNotNull()).alias("with_slide"), n(F.col("file").isNull()).alias("without_slide"), F.countDistinct("group_id").alias("posts"))


@R.query(f"""
WITH s AS (SELECT group_id, list_sort(list(DISTINCT name)) AS names FROM ({_CLAIMS}) WHERE file IS NOT NULL GROUP BY 1)
SELECT row_no, array_to_string(CASE WHEN s.names IS NULL THEN l ELSE list_sort(list_distinct(list_concat(l, s.names))) END, '|') AS names FROM (SELECT row_no, id, list_filter(coalesce(ai_analysis.subtopics, []::VARCHAR[]), lambda x: x IS NOT NULL) AS l FROM posts) p LEFT JOIN s ON s.group_id = p.id""")
def join_derived_onto_posts(spark: SparkSession, d: str) -> DataFrame:
    """The subtopics of every post with the claims that slides bear out."""
    p = _posts(spark, d).select("row_no", F.col("id").alias("group_id"), F.filter(F.coalesce(F.col("ai_analysis.subtopics"), F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("names"))
    return K.with_derived(p, _claims(spark, d).filter("file is not null").select("group_id", "name"), "group_id", "names").select("row_no", F.array_join("names", "|").alias("names"))


_TECH = " UNION ALL ".join("SELECT '" + n + "' AS technology, '" + p + "' AS phrase" for n, ps in sorted(T.TECHNOLOGIES.items()) for p in ps)
_FIRST_NAME = "arg_min(v, row_no * 10000 + pos)"


@R.query(f"""
WITH e AS (SELECT row_no, unnest(ai_analysis.concepts) AS v, generate_subscripts(ai_analysis.concepts, 1) AS pos FROM posts), k AS (SELECT *, {_NORM.format('v')} AS key FROM e WHERE trim(v) <> ''),
t AS (SELECT row_no, unnest(ai_analysis.topics) AS topic FROM posts), kt AS (SELECT key, count(DISTINCT topic) AS n FROM k JOIN t USING (row_no) WHERE trim(topic) <> '' GROUP BY 1)
SELECT key, {_FIRST_NAME} AS label, count(*) AS n_mentions, count(DISTINCT row_no) AS n_posts, coalesce(any_value(kt.n), 0) AS n_topics FROM k LEFT JOIN kt USING (key) GROUP BY 1""")
def agg_site_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Concepts with their first spelling, mentions, posts and the topics they stand beside."""
    p = _posts(spark, d)
    e = p.select("row_no", F.posexplode("ai_analysis.concepts").alias("pos", "v")).filter("trim(v) <> ''").withColumn("key", T.normalise_label(F.col("v")))
    t = p.select("row_no", F.explode("ai_analysis.topics").alias("topic")).filter("trim(topic) <> ''").distinct()
    beside = e.select("row_no", "key").distinct().join(t, "row_no").groupBy("key").agg(F.countDistinct("topic").alias("n_topics"))
    g = e.groupBy("key").agg(F.min(F.struct("row_no", "pos", "v")).alias("f"), F.count("*").alias("n_mentions"), F.countDistinct("row_no").alias("n_posts"))
    return g.join(beside, "key", "left").select("key", F.col("f.v").alias("label"), "n_mentions", "n_posts", F.coalesce("n_topics", F.lit(0)).cast("long").alias("n_topics"))


@R.query(f"""
WITH p AS ({_TECH}), h AS (SELECT DISTINCT row_no, id, technology FROM posts, p WHERE contains(lower(original_text), phrase)), q AS (SELECT post_id AS id, count(*) AS n FROM questions GROUP BY 1), t AS (SELECT row_no, unnest(ai_analysis.topics) AS topic FROM posts), b AS (SELECT technology, count(DISTINCT topic) AS n FROM h JOIN t USING (row_no) WHERE trim(topic) <> '' GROUP BY 1)
SELECT technology, count(*) AS n_posts, coalesce(any_value(b.n), 0) AS n_topics, coalesce(sum(q.n), 0)::BIGINT AS n_questions FROM h LEFT JOIN q USING (id) LEFT JOIN b USING (technology) GROUP BY 1""")
def agg_site_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Technologies with their posts, topics and the questions of those posts."""
    p = _posts(spark, d)
    h = p.select("row_no", "id", F.explode(T.technologies(F.col("original_text"))).alias("technology"))
    q = table(spark, d, "questions").groupBy(F.col("post_id").alias("id")).agg(F.count("*").alias("n"))
    t = p.select("row_no", F.explode("ai_analysis.topics").alias("topic")).filter("trim(topic) <> ''").distinct()
    b = h.join(t, "row_no").groupBy("technology").agg(F.countDistinct("topic").alias("n_topics"))
    g = h.join(q, "id", "left").groupBy("technology").agg(F.count("*").alias("n_posts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_questions"))
    return g.join(b, "technology", "left").select("technology", "n_posts", F.coalesce("n_topics", F.lit(0)).cast("long").alias("n_topics"), "n_questions")


@R.query("""
SELECT source.platform AS platform, coalesce(source.capture_method, 'unknown') AS method, count(*) AS n, count(DISTINCT id) AS n_items, min(row_no) AS first_row FROM posts WHERE starts_with(id, 'urn-li-saved') GROUP BY 1, 2""")
def agg_saved_items(spark: SparkSession, d: str) -> DataFrame:
    """Posts that come from a saved list, by platform and way of capture."""
    p = _posts(spark, d).filter(F.col("id").startswith("urn-li-saved"))
    return p.groupBy(F.col("source.platform").alias("platform"), F.coalesce(F.col("source.capture_method"), F.lit("unknown")).alias("method")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_items"), F.min("row_no").alias("first_row"))


@R.query("""
WITH e AS (SELECT row_no, unnest(ai_analysis.topics) AS label FROM posts), n AS (SELECT label, count(DISTINCT row_no) AS n_posts FROM e WHERE trim(label) <> '' GROUP BY 1)
SELECT label, n_posts, row_number() OVER (ORDER BY lower(label), n_posts, label) AS rank FROM n""")
def sort_site_entries(spark: SparkSession, d: str) -> DataFrame:
    """Topics as readers see them listed: by name without case, then by their posts."""
    e = _posts(spark, d).select("row_no", F.explode("ai_analysis.topics").alias("label")).filter("trim(label) <> ''")
    n = e.groupBy("label").agg(F.countDistinct("row_no").alias("n_posts")).withColumn("low", F.lower("label"))
    return ranked(n, "low", "n_posts", "label").select("label", "n_posts", "rank")


_TOPICS = f"""SELECT key, min(struct_pack(r := row_no, p := pos, v := v)).v AS name, min(struct_pack(r := row_no, p := pos)) AS seen FROM (SELECT row_no, pos, trim(v, ' ') AS v, {_NORM.format("trim(v, ' ')")} AS key FROM (SELECT row_no, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (SELECT row_no, list_concat([classification.primary_topic], coalesce(ai_analysis.topics, []::VARCHAR[])) AS l FROM posts)) WHERE trim(v, ' ') <> '') WHERE key <> '' GROUP BY 1"""


@R.query(f"""
WITH u AS ({_TOPICS}), s AS (SELECT key, seen, CASE WHEN b = '' THEN 'untitled' ELSE b END AS base FROM (SELECT key, seen, regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(name), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS b FROM u)),
r AS (SELECT key, base, row_number() OVER (PARTITION BY base ORDER BY seen) - 1 AS k FROM s), c AS (SELECT r.key, r.base, r.k, n, row_number() OVER (PARTITION BY r.key ORDER BY n) AS place FROM r, (SELECT unnest(range(1, 2000)) AS n) g WHERE r.k > 0 AND n <= r.k + 50 AND r.base || '-' || n NOT IN (SELECT base FROM s))
SELECT key, base AS slug FROM r WHERE k = 0 UNION ALL SELECT key, base || '-' || n FROM c WHERE place = k""")
def win_slug_suffix(spark: SparkSession, d: str) -> DataFrame:
    """A name for each topic; names that collide are numbered in the order first seen, past names that are taken."""
    t = L.post_topics(_posts(spark, d)).groupBy("key").agg(F.min(F.struct("row_no", "pos", "name")).alias("f"))
    return K.registered(t.select("key", "f", F.col("f.name").alias("name")), F.col("name"), ["f"]).select("key", "slug")


QUERIES, ORACLE = R.queries, R.oracle

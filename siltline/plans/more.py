"""Further joins, aggregations, set operations and functions on the captured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.functions.paths import contained, path_kinds, redact_paths
from siltline.operators.merging import filled
from siltline.operators.ranking import ranked_within
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


@R.query("""
WITH k AS (SELECT media_no, post_id, regexp_extract(media_path, '^media/([0-9a-f]{8})_', 1) AS key FROM media_items), p AS (SELECT DISTINCT id, right(id, 8) AS key FROM posts)
SELECT k.media_no, p.id AS post_id, k.post_id = p.id AS agrees FROM k JOIN p USING (key) WHERE key <> ''""")
def join_activity(spark: SparkSession, d: str) -> DataFrame:
    """Items joined to posts by the key that their file name holds, and whether the recorded post agrees."""
    k = _t(spark, d, "media_items").select("media_no", "post_id", F.regexp_extract("media_path", r"^media/([0-9a-f]{8})_", 1).alias("key")).filter("key <> ''")
    p = _t(spark, d, "posts").select("id").distinct().withColumn("key", F.expr("right(id, 8)"))
    return k.join(p, "key").select("media_no", F.col("id").alias("post_id"), (F.col("post_id") == F.col("id")).alias("agrees"))


@R.query("""
WITH s AS (SELECT sha256, max(extraction_method) AS em, max(ocr_quality) AS oq FROM media_items WHERE sha256 IS NOT NULL GROUP BY 1)
SELECT m.media_no, coalesce(nullif(trim(s.em, ' '), ''), m.extraction_method) AS extraction_method, coalesce(nullif(trim(s.oq, ' '), ''), m.ocr_quality) AS ocr_quality FROM media_items m LEFT JOIN s USING (sha256)""")
def join_media_merge(spark: SparkSession, d: str) -> DataFrame:
    """Items with the stored readings of their bytes: a stored value wins where it says anything."""
    m = _t(spark, d, "media_items").select("media_no", "sha256", "extraction_method", "ocr_quality")
    s = m.filter("sha256 is not null").groupBy("sha256").agg(F.max("extraction_method").alias("em"), F.max("ocr_quality").alias("oq"))
    j = m.join(s, "sha256", "left")
    return j.select("media_no", filled(F.col("em"), F.col("extraction_method")).alias("extraction_method"), filled(F.col("oq"), F.col("ocr_quality")).alias("ocr_quality"))


@R.query("""
WITH m AS (SELECT DISTINCT post_id FROM run_state), p AS (SELECT id, max(row_no) AS row_no, max((coalesce(trim(ai_analysis.summary, ' '), '') <> '')::INTEGER) AS e FROM posts GROUP BY 1)
SELECT m.post_id, CASE WHEN p.id IS NULL THEN 'pending' WHEN p.e = 1 THEN 'enriched' ELSE 'imported' END AS state, p.row_no FROM m LEFT JOIN p ON p.id = m.post_id""")
def join_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The state of every logged post by what is stored of it; of several captures the last counts."""
    m = _t(spark, d, "run_state").select("post_id").distinct()
    p = _t(spark, d, "posts").groupBy("id").agg(F.max("row_no").alias("row_no"), F.max(F.coalesce(F.trim("ai_analysis.summary"), F.lit("")) != "").alias("e"))
    j = m.join(p, F.col("post_id") == F.col("id"), "left")
    return j.select("post_id", F.when(F.col("id").isNull(), "pending").when(F.col("e"), "enriched").otherwise("imported").alias("state"), "row_no")


@R.query("""
WITH q AS (SELECT question_no, post_id, TRY_CAST(regexp_extract(id, '-q([0-9]+)$', 1) AS INTEGER) AS n FROM questions), m AS (SELECT post_id, seq_no, max(media_no) AS media_no FROM media_items GROUP BY 1, 2)
SELECT q.question_no, coalesce(a.media_no, b.media_no) AS media_no, a.media_no IS NULL AS shifted FROM q LEFT JOIN m a ON a.post_id = q.post_id AND a.seq_no = q.n LEFT JOIN m b ON b.post_id = q.post_id AND b.seq_no = q.n - 1 WHERE coalesce(a.media_no, b.media_no) IS NOT NULL""")
def join_shadow_slide_number(spark: SparkSession, d: str) -> DataFrame:
    """Questions joined to items by their number, or else by the number before: two readings of where counting starts."""
    q = _t(spark, d, "questions").select("question_no", "post_id", F.regexp_extract("id", r"-q([0-9]+)$", 1).try_cast("int").alias("n"))
    m = _t(spark, d, "media_items").groupBy("post_id", "seq_no").agg(F.max("media_no").alias("media_no"))
    a, b = m.select("post_id", F.col("seq_no").alias("n"), F.col("media_no").alias("x")), m.select("post_id", (F.col("seq_no") + 1).alias("n"), F.col("media_no").alias("y"))
    j = q.join(a, ["post_id", "n"], "left").join(b, ["post_id", "n"], "left").filter("coalesce(x, y) is not null")
    return j.select("question_no", F.coalesce("x", "y").alias("media_no"), F.col("x").isNull().alias("shifted"))


@R.query("""
SELECT t.media_no FROM media_items t WHERE t.media_type = 'image' AND t.width < 600 AND EXISTS (SELECT 1 FROM media_items s WHERE s.post_id = t.post_id AND s.media_type = 'image' AND s.width >= 600 AND s.width >= t.width AND s.height >= t.height)""")
def agg_redundant(spark: SparkSession, d: str) -> DataFrame:
    """Small images for which their post has a large one that is at least as high and wide.

    Heights and widths are few, so each post's large images are reduced to the greatest width per height first.
    """
    m = _t(spark, d, "media_items").filter("media_type = 'image'").select("media_no", "post_id", "width", "height")
    large = m.filter("width >= 600").groupBy("post_id").agg(F.collect_set(F.struct("width", "height")).alias("sizes"))
    j = m.filter("width < 600").join(large, "post_id")
    return j.filter(F.exists("sizes", lambda s: (s["width"] >= F.col("width")) & (s["height"] >= F.col("height")))).select("media_no")


@R.query("""
SELECT coalesce(ocr_status, 'none') AS ocr_status, coalesce(ocr_quality, 'none') AS ocr_quality, count(*) AS n, count(DISTINCT sha256) AS n_contents FROM media_items GROUP BY GROUPING SETS ((1, 2))""")
def agg_import_manifest(spark: SparkSession, d: str) -> DataFrame:
    none = lambda c: F.coalesce(c, F.lit("none")).alias(c)
    return _t(spark, d, "media_items").groupBy(none("ocr_status"), none("ocr_quality")).agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_contents"))


@R.query("""
SELECT media_no, CASE WHEN media_type NOT IN ('image', 'pdf') THEN 'not readable' WHEN sha256 IS NULL THEN 'no digest' WHEN coalesce(size_bytes, 0) = 0 THEN 'empty file' WHEN ocr_status = 'ABSENT' THEN 'absent' ELSE 'unread' END AS reason
FROM media_items WHERE coalesce(trim(extracted_text, ' '), '') = ''""")
def agg_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Why an item has no text: the first reason that applies."""
    why = F.when(~F.col("media_type").isin("image", "pdf"), "not readable").when(F.col("sha256").isNull(), "no digest").when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty file").when(F.col("ocr_status") == "ABSENT", "absent").otherwise("unread")
    return _t(spark, d, "media_items").filter(F.coalesce(F.trim("extracted_text"), F.lit("")) == "").select("media_no", why.alias("reason"))


@R.query("""
WITH e AS (SELECT id, unnest(ai_analysis.topics) AS label, 'topic' AS kind FROM posts UNION ALL SELECT id, unnest(ai_analysis.subtopics), 'subtopic' FROM posts)
SELECT label, min(kind) AS kind, count(DISTINCT id) AS n_posts FROM e WHERE label IS NOT NULL GROUP BY label""")
def agg_site_topics(spark: SparkSession, d: str) -> DataFrame:
    """Labels grouped exactly as they are written."""
    p = _t(spark, d, "posts")
    e = [p.select("id", F.explode(f"ai_analysis.{f}").alias("label"), F.lit(k).alias("kind")) for f, k in (("topics", "topic"), ("subtopics", "subtopic"))]
    return e[0].unionByName(e[1]).filter("label is not null").groupBy("label").agg(F.min("kind").alias("kind"), F.countDistinct("id").alias("n_posts"))


@R.query(f"""
WITH e AS (SELECT row_no, {_NORM.format('v')} AS key FROM (SELECT row_no, unnest(ai_analysis.concepts) AS v FROM posts) WHERE v IS NOT NULL)
SELECT key, count(*) AS n FROM e WHERE key <> '' GROUP BY key ORDER BY n DESC, key LIMIT 12""")
def topk_concepts(spark: SparkSession, d: str) -> DataFrame:
    """The twelve most frequent concepts."""
    e = _t(spark, d, "posts").select(F.explode("ai_analysis.concepts").alias("v")).filter("v is not null").select(T.normalise_label(F.col("v")).alias("key")).filter("key <> ''")
    return e.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(12)


@R.query("SELECT term_id, row_number() OVER (ORDER BY lower(term), term, term_id) AS rank FROM reference_terms")
def sort_label(spark: SparkSession, d: str) -> DataFrame:
    """The fixed list of terms in the order that readers see it in."""
    return _t(spark, d, "reference_terms").select("term_id", F.row_number().over(W.orderBy(F.lower("term"), "term", "term_id")).cast("long").alias("rank"))


@R.query("""
SELECT media_no, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(TRY_CAST(regexp_extract(media_path, '_slide_([0-9]+)', 1) AS INTEGER), 2147483647), media_path, media_no) AS rank FROM media_items""")
def sort_assets(spark: SparkSession, d: str) -> DataFrame:
    """Items of a post by the number in their names, as numbers, then by name."""
    n = F.coalesce(F.regexp_extract("media_path", r"_slide_([0-9]+)", 1).try_cast("int"), F.lit(2147483647))
    m = _t(spark, d, "media_items").select("media_no", "post_id", "media_path", n.alias("n"))
    return ranked_within(m, "post_id", "n", "media_path", "media_no").select("media_no", "rank")


_SETS = "list_sort(list_distinct(list_filter(coalesce(ai_analysis.topics, []::VARCHAR[]), lambda x: x IS NOT NULL))) AS a, list_sort(list_distinct(list_filter(coalesce(ai_analysis.subtopics, []::VARCHAR[]), lambda x: x IS NOT NULL))) AS b"


@R.query(f"""
SELECT row_no, len(list_distinct(list_concat(a, b)))::BIGINT AS n_union, len(list_intersect(a, b))::BIGINT AS n_both, len(list_filter(a, lambda x: NOT list_contains(b, x)))::BIGINT AS n_only_topics FROM (SELECT row_no, {_SETS} FROM posts)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of the topics and subtopics of each post."""
    clean = lambda c: F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    p = _t(spark, d, "posts").select("row_no", clean("ai_analysis.topics").alias("a"), clean("ai_analysis.subtopics").alias("b"))
    n = lambda c: F.size(c).cast("long")
    return p.select("row_no", n(F.array_union("a", "b")).alias("n_union"), n(F.array_intersect("a", "b")).alias("n_both"), n(F.array_except("a", "b")).alias("n_only_topics"))


@R.query("""
SELECT row_no, array_to_string(list_filter(list_transform(l, lambda x: trim(x, ' ')), lambda x, i: x <> '' AND i = list_position(list_transform(l, lambda y: trim(y, ' ')), x)), '|') AS labels FROM (SELECT row_no, list_filter(coalesce(ai_analysis.concepts, []::VARCHAR[]), lambda x: x IS NOT NULL) AS l FROM posts)""")
def arr_clean(spark: SparkSession, d: str) -> DataFrame:
    """Concepts trimmed, without blanks and exact repeats, in their order."""
    l = F.filter(F.coalesce(F.col("ai_analysis.concepts"), F.array().cast("array<string>")), lambda x: x.isNotNull())  # noqa: E741
    return _t(spark, d, "posts").select("row_no", F.array_join(F.array_distinct(F.filter(F.transform(l, lambda x: F.trim(x)), lambda x: x != "")), "|").alias("labels"))


@R.query("SELECT row_no, coalesce(nullif(trim(source.author, ' '), ''), nullif(trim(source.platform, ' '), ''), 'unknown') AS name FROM posts")
def prj_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The first field that says anything."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return _t(spark, d, "posts").select("row_no", F.coalesce(some("source.author"), some("source.platform"), F.lit("unknown")).alias("name"))


@R.query("""
SELECT row_no, CASE WHEN coalesce(trim(original_text, ' '), '') <> '' THEN md5(original_text) ELSE md5('Captured from ' || coalesce(source.platform, 'an unknown place') || coalesce(' by ' || source.author, '') || '.') END AS digest FROM posts""")
def prj_body_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The text of a post, or a statement of where it is from; nothing is invented."""
    said = F.concat(F.lit("Captured from "), F.coalesce(F.col("source.platform"), F.lit("an unknown place")), F.coalesce(F.concat(F.lit(" by "), F.col("source.author")), F.lit("")), F.lit("."))
    return _t(spark, d, "posts").select("row_no", F.md5(F.when(F.coalesce(F.trim("original_text"), F.lit("")) != "", F.col("original_text")).otherwise(said)).alias("digest"))


@R.query("""
SELECT q.question_no, coalesce(contains(' ' || trim(regexp_replace(lower(q.answer), '[^a-z0-9]+', ' ', 'g')) || ' ', ' pipeline '), false) AS names_it, coalesce(contains(trim(regexp_replace(lower(q.answer), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(q.question), '[^a-z0-9]+', ' ', 'g'))), false) AS holds_question FROM questions q""")
def str_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer names a term as a whole word, and whether it holds its question."""
    a = T.normalise_label(F.col("answer"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return _t(spark, d, "questions").select("question_no", no(F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.lit(" pipeline "))).alias("names_it"), no(F.contains(a, T.normalise_label(F.col("question")))).alias("holds_question"))


@R.query(f"""
WITH w AS (SELECT question_no, list_sort(list_distinct(list_filter(string_split({_NORM.format("coalesce(question, '')")}, ' '), lambda x: x <> ''))) AS a, list_sort(list_distinct(list_filter(string_split({_NORM.format("coalesce(answer, '')")}, ' '), lambda x: x <> ''))) AS b FROM questions)
SELECT question_no, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS similarity FROM w""")
def str_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the words of each question and its answer."""
    words = lambda c: F.array_distinct(F.filter(F.split(T.normalise_label(F.coalesce(F.col(c), F.lit(""))), " "), lambda x: x != ""))
    return _t(spark, d, "questions").select("question_no", words("question").alias("a"), words("answer").alias("b")).select("question_no", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@R.query("SELECT row_no, (regexp_matches(original_text, 'https?://') AND len(list_filter(string_split(trim(regexp_replace(regexp_replace(original_text, 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) < 3) AS looks_like_link FROM posts WHERE original_text IS NOT NULL")
def str_looks_like_link(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is an address and hardly more."""
    rest = F.trim(F.regexp_replace(F.regexp_replace("original_text", r"https?://\S+", ""), r"\s+", " "))
    n = F.size(F.filter(F.split(rest, " "), lambda x: x != ""))
    return _t(spark, d, "posts").filter("original_text is not null").select("row_no", (F.col("original_text").rlike("https?://") & (n < 3)).alias("looks_like_link"))


# a line of a known form for each item: what stands in it, what must come out, and the kind of path
_LINES = [
    ("concat('C:', b, 'Users', b, 'Your Name', b, replace(media_path, '/', b), '>type ', id)", "'<LOCAL_WINDOWS_PATH>>type ' || id", "drive"), ("concat('open c:', b, b, 'data', b, b, id, '.txt')", "'open <LOCAL_WINDOWS_PATH>'", "drive"), ("concat('c', b, b, 'Users', b, 'Me>run ', id)", "'<LOCAL_WINDOWS_PATH>>run ' || id", "drive"),
    ("concat('see ', b, b, 'server', b, 'share', b, id)", "'see <UNC_PATH>'", "share"), ("concat('%APPDATA%', b, id, '|more')", "'<LOCAL_PATH_ENV_VAR>|more'", "variable"), ("concat('.venv', b, 'Scripts', b, 'run.exe')", "'<LOCAL_PROJECT_PATH>'", "project"),
    ("concat('copy D:', b, id, '.a E:', b, id)", "'copy <LOCAL_WINDOWS_PATH><LOCAL_WINDOWS_PATH>'", "drive"), ("concat('n//2 and I/O of s3://lake/', media_path, ' at %d/%m/%Y')", "'n//2 and I/O of s3://lake/' || media_path || ' at %d/%m/%Y'", None),
]
_line = lambda k: "CASE media_no % 8 " + " ".join(f"WHEN {n} THEN {x[k]}" for n, x in enumerate(_LINES)) + " END"


def _path_lines(spark: SparkSession, d: str) -> DataFrame:
    m = _t(spark, d, "media_items").select("media_no", F.coalesce("media_path", F.lit("")).alias("media_path"), F.col("media_no").cast("string").alias("id"), F.chr(F.lit(92)).alias("b"))
    return m.select("media_no", F.expr(_line(0)).alias("line"))


_ITEMS = "(SELECT media_no, coalesce(media_path, '') AS media_path, media_no::VARCHAR AS id FROM media_items)"


@R.query(f"SELECT media_no, {_line(1)} AS text, CASE media_no % 8 WHEN 6 THEN 2 WHEN 7 THEN 0 ELSE 1 END::INTEGER AS n FROM {_ITEMS}")
def str_redact_paths(spark: SparkSession, d: str) -> DataFrame:
    """A line with a local path of a known form for every item, with the paths replaced and counted."""
    return _path_lines(spark, d).select("media_no", redact_paths(F.col("line")).alias("r")).select("media_no", "r.text", "r.n")


@R.query("SELECT media_no, kind FROM (SELECT media_no, CASE media_no % 8 " + " ".join(f"WHEN {n} THEN '{x[2]}'" for n, x in enumerate(_LINES) if x[2]) + " END AS kind FROM media_items) WHERE kind IS NOT NULL")
def str_find_paths(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of local path in the same lines."""
    return _path_lines(spark, d).select("media_no", F.explode(path_kinds(F.col("line"))).alias("kind"))


@R.query("SELECT doc_id, md5(text) AS digest, 0 AS n FROM documents")
def str_keep_technical_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents hold code, addresses and dates but no local path, and come back as they are."""
    return _t(spark, d, "documents").select("doc_id", redact_paths(F.col("text")).alias("r")).select("doc_id", F.md5("r.text").alias("digest"), "r.n")


@R.query("""
SELECT 'post' AS kind, row_no AS no, substr(trim(regexp_replace(coalesce(original_text, ''), '\\s+', ' ', 'g')), 1, 400) AS text FROM posts UNION ALL
SELECT 'question', question_no, substr(trim(regexp_replace(coalesce(question, ''), '\\s+', ' ', 'g')), 1, 400) FROM questions""")
def q_build_index(spark: SparkSession, d: str) -> DataFrame:
    """Search records of posts and questions; the shown text is cut at 400 characters."""
    short = lambda c: F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), 1, 400).alias("text")
    p = _t(spark, d, "posts").select(F.lit("post").alias("kind"), F.col("row_no").alias("no"), short("original_text"))
    return p.unionByName(_t(spark, d, "questions").select(F.lit("question").alias("kind"), F.col("question_no").alias("no"), short("question")))


@R.query("""
WITH a AS (SELECT sha256, max(media_no) AS by_no FROM media_items WHERE extraction_method IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1)
SELECT m.media_no, a.by_no IS NOT NULL AS cached FROM media_items m LEFT JOIN a USING (sha256)""")
def inc_visual_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether a reading of an item's bytes is stored."""
    m = _t(spark, d, "media_items")
    a = m.filter("extraction_method is not null and sha256 is not null").groupBy("sha256").agg(F.max("media_no").alias("by_no"))
    return m.select("media_no", "sha256").join(a, "sha256", "left").select("media_no", F.col("by_no").isNotNull().alias("cached"))


@R.query("""
SELECT post_id, row_no, worker FROM (SELECT p.id AS post_id, p.row_no, r.worker_id AS worker, row_number() OVER (PARTITION BY p.row_no ORDER BY r.logged_at DESC, r.run_no DESC) AS k FROM posts p JOIN run_state r ON r.post_id = p.id AND r.logged_at <= p.ingested_at + INTERVAL 30 DAY) WHERE k = 1""")
def join_latest_run(spark: SparkSession, d: str) -> DataFrame:
    """The last run of each capture that was logged at most thirty days after it: an as-of join by one ordered pass.

    Runs and captures of a post stand in the order of their times, and each capture takes the last run before it; nothing multiplies.
    """
    r = _t(spark, d, "run_state").filter("logged_at is not null").select("post_id", F.col("logged_at").alias("t"), F.lit(0).alias("kind"), F.struct("logged_at", "run_no", F.col("worker_id").alias("worker")).alias("run"), F.lit(None).cast("long").alias("row_no"))
    p = _t(spark, d, "posts").filter("ingested_at is not null").select(F.col("id").alias("post_id"), (F.col("ingested_at") + F.expr("interval 30 days")).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(r.schema["run"].dataType).alias("run"), "row_no")
    last = F.max("run").over(W.partitionBy("post_id").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    return r.unionByName(p).withColumn("last", last).filter("kind = 1 and last is not null and post_id is not null").select("post_id", "row_no", "last.worker")


# ways of writing a path: those that stay below their folder, and those that don't
_WAYS = ["", "/", "C:/", "../", "a/../../", "a/b/"]


@R.query("SELECT media_no, media_no % 6 IN (0, 5) AS inside FROM media_items WHERE media_path IS NOT NULL")
def flt_contained_path(spark: SparkSession, d: str) -> DataFrame:
    """Whether paths of items, written in ways that leave their folder and in ways that don't, stay inside it."""
    way = F.element_at(F.array(*map(F.lit, _WAYS)), (F.col("media_no") % 6 + 1).cast("int"))
    return _t(spark, d, "media_items").filter("media_path is not null").select("media_no", contained(F.concat(way, F.col("media_path"))).alias("inside"))


@R.query("SELECT media_no, md5(extracted_text) AS public_digest, md5(trim(regexp_replace(extracted_text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS search_digest, 0 AS redactions FROM media_items")
def prj_public_record(spark: SparkSession, d: str) -> DataFrame:
    """Items as they may be published: the text without local paths and its form for searches; the text as read is dropped."""
    m = _t(spark, d, "media_items").select("media_no", redact_paths(F.col("extracted_text")).alias("r"))
    return m.select("media_no", F.md5("r.text").alias("public_digest"), F.md5(T.collapse(F.col("r.text"))).alias("search_digest"), F.col("r.n").alias("redactions"))


QUERIES, ORACLE = R.queries, R.oracle

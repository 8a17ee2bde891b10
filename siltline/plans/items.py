"""Queries over items and results of several runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import items as S
from siltline.operators import questions as Q
from siltline.operators.ranking import ranked
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_STATE = "CASE WHEN coalesce(ai_analysis.summary, '') <> '' THEN 'ENRICHED' WHEN coalesce(original_text, '') <> '' THEN 'IMPORTED' ELSE 'PENDING' END"
_RANK = "coalesce(list_position(['PENDING', 'FAILED', 'CAPTURED', 'IMPORTED', 'ENRICHED'], {}), 0)"
# the list of an automated capture, and that of all other ways of capture; repeats are folded
_LIST = f"""SELECT id, arg_min(nullif(source.author, ''), row_no) FILTER (nullif(source.author, '') IS NOT NULL) AS author, arg_min(nullif(source.url, ''), row_no) FILTER (nullif(source.url, '') IS NOT NULL) AS url,
  max(struct_pack(r := row_no, v := md5(original_text))).v AS digest, max(struct_pack(r := row_no, v := original_text)).v AS body, max(struct_pack(r := row_no, v := {_STATE})).v AS state FROM posts WHERE {{}} GROUP BY id"""
_AUTO = "coalesce(source.capture_method, '') = 'automated'"
_MERGED = f"""
WITH s AS ({_LIST.format(_AUTO)}), i AS ({_LIST.format(f'NOT ({_AUTO})')}),
j AS (SELECT coalesce(s.id, i.id) AS id, s.id IS NULL AS new, i.id IS NOT NULL AS known, coalesce(i.digest <> '' AND coalesce(s.digest, '') <> i.digest, false) AS changed, s.author AS sa, i.author AS ia, s.url AS su, i.url AS iu, s.digest AS sd, i.digest AS idg, s.state AS ss, i.state AS ist FROM s FULL OUTER JOIN i ON s.id = i.id),
k AS (SELECT *, CASE WHEN changed THEN 'CAPTURED' ELSE ss END AS kept FROM j)
SELECT id, CASE WHEN new THEN ia ELSE coalesce(nullif(sa, ''), nullif(ia, ''), sa) END AS author, CASE WHEN new THEN iu ELSE coalesce(nullif(su, ''), nullif(iu, ''), su) END AS url, CASE WHEN new OR changed THEN idg ELSE sd END AS digest,
  CASE WHEN new THEN ist WHEN {_RANK.format('ist')} > {_RANK.format('kept')} THEN ist ELSE kept END AS state, CASE WHEN new THEN 'new' WHEN known THEN 'merged' ELSE 'stored' END AS status FROM k"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


def _state() -> F.Column:
    return F.when(F.coalesce(F.col("ai_analysis.summary"), F.lit("")) != "", "ENRICHED").when(F.coalesce("original_text", F.lit("")) != "", "IMPORTED").otherwise("PENDING")


def _merged(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d).select("id", "row_no", F.col("source.author").alias("author"), F.col("source.url").alias("url"), F.md5("original_text").alias("digest"), _state().alias("state"), (F.coalesce(F.col("source.capture_method"), F.lit("")) == "automated").alias("auto"))
    fold = lambda x: S.fold_items(x, "id", ["row_no"], ["author", "url"], ["digest", "state"])
    return S.merge_items(fold(p.filter("auto")), fold(p.filter("not auto")), "id", ["author", "url"], [])


@R.query(_MERGED)
def set_item_merge(spark: SparkSession, d: str) -> DataFrame:
    """Items captured automatically merged with those captured otherwise: filled fields, changed content, the higher state."""
    return _merged(spark, d)


@R.query(f"SELECT status, count(*) AS n, count(*) FILTER (state = 'CAPTURED') AS n_changed FROM ({_MERGED}) GROUP BY 1")
def inc_manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """How many items were new, known or only stored, and how many changed."""
    return _merged(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.when(F.col("state") == "CAPTURED", 1).otherwise(0)).cast("long").alias("n_changed"))


@R.query(f"""
SELECT count(*) AS discovered, sum((state = 'PENDING')::INTEGER)::BIGINT AS new, sum((digest IS NOT NULL AND digest <> md5(''))::INTEGER)::BIGINT AS with_content, sum((coalesce(digest, md5('')) = md5(''))::INTEGER)::BIGINT AS metadata_only,
  sum((state IN ('IMPORTED', 'ENRICHED'))::INTEGER)::BIGINT AS imported, sum((state = 'ENRICHED')::INTEGER)::BIGINT AS enriched, sum((state = 'FAILED')::INTEGER)::BIGINT AS failed, sum((state = 'PENDING')::INTEGER)::BIGINT AS pending FROM ({_MERGED})""")
def agg_manifest_report(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a saved list: by content and by state."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    m, empty = _merged(spark, d), F.coalesce("digest", F.md5(F.lit(""))) == F.md5(F.lit(""))
    is_ = lambda *s: some(F.col("state").isin(*s))
    return m.agg(F.count("*").alias("discovered"), is_("PENDING").alias("new"), some(~empty).alias("with_content"), some(empty).alias("metadata_only"), is_("IMPORTED", "ENRICHED").alias("imported"), is_("ENRICHED").alias("enriched"), is_("FAILED").alias("failed"), is_("PENDING").alias("pending"))


@R.query("""
WITH f AS (SELECT id, row_no, ai_analysis.summary AS summary FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no) = 1), l AS (SELECT id, source.url AS url, original_text AS t FROM posts QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1)
SELECT f.id, md5(f.summary) AS analysis, l.url, md5(l.t) AS digest FROM f JOIN l USING (id)""")
def inc_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The first result of every post with address and text as the latest capture has them; the analysis stays."""
    p = _posts(spark, d).select("id", "row_no", F.col("ai_analysis.summary").alias("summary"), F.col("source.url").alias("url"), F.col("original_text").alias("t"))
    pick = lambda f: p.groupBy("id").agg(f(F.struct("row_no", "summary", "url", "t")).alias("m")).select("id", "m.summary", "m.url", "m.t")
    return S.refreshed(pick(F.min), pick(F.max), "id", ["url", "t"]).select("id", F.md5("summary").alias("analysis"), "url", F.md5("t").alias("digest"))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"
_KEY = f"array_to_string(list_sort(list_filter(string_split(trim(regexp_replace(lower(coalesce({{}}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN {_STOP})), ' ')"


@R.query(f"""
WITH q AS (SELECT DISTINCT post_id, {_KEY.format('question')} AS key FROM questions WHERE coalesce(source_kind, '') <> 'image_ocr'), c AS (SELECT post_id, {_KEY.format('question')} AS key, question_no, question FROM questions WHERE source_kind = 'image_ocr')
SELECT post_id, min(question_no) AS question_no, 'theory' AS type, 'medium' AS difficulty FROM c WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM q WHERE q.post_id = c.post_id AND q.key = c.key) GROUP BY post_id, key""")
def inc_add_ocr_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions read from images that their post doesn't have in other words."""
    k = table(spark, d, "questions").select("post_id", "question_no", "question", "source_kind", T.question_key(F.coalesce("question", F.lit(""))).alias("key"))
    read = k.filter("source_kind = 'image_ocr'").select("post_id", "key", F.col("question_no").alias("order"), F.col("question").alias("text"))
    return S.added_questions(k.filter("coalesce(source_kind, '') <> 'image_ocr'"), read).select("post_id", F.col("order").alias("question_no"), "type", "difficulty")


@R.query("""
WITH s AS (SELECT DISTINCT id FROM posts), k AS (SELECT DISTINCT post_id FROM run_state WHERE status = 'done') SELECT id FROM s WHERE id NOT IN (SELECT post_id FROM k WHERE post_id IS NOT NULL) ORDER BY id LIMIT 50""")
def limit_max_posts(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty posts without a finished run: the budget counts new ones only."""
    return S.collected(_posts(spark, d).select("id").distinct(), table(spark, d, "run_state").filter("status = 'done'").select(F.col("post_id").alias("id")), "id", ["id"], 50)


@R.query("""
WITH s AS (SELECT DISTINCT id FROM posts ORDER BY id LIMIT 100), k AS (SELECT DISTINCT post_id FROM run_state WHERE status = 'done') SELECT id FROM s WHERE id NOT IN (SELECT post_id FROM k WHERE post_id IS NOT NULL) ORDER BY id LIMIT 50""")
def limit_source_posts(spark: SparkSession, d: str) -> DataFrame:
    """The same where the source hands out a hundred posts at most, finished ones too."""
    return S.collected(_posts(spark, d).select("id").distinct(), table(spark, d, "run_state").filter("status = 'done'").select(F.col("post_id").alias("id")), "id", ["id"], 50, 100)


@R.query("SELECT term_id, term, greatest(n - 10, 0)::BIGINT AS more FROM (SELECT term_id, term, count(*) OVER () AS n FROM reference_terms ORDER BY term, term_id LIMIT 10)")
def limit_list_display(spark: SparkSession, d: str) -> DataFrame:
    """The first ten terms and how many more there are."""
    return S.displayed(table(spark, d, "reference_terms").select("term_id", "term"), ["term", "term_id"], 10)


_PLAN = """
WITH l AS (SELECT row_no, id AS key, row_no <> min(row_no) OVER (PARTITION BY id) AS rep, source.url IS NOT NULL OR id IS NOT NULL AS valid FROM posts), c AS (SELECT post_id AS key, max(sha256) AS now FROM media_items GROUP BY 1),
s AS (SELECT r.post_id AS key, max(m.was) AS was, max((status = 'failed')::INTEGER) AS failed FROM run_state r LEFT JOIN (SELECT post_id, max(sha256) FILTER (extraction_method IS NOT NULL) AS was FROM media_items GROUP BY 1) m USING (post_id) GROUP BY 1)
SELECT l.row_no, CASE WHEN NOT valid THEN 'INVALID' WHEN rep THEN 'DUPLICATE' WHEN c.key IS NULL THEN 'MISSING_CAPTURE' WHEN s.failed = 1 THEN 'FAILED' WHEN s.key IS NULL THEN 'NEW' WHEN was IS NOT DISTINCT FROM now THEN 'UNCHANGED' ELSE 'CHANGED' END AS outcome FROM l LEFT JOIN c USING (key) LEFT JOIN s USING (key)"""


def _planned(spark: SparkSession, d: str) -> DataFrame:
    p = _posts(spark, d).select("row_no", "id", F.col("source.url").alias("url"))
    first = p.groupBy("id").agg(F.min("row_no").alias("first"))
    listed = p.join(first, "id").select("row_no", F.col("id").alias("key"), (F.col("row_no") != F.col("first")).alias("repeat"), (F.col("url").isNotNull() | F.col("id").isNotNull()).alias("valid"))
    m = table(spark, d, "media_items").select(F.col("post_id").alias("key"), "sha256", "extraction_method").filter("key is not null")
    stored = table(spark, d, "run_state").filter("post_id is not null").groupBy(F.col("post_id").alias("key")).agg(F.max(F.col("status") == "failed").alias("failed"))
    stored = stored.join(m.filter("extraction_method is not null").groupBy("key").agg(F.max("sha256").alias("digest")), "key", "left")
    plan = S.planned(listed.select("key", "repeat", "valid").distinct(), m.select("key", F.col("sha256").alias("digest")), stored)
    # an item's rows differ only in being a repeat
    return listed.join(plan.withColumn("rep", F.col("outcome") == "DUPLICATE"), (listed.key == plan.key) & (F.col("repeat") == F.col("rep"))).select("row_no", "outcome")


@R.query(_PLAN)
def inc_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a run would do with every listed post: all seven outcomes."""
    return _planned(spark, d)


@R.query(f"SELECT o.outcome, count(p.row_no) AS n FROM (SELECT unnest(['NEW', 'CHANGED', 'UNCHANGED', 'DUPLICATE', 'MISSING_CAPTURE', 'INVALID', 'FAILED']) AS outcome) o LEFT JOIN ({_PLAN}) p USING (outcome) GROUP BY 1")
def agg_plan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Listed posts of each outcome, zero-filled."""
    return S.tally(_planned(spark, d), "outcome", S.OUTCOMES)


_QUALITY = """
WITH m AS (SELECT post_id, coalesce(max(media_type = 'image'), false) AS i, coalesce(max(media_type = 'pdf'), false) AS p, coalesce(max(sha256 IS NULL), false) AS u FROM media_items GROUP BY 1),
t AS (SELECT id, max(coalesce(original_text, '') <> '') AS t FROM posts GROUP BY 1)
SELECT id, CASE WHEN (t OR i OR p) AND u THEN 'partial' WHEN t AND (i OR p) THEN 'text_and_media' WHEN t THEN 'text' WHEN i THEN 'image_only' WHEN p THEN 'document_only' ELSE 'metadata_only' END AS quality FROM (SELECT id, t, coalesce(i, false) AS i, coalesce(p, false) AS p, coalesce(u, false) AS u FROM t LEFT JOIN m ON m.post_id = t.id)"""


def _qualities(spark: SparkSession, d: str) -> DataFrame:
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    m = table(spark, d, "media_items").groupBy(F.col("post_id").alias("id")).agg(has(F.col("media_type") == "image").alias("i"), has(F.col("media_type") == "pdf").alias("p"), has(F.col("sha256").isNull()).alias("u"))
    t = _posts(spark, d).groupBy("id").agg(F.max(F.coalesce("original_text", F.lit("")) != "").alias("t")).join(m, "id", "left").na.fill(False, ["i", "p", "u"])
    i, p, u, b = F.col("i"), F.col("p"), F.col("u"), F.col("t")
    q = F.when((b | i | p) & u, "partial").when(b & (i | p), "text_and_media").when(b, "text").when(i, "image_only").when(p, "document_only").otherwise("metadata_only")
    return t.select("id", q.alias("quality"))


@R.query(f"{_QUALITY}")
def cap_quality(spark: SparkSession, d: str) -> DataFrame:
    """How much of each post was captured; partial if a file of it couldn't be read."""
    return _qualities(spark, d)


@R.query(f"SELECT o.quality, count(p.id) AS n FROM (SELECT unnest(['text', 'text_and_media', 'image_only', 'document_only', 'partial', 'metadata_only']) AS quality) o LEFT JOIN ({_QUALITY}) p USING (quality) GROUP BY 1")
def agg_by_quality(spark: SparkSession, d: str) -> DataFrame:
    """Posts of each quality of capture, zero-filled."""
    return S.tally(_qualities(spark, d), "quality", S.QUALITIES)


@R.query("""
WITH e AS (SELECT row_no, (coalesce(trim(original_text, ' '), '') = '')::INTEGER + (source.platform IS NULL)::INTEGER AS e, (source.author IS NULL)::INTEGER + (source.url IS NULL)::INTEGER AS w FROM posts)
SELECT count(*) AS posts, sum(e)::BIGINT AS errors, sum(w)::BIGINT AS warnings, sum(e) = 0 AS ok FROM e""")
def agg_validation_report(spark: SparkSession, d: str) -> DataFrame:
    """Posts, errors and warnings of all checks, and whether a run may go on."""
    yes = lambda c: c.cast("int")
    e = yes(F.coalesce(F.trim("original_text"), F.lit("")) == "") + yes(F.col("source.platform").isNull())
    w = yes(F.col("source.author").isNull()) + yes(F.col("source.url").isNull())
    return _posts(spark, d).select(e.alias("e"), w.alias("w")).agg(F.count("*").alias("posts"), F.sum("e").cast("long").alias("errors"), F.sum("w").cast("long").alias("warnings"), (F.sum("e") == 0).alias("ok"))


@R.query("""
SELECT 'difficulty' AS "column", 'not allowed' AS problem, count(*) AS n FROM questions WHERE difficulty NOT IN ('easy', 'hard') HAVING count(*) > 0 UNION ALL SELECT 'question_type', 'not allowed', count(*) FROM questions WHERE question_type NOT IN ('theory', 'coding') HAVING count(*) > 0
UNION ALL SELECT 'answer', 'missing', count(*) FROM questions WHERE answer IS NULL HAVING count(*) > 0 UNION ALL SELECT 'question', 'missing', count(*) FROM questions WHERE question IS NULL HAVING count(*) > 0""")
def val_schema(spark: SparkSession, d: str) -> DataFrame:
    """Values outside their list and missing values of questions, in one scan."""
    return S.violations(table(spark, d, "questions"), {"difficulty": ["easy", "hard"], "question_type": ["theory", "coding"]}, ["answer", "question"])


@R.query("SELECT platform, home_zone FROM platforms")
def val_expected_count(spark: SparkSession, d: str) -> DataFrame:
    """The platforms, if there are six as the table promises."""
    return S.expect_count(table(spark, d, "platforms").select("platform", "home_zone"), 6)


@R.query("SELECT row_no, row_number() OVER (ORDER BY id, row_no) AS position, count(*) OVER () AS of FROM posts")
def win_position_progress(spark: SparkSession, d: str) -> DataFrame:
    """The place of every post in the order of a run, and how many there are."""
    p = _posts(spark, d).select("id", "row_no")
    return ranked(p, "id", "row_no").crossJoin(p.agg(F.count("*").alias("of"))).select("row_no", F.col("rank").alias("position"), "of")  # one row


@R.query("""
SELECT worker_id, CASE WHEN max((error_type = 'timeout')::INTEGER) = 1 AND count(*) FILTER (status = 'failed') > 40 THEN 'failed' WHEN count(*) FILTER (status = 'done') >= 200 THEN 'max_posts' WHEN max(logged_at) >= TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN 'until_date' WHEN sum(attempts) >= 150 THEN 'scroll_limit' WHEN count(*) FILTER (status IN ('done', 'skipped')) = 0 THEN 'layout_changed' ELSE 'exhausted' END AS reason,
  CASE WHEN max((error_type = 'timeout')::INTEGER) = 1 AND count(*) FILTER (status = 'failed') > 40 THEN false WHEN count(*) FILTER (status = 'done') >= 200 THEN true WHEN max(logged_at) >= TIMESTAMPTZ '2026-01-01 00:00:00+00' THEN true WHEN sum(attempts) >= 150 THEN false WHEN count(*) FILTER (status IN ('done', 'skipped')) = 0 THEN false ELSE true END AS succeeded FROM run_state GROUP BY 1""")
def inc_stop_reason(spark: SparkSession, d: str) -> DataFrame:
    """Why the work of each worker ended, and whether that is a success."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    w = table(spark, d, "run_state").groupBy("worker_id").agg(n(F.col("status").isin("done", "skipped")).alias("seen"), n(F.col("status") == "done").alias("persisted"), (F.max("logged_at") >= F.lit("2026-01-01 00:00:00+00").cast("timestamp")).alias("until"), F.sum("attempts").alias("scrolls"), (F.coalesce(F.max(F.col("error_type") == "timeout"), F.lit(False)) & (n(F.col("status") == "failed") > 40)).alias("broken"))
    reason = S.stop_reason(F.col("seen"), F.col("persisted"), 200, F.coalesce("until", F.lit(False)), F.coalesce("scrolls", F.lit(0)), 150, F.col("broken"))
    return w.select("worker_id", reason.alias("reason"), (~reason.isin(S.FAILED_STOPS)).alias("succeeded"))


@R.query("SELECT post_id, CASE WHEN status = 'retrying' THEN 'pending' ELSE status END AS status, attempts FROM (SELECT post_id, status, attempts, row_number() OVER (PARTITION BY post_id ORDER BY logged_at DESC, run_no DESC) AS r FROM run_state) WHERE r = 1")
def inc_run_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of every post at a restart: what was still running is pending again."""
    g = table(spark, d, "run_state").groupBy("post_id").agg(F.max(F.struct("logged_at", "run_no", "status", "attempts")).alias("m"))
    return g.select("post_id", F.when(F.col("m.status") == "retrying", "pending").otherwise(F.col("m.status")).alias("status"), "m.attempts")


@R.query(f"""
WITH m AS ({_MERGED}) SELECT id, row_number() OVER (ORDER BY (state <> 'PENDING')::INTEGER, id) AS rank FROM m""")
def sort_items_fresh_first(spark: SparkSession, d: str) -> DataFrame:
    """Items that are still to be done first, then the rest, each by id."""
    m = _merged(spark, d).select("id", (F.col("state") != "PENDING").alias("late"))
    return ranked(m, "late", "id").select("id", "rank")


QUERIES, ORACLE = R.queries, R.oracle

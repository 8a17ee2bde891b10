"""Queries over media items: files, transcriptions, duplicates, cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.functions.digests import CHUNK, list_digests
from siltline.operators.dedupe import first_seen, keepers
from siltline.operators.ranking import ranked_within
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_BODY = "regexp_replace(coalesce(extracted_text, ''), '^\\s+|\\s+$', '', 'g')"
_QUALITY = f"""
WITH b AS (SELECT media_no, {_BODY} AS t FROM media_items), w AS (SELECT media_no, t, regexp_extract_all(lower(t), '\\p{{L}}{{4,}}') AS ws, len(regexp_extract_all(t, '\\p{{L}}+')) AS n FROM b),
     d AS (SELECT *, list_max(list_transform(list_distinct(ws), lambda x: len(list_filter(ws, lambda y: y = x)))) AS top FROM w)
SELECT media_no, CASE WHEN t = '' THEN 'empty' WHEN len(ws) >= 12 AND top * 3 >= len(ws) THEN 'garbled' WHEN regexp_matches(t, '[�□]') THEN 'garbled'
  WHEN length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]', '', 'g'))::DOUBLE / greatest(length(t), 1) > 0.40 THEN 'garbled' WHEN n < 4 THEN 'fragmentary' ELSE 'readable' END AS quality FROM d"""


def _m(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_items")


@R.query(_QUALITY)
def str_ocr_quality(spark: SparkSession, d: str) -> DataFrame:
    return _m(spark, d).select("media_no", T.ocr_quality(F.col("extracted_text")).alias("quality"))


@R.query(f"SELECT q.quality, count(m.quality) AS n FROM (SELECT unnest(['empty', 'fragmentary', 'garbled', 'readable']) AS quality) q LEFT JOIN ({_QUALITY}) m ON m.quality = q.quality GROUP BY 1")
def agg_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items of each quality, zero-filled."""
    levels = spark.createDataFrame([("empty",), ("fragmentary",), ("garbled",), ("readable",)], "quality string")
    n = str_ocr_quality(spark, d).groupBy("quality").agg(F.count("*").alias("n"))
    return levels.join(n, "quality", "left").select("quality", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@R.query("SELECT media_no, regexp_extract(media_path, '^(?:.*/)?(.+)_slide_[0-9]+\\.[^.]*$', 1) AS stem, TRY_CAST(regexp_extract(media_path, '_slide_([0-9]+)\\.[^.]*$', 1) AS BIGINT) AS slide FROM media_items")
def file_slide_number(spark: SparkSession, d: str) -> DataFrame:
    """The stem and slide number that a file name holds."""
    p = F.col("media_path")
    return _m(spark, d).select("media_no", F.regexp_extract(p, r"^(?:.*/)?(.+)_slide_[0-9]+\.[^.]*$", 1).alias("stem"), F.regexp_extract(p, r"_slide_([0-9]+)\.[^.]*$", 1).try_cast("long").alias("slide"))


_TYPE = "CASE lower(regexp_extract(media_path, '\\.([^./]*)$', 1)) WHEN 'png' THEN 'image' WHEN 'jpg' THEN 'image' WHEN 'jpeg' THEN 'image' WHEN 'gif' THEN 'image' WHEN 'webp' THEN 'image' WHEN 'svg' THEN 'image' WHEN 'pdf' THEN 'pdf' WHEN 'mp4' THEN 'video' WHEN 'mov' THEN 'video' WHEN 'webm' THEN 'video' ELSE 'other' END"


@R.query(f"SELECT media_type, {_TYPE} AS by_name, count(*) AS n FROM media_items GROUP BY 1, 2")
def file_media_type(spark: SparkSession, d: str) -> DataFrame:
    """The stated type against the type that the file name tells."""
    ext = F.lower(F.regexp_extract("media_path", r"\.([^./]*)$", 1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").when(ext == "pdf", "pdf").when(ext.isin("mp4", "mov", "webm"), "video").otherwise("other")
    return _m(spark, d).groupBy("media_type", kind.alias("by_name")).agg(F.count("*").alias("n"))


@R.query("""
SELECT media_no, k AS duplicate_of FROM (SELECT media_no, first_value(media_no) OVER (PARTITION BY sha256 ORDER BY coalesce(width, 0)::BIGINT * coalesce(height, 0) DESC, size_bytes DESC, media_no) AS k FROM media_items WHERE sha256 IS NOT NULL) WHERE media_no <> k""")
def agg_asset_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Items whose bytes a better item has: more pixels, more bytes, earlier."""
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))
    return keepers(_m(spark, d), F.col("sha256"), "media_no", [pixels, F.coalesce("size_bytes", F.lit(-1))])


@R.query("""
SELECT count(*) AS n_items, count(DISTINCT sha256) AS n_contents, coalesce(sum(size_bytes), 0)::BIGINT AS n_bytes, sum((media_type = 'image')::INTEGER)::BIGINT AS n_images, sum((media_type = 'pdf')::INTEGER)::BIGINT AS n_pdf,
  sum((coalesce(extracted_text, '') <> '')::INTEGER)::BIGINT AS n_text, count(DISTINCT post_id) AS n_posts FROM media_items""")
def agg_media_counts(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return _m(spark, d).agg(F.count("*").alias("n_items"), F.countDistinct("sha256").alias("n_contents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("n_bytes"), some(F.col("media_type") == "image").alias("n_images"), some(F.col("media_type") == "pdf").alias("n_pdf"), some(F.coalesce("extracted_text", F.lit("")) != "").alias("n_text"), F.countDistinct("post_id").alias("n_posts"))


@R.query("SELECT media_no FROM (SELECT media_no, min(media_no) OVER (PARTITION BY sha256) AS f FROM media_items WHERE sha256 IS NOT NULL) WHERE media_no = f")
def win_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return first_seen(_m(spark, d), "sha256", "media_no")


@R.query("SELECT media_no, ((row_number() OVER (PARTITION BY post_id ORDER BY seq_no, media_path, media_no) - 1) // 5)::BIGINT AS batch FROM media_items WHERE media_type = 'image'")
def win_batch_number(spark: SparkSession, d: str) -> DataFrame:
    """Images of each post in batches of five, in their order."""
    m = _m(spark, d).filter("media_type = 'image'").select("media_no", "post_id", "seq_no", "media_path")
    r = ranked_within(m, "post_id", F.col("seq_no").asc_nulls_last(), "media_path", "media_no")
    return r.select("media_no", F.floor((F.col("rank") - 1) / 5).cast("long").alias("batch"))


@R.query("""
WITH f AS (SELECT *, min(media_no) OVER (PARTITION BY sha256) = media_no AS first FROM media_items WHERE post_id IS NOT NULL)
SELECT post_id, count(*) AS assets, sum((media_type = 'image')::INTEGER)::BIGINT AS images, sum((NOT coalesce(first, false))::INTEGER)::BIGINT AS repeats, sum((coalesce(first, false) AND coalesce(extracted_text, '') = '')::INTEGER)::BIGINT AS todo,
  ceil(sum((coalesce(first, false) AND coalesce(extracted_text, '') = '')::INTEGER) / 5.0)::BIGINT AS batches FROM f GROUP BY post_id""")
def agg_visual_plan(spark: SparkSession, d: str) -> DataFrame:
    """What is still to be read of each post, each content once, in batches of five."""
    m = _m(spark, d).filter("post_id is not null").select("media_no", "post_id", "media_type", "sha256", (F.coalesce("extracted_text", F.lit("")) == "").alias("unread"))
    firsts = first_seen(m, "sha256", "media_no").withColumn("first", F.lit(True))
    m = m.join(firsts, "media_no", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = m.groupBy("post_id").agg(F.count("*").alias("assets"), some(F.col("media_type") == "image").alias("images"), some(~F.col("first")).alias("repeats"), some(F.col("first") & F.col("unread")).alias("todo"))
    return out.withColumn("batches", F.ceil(F.col("todo") / 5).cast("long"))


@R.query(f"""
SELECT m.post_id, count(*) AS assets, count(DISTINCT m.sha256) AS contents, sum((q.quality = 'readable')::INTEGER)::BIGINT AS readable, sum((q.quality = 'empty')::INTEGER)::BIGINT AS unread
FROM media_items m JOIN ({_QUALITY}) q USING (media_no) GROUP BY m.post_id""")
def agg_visual_coverage(spark: SparkSession, d: str) -> DataFrame:
    m = _m(spark, d).select("post_id", "sha256", T.ocr_quality(F.col("extracted_text")).alias("quality"))
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return m.groupBy("post_id").agg(F.count("*").alias("assets"), F.countDistinct("sha256").alias("contents"), some(F.col("quality") == "readable").alias("readable"), some(F.col("quality") == "empty").alias("unread"))


@R.query("""
WITH o AS (SELECT post_id, max(row_no) AS row_no FROM (SELECT id AS post_id, row_no FROM posts) GROUP BY 1),
     f AS (SELECT post_id, arg_min(media_no, coalesce(seq_no, 0)::BIGINT * 100000000 + media_no) AS media_no FROM media_items WHERE coalesce(extracted_text, '') <> '' GROUP BY 1)
SELECT o.row_no, f.media_no FROM o JOIN f USING (post_id)""")
def join_first_match(spark: SparkSession, d: str) -> DataFrame:
    """The first item with text of every post, for the post's latest row."""
    o = table(spark, d, "posts").groupBy(F.col("id").alias("post_id")).agg(F.max("row_no").alias("row_no"))
    f = _m(spark, d).filter("coalesce(extracted_text, '') <> ''").groupBy("post_id").agg(F.min(F.struct(F.coalesce("seq_no", F.lit(0)).alias("s"), "media_no")).alias("f"))
    return o.join(f, "post_id").select("row_no", F.col("f.media_no").alias("media_no"))


@R.query("SELECT question_no FROM questions q WHERE EXISTS (SELECT 1 FROM media_items m WHERE m.post_id = q.post_id AND m.ocr_quality = 'readable')")
def join_any_match(spark: SparkSession, d: str) -> DataFrame:
    """Questions of posts with any readable item."""
    keys = _m(spark, d).filter("ocr_quality = 'readable'").select("post_id").distinct()
    return table(spark, d, "questions").join(keys, "post_id", "left_semi").select("question_no")


@R.query("SELECT id FROM (SELECT DISTINCT id FROM posts) p WHERE NOT EXISTS (SELECT 1 FROM media_items m WHERE m.post_id = p.id)")
def join_missing_capture(spark: SparkSession, d: str) -> DataFrame:
    """Posts without any item."""
    return table(spark, d, "posts").select("id").distinct().join(_m(spark, d).select(F.col("post_id").alias("id")).distinct(), "id", "left_anti")


@R.query("SELECT media_no FROM media_items m WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.id = m.post_id)")
def join_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Items without a post."""
    return _m(spark, d).join(table(spark, d, "posts").select(F.col("id").alias("post_id")).distinct(), "post_id", "left_anti").select("media_no")


@R.query("""
WITH b AS (SELECT post_id, seq_no, media_no, trim(regexp_replace(extracted_text, '\\s+', ' ', 'g')) AS t FROM media_items WHERE trim(coalesce(extracted_text, '')) <> '' AND media_type = 'image')
SELECT media_no, post_id, (seq_no + 1)::BIGINT AS slide, substr(t, 1, 300) AS text FROM b WHERE t <> ''""")
def q_build_ocr_index(spark: SparkSession, d: str) -> DataFrame:
    """Search records of read images; the shown text is cut at 300 characters."""
    t = F.trim(F.regexp_replace("extracted_text", r"\s+", " "))
    return _m(spark, d).filter("media_type = 'image'").select("media_no", "post_id", (F.col("seq_no") + 1).cast("long").alias("slide"), t.alias("t")).filter("t <> ''").select("media_no", "post_id", "slide", F.substring("t", 1, 300).alias("text"))


@R.query("SELECT media_no FROM media_items WHERE contains(lower(extracted_text), 'lookup') AND contains(lower(extracted_text), 'kafka') ORDER BY media_no LIMIT 40")
def q_search_ocr(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 items that hold all typed words."""
    low = F.lower("extracted_text")
    return _m(spark, d).filter(F.contains(low, F.lit("lookup")) & F.contains(low, F.lit("kafka"))).select("media_no").orderBy("media_no").limit(40)


@R.query("SELECT media_no FROM media_items WHERE extraction_method IS NOT NULL AND trim(regexp_replace(extracted_text, '\\s+', ' ', 'g')) <> ''")
def flt_quality_media(spark: SparkSession, d: str) -> DataFrame:
    return _m(spark, d).filter(F.col("extraction_method").isNotNull() & (F.trim(F.regexp_replace("extracted_text", r"\s+", " ")) != "")).select("media_no")


@R.query(f"""
WITH r AS (SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY seq_no, media_path, media_no) AS r, chr(0) || seq_no || ':' || media_type || ':' || sha256 AS t FROM media_items WHERE sha256 IS NOT NULL AND seq_no IS NOT NULL AND media_type <> 'other'),
c AS (SELECT post_id, (r - 1) // {CHUNK} AS k, sha256(string_agg(t, '' ORDER BY r)) AS d, count(*) AS n FROM r GROUP BY 1, 2)
SELECT post_id, sha256(string_agg(d, '' ORDER BY k)) AS digest, sum(n)::BIGINT AS members FROM c GROUP BY 1""")
def dig_assets(spark: SparkSession, d: str) -> DataFrame:
    """One digest of a post's items in their order, without those that play no part."""
    m = _m(spark, d).filter("sha256 is not null and seq_no is not null and media_type <> 'other'")
    member = F.concat(F.lit("\x00"), F.col("seq_no").cast("string"), F.lit(":"), F.col("media_type"), F.lit(":"), F.col("sha256"))
    return list_digests(m, "post_id", ["seq_no", "media_path", "media_no"], member)


@R.query("""
WITH l AS (SELECT media_no, unnest(string_split(extracted_text, chr(10))) AS line, generate_subscripts(string_split(extracted_text, chr(10)), 1) - 1 AS pos FROM media_items WHERE extracted_text <> ''),
     h AS (SELECT media_no, pos, line, last_value(CASE WHEN regexp_matches(line, '^(Step|Lecture) [0-9]+:') THEN line END IGNORE NULLS) OVER (PARTITION BY media_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l)
SELECT heading, count(*) AS n_lines, count(DISTINCT media_no) AS n_items FROM h WHERE heading IS NOT NULL GROUP BY 1""")
def win_carry_heading(spark: SparkSession, d: str) -> DataFrame:
    """Lines under each heading, the last seen heading carried to the lines below it."""
    lines = _m(spark, d).filter("extracted_text <> ''").select("media_no", F.posexplode(F.split("extracted_text", "\n")).alias("pos", "line"))
    heading = F.last(F.when(F.col("line").rlike("^(Step|Lecture) [0-9]+:"), F.col("line")), ignorenulls=True).over(W.partitionBy("media_no").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.select("media_no", heading.alias("heading")).filter("heading is not null").groupBy("heading").agg(F.count("*").alias("n_lines"), F.countDistinct("media_no").alias("n_items"))


@R.query("""
WITH q AS (SELECT question_no, post_id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS n FROM questions),
     m AS (SELECT media_no, post_id, trim(regexp_replace(lower(extracted_text), '[^a-z0-9]+', ' ', 'g')) AS t FROM media_items WHERE extracted_text <> ''),
     c AS (SELECT q.question_no, count(m.media_no) AS hits, min(m.media_no) AS media_no FROM q LEFT JOIN m ON m.post_id = q.post_id AND contains(m.t, q.n) WHERE q.n <> '' GROUP BY 1)
SELECT question_no, CASE hits WHEN 0 THEN 'none' WHEN 1 THEN 'attached' ELSE 'ambiguous' END AS outcome, CASE WHEN hits = 1 THEN media_no END AS media_no FROM c""")
def join_containment(spark: SparkSession, d: str) -> DataFrame:
    """Questions attached to the one item of their post that holds them; none and several stay unattached.

    A question's longest inner word stands whole in any text that holds the question, so it is the join key within the post: words
    of texts are joined without the texts, and only what shares that word is tested. Questions of one or two words, which have
    no inner word, are tested against the texts of their post.
    """
    words = lambda c: F.array_distinct(F.split(c, " "))
    inner = F.split("n", " ")
    inner = F.when(F.size(inner) > 2, F.slice(inner, F.lit(2), F.size(inner) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = table(spark, d, "questions").select("question_no", "post_id", T.normalise_label(F.col("question")).alias("n")).filter("n <> ''").withColumn("w", longest)
    m = _m(spark, d).filter("extracted_text <> ''").select("media_no", "post_id", T.normalise_label(F.col("extracted_text")).alias("t"))
    met = m.select("media_no", "post_id", F.explode(words(F.col("t"))).alias("w")).join(q.filter("w is not null"), ["post_id", "w"]).select("media_no", "question_no", "n")
    met = met.unionByName(m.select("media_no", "post_id").join(q.filter("w is null").select("question_no", "post_id", "n"), "post_id").select("media_no", "question_no", "n"))
    hits = met.join(m.select("media_no", "t"), "media_no").filter(F.contains("t", F.col("n"))).groupBy("question_no").agg(F.count("*").alias("hits"), F.min("media_no").alias("one"))
    out = q.select("question_no").join(hits, "question_no", "left")
    return out.select("question_no", F.when(F.col("hits").isNull(), "none").when(F.col("hits") == 1, "attached").otherwise("ambiguous").alias("outcome"), F.when(F.col("hits") == 1, F.col("one")).alias("media_no"))


QUERIES, ORACLE = R.queries, R.oracle

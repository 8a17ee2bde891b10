"""Queries over file inventories, archives and their cross-checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.operators import inventory as I
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()

# what the package claims of every item, and what the archive knows of every file that was read
_RECORDS = """
SELECT media_no, post_id, regexp_extract(media_path, '([^/]*)$', 1) AS name, sha256, size_bytes, width, height, right(post_id, 8) AS activity, regexp_extract(media_path, '^media/([0-9a-f]{8})_', 1) AS derived, ocr_status, extracted_text, media_type, seq_no,
  CASE WHEN media_no <> first_value(media_no) OVER (PARTITION BY sha256 ORDER BY media_no) AND sha256 IS NOT NULL THEN first_value(regexp_extract(media_path, '([^/]*)$', 1)) OVER (PARTITION BY sha256 ORDER BY media_no) END AS duplicate_of,
  CASE WHEN width < 600 THEN regexp_replace(regexp_extract(media_path, '([^/]*)$', 1), '_slide_[0-9]+', '_slide_1') END AS preview_of FROM media_items"""
_ARCHIVE = "SELECT regexp_extract(media_path, '([^/]*)$', 1) AS name, max(sha256) AS sha256, max(size_bytes) AS size_bytes, max(width) AS width, max(height) AS height FROM media_items WHERE extraction_method IS NOT NULL AND media_path IS NOT NULL GROUP BY 1"
_CHECKED = f"""
WITH r AS ({_RECORDS}), a AS ({_ARCHIVE}), p AS (SELECT DISTINCT right(id, 8) AS activity FROM posts),
c AS (SELECT r.*, a.name IS NULL AS gone, concat_ws('; ',
  CASE WHEN r.sha256 <> '' AND r.sha256 <> a.sha256 THEN 'digest' END, CASE WHEN r.size_bytes <> 0 AND a.size_bytes <> 0 AND r.size_bytes <> a.size_bytes THEN 'size' END,
  CASE WHEN r.width <> 0 AND a.width <> 0 AND r.height <> 0 AND a.height <> 0 AND (r.width <> a.width OR r.height <> a.height) THEN 'dimensions' END, CASE WHEN r.activity <> '' AND r.derived <> '' AND r.activity <> r.derived THEN 'activity' END,
  CASE WHEN r.derived <> '' AND r.derived NOT IN (SELECT activity FROM p WHERE activity IS NOT NULL) THEN 'no post' END, CASE WHEN r.duplicate_of <> '' AND r.duplicate_of NOT IN (SELECT name FROM a) THEN 'duplicate target' END, CASE WHEN r.preview_of <> '' AND r.preview_of NOT IN (SELECT name FROM a) THEN 'preview target' END) AS problems
  FROM r LEFT JOIN a ON a.name = r.name)
SELECT *, CASE WHEN gone THEN 'missing' WHEN problems <> '' THEN 'conflicting' ELSE 'matched' END AS verdict, CASE WHEN gone THEN '' ELSE problems END AS note FROM c"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_items").withColumn("name", I.base_name(F.col("media_path")))
    keeper = I.first_of(m, "sha256", ["media_no"], ["media_no", "name"]).select("sha256", F.col("media_no").alias("k_no"), F.col("name").alias("k_name"))
    m = m.join(keeper, "sha256", "left")
    return m.select(
        "media_no", "post_id", "name", "sha256", "size_bytes", "width", "height", F.expr("right(post_id, 8)").alias("activity"), F.regexp_extract("media_path", "^media/([0-9a-f]{8})_", 1).alias("derived"), "ocr_status", "extracted_text", "media_type", "seq_no",
        F.when(F.col("media_no") != F.col("k_no"), F.col("k_name")).alias("duplicate_of"), F.when(F.col("width") < 600, F.regexp_replace("name", "_slide_[0-9]+", "_slide_1")).alias("preview_of"),
    )


def _archive(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "media_items").filter("extraction_method is not null and media_path is not null").withColumn("name", I.base_name(F.col("media_path")))
    return m.groupBy("name").agg(*[F.max(c).alias(c) for c in ("sha256", "size_bytes", "width", "height")])


def _activities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts").select(F.expr("right(id, 8)").alias("activity")).distinct()


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return I.cross_check(_records(spark, d), _archive(spark, d), _activities(spark, d))


@R.query(f"SELECT media_no, verdict, note FROM ({_CHECKED})")
def join_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Every item against the archive of files that were read: verdict and every difference."""
    return _checked(spark, d).select("media_no", "verdict", "note")


@R.query(f"SELECT verdict, n FROM (SELECT verdict, count(*) AS n FROM ({_CHECKED}) GROUP BY 1)")
def agg_crosscheck_counts(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@R.query("""
SELECT DISTINCT regexp_extract(media_path, '([^/]*)$', 1) AS name FROM media_items WHERE regexp_extract(media_path, '([^/]*)$', 1) NOT IN (SELECT regexp_extract(media_path, '([^/]*)$', 1) FROM media_items WHERE extraction_method IS NOT NULL AND media_path IS NOT NULL) ORDER BY name LIMIT 200""")
def join_anti_absent(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 files that were never read."""
    return I.absent(_records(spark, d).select("name"), _archive(spark, d))


@R.query("""
SELECT DISTINCT regexp_extract(media_path, '([^/]*)$', 1) AS name FROM media_items WHERE media_path IS NOT NULL AND regexp_extract(media_path, '([^/]*)$', 1) NOT IN (SELECT regexp_extract(media_path, '([^/]*)$', 1) FROM media_items WHERE media_type IN ('image', 'pdf') AND media_path IS NOT NULL)""")
def join_anti_unreferenced(spark: SparkSession, d: str) -> DataFrame:
    """Files that no image or document refers to."""
    m = table(spark, d, "media_items").filter("media_path is not null").select(I.base_name(F.col("media_path")).alias("name"), "media_type")
    return I.unreferenced(m, m.filter("media_type in ('image', 'pdf')"))


_SAID = "The text of this slide was read by machine."


@R.query(f"""
WITH r AS ({_RECORDS}), t AS (SELECT name, max(CASE WHEN seq_no = 1 THEN 'Note.  THE text of this slide was read by machine. ' ELSE coalesce(extracted_text, '') END) AS t FROM r WHERE coalesce(extracted_text, '') <> '' OR seq_no = 1 GROUP BY 1),
j AS (SELECT media_no, ocr_status, t, trim(regexp_replace(coalesce(t, ''), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS f FROM r LEFT JOIN t USING (name))
SELECT media_no, CASE WHEN t IS NULL AND ocr_status = 'AVAILABLE' THEN 'UNRESOLVED' WHEN t IS NOT NULL AND ocr_status = 'AVAILABLE' AND (f = '' OR contains(lower(f), lower('{_SAID}'))) THEN 'NO_TEXT' ELSE coalesce(ocr_status, 'ABSENT') END AS status,
  md5(CASE WHEN t IS NOT NULL AND NOT coalesce(ocr_status = 'AVAILABLE' AND (f = '' OR contains(lower(f), lower('{_SAID}'))), false) THEN t END) AS digest FROM j""")
def join_transcription(spark: SparkSession, d: str) -> DataFrame:
    """Every item's transcription by its name, with the status that follows; second slides hold nothing but a statement."""
    r = _records(spark, d)
    said = F.lit("Note.  THE text of this slide was read by machine. ")
    t = r.filter("coalesce(extracted_text, '') <> '' or seq_no = 1").select("name", F.when(F.col("seq_no") == 1, said).otherwise(F.coalesce("extracted_text", F.lit(""))).alias("transcription"))
    return I.attach_transcriptions(r.select("media_no", "name", "ocr_status"), t, [_SAID]).select("media_no", "status", F.md5("text").alias("digest"))


@R.query(f"SELECT media_no, trim(regexp_replace(coalesce(extracted_text, ''), '[\\s\\x{{00A0}}]+', ' ', 'g')) = '' OR contains(lower(trim(regexp_replace(coalesce(extracted_text, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))), 'nobody warned me') AS boilerplate FROM media_items")
def flt_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Items whose text is empty or holds a constant statement."""
    return table(spark, d, "media_items").select("media_no", I.is_boilerplate(F.col("extracted_text"), ["Nobody  warned me"]).alias("boilerplate"))


@R.query(f"""
WITH c AS ({_CHECKED}), g AS (SELECT post_id AS group_id, max(seq_no) - min(seq_no) + 1 AS declared FROM media_items WHERE post_id IS NOT NULL GROUP BY 1),
m AS (SELECT post_id AS group_id, count(*) AS members, min(derived) AS activity, max((verdict = 'missing')::INTEGER) AS lacks FROM c GROUP BY 1)
SELECT g.group_id, m.members, CASE WHEN m.activity NOT IN (SELECT right(id, 8) FROM posts) THEN 'missing' WHEN g.declared <> 0 AND g.declared <> m.members THEN 'conflicting' WHEN m.lacks = 1 THEN 'missing' ELSE 'matched' END AS verdict FROM g JOIN m USING (group_id)""")
def agg_groups(spark: SparkSession, d: str) -> DataFrame:
    """The items of each post: declared against found members, a missing activity, a missing member."""
    c = _checked(spark, d).filter("post_id is not null").select(F.col("post_id").alias("group_id"), F.col("derived").alias("activity"), "verdict")
    g = table(spark, d, "media_items").filter("post_id is not null").groupBy(F.col("post_id").alias("group_id")).agg((F.max("seq_no") - F.min("seq_no") + 1).alias("declared"), F.lit(None).cast("string").alias("activity"))
    return I.group_verdicts(g, c, _activities(spark, d))


@R.query(f"""
WITH r AS ({_RECORDS}) SELECT media_no, CASE WHEN EXISTS (SELECT 1 FROM r o WHERE o.post_id = r.post_id AND o.name = r.preview_of) THEN 'thumbnail' WHEN coalesce(duplicate_of, '') <> '' THEN 'slide' WHEN regexp_matches(name, '_slide_[0-9]+(\\.[^.]*)?$') THEN 'slide' ELSE 'image' END AS role FROM r""")
def file_role_claimed(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("media_no", F.col("post_id").alias("group_id"), "name", "preview_of", "duplicate_of")
    return I.claimed_roles(r).select("media_no", "role")


# every post refers to its items by path, a repeated row repeats its reference; some files are unreadable or named wrongly
_REFS = "SELECT post_id AS record, (row_number() OVER (PARTITION BY post_id ORDER BY media_no))::BIGINT AS pos, CASE WHEN media_type = 'image' THEN regexp_extract(media_path, '([^/]*)$', 1) ELSE media_path END AS written FROM media_items WHERE post_id IS NOT NULL AND media_path IS NOT NULL"
_INDEX = "SELECT regexp_extract(media_path, '([^/]*)$', 1) AS name, min(ocr_status IS DISTINCT FROM 'ABSENT') AS readable, min(ocr_status IS DISTINCT FROM 'UNRESOLVED') AS agrees FROM media_items WHERE media_path IS NOT NULL AND sha256 IS NOT NULL AND media_type <> 'video' GROUP BY 1"


def _media_of_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "media_items").filter("post_id is not null and media_path is not null")
    refs = m.select(F.col("post_id").alias("record"), F.col("media_no").alias("pos"), F.when(F.col("media_type") == "image", I.base_name(F.col("media_path"))).otherwise(F.col("media_path")).alias("name"))
    index = table(spark, d, "media_items").filter("media_path is not null and sha256 is not null and media_type <> 'video'").groupBy(I.base_name(F.col("media_path")).alias("name"))
    index = index.agg(F.min(~F.col("ocr_status").eqNullSafe("ABSENT")).alias("readable"), F.min(~F.col("ocr_status").eqNullSafe("UNRESOLVED")).alias("agrees"))
    return I.archive_media(refs, index)


_NOTES = f"""
WITH r AS ({_REFS}), f AS (SELECT *, regexp_extract(written, '([^/]*)$', 1) AS name, pos <> min(pos) OVER (PARTITION BY record, written) AS rep FROM r), j AS (SELECT f.*, i.name IS NOT NULL AS there, i.readable, i.agrees FROM f LEFT JOIN ({_INDEX}) i USING (name)),
n AS (SELECT record, 'included a path' AS note FROM j WHERE name <> written UNION ALL SELECT record, 'listed more than once' FROM j WHERE rep UNION ALL SELECT record, 'not in the media folder' FROM j WHERE NOT rep AND NOT there
  UNION ALL SELECT record, 'could not be read' FROM j WHERE there AND NOT rep AND NOT readable UNION ALL SELECT record, 'named for a different type' FROM j WHERE there AND NOT rep AND readable AND NOT agrees)"""


@R.query(f"{_NOTES} SELECT record, note, count(*) AS n FROM n GROUP BY 1, 2")
def join_archive_media(spark: SparkSession, d: str) -> DataFrame:
    """What isn't right with the files that each post refers to."""
    return _media_of_records(spark, d)[1].groupBy("record", "note").agg(F.count("*").alias("n"))


@R.query(f"""{_NOTES} , u AS (SELECT record, count(*) AS usable FROM j WHERE there AND NOT rep GROUP BY 1), c AS (SELECT record, count(*) AS k FROM r GROUP BY 1)
SELECT record, coalesce(usable, 0) AS usable, concat_ws('; ', CASE WHEN k > 1 AND coalesce(usable, 0) < 2 THEN 'multi-slide but supplied' END, CASE WHEN k <> coalesce(usable, 0) THEN 'counted and usable differ' END) AS note FROM c LEFT JOIN u USING (record)""")
def join_record_notes(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose claims about their media don't hold."""
    c = table(spark, d, "media_items").filter("post_id is not null and media_path is not null").groupBy(F.col("post_id").alias("record")).agg((F.count("*") > 1).alias("claimed_multi"), F.count("*").alias("claimed_count"))
    return I.record_notes(c, _media_of_records(spark, d)[0])


_CAUSE = "CASE WHEN coalesce(note, '') = '' THEN '(no detail)' " + " ".join("WHEN " + " AND ".join(f"contains(lower(note), '{p}')" for p in ps.split("+")) + f" THEN '{c}'" for ps, c in I.NOTE_CAUSES) + " ELSE substr(note, 1, 80) END"


@R.query(f"{_NOTES}, a AS (SELECT note FROM n UNION ALL SELECT error_message FROM run_state) SELECT cause, count(*) AS n FROM (SELECT {_CAUSE} AS cause FROM a) GROUP BY 1")
def agg_note_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Notes of files and runs counted by their causes; a note of no known cause by its first 80 characters."""
    notes = _media_of_records(spark, d)[1].select("note").unionByName(table(spark, d, "run_state").select(F.col("error_message").alias("note")))
    return notes.groupBy(I.note_cause(F.col("note")).alias("cause")).agg(F.count("*").alias("n"))


_OWN = "SELECT post_id, regexp_extract(media_path, '([^/]*)$', 1) AS name, max(extracted_text) AS text, max(extraction_method) AS method FROM media_items WHERE media_type IN ('image', 'pdf') AND post_id IS NOT NULL AND media_path IS NOT NULL GROUP BY 1, 2"
_READ = "SELECT post_id, regexp_extract(media_path, '([^/]*)$', 1) AS name, max('read: ' || extracted_text) AS text, 'package' AS method, min(ocr_status IN ('UNRESOLVED', 'PARTIAL')) AS failed FROM media_items WHERE ocr_status IS NOT NULL AND post_id IS NOT NULL AND media_path IS NOT NULL GROUP BY 1, 2"


def _injected(spark: SparkSession, d: str, add: bool) -> tuple[DataFrame, DataFrame]:
    m = table(spark, d, "media_items").filter("post_id is not null and media_path is not null").withColumn("name", I.base_name(F.col("media_path")))
    own = m.filter("media_type in ('image', 'pdf')").groupBy("post_id", "name").agg(F.max("extracted_text").alias("text"), F.max("extraction_method").alias("method"))
    read = m.filter("ocr_status is not null").groupBy("post_id", "name").agg(F.max(F.concat(F.lit("read: "), F.col("extracted_text"))).alias("text"), F.lit("package").alias("method"), F.min(F.col("ocr_status").isin("UNRESOLVED", "PARTIAL")).alias("failed"))
    return I.inject_media(own, read, add)


def _inject_sql(join: str) -> str:
    return f"""
SELECT post_id, name, md5(CASE WHEN a.name IS NOT NULL AND NOT a.failed THEN nullif(a.text, '') ELSE m.text END) AS digest, CASE WHEN a.name IS NOT NULL AND a.failed THEN NULL WHEN a.name IS NOT NULL THEN a.method ELSE m.method END AS method,
  CASE WHEN a.name IS NULL THEN 'kept' WHEN m.name IS NULL THEN 'added' WHEN a.failed THEN 'failed' ELSE 'read' END AS origin FROM ({_OWN}) m {join} JOIN ({_READ}) a USING (post_id, name)"""


@R.query(_inject_sql("FULL OUTER"))
def join_inject_media(spark: SparkSession, d: str) -> DataFrame:
    """What was read of the files put into the media of posts, with files that a post doesn't have added."""
    return _injected(spark, d, True)[0].select("post_id", "name", F.md5("text").alias("digest"), "method", "origin")


@R.query(_inject_sql("LEFT"))
def join_inject_known_media(spark: SparkSession, d: str) -> DataFrame:
    """The same without adding any."""
    return _injected(spark, d, False)[0].select("post_id", "name", F.md5("text").alias("digest"), "method", "origin")


@R.query(f"SELECT post_id, count(*) AS unmatched FROM ({_READ}) a WHERE NOT EXISTS (SELECT 1 FROM ({_OWN}) m WHERE m.post_id = a.post_id AND m.name = a.name) GROUP BY 1")
def join_inject_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many read files of each post it doesn't have."""
    return _injected(spark, d, False)[1]


QUERIES, ORACLE = R.queries, R.oracle

"""Queries over captured posts and documents: text, addresses, identity, merging, search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.functions import urls as U
from siltline.functions.digests import CHUNK, list_digests, record_digest
from siltline.functions.secrets import holds_secret, redact_secrets
from siltline.operators.dedupe import keepers
from siltline.operators.knowledge import small
from siltline.operators.merging import merge_lists, reusable
from siltline.operators.ranking import ranked
from siltline.plans._registry import Registry
from siltline.session import table

R = Registry()
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TRACK = "(" + ", ".join(f"'{t}'" for t in U.TRACKING) + ")"
_CANON = f"""CASE WHEN regexp_matches(trim(u), '^[Hh][Tt][Tt][Pp][Ss]?://[^/?#]') THEN
  lower(regexp_extract(u, '^\\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(u), '#.*$', ''), '^[^:]+://([^/?]*)', 1), '^.*@', ''), ':[0-9]*$', ''))
  || regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(u), '#.*$', ''), '^[^:]+://[^/?]*([^?]*)', 1), '/{{2,}}', '/', 'g'), '/+$', '')
  || (SELECT CASE WHEN q = '' THEN '' ELSE '?' || q END FROM (SELECT array_to_string(list_sort(list_filter(string_split(regexp_extract(regexp_replace(trim(u), '#.*$', ''), '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN {_TRACK})), '&') AS q)) END"""
_URLS = f"SELECT row_no, {_CANON} AS canonical FROM (SELECT row_no, source.url AS u FROM posts)"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@R.query(_URLS)
def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", U.canonical_url(F.col("source.url")).alias("canonical"))


@R.query(f"""
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN canonical IS NULL THEN 'none' WHEN f IN ('p', 'post', 'posts') THEN 'post' WHEN f IN ('pulse', 'articles', 'article') THEN 'article' WHEN f = '' THEN 'site' ELSE 'other' END AS kind
FROM (SELECT canonical, regexp_extract(canonical, '^[^:]+://[^/?]*/([^/?]*)', 1) AS f FROM ({_URLS}))) GROUP BY kind""")
def url_kind(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select(U.url_kind(F.col("source.url")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@R.query(f"SELECT row_no, 'urn:saved:' || substr(sha256(canonical), 1, 16) AS source_id FROM ({_URLS})")
def url_source_id(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", U.source_id(F.col("source.url")).alias("source_id"))


@R.query(f"SELECT row_no FROM (SELECT row_no, canonical, min(row_no) OVER (PARTITION BY canonical) AS f FROM ({_URLS}) WHERE canonical IS NOT NULL) WHERE row_no <> f")
def win_seen_in_list(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose address an earlier post has."""
    u = _posts(spark, d).select("row_no", U.canonical_url(F.col("source.url")).alias("c")).filter("c is not null")
    return u.join(u.groupBy("c").agg(F.min("row_no").alias("f")), "c").filter("row_no <> f").select("row_no")


@R.query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS fingerprint FROM documents")
def id_content_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@R.query(f"""
WITH f AS (SELECT doc_id, length(text) AS n, (post_id IS NOT NULL)::INTEGER AS p, {_NORM.format('text')} AS k FROM documents WHERE {_NORM.format('text')} <> '')
SELECT doc_id, keeper AS duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY p DESC, n DESC, doc_id) AS keeper FROM f) WHERE doc_id <> keeper""")
def agg_content_dupes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the normalised text of a better one: with a post, longer, earlier."""
    digest = F.when(T.normalise_label(F.col("text")) != "", T.fingerprint(F.col("text")))
    return keepers(_docs(spark, d), digest, "doc_id", [F.col("post_id").isNotNull(), F.length("text")])


@R.query(f"SELECT row_no, {_NORM.format('original_text')} AS key FROM posts")
def str_normalise_label(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", T.normalise_label(F.col("original_text")).alias("key"))


@R.query("""
SELECT term_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT term_id, regexp_replace(regexp_replace(lower(term), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM reference_terms)""")
def str_taxonomy_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reference_terms").select("term_id", T.dashed(F.col("term"), "untitled").alias("slug"))


def _forms(ascii_only: bool) -> str:
    """A map of characters to their forms, built by rule for the SQL, which has no decomposition by compatibility."""
    out = {}
    for code in [*range(128, 0x3000), *range(0xFB00, 0xFB07), *range(0xFE50, 0xFE70), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        c, k = chr(code), unicodedata.normalize("NFKD", chr(code))
        form = k.encode("ascii", "ignore").decode() if ascii_only else "".join(x for x in k if not unicodedata.combining(x))
        if form != c and (form or not ascii_only):
            out[c] = form
    quoted = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    return f"MAP({quoted(out)}, {quoted(out.values())})"


def _mapped(text: str, ascii_only: bool) -> str:
    other = "''" if ascii_only else "ch"
    return f"array_to_string(list_transform(string_split({text}, ''), lambda ch: CASE WHEN ch = '' OR unicode(ch) < 128 THEN ch ELSE coalesce(m[ch], {other}) END), '')"


@R.query(f"""
WITH f AS (SELECT {_forms(True)} AS m)
SELECT row_no, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT row_no, regexp_replace(substr(regexp_replace(regexp_replace(lower({_mapped('original_text', True)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS s FROM posts, f)""")
def str_slug(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", T.slug(F.col("original_text")).alias("slug"))


@R.query(f"""
WITH f AS (SELECT {_forms(True)} AS m)
SELECT row_no, CASE WHEN coalesce(s, '') = '' THEN 'post' ELSE s END AS safe FROM (SELECT row_no, regexp_replace(substr(regexp_replace(regexp_replace({_mapped('original_text', True)}, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '') AS s FROM posts, f)""")
def str_safe_id(spark: SparkSession, d: str) -> DataFrame:
    """A file name made of each post's text."""
    return _posts(spark, d).select("row_no", T.safe_id(F.col("original_text")).alias("safe"))


@R.query("SELECT row_no, nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', ''), '') AS post_id FROM posts")
def str_post_id(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", F.nullif(T.dashed(F.col("id"), "", 80), F.lit("")).alias("post_id"))


@R.query(f"WITH f AS (SELECT {_forms(False)} AS m) SELECT doc_id, md5(trim(regexp_replace({_mapped('lower(text)', False)}, '[^a-z0-9]+', ' ', 'g'))) AS folded FROM documents, f")
def str_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@R.query("SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS digest FROM documents")
def str_collapse(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.collapse(F.col("text"))).alias("digest"))


@R.query("""
WITH t AS (SELECT row_no, trim(regexp_replace(original_text, '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM posts),
     h AS (SELECT row_no, t, substr(t, 1, 120) AS head, regexp_replace(substr(t, 1, 120), '\\s+\\S*$', '') AS word FROM t)
SELECT row_no, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(CASE WHEN length(word) > 60 THEN word ELSE head END, '[ ,.;:-]+$', '') || '…' END AS short FROM h""")
def str_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", T.truncate(F.col("original_text"), 120).alias("short"))


@R.query("SELECT row_no, upper(substr(t, 1, 1)) || substr(t, 2) AS tidy FROM (SELECT row_no, trim(regexp_replace(ai_analysis.summary, '[\\s\\x{00A0}]+', ' ', 'g')) AS t FROM posts)")
def str_tidy(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("row_no", T.tidy(F.col("ai_analysis.summary")).alias("tidy"))


# a line of a known form before each text: what stands in it, and what must come out
_PLANTED = [
    ("'login with ghp_' || substr(md5(id), 1, 24) || ' today'", "'login with [REDACTED] today'"), ("'API_KEY = \"' || substr(md5(id), 1, 12) || '\"; next'", "'API_KEY = [REDACTED]; next'"), ("'Authorization: Bearer ' || substr(md5(id), 1, 20) || ' sent'", "'Authorization: [REDACTED] sent'"),
    ("'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || md5(id) || chr(10) || '-----END RSA PRIVATE KEY----- end'", "'[REDACTED] end'"), ("'the token was lost, writer: ' || id", "'the token was lost, writer: ' || id"), ("'key AKIA' || upper(substr(md5(id), 1, 16)) || '.'", "'key [REDACTED].'"),
]
_planted = lambda k: "CASE row_no % 6 " + " ".join(f"WHEN {n} THEN {x[k]}" for n, x in enumerate(_PLANTED)) + " END"


@R.query(f"SELECT row_no, {_planted(1)} || chr(10) || md5(coalesce(original_text, '')) AS redacted FROM posts")
def str_redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """A line with a credential of a known form before a digest of every post's text, redacted."""
    line = F.concat(F.expr(_planted(0)), F.lit("\n"), F.md5(F.coalesce("original_text", F.lit(""))))
    return _posts(spark, d).select("row_no", redact_secrets(line).alias("redacted"))


@R.query("SELECT row_no, false AS found, md5(original_text) AS digest FROM posts WHERE original_text IS NOT NULL")
def str_contains_credential(spark: SparkSession, d: str) -> DataFrame:
    """Whether a post's text holds a credential (none of the test texts does), with a digest of the redacted text."""
    t = _posts(spark, d).filter("original_text is not null").select("row_no", "original_text")
    return t.select("row_no", holds_secret(F.col("original_text")).alias("found"), F.md5(redact_secrets(F.col("original_text"))).alias("digest"))


@R.query("""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x{00A0}]+', ' ', 'g'), ' ?\\n ?', E'\\n', 'g'), '\\n{3,}', E'\\n\\n', 'g') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS digest FROM t""")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("digest"))


@R.query("""
SELECT row_no, ingested_at, row_number() OVER (ORDER BY ingested_at DESC, lower(id) DESC, row_no) AS rank FROM posts QUALIFY rank <= 12""")
def topk_recent(spark: SparkSession, d: str) -> DataFrame:
    """The twelve posts ingested last."""
    top = _posts(spark, d).select("row_no", "ingested_at", F.lower("id").alias("i")).orderBy(F.desc("ingested_at"), F.desc("i"), "row_no").limit(12)
    return top.select("row_no", "ingested_at", F.row_number().over(W.orderBy(F.desc("ingested_at"), F.desc("i"), "row_no")).cast("long").alias("rank"))


@R.query("SELECT row_no FROM posts WHERE coalesce(CAST(ingested_at AS DATE) >= DATE '2024-01-01', true) AND coalesce(CAST(ingested_at AS DATE) <= DATE '2024-12-31', true)")
def flt_window(spark: SparkSession, d: str) -> DataFrame:
    """Posts ingested between two days, both included; a missing date keeps its row."""
    day = F.to_date("ingested_at")
    return _posts(spark, d).filter(F.coalesce(day >= F.lit("2024-01-01").cast("date"), F.lit(True)) & F.coalesce(day <= F.lit("2024-12-31").cast("date"), F.lit(True))).select("row_no")


@R.query("SELECT id, count(*) AS n FROM posts GROUP BY id HAVING count(*) > 1")
def val_unique_id(spark: SparkSession, d: str) -> DataFrame:
    """Ids that stand more than once."""
    return _posts(spark, d).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


_CHECKS = [
    ("error", "id", "coalesce(trim(id, ' '), '') = ''"), ("error", "text", "coalesce(trim(original_text, ' '), '') = ''"), ("error", "platform", "source.platform IS NULL OR source.platform NOT IN (SELECT platform FROM platforms)"), ("error", "ingested_at", "ingested_at IS NULL"),
    ("error", "url form", "source.url IS NOT NULL AND NOT regexp_matches(trim(source.url, ' '), '^https?://[^/?#]')"), ("error", "domain", "classification.domain IS NULL"), ("warning", "author", "source.author IS NULL"), ("warning", "url", "source.url IS NULL"), ("warning", "capture_method", "source.capture_method IS NULL"),
    ("warning", "summary", "coalesce(trim(ai_analysis.summary, ' '), '') = ''"), ("warning", "topics", "len(list_filter(coalesce(ai_analysis.topics, []::VARCHAR[]), lambda x: coalesce(trim(x, ' '), '') <> '')) = 0"), ("warning", "blank topic", "len(list_filter(coalesce(ai_analysis.topics, []::VARCHAR[]), lambda x: coalesce(trim(x, ' '), '') = '')) > 0"),
]


@R.query("SELECT level, field, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{lv}' AS level, '{f}' AS field FROM posts WHERE {c}" for lv, f, c in _CHECKS) + ") GROUP BY 1, 2")
def val_document(spark: SparkSession, d: str) -> DataFrame:
    """Problems of posts by level and field: identity, source, text, labels and classification, found in one scan."""
    known = table(spark, d, "platforms").select(F.col("platform").alias("p"), F.lit(True).alias("known")).distinct()
    p = _posts(spark, d).join(known, F.col("source.platform") == F.col("p"), "left")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    topics = F.coalesce(F.col("ai_analysis.topics"), F.array().cast("array<string>"))
    tests = [
        blank(F.col("id")), blank(F.col("original_text")), F.col("known").isNull(), F.col("ingested_at").isNull(), F.col("source.url").isNotNull() & ~F.trim("source.url").rlike("^https?://[^/?#]"), F.col("classification.domain").isNull(), F.col("source.author").isNull(), F.col("source.url").isNull(),
        F.col("source.capture_method").isNull(), blank(F.col("ai_analysis.summary")), F.size(F.filter(topics, lambda x: ~blank(x))) == 0, F.exists(topics, blank),
    ]
    issues = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(lv).alias("level"), F.lit(f).alias("field"))) for (lv, f, _), c in zip(_CHECKS, tests, strict=True)]))
    return p.select(F.explode(issues).alias("i")).groupBy("i.level", "i.field").agg(F.count("*").alias("n"))


_HALVES = f"WITH u AS (SELECT row_no, canonical, source.author AS author, ai_analysis.summary AS summary, coalesce(source.capture_method, '') = 'automated' AS auto FROM posts JOIN ({_URLS}) USING (row_no) WHERE canonical IS NOT NULL)"


@R.query(f"""{_HALVES},
s AS (SELECT canonical, min(nullif(trim(author, ' '), '')) AS author, min(nullif(trim(summary, ' '), '')) AS summary FROM u WHERE auto GROUP BY 1),
i AS (SELECT canonical, min(nullif(trim(author, ' '), '')) AS author, min(nullif(trim(summary, ' '), '')) AS summary FROM u WHERE NOT auto GROUP BY 1)
SELECT coalesce(s.canonical, i.canonical) AS canonical, coalesce(s.author, i.author) AS author, coalesce(s.summary, i.summary) AS summary,
  CASE WHEN s.canonical IS NULL THEN 'added' WHEN i.canonical IS NULL THEN 'stored' WHEN (s.author IS NULL AND i.author IS NOT NULL) OR (s.summary IS NULL AND i.summary IS NOT NULL) THEN 'updated' ELSE 'kept' END AS status
FROM s FULL OUTER JOIN i ON s.canonical = i.canonical""")
def set_list_merge(spark: SparkSession, d: str) -> DataFrame:
    """The addresses captured automatically merged with those captured otherwise: what one list lacks, the other fills."""
    u = _posts(spark, d).select((F.coalesce(F.col("source.capture_method"), F.lit("")) == "automated").alias("auto"), U.canonical_url(F.col("source.url")).alias("canonical"), F.col("source.author").alias("author"), F.col("ai_analysis.summary").alias("summary"))
    return merge_lists(u.filter("auto"), u.filter("not auto"), "canonical", ["author", "summary"])


_CLEAN_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t\\x{00A0}]+', ' ', 'g'), ' ?\\n ?', E'\\n', 'g'), '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g')"


@R.query("""
WITH l AS (SELECT id, arg_max(md5(original_text), row_no) AS digest, coalesce(arg_max(coalesce(source.capture_method, ''), row_no), '') AS version FROM posts WHERE original_text IS NOT NULL GROUP BY 1),
     f AS (SELECT id, arg_min(md5(original_text), row_no) AS digest, coalesce(arg_min(coalesce(source.capture_method, ''), row_no), '') AS version FROM posts WHERE original_text IS NOT NULL GROUP BY 1),
     s AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM run_state r WHERE r.post_id = f.id AND r.status = 'done'))
SELECT l.id, coalesce(l.digest = s.digest AND l.version = s.version, false) AS reuse FROM l LEFT JOIN s USING (id)""")
def inc_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose finished run still holds for the latest capture: same text, same way of capture."""
    p = _posts(spark, d).filter("original_text is not null").select("id", "row_no", F.md5("original_text").alias("digest"), F.coalesce(F.col("source.capture_method"), F.lit("")).alias("version"))
    pick = lambda f: p.groupBy("id").agg(f(F.struct("row_no", "digest", "version")).alias("m")).select("id", "m.digest", "m.version")
    done = table(spark, d, "run_state").filter("status = 'done'").select(F.col("post_id").alias("id")).distinct()
    return reusable(pick(F.max), pick(F.min).join(done, "id", "left_semi"), "id")


@R.query(f"""
WITH r AS (SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY media_path, media_no) AS r, chr(0) || media_path || chr(0) || coalesce(extracted_text, '') || chr(0) || coalesce(sha256, 'absent') AS t FROM media_items WHERE post_id IS NOT NULL),
c AS (SELECT post_id, (r - 1) // {CHUNK} AS k, sha256(string_agg(t, '' ORDER BY r)) AS d FROM r GROUP BY 1, 2), m AS (SELECT post_id, sha256(string_agg(d, '' ORDER BY k)) AS g FROM c GROUP BY 1)
SELECT row_no, sha256(trim(coalesce(original_text, ''), ' ') || coalesce(m.g, '')) AS digest FROM posts LEFT JOIN m ON m.post_id = posts.id""")
def dig_source(spark: SparkSession, d: str) -> DataFrame:
    """One digest of a post's text and its media (path, text, bytes), so that any change of either shows."""
    member = F.concat(F.lit("\x00"), F.col("media_path"), F.lit("\x00"), F.coalesce("extracted_text", F.lit("")), F.lit("\x00"), F.coalesce("sha256", F.lit("absent")))
    m = list_digests(table(spark, d, "media_items"), "post_id", ["media_path", "media_no"], member).select("post_id", F.col("digest").alias("g"))
    p = _posts(spark, d).select("row_no", "id", "original_text").join(m, F.col("id") == F.col("post_id"), "left")
    return p.select("row_no", F.sha2(F.concat(F.trim(F.coalesce("original_text", F.lit(""))), F.coalesce("g", F.lit(""))), 256).alias("digest"))


@R.query(f"""
WITH r AS (SELECT post_id, row_number() OVER (PARTITION BY post_id ORDER BY name, media_no) AS r, name AS t FROM (SELECT post_id, media_no, regexp_extract(media_path, '([^/]*)$', 1) AS name FROM media_items WHERE post_id IS NOT NULL)),
c AS (SELECT post_id, (r - 1) // {CHUNK} AS k, sha256(string_agg(t, '' ORDER BY r)) AS d FROM r GROUP BY 1, 2), m AS (SELECT post_id, sha256(string_agg(d, '' ORDER BY k)) AS g FROM c GROUP BY 1)
SELECT row_no, CASE WHEN coalesce(original_text, '') = '' AND m.g IS NULL THEN '' ELSE sha256(coalesce(original_text, '') || coalesce(m.g, '')) END AS digest FROM posts LEFT JOIN m ON m.post_id = posts.id""")
def dig_manual(spark: SparkSession, d: str) -> DataFrame:
    """One digest of a post's text and the names of its files; empty if it has neither."""
    m = table(spark, d, "media_items").select("post_id", "media_no", F.regexp_extract("media_path", "([^/]*)$", 1).alias("name"))
    g = list_digests(m, "post_id", ["name", "media_no"], F.col("name")).select("post_id", F.col("digest").alias("g"))
    p = _posts(spark, d).select("row_no", "id", F.coalesce("original_text", F.lit("")).alias("t")).join(g, F.col("id") == F.col("post_id"), "left")
    return p.select("row_no", F.when((F.col("t") == "") & F.col("g").isNull(), "").otherwise(F.sha2(F.concat("t", F.coalesce("g", F.lit(""))), 256)).alias("digest"))


@R.query("SELECT media_no, sha256(coalesce(post_id, '') || chr(31) || coalesce(media_path, '') || chr(31) || coalesce(seq_no::VARCHAR, '') || chr(31) || coalesce(sha256, '') || chr(31) || coalesce(ocr_status, '') || chr(31) || coalesce(extracted_text, '') || chr(31)) AS digest FROM media_items")
def dig_record(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what makes an item what it is."""
    return table(spark, d, "media_items").select("media_no", record_digest(*[F.col(c) for c in ("post_id", "media_path", "seq_no", "sha256", "ocr_status", "extracted_text")]).alias("digest"))


@R.query(f"SELECT row_no, coalesce('urn:saved:' || substr(sha256(canonical), 1, 16), 'urn:saved-archive:' || substr(sha256('urn:saved-archive::' || id), 1, 16)) AS identity FROM posts JOIN ({_URLS}) USING (row_no)")
def id_archive(spark: SparkSession, d: str) -> DataFrame:
    """The identity of every post: of its address, else of its own id."""
    return _posts(spark, d).select("row_no", T.archive_id(F.col("id"), F.col("source.url")).alias("identity"))


@R.query("""
SELECT question_no, CASE question_no % 5 WHEN 0 THEN question WHEN 1 THEN '{"q": "' || id || '"}' WHEN 2 THEN '{"q": "' || id || '"}' WHEN 3 THEN '["' || id || '"]' ELSE '{"q": 1}' END AS json FROM questions WHERE question_no % 5 <> 0""")
def json_llm_parse(spark: SparkSession, d: str) -> DataFrame:
    """What is JSON in replies that carry it bare, fenced, within prose, as a list; replies without any give none."""
    q = F.concat(F.lit('{"q": "'), F.col("id"), F.lit('"}'))
    reply = (
        F.when(F.col("question_no") % 5 == 0, F.concat(F.lit("No data. "), F.regexp_replace(F.col("question"), r"[{}\[\]]", ""))).when(F.col("question_no") % 5 == 1, F.concat(F.lit(" "), q, F.lit("\n"))).when(F.col("question_no") % 5 == 2, F.concat(F.lit("```json\n"), q, F.lit("\n```")))
        .when(F.col("question_no") % 5 == 3, F.concat(F.lit("Here you are: [\""), F.col("id"), F.lit("\"] as asked."))).otherwise(F.lit('The answer is {"q": 1} and no more.'))
    )
    return table(spark, d, "questions").select("question_no", T.loose_json(reply).alias("json")).filter("json is not null")


@R.query(r"""
SELECT question_no, CASE WHEN question_no % 3 = 0 THEN q ELSE regexp_replace(q, '[^\p{L}\p{N}]+$', '') END AS text, CASE question_no % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'label' ELSE 'signs' END AS repair FROM (SELECT question_no, trim(question, ' ') AS q FROM questions WHERE length(question) > 0
  AND len(regexp_extract_all(question, '\p{L}{2,}')) >= 3 AND trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) <> '' AND NOT contains(question, 'http') AND (len(list_filter(regexp_extract_all(lower(question), '\p{L}{2,}'), lambda w: w IN ('what', 'why', 'how', 'when', 'where', 'which', 'explain', 'describe'))) > 0) AND regexp_matches(question, '[\p{L}\p{N}]\?$')) WHERE question_no % 3 <> 1
UNION ALL SELECT question_no, trim(question, ' '), 'label' FROM questions WHERE question_no % 3 = 1 AND length(question) > 0 AND len(regexp_extract_all(question, '\p{L}{2,}')) >= 3 AND trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) <> '' AND NOT contains(question, 'http')
  AND (len(list_filter(regexp_extract_all(lower(question), '\p{L}{2,}'), lambda w: w IN ('what', 'why', 'how', 'when', 'where', 'which', 'explain', 'describe'))) > 0) AND regexp_matches(question, '[\p{L}\p{N}]\?$')""")
def str_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a link, a label or signs added, repaired against their own text."""
    q = table(spark, d, "questions").select("question_no", "question").filter(F.col("question").rlike(r"[\p{L}\p{N}]\?$") & ~F.contains("question", F.lit("http")) & (T.normalise_label(F.col("question")) != "") & (F.size(F.regexp_extract_all("question", F.lit(r"(\p{L}{2,})"), 1)) >= 3))
    words = F.regexp_extract_all(F.lower("question"), F.lit(r"(\p{L}{2,})"), 1)
    q = q.filter(F.arrays_overlap(words, F.array(*map(F.lit, ["what", "why", "how", "when", "where", "which", "explain", "describe"]))))
    k = F.col("question_no") % 3
    spoiled = F.when(k == 0, F.concat("question", F.lit(" https://a.example/x more"))).when(k == 1, F.concat(F.lit("Q12: "), F.col("question"))).otherwise(F.concat("question", F.lit(" |=_ •")))
    return q.select("question_no", T.repaired_question(spoiled, F.col("question")).alias("r")).select("question_no", "r.text", "r.repair")


@R.query(r"""
SELECT row_no, id, md5(body) AS digest, platform, method FROM (SELECT row_no, id, trim(regexp_replace(coalesce(original_text, ''), '^\s+|\s+$', '', 'g')) AS body, source.platform AS platform, coalesce(source.capture_method, 'unknown') AS method FROM posts) WHERE body <> ''""")
def prj_to_post(spark: SparkSession, d: str) -> DataFrame:
    """Captured items as posts with their provenance; items without a text are left out."""
    body = F.trim(F.regexp_replace(F.coalesce("original_text", F.lit("")), r"^\s+|\s+$", ""))
    return _posts(spark, d).select("row_no", "id", body.alias("body"), F.col("source.platform").alias("platform"), F.coalesce(F.col("source.capture_method"), F.lit("unknown")).alias("method")).filter("body <> ''").select("row_no", "id", F.md5("body").alias("digest"), "platform", "method")


_GTECH = "SELECT unnest([" + ", ".join("{'n': '" + n + "', 'p': ' " + p + " '}" for n, ps in sorted(T.TECHNOLOGIES.items()) for p in ps) + "], recursive := true)"


def _grounded_sql(text: str, keys: str, frm: str) -> str:
    padded = f"' ' || {_NORM.format(text)} || ' '"
    for n, ss in T.SHADOWS.items():
        for s in ss:
            padded = f"CASE WHEN t.n = '{n}' THEN replace({padded}, ' {s} ', ' ') ELSE {padded} END"
    return f"SELECT DISTINCT {keys}, t.n AS technology FROM {frm}, ({_GTECH}) t WHERE contains({padded}, t.p)"


@R.query(_grounded_sql("original_text", "row_no", "posts"))
def str_ground_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Technologies that posts name as whole words, without phrases that only look like them."""
    return _posts(spark, d).select("row_no", F.explode(T.grounded_technologies(F.col("original_text"))).alias("technology"))


@R.query(f"""
WITH s AS ({_grounded_sql("b", "id", "(SELECT id, original_text AS b FROM posts UNION ALL SELECT post_id, extracted_text FROM media_items) x")}), e AS (SELECT row_no, id, 'topic' AS kind, unnest(ai_analysis.topics) AS label FROM posts UNION ALL SELECT row_no, id, 'concept', unnest(ai_analysis.concepts) FROM posts),
n AS ({_grounded_sql("label", "row_no, id, kind, label", "e")}) SELECT DISTINCT row_no, kind, label FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = n.id AND s.technology = n.technology)""")
def str_ground_check(spark: SparkSession, d: str) -> DataFrame:
    """Topics and concepts that name a technology which neither the post's text nor its media name."""
    p = _posts(spark, d)
    texts = p.select("id", F.col("original_text").alias("b")).unionByName(table(spark, d, "media_items").select(F.col("post_id").alias("id"), F.col("extracted_text").alias("b")))
    said = texts.select("id", F.explode(T.grounded_technologies(F.col("b"))).alias("technology")).distinct()
    e = [p.select("row_no", "id", F.lit(k).alias("kind"), F.explode(f"ai_analysis.{f}").alias("label")) for k, f in (("topic", "topics"), ("concept", "concepts"))]
    named = e[0].unionByName(e[1]).withColumn("technology", F.explode(T.grounded_technologies(F.col("label"))))
    return named.join(said, ["id", "technology"], "left_anti").select("row_no", "kind", "label").distinct()


_HAY = "lower(concat_ws(' ', id, coalesce(original_text, ''), coalesce(ai_analysis.summary, ''), array_to_string(coalesce(ai_analysis.topics, []::VARCHAR[]), ' ')))"


@R.query(f"SELECT row_no, row_number() OVER (ORDER BY row_no) AS rank FROM posts WHERE contains({_HAY}, 'pipeline') AND contains({_HAY}, 'kafka')")
def q_search(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold all typed words anywhere, every one with its rank in their order."""
    text = F.concat_ws(" ", "id", F.coalesce("original_text", F.lit("")), F.coalesce(F.col("ai_analysis.summary"), F.lit("")), F.array_join(F.coalesce(F.col("ai_analysis.topics"), F.array().cast("array<string>")), " "))
    hits = _posts(spark, d).filter(F.contains(F.lower(text), F.lit("pipeline")) & F.contains(F.lower(text), F.lit("kafka"))).select("row_no")
    return ranked(hits, "row_no")


@R.query(f"""
WITH t AS (SELECT term_id, ' ' || {_NORM.format('term')} || ' ' AS n FROM reference_terms WHERE kind = 'concept'),
     x AS (SELECT row_no, ' ' || {_NORM.format('original_text')} || ' ' AS h FROM posts WHERE original_text IS NOT NULL)
SELECT term_id, count(row_no) AS n_posts, min(row_no) AS first_post FROM t LEFT JOIN x ON contains(h, n) GROUP BY term_id""")
def join_mention(spark: SparkSession, d: str) -> DataFrame:
    """Posts whose text names a concept as whole words; concepts without evidence count zero.

    A term's first word is the join key: texts are cut into their distinct words, which carry no text; what meets a term is
    joined to its text and tested for the whole term.
    """
    terms = table(spark, d, "reference_terms").filter("kind = 'concept'").select("term_id", T.normalise_label(F.col("term")).alias("n"))
    terms = terms.withColumn("w", F.substring_index("n", " ", 1))
    h = _posts(spark, d).filter("original_text is not null").select("row_no", T.normalise_label(F.col("original_text")).alias("h"))
    met = h.select("row_no", F.explode(F.array_distinct(F.split("h", " "))).alias("w")).join(small(terms), "w").select("row_no", "term_id", "n")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hits = met.join(h, "row_no").filter(F.contains(pad("h"), pad("n"))).groupBy("term_id").agg(F.count("*").alias("c"), F.min("row_no").alias("first_post"))
    return terms.join(hits, "term_id", "left").select("term_id", F.coalesce("c", F.lit(0)).cast("long").alias("n_posts"), "first_post")


@R.query("""
SELECT coalesce(source.platform, 'unknown') AS platform, count(*) AS n_posts, sum((source.url IS NOT NULL)::INTEGER)::BIGINT AS with_url, sum((source.author IS NOT NULL)::INTEGER)::BIGINT AS with_author, sum((coalesce(length(original_text), 0) > 0)::INTEGER)::BIGINT AS with_text, coalesce(sum(length(original_text)), 0)::BIGINT AS n_chars FROM posts GROUP BY 1""")
def agg_archive_report(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return _posts(spark, d).groupBy(F.coalesce("source.platform", F.lit("unknown")).alias("platform")).agg(
        F.count("*").alias("n_posts"), some(F.col("source.url").isNotNull()).alias("with_url"), some(F.col("source.author").isNotNull()).alias("with_author"),
        some(F.coalesce(F.length("original_text"), F.lit(0)) > 0).alias("with_text"), F.coalesce(F.sum(F.length("original_text")), F.lit(0)).cast("long").alias("n_chars"))


@R.query("SELECT id AS post_id, arg_max(row_no, epoch_us(ingested_at)::HUGEINT * 1000000000 + row_no) AS row_no, count(*) AS n_captures FROM posts GROUP BY id")
def inc_collect_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest capture of every post."""
    g = _posts(spark, d).groupBy(F.col("id").alias("post_id")).agg(F.max(F.struct("ingested_at", "row_no")).alias("m"), F.count("*").alias("n_captures"))
    return g.select("post_id", F.col("m.row_no").alias("row_no"), "n_captures")


QUERIES, ORACLE = R.queries, R.oracle

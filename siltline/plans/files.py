"""Queries over files: tables are written as the files that captures come as, and read again by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.operators import inventory as I
from siltline.plans._registry import Registry
from siltline.session import table, use_checkpoint_dir
from siltline.sources import readers as S
from siltline.sources import sinks as W

R = Registry()


def _place(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share and which goes with them."""
    return f"{use_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posts")


def _write_posts(spark: SparkSession, d: str, name: str = "post") -> str:
    """One JSON file for each post; every seventh lacks its text, every eleventh is a job's manifest instead."""
    p = _posts(spark, d)
    media = F.array(F.struct(F.lit("image").alias("type"), F.col("id").alias("path")), F.struct(F.lit("pdf").alias("type"), F.col("id").alias("path")))
    full = F.to_json(F.struct("id", "source", F.coalesce("original_text", F.lit("")).alias("original_text"), media.alias("media")))
    lacking = F.to_json(F.struct("id", "source"))
    job = F.to_json(F.struct(F.col("id").alias("job_id"), F.lit(1).alias("n")))
    path = _place(spark)
    p.select(F.when(F.col("row_no") % 11 == 0, job).when(F.col("row_no") % 7 == 0, lacking).otherwise(full)).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


_KIND = "CASE WHEN row_no % 11 = 0 THEN 'job manifest' WHEN row_no % 7 = 0 THEN 'missing fields' ELSE 'post' END"


@R.query(f"SELECT {_KIND} AS kind, count(*) AS n FROM posts GROUP BY 1")
def src_results_scan(spark: SparkSession, d: str) -> DataFrame:
    """Files of results below a folder by what they are: posts, job manifests, files that lack a field."""
    posts, skipped = S.read_results(spark, _write_posts(spark, d), "*.txt")
    return posts.select(F.lit("post").alias("kind")).unionByName(skipped.select(F.col("reason").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@R.query("SELECT id, source.platform AS platform, source.author AS author, md5(coalesce(original_text, '')) AS digest FROM posts WHERE row_no % 11 <> 0 AND row_no % 7 <> 0")
def src_post_load(spark: SparkSession, d: str) -> DataFrame:
    """The posts of such files, with defaults for what is missing."""
    return S.read_posts(spark, _write_posts(spark, d), "*.txt")[0].select("id", "source.platform", "source.author", F.md5("original_text").alias("digest"))


@R.query("SELECT id, length(coalesce(original_text, ''))::INTEGER AS text_length, 2 AS media_count FROM posts WHERE row_no % 11 <> 0 AND row_no % 7 <> 0")
def src_post_discover(spark: SparkSession, d: str) -> DataFrame:
    """What the post files of a folder hold, without their texts."""
    path = _write_posts(spark, d)
    posts, _ = S.read_posts(spark, path, "*.txt")
    return posts.select("id", F.length("original_text").alias("text_length"), F.size("media").alias("media_count"))


@R.query(f"SELECT {_KIND} AS reason, count(*) AS n FROM posts WHERE {_KIND} <> 'post' GROUP BY 1")
def flt_job_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.read_posts(spark, _write_posts(spark, d), "*.txt")[1].groupBy("reason").agg(F.count("*").alias("n"))


@R.query("SELECT question_no, question, difficulty FROM questions WHERE question_no % 9 <> 0")
def src_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Questions read from lines of JSON; every ninth line is broken."""
    path = _place(spark)
    q = table(spark, d, "questions")
    line = F.to_json(F.struct("question_no", "question", "difficulty"))
    q.select(F.when(F.col("question_no") % 9 == 0, F.substring(line, 1, 10)).otherwise(line)).write.text(path)
    return S.read_jsonl(spark, path, "question_no long, question string, difficulty string")[0].select("question_no", "question", "difficulty")


@R.query("SELECT count(*) AS n FROM questions WHERE question_no % 9 = 0")
def src_jsonl_issues(spark: SparkSession, d: str) -> DataFrame:
    """How many lines are broken, each with its place."""
    path = _place(spark)
    line = F.to_json(F.struct("question_no", "question"))
    table(spark, d, "questions").select(F.when(F.col("question_no") % 9 == 0, F.substring(line, 1, 10)).otherwise(line)).coalesce(1).write.text(path)
    return S.read_jsonl(spark, path, "question_no long")[1].filter("line_no > 0").agg(F.count("*").alias("n"))


_LIST = "SELECT nullif(trim(source.url), '') AS url, id AS source_id, nullif(trim(source.author), '') AS author FROM posts"


def _list(spark: SparkSession, d: str, kind: str) -> DataFrame:
    path = f"{_place(spark)}.{kind}"
    p = _posts(spark, d).select(F.col("source.url").alias("Post URL"), F.col("id").alias("Source ID"), F.col("source.author").alias("Posted By"), F.lit("x").alias("Other"))
    if kind in ("csv", "tsv"):
        p.write.option("header", True).option("quoteAll", True).option("escape", '"').option("sep", "\t" if kind == "tsv" else ",").csv(path)
    elif kind == "jsonl":
        p.write.json(path)
    else:
        # objects that wrap the rows of each group of posts
        p.groupBy(F.pmod(F.xxhash64("Source ID"), F.lit(64)).alias("g")).agg(F.to_json(F.struct(F.collect_list(F.struct("Post URL", "Source ID", "Posted By")).alias("savedItems"))).alias("v")).select("v").write.option("maxRecordsPerFile", 1).text(path)
    return S.read_saved_list(spark, path)[0].select("url", "source_id", "author")


for _kind in ("csv", "tsv", "jsonl", "json"):
    R.query(_LIST, f"src_saved_list_{_kind}")(lambda spark, d, kind=_kind: _list(spark, d, kind))


@R.query("SELECT row_no, 'https://a.example/' || id AS url FROM posts WHERE row_no % 5 <> 0")
def src_plain_links(spark: SparkSession, d: str) -> DataFrame:
    """Addresses from lines of text with notes; every fifth line is a comment."""
    path = f"{_place(spark)}.txt"
    p = _posts(spark, d)
    p.select(F.when(F.col("row_no") % 5 == 0, F.concat(F.lit("# "), "id")).otherwise(F.concat(F.lit("https://a.example/"), "id", F.lit(").  "), F.col("row_no").cast("string")))).write.text(path)
    return S.read_links(spark, path).select(F.col("notes").cast("long").alias("row_no"), "url")


def _html(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit('<DT><A HREF="https://a.example/'), "id", F.lit('" ADD_DATE="1">Post  '), F.col("row_no").cast("string"), F.lit("</A>\n<DD>note"))
    return _posts(spark, d).select("row_no", "id", F.concat(F.lit("<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p>"), link, link, F.lit("</DL>")).alias("h"))


@R.query("SELECT row_no, 'https://a.example/' || id AS url, 'Post ' || row_no AS title, 2 AS n FROM posts")
def src_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    """Links of bookmark exports with their texts."""
    h = _html(spark, d).select("row_no", F.explode(S.bookmark_links("h")).alias("b")).filter(F.col("b.url").startswith("https://a.example/"))
    return h.groupBy("row_no", "b.url", "b.title").agg(F.count("*").cast("int").alias("n"))


@R.query("""
SELECT row_no, CASE WHEN row_no % 3 = 0 THEN 'A description of forty characters or more, ' || id ELSE 'Head ' || id || chr(10) || 'one two' || chr(10) || 'three' END AS text, 'Title ' || row_no AS title, CASE WHEN row_no % 2 = 0 THEN '2024-05-06' END AS published FROM posts""")
def src_saved_page(spark: SparkSession, d: str) -> DataFrame:
    """Text, title and date of saved pages: scripts and head don't count, a long description beats the body."""
    no = F.col("row_no")
    said = F.when(no % 3 == 0, F.concat(F.lit('<meta property="og:description" content="A description of forty characters or more, '), "id", F.lit('">'))).otherwise("")
    page = F.concat(
        F.lit('<html><head><title>no</title><meta property="og:title" content="Title '), no.cast("string"), F.lit('">'), said, F.lit("<style>p{}</style></head><body><script>x('</p>')</script><h1>Head "), F.col("id"), F.lit("</h1><p>one&nbsp;two</p>"),
        F.when(no % 2 == 0, F.lit('<time datetime="2024-05-06"></time>')).otherwise(""), F.lit("<div>three</div></body></html>"),
    )
    return _posts(spark, d).select("row_no", S.page_parts(page).alias("p")).select("row_no", "p.text", "p.title", "p.published")


_NAME = "regexp_extract(media_path, '([^/]*)$', 1)"


@R.query(f"""
SELECT media_no, {_NAME} AS filename, CASE WHEN media_no % 10 = 0 THEN 0 ELSE seq_no END AS slide_number, CASE WHEN media_no % 10 = 0 THEN 'unresolved' ELSE 'package' END AS slide_source, coalesce(width, 0)::BIGINT AS width, coalesce(upper(ocr_status), 'ABSENT') AS ocr_status FROM media_items WHERE seq_no IS NOT NULL AND media_no % 13 <> 0 AND media_path IS NOT NULL""")
def src_package_csv(spark: SparkSession, d: str) -> DataFrame:
    """An inventory in CSV: rows without a file name are left out, numbers that are none are unresolved."""
    path = _place(spark)
    m = table(spark, d, "media_items").filter("seq_no is not null and media_path is not null")
    m.select(
        F.col("media_no").cast("string").alias("post_id"), F.lit("a").alias("activity_id"), F.when(F.col("media_no") % 10 == 0, F.lit("n/a")).otherwise(F.col("seq_no").cast("string")).alias("slide_number"),
        F.when(F.col("media_no") % 13 == 0, F.lit(" ")).otherwise(I.base_name(F.col("media_path"))).alias("filename"), F.lower("ocr_status").alias("ocr_status"), F.col("width").cast("string").alias("width"),
    ).write.option("header", True).csv(path)
    return S.read_inventory(spark, path).select(F.col("post_id").cast("long").alias("media_no"), "filename", "slide_number", "slide_source", "width", "ocr_status")


def _markdown(spark: SparkSession, d: str, text: F.Column, source: str, key: str) -> DataFrame:
    """Lines of Markdown documents, one document for each row of a table."""
    path = _place(spark)
    table(spark, d, source).select(text.alias("t")).write.option("maxRecordsPerFile", 1).option("lineSep", "\x1e").text(path)
    lines = S.numbered_lines(spark, path)
    return lines.withColumn("line", F.regexp_replace("line", "\x1e$", "")).filter(F.col("line") != "\x1e")


def _fenced() -> F.Column:
    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("original_text", F.lit("")), "```", "'''"), r"[\r\x1e]", ""))
    head = F.concat(F.lit("# Package\n\n## POST-"), F.col("row_no").cast("string"), F.lit("\n- Activity ID: `a"), F.col("row_no").cast("string"), F.lit("`\n"))
    slide = lambda n: F.concat(F.lit(f"\n### Slide {n}\n- Filename: `"), F.col("row_no").cast("string"), F.lit(f"_slide_{n}.png`\n#### Transcription\n```text\n"), body, F.lit(f"\nend {n}\n```\n"))
    return F.concat(head, slide(1), slide(2))


@R.query("""
SELECT 'POST-' || row_no AS group_id, row_no || '_slide_' || n || '.png' AS name, md5(regexp_replace(trim(replace(regexp_replace(coalesce(original_text, ''), '[\\r\\x1e]', '', 'g'), '```', ''''''''), ' ') || chr(10) || 'end ' || n, '^\\s+|\\s+$', '', 'g')) AS digest FROM posts, (SELECT unnest([1, 2]) AS n)""")
def src_package_md(spark: SparkSession, d: str) -> DataFrame:
    """Transcriptions of a package's Markdown by group and file name."""
    texts, _ = S.read_transcriptions(_markdown(spark, d, _fenced(), "posts", "row_no"))
    return texts.select("group_id", "name", F.md5("transcription").alias("digest"))


@R.query("SELECT 'POST-' || row_no AS group_id, 2::BIGINT AS names FROM posts")
def src_package_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of such a package with the number of their files."""
    return S.read_transcriptions(_markdown(spark, d, _fenced(), "posts", "row_no"))[1].select("group_id", "names")


@R.query("SELECT kind || ' ' || term AS topic, 'POST-' || term_id AS group_id FROM reference_terms UNION ALL SELECT kind || ' ' || term, 'POST-A' || term_id FROM reference_terms")
def src_topic_index(spark: SparkSession, d: str) -> DataFrame:
    """Groups that stand under each topic, each once."""
    t = F.concat(F.lit("# Index\n\n## "), "kind", F.lit(" "), "term", F.lit("\n\n- post-"), F.col("term_id").cast("string"), F.lit(", POST-A"), F.col("term_id").cast("string"), F.lit("\n- POST-"), F.col("term_id").cast("string"))
    return S.read_topics(_markdown(spark, d, t, "reference_terms", "term_id")).select("topic", "group_id")


@R.query("SELECT term AS topic, term_id * 1000 AS claimed FROM reference_terms")
def src_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The counts that a package claims for its topics; other sections hold none."""
    t = F.concat(F.lit("## Other\n- no: 5\n## Topic Coverage\n- **"), "term", F.lit("**: "), F.format_number(F.col("term_id") * 1000, 0), F.lit(" groups\n\n## End\n- x: 7"))
    return S.read_claimed_counts(_markdown(spark, d, t, "reference_terms", "term_id")).select("topic", "claimed")


@R.query("SELECT question_no AS entry, 'question' AS label, md5(regexp_replace(question, '^\\s+|\\s+$', '', 'g')) AS digest FROM questions WHERE question IS NOT NULL UNION ALL SELECT question_no, 'answer', md5('first line' || chr(10) || chr(10) || 'after a blank ' || question_no) FROM questions WHERE question IS NOT NULL")
def src_question_bank(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a bank with their fields, which go on over lines and blank lines."""
    no = F.col("question_no").cast("string")
    t = F.concat(F.lit("# Bank\n\n## Question "), no, F.lit("\n\n**Question:** "), F.regexp_replace("question", r"[\r\n\x1e]", " "), F.lit("\n**Answer:** first line\n\nafter a blank "), no, F.lit("\n\n---\n\nnot part of it\n"))
    return S.read_bank(_markdown(spark, d, F.coalesce(t, F.lit("# none")), "questions", "question_no")).select("entry", "label", F.md5("value").alias("digest"))


@R.query("SELECT format, misnamed, count(*) AS n FROM (SELECT CASE row_no % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' ELSE 'pdf' END AS format, true AS misnamed FROM posts) GROUP BY 1, 2")
def src_media_index(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder by what their first bytes tell; all are named as text."""
    path = _place(spark)
    k = F.col("row_no") % 4
    head = F.when(k == 0, F.concat(F.lit("PNG"))).when(k == 1, "JPG").when(k == 2, "GIF89a").otherwise("%PDF-1.7")
    # bytes above 127 can't be written as text, so the formats are told by signatures that are
    _posts(spark, d).select(F.concat(head, F.lit(" "), F.col("id"))).write.option("maxRecordsPerFile", 1).text(path)
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    real = F.when(F.substring("content", 1, 3).cast("string") == "PNG", F.concat(F.unhex(F.lit("89")), F.col("content"))).when(F.substring("content", 1, 3).cast("string") == "JPG", F.concat(F.unhex(F.lit("FFD8FF")), F.col("content"))).otherwise(F.col("content"))
    fmt = S.file_format(real)
    return f.select(fmt.alias("format"), (fmt != "txt").alias("misnamed")).groupBy("format", "misnamed").agg(F.count("*").alias("n"))


# ---- sinks


@R.query("SELECT 'stats' AS part, count(*) AS n, NULL::VARCHAR AS digest FROM (SELECT 1) UNION ALL SELECT 'topics', count(*), md5(string_agg(k, '|' ORDER BY k)) FROM (SELECT DISTINCT trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) AS k FROM (SELECT unnest(ai_analysis.topics) AS v FROM posts) WHERE trim(regexp_replace(lower(v), '[^a-z0-9]+', ' ', 'g')) <> '')")
def snk_knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    """A knowledge base published behind the guard, and read again."""
    p = _posts(spark, d)
    topics = p.select(F.explode("ai_analysis.topics").alias("v")).select(T.normalise_label(F.col("v")).alias("k")).filter("k <> ''").distinct()
    path = _place(spark)
    W.knowledge_base(p.agg(F.count("*").alias("posts"), F.lit(2).alias("schema_version")), {"topics": topics}, path)
    stats, back = W.published(spark, f"{path}/stats"), W.published(spark, f"{path}/topics")
    digest = back.agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("k")), "|")).alias("digest"))  # labels of a bounded vocabulary
    return stats.select(F.lit("stats").alias("part"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("digest")).unionByName(digest.select(F.lit("topics").alias("part"), "n", "digest"))


@R.query("SELECT row_no, md5(original_text) AS digest, source.author AS author FROM posts WHERE original_text <> ''")
def snk_saved_list_csv(spark: SparkSession, d: str) -> DataFrame:
    """Posts written as a CSV list and read back: texts with quotes and line breaks come back as they were."""
    path = _place(spark)
    p = _posts(spark, d).filter("original_text <> ''").select(F.col("row_no").cast("string").alias("row_no"), F.col("original_text").alias("t"), F.col("source.author").alias("author"))
    W.write_list(p, path)
    back = spark.read.schema("row_no string, t string, author string").option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return back.select(F.col("row_no").cast("long").alias("row_no"), F.md5("t").alias("digest"), "author")


_DUP = "row_no <> min(row_no) OVER (PARTITION BY md5(coalesce(original_text, '')))"


@R.query(f"SELECT action, count(*) AS n FROM (SELECT row_no, {_DUP} AS dup, CASE WHEN row_no % 3 = 0 THEN 'unchanged' ELSE 'written' END AS action FROM posts) WHERE NOT dup GROUP BY 1")
def snk_prepare(spark: SparkSession, d: str) -> DataFrame:
    """What preparing an archive a second time writes: all but duplicates is listed, only what changed is written."""
    p = _posts(spark, d).select("row_no", F.md5(F.coalesce("original_text", F.lit(""))).alias("fingerprint"))
    first = p.groupBy("fingerprint").agg(F.min("row_no").alias("first"))
    records = p.join(first, "fingerprint").select("row_no", "fingerprint", F.when(F.col("row_no") != F.col("first"), F.col("first")).alias("duplicate_of"))
    stored = records.filter("row_no % 3 = 0").select("row_no", "fingerprint")
    return W.prepare(records, stored, "row_no")[1].groupBy("action").agg(F.count("*").alias("n"))


@R.query("SELECT 1 AS run, count(*)::BIGINT AS changed, 1 AS version FROM documents UNION ALL SELECT 2, 0, 1 UNION ALL SELECT 3, (2 * count(*) FILTER (doc_id % 4 = 0))::BIGINT, 2 FROM documents")
def snk_import(spark: SparkSession, d: str) -> DataFrame:
    """Three imports: the first writes all, an unchanged one nothing, one with a quarter changed a new version."""
    path, rows = _place(spark), []
    doc = table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5("text")), 256).alias("digest"))
    changed = doc.withColumn("digest", F.when(F.col("doc_id") % 4 == 0, F.sha2(F.concat("digest", F.lit("x")), 256)).otherwise(F.col("digest")))
    for run, df in ((1, doc), (2, doc), (3, changed)):
        n = W.publish_changed(df, path, "digest")
        rows.append((run, n, W._version(spark, path)))
    return spark.createDataFrame(rows, "run int, changed long, version int")


@R.query("SELECT * FROM (VALUES ('author.name', 1::BIGINT), ('labels', 1::BIGINT), ('text', 2::BIGINT)) t(\"column\", n)")
def snk_public_guard(spark: SparkSession, d: str) -> DataFrame:
    """What the guard finds in nested columns of rows of which four hold a path or a credential."""
    p = _posts(spark, d).select(F.col("row_no").alias("k"))
    windows = F.concat(F.lit("see C:"), F.chr(F.lit(92)), F.lit("Users"), F.chr(F.lit(92)), F.lit("me"))
    rows = p.select(
        F.when(F.col("k") == 1, windows).when(F.col("k") == 2, "api_key = abcd1234").otherwise("plain").alias("text"), F.struct(F.when(F.col("k") == 3, "ghp_0123456789abcdefXYZ").otherwise("n").alias("name")).alias("author"),
        F.array(F.lit("ok"), F.when(F.col("k") == 4, "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----").otherwise("ok")).alias("labels"),
    )
    return W.leaks(rows)


QUERIES, ORACLE = R.queries, R.oracle

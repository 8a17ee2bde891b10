"""Readers of captures, lists, pages and files: explicit schemas, rows that don't fit go to a reject table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltline.operators.inventory import carry_heading
from siltline.session import checkpointed

POST = (
    "id string, source struct<platform:string,url:string,captured_at:string,author:string,capture_method:string,published_at:string>, original_text string, "
    "media array<struct<type:string,path:string,description:string,extracted_text:string,sequence:int,role:string,sha256:string>>, "
    "ai_analysis struct<summary:string,topics:array<string>,subtopics:array<string>,concepts:array<string>>, "
    "interview_questions array<struct<question:string,type:string,difficulty:string,answer:string>>, classification struct<domain:string,primary_topic:string,interview_relevant:boolean>"
)
# Names under which lists give their fields; names are compared by letters and digits only.
ALIASES = {
    "url": ["url", "link", "href", "permalink", "posturl"], "source_id": ["id", "sourceid", "postid", "urn"], "title": ["title", "name", "headline"],
    "author": ["author", "by", "creator", "postedby"], "notes": ["notes", "note", "comment", "comments"], "saved_at": ["saveddate", "savedat", "date", "saved"],
}
SECRETIVE = r"^(password|passwd|token|secret|cookie|cookies|session|sessionid|apikey|accesstoken|authorization|credential|credentials)$"
_SIGNATURES = [("89504E47", "png"), ("FFD8FF", "jpg"), ("47494638", "gif"), ("25504446", "pdf"), ("52494646", "riff"), ("3C737667", "svg")]


def read_posts(spark: SparkSession, path: str, pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(posts, rejects): JSON files, one post each; files without id, source and text, and unreadable ones, are rejects."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    raw = raw.select(F.regexp_replace("value", "^﻿", "").alias("value"), F.input_file_name().alias("file"))
    keys = F.json_object_keys("value")
    reason = F.when(keys.isNull(), "unreadable").when(F.size(F.array_except(F.array(F.lit("id"), F.lit("source"), F.lit("original_text")), keys)) > 0, F.when(F.array_contains(keys, "job_id"), "job manifest").otherwise("missing fields"))
    raw = raw.withColumn("reason", reason)
    posts = raw.filter("reason is null").select(F.from_json("value", POST).alias("p"), "file").select("p.*", "file")
    return posts, raw.filter("reason is not null").select("file", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues): one object a line; blank lines are skipped, bad ones are issues.

    Files are split and read by lines. A line is known by its file, the start of its block and its place there
    (``block``, ``line_no`` from 1); in a file of one block ``line_no`` is the number of the line in the file.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("r_id"))
    raw = checkpointed(raw)  # both results must see the same ids
    # ids rise within a block in the order of its lines
    first = raw.groupBy("file", "block").agg(F.min("r_id").alias("r_first"))
    lines = raw.join(first, ["file", "block"]).select("file", "block", (F.col("r_id") - F.col("r_first") + 1).alias("line_no"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))
    lines = lines.filter(F.trim("line") != "").withColumn("ok", F.json_object_keys("line").isNotNull())
    rows = lines.filter("ok").select("file", "block", "line_no", F.from_json("line", schema).alias("r")).select("file", "block", "line_no", "r.*")
    return rows, lines.filter("not ok").select("file", "block", "line_no", "line")


def _compact(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def map_header(df: DataFrame) -> DataFrame:
    """The known fields of a list under their own names, the first alias wins; columns named like credentials are refused."""
    import re

    by = {}
    for c in df.columns:
        if re.match(SECRETIVE, _compact(c)):
            raise ValueError(f"column {c!r} is named like a credential")
        by.setdefault(_compact(c), c)
    found = {f: next((by[a] for a in names if a in by), None) for f, names in ALIASES.items()}
    value = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) if c else F.lit(None).cast("string")
    return df.select(*[value(c).alias(f) for f, c in found.items()])


# Names under which a JSON object may hold its rows.
WRAPPERS = ["items", "saved", "savedItems", "data", "results"]


def _json_list(spark: SparkSession, path: str, by_line: bool) -> DataFrame:
    """The known fields of a JSON list: an array, an object that wraps one, or an object that is itself a row; all values are text."""
    row = "map<string,string>"
    text = spark.read.text(path, wholetext=not by_line).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    wrapped = F.coalesce(*[F.get_json_object("v", f"$.{w}") for w in WRAPPERS])
    rows = F.when(F.ltrim("v").startswith("["), F.col("v")).when(F.ltrim(wrapped).startswith("["), wrapped).otherwise(F.concat(F.lit("["), F.col("v"), F.lit("]")))
    each = text.filter(F.trim("v") != "").select(F.explode(F.from_json(rows, f"array<{row}>")).alias("m"))
    compact = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("m"), lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[^a-z0-9]", "").alias("key"), e["value"].alias("value")))))
    each = each.select(compact.alias("m"))
    value = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("m", F.lit(a))), F.lit("")) for a in names])
    return each.select(*[value(names).alias(f) for f, names in ALIASES.items()])


def discover_posts(spark: SparkSession, path: str) -> DataFrame:
    """id, file, text_length, media_count of every post file below a folder, in the order of the files."""
    posts, _ = read_posts(spark, path)
    return posts.select("id", "file", F.length(F.coalesce("original_text", F.lit(""))).alias("text_length"), F.coalesce(F.size("media"), F.lit(0)).alias("media_count")).orderBy("file")


def read_results(spark: SparkSession, path: str, pattern: str = "cloud_worker_*.json") -> tuple[DataFrame, DataFrame]:
    """(posts, skipped) of the result files below a folder; an error if no file has a name of the pattern."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    posts, skipped = read_posts(spark, path, pattern)
    if not posts.limit(1).count() and not skipped.limit(1).count():
        raise FileNotFoundError(f"{path}: no file named {pattern}")
    return posts, skipped


# The columns that an inventory must have.
INVENTORY = ["post_id", "activity_id", "slide_number", "filename", "ocr_status"]


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an inventory in CSV with a file name; slide numbers that are none are 0 and unresolved."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    lacking = sorted(set(INVENTORY) - set(raw.columns))
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
    number = F.trim(F.col("slide_number")).try_cast("int")
    good = F.coalesce(number >= 0, F.lit(False))
    rows = raw.select(
        text("post_id").alias("post_id"), text("activity_id").alias("activity_id"), text("filename").alias("filename"), F.when(good, number).otherwise(0).alias("slide_number"), F.when(good, "package").otherwise("unresolved").alias("slide_source"),
        *[F.coalesce(text(c).try_cast("long"), F.lit(0)).alias(c) for c in ("width", "height", "size_bytes")], F.lower(text("sha256")).alias("sha256"), text("exact_duplicate_of").alias("duplicate_of"), text("likely_preview_of").alias("preview_of"), F.coalesce(F.nullif(F.upper(text("ocr_status")), F.lit("")), F.lit("ABSENT")).alias("ocr_status"),
    )
    return rows.filter("filename <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, line of the lines of Markdown files; a file is one document and is read by one task."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return t.select("file", "pos", "line")


def read_transcriptions(lines: DataFrame, group: str = r"^## ((?:POST|Post)[- ]?[A-Za-z0-9_-]+)", name: str = r"^- (?:\*\*)?[Ff]ile(?:name)?:(?:\*\*)?\s*`?([^`]+?)`?\s*$", fence: str = "```") -> tuple[DataFrame, DataFrame]:
    """(texts, groups) of a package's Markdown: under a group's heading, a file's name and then what a fence holds.

    texts: file, group_id, name, transcription. groups: group_id, names. The last heading and name hold for the lines
    below; what is inside is told by counting fences. One file is one ordered document.
    """
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.trim("line").startswith(fence)
    x = lines.withColumn("fences", F.sum(F.when(mark, 1).otherwise(0)).over(w)).withColumn("inside", (F.col("fences") % 2 == 1) & ~mark)
    free = ~F.col("inside") & ~mark
    carried = lambda p: F.last(F.when(free & F.col("line").rlike(p), F.trim(F.regexp_extract("line", p, 1))), ignorenulls=True).over(w)
    x = x.withColumn("group_id", carried(group)).withColumn("named_at", F.last(F.when(free & F.trim("line").rlike(name), F.col("pos")), ignorenulls=True).over(w)).withColumn("name", carried(name))
    x = x.withColumn("headed_at", F.last(F.when(free & F.col("line").rlike(group), F.col("pos")), ignorenulls=True).over(w))
    body = x.filter(F.col("inside") & F.col("group_id").isNotNull() & (F.col("named_at") > F.col("headed_at"))).groupBy("file", "group_id", "name", "fences").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    texts = body.select("file", "group_id", "name", F.regexp_replace(F.array_join(F.transform("l", lambda v: v["line"]), "\n"), r"^\s+|\s+$", "").alias("transcription"))
    named = x.filter(free & F.trim("line").rlike(name) & F.col("group_id").isNotNull())
    return texts, named.groupBy("file", "group_id").agg(F.count("*").alias("names"))


def read_topics(lines: DataFrame, heading: str = r"^#+ +(.+)$", reference: str = r"(POST-[0-9A-Za-z]+)") -> DataFrame:
    """file, topic, group_id: groups that stand under each topic's heading, each once."""
    x = carry_heading(lines, "line", heading, ["file"], "pos", "topic").filter("topic is not null")
    return x.select("file", F.trim("topic").alias("topic"), F.explode(F.regexp_extract_all(F.upper("line"), F.lit(reference), 1)).alias("group_id")).distinct()


def read_claimed_counts(lines: DataFrame, section: str = "Topic Coverage", item: str = r"^- (?:\*\*)?(.+?)(?:\*\*)?: *([0-9,]+)") -> DataFrame:
    """file, topic, claimed: the counts that a section claims."""
    x = carry_heading(lines, "line", r"^#+ +(.+)$", ["file"], "pos", "section").filter(F.col("section") == section)
    return x.filter(F.col("line").rlike(item)).select("file", F.trim(F.regexp_extract("line", item, 1)).alias("topic"), F.regexp_replace(F.regexp_extract("line", item, 2), ",", "").cast("long").alias("claimed"))


def read_bank(lines: DataFrame, entry: str = r"^#+ +(?:Question|Q) *#?([0-9]+)", field: str = r"^\*\*([^*:]+):\*\*\s*(.*)$") -> DataFrame:
    """file, entry, label, value of a question bank: a field goes on over lines and blank lines up to the next field, rule or entry."""
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = lines.withColumn("entry", F.last(F.when(F.col("line").rlike(entry), F.regexp_extract("line", entry, 1).cast("long")), ignorenulls=True).over(w))
    starts = F.col("line").rlike(field) | F.col("line").rlike(entry) | F.trim("line").startswith("---")
    x = x.withColumn("part", F.sum(F.when(starts, 1).otherwise(0)).over(w)).withColumn("head", F.col("line").rlike(field))
    x = x.withColumn("label", F.first(F.when(F.col("head"), F.lower(F.trim(F.regexp_extract("line", field, 1)))), ignorenulls=True).over(W.partitionBy("file", "part"))).filter("label is not null and entry is not null")
    text = F.when(F.col("head"), F.regexp_extract("line", field, 2)).otherwise(F.col("line"))
    g = x.groupBy("file", "entry", "label").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("l"))
    return g.select("file", "entry", "label", F.regexp_replace(F.array_join(F.transform("l", lambda v: v["t"]), "\n"), r"^\s+|\s+$", "").alias("value"))


def read_saved_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, issues) of a CSV, TSV, JSON, JSONL or plain list; an item needs an address or an id."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        df = map_header(spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if suffix == "tsv" else ",").csv(path))
    elif suffix in ("json", "jsonl"):
        df = _json_list(spark, path, suffix == "jsonl")
    else:
        df = read_links(spark, path)
    usable = F.col("url").rlike("^https?://") | F.col("source_id").isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    return df.filter(usable), df.filter(~usable)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """One address a line, what stands beside it is a note; lines starting with # are comments."""
    line = F.trim("value")
    url = F.regexp_replace(F.regexp_extract(line, r"(https?://\S+)", 1), r"[.,;)\]}'\"]+$", "")
    t = spark.read.text(path).filter((line != "") & ~line.startswith("#"))
    empty = F.lit(None).cast("string")
    note = F.nullif(F.trim(F.regexp_replace(line, r"https?://\S+", "")), F.lit(""))
    return t.select(F.nullif(url, F.lit("")).alias("url"), empty.alias("source_id"), empty.alias("title"), empty.alias("author"), note.alias("notes"), empty.alias("saved_at"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("title", T.StringType())])))
def bookmark_links(html: pd.Series) -> pd.Series:
    """The links of a bookmark export with their texts."""
    from html.parser import HTMLParser

    class Links(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.out: list[dict] = []
            self.at: dict | None = None

        def handle_starttag(self, tag: str, attrs: list) -> None:
            href = dict(attrs).get("href") if tag == "a" else None
            if href:
                self.at = {"url": href, "title": ""}
                self.out.append(self.at)

        def handle_endtag(self, tag: str) -> None:
            if tag == "a":
                self.at = None

        def handle_data(self, data: str) -> None:
            if self.at is not None:
                self.at["title"] += data

    def links(text: str | None) -> list[dict]:
        p = Links()
        p.feed(text or "")
        return [{"url": x["url"], "title": " ".join(x["title"].split())} for x in p.out]

    return html.map(links)


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "title", "author", "published")]))
def page_parts(html: pd.Series) -> pd.DataFrame:
    """Text, title, author and date of a saved page: scripts and head are left out, a long description beats the body."""
    from html.parser import HTMLParser

    skipped = {"script", "style", "noscript", "svg", "template", "head"}
    block = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "blockquote"}
    names = {"og:title": "title", "twitter:title": "title", "author": "author", "article:author": "author", "article:published_time": "published", "og:description": "description", "twitter:description": "description"}

    class Page(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.hidden, self.text, self.meta = 0, [], {}

        def handle_starttag(self, tag: str, attrs: list) -> None:
            a = dict(attrs)
            if tag in skipped:
                self.hidden += 1
            elif tag == "meta":
                name = names.get((a.get("property") or a.get("name") or "").lower())
                if name and a.get("content"):
                    self.meta.setdefault(name, a["content"].strip())
            elif tag == "time" and a.get("datetime"):
                self.meta.setdefault("published", a["datetime"])
            if tag in block:
                self.text.append("\n")

        def handle_endtag(self, tag: str) -> None:
            if tag in skipped and self.hidden:
                self.hidden -= 1
            if tag in block:
                self.text.append("\n")

        def handle_data(self, data: str) -> None:
            if not self.hidden:
                self.text.append(data)

    def parts(text: str | None) -> tuple:
        p = Page()
        p.feed(text or "")
        lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
        body = "\n".join(x for x in lines if x)
        said = p.meta.get("description", "")
        return (said if len(said) >= 40 else body or said or None, p.meta.get("title"), p.meta.get("author"), p.meta.get("published"))

    return pd.DataFrame([parts(t) for t in html], columns=["text", "title", "author", "published"])


def file_format(content: Column) -> Column:
    """The format that the first bytes of a file tell."""
    head = F.hex(F.substring(content, 1, 8))
    out = F
    for signature, name in _SIGNATURES:
        out = out.when(head.startswith(signature), name)
    return out.otherwise("unknown")


def media_index(spark: SparkSession, root: str) -> DataFrame:
    """name, size, sha256, format and whether the name's ending tells another format, of every file under a folder; empty files are not listed."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name, fmt = F.regexp_extract("path", r"([^/]+)$", 1), file_format(F.col("content"))
    ending = F.regexp_replace(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), "jpeg", "jpg")
    return f.select(name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), fmt.alias("format"), ((fmt != "unknown") & (fmt != ending)).alias("misnamed"))

"""Inventories of files against archives: cross-checks, transcriptions, attachments, groups and what is missing.

Names of columns are parameters where tables differ; every operator works by equi-joins and conditional aggregates, and
no group is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def first_of(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row of every key: the first by ``order``, as an aggregate. Rows with a null key are left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in keep])


def attach_transcriptions(records: DataFrame, texts: DataFrame, boilerplate: list[str]) -> DataFrame:
    """Add ``text`` and ``status`` to records (name, ocr_status) from texts (name, transcription).

    Text that was promised and isn't there is UNRESOLVED; promised and empty, or nothing but a constant statement, NO_TEXT; a
    record without a promise and without a text keeps its status. Of several texts of a name the greatest counts.
    """
    t = texts.filter(F.col("name").isNotNull()).groupBy("name").agg(F.max(F.coalesce("transcription", F.lit(""))).alias("t_text"))
    j = records.join(t, "name", "left")
    promised = F.coalesce(F.col("ocr_status") == "AVAILABLE", F.lit(False))
    hollow = is_boilerplate(F.col("t_text"), boilerplate)
    status = F.when(F.col("t_text").isNull() & promised, "UNRESOLVED").when(F.col("t_text").isNotNull() & promised & hollow, "NO_TEXT").otherwise(F.coalesce("ocr_status", F.lit("ABSENT")))
    text = F.when(F.col("t_text").isNotNull() & ~(promised & hollow), F.col("t_text"))
    return j.select(*records.columns, text.alias("text"), status.alias("status"))


def is_boilerplate(text: Column, statements: list[str]) -> Column:
    """Whether a text is empty or holds one of the constant statements; blanks and case don't count."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " ")))
    out = fold(F.coalesce(text, F.lit(""))) == ""
    for s in statements:
        out |= F.contains(fold(F.coalesce(text, F.lit(""))), F.lit(" ".join(s.split()).lower()))
    return out


def cross_check(records: DataFrame, archive: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Add ``verdict`` (matched, conflicting, missing) and ``note`` (every difference, in a fixed order).

    records: name, sha256, size_bytes, width, height, activity (claimed), derived (from the name), duplicate_of, preview_of.
    archive: name, sha256, size_bytes, width, height, one row a name. posts: activity. A value is compared only if both sides know it;
    zero and the empty string are unknown.
    """
    a = archive.select("name", *[F.col(c).alias(f"a_{c}") for c in ("sha256", "size_bytes", "width", "height")], F.lit(True).alias("there"))
    j = records.join(a, "name", "left")
    names = archive.select("name").distinct()
    for c in ("duplicate_of", "preview_of"):
        j = j.join(names.select(F.col("name").alias(c), F.lit(True).alias(f"has_{c}")), c, "left")
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    both = lambda c: number(c) & number(f"a_{c}")
    problems = [
        (known("sha256") & (F.col("sha256") != F.col("a_sha256")), "digest"), (both("size_bytes") & (F.col("size_bytes") != F.col("a_size_bytes")), "size"),
        (both("width") & both("height") & ((F.col("width") != F.col("a_width")) | (F.col("height") != F.col("a_height"))), "dimensions"), (known("activity") & known("derived") & (F.col("activity") != F.col("derived")), "activity"),
    ]
    if posts is not None:
        j = j.join(posts.select(F.col("activity").alias("derived"), F.lit(True).alias("has_post")).distinct(), "derived", "left")
        problems.append((known("derived") & F.col("has_post").isNull(), "no post"))
    problems += [(known(c) & F.col(f"has_{c}").isNull(), n) for c, n in (("duplicate_of", "duplicate target"), ("preview_of", "preview target"))]
    note = F.concat_ws("; ", *[F.when(F.coalesce(c, F.lit(False)), n) for c, n in problems])
    verdict = F.when(F.col("there").isNull(), "missing").when(note != "", "conflicting").otherwise("matched")
    return j.select(*records.columns, verdict.alias("verdict"), F.when(F.col("there").isNull(), "").otherwise(note).alias("note"))


def absent(archive: DataFrame, records: DataFrame, limit: int = 200) -> DataFrame:
    """name: files of the archive that no record names, the first ``limit`` in order (a report, so it is bounded)."""
    return archive.select("name").distinct().join(records.select("name"), "name", "left_anti").orderBy("name").limit(limit)


def unreferenced(archive: DataFrame, references: DataFrame) -> DataFrame:
    """name: files of the archive that no reference names."""
    return archive.select("name").distinct().join(references.select("name"), "name", "left_anti")


def group_verdicts(groups: DataFrame, members: DataFrame, activities: DataFrame) -> DataFrame:
    """group_id, members, verdict of groups (group_id, declared, activity) by their members (group_id, activity, verdict).

    An activity that no post has counts before a member that is missing, and either before a wrong count; a group without
    members is matched.
    """
    m = members.groupBy("group_id").agg(F.count("*").alias("members"), F.min("activity").alias("m_activity"), F.max((F.col("verdict") == "missing").cast("int")).alias("lacks"))
    j = groups.join(m, "group_id", "left").withColumn("activity", F.coalesce(F.nullif("activity", F.lit("")), "m_activity"))
    j = j.join(activities.select("activity", F.lit(True).alias("known")).distinct(), "activity", "left")
    count = (F.coalesce("declared", F.lit(0)) != 0) & (F.coalesce("members", F.lit(0)) > 0) & (F.col("declared") != F.col("members"))
    verdict = F.when(F.col("activity").isNotNull() & F.col("known").isNull(), "missing").when(count, "conflicting").when(F.coalesce("lacks", F.lit(0)) == 1, "missing").otherwise("matched")
    return j.select("group_id", F.coalesce("members", F.lit(0)).cast("long").alias("members"), verdict.alias("verdict"))


def archive_media(references: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, notes) of references (record, pos, name) to an index (name, readable, agrees): what is usable and what isn't right.

    A name counts once in a record, repeats are noted; a path is cut to its name and noted; what the index lacks is noted. media:
    record, pos, name. notes: record, pos, note.
    """
    r = references.select("record", "pos", F.trim("name").alias("written"))
    r = r.join(r.filter("written <> ''").groupBy("record", "written").agg(F.min("pos").alias("first")), ["record", "written"], "left")
    r = r.withColumn("name", base_name(F.col("written"))).withColumn("repeat", F.col("pos") != F.col("first"))
    j = r.join(index.select("name", "readable", "agrees", F.lit(True).alias("there")), "name", "left")
    blank = F.coalesce(F.col("written"), F.lit("")) == ""
    there, repeat = F.coalesce("there", F.lit(False)), F.coalesce("repeat", F.lit(False))
    notes = [
        (blank, "empty"), (~blank & (F.col("name") != F.col("written")), "included a path"), (~blank & repeat, "listed more than once"), (~blank & ~repeat & ~there, "not in the media folder"),
        (there & ~repeat & ~F.col("readable"), "could not be read"), (there & ~repeat & F.col("readable") & ~F.col("agrees"), "named for a different type"),
    ]
    each = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in notes]))
    return j.filter(there & ~repeat & ~blank).select("record", "pos", "name"), j.select("record", "pos", F.explode(each).alias("note"))


def record_notes(records: DataFrame, media: DataFrame) -> DataFrame:
    """record, usable, note of records (record, claimed_multi, claimed_count): claims about media that don't hold."""
    n = media.groupBy("record").agg(F.count("*").alias("usable"))
    j = records.join(n, "record", "left").withColumn("usable", F.coalesce("usable", F.lit(0)).cast("long"))
    multi = F.coalesce("claimed_multi", F.lit(False)) & (F.col("usable") < 2)
    count = (F.coalesce("claimed_count", F.lit(0)) != 0) & (F.col("claimed_count") != F.col("usable"))
    return j.select("record", "usable", F.concat_ws("; ", F.when(multi, "multi-slide but supplied"), F.when(count, "counted and usable differ")).alias("note"))


def inject_media(media: DataFrame, assets: DataFrame, add_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(media, unmatched) of post media (post_id, name, text, method) and what was read (post_id, name, text, method, failed).

    What was read replaces what stands; a failed asset clears the method and keeps the text; an asset that the post doesn't have
    is added or, without ``add_missing``, only counted (post_id, unmatched). Adds ``origin``: kept, read, failed, added.
    """
    a = assets.select("post_id", "name", F.col("text").alias("a_text"), F.col("method").alias("a_method"), F.coalesce("failed", F.lit(False)).alias("failed"), F.lit(True).alias("asset"))
    m = media.select("post_id", "name", "text", "method", F.lit(True).alias("own"))
    j = m.join(a, ["post_id", "name"], "full_outer" if add_missing else "left")
    origin = F.when(F.col("asset").isNull(), "kept").when(F.col("own").isNull(), "added").when(F.col("failed"), "failed").otherwise("read")
    asset = F.col("asset").isNotNull()
    text = F.when(asset & ~F.coalesce("failed", F.lit(False)), F.nullif("a_text", F.lit(""))).otherwise(F.col("text"))
    method = F.when(asset & F.coalesce("failed", F.lit(False)), F.lit(None).cast("string")).when(asset, F.col("a_method")).otherwise(F.col("method"))
    out = j.select("post_id", "name", text.alias("text"), method.alias("method"), origin.alias("origin"))
    missing = a.join(m.select("post_id", "name"), ["post_id", "name"], "left_anti").groupBy("post_id").agg(F.count("*").alias("unmatched"))
    return out, missing


def claimed_roles(records: DataFrame) -> DataFrame:
    """Add ``role`` to records (group_id, name, preview_of, duplicate_of): thumbnail only if what it previews is in its group."""
    names = records.select(F.col("group_id").alias("g"), F.col("name").alias("p")).distinct().withColumn("there", F.lit(True))
    j = records.join(names, (F.col("group_id") == F.col("g")) & (F.col("preview_of") == F.col("p")), "left")
    numbered = F.regexp_extract("name", r"_slide_([^_]*?)(?:\.[^.]*)?$", 1).rlike(r"^\d+$")
    role = F.when(F.col("there"), "thumbnail").when(F.coalesce("duplicate_of", F.lit("")) != "", "slide").when(numbered, "slide").otherwise("image")
    return j.select(*records.columns, role.alias("role"))


# Parts of a note and the cause that they tell, the first one decides; parts joined by + must all be there.
NOTE_CAUSES = [("no usable author", "no author"), ("not in the media folder", "file missing"), ("not a format this project reads", "format unknown"), ("named for a different type", "misnamed"), ("but its content is", "misnamed"), ("multi-slide but supplied", "slides missing"), ("no text for this post", "no text"), ("listed more than once", "listed twice"), ("included a path", "path for a name"), ("counted+usable", "count differs"), ("could not be read", "unreadable"), ("could not be placed", "not written")]


def note_cause(note: Column) -> Column:
    """The cause that a note tells, or its first 80 characters."""
    low, out = F.lower(note), F.when(F.coalesce(note, F.lit("")) == "", "(no detail)")
    for parts, cause in NOTE_CAUSES:
        hit = F.lit(True)
        for p in parts.split("+"):
            hit &= F.contains(low, F.lit(p))
        out = out.when(hit, cause)
    return out.otherwise(F.substring(note, 1, 80))


def carry_heading(lines: DataFrame, text: str, pattern: str, by: list[str], order: str, out: str = "heading") -> DataFrame:
    """Add ``out``: the last line so far, within ``by``, that is a heading of the pattern; what its first group holds."""
    h = F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, 1))
    return lines.withColumn(out, F.last(h, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)))

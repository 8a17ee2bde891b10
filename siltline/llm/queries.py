"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.llm.cuts import cut_values
from siltline.llm.languages import document_languages, language_cases
from siltline.llm.lookalikes import unify_text, visual_classes, visual_twins, writing_pairs
from siltline.llm.mixing import mix_documents
from siltline.llm.packing import pack_documents, pack_report
from siltline.llm.pairs import judge_pairs
from siltline.llm.personal import personal_pieces, without_personal
from siltline.llm.scans import repaired, scan_defects
from siltline.llm.terms import typed_labels
from siltline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, field, pos, term_id of every label that isn't written exactly as a term of its kind."""
    return typed_labels(table(spark, sf_dir, "posts"), table(spark, sf_dir, "reference_terms")).select("row_no", "field", "pos", "term_id")


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that mean no term of their kind, with their number: field, label, n."""
    out = typed_labels(table(spark, sf_dir, "posts"), table(spark, sf_dir, "reference_terms"))
    return out.filter("term_id = 0").groupBy("field", "label").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_a, row_b: pairs of posts whose text reads the same but isn't the same string."""
    return visual_twins(table(spark, sf_dir, "posts"), "row_no", "original_text")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, class_no, writing_no, n_writings: the class of texts that read the same, of every post with a text."""
    return visual_classes(table(spark, sf_dir, "posts"), "row_no", "original_text")


def p2_writings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class_no, writing_no: pairs of the first string of each class with its other strings, by their first rows."""
    return writing_pairs(table(spark, sf_dir, "posts"), "row_no", "original_text")


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, unified: every post's text in one form."""
    return unify_text(table(spark, sf_dir, "posts").select("row_no", "original_text"), "original_text").select("row_no", "unified")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_no, defect: the first defect that the ordered rules find in each defective pair."""
    out = judge_pairs(table(spark, sf_dir, "questions").select("question_no", "question", "answer"))
    return out.select("question_no", F.get("defects", F.lit(0)).alias("defect")).filter("defect is not null")


def p5_all_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_no, defect: every defect triggered."""
    out = judge_pairs(table(spark, sf_dir, "questions").select("question_no", "question", "answer"))
    return out.select("question_no", F.explode("defects").alias("defect"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_no, field of every value of original_text and summary that was cut."""
    return cut_values(table(spark, sf_dir, "posts")).filter("cut").select("row_no", "field")


def p6_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """platform, field, n_values, n_cut, share of cut values."""
    out = cut_values(table(spark, sf_dir, "posts")).groupBy("platform", "field")
    out = out.agg(F.count("*").alias("n_values"), F.sum(F.col("cut").cast("long")).alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, container, doc_id, piece, tokens of every piece of every document in every pack."""
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_name, capacity_tokens, n_containers, n_pieces, tokens, fill."""
    packs = table(spark, sf_dir, "pack_sizes")
    return pack_report(pack_documents(table(spark, sf_dir, "documents"), packs), packs)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_name, doc_id, source, tokens, uses of every document that a mix uses."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of each mix was to reach and really reaches."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "posts").select(F.lit("posts").alias("tbl"), F.col("row_no").alias("key_no"), F.col("original_text").alias("text"))
    media = table(spark, sf_dir, "media_items").select(F.lit("media_items").alias("tbl"), F.col("media_no").alias("key_no"), F.col("extracted_text").alias("text"))
    return posts.unionByName(media)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, key_no, kind, start_pos of every piece of personal data."""
    return personal_pieces(_personal_texts(spark, sf_dir), ["tbl", "key_no"], "text").select("tbl", "key_no", "kind", "start_pos")


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, key_no, masked: every text with a typed placeholder for each piece."""
    return without_personal(_personal_texts(spark, sf_dir), "text").select("tbl", "key_no", "masked")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_no, defect: one row for each defect that occurs in the text of an item."""
    return scan_defects(table(spark, sf_dir, "media_items"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_no, paragraphs: every item's text as continuous paragraphs."""
    return repaired(table(spark, sf_dir, "media_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, scope, lang_code: documents with a missing or wrong label, and further languages of mixed documents."""
    return language_cases(table(spark, sf_dir, "documents"))


def p10_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start_pos, end_pos, lang_code, confidence of every stretch, with the document's own language."""
    out = document_languages(table(spark, sf_dir, "documents")).select("doc_id", "main", "confidence", F.explode("stretches").alias("s"))
    return out.select("doc_id", F.col("main").alias("doc_lang"), F.round("confidence", 4).alias("doc_confidence"), "s.start_pos", "s.end_pos", F.col("s.code").alias("lang_code"), F.round("s.confidence", 4).alias("confidence"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p2_found, p2_classes, p2_writings, p2_unified, p3_found, p3_repaired, p4_found, p4_masked, p5_found, p5_all_defects, p6_found, p6_share, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_stretches)
}
ORACLE: dict[str, str] = {}

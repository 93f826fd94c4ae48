"""The pN_ queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import canon, langid, leak, mix, names, ocr, split, subjects, truncated
from foliant.llm.common import read


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    return langid.mislabelled(read(spark, data, "archive_document"))


def p1_languages(spark: SparkSession, data: str) -> DataFrame:
    """Every document and every paragraph of a mixed document, with its language and confidence."""
    return langid.languages(read(spark, data, "archive_document"))


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    out = canon.map_values(read(spark, data, "tag"), read(spark, data, "tag_vocabulary"))
    return out.select(F.col("id").alias("tag_id"), "entry_id")


def p2_unmatched(spark: SparkSession, data: str) -> DataFrame:
    """Names that stand for no entry, with the number of tags that bear them."""
    tags = read(spark, data, "tag")
    out = canon.map_values(tags, read(spark, data, "tag_vocabulary")).filter("entry_id = 0").select("id")
    return tags.select("id", "name").dropDuplicates(["id"]).join(out, "id", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("tags"))


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    return names.same_pairs(read(spark, data, "people"))


def p3_entities(spark: SparkSession, data: str) -> DataFrame:
    """Every row of people with its entity."""
    return names.entities(read(spark, data, "people"))


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    out = split.split(read(spark, data, "archive_document"), read(spark, data, "size_limit"), with_text=False)
    return out.filter("piece = 2").select("id").distinct()


def p4_pieces(spark: SparkSession, data: str) -> DataFrame:
    return split.split(read(spark, data, "archive_document"), read(spark, data, "size_limit"))


def p9_mixture(spark: SparkSession, data: str) -> DataFrame:
    return mix.mixture(read(spark, data, "documents"), read(spark, data, "mix_target"))


def p9_shares(spark: SparkSession, data: str) -> DataFrame:
    return mix.shares(p9_mixture(spark, data), read(spark, data, "mix_target"))


def p10_found(spark: SparkSession, data: str) -> DataFrame:
    return truncated.truncated(read(spark, data, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, data: str) -> DataFrame:
    return truncated.rates(read(spark, data, "documents"))


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return ocr.noise(read(spark, data, "archive_document"))


def p5_repaired(spark: SparkSession, data: str) -> DataFrame:
    return ocr.repaired(read(spark, data, "archive_document"))


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    return subjects.areas(read(spark, data, "archive_document"), read(spark, data, "subject_label")).select("id", "subject_id")


def p6_shares(spark: SparkSession, data: str) -> DataFrame:
    return subjects.composition(read(spark, data, "archive_document"), read(spark, data, "subject_label"))


def p8_found(spark: SparkSession, data: str) -> DataFrame:
    return leak.leaks(read(spark, data, "documents"), read(spark, data, "benchmark")).select("item_id", "doc_id")


def p8_items(spark: SparkSession, data: str) -> DataFrame:
    """The leaked items, with the documents that hold a passage of them and the longest passage in words."""
    out = leak.leaks(read(spark, data, "documents"), read(spark, data, "benchmark"))
    return out.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"))


P4_SQL = """
WITH l AS (SELECT lower(trim(split_part(original_type, ';', 1))) AS k, min(max_chars) AS m FROM size_limit GROUP BY 1)
SELECT DISTINCT d.id FROM archive_document d LEFT JOIN l ON l.k = lower(trim(split_part(d.original_type, ';', 1)))
WHERE length(d.text_content) > coalesce(l.m, (SELECT m FROM l WHERE k = '*'))
"""

QUERIES = {"p1_found": p1_found, "p1_languages": p1_languages, "p2_found": p2_found, "p2_unmatched": p2_unmatched, "p3_found": p3_found, "p3_entities": p3_entities, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_repaired": p5_repaired, "p6_found": p6_found, "p6_shares": p6_shares, "p8_found": p8_found, "p8_items": p8_items, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_rates": p10_rates}
SQL = {"p4_found": P4_SQL}

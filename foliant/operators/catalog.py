"""Reads over the archive's tables: lookups, listings, prefix searches and counts. Page limits of 0 or less mean no page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import like_prefix
from foliant.sources.views import Archive

def _count():
    return F.count(F.lit(1))


def page(df: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset > 0 else df
    return df.limit(limit) if limit > 0 else df


def newest(df: DataFrame, by: str = "created_at", limit: int = 0, offset: int = 0) -> DataFrame:
    """Newest first; equal times by id, unknown times first."""
    return page(df.orderBy(F.col(by).desc_nulls_first(), "id"), limit, offset)


def by(df: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values; None leaves a column out."""
    for c, v in equal.items():
        df = df.filter(F.col(c) == v) if v is not None else df
    return df


def named(df: DataFrame, prefix: str, limit: int = 0, offset: int = 0) -> DataFrame:
    return page(df.filter(like_prefix(F.col("name"), prefix)).orderBy("name", "id"), limit, offset)


def counted(df: DataFrame) -> DataFrame:
    return df.agg(_count().alias("count"))


def as_json(page: DataFrame) -> DataFrame:
    """Each row of a page as one JSON object (column `value`), nulls left out."""
    return page.select(F.to_json(F.struct(*page.columns)).alias("value"))


def tasks(a: Archive, batch_id: str | None = None, status: str | None = None, task_type: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """The sixteen task listings as one: any of batch, status and type, newest first, paged or not."""
    return newest(by(a.task, batch_id=batch_id, status=status, task_type=task_type), limit=limit, offset=offset)


def processing_tasks(a: Archive) -> DataFrame:
    return counted(a.task.filter("status = 'processing' and task_type in ('consume', 'enrich')"))


def document_details(a: Archive, cond: Column) -> DataFrame:
    t = a.document_type.select(F.col("id").alias("document_type_id"), F.col("name").alias("document_type"))
    return a.live.filter(cond).join(t, "document_type_id", "left")


def by_checksum(a: Archive, md5: str | None = None, sha512: str | None = None) -> DataFrame:
    return by(a.live, md5_checksum=md5, sha512_checksum=sha512)


def titles_like(a: Archive, pattern: str, limit: int = 0, offset: int = 0) -> DataFrame:
    return newest(a.live.filter(F.col("title").like(pattern)), limit=limit, offset=offset)


def trash(a: Archive, limit: int = 0, offset: int = 0) -> DataFrame:
    return newest(a.trash, "deleted_at", limit, offset)


def document_tags(a: Archive, document_id: int) -> DataFrame:
    ids = a.document_tag.filter(F.col("document_id") == document_id).select(F.col("tag_id").alias("id"))
    return a.tag.join(ids, "id", "left_semi")


def tag_documents(a: Archive, tag_id: int) -> DataFrame:
    ids = a.document_tag.filter(F.col("tag_id") == tag_id).select(F.col("document_id").alias("id"))
    return a.live.join(ids, "id", "left_semi")


def document_people(a: Archive, document_id: int) -> DataFrame:
    dp = a.document_people.filter(F.col("document_id") == document_id)
    p = a.people.select(F.col("id").alias("people_id"), "name", "name_native")
    return dp.join(p, "people_id").join(a.people_type.select(F.col("id").alias("people_type_id"), F.col("name").alias("role")), "people_type_id")


def people_documents(a: Archive, people_id: int) -> DataFrame:
    """Trashed documents too."""
    ids = a.document_people.filter(F.col("people_id") == people_id).select(F.col("document_id").alias("id"))
    return a.document.join(ids, "id", "left_semi")


def tags_with_count(a: Archive, prefix: str | None = None) -> DataFrame:
    """Each tag with its documents, trashed ones too."""
    t = a.tag if prefix is None else a.tag.filter(like_prefix(F.col("name"), prefix))
    n = a.document_tag.groupBy(F.col("tag_id").alias("id")).agg(_count().alias("n"))
    return t.join(n, "id", "left").select("id", "name", "created_at", F.coalesce("n", F.lit(0)).alias("document_count"))


def people_with_count(a: Archive, prefix: str | None = None) -> DataFrame:
    """Each person with the number of roles in documents, trashed ones too."""
    p = a.people if prefix is None else a.people.filter(like_prefix(F.col("name"), prefix))
    n = a.document_people.groupBy(F.col("people_id").alias("id")).agg(_count().alias("n"))
    return p.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("document_count"))


def types_with_count(a: Archive, prefix: str | None = None) -> DataFrame:
    """Each document type with its live documents."""
    t = a.document_type if prefix is None else a.document_type.filter(like_prefix(F.col("name"), prefix))
    n = a.live.groupBy(F.col("document_type_id").alias("id")).agg(_count().alias("n"))
    return t.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("document_count"))


def untagged(a: Archive) -> DataFrame:
    return a.live.join(a.document_tag.select(F.col("document_id").alias("id")), "id", "left_anti")


def recent_tasks(a: Archive, task_type: str, minutes: int, at: Column) -> DataFrame:
    return counted(a.task.filter((F.col("task_type") == task_type) & (F.col("created_at") > at - F.make_dt_interval(mins=F.lit(minutes)))))


def last_completed(a: Archive, task_type: str) -> DataFrame:
    return a.task.filter((F.col("task_type") == task_type) & (F.col("status") == "completed")).agg(F.max("completed_at").alias("completed_at"))


def latest_by_key(a: Archive, task_type: str) -> DataFrame:
    """The newest task of each dedup key."""
    t = a.task.filter((F.col("task_type") == task_type) & F.col("dedup_key").isNotNull() & F.col("created_at").isNotNull())
    return t.groupBy("dedup_key").agg(F.max(F.struct("created_at", "id", "status")).alias("x")).select("dedup_key", "x.id", "x.status")

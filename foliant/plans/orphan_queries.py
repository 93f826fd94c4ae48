"""Queries p7_found and p7_report, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators.orphans import Reference, orphan_report, orphans
from foliant.sources.tables import table


def references(spark: SparkSession, data: str) -> list[Reference]:
    t = lambda name: table(spark, data, name)
    return [
        Reference("task", t("task"), "id", "batch_id", "created_at", t("batch"), "id", "created_at", "uuid"),
        Reference("archive_document", t("archive_document"), "id", "document_type_id", "created_at", t("document_type"), "id", "created_at"),
        Reference("document_tag_request", t("document_tag_request"), "request_id", "tag_id", "requested_at", t("tag"), "id", "created_at"),
    ]


def p7_found(spark: SparkSession, data: str) -> DataFrame:
    return orphans(references(spark, data)).select("child", "row_id")


def p7_report(spark: SparkSession, data: str) -> DataFrame:
    return orphan_report(references(spark, data))


_KEY = r"""(CASE WHEN regexp_matches({k}, '^[0-9a-f]{{32}}$') THEN regexp_replace({k}, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5') ELSE {k} END)"""


def _uuid(c: str) -> str:
    s = f"trim(regexp_replace(lower(trim({c})), '^(urn:)?(uuid:)?\\s*[\\{{\\(]?\\s*|\\s*[\\}}\\)]?$', '', 'g'))"
    return _KEY.format(k=s)


_ORPHANS = f"""
WITH refs AS (
  SELECT 'task' AS child, id AS row_id, {_uuid("batch_id")} AS key, created_at AS t FROM task
  UNION ALL SELECT 'archive_document', id, CAST(document_type_id AS VARCHAR), created_at FROM archive_document
  UNION ALL SELECT 'document_tag_request', request_id, CAST(tag_id AS VARCHAR), requested_at FROM document_tag_request),
parents AS (
  SELECT 'task' AS child, {_uuid("id")} AS key, min(created_at) AS since FROM batch GROUP BY 2
  UNION ALL SELECT 'archive_document', CAST(id AS VARCHAR), min(created_at) FROM document_type GROUP BY 2
  UNION ALL SELECT 'document_tag_request', CAST(id AS VARCHAR), min(created_at) FROM tag GROUP BY 2),
tops AS (
  SELECT 'archive_document' AS child, max(id) AS top FROM document_type
  UNION ALL SELECT 'document_tag_request', max(id) FROM tag),
orphans AS (
  SELECT r.child, r.row_id, min(r.t) AS t, max(CASE WHEN p.key IS NOT NULL THEN 'late'
    WHEN try_cast(r.key AS BIGINT) BETWEEN 1 AND o.top THEN 'deleted' ELSE 'missing' END) AS kind
  FROM refs r LEFT JOIN parents p ON r.child = p.child AND r.key = p.key LEFT JOIN tops o ON o.child = r.child
  WHERE r.key IS NOT NULL AND r.key <> '' AND (p.key IS NULL OR p.since > r.t)
  GROUP BY r.child, r.row_id)
"""

QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": _ORPHANS + "SELECT child, row_id FROM orphans",
    "p7_report": _ORPHANS + "SELECT child, strftime(t, '%Y-%m') AS month, kind, count(*) AS orphans FROM orphans GROUP BY ALL",
}

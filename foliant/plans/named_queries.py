"""The archive's named reads and writes, a line each, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import catalog as C
from foliant.operators import dashboard as D
from foliant.operators import pipeline as P
from foliant.operators import state as M
from foliant.sources.views import AS_OF, SQL as VIEWS, Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"


def add(name: str, f: Callable[[Archive], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, data: f(Archive(spark, data))
    SQL[name] = VIEWS + sql


def least(df: DataFrame, c: str = "id") -> object:
    """One value to ask for: the least one of a column."""
    return df.agg(F.min(c)).first()[0]


# Lookups by a key: view, its table in the SQL, key column, columns that are shown.
_LOOKUPS = {
    "tag_by_id": ("tag", "tag", "id", "id, name"),
    "tag_by_name": ("tag", "tag", "name", "id, name"),
    "people_by_id": ("people", "persons", "id", "id, name"),
    "people_by_name": ("people", "persons", "name", "id, name"),
    "people_by_normalized_name": ("people", "persons", "normalized_name", "id, normalized_name"),
    "document_type_by_id": ("document_type", "document_type", "id", "id, name"),
    "document_type_by_name": ("document_type", "document_type", "name", "id, name"),
    "people_type_by_name": ("people_type", "people_type", "name", "id, name"),
    "document_by_id": ("live", "live", "id", "id, title"),
    "document_by_uuid": ("live", "live", "document_id", "id, document_id"),
    "document_by_md5": ("live", "live", "md5_checksum", "id, md5_checksum"),
    "trash_by_uuid": ("trash", "(SELECT * FROM document WHERE deleted_at IS NOT NULL)", "document_id", "id, document_id"),
    "task_by_id": ("task", "tasks", "id", "id, status"),
    "task_by_task_id": ("task", "tasks", "task_id", "id, task_id"),
    "tasks_of_batch": ("task", "tasks", "batch_id", "id, status"),
    "batch_by_id": ("batch", "batches", "id", "id, status"),
    "batch_owner_of": ("batch_owner", "batch_owner", "batch_id", "batch_id, owner_id"),
    "orphaned_by_id": ("orphaned_file", "orphaned_file", "id", "id, document_key"),
}
for _name, (_view, _table, _key, _cols) in _LOOKUPS.items():
    add(
        _name,
        lambda a, v=_view, k=_key, c=_cols: (lambda df: C.by(df, **{k: least(df, k)}).select(*c.split(", ")))(getattr(a, v)),
        f"SELECT {_cols} FROM {_table} WHERE {_key} = (SELECT min({_key}) FROM {_table})",
    )

# Listings by name, and prefix searches with the number of documents.
for _name, _view, _table in (("tags_all", "tag", "tag"), ("people_all", "people", "persons"), ("document_types_all", "document_type", "document_type"), ("people_types_all", "people_type", "people_type")):
    add(_name, lambda a, v=_view: C.named(getattr(a, v), "").select("id", "name"), f"SELECT id, name FROM {_table}")
    add(f"{_name}_page", lambda a, v=_view: C.named(getattr(a, v), "", 5, 3).select("id", "name"), f"SELECT id, name FROM {_table} ORDER BY name, id LIMIT 5 OFFSET 3")
add("tags_prefix_with_count", lambda a: C.tags_with_count(a, "s").select("id", "document_count"), "SELECT t.id, count(d.tag_id) AS document_count FROM tag t LEFT JOIN document_tag d ON d.tag_id = t.id WHERE t.name LIKE 's%' GROUP BY 1")
add("people_prefix_with_count", lambda a: C.people_with_count(a, "M").select("id", "document_count"), "SELECT p.id, count(d.people_id) AS document_count FROM persons p LEFT JOIN document_people d ON d.people_id = p.id WHERE p.name LIKE 'M%' GROUP BY 1")
add("types_prefix_with_count", lambda a: C.types_with_count(a, "l").select("id", "document_count"), "SELECT t.id, count(d.id) AS document_count FROM document_type t LEFT JOIN live d ON d.document_type_id = t.id WHERE t.name LIKE 'l%' GROUP BY 1")
add("tags_count", lambda a: C.counted(a.tag), "SELECT count(*) AS count FROM tag")
add("people_count", lambda a: C.counted(a.people), "SELECT count(*) AS count FROM persons")
add("users_count", lambda a: C.counted(a.user), "SELECT count(*) AS count FROM users")
add("documents_count", lambda a: C.counted(a.live), "SELECT count(*) AS count FROM live")
add("documents_bytes", lambda a: a.live.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes")), "SELECT coalesce(sum(file_size), 0)::BIGINT AS bytes FROM live")
add("tasks_count", lambda a: C.counted(a.task), "SELECT count(*) AS count FROM tasks")
add("batches_queued", lambda a: C.counted(C.by(a.batch, status="queued")), "SELECT count(*) AS count FROM batches WHERE status = 'queued'")
add("batches_paused", lambda a: C.by(a.batch, status="paused").select("id"), "SELECT id FROM batches WHERE status = 'paused'")
add("batch_next_queued", lambda a: C.by(a.batch, status="queued").orderBy(F.col("created_at").asc_nulls_last(), "id").limit(1).select("id"), "SELECT id FROM batches WHERE status = 'queued' ORDER BY created_at NULLS LAST, id LIMIT 1")
add("batches_live", lambda a: C.counted(a.batch_owner.filter(F.col("last_heartbeat") > D.now() - F.make_dt_interval(secs=F.lit(15)))), f"SELECT count(*) AS count FROM batch_owner WHERE last_heartbeat > {NOW} - INTERVAL 15 SECOND")
for _type, _status in (("consume", "failed"), ("enrich", "completed")):
    add(f"tasks_{_type}_{_status}", lambda a, t=_type, s=_status: C.tasks(a, status=s, task_type=t, limit=20).select("id"), f"SELECT id FROM tasks WHERE status = '{_status}' AND task_type = '{_type}' ORDER BY created_at DESC NULLS FIRST, id LIMIT 20")
add("tasks_active_of_type", lambda a: C.counted(a.task.filter("task_type = 'consume' and status in ('pending', 'processing')")), "SELECT count(*) AS count FROM tasks WHERE task_type = 'consume' AND status IN ('pending', 'processing')")
add("orphaned_pending", lambda a: C.newest(C.by(a.orphaned_file, status="pending"), "detected_at").select("id"), "SELECT id FROM orphaned_file WHERE status = 'pending'")

# Writes, as the table that they leave.
_T = "(SELECT min(id) FROM tasks WHERE status = '{}')"
add("batch_set_paused", lambda a: M.set_batch(a.batch, least(a.batch), "paused").select("id", "status"), "SELECT id, CASE WHEN id = (SELECT min(id) FROM batches) THEN 'paused' ELSE status END AS status FROM batches")
add("batch_created", lambda a: M.insert_absent(a.batch, a.spark.createDataFrame([("new", "manual", "queued", None), (str(least(a.batch)), "x", "x", None)], a.batch.schema), ["id"]).select("id", "status"), "SELECT id, status FROM batches UNION ALL SELECT 'new', 'queued'")
add("lease_heartbeat", lambda a: M.heartbeat(a.batch_owner, least(a.batch_owner, "owner_id"), D.now()).select("batch_id", "last_heartbeat"), f"SELECT batch_id, CASE WHEN owner_id = (SELECT min(owner_id) FROM batch_owner) THEN {NOW} ELSE last_heartbeat END AS last_heartbeat FROM batch_owner")
add("lease_forced", lambda a: M.acquire_owner(a.batch_owner, least(a.batch_owner, "batch_id"), "me", 7, D.now(), True).select("batch_id", "owner_id"), "SELECT batch_id, CASE WHEN batch_id = (SELECT min(batch_id) FROM batch_owner) THEN 'me' ELSE owner_id END AS owner_id FROM batch_owner")
add("lock_running", lambda a: M.lock_running(a.backup_lock, D.now()), "SELECT 1 AS locked")
add("lock_taken", lambda a: M.acquire_lock(a.backup_lock, D.now(), 5).select("running", "started_at"), f"SELECT true AS running, {NOW} AS started_at")
add("lock_held", lambda a: M.acquire_lock(a.backup_lock, D.now(), 30).select("running", "started_at"), "SELECT running, started_at FROM backup_lock")
add("lock_released", lambda a: M.release_lock(a.backup_lock).select("running", "started_at"), "SELECT false AS running, NULL::TIMESTAMP AS started_at")
add("orphaned_deleted_all", lambda a: P.orphan_action(a.orphaned_file, None, "deleted", D.now()).select("id", "status", "action_type"), "SELECT id, CASE WHEN status = 'pending' THEN 'deleted' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'delete' END AS action_type FROM orphaned_file")
add("orphaned_reingested", lambda a: P.orphan_action(a.orphaned_file, [least(a.orphaned_file) or 0], "reingested", D.now()).select("id", "status", "action_type"), "SELECT id, CASE WHEN id = (SELECT min(id) FROM orphaned_file) THEN 'reingested' ELSE status END AS status, CASE WHEN id = (SELECT min(id) FROM orphaned_file) THEN 'move_to_inbox' END AS action_type FROM orphaned_file")
add("orphaned_restorable", lambda a: P.restorable(a.orphaned_file, a.live), "SELECT id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.document_id = o.document_key) THEN 'Conflict' ELSE 'Ok' END AS code FROM orphaned_file o")
add("task_retry", lambda a: M.retry(a.task, F.col("id") == (least(C.by(a.task, status="failed")) or 0)).select("id", "status", "attempts"), f"SELECT id, CASE WHEN id = {_T.format('failed')} THEN 'pending' ELSE status END AS status, CASE WHEN id = {_T.format('failed')} THEN 0 ELSE attempts END AS attempts FROM tasks")
_W = "SELECT task_id, json_extract_string(payload, '$.waiting_for') AS parent FROM tasks WHERE task_type = 'enrich' AND status = 'waiting' AND json_extract_string(payload, '$.waiting_for') IS NOT NULL ORDER BY id LIMIT 1"


def _activated(a: Archive) -> DataFrame:
    """The first waiting enrich task gets its payload and becomes pending."""
    w = a.task.filter("task_type = 'enrich' and status = 'waiting'").select("id", "task_id", F.get_json_object("payload", "$.waiting_for").alias("parent")).filter("parent is not null").orderBy("id").first()
    return M.activate_enrich(a.task, w.parent, w.task_id, "{}") if w else a.task


add("task_activated", lambda a: _activated(a).select("id", "status"), f"SELECT t.id, CASE WHEN w.task_id IS NOT NULL THEN 'pending' ELSE status END AS status FROM tasks t LEFT JOIN ({_W}) w ON w.task_id = t.task_id AND w.parent = json_extract_string(t.payload, '$.waiting_for') AND t.status IN ('waiting', 'discarded')")
add("task_deleted", lambda a: M.delete(a.task, F.col("id") == least(a.task)).select("id"), "SELECT id FROM tasks WHERE id <> (SELECT min(id) FROM tasks)")
add("document_trashed", lambda a: M.soft_delete(a.document, least(a.live, "document_id"), D.now()).select("id", "deleted_at"), f"SELECT id, CASE WHEN document_id = (SELECT min(document_id) FROM live) AND deleted_at IS NULL THEN {NOW} ELSE deleted_at END AS deleted_at FROM document")
add("document_restored", lambda a: M.restore_document(a.document, least(a.trash, "document_id") or "", D.now()).select("id", "deleted_at"), "SELECT id, CASE WHEN document_id = (SELECT min(document_id) FROM document WHERE deleted_at IS NOT NULL) THEN NULL ELSE deleted_at END AS deleted_at FROM document")
add("document_edited", lambda a: M.update(a.document, F.col("document_id") == least(a.live, "document_id"), title=F.lit("new title"), language=F.lit("eng"), modified_at=D.now()).select("id", "title", "language"), "SELECT id, CASE WHEN h THEN 'new title' ELSE title END AS title, CASE WHEN h THEN 'eng' ELSE language END AS language FROM (SELECT *, document_id = (SELECT min(document_id) FROM live) AS h FROM document)")
add("document_tags_cleared", lambda a: M.delete(a.document_tag, F.col("document_id") == least(a.document_tag, "document_id")), "SELECT document_id, tag_id FROM document_tag WHERE document_id <> (SELECT min(document_id) FROM document_tag)")
add("people_native_set", lambda a: M.update(a.people, F.col("id") == least(a.people), name_native=F.lit("x")).select("id", "name_native"), "SELECT id, CASE WHEN id = (SELECT min(id) FROM people) THEN 'x' ELSE name_native END AS name_native FROM persons")
add("tags_deleted", lambda a: M.delete_named(a.tag, [least(a.tag), -1], a.document_tag.select("tag_id"))[1].select("id", "code"), "SELECT (SELECT min(id) FROM tag) AS id, CASE WHEN EXISTS (SELECT 1 FROM document_tag WHERE tag_id = (SELECT min(id) FROM tag)) THEN 'Conflict' ELSE 'Deleted' END AS code UNION ALL SELECT -1, 'NotFound'")
add("saved_search_deleted", lambda a: M.delete(a.saved_search, F.col("id") == 1).select("id"), "SELECT id FROM saved_search WHERE id <> 1")
add("user_role_set", lambda a: M.update(a.user, F.col("id") == 2, role=F.lit("editor")).select("id", "role"), "SELECT id, CASE WHEN id = 2 THEN 'editor' ELSE role END AS role FROM users")

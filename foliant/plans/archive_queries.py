"""Queries over the archive's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import fts as FTS
from foliant.functions import text as T
from foliant.operators import catalog as C
from foliant.operators import dashboard as D
from foliant.operators import enrich as E
from foliant.operators import ingest as I
from foliant.operators import pipeline as P
from foliant.operators import search as S
from foliant.operators import state as M
from foliant.session import shared_dir
from foliant.sources.views import AS_OF, SQL as VIEWS, Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = f"TIMESTAMP '{AS_OF}'"


def add(name: str, f: Callable[[Archive], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, data: f(Archive(spark, data))
    if sql:
        SQL[name] = VIEWS + sql


# Search
FILTER = S.Filter(language="eng", created=("2021-01-01", "2025-06-30"), size=(1000, None), limit=100)
_WHERE = "language = 'eng' AND created_at >= TIMESTAMP '2021-01-01' AND created_at <= TIMESTAMP '2025-06-30' AND file_size >= 1000"
_PAGE = "SELECT id, title, created_at FROM live WHERE {} ORDER BY created_at DESC NULLS FIRST, id LIMIT 100"
ID = ["id", "title", "created_at"]
add("search_structured_page", lambda a: S.search(a, FILTER).select(*ID), _PAGE.format(_WHERE))
add("search_structured_count", lambda a: S.total(a, FILTER), f"SELECT count(*) AS total FROM live WHERE {_WHERE}")
add("search_sorted_by_size", lambda a: S.search(a, S.Filter(sort_by="file_size", sort_order="asc", limit=50)).select("id", "file_size"), "SELECT id, file_size FROM live ORDER BY file_size ASC NULLS LAST, id LIMIT 50")
add("search_second_page", lambda a: S.search(a, S.Filter(sort_by="nonsense", limit=25, offset=25)).select(*ID), "SELECT id, title, created_at FROM live ORDER BY created_at DESC NULLS FIRST, id LIMIT 25 OFFSET 25")
add("search_tags_any", lambda a: S.matching(a, S.Filter(tags=("swimming club", "chess tournaments", "thesis drafts", "film screenplays"))).select("id"), "SELECT id FROM live WHERE id IN (SELECT dt.document_id FROM document_tag dt JOIN tag t ON t.id = dt.tag_id WHERE t.name IN ('swimming club', 'chess tournaments', 'thesis drafts', 'film screenplays'))")
_P = "id IN (SELECT document_id FROM document_people dp JOIN persons p ON p.id = dp.people_id JOIN people_type k ON k.id = dp.people_type_id WHERE p.name = '{}' AND k.name = '{}')"


def _first_people(a: Archive) -> tuple[tuple[str, str], ...]:
    """The people (name, role) of the first live document that has any."""
    first = a.document_people.join(a.live.select(F.col("id").alias("document_id")), "document_id", "left_semi").agg(F.min("document_id")).first()[0]
    who = a.document_people.filter(F.col("document_id") == first).join(a.people.select(F.col("id").alias("people_id"), "name"), "people_id").join(a.people_type.select(F.col("id").alias("people_type_id"), F.col("name").alias("role")), "people_type_id")
    return tuple((r.name, r.role) for r in who.select("name", "role").distinct().collect())


_WHO = "SELECT DISTINCT dp.document_id, p.name, k.name AS role FROM document_people dp JOIN persons p ON p.id = dp.people_id JOIN people_type k ON k.id = dp.people_type_id"
add("search_people_all", lambda a: S.matching(a, S.Filter(people=_first_people(a))).select("id"), f", who AS ({_WHO}), asked AS (SELECT name, role FROM who WHERE document_id = (SELECT min(document_id) FROM document_people WHERE document_id IN (SELECT id FROM live))) SELECT id FROM live WHERE (SELECT count(*) FROM who w JOIN asked q ON q.name = w.name AND q.role = w.role WHERE w.document_id = live.id) = (SELECT count(*) FROM asked)")
add("search_doc_type", lambda a: S.matching(a, S.Filter(document_type="letter")).select("id"), "SELECT id FROM live WHERE document_type_id = (SELECT id FROM document_type WHERE name = 'letter')")
add("search_doc_type_unknown", lambda a: S.matching(a, S.Filter(document_type="no such type")).select("id"), "SELECT id FROM live WHERE document_type_id = (SELECT id FROM document_type WHERE name = 'no such type')")
add("search_untagged", lambda a: S.matching(a, S.Filter(untagged=True)).select("id"), "SELECT id FROM live l WHERE NOT EXISTS (SELECT 1 FROM document_tag dt WHERE dt.document_id = l.id)")
add("search_missing_language", lambda a: S.matching(a, S.Filter(missing_language=True)).select("id"), "SELECT id FROM live WHERE language IN ('und', '')")
add("search_missing_type", lambda a: S.matching(a, S.Filter(missing_type=True)).select("id"), "SELECT id FROM live WHERE document_type_id = 1")
add("search_modified_range", lambda a: S.matching(a, S.Filter(modified=(None, "2023-12-31"))).select("id"), "SELECT id FROM live WHERE modified_at <= TIMESTAMP '2023-12-31'")
add("search_from_string", lambda a: S.matching(a, S.parse_query("lang:deu size:>2kb created:2020..2024-06-30 Sonnenfinsternis")).select("id"), r"SELECT id FROM live WHERE language = 'deu' AND file_size >= 2048 AND created_at >= TIMESTAMP '2020-01-01' AND created_at <= TIMESTAMP '2024-06-30' AND list_contains(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(text_content, '')), '[^\p{L}\p{N}]+'), 'sonnenfinsternis')")
_TOK = r"regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(text_content, '')), '[^\p{L}\p{N}]+')"
_FTS = f"SELECT id, {_TOK} AS w FROM live"
add("fts_match", lambda a: S.matching(a, S.Filter(query="Planetary orbit")).select("id"), f"SELECT id FROM ({_FTS}) WHERE list_contains(w, 'planetary') AND list_contains(w, 'orbit')")
add("fts_match_count", lambda a: S.total(a, S.Filter(query="orchestra")), f"SELECT count(*) AS total FROM ({_FTS}) WHERE list_contains(w, 'orchestra')")
_RANK = "round(round(list_sum(list_transform(range(1, least(n, 256) + 1), lambda k: 1.0 / (k * k))) * 0.1 / 1.64493406685, 12), 6)"
add("fts_ranked", lambda a: S.search(a, S.Filter(query="orchestra", limit=100)).select("id", "rank"), f"SELECT id, {_RANK} AS rank FROM (SELECT id, len(list_filter(w, lambda x: x = 'orchestra')) AS n FROM ({_FTS})) WHERE n > 0 ORDER BY rank, id LIMIT 100")
_PAIR = """SELECT id, round(1 - exp(sum(ln(1 - 0.1 * sqrt(CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(d / 1.5 - 2)) END)))), 6) AS rank FROM (
SELECT x.id, abs(x.pos - y.pos)::DOUBLE AS d FROM place x JOIN place y ON x.id = y.id WHERE x.t = 'planetary' AND y.t = 'orbit' AND x.k <= 256 AND y.k <= 256) GROUP BY id ORDER BY rank DESC, id LIMIT 100"""
_PLACES = f", place AS (SELECT id, t, pos, row_number() OVER (PARTITION BY id, t ORDER BY pos) AS k FROM (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM ({_FTS})) WHERE t IN ('planetary', 'orbit')) "
_TWO = S.Filter(query="planetary orbit", rank_order="desc", limit=100)
add("fts_ranked_two", lambda a: S.search(a, _TWO).select("id", "rank"), _PLACES + _PAIR)


def indexed(a: Archive) -> Archive:
    """The archive with the inverted table of its live documents, built once for each session and directory."""
    key = (a.spark.sparkContext.applicationId, a.data)
    if key not in _INDEXES:
        path = f"{shared_dir(a.spark).rstrip('/')}/lexemes-{uuid.uuid4().hex}"
        FTS.write_index(a.live, path, "id", FTS.index_text(F.col("title"), F.col("text_content")))
        _INDEXES[key] = path
    return Archive(a.spark, a.data, _INDEXES[key])


_INDEXES: dict[tuple[str, str], str] = {}
add("fts_index_match", lambda a: S.matching(indexed(a), S.Filter(query="Planetary orbit")).select("id"), SQL["fts_match"][len(VIEWS):])
add("fts_index_ranked", lambda a: S.search(indexed(a), S.Filter(query="orchestra", limit=100)).select("id", "rank"), SQL["fts_ranked"][len(VIEWS):])
add("fts_index_ranked_two", lambda a: S.search(indexed(a), _TWO).select("id", "rank"), _PLACES + _PAIR)
add("fts_snippet", lambda a: S.search(a, S.Filter(query="orchestra", limit=100, rank_order="desc"), snippets=True).select("id", T.sanitize_snippet(F.col("snippet")).alias("snippet")))
add("search_with_labels", lambda a: S.with_labels(a, S.search(a, FILTER)).select("id", "tags"), f"SELECT p.id, coalesce((SELECT list(DISTINCT t.name ORDER BY t.name) FROM document_tag dt JOIN tag t ON t.id = dt.tag_id WHERE dt.document_id = p.id), []) AS tags FROM ({_PAGE.format(_WHERE)}) p")
add("suggest_tags", lambda a: S.suggest(a, "tag", "film"), "SELECT DISTINCT 'tag' AS field, name AS value FROM tag WHERE starts_with(name, 'film') ORDER BY value LIMIT 10")

# Dashboard
add("original_type_breakdown", D.original_type_breakdown, "SELECT original_type, count(*) AS count, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM live GROUP BY 1")
add("type_breakdown_top7", D.type_breakdown_top, "SELECT CASE WHEN rn > 7 THEN 'other' ELSE original_type END AS original_type, sum(count)::BIGINT AS count, sum(bytes)::BIGINT AS bytes FROM (SELECT *, row_number() OVER (ORDER BY bytes DESC, original_type NULLS LAST) AS rn FROM (SELECT original_type, count(*) AS count, coalesce(sum(file_size), 0) AS bytes FROM live GROUP BY 1)) GROUP BY 1")
_DAILY = "SELECT created_at::DATE AS day, count(*) AS count, coalesce(sum(file_size), 0)::BIGINT AS bytes FROM live WHERE created_at IS NOT NULL GROUP BY 1"
add("storage_trend_daily", D.storage_trend_daily, _DAILY)
add("storage_trend_cumulative", D.storage_trend_cumulative, f"SELECT day, bytes, (sum(bytes) OVER (ORDER BY day))::BIGINT AS cumulative_bytes FROM ({_DAILY})")
add("language_distribution", D.language_distribution, "SELECT language, count(*) AS count FROM live WHERE language NOT IN ('und', '') GROUP BY 1 ORDER BY count DESC, language LIMIT 10")
add("document_type_distribution", D.document_type_distribution, "SELECT t.name, count(*) AS count FROM live d JOIN document_type t ON t.id = d.document_type_id WHERE d.document_type_id <> 1 GROUP BY t.id, t.name")
add("tag_frequency", D.tag_frequency, "SELECT t.name, count(*) AS count FROM document_tag dt JOIN live d ON d.id = dt.document_id JOIN tag t ON t.id = dt.tag_id GROUP BY t.name ORDER BY count DESC, t.name LIMIT 10")
add("missing_counts", D.missing_counts, "SELECT (SELECT count(*) FROM live WHERE language IN ('und', '')) AS missing_language, (SELECT count(*) FROM live WHERE document_type_id = 1) AS missing_type, (SELECT count(*) FROM live l WHERE NOT EXISTS (SELECT 1 FROM document_tag dt WHERE dt.document_id = l.id)) AS missing_tags")
add("task_success_rate", D.task_success_rate, f"SELECT completed, failed, CASE WHEN completed + failed = 0 THEN 0.0 ELSE round(completed / (completed + failed), 6) END AS success_rate FROM (SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM tasks WHERE completed_at >= {NOW} - INTERVAL 7 DAY)")
add("avg_task_duration_ms", D.avg_task_duration_ms, f"SELECT round(coalesce(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1000.0), 0))::BIGINT AS avg_duration_ms FROM tasks WHERE status = 'completed' AND started_at IS NOT NULL AND completed_at >= {NOW} - INTERVAL 7 DAY")
add("document_aggregates", D.document_aggregates, "SELECT documents, bytes, pages, words, CASE WHEN documents = 0 THEN 0 ELSE bytes // documents END AS avg_file_size, round(bytes / 1073741824.0, 6) AS gb FROM (SELECT count(*) AS documents, coalesce(sum(file_size), 0)::BIGINT AS bytes, coalesce(sum(page_count), 0)::BIGINT AS pages, coalesce(sum(word_count), 0)::BIGINT AS words FROM live)")
_EVENTS = """SELECT 'document_uploaded' AS event_type, created_at AS event_time, title, '' AS path, document_id AS ref_id, '' AS batch_id, '' AS task_id FROM live
UNION ALL SELECT CASE WHEN status = 'completed' THEN 'task_completed' ELSE 'task_failed' END, completed_at, coalesce(json_extract_string(payload, '$.file_name'), ''), coalesce(json_extract_string(payload, '$.file_path'), ''), coalesce(json_extract_string(payload, '$.document_id'), ''), coalesce(batch_id, ''), task_id FROM tasks WHERE status IN ('completed', 'failed') AND completed_at IS NOT NULL
UNION ALL SELECT 'batch_created', created_at, source, '', id, id, '' FROM batches"""
add("activity_timeline", D.activity_timeline, f"SELECT event_type, event_time, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) WHEN path <> '' THEN regexp_extract(trim(path), '([^/]+)/*$', 1) ELSE task_id END AS title, CASE event_type WHEN 'document_uploaded' THEN '/documents/' || ref_id WHEN 'batch_created' THEN '/tasks?batch=' || batch_id ELSE '/tasks/' || task_id END AS link FROM (SELECT * FROM ({_EVENTS}) WHERE event_time IS NOT NULL ORDER BY event_time DESC, event_type, ref_id, task_id LIMIT 30)")
_ST = ["waiting", "pending", "processing", "completed", "failed", "cancelled", "discarded"]
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in _ST)
_OVER = f"""SELECT b.id AS batch_id, b.source, b.status, b.created_at, coalesce(total, 0) AS total, {", ".join(f"coalesce({s}, 0) AS {s}" for s in _ST)},
CASE WHEN o.last_heartbeat IS NULL THEN 'none' WHEN o.last_heartbeat > {NOW} - INTERVAL 15 SECOND THEN 'live' ELSE 'stale' END AS owner_state, first_started_at, last_completed_at
FROM batches b LEFT JOIN (SELECT batch_id, count(*) AS total, {_COUNTS}, min(started_at) AS first_started_at, max(completed_at) AS last_completed_at FROM tasks WHERE batch_id IS NOT NULL GROUP BY 1) t ON t.batch_id = b.id LEFT JOIN batch_owner o ON o.batch_id = b.id"""
_OVERVIEW = f"SELECT * EXCLUDE (first_started_at, last_completed_at), owner_state <> 'live' AND (pending > 0 OR processing > 0) AS orphaned, CASE WHEN waiting + pending + processing = 0 AND first_started_at IS NOT NULL AND last_completed_at IS NOT NULL THEN floor((epoch_us(last_completed_at) - epoch_us(first_started_at)) / 1000)::BIGINT END AS duration_ms FROM ({_OVER})"
add("batch_overview", D.batch_overview, _OVERVIEW)
add("batch_summary", D.batch_summaries, f"SELECT t.*, b.source, b.status AS batch_status FROM (SELECT batch_id, count(*) AS total, {_COUNTS}, max(created_at) AS newest FROM tasks WHERE batch_id IS NOT NULL GROUP BY 1) t JOIN batches b ON b.id = t.batch_id")
add("batch_ids_recent", D.batch_ids_recent, "SELECT batch_id, max(created_at) AS newest FROM tasks WHERE batch_id IS NOT NULL GROUP BY 1 ORDER BY newest DESC NULLS LAST, batch_id LIMIT 20")
add("batch_ids_recent_failed", lambda a: D.batch_ids_recent(a, 20, "failed"), "SELECT batch_id, max(created_at) AS newest FROM tasks WHERE batch_id IS NOT NULL AND status = 'failed' GROUP BY 1 ORDER BY newest DESC NULLS LAST, batch_id LIMIT 20")
add("orphaned_batches", D.orphaned_batches, f"SELECT count(*) AS orphaned FROM ({_OVERVIEW}) WHERE orphaned")
add("tasks_by_status", D.tasks_by_status, "SELECT status, count(*) AS count FROM tasks GROUP BY 1")
add("status_shares", D.status_shares, "SELECT status, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM tasks WHERE status <> 'waiting' GROUP BY 1")
add("distinct_batches", D.distinct_batches, "SELECT count(DISTINCT batch_id) AS batches FROM tasks")
add("active_batches", D.active_batch_ids, "SELECT DISTINCT batch_id FROM tasks WHERE status IN ('pending', 'processing', 'waiting') AND batch_id IS NOT NULL")
add("distinct_languages", D.distinct_languages, "SELECT DISTINCT language FROM live WHERE language IS NOT NULL AND language <> ''")
add("batch_terminal_status", D.batch_terminal_status, "SELECT b.id AS batch_id, CASE WHEN b.status IN ('completed', 'failed', 'cancelled', 'paused') THEN b.status WHEN coalesce(failed, false) THEN 'failed' ELSE 'completed' END AS final_status FROM batches b LEFT JOIN (SELECT batch_id, bool_or(status = 'failed') AS failed FROM tasks WHERE batch_id IS NOT NULL GROUP BY 1) t ON t.batch_id = b.id")
add("progress_totals", D.progress_totals, "SELECT batch_id, CASE WHEN max(try_cast(json_extract_string(payload, '$.file_index') AS INTEGER)) > 0 THEN max(try_cast(json_extract_string(payload, '$.file_index') AS INTEGER)) ELSE count(*) END::BIGINT AS files FROM tasks WHERE task_type = 'consume' AND batch_id IS NOT NULL GROUP BY 1")

# Catalog
add("tags_with_count", C.tags_with_count, "SELECT t.id, t.name, t.created_at, count(dt.document_id) AS document_count FROM tag t LEFT JOIN document_tag dt ON dt.tag_id = t.id GROUP BY ALL")
add("people_with_count", C.people_with_count, "SELECT p.id, p.name, count(dp.document_id) AS document_count FROM persons p LEFT JOIN document_people dp ON dp.people_id = p.id GROUP BY ALL")
add("doc_types_with_count", C.types_with_count, "SELECT t.id, t.name, count(d.id) AS document_count FROM document_type t LEFT JOIN live d ON d.document_type_id = t.id GROUP BY ALL")
add("tags_prefix", lambda a: C.named(a.tag, "film").select("id", "name"), "SELECT id, name FROM tag WHERE name LIKE 'film%'")
add("people_prefix_count", lambda a: C.counted(a.people.filter(T.like_prefix(F.col("name"), "O"))), "SELECT count(*) AS count FROM persons WHERE name LIKE 'O%'")
add("tasks_filtered", lambda a: C.tasks(a, status="failed", task_type="consume", limit=50).select("id", "created_at"), "SELECT id, created_at FROM tasks WHERE status = 'failed' AND task_type = 'consume' ORDER BY created_at DESC NULLS FIRST, id LIMIT 50")
add("tasks_all_of_status", lambda a: C.tasks(a, status="processing").select("id", "task_type", "batch_id"), "SELECT id, task_type, batch_id FROM tasks WHERE status = 'processing'")
add("processing_tasks", C.processing_tasks, "SELECT count(*) AS count FROM tasks WHERE status = 'processing' AND task_type IN ('consume', 'enrich')")
add("document_details", lambda a: C.document_details(a, F.col("page_count") > 3).select("id", "title", "document_type"), "SELECT d.id, d.title, t.name AS document_type FROM live d LEFT JOIN document_type t ON t.id = d.document_type_id WHERE d.page_count > 3")
add("titles_like", lambda a: C.titles_like(a, "The %", 50).select("id", "title"), "SELECT id, title FROM live WHERE title LIKE 'The %' ORDER BY created_at DESC NULLS FIRST, id LIMIT 50")
add("trash_listing", lambda a: C.trash(a, 50).select("id", "deleted_at"), "SELECT id, deleted_at FROM document WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, id LIMIT 50")
add("trash_count", lambda a: C.counted(a.trash), "SELECT count(*) AS count FROM document WHERE deleted_at IS NOT NULL")
add("tag_documents", lambda a: C.tag_documents(a, 1).select("id"), "SELECT id FROM live WHERE id IN (SELECT document_id FROM document_tag WHERE tag_id = 1)")
add("people_documents", lambda a: C.people_documents(a, 1).select("id"), "SELECT id FROM document WHERE id IN (SELECT document_id FROM document_people WHERE people_id = 1)")
add("document_people_roles", lambda a: C.document_people(a, 5).select("people_id", "name", "role"), "SELECT dp.people_id, p.name, k.name AS role FROM document_people dp JOIN persons p ON p.id = dp.people_id JOIN people_type k ON k.id = dp.people_type_id WHERE dp.document_id = 5")
add("latest_task_by_key", lambda a: C.latest_by_key(a, "consume"), "SELECT dedup_key, x.id AS id, x.status AS status FROM (SELECT dedup_key, max({'c': created_at, 'id': id, 'status': status}) AS x FROM (SELECT * FROM tasks WHERE task_type = 'consume' AND dedup_key IS NOT NULL AND created_at IS NOT NULL) GROUP BY 1)")
add("recent_tasks", lambda a: C.recent_tasks(a, "consume", 60 * 24 * 30, D.now()), f"SELECT count(*) AS count FROM tasks WHERE task_type = 'consume' AND created_at > {NOW} - INTERVAL 30 DAY")
add("last_completed", lambda a: C.last_completed(a, "enrich"), "SELECT max(completed_at) AS completed_at FROM tasks WHERE task_type = 'enrich' AND status = 'completed'")

# State
_ROW = ["id", "status", "attempts", "error"]
add("claim_next", lambda a: M.next_pending(a.task, "consume").select("id"), "SELECT id FROM tasks WHERE status = 'pending' AND task_type = 'consume' ORDER BY created_at NULLS LAST, id LIMIT 1")
add("claim_next_gate_closed", lambda a: M.next_pending(a.task, "consume", gate_closed=True).select("id"), "SELECT id FROM tasks WHERE false")
add("claim_next_of_owner", lambda a: M.next_pending(a.task, "enrich", a.batch_owner).select("id"), "SELECT id FROM tasks WHERE status = 'pending' AND task_type = 'enrich' AND batch_id IN (SELECT batch_id FROM batch_owner) ORDER BY created_at NULLS LAST, id LIMIT 1")
add("stale_owners", lambda a: M.stale_owners(a.batch_owner, a.task, D.now()).select("batch_id", "owner_id"), f"SELECT batch_id, owner_id FROM batch_owner o WHERE last_heartbeat < {NOW} - INTERVAL 15 SECOND AND EXISTS (SELECT 1 FROM tasks t WHERE t.batch_id = o.batch_id AND t.status IN ('pending', 'processing', 'waiting'))")
add("cleanup_owners", lambda a: M.cleanup_owners(a.batch_owner, a.task).select("batch_id"), "SELECT batch_id FROM batch_owner o WHERE EXISTS (SELECT 1 FROM tasks t WHERE t.batch_id = o.batch_id AND t.status IN ('waiting', 'pending', 'processing'))")
_OLD = f"status = 'processing' AND started_at < {NOW} - INTERVAL 600 SECOND"
add("reclaim_stale", lambda a: M.reclaim_stale(a.task, D.now(), most=2).select(*_ROW), f"SELECT id, CASE WHEN {_OLD} AND attempts >= 2 THEN 'failed' WHEN {_OLD} THEN 'pending' ELSE status END AS status, CASE WHEN {_OLD} AND attempts < 2 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN {_OLD} AND attempts >= 2 THEN 'Max retries exceeded (' || attempts || ')' ELSE error END AS error FROM tasks")
add("retry_failed", lambda a: M.retry(a.task, F.col("batch_id").isNotNull()).select(*_ROW), "SELECT id, CASE WHEN f THEN 'pending' ELSE status END AS status, CASE WHEN f THEN 0 ELSE attempts END AS attempts, CASE WHEN f THEN NULL ELSE error END AS error FROM (SELECT *, status = 'failed' AND batch_id IS NOT NULL AS f FROM tasks)")
_HIT = "task_type = 'enrich' AND status = '{}' AND task_id IN (SELECT json_extract_string(payload, '$.on_completed') FROM tasks WHERE task_type = 'consume' AND status = '{}')"
add("discard_waiting", lambda a: M.discard_waiting(a.task).select("id", "status"), f"SELECT id, CASE WHEN {_HIT.format('waiting', 'failed')} THEN 'discarded' ELSE status END AS status FROM tasks")
add("restore_discarded", lambda a: M.restore_discarded(M.retry(a.task, F.lit(True))).select("id", "status"), "SELECT id, CASE WHEN task_type = 'enrich' AND status = 'discarded' AND task_id IN (SELECT json_extract_string(payload, '$.on_completed') FROM tasks WHERE task_type = 'consume' AND status IN ('pending', 'failed')) THEN 'waiting' WHEN status = 'failed' THEN 'pending' ELSE status END AS status FROM tasks")
add("cancel_batch", lambda a: M.cancel(a.task, a.batch.agg(F.min("id")).first()[0], D.now()).select("id", "status"), "SELECT id, CASE WHEN batch_id = (SELECT min(id) FROM batches) AND status IN ('pending', 'processing') THEN 'cancelled' ELSE status END AS status FROM tasks")
add("purge_expired", lambda a: M.purge_expired(a.document, 30, D.now()).select("id"), f"SELECT id FROM document WHERE deleted_at IS NULL OR deleted_at >= {NOW} - INTERVAL 30 DAY")
add("purge_cascade", lambda a: M.cascade(a.document_tag, M.purge_expired(a.document, 30, D.now())), f"SELECT document_id, tag_id FROM document_tag WHERE document_id IN (SELECT id FROM document WHERE deleted_at IS NULL OR deleted_at >= {NOW} - INTERVAL 30 DAY)")

# Ingest
add("duplicate_documents", lambda a: I.same_content(a.document), "SELECT d.id, g.first_id, g.copies FROM document d JOIN (SELECT md5_checksum, min(id) AS first_id, count(*) AS copies FROM document WHERE md5_checksum IS NOT NULL GROUP BY 1 HAVING count(*) > 1) g ON g.md5_checksum = d.md5_checksum WHERE d.id > g.first_id")
_FILES = "SELECT '/in/' || doc_id || '.txt' AS path, md5(text) AS md5 FROM documents"


def _corpus_files(a: Archive) -> DataFrame:
    return a._t("documents").select(F.concat(F.lit("/in/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.md5("text").alias("md5"))


add("scan_dedup", lambda a: I.new_files(_corpus_files(a), a.document), f"SELECT md5, min(path) AS path FROM ({_FILES}) WHERE md5 NOT IN (SELECT md5_checksum FROM document WHERE md5_checksum IS NOT NULL) GROUP BY 1")
add("orphan_files", lambda a: I.orphan_files(a.document.select(F.concat(F.lit("/store/"), "document_id", F.lit(".pdf")).alias("path")), a.live), "SELECT '/store/' || document_id || '.pdf' AS path, document_id AS key, 'uuid' AS key_type FROM document WHERE deleted_at IS NOT NULL AND document_id NOT IN (SELECT document_id FROM live)")
add("needs_ocr", lambda a: a.live.filter(I.needs_ocr(F.col("text_content"), F.col("file_size"), F.col("original_type"))).select("id"), "SELECT id FROM live WHERE coalesce(text_content, '') = '' OR (original_type = 'application/pdf' AND octet_length(encode(text_content)) / greatest(file_size, 1) < 0.001)")


def flagship(spark: SparkSession, data: str) -> DataFrame:
    return S.search(Archive(spark, data), S.parse_query("lang:eng created:2020.. size:>1kb".replace("2020..", ">2020")))


# Links and gates
add("assign_tags", lambda a: P.assign_tags(a.document_tag, a.live, a.document.filter("document_type_id = 7").select(F.col("id").alias("document_id")), a.tag.filter("name = 'swimming club'").select(F.col("id").alias("tag_id")))[0], "SELECT document_id, tag_id FROM document_tag UNION SELECT l.id, t.id FROM live l, tag t WHERE l.document_type_id = 7 AND t.name = 'swimming club'")
add("replace_tags", lambda a: P.assign_tags(a.document_tag, a.live, a.document.filter("document_type_id = 7").select(F.col("id").alias("document_id")), a.tag.filter("name = 'swimming club'").select(F.col("id").alias("tag_id")), True)[0], "SELECT document_id, tag_id FROM document_tag WHERE document_id NOT IN (SELECT id FROM live WHERE document_type_id = 7) UNION SELECT l.id, t.id FROM live l, tag t WHERE l.document_type_id = 7 AND t.name = 'swimming club'")
_LIVE = f"(SELECT count(*) FROM batch_owner WHERE last_heartbeat > {NOW} - INTERVAL 15 SECOND)"
add("admit_batches", lambda a: P.admit(a.batch, a.batch_owner.filter("pid % 9 = 0"), D.now(), 40).select("id"), "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY created_at NULLS LAST, id) AS rn FROM batches WHERE status = 'queued') WHERE rn <= 40 - " + _LIVE.replace("WHERE", "WHERE pid % 9 = 0 AND"))
add("document_tag_insert", lambda a: M.insert_absent(a.document_tag, a.document.select(F.col("id").alias("document_id"), F.lit(1).cast("long").alias("tag_id")), ["document_id", "tag_id"]), "SELECT document_id, tag_id FROM document_tag UNION SELECT id, 1 FROM document")
_AGAIN = "SELECT 'again-' || task_id AS task_id, task_type, dedup_key FROM tasks WHERE status IN ('pending', 'completed')"
add(
    "task_enqueue_dedup",
    lambda a: M.enqueue(a.task, a.task.filter("status in ('pending', 'completed')").withColumns({"task_id": F.concat(F.lit("again-"), "task_id"), "status": F.lit("pending")})).select("id", "task_id", "task_type", "status"),
    f"""SELECT id, task_id, task_type, status FROM tasks UNION ALL
SELECT (SELECT max(id) FROM tasks) + row_number() OVER (ORDER BY task_id), task_id, task_type, 'pending' FROM (
SELECT task_id, task_type, dedup_key, row_number() OVER (PARTITION BY task_type, dedup_key ORDER BY task_id) AS rn FROM ({_AGAIN})) n
WHERE (dedup_key IS NULL OR rn = 1) AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.status IN ('pending', 'processing') AND t.task_type = n.task_type AND t.dedup_key = n.dedup_key)""",
)
add("quarantined_tasks", lambda a: M.quarantined(M.reclaim_stale(a.task, D.now(), most=2)).select("task_id", "batch_id"), f"SELECT task_id, batch_id FROM tasks WHERE {_OLD} AND attempts >= 2 UNION ALL SELECT task_id, batch_id FROM tasks WHERE NOT ({_OLD} AND attempts >= 2) AND status = 'failed' AND error LIKE 'Max retries exceeded%'")
_STALE = f"(SELECT batch_id FROM batch_owner o WHERE last_heartbeat < {NOW} - INTERVAL 15 SECOND AND EXISTS (SELECT 1 FROM tasks t WHERE t.batch_id = o.batch_id AND t.status IN ('pending', 'processing', 'waiting')))"
add("reclaim_batches_tasks", lambda a: M.reclaim_batches(a.task, a.batch, a.batch_owner, D.now(), 1)[0].select("id", "status", "attempts"), f"SELECT id, CASE WHEN s AND attempts >= 1 THEN 'failed' WHEN s THEN 'pending' ELSE status END AS status, CASE WHEN s AND attempts < 1 THEN attempts + 1 ELSE attempts END AS attempts FROM (SELECT *, status = 'processing' AND coalesce(batch_id IN {_STALE}, false) AS s FROM tasks)")
add("reclaim_batches_status", lambda a: M.reclaim_batches(a.task, a.batch, a.batch_owner, D.now(), 1)[1].select("id", "status"), f"SELECT id, CASE WHEN id NOT IN {_STALE} THEN status WHEN EXISTS (SELECT 1 FROM tasks t WHERE t.batch_id = b.id AND (t.status IN ('waiting', 'pending') OR (t.status = 'processing' AND attempts < 1))) THEN 'queued' ELSE 'failed' END AS status FROM batches b")
add("reclaim_batches_owners", lambda a: M.reclaim_batches(a.task, a.batch, a.batch_owner, D.now(), 1)[2].select("batch_id", "owner_id"), f"SELECT batch_id, owner_id FROM batch_owner WHERE batch_id NOT IN {_STALE}")
_FIRST = "(SELECT min(id) FROM tasks WHERE status = '{}')"
_first = lambda a, status: a.task.filter(F.col("status") == status).agg(F.min("id")).first()[0] or 0
add("task_claim", lambda a: M.claim(a.task, _first(a, "pending"), D.now()).select("id", "status", "started_at"), f"SELECT id, CASE WHEN id = {_FIRST.format('pending')} THEN 'processing' ELSE status END AS status, CASE WHEN id = {_FIRST.format('pending')} THEN {NOW} ELSE started_at END AS started_at FROM tasks")
add("task_complete", lambda a: M.complete(a.task, _first(a, "processing"), "{}", D.now()).select("id", "status", "result", "error", "attempts"), f"SELECT id, CASE WHEN h THEN 'completed' ELSE status END AS status, CASE WHEN h THEN '{{}}' ELSE result END AS result, CASE WHEN h THEN NULL ELSE error END AS error, CASE WHEN h THEN 0 ELSE attempts END AS attempts FROM (SELECT *, id = {_FIRST.format('processing')} AS h FROM tasks)")
add("task_fail", lambda a: M.fail(a.task, _first(a, "processing"), "broken", D.now()).select("id", "status", "error"), f"SELECT id, CASE WHEN h THEN 'failed' ELSE status END AS status, CASE WHEN h THEN 'broken' ELSE error END AS error FROM (SELECT *, id = {_FIRST.format('processing')} AS h FROM tasks)")
add("lease_acquire", lambda a: M.acquire_owner(a.batch_owner, a.batch.agg(F.max("id")).first()[0], "me", 7, D.now()).select("batch_id", "owner_id", "pid"), f"SELECT batch_id, CASE WHEN batch_id = m AND last_heartbeat < {NOW} - INTERVAL 15 SECOND THEN 'me' ELSE owner_id END AS owner_id, CASE WHEN batch_id = m AND last_heartbeat < {NOW} - INTERVAL 15 SECOND THEN 7 ELSE pid END AS pid FROM batch_owner, (SELECT max(id) AS m FROM batches) UNION ALL SELECT m, 'me', 7 FROM (SELECT max(id) AS m FROM batches) WHERE m NOT IN (SELECT batch_id FROM batch_owner)")
add("lease_release", lambda a: M.release_owner(a.batch_owner, a.batch.agg(F.min("id")).first()[0]).select("batch_id"), "SELECT batch_id FROM batch_owner WHERE batch_id <> (SELECT min(id) FROM batches)")
add("tag_rename", lambda a: M.rename(a.tag, a.tag.agg(F.min("id")).first()[0], "a name of its own")[0].select("id", "name"), "SELECT id, CASE WHEN id = (SELECT min(id) FROM tag) THEN 'a name of its own' ELSE name END AS name FROM tag")
add("tags_created", lambda a: M.create_named(a.tag, ["zz new", "zz new", " zz other ", ""], D.now())[0].select("id", "name"), "SELECT id, name FROM tag UNION ALL SELECT (SELECT max(id) FROM tag) + 1, 'zz new' UNION ALL SELECT (SELECT max(id) FROM tag) + 2, 'zz other'")
add("duplicates_both_hashes", lambda a: I.duplicates(a.document.select(F.col("original_path").alias("path"), F.col("md5_checksum").alias("md5"), F.col("sha512_checksum").alias("sha512")), a.live), "SELECT d.original_path AS path, min(l.id) AS document_id FROM document d JOIN live l ON l.md5_checksum = d.md5_checksum AND l.sha512_checksum = d.sha512_checksum GROUP BY 1")
add(
    "people_links",
    lambda a: E.upsert_people(a.people, a.live.select(F.col("id").alias("document_id"), F.concat(F.lit("New Person "), F.char((F.col("id") % 5 + 65).cast("int")), F.lit("x")).alias("name"), F.lit("").alias("native"), F.when(F.col("id") % 2 == 0, "author").otherwise("stranger").alias("role")), D.now())[1],
    "SELECT DISTINCT id AS document_id, (SELECT max(id) FROM people) + 1 + id % 5 AS people_id, CASE WHEN id % 2 = 0 THEN 'author' ELSE 'unknown' END AS role FROM live",
)
add("sizes_and_durations", lambda a: a.live.filter("file_size is not null").select("id", T.format_bytes(F.col("file_size")).alias("bytes"), T.format_size(F.col("file_size")).alias("size"), T.human_duration(F.col("file_size")).alias("duration")), """SELECT id,
CASE WHEN file_size >= 1073741824 THEN printf('%.1f GiB', file_size / 1073741824) WHEN file_size >= 1048576 THEN printf('%.1f MiB', file_size / 1048576) WHEN file_size >= 1024 THEN printf('%.1f KiB', file_size / 1024) ELSE printf('%d B', file_size) END AS bytes,
CASE WHEN file_size >= 1073741824 THEN printf('%.1f GB', file_size / 1073741824) WHEN file_size >= 1048576 THEN printf('%.1f MB', file_size / 1048576) WHEN file_size >= 1024 THEN printf('%.1f KB', file_size / 1024) ELSE printf('%d B', file_size) END AS size,
CASE WHEN file_size < 60000 THEN printf('%.1fs', file_size / 1000) WHEN file_size < 3600000 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm %ds', s // 3600, s // 60 % 60, s % 60) END AS duration
FROM (SELECT *, round(file_size / 1000)::BIGINT AS s FROM live) WHERE file_size IS NOT NULL""")
add("saved_search_newest", lambda a: C.newest(a.saved_search, limit=5).select("id", "name"), "SELECT id, name FROM saved_search ORDER BY created_at DESC, id LIMIT 5")
add("saved_search_run", lambda a: S.matching(a, S.saved(a.saved_search, 2)).select("id"), "SELECT id FROM live WHERE language = 'deu' AND file_size >= 1000")
add("user_by_name", lambda a: C.by(a.user, username="reader").select("id", "username", "role"), "SELECT id, username, role FROM users WHERE username = 'reader'")
add("users_by_role", lambda a: a.user.groupBy("role").agg(F.count(F.lit(1)).alias("users")), "SELECT role, count(*) AS users FROM users GROUP BY 1")

"""Schemas of the archive's tables and records, as DDL (readers and createDataFrame take it as it is)."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "document_type": "id long, name string, description string, created_at timestamp",
    "people_type": "id long, name string, description string, created_at timestamp",
    "people": "id long, name string, name_native string, normalized_name string, created_at timestamp",
    "tag": "id long, name string, created_at timestamp",
    "user": "id long, username string, password_hash string, api_key_hash string, api_key_prefix string, api_key_created_at timestamp, role string, created_at timestamp",
    "task": "id long, task_id string, task_type string, status string, batch_id string, payload string, result string, dedup_key string, created_at timestamp, started_at timestamp, completed_at timestamp, error string, attempts int",
    "document": "id long, document_id string, title string, md5_checksum string, sha512_checksum string, original_type string, file_size long, page_count int, word_count int, char_count int, language string, created_at timestamp, modified_at timestamp, document_type_id long, original_path string, storage_path string, text_content string, deleted_at timestamp",
    "document_people": "document_id long, people_id long, people_type_id long",
    "document_tag": "document_id long, tag_id long",
    "saved_search": "id long, name string, filter_json string, created_at timestamp",
    "batch": "id string, source string, status string, created_at timestamp",
    "batch_owner": "batch_id string, owner_id string, pid long, acquired_at timestamp, last_heartbeat timestamp",
    "orphaned_file": "id long, document_key string, key_type string, file_path string, original_path string, source_dir string, file_size long, original_type string, detected_at timestamp, status string, action_at timestamp, action_type string",
    "backup_lock": "id long, running boolean, started_at timestamp",
}

TASK_STATUSES = ["waiting", "pending", "processing", "completed", "failed", "cancelled", "discarded"]
BATCH_STATUSES = ["queued", "processing", "completed", "failed", "paused", "cancelled"]
OWNER_STALE_SECONDS = 15

CONSUME_PAYLOAD = "file_path string, file_index int, on_completed string, document_id string"
ENRICH_PAYLOAD = "waiting_for string, file_name string, file_index int, document_id string"
CONSUME_RESULT = "document_db_id long, storage_path string, document_id string"
FILTER = (
    "query string, tags array<string>, people array<struct<name: string, type: string>>, document_type string, language string, date_created struct<`from`: string, `to`: string>, "
    "date_modified struct<`from`: string, `to`: string>, file_size struct<`min`: long, `max`: long>, sort_by string, sort_order string, limit int, offset int, missing_language boolean, missing_type boolean, untagged boolean"
)
ANALYSIS = "title string, type string, tags array<string>, people array<struct<name: string, name_romanized: string, type: string>>, language string"

# The roles a person can have in a document, in seed order.
PEOPLE_TYPES = "author sender recipient signatory correspondent subject contact client supplier employee legal_representative beneficiary witness other unknown".split()
# Types, extensions and aliases of files taken in.
MIME_TYPES = {
    "application/pdf": ".pdf", "image/jpeg": ".jpg", "image/png": ".png", "image/tiff": ".tiff",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.oasis.opendocument.text": ".odt",
}
EXTENSION_ALIASES = {".tif": ".tiff", ".jpeg": ".jpg"}

"""The archive's tables, as views over a data directory.

Repeated deliveries are reduced to one row before anything else sees them. Tables that the directory does not hold are derived by fixed rules, given
here once for Spark and once (SQL) for the check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.schemas import PEOPLE_TYPES
from foliant.sources.tables import table


def _one_row(df: DataFrame) -> DataFrame:
    """Repeated deliveries as one row an id, with the greatest value of each column; only the columns that a query uses are carried."""
    return df.groupBy("id").agg(*[F.max(c).alias(c) for c in df.columns if c != "id"])


AS_OF = "2025-12-31 00:00:00"


SAVED = [
    (1, "recent letters", '{"document_type":"letter","sort_by":"created_at","sort_order":"desc"}', "2025-01-01 00:00:00"),
    (2, "german", '{"language":"deu","file_size":{"min":1000}}', "2025-02-01 00:00:00"),
    (3, "orchestra", '{"query":"orchestra","limit":100}', "2025-03-01 00:00:00"),
]
USERS = [(1, "admin", "admin", "2024-01-01 00:00:00"), (2, "reader", "viewer", "2024-02-01 00:00:00"), (3, "editor", "editor", "2024-03-01 00:00:00")]


@dataclass
class Archive:
    """The tables of one archive; each attribute is lazy."""

    spark: SparkSession
    data: str
    index: str = ""  # where the inverted table of the live documents' lexemes lies, if there is one

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.data, name)

    @property
    def document(self) -> DataFrame:
        return self._t("archive_document")

    @property
    def live(self) -> DataFrame:
        return self.document.filter("deleted_at is null")

    @property
    def trash(self) -> DataFrame:
        return self.document.filter("deleted_at is not null")

    @property
    def document_type(self) -> DataFrame:
        return self._t("document_type")

    @property
    def tag(self) -> DataFrame:
        return self._t("tag")

    @property
    def task(self) -> DataFrame:
        return _one_row(self._t("task"))

    @property
    def batch(self) -> DataFrame:
        return self._t("batch").groupBy("id").agg(F.max("source").alias("source"), F.max("status").alias("status"), F.min("created_at").alias("created_at"))

    @property
    def people(self) -> DataFrame:
        return _one_row(self._t("people"))

    @property
    def people_type(self) -> DataFrame:
        return self.spark.createDataFrame([(i + 1, n) for i, n in enumerate(PEOPLE_TYPES)], "id long, name string")

    @property
    def saved_search(self) -> DataFrame:
        rows = [(i, n, j, t) for i, n, j, t in SAVED]
        return self.spark.createDataFrame(rows, "id long, name string, filter_json string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))

    @property
    def orphaned_file(self) -> DataFrame:
        d = self.trash.select("id", F.col("document_id").alias("document_key"), F.col("storage_path").alias("file_path"), "file_size", F.col("deleted_at").alias("detected_at"))
        null = lambda t: F.lit(None).cast(t)
        status = F.when(F.col("id") % 3 == 0, "deleted").otherwise("pending")
        return d.select("id", "document_key", F.lit("uuid").alias("key_type"), "file_path", null("string").alias("original_path"), F.lit("processed").alias("source_dir"), "file_size", null("string").alias("original_type"), "detected_at", status.alias("status"), null("timestamp").alias("action_at"), null("string").alias("action_type"))

    @property
    def backup_lock(self) -> DataFrame:
        return self.spark.range(1).select((F.col("id") + 1).alias("id"), F.lit(True).alias("running"), (F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(mins=F.lit(10))).alias("started_at"))

    @property
    def user(self) -> DataFrame:
        df = self.spark.createDataFrame(USERS, "id long, username string, role string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
        none = F.lit(None).cast("string")
        return df.select("id", "username", none.alias("password_hash"), none.alias("api_key_hash"), none.alias("api_key_prefix"), F.lit(None).cast("timestamp").alias("api_key_created_at"), "role", "created_at")

    @property
    def document_tag(self) -> DataFrame:
        r = self._t("document_tag_request").select(F.col("document_id").alias("uuid"), "tag_id").distinct()
        d = self.document.select("id", F.col("document_id").alias("uuid"))
        tags = self.tag.select(F.col("id").alias("tag_id"))
        return r.join(d, "uuid").join(tags, "tag_id", "left_semi").select(F.col("id").alias("document_id"), "tag_id").distinct()

    @property
    def document_people(self) -> DataFrame:
        d = self.document.select(F.col("id").alias("document_id"), F.explode(F.array(F.lit(7), F.lit(13))).alias("k"))
        top = self._t("people").agg(F.coalesce(F.max("id"), F.lit(1)).alias("top"))  # one row
        d = d.join(F.broadcast(top), F.lit(True)).select("document_id", ((F.col("document_id") * F.col("k")) % F.col("top") + 1).alias("people_id"), ((F.col("document_id") + F.col("k")) % 15 + 1).alias("people_type_id"))
        return d.join(self.people.select(F.col("id").alias("people_id")), "people_id", "left_semi").select("document_id", "people_id", "people_type_id").distinct()

    @property
    def batch_owner(self) -> DataFrame:
        b = self.batch.filter(F.substring("id", 1, 1) < "8")
        secs = (F.ascii(F.substring("id", 2, 1)) % 30).cast("int")
        beat = F.to_timestamp(F.lit(AS_OF)) - F.make_dt_interval(secs=secs)
        return b.select(F.col("id").alias("batch_id"), F.concat(F.lit("owner-"), F.substring("id", 1, 4)).alias("owner_id"), (F.ascii(F.substring("id", 3, 1)) + 1000).cast("long").alias("pid"), F.col("created_at").alias("acquired_at"), beat.alias("last_heartbeat"))


_SAVED = ", ".join(f"({i}, '{n}', '{j}', TIMESTAMP '{t}')" for i, n, j, t in SAVED)
_USERS = ", ".join(f"({i}, '{n}', '{r}', TIMESTAMP '{t}')" for i, n, r, t in USERS)
_TYPES = ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(PEOPLE_TYPES))
SQL = f"""WITH document AS (SELECT * FROM archive_document),
live AS (SELECT * FROM archive_document WHERE deleted_at IS NULL),
tasks AS (SELECT DISTINCT * FROM task),
batches AS (SELECT id, max(source) AS source, max(status) AS status, min(created_at) AS created_at FROM batch GROUP BY id),
persons AS (SELECT DISTINCT * FROM people),
orphaned_file AS (SELECT id, document_id AS document_key, storage_path AS file_path, file_size, deleted_at AS detected_at, CASE WHEN id % 3 = 0 THEN 'deleted' ELSE 'pending' END AS status FROM archive_document WHERE deleted_at IS NOT NULL),
backup_lock AS (SELECT 1 AS id, true AS running, TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE AS started_at),
saved_search(id, name, filter_json, created_at) AS (VALUES {_SAVED}),
users(id, username, role, created_at) AS (VALUES {_USERS}),
people_type(id, name) AS (VALUES {_TYPES}),
document_tag AS (SELECT DISTINCT d.id AS document_id, r.tag_id FROM document_tag_request r JOIN archive_document d ON d.document_id = r.document_id WHERE r.tag_id IN (SELECT id FROM tag)),
document_people AS (SELECT DISTINCT x.document_id, x.people_id, x.people_type_id FROM (SELECT d.id AS document_id, (d.id * k) % (SELECT coalesce(max(id), 1) FROM people) + 1 AS people_id, (d.id + k) % 15 + 1 AS people_type_id FROM archive_document d, (VALUES (7), (13)) v(k)) x WHERE x.people_id IN (SELECT id FROM people)),
batch_owner AS (SELECT id AS batch_id, 'owner-' || substr(id, 1, 4) AS owner_id, ascii(substr(id, 3, 1)) + 1000 AS pid, created_at AS acquired_at, TIMESTAMP '{AS_OF}' - to_seconds(ascii(substr(id, 2, 1)) % 30) AS last_heartbeat FROM batches WHERE substr(id, 1, 1) < '8')
"""

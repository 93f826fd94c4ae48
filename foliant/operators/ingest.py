"""Taking files in: duplicates, tasks for new files, orphan files, the text gate, the storage layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_DENSITY = 0.001
# Forms of storage names.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def new_files(files: DataFrame, document: DataFrame) -> DataFrame:
    """Files (path, md5) that no document has, trashed ones included; of several files with one hash the first path."""
    one = files.groupBy("md5").agg(F.min("path").alias("path"))
    return one.join(document.select(F.col("md5_checksum").alias("md5")), "md5", "left_anti")


def duplicates(files: DataFrame, live: DataFrame) -> DataFrame:
    """Files (path, md5, sha512) that a live document has by both hashes."""
    d = live.select(F.col("md5_checksum").alias("md5"), F.col("sha512_checksum").alias("sha512"), F.col("id").alias("document_id"))
    return files.join(d, ["md5", "sha512"]).groupBy("path").agg(F.min("document_id").alias("document_id"))


def same_content(document: DataFrame) -> DataFrame:
    """Documents that repeat the content of an earlier one: id, first_id, copies."""
    g = document.filter("md5_checksum is not null").groupBy("md5_checksum").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return document.select("id", "md5_checksum").join(g, "md5_checksum").filter("id > first_id").select("id", "first_id", "copies")


def task_pairs(files: DataFrame, batch_id: Column, at: Column) -> DataFrame:
    """The consume and the waiting enrich task of each new file (path, md5, file_index, consume_id, enrich_id, document_id)."""
    null = F.lit(None).cast("string")
    consume = F.to_json(F.struct(F.col("path").alias("file_path"), "file_index", F.col("enrich_id").alias("on_completed"), "document_id"))
    enrich = F.to_json(F.struct(F.col("consume_id").alias("waiting_for"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "file_index", "document_id"))
    row = lambda i, t, s, p, k: files.select(F.col(i).alias("task_id"), F.lit(t).alias("task_type"), F.lit(s).alias("status"), batch_id.alias("batch_id"), p.alias("payload"), k.alias("dedup_key"), at.alias("created_at"))
    return row("consume_id", "consume", "pending", consume, F.concat(F.lit("consume:"), "md5")).unionByName(row("enrich_id", "enrich", "waiting", enrich, null))


def orphan_files(files: DataFrame, live: DataFrame) -> DataFrame:
    """Stored pdf files (path) whose name is no live document's uuid or id: path, key, key_type. Other names are not looked at."""
    name = F.element_at(F.split("path", "/"), -1)
    f = files.filter(F.lower(name).endswith(".pdf")).withColumn("key", F.regexp_replace(name, r"\.pdf$", ""))
    kind = F.when(F.col("key").rlike(UUID), "uuid").when(F.col("key").rlike("^[0-9]+$"), "dbid")
    f = f.withColumn("key_type", kind).filter("key_type is not null")
    keys = live.select(F.col("document_id").alias("key")).unionByName(live.select(F.col("id").cast("string").alias("key")))
    return f.join(keys, "key", "left_anti").select("path", "key", "key_type")


def needs_ocr(text: Column, size: Column, kind: Column) -> Column:
    """Has a file no text, or a pdf too little for its size (that of the file the text was taken from)? Other files keep sparse text."""
    given = F.coalesce(text, F.lit(""))
    sparse = F.octet_length(given) / F.greatest(size, F.lit(1)) < LEAST_DENSITY
    return (given == "") | (F.coalesce(kind == "application/pdf", F.lit(False)) & F.coalesce(sparse, F.lit(False)))


def storage_path(root: str, uuid: Column, ext: Column, at: Column, kind: str = "processed") -> Column:
    return F.concat(F.lit(f"{root}/{kind}/"), F.date_format(at, "yyyy/MM/dd/HH/"), uuid, ext)


def write_partitioned(document: DataFrame, path: str) -> None:
    """Documents by year, month, day and hour of their creation."""
    t = F.col("created_at")
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}
    document.withColumns(parts).write.mode("append").partitionBy(*parts).parquet(path)


def rewrite_prefix(c: Column, old: str, new: str) -> Column:
    """Paths under `old` moved to `new`; only the prefix is replaced."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(c)

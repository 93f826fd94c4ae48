"""The inbox as a stream: each file becomes a document once, or a reject with its reason (unsupported, duplicate).

A micro-batch writes under its own number, so one that runs again overwrites itself. Which contents are known is kept in a table of hashes, laid out by
the first two letters of the hash: a micro-batch reads the folders of its own files' hashes only, not the documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from foliant.functions.text import count_words
from foliant.operators.backup import in_windows
from foliant.sources import files

_KEYS = "md5 string, sha512 string, batch long, prefix string"


def read(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(files.BINARY).option("maxFilesPerTrigger", per_trigger).load(path)


def _documents(df: DataFrame) -> DataFrame:
    x = files.extract(df)
    return x.select("path", "mime", "length", "md5", "sha512", "text", count_words(F.col("text")).alias("words"), F.col("modificationTime").alias("modified_at"), F.lit("").alias("language"))


def sorted_in(batch: DataFrame, known: DataFrame) -> DataFrame:
    """The files with the reason why they are rejected (null: they are taken in). Of several files of one content the oldest is taken, if the content is new."""
    x = files.hashed(batch, supported=False)
    first = F.row_number().over(Window.partitionBy("md5", "sha512").orderBy("modificationTime", "path"))
    old = known.select("md5", "sha512", F.lit(True).alias("_old")).distinct()
    x = x.withColumn("_n", first).join(old, ["md5", "sha512"], "left")
    reason = F.when(~F.col("mime").isin(*files.MIME_TYPES), "unsupported").when(F.col("_old") | (F.col("_n") > 1), "duplicate")
    return x.withColumn("reason", reason).drop("_n", "_old")


def start(spark: SparkSession, path: str, target: str, rejects: str, checkpoint: str, per_trigger: int = 10, every: str | None = None) -> StreamingQuery:
    """Append new documents to target and all other files to rejects."""
    keys = f"{target.rstrip('/')}_keys"
    spark.createDataFrame([], _KEYS).write.mode("append").partitionBy("batch", "prefix").parquet(keys)

    def store(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        batch = batch.persist()
        try:
            hashes = [r.p for r in batch.select(F.substring(F.md5("content"), 1, 2).alias("p")).distinct().collect()]  # at most 256
            known = s.read.schema(_KEYS).parquet(keys).filter((F.col("batch") != number) & F.col("prefix").isin(hashes))
            x = sorted_in(batch, known).persist()
            fresh = x.filter("reason is null")
            _documents(fresh).write.mode("overwrite").parquet(f"{target}/batch={number}")
            x.filter("reason is not null").select("path", "mime", "length", "md5", "sha512", "reason").write.mode("overwrite").parquet(f"{rejects}/batch={number}")
            fresh.select("md5", "sha512", F.substring("md5", 1, 2).alias("prefix")).write.mode("overwrite").partitionBy("prefix").parquet(f"{keys}/batch={number}")
            x.unpersist()
        finally:
            batch.unpersist()

    w = read(spark, path, per_trigger).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def closed(now: datetime, enabled: bool = True, windows: list[tuple[str, str]] | None = None, locked: bool = False, queued: int = 0, live: int = 0, most: int = 4, missing_tools: tuple[str, ...] = ()) -> str:
    """Why no files are taken in now; '' if they are."""
    if not enabled:
        return "disabled"
    if not in_windows(now, windows or []):
        return "outside its windows"
    if locked:
        return "backup in progress"
    if queued + live >= most:
        return f"{live} live, {queued} queued (max {most})"
    return "missing tools: " + ", ".join(missing_tools) if missing_tools else ""


def poll(spark: SparkSession, path: str, target: str, rejects: str, checkpoint: str, now: datetime, per_trigger: int = 10, **gates: object) -> str:
    """One poll: what lies in the inbox is taken in, if the gates (see `closed`) are open; the reason if they are not."""
    if not (why := closed(now, **gates)):  # type: ignore[arg-type]
        start(spark, path, target, rejects, checkpoint, per_trigger).awaitTermination()
    return why

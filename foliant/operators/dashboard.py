"""Dashboard aggregates over documents, tasks and batches. Time windows take an `as_of`, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.schemas import OWNER_STALE_SECONDS
from foliant.sources.views import AS_OF, Archive

def _count():
    return F.count(F.lit(1))


def _when(cond: Column | str) -> Column:
    c = F.expr(cond) if isinstance(cond, str) else cond
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def now(as_of: str = AS_OF) -> Column:
    return F.to_timestamp(F.lit(as_of))


def original_type_breakdown(a: Archive) -> DataFrame:
    return a.live.groupBy("original_type").agg(_count().alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def type_breakdown_top(a: Archive, n: int = 7) -> DataFrame:
    """The n largest types by bytes; the rest in one row `other`. The window runs over the types, one row each."""
    w = Window.orderBy(F.col("bytes").desc(), F.col("original_type").asc_nulls_last())
    t = original_type_breakdown(a).withColumn("rn", F.row_number().over(w))
    name = F.when(F.col("rn") > n, "other").otherwise(F.col("original_type"))
    return t.groupBy(name.alias("original_type")).agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes"))


def storage_trend_daily(a: Archive) -> DataFrame:
    return a.live.filter("created_at is not null").groupBy(F.to_date("created_at").alias("day")).agg(_count().alias("count"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def storage_trend_cumulative(a: Archive) -> DataFrame:
    """Running total over the days, one row a day."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return storage_trend_daily(a).select("day", "bytes", F.sum("bytes").over(w).alias("cumulative_bytes"))


def language_distribution(a: Archive, n: int = 10) -> DataFrame:
    return a.live.filter("language not in ('und', '')").groupBy("language").agg(_count().alias("count")).orderBy(F.desc("count"), "language").limit(n)


def document_type_distribution(a: Archive) -> DataFrame:
    t = a.document_type.select(F.col("id").alias("document_type_id"), "name")
    return a.live.filter("document_type_id <> 1").groupBy("document_type_id").agg(_count().alias("count")).join(t, "document_type_id").select("name", "count")


def tag_frequency(a: Archive, n: int = 10) -> DataFrame:
    live = a.live.select(F.col("id").alias("document_id"))
    t = a.document_tag.join(live, "document_id", "left_semi").groupBy("tag_id").agg(_count().alias("count")).join(a.tag.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return t.groupBy("name").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "name").limit(n)


def missing_counts(a: Archive) -> DataFrame:
    """One pass over the documents instead of three."""
    tagged = a.document_tag.select(F.col("document_id").alias("id"), F.lit(True).alias("tagged")).distinct()
    d = a.live.select("id", "language", "document_type_id").join(tagged, "id", "left")
    return d.agg(_when("language in ('und', '')").alias("missing_language"), _when("document_type_id = 1").alias("missing_type"), _when("tagged is null").alias("missing_tags"))


def task_success_rate(a: Archive, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    t = a.task.filter(F.col("completed_at") >= now(as_of) - F.make_dt_interval(F.lit(days)))
    r = t.agg(_when("status = 'completed'").alias("completed"), _when("status = 'failed'").alias("failed"))
    done = F.col("completed") + F.col("failed")
    return r.withColumn("success_rate", F.when(done == 0, F.lit(0.0)).otherwise(F.round(F.col("completed") / done, 6)))


def avg_task_duration_ms(a: Archive, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    t = a.task.filter((F.col("status") == "completed") & F.col("started_at").isNotNull() & (F.col("completed_at") >= now(as_of) - F.make_dt_interval(F.lit(days))))
    ms = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000.0
    return t.agg(F.round(F.coalesce(F.avg(ms), F.lit(0.0))).cast("long").alias("avg_duration_ms"))


def document_aggregates(a: Archive) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias
    d = a.live.agg(_count().alias("documents"), s("file_size")("bytes"), s("page_count")("pages"), s("word_count")("words"))
    avg = F.when(F.col("documents") == 0, 0).otherwise(F.floor(F.col("bytes") / F.greatest("documents", F.lit(1))))
    return d.withColumns({"avg_file_size": avg.cast("long"), "gb": F.round(F.col("bytes") / F.lit(1073741824.0), 6)})


def activity_timeline(a: Archive, n: int = 30) -> DataFrame:
    """The latest events of documents, finished tasks and batches, with the title to show and where it leads."""
    e = F.lit("")
    js = lambda k: F.coalesce(F.get_json_object("payload", f"$.{k}"), e)
    d = a.live.select(F.lit("document_uploaded").alias("event_type"), F.col("created_at").alias("event_time"), F.col("title"), e.alias("path"), F.col("document_id").alias("ref_id"), e.alias("batch_id"), e.alias("task_id"))
    t = a.task.filter("status in ('completed', 'failed') and completed_at is not null")
    t = t.select(F.when(F.col("status") == "completed", "task_completed").otherwise("task_failed").alias("event_type"), F.col("completed_at").alias("event_time"), js("file_name").alias("title"), js("file_path").alias("path"), js("document_id").alias("ref_id"), F.coalesce("batch_id", e).alias("batch_id"), "task_id")
    b = a.batch.select(F.lit("batch_created").alias("event_type"), F.col("created_at").alias("event_time"), F.col("source").alias("title"), e.alias("path"), F.col("id").alias("ref_id"), F.col("id").alias("batch_id"), e.alias("task_id"))
    top = lambda df: df.filter("event_time is not null").orderBy(F.desc("event_time"), "event_type", "ref_id", "task_id").limit(n)
    x = top(top(d).unionByName(top(t)).unionByName(top(b)))
    title = F.trim(F.coalesce("title", e))
    base = F.regexp_extract(F.trim("path"), r"([^/]+)/*$", 1)
    title = F.when(title != "", title).when(F.col("path") != "", base).otherwise(F.col("task_id"))
    link = F.when(F.col("event_type") == "document_uploaded", F.concat(F.lit("/documents/"), "ref_id")).when(F.col("event_type") == "batch_created", F.concat(F.lit("/tasks?batch="), "batch_id")).otherwise(F.concat(F.lit("/tasks/"), "task_id"))
    return x.select("event_type", "event_time", title.alias("title"), link.alias("link"))


_STATUS = ["waiting", "pending", "processing", "completed", "failed", "cancelled", "discarded"]


def _by_batch(task: DataFrame) -> DataFrame:
    aggs = [_when(F.col("status") == s).alias(s) for s in _STATUS]
    return task.filter("batch_id is not null").groupBy("batch_id").agg(_count().alias("total"), *aggs, F.min("started_at").alias("first_started_at"), F.max("completed_at").alias("last_completed_at"))


def owner_state(beat: Column, as_of: str = AS_OF) -> Column:
    return F.when(beat.isNull(), "none").when(beat > now(as_of) - F.make_dt_interval(secs=F.lit(OWNER_STALE_SECONDS)), "live").otherwise("stale")


def batch_overview(a: Archive, as_of: str = AS_OF) -> DataFrame:
    """Each batch with its counts, its owner's state and its duration. The lateral count of the reference is an aggregate joined once."""
    t = _by_batch(a.task).withColumnRenamed("batch_id", "id")
    o = a.batch_owner.select(F.col("batch_id").alias("id"), "last_heartbeat", "pid")
    x = a.batch.join(t, "id", "left").join(o, "id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["total", *_STATUS]}
    x = x.withColumns(zero).withColumn("owner_state", owner_state(F.col("last_heartbeat"), as_of))
    open_ = (F.col("pending") > 0) | (F.col("processing") > 0)
    idle = (F.col("waiting") + F.col("pending") + F.col("processing")) == 0
    ms = F.floor((F.unix_micros("last_completed_at") - F.unix_micros("first_started_at")) / 1000)
    x = x.withColumns({"orphaned": (F.col("owner_state") != "live") & open_, "duration_ms": F.when(idle & F.col("first_started_at").isNotNull() & F.col("last_completed_at").isNotNull(), ms)})
    return x.select(F.col("id").alias("batch_id"), "source", "status", "created_at", "total", *_STATUS, "owner_state", "orphaned", "duration_ms")


def batch_summaries(a: Archive) -> DataFrame:
    """Only batches that have tasks and a batch row, with the time of the newest task."""
    t = a.task.filter("batch_id is not null").groupBy("batch_id").agg(_count().alias("total"), *[_when(F.col("status") == s).alias(s) for s in _STATUS], F.max("created_at").alias("newest"))
    return t.join(a.batch.select(F.col("id").alias("batch_id"), "source", F.col("status").alias("batch_status")), "batch_id")


def batch_ids_recent(a: Archive, limit: int = 20, status: str | None = None) -> DataFrame:
    t = a.task.filter("batch_id is not null")
    t = t.filter(F.col("status") == status) if status else t
    return t.groupBy("batch_id").agg(F.max("created_at").alias("newest")).orderBy(F.col("newest").desc_nulls_last(), "batch_id").limit(limit)


def orphaned_batches(a: Archive, as_of: str = AS_OF) -> DataFrame:
    return batch_overview(a, as_of).filter("orphaned").agg(_count().alias("orphaned"))


def tasks_by_status(a: Archive) -> DataFrame:
    return a.task.groupBy("status").agg(_count().alias("count"))


def status_shares(a: Archive) -> DataFrame:
    """Percent of the tasks in each status but `waiting`; statuses without tasks do not appear."""
    t = tasks_by_status(a).filter("status <> 'waiting'")
    total = t.agg(F.greatest(F.sum("count"), F.lit(1)).alias("total"))
    return t.join(F.broadcast(total), F.lit(True)).select("status", F.round(F.col("count") * 100.0 / F.col("total"), 4).alias("percent"))


def distinct_batches(a: Archive) -> DataFrame:
    return a.task.agg(F.count_distinct("batch_id").alias("batches"))


def active_batch_ids(a: Archive) -> DataFrame:
    return a.task.filter("status in ('pending', 'processing', 'waiting') and batch_id is not null").select("batch_id").distinct()


def distinct_languages(a: Archive) -> DataFrame:
    return a.live.filter("language is not null and language <> ''").select("language").distinct()


def batch_terminal_status(a: Archive) -> DataFrame:
    """What a batch ends as when its run is over: terminal statuses and a pause stay; any failed task makes it failed, else completed."""
    t = a.task.filter("batch_id is not null and status = 'failed'").select(F.col("batch_id").alias("id"), F.lit(True).alias("failed")).distinct()
    x = a.batch.join(t, "id", "left")
    s = F.when(F.col("status").isin("completed", "failed", "cancelled", "paused"), F.col("status")).when(F.coalesce("failed", F.lit(False)), "failed").otherwise("completed")
    return x.select(F.col("id").alias("batch_id"), s.alias("final_status"))


def progress_totals(a: Archive) -> DataFrame:
    """Files of a batch: the largest file index of its consume tasks (they count from one), or their number where none is given."""
    i = F.get_json_object("payload", "$.file_index").try_cast("int")
    t = a.task.filter("task_type = 'consume' and batch_id is not null").groupBy("batch_id").agg(F.max(i).alias("most"), _count().alias("n"))
    return t.select("batch_id", F.when(F.col("most") > 0, F.col("most")).otherwise(F.col("n")).cast("long").alias("files"))

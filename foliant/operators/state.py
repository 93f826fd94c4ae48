"""State changes as pure functions from one snapshot of a table to the next.

Each returns the whole new table; `affected` counts the rows that differ by key. A single writer stores the snapshots, which gives the
compare-and-set that rows changed under a lock would give. A change that adds rows drops those that a unique key forbids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.schemas import OWNER_STALE_SECONDS
from foliant.session import stored

MAX_ATTEMPTS = 3
STALE_SECONDS = 600
EXHAUSTED = "Max retries exceeded"
ACTIVE = ("waiting", "pending", "processing")


def update(df: DataFrame, cond: Column, **sets: Column) -> DataFrame:
    """Rows that meet cond get the new values; a null condition is not met."""
    c = F.coalesce(cond, F.lit(False))
    return df.withColumns({k: F.when(c, v.cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in sets.items()})


def affected(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `after` that `before` does not have, and of `before` that `after` does not."""
    return before.exceptAll(after).withColumn("change", F.lit("old")).unionByName(after.exceptAll(before).withColumn("change", F.lit("new")))


def insert_absent(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is free; of several with one key the first by all columns. Keys are compared as values, null is never taken."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c) for c in sorted(new.columns)])
    one = new.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return df.unionByName(one.join(df.select(*key), key, "left_anti").select(*df.columns))


def upsert(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return df.join(new.select(*key), key, "left_anti").select(*df.columns).unionByName(new.select(*df.columns))


def delete(df: DataFrame, cond: Column) -> DataFrame:
    return df.filter(~F.coalesce(cond, F.lit(False)))


def numbered(new: DataFrame, order: list[str], df: DataFrame | None = None, key: str = "id") -> DataFrame:
    """new with ids that go on from the largest of df, in the order of some columns. Rows are sorted over all tasks and numbered part by part; only one
    row a part (its size) meets in one place."""
    rows = stored(new.drop(key).orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    top = (df if df is not None else rows.sparkSession.createDataFrame([], f"{key} long")).agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    out = rows.withColumn("_part", part).join(F.broadcast(starts), "_part").join(F.broadcast(top), F.lit(True))
    return out.withColumn(key, (F.col("_top") + F.col("_start") + place + 1).cast("long")).drop("_at", "_part", "_start", "_top")


def _nothing() -> Column:
    return F.lit(None)


def enqueue(task: DataFrame, new: DataFrame) -> DataFrame:
    """New tasks without those whose (task_type, dedup_key) an active task holds; a null key never collides. Ids go on from the largest."""
    held = task.filter("status in ('pending', 'processing') and dedup_key is not null").select("task_type", "dedup_key")
    w = Window.partitionBy("task_type", "dedup_key").orderBy("task_id")
    one = new.withColumn("_rn", F.when(F.col("dedup_key").isNull(), 1).otherwise(F.row_number().over(w))).filter("_rn = 1").drop("_rn", "id")
    free = one.join(held, ["task_type", "dedup_key"], "left_anti")
    return task.unionByName(numbered(free, ["task_id"], task).select(*task.columns))


def next_pending(task: DataFrame, task_type: str | None = None, batches: DataFrame | None = None, gate_closed: bool = False) -> DataFrame:
    """The oldest pending task (of a type, of the batches an owner holds); none while the gate is closed."""
    t = task.filter("status = 'pending'")
    t = t.filter(F.col("task_type") == task_type) if task_type else t
    t = t.join(batches.select("batch_id"), "batch_id", "left_semi") if batches is not None else t
    return t.orderBy(F.col("created_at").asc_nulls_last(), "id").limit(0 if gate_closed else 1)


def claim(task: DataFrame, task_id: int, at: Column) -> DataFrame:
    return update(task, (F.col("id") == task_id) & (F.col("status") == "pending"), status=F.lit("processing"), started_at=at)


def complete(task: DataFrame, task_id: int, result: str | None, at: Column) -> DataFrame:
    return update(task, (F.col("id") == task_id) & (F.col("status") == "processing"), status=F.lit("completed"), result=F.lit(result), completed_at=at, error=_nothing(), attempts=F.lit(0))


def fail(task: DataFrame, task_id: int, error: str, at: Column) -> DataFrame:
    return update(task, F.col("id") == task_id, status=F.lit("failed"), error=F.lit(error), completed_at=at)


def retry(task: DataFrame, cond: Column) -> DataFrame:
    """Failed tasks start again from nothing."""
    return update(task, cond & (F.col("status") == "failed"), status=F.lit("pending"), result=_nothing(), error=_nothing(), started_at=_nothing(), completed_at=_nothing(), attempts=F.lit(0))


def cancel(task: DataFrame, batch_id: str, at: Column) -> DataFrame:
    return update(task, (F.col("batch_id") == batch_id) & F.col("status").isin("pending", "processing"), status=F.lit("cancelled"), completed_at=at)


def quarantine(task: DataFrame, cond: Column, at: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Processing tasks that have used up their attempts fail."""
    c = cond & (F.col("status") == "processing") & (F.col("attempts") >= most)
    return update(task, c, status=F.lit("failed"), error=F.concat(F.lit(f"{EXHAUSTED} ("), F.col("attempts").cast("string"), F.lit(")")), completed_at=at)


def reset(task: DataFrame, cond: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """The others go back to pending with one attempt more."""
    c = cond & (F.col("status") == "processing") & (F.col("attempts") < most)
    return update(task, c, status=F.lit("pending"), started_at=_nothing(), attempts=F.col("attempts") + 1)


def reclaim_stale(task: DataFrame, at: Column, seconds: int = STALE_SECONDS, most: int = MAX_ATTEMPTS) -> DataFrame:
    old = F.col("started_at") < at - F.make_dt_interval(secs=F.lit(seconds))
    return reset(quarantine(task, old, at, most), old, most)


def _parents(task: DataFrame, status: str) -> DataFrame:
    """The enrich task that each consume task of a status names, with the consume task's error."""
    c = task.filter((F.col("task_type") == "consume") & (F.col("status") == status) if status else F.col("task_type") == "consume")
    return c.select(F.get_json_object("payload", "$.on_completed").alias("task_id"), F.col("error").alias("_error"), F.col("batch_id").alias("_batch"), F.lit(True).alias("_hit")).filter("task_id is not null").dropDuplicates(["task_id"])


def discard_waiting(task: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Waiting enrich tasks of failed consume tasks are discarded, with their error."""
    p = _parents(task, "failed")
    p = p.filter(F.col("_batch") == batch_id) if batch_id else p
    x = task.join(p, "task_id", "left")
    return update(x, F.col("_hit") & (F.col("status") == "waiting") & (F.col("task_type") == "enrich"), status=F.lit("discarded"), error=F.coalesce("_error", F.lit("parent task failed"))).select(*task.columns)


def restore_discarded(task: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Discarded enrich tasks wait again when their consume task is pending again."""
    p = _parents(task, "pending")
    p = p.filter(F.col("_batch") == batch_id) if batch_id else p
    x = task.join(p, "task_id", "left")
    return update(x, F.col("_hit") & (F.col("status") == "discarded") & (F.col("task_type") == "enrich"), status=F.lit("waiting"), error=_nothing()).select(*task.columns)


def activate_enrich(task: DataFrame, parent: str, task_id: str, payload: str) -> DataFrame:
    """The enrich task that waits for `parent` becomes pending with its payload."""
    waits = F.get_json_object("payload", "$.waiting_for") == parent
    return update(task, (F.col("task_id") == task_id) & waits & F.col("status").isin("waiting", "discarded"), status=F.lit("pending"), payload=F.lit(payload))


def set_batch(batch: DataFrame, batch_id: str, status: str) -> DataFrame:
    return update(batch, F.col("id") == batch_id, status=F.lit(status))


def acquire_owner(owner: DataFrame, batch_id: str, me: str, pid: int, at: Column, force: bool = False) -> DataFrame:
    """A lease: free, stale or already mine (or by force)."""
    spark = owner.sparkSession
    new = spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(me).alias("owner_id"), F.lit(pid).cast("long").alias("pid"), at.alias("acquired_at"), at.alias("last_heartbeat"))
    if force:
        return upsert(owner, new, ["batch_id"])
    stale = (F.col("last_heartbeat") < at - F.make_dt_interval(secs=F.lit(OWNER_STALE_SECONDS))) | (F.col("owner_id") == me)
    mine = update(owner, (F.col("batch_id") == batch_id) & stale, owner_id=F.lit(me), pid=F.lit(pid), acquired_at=at, last_heartbeat=at)
    return insert_absent(mine, new, ["batch_id"])


def heartbeat(owner: DataFrame, me: str, at: Column) -> DataFrame:
    return update(owner, F.col("owner_id") == me, last_heartbeat=at)


def release_owner(owner: DataFrame, batch_id: str, me: str | None = None) -> DataFrame:
    c = F.col("batch_id") == batch_id
    return delete(owner, c & (F.col("owner_id") == me) if me else c)


def stale_owners(owner: DataFrame, task: DataFrame, at: Column) -> DataFrame:
    """Owners without a recent heartbeat whose batch still has work."""
    active = task.filter(F.col("status").isin(*ACTIVE)).select("batch_id").distinct()
    return owner.filter(F.col("last_heartbeat") < at - F.make_dt_interval(secs=F.lit(OWNER_STALE_SECONDS))).join(active, "batch_id", "left_semi")


def quarantined(task: DataFrame, batch_id: str | None = None) -> DataFrame:
    """task_id, payload of the tasks that failed because they used up their attempts."""
    t = task.filter((F.col("status") == "failed") & F.col("error").startswith(EXHAUSTED))
    return (t if batch_id is None else t.filter(F.col("batch_id") == batch_id)).select("task_id", "payload", "batch_id")


def reclaim_batches(task: DataFrame, batch: DataFrame, owner: DataFrame, at: Column, most: int = MAX_ATTEMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(task, batch, owner) after the batches of stale owners were taken back: their tasks in work go back to pending or, with their attempts used up, fail; a
    batch that still has work is queued again, another one has failed; the lease ends."""
    stale = stale_owners(owner, task, at).select("batch_id").distinct().withColumn("_stale", F.lit(True))
    mine = task.join(stale, "batch_id", "left")
    mine = reset(quarantine(mine, F.col("_stale"), at, most), F.col("_stale"), most)
    work = mine.filter(F.col("_stale") & F.col("status").isin(*ACTIVE)).select(F.col("batch_id").alias("id"), F.lit(True).alias("_work")).distinct()
    b = batch.join(stale.withColumnRenamed("batch_id", "id"), "id", "left").join(work, "id", "left")
    b = update(b, F.col("_stale"), status=F.when(F.col("_work"), "queued").otherwise("failed"))
    return mine.select(*task.columns), b.select(*batch.columns), owner.join(stale, "batch_id", "left_anti").select(*owner.columns)


def pause_batches(batch: DataFrame, task: DataFrame, answers: DataFrame) -> DataFrame:
    """batch after an analysis (answers: task_id, error) met the end of the provider's credit: the batches of these tasks are paused."""
    stopped = answers.filter("error = 'credit'").select("task_id").join(task.select("task_id", F.col("batch_id").alias("id")), "task_id").select("id", F.lit(True).alias("_stop")).distinct()
    return update(batch.join(stopped, "id", "left"), F.col("_stop"), status=F.lit("paused")).select(*batch.columns)


def cleanup_owners(owner: DataFrame, task: DataFrame) -> DataFrame:
    """Owners of batches without active tasks are removed."""
    return owner.join(task.filter(F.col("status").isin(*ACTIVE)).select("batch_id").distinct(), "batch_id", "left_semi")


def soft_delete(document: DataFrame, document_id: str, at: Column) -> DataFrame:
    return update(document, (F.col("document_id") == document_id) & F.col("deleted_at").isNull(), deleted_at=at, modified_at=at)


def restore_document(document: DataFrame, document_id: str, at: Column) -> DataFrame:
    return update(document, (F.col("document_id") == document_id) & F.col("deleted_at").isNotNull(), deleted_at=_nothing(), modified_at=at)


def purge_expired(document: DataFrame, days: int, at: Column) -> DataFrame:
    return delete(document, F.col("deleted_at") < at - F.make_dt_interval(F.lit(days)))


def purgeable(folders: DataFrame, document: DataFrame, at: Column, grace_minutes: int = 5) -> DataFrame:
    """Folders of the trash (document_id, modified_at) that no trashed document has any more and that were not written to just now."""
    held = document.filter("deleted_at is not null").select("document_id")
    old = F.col("modified_at") <= at - F.make_dt_interval(mins=F.lit(grace_minutes))
    return folders.filter(old).join(held, "document_id", "left_anti").select(*folders.columns)


def cascade(junction: DataFrame, document: DataFrame) -> DataFrame:
    """Rows of a junction whose document still exists."""
    return junction.join(document.select(F.col("id").alias("document_id")), "document_id", "left_semi").select(*junction.columns)


def lock_running(lock: DataFrame, at: Column, minutes: int = 30) -> DataFrame:
    held = F.col("running") & (F.col("started_at") > at - F.make_dt_interval(mins=F.lit(minutes)))
    return lock.agg(F.coalesce(F.max(F.when(held, 1).otherwise(0)), F.lit(0)).alias("locked"))


def acquire_lock(lock: DataFrame, at: Column, minutes: int = 30) -> DataFrame:
    free = ~F.col("running") | (F.col("started_at") <= at - F.make_dt_interval(mins=F.lit(minutes)))
    return update(lock, free, running=F.lit(True), started_at=at)


def release_lock(lock: DataFrame) -> DataFrame:
    return update(lock, F.col("running"), running=F.lit(False), started_at=_nothing())


def create_named(df: DataFrame, names: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, result code of each given name: Created, Conflict or Invalid)."""
    spark = df.sparkSession
    ask = spark.createDataFrame([(i, (n or "").strip()) for i, n in enumerate(names)], "pos int, name string")
    first = ask.groupBy("name").agg(F.min("pos").alias("first"))
    held = df.select("name", F.lit(True).alias("held")).distinct()
    r = ask.join(first, "name").join(held, "name", "left")
    code = F.when(F.col("name") == "", "Invalid").when(F.col("held") | (F.col("pos") > F.col("first")), "Conflict").otherwise("Created")
    r = r.select("pos", "name", code.alias("code"))
    new = numbered(r.filter("code = 'Created'"), ["pos"], df).select("id", "name", at.alias("created_at"))
    missing = {c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if c not in new.columns}
    return df.unionByName(new.withColumns(missing).select(*df.columns)), r.orderBy("pos")


def rename(df: DataFrame, row_id: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new name, one row: id, code: Updated, Noop for the name it has, NotFound, Conflict for a name that another row has, or Invalid)."""
    want = name.strip()
    seen = df.agg(
        F.max(F.col("id") == row_id).alias("there"), F.max((F.col("id") == row_id) & (F.col("name") == want)).alias("same"), F.max((F.col("id") != row_id) & (F.col("name") == want)).alias("held"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = F.when(F.lit(want == ""), "Invalid").when(~yes("there"), "NotFound").when(yes("same"), "Noop").when(yes("held"), "Conflict").otherwise("Updated")
    result = seen.select(F.lit(row_id).cast("long").alias("id"), code.alias("code"))
    ok = result.filter("code = 'Updated'").select("id", F.lit(True).alias("_ok"))
    return update(df.join(F.broadcast(ok), "id", "left"), F.col("_ok"), name=F.lit(want)).select(*df.columns), result


def delete_named(df: DataFrame, ids: list[int], used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(table without the rows, Deleted, NotFound or Conflict for each id). used: one column of ids that must stay."""
    ask = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "pos int, id long")
    r = ask.join(df.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
    if used is not None:
        r = r.join(used.toDF("id").distinct().withColumn("used", F.lit(True)), "id", "left")
    busy = F.coalesce("used", F.lit(False)) if used is not None else F.lit(False)
    r = r.select("pos", "id", F.when(F.col("there").isNull(), "NotFound").when(busy, "Conflict").otherwise("Deleted").alias("code"))
    return df.join(r.filter("code = 'Deleted'").select("id"), "id", "left_anti").select(*df.columns), r.orderBy("pos")

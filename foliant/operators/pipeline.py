"""The steps between taking a file in and having it described: suggestions, second look at types, links, gates, errors, orphans."""

from __future__ import annotations

import shutil
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from foliant.functions.text import head_tail_words
from foliant.operators import enrich, state

# What a status of an orphaned file came from.
ACTIONS = {"deleted": "delete", "restored": "restore", "reingested": "move_to_inbox"}
MOST_LIVE = 4


def suggestions(documents: DataFrame, matches: DataFrame, tags: DataFrame) -> DataFrame:
    """id, tags: the names matched to each document, best first; a document without matches gets all names, however many. matches: q, t (name), similarity.
    The list of all names stands in every such row: for its length alone see `suggested`."""
    every = tags.agg(F.array_sort(F.collect_set("name")).alias("every"))
    return _matched(documents, matches).join(F.broadcast(every), F.lit(True)).select("id", F.coalesce("m", "every").alias("tags"))


def suggested(documents: DataFrame, matches: DataFrame, tags: DataFrame) -> DataFrame:
    """id, tags: how many names `suggestions` has for each document, without laying out the list of all names for any."""
    every = tags.agg(F.count_distinct("name").cast("int").alias("every"))
    return _matched(documents, matches).join(F.broadcast(every), F.lit(True)).select("id", F.when(F.col("m").isNotNull(), F.size("m")).otherwise(F.col("every")).alias("tags"))


def _matched(documents: DataFrame, matches: DataFrame) -> DataFrame:
    """id, m: the names matched to each document, best first; null without any."""
    m = matches.groupBy(F.col("q").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "t"))), lambda x: x["t"]).alias("m"))
    return documents.select("id").join(m, "id", "left")


def second_look(docs: DataFrame, key: str, text: str, target: int, model: Callable[[str], str], types: str, head: int = enrich.HEAD, tail: int = enrich.TAIL) -> DataFrame:
    """key, type: for documents longer than the target, the type judged by their first and last words."""
    long = docs.filter(F.size(F.split(F.col(text), r"\s+")) > target).select(key, head_tail_words(F.col(text), head, tail).alias("_part"))
    return enrich.analyze(long, key, "_part", model, "Name the type of this document as JSON.\nTypes: {types}\n\n{text}", types).select(key, "type")


def relink_tags(tag: DataFrame, document_tag: DataFrame, wanted: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(tag, document_tag) after the documents in wanted (document_id, tags) got exactly these tags; missing tags are created once."""
    w = wanted.select("document_id", F.explode_outer("tags").alias("name"))
    free = w.filter("name is not null").select("name").distinct().join(tag.select("name"), "name", "left_anti")
    new = state.numbered(free, ["name"], tag).select("id", "name", at.alias("created_at"))
    tags = tag.unionByName(new)
    ids = tags.groupBy("name").agg(F.min("id").alias("tag_id"))
    links = w.join(ids, "name").select("document_id", "tag_id").distinct()
    rest = document_tag.join(wanted.select("document_id").distinct(), "document_id", "left_anti")
    return tags, rest.select("document_id", "tag_id").unionByName(links)


def assign_tags(document_tag: DataFrame, live: DataFrame, ids: DataFrame, tag_ids: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(document_tag, result of each document: Updated or NotFound) after adding tags to documents or replacing theirs. ids: document_id; tag_ids: tag_id, a short list."""
    ask = ids.select("document_id").distinct()
    found = ask.join(live.select(F.col("id").alias("document_id"), F.lit(True).alias("there")), "document_id", "left")
    ok = found.filter("there").select("document_id")
    each = tag_ids.agg(F.collect_set("tag_id").alias("tag_ids"))  # the request's list, one row
    links = ok.join(F.broadcast(each), F.lit(True)).select("document_id", F.explode("tag_ids").alias("tag_id"))
    base = document_tag.join(ok, "document_id", "left_anti") if replace else document_tag
    out = base.select("document_id", "tag_id").unionByName(links).distinct()
    return out, found.select("document_id", F.when(F.col("there"), "Updated").otherwise("NotFound").alias("result"))


def reenrich(document: DataFrame, uuids: list[str], batch_id: str, at: Column) -> DataFrame:
    """The enrich task of each document, with the key that keeps a document from being queued twice."""
    d = document.filter(F.col("document_id").isin(*uuids))
    payload = F.to_json(F.struct("document_id", F.col("title").alias("file_name")))
    null = F.lit(None)
    return d.select(F.lit(0).cast("long").alias("id"), F.uuid().alias("task_id"), F.lit("enrich").alias("task_type"), F.lit("pending").alias("status"), F.lit(batch_id).alias("batch_id"), payload.alias("payload"), null.cast("string").alias("result"), F.concat(F.lit("enrich:doc:"), "document_id").alias("dedup_key"), at.alias("created_at"), null.cast("timestamp").alias("started_at"), null.cast("timestamp").alias("completed_at"), null.cast("string").alias("error"), F.lit(0).alias("attempts"))


def admit(batch: DataFrame, owner: DataFrame, at: Column, most: int = MOST_LIVE) -> DataFrame:
    """The queued batches that may start now: the oldest ones, as many as live owners leave room for."""
    live = owner.agg(F.coalesce(F.sum(F.when(F.col("last_heartbeat") > at - F.make_dt_interval(secs=F.lit(15)), 1).otherwise(0)), F.lit(0)).alias("live"))
    queued = batch.filter("status = 'queued'").orderBy(F.col("created_at").asc_nulls_last(), "id").limit(most)
    rn = F.row_number().over(Window.orderBy(F.col("created_at").asc_nulls_last(), "id"))
    return queued.withColumn("_rn", rn).join(F.broadcast(live), F.lit(True)).filter(F.col("_rn") <= most - F.col("live")).select(*batch.columns)


def errored(files: DataFrame) -> DataFrame:
    """Files under errors/ with the reason their folder names: path, name, reason."""
    f = files.filter(F.col("path").rlike("/errors/(duplicated/)?[^/]+$"))
    return f.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.when(F.contains("path", F.lit("/errors/duplicated/")), "duplicate").otherwise("failed").alias("reason"))


def orphan_action(orphaned: DataFrame, ids: list[int] | None, action: str, at: Column) -> DataFrame:
    """Orphan files are marked deleted, restored or reingested: some of them by id, or all that are pending."""
    c = F.col("status") == "pending" if ids is None else F.col("id").isin(*ids)
    return state.update(orphaned, c, status=F.lit(action), action_at=at, action_type=F.lit(ACTIONS[action]))


def restorable(orphaned: DataFrame, live: DataFrame) -> DataFrame:
    """id, code of each orphan file: Ok, Invalid (its name is no uuid) or Conflict (a live document has it)."""
    d = live.select(F.col("document_id").alias("document_key"), F.lit(True).alias("held"))
    return orphaned.join(d, "document_key", "left").select("id", F.when(F.col("key_type") != "uuid", "Invalid").when(F.col("held"), "Conflict").otherwise("Ok").alias("code"))


def model_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Models with limits and abilities from a JSON file (one array or one object a line)."""
    return spark.read.option("multiLine", True).json(path)


def model_of(catalog: DataFrame, provider: str, model: str) -> DataFrame:
    """The catalog's row for a model; without one of that name, the one whose name the asked name begins with (the longest)."""
    fits = catalog.filter((F.lower("provider") == provider.lower()) & F.lit(model.lower()).startswith(F.lower(F.col("model"))))
    return fits.orderBy(F.length("model").desc(), "model").limit(1)


def move_orphan(row_path: str, folder: str) -> str:
    """Move an orphaned file to a folder (quarantine, or back to the inbox); a name that is taken gets a number. The new path."""
    source, target = Path(row_path), Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    to, n = target / source.name, 1
    while to.exists():
        to, n = target / f"{source.stem}-{n}{source.suffix}", n + 1
    shutil.move(source, to)
    return str(to)


def downscale(pixels: bytes, width: int, height: int, out_width: int, out_height: int) -> bytes:
    """Nearest neighbour, RGB rows."""
    a = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
    return a[np.arange(out_height) * height // out_height][:, np.arange(out_width) * width // out_width].tobytes()


def downscaled(pixels: Column, width: Column, height: Column, scale: float = 0.75) -> Column:
    """Images brought to a lower resolution, in Arrow batches."""

    @pandas_udf("binary")
    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([downscale(bytes(x), a, b, max(1, int(a * scale)), max(1, int(b * scale))) if x is not None else None for x, a, b in zip(p, w, h)], dtype=object)

    return run(pixels, width, height)

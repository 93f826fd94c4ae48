"""References to records that do not exist.

References and parent keys are hashed to the same partitions and sorted, and one linear merge of both sorted streams
(a sort-merge join, asked for by hint) finds each reference's parent together with the start of the parent's validity.
One parent may be named by a third of all rows: the keys that are named by more than one in PARTS of all references (of which there
can be no more than PARTS) are dealt to as many salts as they have such shares, and their parents are repeated for each, so no task gets more than
about one in PARTS of the rows from one key. References are counted, and parents reduced to one row a key, with a map-side combine.

Kinds: `late` (the parent exists, but only since after the record), `deleted` (the parent's validity ended before the record; where the parent table has no
end of validity, a number up to the largest that it holds, as numbers are given out in order: one that was skipped counts as deleted, too) and `missing` (all
else). A uuid does not show whether it was ever given out: `missing`.

Defined results: a null, empty or blank reference is no case; a null time on either side makes no record late; repeated
deliveries of a record count once; several rows of one parent count with their earliest time; empty tables give no rows
(an empty parent table makes every reference `missing`); further columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

PARTS = 1000
#: A key with fewer references is no load for any task.
LEAST_HOT = 10_000


@dataclass(frozen=True)
class Reference:
    """One foreign key: child table, its id, its key and time, and the parent's id and time."""

    child: str
    refs: DataFrame
    row_id: str
    key: str
    at: str
    parents: DataFrame
    parent_key: str
    parent_at: str
    kind: str = "number"  # or "uuid"
    parent_until: str | None = None  # when the parent ceased to exist, null while it does


def uuid_key(c: Column) -> Column:
    """One notation for all notations of a uuid: lower case, without braces, urn prefix, blanks; dashes put back."""
    s = F.lower(F.trim(F.regexp_replace(c, r"[\s ﻿]+", " ")))
    s = F.trim(F.regexp_replace(s, r"^(urn:)?(uuid:)?\s*[\{\(]?\s*|\s*[\}\)]?$", ""))
    return F.when(s.rlike("^[0-9a-f]{32}$"), F.regexp_replace(s, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(s)


def _key(c: Column, kind: str) -> Column:
    return uuid_key(c) if kind == "uuid" else c.cast("string")


def _hot(refs: DataFrame, parts: int, least: int) -> DataFrame:
    """child, key, salts of the keys with more than one in `parts` of all references: at most `parts` rows."""
    seen = Observation("references")
    n = refs.groupBy("child", "key").agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("total"))
    most = n.filter(F.col("n") >= least).orderBy(F.desc("n")).limit(parts).collect()  # no more keys can have such a share
    total = (seen.get["total"] or 0) if most else 0
    rows = [(r.child, r.key, -(-r.n * parts // total)) for r in most if r.n * parts > total]
    return refs.sparkSession.createDataFrame(rows, "child string, key string, salts int")


def orphans(references: list[Reference], parts: int = PARTS, least: int = LEAST_HOT) -> DataFrame:
    """child, row_id, kind (missing, deleted, late), at: one row for each record whose reference has no parent in time."""
    refs = parents = known = None
    for r in references:
        one = r.refs.select(F.lit(r.child).alias("child"), _key(F.col(r.key), r.kind).alias("key"), F.col(r.row_id).cast("long").alias("row_id"), F.col(r.at).alias("at"))
        one = one.filter(F.col("key").isNotNull() & (F.trim("key") != ""))
        until = F.lit(None).cast("timestamp") if r.parent_until is None else F.col(r.parent_until)
        up = r.parents.select(F.lit(r.child).alias("child"), _key(F.col(r.parent_key), r.kind).alias("key"), F.col(r.parent_at).alias("since"), until.alias("until"))
        up = up.filter(F.col("key").isNotNull())
        top = r.parents.agg(F.max(F.col(r.parent_key).cast("long") if r.kind == "number" and r.parent_until is None else F.lit(None).cast("long")).alias("top")).select(F.lit(r.child).alias("child"), "top")
        refs = one if refs is None else refs.unionByName(one)
        parents = up if parents is None else parents.unionByName(up)
        known = top if known is None else known.unionByName(top)
    assert refs is not None and parents is not None and known is not None, "no references"
    hot = F.broadcast(_hot(refs, parts, least))
    salts = F.coalesce("salts", F.lit(1))
    refs = refs.join(hot, ["child", "key"], "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), salts).cast("int")).drop("salts")
    # A parent that one of its rows still holds is not ended.
    ended = F.when(F.max(F.col("until").isNull().cast("int")) == 0, F.max("until"))
    parents = parents.groupBy("child", "key").agg(F.min("since").alias("since"), ended.alias("until"), F.lit(True).alias("there"))
    parents = parents.join(hot, ["child", "key"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    merged = refs.join(parents.hint("merge"), ["child", "key", "salt"], "left")
    late = F.coalesce(F.col("since") > F.col("at"), F.lit(False))
    over = F.coalesce(F.col("until") < F.col("at"), F.lit(False))
    found = merged.filter(F.col("there").isNull() | late | over)
    found = found.join(F.broadcast(known), "child")  # one row a reference
    n = F.col("key").try_cast("long")
    kind = F.when(late, "late").when(F.col("there") | ((n >= 1) & (n <= F.col("top"))), "deleted").otherwise("missing")
    found = found.select("child", "row_id", kind.alias("kind"), "at")
    return found.groupBy("child", "row_id").agg(F.max_by("kind", "kind").alias("kind"), F.min("at").alias("at"))


def orphan_report(references: list[Reference]) -> DataFrame:
    """child, month (null where the record has no time), kind, orphans."""
    month = F.date_format("at", "yyyy-MM")
    return orphans(references).groupBy("child", month.alias("month"), "kind").agg(F.count(F.lit(1)).alias("orphans"))

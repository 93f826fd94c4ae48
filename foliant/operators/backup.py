"""Backups: a snapshot of all tables with a manifest, what to keep, restoring, and when the next one is due."""

from __future__ import annotations

import hashlib
import json
import tarfile
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.ingest import rewrite_prefix

DEFAULT_HOUR, CHECKSUMS = 2, "checksums.txt"


def export(tables: dict[str, DataFrame], path: str, at: datetime) -> dict:
    """Write each table as parquet under path, and the manifest last: a backup without one is not complete."""
    spark = next(iter(tables.values())).sparkSession
    rows = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{name}").count()
    manifest = {"version": 1, "format": "parquet", "timestamp": at.isoformat(), "tables": rows}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return manifest


def archive(path: str, target: str) -> str:
    """A backup folder as one tar.gz with a list of the checksums of its files in it; the archive's own checksum is returned. Local folders only: what is
    archived are the files, table by table, so a large backup is better left as the folder that `export` wrote."""
    root = Path(path)
    names = sorted(p for p in root.rglob("*") if p.is_file() and not p.name.startswith(".") and p.name != CHECKSUMS)
    (root / CHECKSUMS).write_text("".join(f"{_sha256(p)}  {p.relative_to(root)}\n" for p in names))
    with tarfile.open(target, "w:gz") as tar:
        for p in [*names, root / CHECKSUMS]:
            tar.add(p, p.relative_to(root))
    return _sha256(Path(target))


def unpack(archived: str, path: str) -> list[str]:
    """Unpack an archive; the files whose checksum is not the listed one, or that are missing."""
    with tarfile.open(archived) as tar:
        tar.extractall(path, filter="data")
    root = Path(path)
    listed = [line.split("  ", 1) for line in (root / CHECKSUMS).read_text().splitlines()]
    return [name for sha, name in listed if not (root / name).is_file() or _sha256(root / name) != sha]


def _sha256(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def restore(spark: SparkSession, path: str, old_root: str | None = None, new_root: str | None = None) -> dict[str, DataFrame]:
    """The tables of a complete backup; paths under the old root point to the new one."""
    manifest = json.loads(spark.read.text(f"{path}/_manifest").first().value)
    out = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    if old_root and new_root:
        for name, df in out.items():
            cols = [c for c in ("original_path", "storage_path", "file_path") if c in df.columns]
            out[name] = df.withColumns({c: rewrite_prefix(F.col(c), old_root, new_root) for c in cols})
    return out


def totals(files: DataFrame) -> DataFrame:
    """files, bytes: of a folder's files (path, length)."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def expired(names: list[str], keep: int) -> list[str]:
    """The backups beyond the newest `keep`, by name; 0 keeps all."""
    return sorted(names, reverse=True)[keep:] if keep > 0 else []


def next_time(after: datetime, days: float, hhmm: str) -> datetime:
    """From a day on: so many days later at the time of day; under a day: steps on from today's time until one is later; nothing positive is a day, an
    empty or unreadable time of day is 02:00."""
    days = days if days > 0 else 1
    try:
        h, m = divmod(minutes(hhmm), 60)
    except ValueError:
        h, m = DEFAULT_HOUR, 0
    at = after.replace(hour=h, minute=m, second=0, microsecond=0)
    if days >= 1:
        return at + timedelta(days=int(days))
    step = timedelta(days=days)
    return at if at > after else at + ((after - at) // step + 1) * step


def due(now: datetime, last: datetime | None, days: float, hhmm: str, active: int = 0, recent: int = 0) -> bool:
    """Is a backup to be started: none in work, none lately, and the time after the last one has come?"""
    return not active and not recent and (last is None or next_time(last, days, hhmm) <= now)


def minutes(hhmm: str, end: bool = False) -> int:
    """Minutes of a time of day; 24:00 only as an end."""
    h, m = map(int, hhmm.split(":"))
    if not (0 <= h < 24 and 0 <= m < 60) and not (end and (h, m) == (24, 0)):
        raise ValueError(hhmm)
    return h * 60 + m


def in_windows(now: datetime, windows: list[tuple[str, str]]) -> bool:
    """Is now in one of the windows (start included, end not)? No windows: always."""
    t = now.hour * 60 + now.minute
    return not windows or any(minutes(a) <= t < minutes(b, True) for a, b in windows)

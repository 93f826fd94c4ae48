"""Log files: lines that continue an entry are put back to it."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = r"^\d{4}[-/]\d{2}[-/]\d{2}"
LEAST, MOST, DEFAULT = 100, 5000, 500


def clamp(n: int) -> int:
    return DEFAULT if n <= 0 else max(LEAST, min(MOST, n))


def merge(lines: DataFrame, file: str = "file", pos: str = "pos", line: str = "line") -> DataFrame:
    """file, entry, text: entries of each file (a log's tail, one small group each); lines before the first start are dropped."""
    w = Window.partitionBy(file).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("entry", F.sum(F.when(F.col(line).rlike(START), 1).otherwise(0)).over(w)).filter("entry > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda s: s[line]), "\n")
    return x.groupBy(file, "entry").agg(text.alias("text"))


TAIL_BYTES = 2 << 20


def last_lines(spark: SparkSession, paths: list[str], size: int = TAIL_BYTES) -> DataFrame:
    """file, pos, line: the lines in the last `size` bytes of each log file; a line that begins before that is left out. The files are cut in the tasks, each read from its end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b.path:
                with open(path, "rb") as f:
                    whole = f.seek(0, os.SEEK_END)
                    f.seek(max(0, whole - size))
                    lines = f.read().decode("utf-8", "replace").split("\n")
                lines = lines[1:] if whole > size else lines
                lines = lines[:-1] if lines and not lines[-1] else lines
                yield pd.DataFrame({"file": path, "pos": range(len(lines)), "line": lines})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "file string, pos long, line string")


def tail(lines: DataFrame, n: int = DEFAULT) -> DataFrame:
    """The last n entries of each file."""
    w = Window.partitionBy("file").orderBy(F.desc("entry"))
    return merge(lines).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= clamp(n)).drop("_rn")

"""What the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

#: Rows an Arrow batch holds; with texts of some kB a batch stays in the tens of MB. The bytes bound holds for very long texts.
BATCH_ROWS, BATCH_BYTES = 4000, 64 << 20


def read(spark: SparkSession, data: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return table(spark, data, name)


_BEYOND = re.compile(r"[^\x00-\x7f]+")
_APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[str]:
    """The runs of letters and digits, as `[^\\W_]+` finds them: all that is neither is made a blank at once, in its UTF-8 bytes."""
    if not text.isascii():
        for c in set("".join(_BEYOND.findall(text))):
            if not c.isalnum():
                text = text.replace(c, " ")
    return text.encode("utf-8", "surrogatepass").translate(_APART).decode("utf-8", "surrogatepass").split()


def in_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over the Arrow batches of df."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(out := f(b)):
                yield out

    return df.mapInPandas(run, schema)


def bounded(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows of df, those with the least hashes of the key. A first cut at a share of all hashes, from the row count, leaves little
    more than n rows to order, so no task sees more than a bounded number of texts."""
    total = df.select(key).count()
    if total > 2 * n:
        df = df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(1_000_000)) < int(1_000_000 * 1.5 * n / total) + 1)
    return df.orderBy(F.xxhash64(F.col(key), F.lit(31)), key).limit(n)

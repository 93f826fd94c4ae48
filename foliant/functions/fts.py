"""Full-text search: match, rank and snippet, over texts or over an inverted table of their lexemes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliant.functions.text import lexemes

_TOKEN = re.compile(r"[^\W_]+")


def query_lexemes(query: str) -> list[str]:
    """Distinct lexemes of a query, in order."""
    return list(dict.fromkeys(_TOKEN.findall(query.lower())))


def index_text(title: Column, text: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))


def matches(document: Column, query: str) -> Column:
    """All lexemes of the query are in the document. A query without lexemes matches nothing."""
    qs = query_lexemes(query)
    if not qs:
        return F.lit(False)
    low = F.lower(document)
    # A substring test of each lexeme comes first: it is cheap and keeps most documents from being cut into tokens.
    cheap = F.lit(True)
    for q in qs:
        cheap = cheap & F.contains(low, F.lit(q))
    return cheap & (F.size(F.array_except(F.array(*[F.lit(q) for q in qs]), lexemes(document))) == 0)


#: Places of a lexeme in a document that count.
MOST_PLACES = 256
# The weight of a place, and how two lexemes that stand so many words apart count.
WEIGHT, FAR = 0.1, 100


def rank_of(places: list[Column]) -> Column:
    """The rank of a document by the places of the query's lexemes in it. One lexeme: its k-th place counts 1 / k squared, scaled by the limit of that
    sum. Several: each pair of places counts by the root of its nearness, and the pairs are joined as independent evidence."""
    ps = [F.slice(F.coalesce(p, F.array().cast("array<int>")), 1, MOST_PLACES) for p in places]
    if not ps:
        return F.lit(0.0)
    if len(ps) == 1:
        n = F.size(ps[0])
        series = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda x, k: x + F.lit(1.0) / (k * k))
        return F.round(F.when(n > 0, series * WEIGHT / 1.64493406685).otherwise(0.0), 6)

    def near(d: Column) -> Column:
        return F.when(d > FAR, F.lit(1e-30)).otherwise(F.lit(1.0) / (F.lit(1.005) + F.lit(0.05) * F.exp(d / F.lit(1.5) - F.lit(2.0))))

    def against(one: Column, other: Column) -> Column:
        each = F.flatten(F.transform(one, lambda x: F.transform(other, lambda y: F.abs(x - y).cast("double"))))
        return F.aggregate(each, F.lit(1.0), lambda x, d: x * (F.lit(1.0) - F.lit(WEIGHT) * F.sqrt(near(d))))

    rest = F.lit(1.0)
    for i, one in enumerate(ps):
        for other in ps[:i]:
            rest = rest * against(one, other)
    return F.round(F.lit(1.0) - rest, 6)


def rank(document: Column, query: str) -> Column:
    """`rank_of` the places that the query's lexemes have in the document."""
    toks = lexemes(document)

    def places(q: str) -> Column:
        return F.filter(F.transform(toks, lambda t, i: F.when(t == q, i + 1)), lambda x: x.isNotNull())

    return rank_of([places(q) for q in query_lexemes(query)])


BUCKETS, SHARE = 256, 1_000_000
_INDEX = "bucket int, lexeme string, id long, places array<int>"


def bucket_of(lexeme: str) -> int:
    return crc32(lexeme.encode()) % BUCKETS


def postings(documents: DataFrame, key: str, document: Column) -> DataFrame:
    """bucket, lexeme, id, places: the inverted table of the documents, a row for each lexeme of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, toks in zip(b.id, b.toks):
                places: dict[str, list[int]] = {}
                for n, t in enumerate(toks, 1):
                    if len(own := places.setdefault(t, [])) < MOST_PLACES:
                        own.append(n)
                rows += [(bucket_of(t), t, i, p) for t, p in places.items()]
            yield pd.DataFrame(rows, columns=["bucket", "lexeme", "id", "places"])

    return documents.select(F.col(key).cast("long").alias("id"), lexemes(document).alias("toks")).mapInPandas(run, _INDEX)


def write_index(documents: DataFrame, path: str, key: str, document: Column) -> None:
    """The inverted table as parquet, a folder for each bucket of lexemes. A bucket goes to one writer for each SHARE documents, so that those of a frequent lexeme are shared out."""
    salts = max(1, -(-documents.count() // SHARE))
    p = postings(documents, key, document)
    p.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "lexeme", "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(path)


def hits(index: DataFrame, query: str) -> DataFrame:
    """id, rank: the documents that have all lexemes of the query. Only the buckets of these lexemes are read."""
    qs = query_lexemes(query)
    found = index.filter(F.col("bucket").isin(sorted({bucket_of(q) for q in qs})) & F.col("lexeme").isin(qs))
    places = [F.max(F.when(F.col("lexeme") == q, F.col("places"))).alias(f"p{i}") for i, q in enumerate(qs)]
    g = found.groupBy("id").agg(F.count_distinct("lexeme").alias("n"), *places) if qs else found.select("id", F.lit(-1).alias("n"))
    return g.filter(F.col("n") == len(qs)).select("id", rank_of([F.col(f"p{i}") for i in range(len(qs))]).alias("rank"))


def snippet(query: str, most: int = 64, least: int = 32):
    """A pandas function: the window of at most `most` words with the most lexemes of the query, these between <b> and </b>."""
    qs = set(query_lexemes(query))

    @pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: headline(t, qs, most, least)).fillna("")

    return cut


def headline(text: str | None, qs: set[str], most: int, least: int) -> str:
    if not text:
        return ""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    hit = [i for i, (a, b) in enumerate(spans) if text[a:b].lower() in qs]
    if not spans:
        return ""
    if not hit:
        a, b = 0, min(least, len(spans))
    else:
        best, lo = (0, 0, 0), 0
        for hi in range(len(hit)):
            while hit[hi] - hit[lo] >= most:
                lo += 1
            if hi - lo + 1 > best[0]:
                best = (hi - lo + 1, lo, hi)
        a, b = hit[best[1]], hit[best[2]] + 1
        b = min(len(spans), max(b, a + least))
        a = max(0, min(a, b - least))
    out, at = [], spans[a][0]
    for x, y in spans[a:b]:
        out.append(text[at:x])
        out.append(f"<b>{text[x:y]}</b>" if text[x:y].lower() in qs else text[x:y])
        at = y
    return "".join(out)

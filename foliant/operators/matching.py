"""Embeddings: encoding, matching documents to tags, and tag consolidation."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import stored

#: Most vectors that are held in memory at once; more are taken in blocks of this size.
HELD_VECTORS = 50_000
#: Most similarities (8 bytes each) that a task holds at once.
HELD_CELLS = 4_000_000
# Least similarity for a match and for a replacement, by model.
THRESHOLDS = {"bge-m3": (0.40, 0.80), "mpnet": (0.30, 0.75), "minilm": (0.25, 0.70)}
TOP = 15


def thresholds(model: str) -> tuple[float, float]:
    return next((t for k, t in THRESHOLDS.items() if k in model.lower()), (0.30, 0.75))


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The stand-in encoder: words projected by hash, unit length. Any callable of this form can take its place."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return encode


def windows(words: list[str], size: int, share: float = 0.1) -> list[str]:
    """One text, or windows of `size` words that overlap by a tenth."""
    if size <= 0 or len(words) <= size:
        return [" ".join(words)]
    step = max(1, size - int(size * share))
    return [" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - int(size * share)), step)]


def token_windows(text: str, size: int, count: Callable[[list[str]], list[int]], share: float = 0.1) -> list[str]:
    """Windows of at most `size` tokens (by the caller's count of each word's tokens) that overlap by about a tenth; a word that is longer stands alone."""
    words = text.split()
    costs = count(words)
    if size <= 0 or sum(costs) <= size:
        return [" ".join(words)]
    out, at = [], 0
    while at < len(words):
        end, total = at, 0
        while end < len(words) and (end == at or total + costs[end] <= size):
            total += costs[end]
            end += 1
        out.append(" ".join(words[at:end]))
        if end == len(words):
            break
        back, total = end, 0
        while back - 1 > at and total + costs[back - 1] <= size * share:
            back -= 1
            total += costs[back]
        at = back if total + costs[end] <= size else end  # an overlap that leaves no room for the next word is dropped
    return out


def encode(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], key: str = "id", size: int = 0, batch: int = 32, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """key, embedding: the mean of a text's windows (of `size` words, or tokens if `count` tells those of each word), not brought to unit length again. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [token_windows(t or "", size, count) if count else windows((t or "").split(), size) for t in b.text]
            flat = [p for ps in parts for p in ps]
            vec = np.concatenate([encoder(flat[i : i + batch]) for i in range(0, len(flat), batch)]) if flat else np.zeros((0, 1))
            at = np.cumsum([0, *map(len, parts)])
            yield pd.DataFrame({"key": b.key, "embedding": [vec[x:y].mean(0).astype("float32").tolist() for x, y in zip(at, at[1:])]})

    kt = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kt}, embedding array<float>").withColumnRenamed("key", key)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in double; 0 if the lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


def mean_pool(df: DataFrame, group: str, vector: str, dim: int) -> DataFrame:
    """group, embedding: element-wise mean; the sums combine before they are shuffled."""
    v = [F.avg(F.col(vector)[i].cast("double")).alias(f"v{i}") for i in range(dim)]
    return df.groupBy(group).agg(*v).select(group, F.array(*[F.round(f"v{i}", 6) for i in range(dim)]).alias("embedding"))


def _blocks(targets: DataFrame, held: int) -> Iterator[tuple[list, np.ndarray, bool]]:
    """The targets in blocks of bounded size, by the hash of their key; and whether there are several."""
    n = targets.count()
    k = max(1, -(-n // held))
    t = targets.withColumn("_b", F.pmod(F.xxhash64("t"), F.lit(k)))
    for b in range(k):
        rows = [r for r in t.filter(F.col("_b") == b).select("t", "v").collect() if r.v is not None]
        for size in sorted({len(r.v) for r in rows}):  # vectors of other lengths are alike in nothing
            own = [r for r in rows if len(r.v) == size]
            yield [r.t for r in own], np.array([r.v for r in own], np.float64), k > 1


def similar(queries: DataFrame, targets: DataFrame, least: float, top: int = TOP, held: int = HELD_VECTORS) -> DataFrame:
    """q, t, similarity: of each query (q, v) the `top` targets (t, v) with similarity of at least `least`, ties by t.
    The targets come in blocks of bounded size to all tasks, one after the other, so that the driver holds one; a query's best of each block meet in a small group."""
    qt, tt = dict(queries.dtypes)["q"], dict(targets.dtypes)["t"]
    out = None
    for names, m, more in _blocks(targets, held):
        b = queries.sparkSession.sparkContext.broadcast((names, m))

        def run(batches: Iterator[pd.DataFrame], b=b) -> Iterator[pd.DataFrame]:
            names, m = b.value
            order = np.argsort(np.array(names), kind="stable")
            names, m = [names[i] for i in order], m[order]
            step = max(1, HELD_CELLS // len(names))
            for x in batches:
                rows = []
                ok = [v is not None and len(v) == m.shape[1] for v in x.v]
                sub = x[ok]
                for at in range(0, len(sub), step):
                    part = sub.iloc[at : at + step]
                    sims = np.stack(part.v.to_list()).astype(np.float64) @ m.T
                    for q, s in zip(part.q, sims):
                        near = np.flatnonzero(s >= least - 1e-6)
                        s = np.round(s[near], 6)
                        near, s = near[s >= least], s[s >= least]
                        for i in np.argsort(-s, kind="stable")[:top]:
                            rows.append((q, names[near[i]], float(s[i])))
                yield pd.DataFrame(rows, columns=["q", "t", "similarity"])

        asked = queries.select("q", "v")
        if more:  # the work is in the pairs, not in the bytes that Spark divides by
            asked = asked.repartition(4 * queries.sparkSession.sparkContext.defaultParallelism)
        one = asked.mapInPandas(run, f"q {qt}, t {tt}, similarity double")
        if more:
            one = stored(one, "similar")
            b.unpersist()
        out = one if out is None else out.unionByName(one)
    if out is None:
        return queries.sparkSession.createDataFrame([], f"q {qt}, t {tt}, similarity double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), "t"))), 1, top)
    return out.groupBy("q").agg(best.alias("x")).select("q", F.explode("x").alias("x")).select("q", F.col("x.t").alias("t"), (-F.col("x.n")).alias("similarity"))


def consolidate(queries: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """q, name, result: the best tag at or over the threshold, else the name as it was normalised; a threshold of 0 changes nothing."""
    if least <= 0:
        return queries.select("q", "name", F.col("name").alias("result"))
    best = similar(queries, targets, least, 1).select("q", F.col("t").alias("best"))
    return queries.select("q", "name").join(best, "q", "left").select("q", "name", F.coalesce("best", "name").alias("result"))

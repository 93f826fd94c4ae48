"""Mixing sources to target weights.

Documents become tokens of a public tokenizer (a vocabulary file given by its path) and, source by source, streams of tokens that are cut into blocks of BLOCK tokens. A large
source has many streams (hash buckets of bounded size), so no window holds a source. The output is cut into shards of SLOTS slots; each shard draws how
many slots each source gets from a multinomial of the target weights, with the shard's own seed. The slots of a source are numbered over
all shards by prefix sums; number r is turn r / blocks of the source, at place r % blocks, and that place goes through a pseudorandom permutation
(a Feistel network with cycle walking, keyed by source and turn) to a block, which is joined by its index. Turns beyond max_repeats
are never given out: the size of the mixture is such that the scarcest source stays MARGIN standard deviations below it.

Every token of a document lies in one block, so no document is used more than max_repeats times. Sources that are listed but have no tokens
are left out and the weights of the others scaled to 1; sources that are not listed give nothing.

Defined results: null and empty texts have no tokens; rows of one id count once (the first text); a null or negative weight or a max_repeats under 1 leaves a source out; without usable
sources the mixture is empty; the last block of a stream is shorter.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.session import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK, SLOTS, STREAM_DOCS, CHUNK, MARGIN = 256, 2048, 20_000, 500, 4.0

# Fixed value: how a byte-level vocabulary of this kind cuts text before it merges bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a vocabulary file of ranks, one for each process; the file has to lie at the path on every machine."""
    if path not in _ENCODERS:
        import tiktoken

        if not os.path.exists(path):
            raise FileNotFoundError(f"no vocabulary file at {path}: give its path on the executors as `path`")

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, key: str, text: str, source: str, path: str = TOKENIZER) -> DataFrame:
    """key, source, tokens of each document with tokens; rows of one id count once."""
    df = docs.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).filter("text <> '' and source is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            texts = [t.encode("utf-8", "replace").decode() for t in b.text]
            n = [len(x) for x in e.encode_ordinary_batch(texts, num_threads=1)]
            yield pd.DataFrame({"key": b.key, "source": b.source, "tokens": n})

    return df.mapInPandas(run, "key long, source string, tokens long").groupBy("key").agg(F.min(F.struct("source", "tokens")).alias("x")).select("key", "x.*")


def permute(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """The image of i under a pseudorandom permutation of 0..n-1: a Feistel network, walked until it falls below n."""
    if n <= 1:
        return np.zeros(len(i), np.int64)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = i.astype(np.uint64)
    todo = np.arange(len(i))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(5):
            k = np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            x = right ^ k
            with np.errstate(over="ignore"):
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def slices(counts: DataFrame) -> DataFrame:
    """source, block (an index in its source), part, key, first, last (tokens of the document, last excluded): what the blocks hold."""
    sizes = counts.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    streams = F.greatest(F.lit(1), F.ceil(F.col("docs") / STREAM_DOCS)).cast("long")
    c = counts.join(sizes, "source").withColumn("stream", F.pmod(F.xxhash64("key"), streams).cast("int"))
    w = Window.partitionBy("source", "stream").orderBy(F.xxhash64("key", F.lit(7)), "key")
    c = c.withColumn("end", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("tokens"))
    per = c.groupBy("source", "stream").agg(F.ceil(F.sum("tokens") / BLOCK).alias("blocks"))
    per = per.withColumn("base", F.coalesce(F.sum("blocks").over(Window.partitionBy("source").orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a stream
    c = c.filter("tokens > 0").join(per.select("source", "stream", "base"), ["source", "stream"])
    c = c.withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))))
    first = F.greatest(F.lit(0), F.col("b") * BLOCK - F.col("begin"))
    last = F.least(F.col("tokens"), (F.col("b") + 1) * BLOCK - F.col("begin"))
    at = F.greatest(F.lit(0), F.col("begin") - F.col("b") * BLOCK)
    return c.select("source", (F.col("base") + F.col("b")).alias("block"), at.cast("int").alias("at"), "key", first.alias("first"), last.alias("last"))


def plan(blocks: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[list[str], np.ndarray, int]:
    """The sources, their weights scaled to 1, and the slots of the mixture."""
    names = sorted(s for s, (w, r) in targets.items() if w > 0 and r >= 1 and blocks.get(s))
    if not names:
        return [], np.zeros(0), 0
    w = np.array([targets[s][0] for s in names])
    w = w / w.sum()
    most = math.inf
    for s, x in zip(names, w):
        cap = targets[s][1] * blocks[s]
        sd = MARGIN * math.sqrt(1 - x)
        most = min(most, ((math.sqrt(sd * sd + 4 * cap) - sd) / 2) ** 2 / x)
    return names, w, max(1, int(most if total is None else min(most, total)))


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, path: str = TOKENIZER, total_blocks: int | None = None) -> DataFrame:
    """shard, slot, source, turn, block, at, key, first, last: the slices of documents (in tokens) in the order of the mixture.
    Sort by shard, slot, at to read it. targets: source, weight, max_repeats (a list of sources, one row each)."""
    spark = docs.sparkSession
    want = {r.source: (float(r.w or 0), int(r.m or 0)) for r in targets.filter("source is not null").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeats").alias("m")).collect()}
    usable = [s for s, (w, r) in want.items() if w > 0 and r >= 1]
    parts = stored(slices(stored(token_counts(docs.filter(F.col(source).isin(usable)), key, text, source, path), "tokens")), "slices")  # what no target names is not tokenised
    blocks = {r.source: int(r.n) for r in parts.groupBy("source").agg((F.max("block") + 1).alias("n")).collect()}
    names, w, slots = plan(blocks, want, total_blocks)
    shards = -(-slots // SLOTS) if names else 0
    n = np.array([blocks[s] for s in names])
    most = np.array([want[s][1] for s in names])

    def sizes(shard: int) -> np.ndarray:
        rng = np.random.default_rng([seed, shard])
        return rng.multinomial(min(SLOTS, slots - shard * SLOTS), w)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"chunk": b.id // CHUNK, "n": [sizes(i).tolist() for i in b.id]})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, base in zip(b.chunk, b.base):
                at = np.array(base, np.int64)
                for shard in range(chunk * CHUNK, min(shards, (chunk + 1) * CHUNK)):
                    k = sizes(shard)
                    src = np.repeat(np.arange(len(names)), k)
                    r = np.concatenate([at[j] + np.arange(k[j]) for j in range(len(names))])
                    turn = r // n[src]
                    block = np.zeros(len(r), np.int64)
                    for j in np.unique(src).tolist():
                        for t in np.unique(turn[src == j]).tolist():
                            here = (src == j) & (turn == t)
                            block[here] = permute(r[here] % n[j], int(n[j]), hash((seed, j, t)) & 0x7FFFFFFFFFFF)
                    slot = permute(np.arange(len(r)), len(r), hash((seed, 99, shard)) & 0x7FFFFFFFFFFF)
                    ok = turn < most[src]
                    yield pd.DataFrame({"shard": shard, "slot": slot[ok], "source": [names[j] for j in src[ok]], "turn": turn[ok], "block": block[ok]})
                    at += k

    schema = "shard long, slot int, source string, turn int, block long"
    if not shards:
        drawn_slots = spark.createDataFrame([], schema)
    else:
        chunks = -(-shards // CHUNK)
        per = spark.range(shards).mapInPandas(drawn, "chunk long, n array<long>")
        one = per.select("chunk", F.posexplode("n").alias("j", "k")).groupBy("chunk", "j").agg(F.sum("k").alias("k"))
        base = one.withColumn("base", F.coalesce(F.sum("k").over(Window.partitionBy("j").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for CHUNK shards
        base = base.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "base"))), lambda x: x["base"]).alias("base"))
        drawn_slots = base.repartition(min(chunks, 2000)).mapInPandas(placed, schema)
    out = drawn_slots.join(parts.hint("merge"), ["source", "block"])  # no side may be broadcast, however small it looks
    return out.select("shard", "slot", "source", "turn", "block", "at", F.col("key").alias(key), "first", "last")


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """source, weight, tokens, share (of all tokens of the mixture), turns (the most that a document was used): targets and what came of them."""
    got = mixed.groupBy("source").agg(F.sum(F.col("last") - F.col("first")).alias("tokens"), (F.max("turn") + 1).alias("turns"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "weight").join(got, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    return out.select("source", "weight", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), F.coalesce("turns", F.lit(0)).alias("turns"))

"""Reducing texts to their most telling chunks.

A text is cut into chunks of whole sentences; a chunk's score is made of rare words, its place in the graph of word overlap, and its
position. Chunks are taken greedily until the target is met, and each pick weighs down what resembles it. A text is one row, so its chunk
graph is a small matrix inside one Arrow batch and nothing is shuffled.

Where all chunks have the same words (or there is one) the rare-word score is 0 for all; equal scores go by position."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import DROPPED, lexemes

CHUNK, LEAST_TARGET, WORDS = 150, 2000, 2048
# Weights of the three scores, damping, steps, tolerance, resemblance from which a pick weighs down others, its full penalty.
WEIGHTS, DAMPING, STEPS, TOLERANCE, ALIKE, PENALTY = (0.4, 0.4, 0.2), 0.85, 100, 1e-4, 0.15, 0.9

_BREAK = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"[^\W_]+")
_CLEAN = str.maketrans("", "", DROPPED)


def target_words(words: int, target: int) -> int:
    """A negative target is a divisor of the word count; never under LEAST_TARGET."""
    return max(LEAST_TARGET, words // -target if target < 0 else target)


def chunked(words: list[str], size: int) -> list[tuple[list[str], int]]:
    """(words, how many of them the next chunk repeats): whole sentences up to `size` words; a longer sentence stays whole."""
    out: list[tuple[list[str], int]] = []
    now: list[str] = []
    for sentence in _BREAK.split(" ".join(words)):
        ws = sentence.split()
        if ws and now and len(now) + len(ws) > size:
            last = next((i for i in range(len(now) - 1, -1, -1) if now[i][-1] in ".!?"), 0)
            out.append((now, len(now) - last))
            now = now[last:] + ws
        elif ws:
            now = now + ws
    return [*out, (now, 0)] if now else out


def overlap(sets: list[set[str]]) -> np.ndarray:
    """Jaccard similarity of all pairs. Words are taken WORDS at a time, so that the chunk by word matrix stays small; words of one chunk only link nothing."""
    ids: dict[str, int] = {}
    seen = Counter(w for s in sets for w in s)
    rows, cols = [], []
    for r, s in enumerate(sets):
        for w in s:
            if seen[w] > 1:
                rows.append(r)
                cols.append(ids.setdefault(w, len(ids)))
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    n = np.array([len(s) for s in sets], float)
    both = np.zeros((len(sets), len(sets)))
    for a in range(0, len(ids), WORDS):
        lo, hi = np.searchsorted(cols, [a, a + WORDS])
        m = np.zeros((len(sets), WORDS), np.float32)
        m[rows[lo:hi], cols[lo:hi] - a] = 1
        both += m @ m.T
    np.fill_diagonal(both, n)
    for r in range(len(sets)):  # row by row: no further matrix of all pairs
        union = n[r] + n - both[r]
        both[r] = np.divide(both[r], union, out=np.zeros(len(sets)), where=union > 0)
    return both


def graph_scores(sim: np.ndarray) -> np.ndarray:
    """Weighted rank of the chunks. The self link takes part in what a chunk gives out but not in what it receives, and the step that meets the tolerance is not taken."""
    n = len(sim)
    own = np.diagonal(sim)
    total = sim.sum(1) - own + 1.0
    s = np.full(n, 1.0 / n)
    for _ in range(STEPS):
        part = s / total
        new = (1 - DAMPING) / n + DAMPING * (part @ sim - part * own)
        if np.abs(new - s).sum() < TOLERANCE:
            break
        s = new
    return s / s.sum() if s.sum() > 0 else s


def scores(text: str, chunks: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
    """(final scores, similarity of all pairs)."""
    toks = [_TOKEN.findall(" ".join(ws)) for ws, _ in chunks]
    n = len(chunks)
    df = Counter(t for ts in toks for t in set(ts))
    tf = np.array([sum(k / len(ts) * np.log((n + 1) / (df[t] + 1)) for t, k in sorted(Counter(ts).items())) if ts else 0.0 for ts in toks])
    tf = tf / tf.sum() if tf.sum() > 0 else np.zeros(n)
    sim = overlap([set(ts) for ts in toks])
    p = np.arange(n) / n
    size = len(text.encode())
    dense = size == 0 or text.count("\n") / size * 1000 > 20
    pos = np.maximum(np.exp(-4 * p), np.exp(-4 * (1 - p))) if dense else 0.5 + 0.5 * np.abs(np.cos(2 * np.pi * p))
    pos = pos / pos.sum()
    return WEIGHTS[0] * tf + WEIGHTS[1] * graph_scores(sim) + WEIGHTS[2] * pos, sim


def reduce_text(text: str, target: int, size: int = CHUNK) -> str:
    """The text reduced to about `target` words; unchanged where the target is 0 or not exceeded."""
    if target <= 0 or len(text.split()) < target:
        return text
    clean = text.translate(_CLEAN)
    chunks = chunked(clean.split(), size)
    if not chunks:
        return text
    final, sim = scores(clean, chunks)
    picked, left, words = [0], np.arange(1, len(chunks)), len(chunks[0][0])
    while len(left) and words < target:
        best = left[np.lexsort((left, -final[left]))[0]]
        picked.append(int(best))
        words += len(chunks[best][0])
        left = left[left != best]
        s = sim[best, left]
        final[left] = np.where(s > ALIKE, final[left] * (1 - PENALTY * s), final[left])
    picked.sort()
    out = " ".join(chunks[picked[0]][0])
    for a, b in zip(picked, picked[1:]):
        ws, again = chunks[b]
        out += " " + " ".join(ws[again:]) if b == a + 1 else " [...] " + " ".join(ws)
    return out


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, score: of each document's tokens their share of it times log((documents + 1) / (documents with the token + 1))."""
    toks = df.select(F.col(key).alias("key"), lexemes(F.col(text)).alias("ts"))
    n = F.count(F.lit(1))
    each = toks.select("key", F.size("ts").alias("size"), F.explode("ts").alias("token")).groupBy("key", "size", "token").agg(n.alias("n"))
    of = each.groupBy("token").agg(n.alias("df"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = each.join(of, "token").join(F.broadcast(total), F.lit(True))
    score = F.col("n") / F.col("size") * F.log((F.col("total") + 1) / (F.col("df") + 1))
    return out.select(F.col("key").alias(key), "token", F.round(score, 8).alias("score"))


def reduce(df: DataFrame, key: str, text: str, target: int, size: int = CHUNK) -> DataFrame:
    """key, text, words: each text reduced. Null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [reduce_text(t, target_words(len(t.split()), target), size) if isinstance(t, str) else None for t in b.text]
            yield pd.DataFrame({"key": b.key, "text": out, "words": [len(t.split()) if t is not None else 0 for t in out]})

    kt = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kt}, text string, words int").withColumnRenamed("key", key)


def chunk_rows(df: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """key, chunk, words, overlap, score: the chunks of each text. Null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b.key, b.text):
                clean = t.translate(_CLEAN) if isinstance(t, str) else ""
                chunks = chunked(clean.split(), size)
                if chunks:
                    final, _ = scores(clean, chunks)
                    rows += [(k, i, len(ws), o, float(f)) for i, ((ws, o), f) in enumerate(zip(chunks, final))]
            yield pd.DataFrame(rows, columns=["key", "chunk", "words", "overlap", "score"])

    kt = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kt}, chunk int, words int, overlap int, score double").withColumnRenamed("key", key)

"""Splitting oversized texts at natural boundaries, with an exact overlap.

A piece ends at a cut c and the next one begins at c - overlap, so a piece that follows the cut c can reach as far as
c + max - overlap. All positions where a text may be cut form one table of boundaries (paragraph, line, sentence and word ends;
within a run that has no boundary, positions a full step apart). Every boundary is joined to its farthest legal
successor: of the boundaries within reach the last paragraph end if it lies in the second half of the reach, else the
last line or sentence end there, else the last word end, else the last position. The successor table of all texts of a batch is
one array; it is squared again and again (pointer doubling), and the cuts reached from the starts are marked, so that
2^k cuts are known after k rounds, for a long text as for many short ones.

Defined results: a null or empty text gives one piece (null stays null, of length 0); a text within its limit is one piece; an unknown or null type has the
limit of `*`, or no limit where `*` is missing; a null overlap is 0; an overlap of max_chars or more is taken as max_chars - 1; a limit under 1 is none. Lengths are in code points.
The rows of one id are split one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import in_batches

BROADCAST_TYPES = 10_000

_BOUNDARY = re.compile(r"(?P<p>\n[ \t\r]*\n\s*|\f\s*)|(?P<l>\r?\n[ \t]*)|(?P<s>(?<=[.!?。！？])[\"'”»)\]]*[ \t]+)|(?P<w>[ \t ]+)")
_LEVEL = {"p": 3, "l": 2, "s": 2, "w": 1}


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the text may be cut, ascending, and their levels; the first is 0, the last the length, no gap is wider than a step."""
    pos, level = [0], [0]
    for m in _BOUNDARY.finditer(text):
        e = m.end()
        if e - pos[-1] > step:
            far = range(pos[-1] + step, e, step)
            pos.extend(far)
            level.extend([0] * len(far))
        pos.append(e)
        level.append(_LEVEL[m.lastgroup])
    n = len(text)
    if n - pos[-1] > step:
        far = range(pos[-1] + step, n, step)
        pos.extend(far)
        level.extend([0] * len(far))
    if pos[-1] != n:
        pos.append(n)
        level.append(0)
    return np.array(pos, np.int64), np.array(level, np.int8)


def successors(pos: np.ndarray, level: np.ndarray, step: int, first: int) -> np.ndarray:
    """The index of each boundary's farthest legal successor; the last boundary is its own. The first piece reaches `first`, others a step."""
    n = len(pos)
    reach = pos + step
    reach[0] = first
    far = np.searchsorted(pos, reach, "right") - 1
    at = np.arange(n)
    far = np.maximum(far, np.minimum(at + 1, n - 1))
    far[reach >= pos[-1]] = n - 1
    best = far.copy()
    chosen = far == n - 1
    for least in (3, 2, 1):
        last = np.maximum.accumulate(np.where(level >= least, at, -1))[far]  # the last boundary of that level within reach
        ok = ~chosen & (last > at) & ((pos[np.maximum(last, 0)] - pos) * 2 >= reach - pos)
        best[ok] = last[ok]
        chosen |= ok
    return best


def cuts(nexts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks of all boundaries reached from the starts, by squaring the successor table."""
    reached = np.zeros(len(nexts), bool)
    reached[starts] = True
    jump = nexts
    while True:
        new = jump[reached]
        before = int(reached.sum())
        reached[new] = True
        if int(reached.sum()) == before and bool(np.isin(jump[starts], ends).all()):
            return reached
        jump = jump[jump]


def split_batch(texts: list[str | None], most: np.ndarray, overlap: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text; most 0: no limit."""
    out: list[list[tuple[int, int]]] = [[(0, len(t or ""))] for t in texts]
    tables, rows, base = [], [], 0
    for i, t in enumerate(texts):
        if t and 0 < most[i] < len(t):
            step = int(most[i] - overlap[i])
            pos, level = boundaries(t, step)
            tables.append((pos, successors(pos, level, step, int(most[i])) + base, base))
            rows.append(i)
            base += len(pos)
    if rows:
        nexts = np.concatenate([x[1] for x in tables])
        starts = np.array([x[2] for x in tables])
        reached = cuts(nexts, starts, np.append(starts[1:], base) - 1)
        for i, (pos, _, at) in zip(rows, tables):
            c = pos[reached[at : at + len(pos)]].tolist()
            out[i] = [(max(0, a - int(overlap[i])), b) for a, b in zip(c, c[1:])]
    return out


def type_key(c: Column) -> Column:
    """A media type without case and parameters."""
    return F.lower(F.trim(F.split(c, ";", 2)[0]))


def with_limits(docs: DataFrame, limits: DataFrame, kind: str = "original_type") -> DataFrame:
    """docs with max_chars and overlap_chars. The limits are reduced to one row a type; up to BROADCAST_TYPES of them are broadcast."""
    each = limits.groupBy(type_key(F.col("original_type")).alias("_type")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("_limit"))
    star = each.filter("_type = '*'").select(F.col("_limit").alias("_star"))
    few = each.limit(BROADCAST_TYPES + 1).count() <= BROADCAST_TYPES
    df = docs.withColumn("_type", type_key(F.col(kind))).join(F.broadcast(each) if few else each, "_type", "left")
    df = df.join(F.broadcast(star), F.lit(True), "left")
    limit = F.coalesce("_limit", "_star")
    most = F.greatest(F.coalesce(limit["max_chars"], F.lit(0)), F.lit(0))
    over = F.least(F.greatest(F.coalesce(limit["overlap_chars"], F.lit(0)), F.lit(0)), F.greatest(most - 1, F.lit(0)))
    return df.withColumns({"max_chars": most, "overlap_chars": over}).drop("_type", "_limit", "_star")


def split(docs: DataFrame, limits: DataFrame, key: str = "id", text: str = "text_content", kind: str = "original_type", with_text: bool = True) -> DataFrame:
    """key, piece (from 1), pieces, start, end and, with_text, the piece's text; one row a piece."""
    df = with_limits(docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(kind).alias("kind")), limits, "kind").drop("kind")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in b.text]
        keys, rows = b.key.tolist(), []
        for k, t, ps in zip(keys, texts, split_batch(texts, b.max_chars.to_numpy(), b.overlap_chars.to_numpy())):
            for i, (s, e) in enumerate(ps):
                rows.append((k, i + 1, len(ps), s, e, t[s:e] if with_text and t is not None else None))
        return pd.DataFrame(rows, columns=["key", "piece", "pieces", "start", "end", "text"])

    out = in_batches(df, run, f"key {dict(docs.dtypes)[key]}, piece int, pieces int, start long, end long, text string")
    return (out if with_text else out.drop("text")).withColumnRenamed("key", key)

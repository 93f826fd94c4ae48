"""Mapping freely typed values to a canonical list.

The entries stand in a BK-tree under the unrestricted Damerau-Levenshtein distance, a true metric; the triangle
inequality prunes the branches that hold nothing within the threshold, and all entries within it come back. A list of
up to BROADCAST_ENTRIES entries is broadcast and each task builds the tree once; a longer one is cut into shards, each
name visits the tree of every shard, and the shards' winners are merged by a min. Names are looked up once for each spelling.

Before the search a name is brought to a canonical spelling (case, accents, separators, digits typed for letters,
wrappers such as "tag:", "etc.", a year or a remark in brackets are dropped), its words are also read in other orders (four and more: rotated or sorted), and
words cut off with a full stop are completed from the words of the entries. Keys are compared without spaces, so missing and doubled spaces cost nothing.

Defined results: a null, empty or wordless name is unmatched (0); two entries at the same least distance leave a name unmatched unless
they have the same spelling, where the smaller entry_id counts; rows of one id count once (the smallest entry found); an empty vocabulary leaves all unmatched.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import stored

BROADCAST_ENTRIES = 20_000
SHARD_ENTRIES = 20_000
#: Distinct names that one task looks up in one shard.
BLOCK_NAMES = 20_000
#: Distinct names that one task looks up in the broadcast list: a second or two of work, which no reader of small files would share out.
TASK_NAMES = 1000

# Digits and signs typed for letters.
LOOKALIKES = {"0": "o", "1": "l", "3": "e", "5": "s", "@": "a", "$": "s", "|": "l"}


def distance(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance (a metric), or most + 1 where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    inf = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        d[i + 1][1] = i
        row, up, k = d[i + 1], d[i], 0
        x = a[i - 1]
        for j in range(1, len(b) + 1):
            y = b[j - 1]
            i1, j1 = last.get(y, 0), k
            cost = 1
            if x == y:
                cost, k = 0, j
            v = up[j] + cost
            if row[j] + 1 < v:
                v = row[j] + 1
            if up[j + 1] + 1 < v:
                v = up[j + 1] + 1
            if i1 and j1:
                t = d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1)
                if t < v:
                    v = t
            row[j + 1] = v
        last[x] = i
    return d[-1][-1]


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """`distance` of many pairs at once: row i of a (la[i] letters, small integers from 1, then 0) and of b."""
    n, wa, wb = len(a), int(la.max(initial=0)), int(lb.max(initial=0))
    at, inf = np.arange(n), np.int16(wa + wb + 1)
    d = np.full((wa + 2, wb + 2, n), inf, np.int16)
    d[1, 1:] = np.arange(wb + 1, dtype=np.int16)[:, None]
    d[1:, 1] = np.arange(wa + 1, dtype=np.int16)[:, None]
    last = np.zeros((int(max(a.max(initial=0), b.max(initial=0))) + 1, n), np.int16)
    for i in range(1, wa + 1):
        x, k = a[:, i - 1], np.zeros(n, np.int16)
        for j in range(1, wb + 1):
            y = b[:, j - 1]
            i1, same = last[y, at], x == y
            v = np.minimum(np.minimum(d[i, j + 1], d[i + 1, j]) + 1, d[i, j] + ~same)
            swap = (i1 > 0) & (k > 0) & ~same
            if swap.any():
                w = np.flatnonzero(swap)
                v[w] = np.minimum(v[w], d[i1[w], k[w], w] + (i - i1[w]) + (j - k[w]) - 1)
            d[i + 1, j + 1] = v
            k = np.where(same, np.int16(j), k)
        last[x, at] = i
    return d[la + 1, lb + 1, at]


def _letters(keys: list[str], wide: int, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(keys), wide), np.int32)
    for r, k in enumerate(keys):
        for c, x in enumerate(k):
            out[r, c] = ids.setdefault(x, len(ids) + 1)
    return out, np.array([len(k) for k in keys], np.int64)


class BKTree:
    """Keys with their entries, under `distance`. Nodes are numbered; below[n] maps a distance to the child at it."""

    PAIRS = 20_000  # node visits worked on at once

    def __init__(self, keys: dict[str, set[int]]):
        self.keys = sorted(keys)
        self.ids = [keys[k] for k in self.keys]
        self.letters: dict[str, int] = {}
        self.wide = max(map(len, self.keys), default=0)
        self.table, self.lens = _letters(self.keys, self.wide, self.letters)
        self.below: list[dict[int, int]] = [{} for _ in self.keys]
        pending = [(0, np.arange(1, len(self.keys)))] if self.keys else []
        while pending:  # the same tree as by inserting one key after the other: a node's first key at each distance is its child there
            node, rest = pending.pop()
            if not len(rest):
                continue
            d = self._from(self.table[node], self.lens[node], rest)
            for x in np.unique(d).tolist():
                at = rest[d == x]
                self.below[node][x] = int(at[0])
                pending.append((int(at[0]), at[1:]))

    def _from(self, row: np.ndarray, length: int, nodes: np.ndarray) -> np.ndarray:
        out = [distances(np.repeat(row[None], len(c), 0), np.full(len(c), length), self.table[c], self.lens[c]) for c in np.array_split(nodes, -(-len(nodes) // self.PAIRS))]
        return np.concatenate(out)

    def within(self, queries: list[str], most: list[int]) -> list[list[tuple[int, str, set[int]]]]:
        """For each query all keys within its distance, with it and their entries. The frontiers of all queries advance together."""
        out: list[list[tuple[int, str, set[int]]]] = [[] for _ in queries]
        short = [i for i, q in enumerate(queries) if len(q) <= self.wide + most[i]]  # a longer one is too far from every key
        if not short or not self.keys:
            return out
        letters = dict(self.letters)
        table, lens = _letters([queries[i] for i in short], max(len(queries[i]) for i in short), letters)
        frontier = [(q, 0) for q in range(len(short))]
        while frontier:
            chunk, frontier = frontier[-self.PAIRS :], frontier[: -self.PAIRS]
            qs, ns = np.array([c[0] for c in chunk]), np.array([c[1] for c in chunk])
            d = distances(table[qs], lens[qs], self.table[ns], self.lens[ns])
            for (q, node), x in zip(chunk, d.tolist()):
                m = most[short[q]]
                if x <= m:
                    out[short[q]].append((x, self.keys[node], self.ids[node]))
                frontier += [(q, c) for k, c in self.below[node].items() if x - m <= k <= x + m]
        return out


def words(name: str) -> list[str]:
    """The words of a name in canonical spelling; a word cut off with a full stop keeps the stop."""
    s = unicodedata.normalize("NFKD", name).casefold()
    s = "".join(c for c in s if not unicodedata.combining(c))
    s = re.sub(r"^\W*(tags?|labels?|topics?)\s*:", " ", s)
    s = re.sub(r"(?<=[^\W\d_])[01345@$|](?=[^\W\d_])|(?<![\w@$|])[01345@$|](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[01345@$|](?![\w@$|])", lambda m: LOOKALIKES.get(m[0], m[0]), s)
    s = re.sub(r"\((old|new|\d+)\)|(?<!\w)(19|20)\d\d(?!\w)|(?<!\w)etc\b\.?", " ", s)
    return re.findall(r"[^\W_]+\.(?=\s|$)|[^\W_]+", s)


def _orders(ws: list[str]) -> Iterator[str]:
    """The words in all orders up to three, else rotated and (for all other orders) sorted; without spaces."""
    if len(ws) <= 3:
        yield from ("".join(p) for p in itertools.permutations(ws))
    else:
        yield from ("".join(ws[i:] + ws[:i]) for i in range(len(ws)))
        yield "".join(sorted(ws))


class Canon:
    """The entries of one shard."""

    def __init__(self, entries: list[tuple[int, str]]):
        keys: dict[str, set[int]] = {}
        self.spelling: dict[int, str] = {}
        self.parts: dict[int, list[str]] = {}
        for i, name in entries:
            ws = [w.rstrip(".") for w in words(name)]
            if ws:
                self.spelling[i], self.parts[i] = "".join(ws), ws
                for k in _orders(ws):
                    keys.setdefault(k, set()).add(i)
                if len(ws) > 2:  # the initials of three words and more stand for them
                    keys.setdefault("".join(w[0] for w in ws), set()).add(i)
        self.tree = BKTree(keys)
        self.starts: dict[str, set[int]] = {}
        for i, ws in self.parts.items():
            for w in ws:
                self.starts.setdefault(w[:2], set()).add(i)

    def completed(self, ws: list[str]) -> set[str]:
        """Readings of a name with words cut off by a full stop: each word a start of the entry's word at its place."""
        out = set()
        for i in self.starts.get(ws[0][:2], ()):
            full = self.parts[i]
            if len(full) == len(ws) and all(f.startswith(w[:-1]) if w[-1] == "." and len(w) > 2 else f == w for f, w in zip(full, ws)):
                out.add("".join(full))
        return out

    def best(self, names: list[str | None]) -> list[tuple[int, int]]:
        """For each name (distance, entry), or (99, 0). Two different entries at the least distance: (distance, 0)."""
        return [(d, i) for d, i, _ in self.nearest(names)]

    def nearest(self, names: list[str | None]) -> list[tuple[int, int, str]]:
        """`best` with the spelling of the entry ('' for none)."""
        asked, owner = [], []
        for i, name in enumerate(names):
            ws = words(name or "")
            if not ws:
                continue
            bare = [w.rstrip(".") for w in ws]
            readings = {"".join(bare)} | ({"".join(sorted(bare))} if len(bare) > 3 else set())
            if any(w[-1] == "." for w in ws[:-1]) or (len(ws[-1]) > 2 and ws[-1][-1] == "." and len(ws) > 1):
                readings |= self.completed(ws)
            asked += sorted(readings)
            owner += [i] * len(readings)
        hits: dict[int, list] = {}
        for i, h in zip(owner, self.tree.within(asked, [allowed(k) for k in asked])):
            hits.setdefault(i, []).extend(h)
        out = []
        for i in range(len(names)):
            if not (h := hits.get(i)):
                out.append((99, 0, ""))
                continue
            least = min(x[0] for x in h)
            ids = set().union(*(x[2] for x in h if x[0] == least))
            spellings = {self.spelling[e] for e in ids}
            out.append((least, min(ids), spellings.pop()) if len(spellings) == 1 else (least, 0, ""))
        return out


def allowed(key: str) -> int:
    """Edits allowed for a key: none up to 4 letters, 1 up to 7, 2 up to 15, else 3."""
    n = len(key)
    return 0 if n <= 4 else 1 if n <= 7 else 2 if n <= 15 else 3


def map_values(values: DataFrame, vocabulary: DataFrame, key: str = "id", name: str = "name", entry: str = "entry_id", entry_name: str = "name", shard_entries: int = SHARD_ENTRIES, broadcast_entries: int = BROADCAST_ENTRIES, block_names: int = BLOCK_NAMES) -> DataFrame:
    """key, entry_id (0: none), distance (null: none): one row a key."""
    vals = values.select(F.col(key).alias("key"), F.col(name).alias("name"))
    vocab = vocabulary.select(F.col(entry).cast("long").alias("e"), F.col(entry_name).alias("n")).filter("e is not null and n is not null")
    size = vocab.count()
    typed = stored(vals.select("name").filter("name is not null").distinct(), "names")  # each spelling is looked up once
    spellings = typed.count()
    if size <= broadcast_entries:
        entries = vals.sparkSession.sparkContext.broadcast([(r.e, r.n) for r in vocab.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            canon = Canon(entries.value)
            for b in batches:
                got = canon.best(list(b.name))
                yield pd.DataFrame({"name": b.name, "d": [g[0] for g in got], "e": [g[1] for g in got]})

        won = typed.repartition(max(1, -(-spellings // TASK_NAMES))).mapInPandas(run, "name string, d int, e long").filter("d < 99")
    else:
        shards = -(-size // shard_entries)
        each = vocab.withColumn("shard", F.pmod(F.xxhash64("e"), F.lit(shards)).cast("int"))
        count = max(1, -(-spellings // block_names))  # blocks of bounded size, as many as there are names for
        block = F.pmod(F.xxhash64("name", F.lit(3)), F.lit(count)).cast("int")
        blocks = typed.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        trees = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

        def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            canon = Canon(list(zip(b.e, b.n)))
            got = canon.nearest(list(a.name))
            return pd.DataFrame({"name": a.name, "d": [g[0] for g in got], "e": [g[1] for g in got], "s": [g[2] for g in got]})

        won = blocks.groupBy("shard", "block").cogroup(trees.groupBy("shard", "block")).applyInPandas(one, "name string, d int, e long, s string")
        # The winners of the shards: a tie is one between spellings (or within a shard, where the entry is 0), not between ids.
        won = won.filter("d < 99").groupBy("name", "d").agg(F.min("e").alias("e"), F.min("s").alias("s"), F.max("s").alias("s2"))
        won = won.groupBy("name").agg(F.min(F.struct("d", F.when(F.col("s") == F.col("s2"), F.col("e")).otherwise(F.lit(0)).alias("e"))).alias("w")).select("name", "w.*")
    best = vals.join(won, "name", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("d", F.lit(99)).alias("d"), F.coalesce("e", F.lit(0)).alias("e"))).alias("b"))
    found = F.col("b.e") != 0
    return best.select(F.col("key").alias(key), F.col("b.e").alias("entry_id"), F.when(found, F.col("b.d")).alias("distance"))

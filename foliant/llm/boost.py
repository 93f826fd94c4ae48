"""Gradient-boosted trees for a few numeric features, in numpy: logistic loss, depth-limited trees over quantile bins.

`Boosted.fit` takes arrays, `fit_rows` a table of packed rows of any size. Trees are grown level by level from sums over bins: of rows in the driver while these are
at most AT_HAND (a byte a feature), else of sums that the tasks make. Every row is used: with more than ROWS rows they are dealt to chunks, at most one for each tree, and
the trees take the chunks in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import in_batches
from foliant.session import stored

ROWS, AT_HAND = 20_000, 2_000_000
#: Rows are dealt to so many parts by a hash; a multiple of the usual numbers of trees.
PARTS = 720
PACKED = "part binary, y binary, x binary"


class Boosted:
    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.bias, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float32), np.asarray(y, float)
        cuts = [self.cuts(*np.unique(x[:, j], return_counts=True)) for j in range(x.shape[1])]
        return self.grow(cuts, AtHand(_codes(x, cuts).T, y, np.zeros(len(y), int)), len(y), y.sum())

    def cuts(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The bounds of the bins, from the values of a feature and how often each stands."""
        total = counts.cumsum()
        at = np.linspace(0, 1, self.bins + 1)[1:-1] * (total[-1] - 1)
        low, high = (values[np.searchsorted(total, i, "right")].astype(float) for i in (np.floor(at), np.ceil(at)))
        return np.unique((low + (high - low) * (at - np.floor(at))).astype(np.float32))

    def grow(self, cuts: list[np.ndarray], rows: AtHand | Apart, n: int, positive: float) -> Boosted:
        width = self.bins + 1
        chunks = max(1, min(self.trees, n // ROWS))
        p0 = min(max(positive / n, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(p0 / (1 - p0)))
        rows.begin(self.bias, self.rate, chunks)
        coded: list[list] = []
        for t in range(self.trees):
            tree: list = [(-1, 0, 0, 0, 0.0)]
            nodes = [0]
            for _ in range(self.depth):
                if not nodes:
                    break
                s = rows.sums(coded, tree, nodes, t % chunks, len(cuts), width).cumsum(3)
                after = []
                for me, (n_, gs, hs) in zip(nodes, s.transpose(1, 0, 2, 3)):
                    total, total_g, total_h = n_[0, -1], gs[0, -1], hs[0, -1]
                    tree[me] = (-1, 0, 0, 0, float(total_g / (total_h + 1.0)))
                    if total < 2 * self.least:
                        continue
                    gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                    gain[(n_ < self.least) | (total - n_ < self.least)] = -1
                    j, k = divmod(int(gain.argmax()), width)
                    if gain[j, k] <= 1e-6:
                        continue
                    a = len(tree)
                    tree[me] = (j, k, a, a + 1, tree[me][4])
                    tree += [(-1, 0, 0, 0, float(gs[j, k] / (hs[j, k] + 1.0))), (-1, 0, 0, 0, float((total_g - gs[j, k]) / (total_h - hs[j, k] + 1.0)))]
                    after += [a, a + 1]
                nodes = after
            coded.append(tree)
            rows.add(tree)
        self.forest = [[(j, float(cuts[j][k]) if j >= 0 else 0.0, a, b, leaf) for j, k, a, b, leaf in tree] for tree in coded]
        return self

    @staticmethod
    def _one(tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            j, cut, a, b, leaf = tree[node]
            if j < 0:
                out[at] = leaf
            else:
                left = x[at, j] <= cut
                todo += [(a, at[left]), (b, at[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        x = np.asarray(x, np.float32)
        f = np.full(len(x), self.bias)
        for t in self.forest:
            f += self.rate * self._one(t, x)
        return 1 / (1 + np.exp(-f))


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def _route(tree: list, columns: np.ndarray) -> np.ndarray:
    """The node of the tree that each row comes to. columns: the codes of each feature."""
    out = np.zeros(columns.shape[1], np.int64)
    todo: list[tuple[int, np.ndarray | None]] = [(0, None)]
    while todo:
        node, at = todo.pop()
        j, k, a, b, _ = tree[node]
        if j < 0:
            if at is not None:
                out[at] = node
            continue
        left = (columns[j] if at is None else columns[j][at]) <= k
        todo += [(n, np.flatnonzero(x) if at is None else at[x]) for n, x in ((a, left), (b, ~left))]
    return out


def _leaves(tree: list) -> np.ndarray:
    return np.array([node[4] for node in tree])


def _sums(columns: np.ndarray, y: np.ndarray, f: np.ndarray, tree: list, nodes: list[int], width: int) -> np.ndarray:
    """Of the rows that come to each of the nodes: number, gradients and curvatures in each bin of each feature."""
    slot = np.full(len(tree), -1)
    slot[nodes] = np.arange(len(nodes))
    s = slot[_route(tree, columns)]
    at = np.flatnonzero(s >= 0)
    p = 1 / (1 + np.exp(-f[at]))
    first, weights = s[at] * width, (None, y[at] - p, p * (1 - p))
    out = np.empty((3, len(nodes), len(columns), width))
    for j, column in enumerate(columns):  # a feature's bins are few: they stay in the cache
        cells = first + column[at]
        for k, w in enumerate(weights):
            out[k, :, j] = np.bincount(cells, w, len(nodes) * width).reshape(-1, width)
    return out


class AtHand:
    """Rows in the driver, a column of codes for each feature."""

    def __init__(self, columns: np.ndarray, y: np.ndarray, part: np.ndarray):
        self.columns, self.y, self.part = columns, y, part

    def begin(self, bias: float, rate: float, chunks: int) -> None:
        order = np.argsort(self.part % chunks, kind="stable")
        self.columns, self.y, self.rate = np.stack([c[order] for c in self.columns]), self.y[order], rate
        self.ends = np.bincount(self.part % chunks, minlength=chunks).cumsum()
        self.f = np.full(len(self.y), bias)

    def sums(self, coded: list, tree: list, nodes: list[int], chunk: int, features: int, width: int) -> np.ndarray:
        at = slice(self.ends[chunk - 1] if chunk else 0, self.ends[chunk])
        return _sums(self.columns[:, at], self.y[at], self.f[at], tree, nodes, width)

    def add(self, tree: list) -> None:
        self.f += self.rate * _leaves(tree)[_route(tree, self.columns)]


class Apart:
    """Rows in a table of packed codes, which stays where it is: the driver gets sums."""

    def __init__(self, table: DataFrame):
        self.table = table

    def begin(self, bias: float, rate: float, chunks: int) -> None:
        def deal(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for part, y, x in zip(b.part, b.y, b.x):
                to = np.frombuffer(part, np.int16) % chunks
                y, x = np.frombuffer(y, np.uint8), np.frombuffer(x, np.uint8).reshape(len(to), -1)
                out += [(int(c), y[to == c].tobytes(), x[to == c].tobytes()) for c in np.unique(to)]
            return pd.DataFrame(out, columns=["chunk", "y", "x"])

        self.rows = stored(in_batches(self.table, deal, "chunk int, y binary, x binary").sortWithinPartitions("chunk"), "rows")
        self.bias, self.rate = bias, rate

    def sums(self, coded: list, tree: list, nodes: list[int], chunk: int, features: int, width: int) -> np.ndarray:
        bias, rate, forest = self.bias, self.rate, list(coded)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((3, len(nodes), features, width))
            for b in batches:
                if not len(b):
                    continue
                y, x = np.frombuffer(b"".join(b.y), np.uint8), np.ascontiguousarray(np.frombuffer(b"".join(b.x), np.uint8).reshape(-1, features).T)
                f = np.full(len(y), bias)
                for t in forest:
                    f += rate * _leaves(t)[_route(t, x)]
                out += _sums(x, y, f, tree, nodes, width)
            n, g, h = out.reshape(3, -1)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"cell": at, "n": n[at], "g": g[at], "h": h[at]})

        got = self.rows.filter(F.col("chunk") == chunk).select("y", "x").mapInPandas(run, "cell long, n double, g double, h double")
        got = got.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        out = np.zeros((3, len(nodes) * features * width))
        out[:, got.cell.to_numpy()] = got[["n", "g", "h"]].to_numpy().T
        return out.reshape(3, len(nodes), features, width)

    def add(self, tree: list) -> None:
        pass


def packed(part: list[int], y: list[int], x: list[list[float]]) -> tuple[bytes, bytes, bytes]:
    """Rows as one row of a table (PACKED): their parts (any integers), classes and features."""
    return (np.array(part) % PARTS).astype(np.int16).tobytes(), np.array(y, np.uint8).tobytes(), np.array(x, np.float32).tobytes()


def fit_rows(table: DataFrame, trees: int, depth: int, least: tuple[int, int] = (21, 21), at_hand: int = AT_HAND) -> Boosted | None:
    """The trees of all packed rows; None if there are less than `least` of class 0 or of class 1."""

    def values(b: pd.DataFrame) -> pd.DataFrame:
        y = np.frombuffer(b"".join(b.y), np.uint8)
        x = np.frombuffer(b"".join(b.x), np.float32).reshape(len(y), -1) if len(y) else np.zeros((0, 0))
        out = [(-1, float(v), n) for v, n in zip(*np.unique(y, return_counts=True))]
        for j in range(x.shape[1]):
            out += [(j, float(v), n) for v, n in zip(*np.unique(x[:, j].round(3), return_counts=True))]
        return pd.DataFrame(out, columns=["j", "v", "n"])

    table = table.select("part", "y", "x")
    seen = in_batches(table, values, "j int, v double, n long").groupBy("j", "v").agg(F.sum("n").alias("n")).toPandas().sort_values(["j", "v"])
    classes = dict(zip(seen.v[seen.j < 0], seen.n[seen.j < 0]))
    if any(classes.get(float(k), 0) < n for k, n in enumerate(least)):
        return None
    m = Boosted(trees=trees, depth=depth)
    cuts = [m.cuts(own.v.to_numpy(np.float32), own.n.to_numpy()) for _, own in seen[seen.j >= 0].groupby("j")]

    def code(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(x=[_codes(np.frombuffer(x, np.float32).reshape(-1, len(cuts)), cuts).tobytes() for x in b.x])

    coded, n = in_batches(table, code, PACKED), int(sum(classes.values()))
    if n > at_hand:
        return m.grow(cuts, Apart(coded), n, classes[1.0])
    got = coded.collect()
    part, y, x = (np.frombuffer(b"".join(bytes(r[c]) for r in got), kind) for c, kind in (("part", np.int16), ("y", np.uint8), ("x", np.uint8)))
    # in the order of their content, so that sums do not depend on how the table is divided
    x = x.reshape(len(y), -1)
    order = np.lexsort((*x.T, y, part))
    return m.grow(cuts, AtHand(x[order].T, y[order].astype(float), part[order].astype(int)), n, classes[1.0])

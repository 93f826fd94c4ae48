"""Frequent-pattern growth with class counts: sets of items up to a length, and how often each class has them.

Transactions become paths of a prefix tree, items in a fixed order (frequent ones first), with a vector of class counts at each node. The
paths above the nodes of an item are its conditional transactions; growth goes on in these until the length is reached, so a
transaction of n items costs at most n^longest steps and never 2^n. `frequent_sets` grows in parallel: each group of items gets the parts of the
transactions that end with its items, and grows the sets whose last item is its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foliant.llm.common import in_batches

GROUPS = 64


def group_of(item: str, groups: int = GROUPS) -> int:
    return crc32(item.encode()) % groups


class Tree:
    """A prefix tree of transactions with the class counts of all transactions that go through a node."""

    def __init__(self, transactions: Iterable[tuple[tuple[str, ...], np.ndarray]], classes: int):
        self.item: list[str] = [""]
        self.parent: list[int] = [0]
        below: dict[tuple[int, str], int] = {}
        ends: list[tuple[int, np.ndarray]] = []
        for items, n in transactions:
            node = 0
            for x in items:
                child = below.get((node, x))
                if child is None:
                    child = below[node, x] = len(self.item)
                    self.item.append(x)
                    self.parent.append(node)
                node = child
            ends.append((node, n))
        self.counts = np.zeros((len(self.item), classes), np.int64)
        for node, n in ends:
            self.counts[node] += n
        for node in range(len(self.item) - 1, 0, -1):
            self.counts[self.parent[node]] += self.counts[node]
        self.nodes: dict[str, list[int]] = {}
        for node in range(1, len(self.item)):
            self.nodes.setdefault(self.item[node], []).append(node)

    def above(self, node: int) -> tuple[str, ...]:
        """The items over a node, from the top."""
        out = []
        while node := self.parent[node]:
            out.append(self.item[node])
        return tuple(out[::-1])


def grow(transactions: Iterable[tuple[tuple[str, ...], np.ndarray]], classes: int, longest: int, good: Callable[[np.ndarray], bool], wanted: Callable[[str], bool] | None = None) -> Iterator[tuple[tuple[str, ...], np.ndarray]]:
    """(items, class counts) of all sets of at most `longest` items whose counts are good (a condition that no superset of a set that fails it meets).
    wanted: the items that may be last in a set; the items of a transaction stand in one order throughout."""
    tree = Tree(transactions, classes)
    for item, nodes in tree.nodes.items():
        if wanted and not wanted(item):
            continue
        n = tree.counts[nodes].sum(0)
        if not good(n):
            continue
        yield (item,), n
        if longest > 1:
            paths = [(p, tree.counts[k]) for k in nodes if (p := tree.above(k))]
            for rest, m in grow(paths, classes, longest - 1, good):
                yield (*rest, item), m


def frequent_sets(transactions: DataFrame, classes: int, longest: int, good: Callable[[np.ndarray], bool], keep: Callable[[np.ndarray], bool]) -> DataFrame:
    """items array<string>, counts array<long>: `grow` over transactions (items array<string> in order, class int, n long), in parallel; of the good
    sets those that are to be kept."""

    def split(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for items, c, n in zip(b["items"], b["class"], b["n"]):
            last: dict[int, int] = {}
            for i, x in enumerate(items):
                last[group_of(x)] = i
            rows += [(g, list(items[: i + 1]), c, n) for g, i in last.items()]
        return pd.DataFrame(rows, columns=["g", "items", "class", "n"])

    def mine(b: pd.DataFrame) -> pd.DataFrame:
        own = int(b["g"].iloc[0])
        rows: dict[tuple[str, ...], np.ndarray] = {}
        for items, c, n in zip(b["items"], b["class"], b["n"]):
            rows.setdefault(tuple(items), np.zeros(classes, np.int64))[c] += n
        out = [(sorted(s), n.tolist()) for s, n in grow(rows.items(), classes, longest, good, lambda x: group_of(x) == own) if keep(n)]
        return pd.DataFrame(out, columns=["items", "counts"])

    parts = in_batches(transactions, split, "g int, items array<string>, class int, n long")
    return parts.groupBy("g").applyInPandas(mine, "items array<string>, counts array<long>")

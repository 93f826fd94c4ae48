"""Evaluation texts inside a training corpus.

All shingles of five words of the normalised test items form one Aho-Corasick automaton, which every task builds from
the broadcast items. A text is normalised to words (case, punctuation, line breaks and hyphens at them are layout), and scanned
once. Where a shingle is hit, the passage is followed in each item that has it to both sides, over single words that
were altered, dropped, added, split or joined, as long as the words around them go on in the item's order; it counts if it
covers at least 20 words of the item, most of these are unaltered and few are other words altogether. Offsets are mapped to the original text.

The driver and the broadcast are bounded: items are taken in chunks of at most CHUNK_ITEMS, one after the other, each with its own scan whose hits are
stored; one chunk is the usual case. Texts are scanned where they lie; nothing but the hits is shuffled.

Defined results: null, empty and wordless texts and items under 20 words are never found; rows of one document id count once for each item, rows of one item id with the first text; items with the same text are all found; a passage found several times in
a document is reported with the longest (of these the first) place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.names import lcs_ratio
from foliant.session import stored

SHINGLE, LEAST = 5, 20
#: Of the words a passage covers, this share at least is unaltered; of a long one (LONG words), this.
UNALTERED, LONG, UNALTERED_LONG = 0.88, 30, 0.8
#: This share of the words may be other words altogether; standing phrases differ in more, in names and numbers.
REPLACED = 0.08
CHUNK_ITEMS = 20_000
#: Words of the item and of the text that are stepped over: altered, dropped, added, split, joined.
STEPS = ((1, 1), (1, 0), (0, 1), (1, 2), (2, 1))

_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile("[\u0300-\u036f]+")
_BROKEN = re.compile(r"(?<=[^\W_])[-\u00ad\u2010\u00ac]\s*\n\s*(?=[^\W\d_])")


def words(text: str) -> list[str]:
    """The normalised words of a text: without case, accents and hyphens at line ends."""
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _WORD.findall(text)


def offsets(text: str) -> list[tuple[int, int]]:
    """The place of each of words(text) in the text itself: the text is normalised sign by sign, with the place of each."""
    signs, places = [], []
    for i, c in enumerate(text):
        for x in c if c.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", c.casefold())):
            signs.append(x)
            places.append(i)
    s = "".join(signs).casefold()  # ASCII signs keep their length
    for m in reversed(list(_BROKEN.finditer(s))):
        s = s[: m.start()] + s[m.end() :]
        del places[m.start() : m.end()]
    return [(places[m.start()], places[m.end() - 1] + 1) for m in _WORD.finditer(s)]


def follow(a: list[str], b: list[str], i: int, j: int, step: int) -> tuple[int, int, int]:
    """From a[i] = b[j] on in one direction: the last equal place (i, j) and how many words were equal on the way (the first not counted).
    A word that was altered, dropped, added, split or joined is stepped over if the text goes on in the item's order: the next two words are equal,
    or one, then after another single alteration two, or one and the item is at its end."""
    equal = 0
    n, m = len(a), len(b)

    def same(x: int, y: int) -> bool:
        return 0 <= x < n and 0 <= y < m and a[x] == b[y]

    while True:
        x, y = i + step, j + step
        while 0 <= x < n and 0 <= y < m and a[x] == b[y]:
            x, y, equal = x + step, y + step, equal + 1
        i, j = x - step, y - step
        for di, dj in STEPS:
            x, y = i + step * (di + 1), j + step * (dj + 1)
            if 0 <= x < n and 0 <= y < m and a[x] == b[y] and (not 0 <= x + step < n or same(x + step, y + step) or same(x + 2 * step, y + 2 * step) and same(x + 3 * step, y + 3 * step)):
                i, j, equal = x, y, equal + 1
                break
        else:
            return i, j, equal


def replaced(a: list[str], b: list[str]) -> int:
    """Of two passages, the words that have another word in their place, or none: no slip, doubling, splitting or joining of the word."""
    n = 0
    for tag, i0, i1, j0, j1 in SequenceMatcher(None, a, b, False).get_opcodes():
        x, y = a[i0:i1], b[j0:j1]
        if tag == "equal" or (tag == "insert" and y and all(w in (b[j0 - 1 : j0] + b[j1 : j1 + 1]) for w in y)):
            continue
        one, other = "".join(x), "".join(y)
        if one == other or (not (one.isdigit() or other.isdigit()) and lcs_ratio(one, other) >= 0.6):
            continue
        n += max(len(x), len(y))
    return n


class Items:
    """The automaton of one chunk of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.words = {}
        shingles: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            ws = words(text)
            if len(ws) >= LEAST:
                self.words[item] = ws
                for p in range(len(ws) - SHINGLE + 1):
                    shingles.setdefault(f" {' '.join(ws[p : p + SHINGLE])} ", []).append((item, p))
        self.automaton = ahocorasick.Automaton()
        same: dict[tuple[str, ...], list[int]] = {}
        for item, ws in self.words.items():
            same.setdefault(tuple(ws), []).append(item)
        self.twins = {g[0]: g for g in same.values()}
        for k, at in shingles.items():
            self.automaton.add_word(k, [(i, p) for i, p in at if i in self.twins])  # one of the items with the same words stands for all
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, first word and last word + 1 in the item, the same in the text), the longest for each item."""
        ws = words(text)
        if len(ws) < LEAST or not self.any:
            return []
        joined = f" {' '.join(ws)} "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        best: dict[int, tuple[int, int, int, int]] = {}
        done: dict[int, list[tuple[int, int, int]]] = {}
        spaces, at = 0, 0
        for end, places in hits:
            spaces += joined.count(" ", at, end + 1)
            at = end + 1
            j = spaces - 1 - SHINGLE  # the first word of the shingle
            for item, i in places:
                seen = done.setdefault(item, [])
                if any(lo <= j <= hi and abs(j - i - d) <= 3 for lo, hi, d in seen):
                    continue
                a = self.words[item]
                i0, j0, left = follow(a, ws, i, j, -1)
                i1, j1, right = follow(a, ws, i + SHINGLE - 1, j + SHINGLE - 1, 1)
                seen.append((j0, j1, j - i))
                span = i1 - i0 + 1
                if span < LEAST or left + right + SHINGLE < (UNALTERED_LONG if span >= LONG else UNALTERED) * span or (item in best and span <= best[item][1] - best[item][0]):
                    continue
                if left + right + SHINGLE == span or replaced(a[i0 : i1 + 1], ws[j0 : j1 + 1]) <= REPLACED * span:
                    best[item] = (i0, i1 + 1, j0, j1 + 1)
        return [(twin, *p) for item, p in best.items() for twin in self.twins[item]]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """key, item_id, words (of the item covered), item_from, item_to (words), start, end (characters of the document)."""
    bench = items.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").groupBy("i").agg(F.min("t").alias("t"))
    chunks = max(1, -(-bench.count() // chunk_items))
    bench = bench.withColumn("c", F.pmod(F.xxhash64("i"), F.lit(chunks)))
    kt = dict(docs.dtypes)[key]
    schema = f"key {kt}, item_id long, words int, item_from int, item_to int, start int, end int"
    df = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")
    out = None
    for c in range(chunks):
        held = docs.sparkSession.sparkContext.broadcast([(r.i, r.t) for r in bench.filter(F.col("c") == c).collect()])

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            them = Items(held.value)
            for b in batches:
                rows = []
                for k, t in zip(b.key, b.text):
                    if found := them.find(t):
                        places = offsets(t)
                        rows += [(k, x, i1 - i0, i0, i1, places[j0][0], places[j1 - 1][1]) for x, i0, i1, j0, j1 in found]
                yield pd.DataFrame(rows, columns=["key", "item_id", "words", "item_from", "item_to", "start", "end"])

        one = df.mapInPandas(run, schema)
        if chunks > 1:
            one = stored(one, "leaks")
            held.unpersist()
        out = one if out is None else out.unionByName(one)
    first = F.max_by(F.struct("words", "item_from", "item_to", "start", "end"), F.struct("words", -F.col("start")))
    return out.groupBy("key", "item_id").agg(first.alias("x")).select(F.col("key").alias(key), "item_id", "x.*")
